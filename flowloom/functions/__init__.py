"""Column expressions: everything here takes and returns ``Column`` and stays in the JVM."""
