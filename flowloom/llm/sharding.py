"""Shards by extendible hashing: only a bucket over the byte limit splits, on the next bit of its hash prefix.

One pass sums bytes and rows of every entry of a directory of ``STEP`` bits; rolled up to all shorter prefixes it
gives each bucket's depth. Only entries that are still too large get a further directory, one level down. Rows find
their bucket by an equality join with the directory's entries. Rows of one key share all bits of its hash; where they are
too many for a shard, they go on splitting by the bits of a second hash, over the text and a number of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.session import broadcast_if_small, cut_lineage, spread

HASH_BITS = 60
#: Bits of one directory: at most 2^STEP entries below each bucket that is still too large.
STEP = 12
DIRECTORY_ROWS = 200_000


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a number; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(h: Column, depth: Column) -> Column:
    """The first ``depth`` bits as a text of zeros and ones."""
    return F.substr(F.lpad(F.bin(h), HASH_BITS, "0"), F.lit(1), depth)


def split_directory(sized: DataFrame, limit: int, by: tuple[str, ...] = ()) -> list[DataFrame]:
    """Directories, one per level: (entry, depth) where ``depth`` is null for an entry that the next level splits.

    ``sized`` has ``h`` and ``n_bytes``, and ``by``, for each value of which there is a directory of its own. A bucket is done when its bytes fit, it has one row, or its bits are used up.
    """
    levels, above = [], None
    rows = sized
    for base in range(0, HASH_BITS, STEP):
        top = base + STEP
        if above is not None:
            rows = sized.withColumn("entry_above", F.shiftright("h", HASH_BITS - base)).join(broadcast_if_small(above, DIRECTORY_ROWS), [*by, "entry_above"])
        entries = rows.groupBy(*by, F.shiftright("h", HASH_BITS - top).alias("entry")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        entries = cut_lineage(entries)
        depths = F.sequence(F.lit(base), F.lit(top))
        up = entries.select(*by, "entry", "n_bytes", "n", F.explode(depths).alias("depth")).withColumn("at", F.expr(f"shiftright(entry, {top} - depth)"))
        sums = up.groupBy(*by, "depth", "at").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))
        fits = (F.col("n_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == HASH_BITS)
        done = sums.where(fits).select(*by, "depth", "at")
        directory = cut_lineage(
            up.select(*by, "entry", "depth", "at").join(done, [*by, "depth", "at"]).groupBy(*by, "entry").agg(F.min("depth").alias("depth"))
        )
        directory = entries.select(*by, "entry").join(directory, [*by, "entry"], "left")
        levels.append(directory)
        above = directory.where("depth IS NULL").select(*by, F.col("entry").alias("entry_above"))
        if above.isEmpty():
            break
    return levels


def _with_depth(rows: DataFrame, h: str, directories: list[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``depth``: what the directories say of the hash in the column ``h``."""
    found, kept = F.lit(None).cast("int"), rows.columns
    for k, directory in enumerate(directories):
        entry, depth = f"_entry{k}", f"_depth{k}"
        level = broadcast_if_small(directory.select(*by, F.col("entry").alias(entry), F.col("depth").alias(depth)), DIRECTORY_ROWS)
        rows = rows.withColumn(entry, F.shiftright(h, HASH_BITS - STEP * (k + 1))).join(level, [*by, entry], "left")
        found = F.coalesce(found, F.col(depth))
    return rows.withColumn("depth", found.cast("int")).select(*kept, "depth")


def assign_shards(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with ``shard`` (its prefix bits), ``depth`` and ``n_bytes`` (of ``text``, UTF-8).

    Every shard's bytes are at most ``limit``, unless it is a single row that is larger. Rows of one key stay together
    while they fit; else their shards have the 60 bits of the key's hash and, behind them, bits of a second hash. A null
    text has 0 bytes; a null key is one key, and repeated rows are rows of one key, so ties need no rule. A very long text
    is one row. An empty table gives an empty one. Columns of ``docs`` named like the three are replaced.
    """
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(n).alias(c) for c, n in names.items() if c not in ("shard", "depth", "n_bytes")]
    size = F.coalesce(F.octet_length(F.col(names["text"]).cast("string")), F.lit(0)).cast("bigint")
    out = docs.toDF(*names.values()).withColumns({"n_bytes": size, "_h": hash_bits(F.col(names[key]))})
    sized = cut_lineage(out.select(F.col("_h").alias("h"), "n_bytes"))
    out = _with_depth(out, "_h", split_directory(sized, limit)).withColumn("shard", prefix(F.col("_h"), F.col("depth")))
    heavy = sized.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    heavy = cut_lineage(heavy.where((F.col("n_bytes") > limit) & (F.col("n") > 1)).select(F.col("h").alias("_h")))
    if not heavy.isEmpty():
        heavy = broadcast_if_small(heavy, DIRECTORY_ROWS)
        parted = out.join(heavy, "_h", "left_semi").withColumn("_row", F.monotonically_increasing_id())
        parted = cut_lineage(parted.withColumn("_h2", hash_bits(F.concat_ws("|", F.xxhash64(names["text"]).cast("string"), F.col("_row").cast("string")))))
        second = split_directory(parted.select("_h", F.col("_h2").alias("h"), "n_bytes"), limit, ("_h",))
        parted = _with_depth(parted.withColumnRenamed("depth", "_above"), "_h2", second, ("_h",))
        parted = parted.withColumns({"shard": F.concat("shard", prefix(F.col("_h2"), F.col("depth"))), "depth": F.col("_above") + F.col("depth")})
        out = out.join(heavy, "_h", "left_anti").unionByName(parted.select(*out.columns))
    return out.select(*back, "shard", "depth", "n_bytes")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id") -> None:
    """Parquet with one directory per shard; a task holds whole shards, none of them above the limit."""
    rows = assign_shards(docs, limit, key).withColumn("shard", F.concat(F.lit("b"), "shard"))
    spread(rows, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
