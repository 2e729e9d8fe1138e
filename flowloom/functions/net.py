"""Address and clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schemas import LOCAL_HOURS


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text as a 32-bit number held in a bigint."""
    octets = F.split(ip, r"\.")
    return (
        octets[0].cast("bigint") * 16777216
        + octets[1].cast("bigint") * 65536
        + octets[2].cast("bigint") * 256
        + octets[3].cast("bigint")
    )


def local_time(epoch: Column, offset_hours: int = LOCAL_HOURS) -> Column:
    """Epoch seconds as a wall clock without zone; independent of the session time zone."""
    micros = F.round(epoch.cast("double") * 1e6).cast("bigint") + offset_hours * 3_600_000_000
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def clock_on_day(day: Column, clock: Column) -> Column:
    """``Weekday-dd-mm-yyyy`` plus ``H:MM`` as a timestamp without zone."""
    parts = F.split(day, "-")
    text = F.concat(parts[3], F.lit("-"), parts[2], F.lit("-"), parts[1], F.lit(" "), clock)
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd H:mm"))
