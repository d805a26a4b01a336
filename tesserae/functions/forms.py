"""Text forms of ranges, sizes, times and tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashes import col

#: The units of sizes, longest name first.
UNITS = (("pib", 1024**5), ("tib", 1024**4), ("gib", 1024**3), ("mib", 1024**2), ("kib", 1024), ("pb", 1000**5), ("tb", 1000**4), ("gb", 1000**3), ("mb", 1000**2), ("kb", 1000), ("b", 1))
SHOWN = (("PB", 1000**5), ("TB", 1000**4), ("GB", 1000**3), ("MB", 1000**2), ("kB", 1000))
BINARY = (("TiB", 1024**4), ("GiB", 1024**3), ("MiB", 1024**2), ("KiB", 1024))
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def dotted_range(text: Column | str) -> Column:
    """[start, end) of ``a..b``, with null end for ``a..``; null if it isn't one or runs backwards."""
    shape = r"^(\d+)\.\.(\d*)$"
    a, b = F.regexp_extract(col(text), shape, 1).try_cast("long"), F.nullif(F.regexp_extract(col(text), shape, 2), F.lit(""))
    ok = a.isNotNull() & (b.isNull() | (a <= b.try_cast("long")))
    return F.when(ok, F.struct(a.alias("start"), b.try_cast("long").alias("end")))


def bounds_range(start: Column, start_kind: Column, end: Column, end_kind: Column) -> Column:
    """[start, end) of bounds that are included, excluded or open; null for the full range, an error where start is past end."""
    a = F.when(start_kind == "included", start).when(start_kind == "excluded", start + 1).otherwise(0).cast("long")
    b = F.when(end_kind == "included", end + 1).when(end_kind == "excluded", end).cast("long")
    bad = F.raise_error(F.concat(F.lit("a range from "), a.cast("string"), F.lit(" to "), b.cast("string")))
    whole = (a == 0) & b.isNull()
    return F.when(b < a, bad.cast("struct<start:bigint,end:bigint>")).when(~whole, F.struct(a.alias("start"), b.alias("end")))


def fetch_token(h: Column, at_ms: Column, ranges: Column) -> Column:
    """``hash:time:a-b,c-d`` in URL-safe base64 without padding; ranges is an array of structs of start and end."""
    text = F.concat_ws(":", h, at_ms.cast("string"), F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ","))
    return F.rtrim(F.translate(F.replace(F.base64(F.encode(text, "utf-8")), F.lit("\r\n")), "+/", "-_"), F.lit("="))


def parsed_token(token: Column | str) -> Column:
    """struct of hash, at_ms and ranges; null if it isn't a token."""
    t = F.translate(col(token), "-_", "+/")
    text = F.decode(F.try_to_binary(F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), "utf-8")
    shape = r"^([0-9a-f]{64}):(\d+):((?:\d+-\d+(?:,\d+-\d+)*)?)$"
    parts = F.filter(F.split(F.regexp_extract(text, shape, 3), ","), lambda x: x != "")
    ranges = F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("long").alias("start"), F.split_part(x, F.lit("-"), F.lit(2)).cast("long").alias("end")))
    return F.when(text.rlike(shape), F.struct(F.regexp_extract(text, shape, 1).alias("hash"), F.regexp_extract(text, shape, 2).cast("long").alias("at_ms"), ranges.alias("ranges")))


def parsed_size(text: Column | str) -> Column:
    """Bytes of ``1.5 MiB`` and the like, in either case, to the nearest whole; a number alone is bytes; null if it isn't a size."""
    low = F.lower(F.trim(col(text)))
    number, unit = F.regexp_extract(low, r"^([0-9.]+)\s*([a-z]*)$", 1).try_cast("double"), F.regexp_extract(low, r"^([0-9.]+)\s*([a-z]*)$", 2)
    factor = F.when(unit == "", 1)
    for name, n in UNITS:
        factor = factor.when(unit == name, n)
    return F.round(number * factor).cast("long")


def _fixed(x: Column, places: int) -> Column:
    """A double with so many places, rounded as the double is: SQL's own format rounds its shortest digits, and ties up."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: f"{v:.{places}f}", na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def _shown(n: Column, units, exact, rounded, rest: Column) -> Column:
    out = None
    for name, size in units:
        text = F.when(n % size == 0, F.concat(F.floor(n / size).cast("string"), F.lit(exact + name))).otherwise(F.concat(_fixed(n / size, rounded), F.lit(exact + name)))
        out = F.when(n >= size, text) if out is None else out.when(n >= size, text)
    return out.otherwise(rest)


def shown_size(n: Column | str) -> Column:
    """In decimal units, three places unless it is whole: 1.500MB."""
    return _shown(col(n), SHOWN, "", 3, F.concat(col(n).cast("string"), F.lit("B")))


def human_bytes(n: Column | str) -> Column:
    """In binary units, two places unless it is whole: 1.50 MiB."""
    return _shown(col(n), BINARY, " ", 2, F.concat(col(n).cast("string"), F.lit(" bytes")))


def parsed_bool(text: Column | str) -> Column:
    low = F.lower(F.trim(col(text)))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def parsed_millis(text: Column | str) -> Column:
    """Milliseconds of ``250ms``, ``20s``, ``5m``, ``2h`` or ``1d``; a number alone is seconds; null if it isn't a time."""
    shape = r"^(\d+)\s*(ms|s|sec|m|min|h|d|)$"
    low = F.lower(F.trim(col(text)))
    unit = F.regexp_extract(low, shape, 2)
    factor = F.when(unit == "ms", 1).when(unit.isin("", "s", "sec"), 1000).when(unit.isin("m", "min"), 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000)
    return F.when(low.rlike(shape), F.regexp_extract(low, shape, 1).try_cast("long") * factor)
