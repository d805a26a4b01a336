"""Keyed hash columns: chunk hashes, hashes under a key, range hashes, file name rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import blake3
from .hashes import MARKER, ZERO, col


def data_hash(data: Column | str) -> Column:
    """Hash of a binary column in the chunk domain."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([blake3.to_hex(x) for x in blake3.keyed_hashes([bytes(b) for b in s], blake3.DATA_KEY)], dtype=object)

    return F.pandas_udf(run, "string")(col(data))


def keyed(h: Column | str, key: str | None) -> Column:
    """A hash hashed under a key of 64 digits; no key, or the zero key, leaves it as it is."""
    if key is None or key == ZERO:
        return col(h)
    raw = blake3.from_hex(key)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([blake3.to_hex(x) for x in blake3.keyed_hashes([blake3.from_hex(d) for d in s], raw)], dtype=object)

    return F.pandas_udf(run, "string")(col(h))


def is_marker(h: Column | str) -> Column:
    return col(h) == MARKER


def shard_name(path: Column | str) -> Column:
    """The hash in a shard file's name; null for other names."""
    found = F.regexp_extract(col(path), r"(?:^|/)([0-9a-f]{64})\.mdb$", 1)
    return F.when(found != "", found)


def chosen_sha256(data: Column, provided: Column, skip: Column) -> Column:
    """None if skipped; the provided digits if they are a hash; else the data's own."""
    return F.when(~F.coalesce(skip, F.lit(False)), F.coalesce(F.when(F.lower(provided).rlike("^[0-9a-f]{64}$"), F.lower(provided)), F.sha2(data, 256)))


def split_key(key: Column | str) -> Column:
    """prefix and hash of ``prefix/hash``, at the last slash."""
    k = col(key)
    return F.struct(F.regexp_extract(k, "^(.*)/", 1).alias("prefix"), F.regexp_extract(k, "([^/]*)$", 1).alias("hash"))


def http_range(start: Column, end: Column) -> Column:
    """The header value of [start, end); an open end is left out."""
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), F.coalesce((end - 1).cast("string"), F.lit("")))


def parsed_range(text: Column | str) -> Column:
    """[start, end) of ``a-b`` with inclusive b, with or without ``bytes=``; null if it isn't one."""
    t = F.regexp_replace(col(text), "^bytes=", "")
    a, b = F.regexp_extract(t, r"^(\d+)-(\d*)$", 1), F.regexp_extract(t, r"^(\d+)-(\d*)$", 2)
    ok = (a != "") & ((b == "") | (a.try_cast("long") <= b.try_cast("long")))
    return F.when(ok, F.struct(a.try_cast("long").alias("start"), (b.try_cast("long") + 1).alias("end")))


def strictly_increasing(offsets: Column | str, size: Column | None = None) -> Column:
    """Whether offsets start at 0 and increase, up to ``size`` if it is given."""
    o = col(offsets)
    rising = (F.array_size(F.array_distinct(o)) == F.size(o)) & (F.array_sort(o) == o)
    fits = F.element_at(o, 1) == 0
    return rising & fits if size is None else rising & fits & (F.element_at(o, -1) == size)


def rebased(first: Column, more: Column) -> Column:
    """Offsets of two decoded pieces as one list: the second's, without its leading 0, go on from the first's end."""
    end = F.element_at(first, -1)
    return F.concat(first, F.transform(F.slice(more, F.lit(2), F.greatest(F.size(more) - 1, F.lit(0))), lambda x: x + end))


def chunk_offset_pairs(ranges: Column, offsets: Column) -> Column:
    """(chunk, offset) of disjoint chunk ranges whose chunks are stored one after the other."""
    ids = F.flatten(F.transform(ranges, lambda r: F.sequence(r["start"], r["end"] - 1)))
    return F.zip_with(ids, F.slice(offsets, F.lit(1), F.size(ids)), lambda c, o: F.struct(c.alias("chunk"), o.alias("offset")))
