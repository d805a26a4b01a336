"""Operator 8: secret scans.

Three pattern kinds (assign, access, hex) and the token-efficiency test: a long
unbroken string whose characters per token under a tiktoken vocabulary fall
under ``min_chars_per_token`` reads like random data, unless it is a known
digest or an identifier, whose words have to pass the same test themselves. Each row is scanned alone, in one pass, with no
shuffle. Spans are code point offsets, end exclusive, sorted by start and then
by kind in the order of ``KINDS``.

Defined results: null and empty text have no spans; repeated rows each get a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a run starts where no member of its class precedes, so no start inside a run is tried
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_KEYWORDS = ("pass", "secret", "token", "api")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = frozenset({32, 40, 48, 56, 64, 96, 128})
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: Digests in base64 that say what they are, as web pages have them: name, separator, 16 to 64 bytes.
_NAMED_DIGEST = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-=_/](?:[A-Za-z0-9+/_-]{22}(?:==)?|[A-Za-z0-9+/_-]{27}=?|[A-Za-z0-9+/_-]{38}(?:==)?|[A-Za-z0-9+/_-]{43}=?|[A-Za-z0-9+/_-]{64}|[A-Za-z0-9+/_-]{86}(?:==)?)\Z")
_PARTS = re.compile(r"[+/_=-]+|(?<=[a-z])(?=[A-Z])")
LONG, SHORTEST = 8, 20
_WORDLIKE = re.compile(r"(?:[A-Za-z]+|[0-9]+|[A-Za-z]+[0-9]{1,4}|v[0-9]+)\Z")


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def is_known(run: str, encoding, min_chars_per_token: float) -> bool:
    """A digest in hex of a usual size or in base64 after its name, a UUID, or an identifier: words and short numbers with separators.

    Letters are words if they have the characters per token of words: each part of
    LONG letters or more by itself, and all parts together, as a short one tells little.
    """
    if _UUID.match(run) or _NAMED_DIGEST.match(run) or len(run) in _DIGEST_SIZES and _DIGEST.match(run):
        return True
    parts = [p for p in _PARTS.split(run) if p]
    if not all(_WORDLIKE.match(p) for p in parts):
        return False
    words = [w for p in parts if (w := p.rstrip("0123456789"))]
    tokens = [len(encoding.encode_ordinary(w)) for w in words]
    wordlike = all(len(w) >= min_chars_per_token * n for w, n in zip(words, tokens) if len(w) >= LONG)
    return wordlike and sum(map(len, words)) >= min_chars_per_token * sum(tokens)


def outside(start: int, end: int, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The pieces of [start, end) that no span in ``taken`` has."""
    for a, b in sorted((a, b) for _, a, b in taken if a < end and start < b):
        if start < a:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def random_spans(text: str, taken: list[tuple[str, int, int]], encoding, min_chars_per_token: float) -> list[tuple[str, int, int]]:
    """Long runs that the test takes for random; of a run that has a span already, what lies beside it is tested by itself."""
    found = []
    for m in _RUN.finditer(text):
        if not any(map(str.isalpha, m[0])) or is_known(m[0], encoding, min_chars_per_token):
            continue
        for start, end in outside(*m.span(), taken):
            run = text[start:end]
            if end - start < SHORTEST or (end - start < len(m[0]) and (not any(map(str.isalpha, run)) or is_known(run, encoding, min_chars_per_token))):
                continue
            if len(run) / len(encoding.encode_ordinary(run)) < min_chars_per_token:
                found.append(("random", start, end))
    return found


def scan_secrets(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", min_chars_per_token: float = 2.2) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of each row."""
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary_path)
        for b in batches:
            offsets, kinds, starts, ends = [0], [], [], []
            for scalar in b.column("text"):
                text = scalar.as_py() or ""
                spans = base_spans(text)
                spans += random_spans(text, spans, encoding, min_chars_per_token)
                for kind, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]])):
                    kinds.append(kind)
                    starts.append(s)
                    ends.append(e)
                offsets.append(len(kinds))
            spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=["doc_id", "spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return scanned.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
