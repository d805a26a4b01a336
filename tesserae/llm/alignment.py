"""Operator 13: alignment of two tokenizers over the same bytes.

Python tokenises: a byte-level vocabulary (A, over a space and the text) and a piece
model (B, which adds that space itself) give ids and byte ends of each chunk of the
texts, and a chunk is cut into units where tokens of both sides end. No group and no
link crosses such a place, so a unit is a group. A batch of texts is a row of its
distinct units, of which units each distinct chunk has and of which chunks each text
has: a unit is aligned once a batch however many chunks repeat it, and a chunk put
together once. All that follows are Spark's own functions. Both ends of a unit merged
in order are its links: between two neighbouring ends lies one token of A and one of
B, and two tokens overlap in one such stretch, so a unit has as many links as it has
different ends; the place of an end in the merged order tells how many tokens of the
other side came before it, so one pass makes all links. A chunk's groups and links
are those of its units in order, a text's those of its chunks.

Counts of id pairs over the corpus are sums of links, folded before the shuffle.
Each link then needs its pair's count. Pairs that hold a ``BROADCAST``th of all
links or more are at most ``BROADCAST``, whatever the corpus: they are broadcast,
and links meet them where they are; links of rarer pairs, folded by row, meet
theirs by a shuffle, which has no hot keys. Which ids of B have which highest count
is a table as long as its vocabulary.

Defined results: null and empty texts, and those whose tokens' bytes joined differ
from the space and the text (a text that holds the piece model's own space mark),
have no tokens and zero counts; strings of special tokens are plain text; rows
that share an id or are repeated each get a row and count each for itself in the
corpus; further columns are ignored; an empty table gives an empty result. A text
is limited by the size of a Spark row, about 500 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sentence_pieces import MARK, ChunkTable, _Numbers
from .shared import written
from .token_counts import _LONG_SPACE, _byte_encoder, _library

#: Pairs of so large a share of all links are broadcast.
BROADCAST = 1 << 19
TOKENS = """docs array<struct<doc_id: bigint, row: bigint, n_a: bigint, n_b: bigint, of: array<int>>>,
    chunks array<array<int>>, units array<struct<a_ids: array<int>, a_ends: array<int>, b_ids: array<int>, b_ends: array<int>>>"""
#: A space with white space or nothing beside it (Unicode's, as both pre-tokenisers have it); then only spaces between other characters cut.
_PLAIN = re.compile(r"^ | $|\s | \s").search
_CUT = re.compile(r"(?<=\S) (?=\S)")
_INDEX, _SIDE = (1 << 31) - 1, 1 << 31


@lru_cache(maxsize=2)
def _byte_ids(path: str):
    """texts -> ids of a byte-level vocabulary, special tokens' strings as plain text; and the bytes of each id."""
    encoder, _ = _byte_encoder(path)
    plain = None

    def encode(texts: list[str]) -> list[list[int]]:
        nonlocal plain
        out = []
        for text in texts:
            if len(text) >= 10_000 and _LONG_SPACE.search(text):
                if plain is None:
                    from tokenizers import Tokenizer

                    plain = Tokenizer.from_str(_library(path).to_str())
                    plain.encode_special_tokens = True
                out.append(plain.encode(text, add_special_tokens=False).ids)
            else:
                out.append(encoder.encode_ordinary(text))
        return out

    entries = [b""] * (encoder.max_token_value + 1)
    for i in range(len(entries)):
        try:
            entries[i] = encoder.decode_single_token_bytes(i)
        except KeyError:
            continue
    return encode, entries


def _piece_entries(sp) -> list[bytes]:
    """The bytes of each piece: its text with the mark as a space, or the byte that it names."""
    of = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode()
    return [of(i) for i in range(sp.get_piece_size())]


def _lists(stops: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(stops.astype(np.int32), pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def _gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``pool`` put one after the other: where each begins (and the last ends), and the values."""
    stops = np.concatenate([[0], np.cumsum(size)])
    return stops, pool[np.arange(int(stops[-1])) + np.repeat(start - stops[:-1], size)]


class TokenTable:
    """Distinct chunks of texts and the units that they are made of, each chunk tokenised once.

    A space between two characters that are no white space begins a token on both
    sides whatever surrounds it, so texts fall into chunks there. What is no such
    place stays within a chunk, which then is as long as it takes. A unit is told by
    its ids of both sides, those of B with the bit ``_SIDE``.
    """

    def __init__(self, byte_path: str, piece_path: str, max_chunks: int = 400_000):
        self.encode_bytes, a = _byte_ids(byte_path)
        # refuses models whose pieces cross a mark or that fold white space
        self.sp = ChunkTable(piece_path).sp
        self.entries, self.max_chunks = (a, _piece_entries(self.sp)), max_chunks
        self.widths = [np.array([len(x) for x in e], np.int64) for e in self.entries]
        self.clear()

    def clear(self) -> None:
        self.numbers, self.units, self.whole = _Numbers(), _Numbers(), np.zeros(0, bool)
        self.pool, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks without the space before each."""
        return text.split(" ") if _PLAIN(text) is None else _CUT.split(text)

    def arrays(self, texts: list[str | None]) -> tuple[list[pa.Array], pa.Array, list[pa.Array]]:
        """n_a, n_b and the places of their chunks of texts; the places of their units of the distinct chunks; a_ids, a_ends, b_ids, b_ends of the distinct units."""
        if len(self.numbers) > self.max_chunks:
            self.clear()
        number, of, counts = self.numbers.__getitem__, [], []
        for t in texts:
            c = self.chunks(t) if t else []
            of.extend(map(number, c))
            counts.append(len(c))
        new, self.numbers.new = self.numbers.new, []
        if new:
            self._add(new)
        of, counts = np.fromiter(of, np.int64, len(of)), np.array(counts, np.int64)
        # a text with a chunk whose bytes differ has no tokens
        text = np.repeat(np.arange(len(texts)), counts)
        wrong = np.zeros(len(texts), bool)
        wrong[text[~self.whole[of]]] = True
        of, counts = of[~wrong[text]], np.where(wrong, 0, counts)
        stops = np.concatenate([[0], np.cumsum(counts)])
        sizes = [pa.array(np.diff(np.concatenate([[0], np.cumsum(n[of])])[stops])) for n in self.tokens]
        distinct, place = np.unique(of, return_inverse=True)
        starts, units = _gathered(self.pool, self.start[distinct], self.size[distinct])
        used, unit = np.unique(units, return_inverse=True)
        return [*sizes, _lists(stops, place)], _lists(starts, unit), self._unit_arrays(used)

    def _add(self, new: list[str]) -> None:
        """Tokenises chunks and cuts them where tokens of both sides end."""
        marked = [" " + c for c in new]
        n_bytes = np.fromiter((len(c.encode()) for c in marked), np.int64, len(new))
        sizes, flats, fits = [], [], np.ones(len(new), bool)
        for ids, entries, width in zip((self.encode_bytes(marked), self._pieces(new)), self.entries, self.widths):
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
            chunk = np.repeat(np.arange(len(new)), size)
            # the entries joined are a space and the chunk: seen at once for all, or one by one where any differs
            same = (np.bincount(chunk, width[flat], len(new)) == n_bytes).all() and b"".join(map(entries.__getitem__, flat.tolist())) == "".join(marked).encode()
            if not same:
                fits &= np.array([b"".join([entries[i] for i in x]) == c.encode() for x, c in zip(ids, marked)])
            sizes.append(size)
            flats.append(flat)
        # chunks that fit lie one after the other, so both sides count the same bytes
        flats = [f[np.repeat(fits, s)] for f, s in zip(flats, sizes)]
        ends = [np.cumsum(w[f]) for f, w in zip(flats, self.widths)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        unit = np.concatenate([np.searchsorted(cuts, e) for e in ends])
        tokens = np.concatenate([flats[0], flats[1] | _SIDE])[np.argsort(unit, kind="stable")]
        units = self._unit_numbers(tokens, np.bincount(unit, minlength=len(cuts)))
        n_units = np.diff(np.concatenate([[0], np.searchsorted(cuts, np.cumsum(n_bytes * fits), "right")]))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(n_units) - n_units])
        self.size, self.pool = np.concatenate([self.size, n_units]), np.concatenate([self.pool, units])
        self.tokens = [np.concatenate([n, s]) for n, s in zip(self.tokens, sizes)]
        self.whole = np.concatenate([self.whole, fits])

    def _unit_numbers(self, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of units of so many tokens each."""
        raw, first, out = tokens.astype(np.uint32).tobytes(), np.cumsum(size) - size, np.zeros(len(size), np.int32)
        number = lambda x, n: [self.units[raw[4 * i : 4 * (i + k)]] for i, k in zip(x.tolist(), n.tolist())]
        # most are a token of each side: of those each distinct one is looked up once
        pairs = np.flatnonzero(size == 2)
        _, one, which = np.unique(tokens[first[pairs]] << 32 | tokens[first[pairs] + 1], return_index=True, return_inverse=True)
        out[pairs] = np.array(number(first[pairs][one], size[pairs][one]), np.int32)[which]
        others = np.flatnonzero(size != 2)
        out[others] = number(first[others], size[others])
        return out

    def _unit_arrays(self, which: np.ndarray) -> list[pa.Array]:
        """Ids and byte ends of both sides of the units ``which``."""
        known = self.units.new
        raw = [known[u] for u in which.tolist()]
        tokens = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(raw)), np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw)))
        out = []
        for side, width in enumerate(self.widths):
            mine = tokens // _SIDE == side
            ids, size = tokens[mine] & _INDEX, np.bincount(unit[mine], minlength=len(raw))
            stops = np.concatenate([[0], np.cumsum(size)])
            ends = np.concatenate([[0], np.cumsum(width[ids])])
            out += [_lists(stops, ids), _lists(stops, ends[1:] - np.repeat(ends[stops[:-1]], size))]
        return out

    def _pieces(self, chunks: list[str]) -> list[list[int]]:
        mark = self.sp.piece_to_id(MARK)
        return [x if c else [mark] for c, x in zip(chunks, self.sp.encode(chunks, num_threads=1))]


def _tokenise(byte_path: str, piece_path: str, batch_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenTable(byte_path, piece_path)
        for whole in batches:
            texts = whole.column("text").to_pylist()
            # long texts may fill a batch: cut it into parts of bounded size
            sizes = np.cumsum([len(t) if t else 0 for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // batch_chars)) + 1).tolist(), whole.num_rows] if whole.num_rows else [0]
            for x, y in zip(cuts, cuts[1:]):
                part = whole.slice(x, y - x)
                docs, chunks, units = table.arrays(texts[x:y])
                docs = pa.StructArray.from_arrays([part.column("doc_id"), part.column("row"), *docs], names=["doc_id", "row", "n_a", "n_b", "of"])
                units = pa.StructArray.from_arrays(units, names=["a_ids", "a_ends", "b_ids", "b_ends"])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (docs, chunks, units)], names=["docs", "chunks", "units"])

    return run


def tokenised(docs: DataFrame, byte_path: str, piece_path: str, batch_chars: int = 500_000) -> DataFrame:
    """A row for each batch of docs(doc_id, text): each document with a number of its own and the places of its chunks; the places of the units of each distinct chunk; ids and byte ends of both sides of the distinct units."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return source.mapInArrow(_tokenise(byte_path, piece_path, batch_chars), TOKENS)


def _aligned(u: Column) -> Column:
    """The group and the links of a unit with merged ends."""
    wide = lambda x: x.cast("long")

    def link(x: Column, p: Column) -> Column:
        i = x.bitwiseAND(F.lit(_INDEX)).cast("int")
        pair = lambda a, b: F.shiftleft(wide(F.get(u["a_ids"], a)), 32).bitwiseOR(wide(F.get(u["b_ids"], b)))
        # of an end that both sides have, A's comes first and makes the link
        again = F.shiftright(F.get(u["merged"], p - 1), 32) == F.shiftright(x, 32)
        return F.when(x.bitwiseAND(F.lit(_SIDE)) == 0, pair(i, p - i)).when((p == 0) | ~again, pair(p - i, i))

    links = F.filter(F.transform(u["merged"], link), lambda x: x.isNotNull())
    text = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    return F.struct(F.concat(text(u["a_ids"]), F.lit("|"), text(u["b_ids"])).alias("groups"), links.alias("links"))


def linked(tokens: DataFrame) -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, n_links, groups and links (id of A in the upper 32 bits, of B in the lower) of tokenised rows."""
    wide = lambda c: c.cast("long")
    # end, side and number of each token in one long, so that sorting merges both sides
    keyed = lambda ends, side: F.transform(ends, lambda e, i: F.shiftleft(wide(e), 32).bitwiseOR(wide(i) + F.lit(side).cast("long")))
    merged = lambda c: F.sort_array(F.concat(keyed(c["a_ends"], 0), keyed(c["b_ends"], _SIDE))).alias("merged")
    named = lambda c: [c[x].alias(x) for x in ("a_ids", "b_ids")]
    of = lambda places, table, name: F.transform(places, lambda i: F.get(table, i)[name])
    # steps of their own, so that what is used more than once is made once
    units = F.transform(F.transform("units", lambda u: F.struct(*named(u), merged(u))), _aligned)
    chunk = lambda c: F.struct(
        wide(F.size(c)).alias("n_groups"),
        F.array_join(of(c, "units", "groups"), ";").alias("groups"),
        F.flatten(of(c, "units", "links")).alias("links"),
    )
    doc = lambda d: F.struct(
        *(d[x].alias(x) for x in ("doc_id", "row", "n_a", "n_b")),
        F.aggregate(d["of"], F.lit(0).cast("long"), lambda n, i: n + F.get("chunks", i)["n_groups"]).alias("n_groups"),
        F.array_join(of(d["of"], "chunks", "groups"), ";").alias("groups"),
        F.flatten(of(d["of"], "chunks", "links")).alias("links"),
    )
    t = tokens.select("docs", "chunks", units.alias("units")).select("docs", F.transform("chunks", chunk).alias("chunks")).select(F.inline(F.transform("docs", doc)))
    return t.select("doc_id", "row", "n_a", "n_b", "n_groups", wide(F.size("links")).alias("n_links"), "groups", "links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link, count and best (is it the highest of its id of B?) of each id pair."""
    counted = written(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count")), "pair-counts")
    piece = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    # a row for each id of B: as long as its vocabulary
    highest = counted.groupBy(piece.alias("__b")).agg(F.max("count").alias("__most"))
    return counted.join(F.broadcast(highest), piece == F.col("__b")).select("link", "count", (F.col("count") == F.col("__most")).alias("best"))


def link_sums(aligned: DataFrame, pairs: DataFrame, most: int = BROADCAST) -> DataFrame:
    """row, n_best, count_sum of rows with links."""
    total = pairs.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * most >= total
    near = F.broadcast(pairs.where(often).select(F.col("link").alias("__link"), "count", F.col("best").cast("long").alias("best")))  # at most ``most`` rows
    met = aligned.select("row", F.explode("links").alias("link")).join(near, F.col("link") == F.col("__link"), "left")
    # links of frequent pairs are summed up by row, those of rarer ones are folded by row and pair
    folded = met.groupBy("row", F.when(F.col("__link").isNull(), F.col("link")).alias("link")).agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"), F.count("*").alias("n"))
    folded = written(folded, "link-sums")
    rare = folded.where("link is not null").select("row", "link", "n").join(pairs.where(~often), "link")
    rare = rare.select("row", (F.col("n") * F.col("best").cast("long")).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    return folded.where("link is null").select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs(doc_id, text); the groups and links too, if asked for."""
    found = linked(tokenised(docs, byte_path, piece_path))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = written(found.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", digest, *(["groups"] if with_groups else []), "links"), "aligned")
    sums = link_sums(kept, written(pair_counts(kept), "pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = kept.join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups", "links"] if with_groups else []))
