"""Operator 2: SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary crosses from a character into a following space
marker, so a text falls into marked words (markers and the characters up to the
next marker) whose segmentations don't affect each other. Each task numbers the
distinct marked words of its rows, segments each new one once, and joins the
ids back by position: a gather over the table, in text order. The table of a
task is emptied at ``max_words`` entries, so memory is bounded; nothing is
shuffled. (A table shared by all tasks would have to move a row for each word
of each text, more than twice the input.)

Defined results: null and empty text encode to the end id alone and decode to
the empty text; repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_WORDS = re.compile(r" +[^ ]*")


class _Numbers(dict):
    """Numbers distinct words in order of first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        k = self[word] = len(self)
        return k


class ChunkTable:
    """Distinct marked words with their ids and decoded texts."""

    def __init__(self, model_path: str, max_words: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.mark = self.sp.piece_to_id(MARK)
        self.max_words = max_words
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
        if crossing:
            raise ValueError(f"pieces cross a whitespace marker: {crossing[:3]}")
        if [self.sp.id_to_piece(i) for i in self.sp.encode(" a")][:1] not in ([MARK * 2], [MARK]):
            raise ValueError("the model folds whitespace; marked words would not be independent")
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.shown: list[str] = []

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words without their first marker; the text's own first marker is the model's dummy prefix."""
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        return parts if "" not in parts else [w[1:] for w in _WORDS.findall(" " + text)]

    def _segment_new(self) -> None:
        new = self.numbers.new
        if not new:
            return
        ids = [x if w else [self.mark] for w, x in zip(new, self.sp.encode(new, num_threads=1), strict=True)]
        # decode() drops the first marker
        self.shown += [" " + t for t in self.sp.decode(ids, num_threads=1)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))])
        self.numbers.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in one array, how many each has, and the decoded texts."""
        if len(self.numbers) > self.max_words:
            self.clear()
        of, counts, number = [], [], self.numbers.__getitem__
        for t in texts:
            w = self.words(t) if t else []
            of.extend(map(number, w))
            counts.append(len(w))
        self._segment_new()
        word = np.fromiter(of, np.int64, len(of))
        size = self.size[word]
        first = np.cumsum(size) - size
        flat = self.pool[np.arange(int(size.sum())) + np.repeat(self.start[word] - first, size)]
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(size)])
        lengths = total[ends] - total[ends - np.asarray(counts, np.int64)] if len(texts) else np.zeros(0, np.int64)
        shown, at, out = self.shown, 0, []
        for n in counts:
            out.append("".join([shown[k] for k in of[at : at + n]])[1:])
            at += n
        return flat, lengths, out


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", end_id: bool = True, batch_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` with piece_ids array<int> and decoded_text; both must be new names."""
    if clash := {"piece_ids", "decoded_text"} & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = docs.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        end = table.sp.eos_id()
        for whole in batches:
            sizes = np.cumsum([len(t) if t else 0 for t in whole.column(text_col).to_pylist()])
            # long texts may fill a batch: cut it into parts of bounded size
            cuts = [0, *(np.flatnonzero(np.diff(sizes // batch_chars)) + 1).tolist(), whole.num_rows] if whole.num_rows else [0, 0]
            for a, b in zip(cuts, cuts[1:]):
                part = whole.slice(a, b - a)
                flat, lengths, shown = table.encode(part.column(text_col).to_pylist())
                if end_id:
                    stops = np.cumsum(lengths)
                    flat, lengths = np.insert(flat, stops, end), lengths + 1
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(shown, pa.string())], names=[*part.schema.names, "piece_ids", "decoded_text"])

    return docs.mapInArrow(run, _ddl(docs) + ", piece_ids array<int>, decoded_text string" if schema else "")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded rows."""
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )
