"""Pack documents into token sequences: concatenate all, cut at fixed lengths.

The first pass turns texts into token ids, each partition numbering its tokens as it goes, and stores
them once. Prefix sums over the partitions' totals place every partition in one long stream of tokens.
The second pass reads the stored tokens in order and cuts the stream into windows of fixed length:
a window that lies in one run of rows is a finished sequence, the open windows at both ends of a run are
boundary records, which meet by their number. Nothing else is shuffled.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from cohortwise.session import pinned, shared_path

# Fixed value: the pattern of byte-level pre-tokenization, for texts of ASCII and Latin letters, where classes
# of letters and numbers are small enough to be listed.
_LETTERS, _NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_WORDS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)
_LATIN = re.compile("[\t\n -~\u00a1-\u024f]*")
# Before a single space between two other characters every match of that pattern ends, so other texts can be cut there.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_REMEMBERED = 1 << 20
_LONGEST_REMEMBERED = 64
_TEXT_CHARS = 1 << 20
_BATCH_BYTES = 8 << 20
_PARTS_BROADCAST = 100_000


class Encoder:
    """Token ids of whole texts as little-endian bytes, ``width`` bytes an id.

    The strings of special tokens are ordinary text. With byte-level pre-tokenization and nothing before
    it, texts are cut where it cuts them too and the words, most of them seen before, are looked up; with
    other tokenizers texts are encoded whole.
    """

    def __init__(self, vocabulary: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self._whole = self._opened(vocabulary)
        self._bare = self._opened(vocabulary)
        self._bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self._code = "H" if width == 2 else "I"
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        told = json.loads(vocabulary)
        before = told.get("pre_tokenizer") or {}
        self._by_parts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not told.get("normalizer")
            and not any(t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens") or [])
        )

    @staticmethod
    def _opened(vocabulary: str) -> Tokenizer:
        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.encode_special_tokens = True
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _ids(self, tokenizer: Tokenizer, texts: Iterable[str]) -> dict[str, bytes]:
        texts = list(texts)
        found = (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        return {t: struct.pack(f"<{len(i)}{self._code}", *i) for t, i in zip(texts, found, strict=True)}

    def _joined(self, cut: list[list[str]], known: dict[str, bytes], tokenizer: Tokenizer) -> list[bytes]:
        """The ids of texts given as words; ``known`` keeps the ids of words up to a number of them."""
        met = set().union(*cut)
        new = met.difference(known)
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            new = met
        known.update(self._ids(tokenizer, new))
        joined = [b"".join(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > _LONGEST_REMEMBERED:
                del known[word]
        return joined

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self._by_parts:
            whole = self._ids(self._whole, set(texts))
            return [whole[t] for t in texts]
        latin = [_LATIN.fullmatch(t) is not None for t in texts]
        words = [_WORDS.findall(t) for t, plain in zip(texts, latin, strict=True) if plain]
        parts = [_CUT.split(t) for t, plain in zip(texts, latin, strict=True) if not plain]
        words = iter(self._joined(words, self._words, self._bare))
        parts = iter(self._joined(parts, self._parts, self._whole))
        return [next(words) if plain else next(parts) for plain in latin]


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str, width: int) -> Encoder:
    return Encoder(vocabulary, width)


def _id_width(vocabulary: str, end_id: int) -> int:
    largest = max(Tokenizer.from_str(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id)
    return 2 if largest < 1 << 16 else 4


def tokenized(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """(id, part, at, n, ids): every row's tokens and their place in its partition, stored once.

    ``vocabulary`` is the path of a tokenizer file, read here and sent to the tasks. ``end_id`` follows every document;
    a null or empty text has this token only.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        told = file.read()
    width, sent = _id_width(told, end_id), spark.sparkContext.broadcast(told)
    end = int(end_id).to_bytes(width, "little")
    id_type = docs.schema[id_col].dataType.simpleString()

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(sent.value, width), TaskContext.get().partitionId(), 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, held = [], 0
                while start + len(texts) < batch.num_rows and held < _TEXT_CHARS:
                    texts.append(batch.column(1)[start + len(texts)].as_py() or "")
                    held += len(texts[-1])
                ids = [x + end for x in encoder.encode(texts)]
                sizes = np.array([len(x) // width for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(ids)),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(at + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array([width] * len(ids), pa.int32()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["id", "part", "at", "n", "width", "ids"],
                )
                at += int(sizes.sum())
                start += len(ids)

    path = shared_path(spark, "tokens")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {id_type}, part int, at long, n long, width int, ids binary"
    texts.mapInArrow(tokens, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _placed(tokens: DataFrame, group: int = 1024) -> DataFrame:
    """Add ``pos``, the place of a row's first token in the whole stream."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # Partitions are summed in groups of 1,024 and then the groups, so no task sees all partitions of a large job.
    totals = pinned(totals.withColumn("group", F.floor(F.col("part") / group)))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy("group").agg(F.sum("total").alias("all"))
    groups = groups.select("group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    offsets = totals.withColumn("base_in", F.coalesce(F.sum("total").over(inside), F.lit(0))).join(groups, "group")
    offsets = offsets.select("part", (F.col("base") + F.col("base_in")).alias("base"))
    # One small row per partition of the first pass.
    if totals.count() <= _PARTS_BROADCAST:
        offsets = F.broadcast(offsets)
    return tokens.join(offsets, "part").withColumn("pos", F.col("base") + F.col("at")).drop("base")


class _Cutter:
    """Windows of one task's rows, finished or open at an end."""

    def __init__(self, length: int, schema: pa.Schema) -> None:
        self.length, self.schema = length, schema
        self.number, self.first, self.end = -1, 0, 0
        self.ids: list[bytes] = []
        self.segments: list[dict] = []
        self.rows: list[dict] = []
        self.held = 0

    def close(self) -> None:
        """Hand out the current window."""
        if self.segments:
            ids = b"".join(self.ids)
            self.rows.append(
                {"sequence_id": self.number, "first": self.first, "n_tokens": self.end - self.first,
                 "ids": ids, "segments": self.segments}
            )
            self.held += len(ids)
        self.ids, self.segments = [], []

    def add(self, doc, pos: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, n = 0, len(ids)
        while start < n:
            number, offset = divmod(pos + start, self.length)
            if not self.segments or number != self.number or offset != self.end:
                self.close()
                self.number, self.first = number, offset
            taken = min(self.length - offset, n - start)
            self.ids.append(ids[start : start + taken].tobytes())
            self.segments.append(
                {"id": doc, "start": start, "length": taken, "doc_tokens": n, "offset": offset}
            )
            start, self.end = start + taken, offset + taken
            if self.held >= _BATCH_BYTES:
                yield self.batch()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, self.schema)


def sequences(tokens: DataFrame, length: int = 1024) -> DataFrame:
    """(sequence_id, n_tokens, ids, segments) of the stored ``tokens``.

    ``ids`` are little-endian unsigned 32-bit ids, unpadded; each segment (id, start, length, doc_tokens,
    offset) says which tokens of which document lie where. All sequences but the last have ``length``
    tokens. Order follows the partitions of the stored table; an empty table gives no rows.
    """
    id_type = tokens.schema["id"].dataType.simpleString()
    segment = f"struct<id:{id_type},start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>"
    schema = f"sequence_id long, first long, n_tokens long, ids binary, segments array<{segment}>"
    arrow = pa.schema(
        [
            ("sequence_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
            ("segments", pa.list_(pa.struct([
                ("id", _arrow_type(id_type)), ("start", pa.int64()), ("length", pa.int64()),
                ("doc_tokens", pa.int64()), ("offset", pa.int64()),
            ]))),
        ]
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(length, arrow)
        for batch in batches:
            docs, places, widths, ids = (batch.column(i) for i in range(4))
            for row in range(batch.num_rows):
                found = np.frombuffer(ids[row].as_py(), f"<u{widths[row].as_py()}").astype("<u4")
                yield from cutter.add(docs[row].as_py(), places[row].as_py(), found)
        cutter.close()
        if cutter.rows:
            yield cutter.batch()

    # Rows of a part follow one another in its file; a reader that begins or ends inside one leaves open windows.
    windows = pinned(_placed(tokens).select("id", "pos", "width", "ids").mapInArrow(cut, schema))
    whole = windows.where(F.col("n_tokens") == length).drop("first")
    # A window has at most as many boundary records as tokens.
    pieces = windows.where(F.col("n_tokens") < length).groupBy("sequence_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "ids", "segments"))).alias("p"),
    )
    joined = pieces.select(
        "sequence_id", "n_tokens",
        F.aggregate("p", F.lit(b""), lambda all_, piece: F.concat(all_, piece["ids"])).alias("ids"),
        F.flatten(F.transform("p", lambda piece: piece["segments"])).alias("segments"),
    )
    return whole.unionByName(joined)


def _arrow_type(name: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    if name not in known:
        raise ValueError(f"document ids of type {name} are not supported")
    return known[name]


def pieces_of(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per segment: (id, start, length, ids, doc_tokens, sequence_id, offset)."""
    one = packed.select("sequence_id", F.col("ids").alias("all"), F.explode("segments").alias("s"))
    return one.select(
        F.col("s.id").alias(id_col), "s.start", "s.length",
        F.substring("all", F.col("s.offset") * 4 + 1, F.col("s.length") * 4).alias("ids"),
        "s.doc_tokens", "sequence_id", "s.offset",
    )


def pack_tokens(
    docs: DataFrame, vocabulary: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """Sequences of at most ``length`` tokens of all rows of ``docs``; see :func:`sequences`.

    Every row is a document, also where ids repeat or are null; other columns are ignored.
    """
    return sequences(tokenized(docs, vocabulary, id_col, text_col, end_id), length)
