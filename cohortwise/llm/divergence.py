"""Which terms, and which other sources, a source differs from.

Each partition folds whole documents into stripes in memory: per language and term the number of documents
and the occurrences per source. A full table of stripes is handed out and begun anew, and all
stripes of a term are merged in the order of their keys. From the merged stripes and the
totals of the sources every divergence follows directly: blocks of stripes meet the totals of
their language, and partial sums of pairs and the best terms come out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.session import pinned

# Bytes that end a term, and A-Z in lower case.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)
_TEXT_BYTES = 1 << 20
_OUT_ROWS = 20_000
_CELLS = 1 << 19
#: Stands for documents in a stripe, where others have a term; no term is empty.
_DOCUMENTS = b""

_STRIPE = "lang string, term binary, docs long, sources array<string>, counts array<long>"
_STRIPE_ARROW = pa.schema(
    [
        ("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()),
        ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
    ]
)


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def term_counts(text: bytes, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a text, as numbers, and how often each occurs.

    Terms are runs of ASCII letters, lower-cased, and bytes beyond ASCII.
    """
    folded, start = text.translate(_FOLD), 0
    ids, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    while start < len(folded):
        end = folded.find(b" ", start + _TEXT_BYTES)
        end = len(folded) if end < 0 else end
        words = folded[start:end].split()
        found = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        more = np.unique(found, return_counts=True)
        ids, counts = _summed(np.concatenate([ids, more[0]]), np.concatenate([counts, more[1]])) if start else more
        start = end
    return ids, counts


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)


class _Table:
    """Stripes of one partition: sums per group of documents and term."""

    def __init__(self, max_cells: int) -> None:
        self.max_cells = max_cells
        self.clear()

    def clear(self) -> None:
        self.terms, self.groups = _Numbers(), _Numbers()
        self.keys, self.docs, self.counts = [], [], []
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups[lang, source] << 32
        ids, counts = term_counts(text, self.terms)
        self.keys += [group | ids, np.array([group | self.terms[_DOCUMENTS]])]
        self.counts += [counts, np.ones(1, np.int64)]
        self.docs += [np.ones(len(ids) + 1, np.int64)]
        self.held += len(ids) + 1

    def full(self) -> bool:
        """Whether the sums, brought together, are too many."""
        if self.held <= 2 * self.max_cells:
            return False
        self._fold()
        return self.held > self.max_cells

    def _fold(self) -> None:
        keys, docs, counts = _summed(*(np.concatenate(x) for x in (self.keys, self.docs, self.counts)))
        self.keys, self.docs, self.counts, self.held = [keys], [docs], [counts], len(keys)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The stripes, one row per language and term."""
        if not self.held:
            return
        self._fold()
        (keys,), (docs,), (counts,) = self.keys, self.docs, self.counts
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1))
        lang_of = langs.dictionary_encode()
        group, term = keys >> 32, keys & 0xFFFFFFFF
        stripe = (lang_of.indices.to_numpy().astype(np.int64)[group] << 32) | term
        order = np.argsort(stripe, kind="stable")
        starts = np.flatnonzero(np.diff(stripe[order], prepend=-1))
        docs = np.add.reduceat(docs[order], starts)
        ends = np.append(starts[1:], len(order))
        names = pa.array(list(self.terms), pa.binary())
        for low in range(0, len(starts), _OUT_ROWS):
            some = slice(low, low + _OUT_ROWS)
            first = order[starts[some]]
            cells = order[starts[some][0] : ends[some][-1]]
            yield _stripes(
                langs.take(pa.array(group[first])), names.take(pa.array(term[first])), docs[some],
                np.append(starts[some], ends[some][-1]) - starts[some][0],
                sources.take(pa.array(group[cells])), counts[cells],
            )


def _stripes(langs, terms, docs, offsets, sources, counts) -> pa.RecordBatch:
    offsets = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            langs, terms, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, sources),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        ],
        schema=_STRIPE_ARROW,
    )


def _folded(docs: DataFrame, max_cells: int) -> DataFrame:
    """Stripes of each partition of (lang, source, text as bytes)."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(max_cells)
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                table.add(lang, source, batch.column(2)[row].as_py())
                if table.full():
                    yield from table.batches()
                    table.clear()
        yield from table.batches()

    return docs.mapInArrow(fold, _STRIPE)


def _united(rows: pa.RecordBatch, least_docs: int, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """Stripes of rows sorted by key, and the last key's stripe apart, unless these are the ``last`` rows."""
    langs, terms = rows.column(0), rows.column(1)
    n = rows.num_rows
    new = np.ones(n, bool)
    new[1:] = pc.or_(
        pc.not_equal(langs.slice(1), langs.slice(0, n - 1)), pc.not_equal(terms.slice(1), terms.slice(0, n - 1))
    ).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    docs = np.add.reduceat(rows.column(2).to_numpy(), starts)
    kept = docs >= least_docs
    kept |= pc.equal(terms.take(pa.array(starts)), _DOCUMENTS).to_numpy(zero_copy_only=False)
    kept[-1] |= not last
    of = np.cumsum(new) - 1
    cell_of = np.repeat(of, pc.list_value_length(rows.column(3)).to_numpy(zero_copy_only=False))
    names = rows.column(3).flatten().dictionary_encode()
    wanted = kept[cell_of]
    codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[wanted]
    keys = cell_of[wanted] * max(1, len(names.dictionary)) + codes
    keys, counts = _summed(keys, rows.column(4).flatten().to_numpy()[wanted])
    stripe, codes = np.divmod(keys, max(1, len(names.dictionary)))
    ids = np.flatnonzero(kept)
    first = pa.array(starts[ids])
    out = _stripes(
        langs.take(first), terms.take(first), docs[ids], np.append(np.searchsorted(stripe, ids), len(stripe)),
        names.dictionary.take(pa.array(codes)), counts,
    )
    return (out, None) if last else (out.slice(0, len(ids) - 1), out.slice(len(ids) - 1))


def _merged(partial: DataFrame, least_docs: int) -> DataFrame:
    """One stripe per language and term with ``least_docs`` documents or more; rows are sorted by key."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip(batch.columns, _STRIPE_ARROW.types, strict=True)], schema=_STRIPE_ARROW
            )
            if open_ is not None:
                rows = pa.Table.from_batches([open_, rows]).combine_chunks().to_batches()[0]
            done, open_ = _united(rows, least_docs, last=False)
            yield done
        if open_ is not None:
            yield _united(open_, least_docs, last=True)[0]

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(merge, _STRIPE)


def stripes_of(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    least_docs: int = 3, max_cells: int = 500_000,
) -> DataFrame:
    """(lang, term, docs, sources, counts) of all rows, stored; the empty term counts documents.

    Null text, language and source are the empty string. A partition holds at most about ``max_cells``
    counts at a time, and one document's terms. No key has more rows to merge than
    tables were handed out.
    """
    plain = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    return pinned(_merged(_folded(plain, max_cells), least_docs))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / total) by long division, exact for totals up to 9 * 10^15."""
    quotient, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + whole
    return quotient + 1


class _Unit:
    """Divergences of some sources of a language over some of its terms."""

    def __init__(self, key: tuple, block: int, block_size: int, top: int) -> None:
        self.lang, self.low, self.size, self.top = key[0], block * block_size, block_size, top
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.whole = 0
        self.sums: np.ndarray | None = None

    def start(self) -> None:
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.total = np.array(self.totals, np.int64)
        self.mine = range(self.low, min(self.low + self.size, len(self.sources)))
        self.sums = np.zeros((len(self.mine), len(self.sources)), np.int64)
        self.best: list[list] = [[] for _ in self.mine]
        self.least = [-1] * len(self.mine)

    def _keep(self, i: int) -> None:
        self.best[i].sort(key=lambda pair: (-pair[0], pair[1]))
        del self.best[i][self.top :]
        if len(self.best[i]) == self.top:
            self.least[i] = self.best[i][-1][0]

    def add(self, terms: list[bytes], sources: list[list[str]], counts: list[list[int]]) -> None:
        table = np.zeros((len(terms), len(self.sources)), np.int64)
        rows = np.repeat(np.arange(len(terms)), [len(s) for s in sources])
        table[rows, [self.at[s] for stripe in sources for s in stripe]] = [c for stripe in counts for c in stripe]
        p = shares(table, self.total)
        q = shares(table.sum(axis=1), np.int64(self.whole))
        for i, g in enumerate(self.mine):
            off = p[:, g : g + 1] - p
            self.sums[i] += (off * off // p).sum(axis=0)
            over = p[:, g] - q
            value = over * over // q
            for at in np.flatnonzero((table[:, g] > 0) & (over > 0) & (value >= self.least[i])):
                self.best[i].append((int(value[at]), terms[at]))
            if len(self.best[i]) > 4 * self.top:
                self._keep(i)

    def rows(self) -> Iterator[tuple]:
        if self.sums is None:
            self.start()
        for i, g in enumerate(self.mine):
            self._keep(i)
            for h, other in enumerate(self.sources):
                if h != g:
                    yield self.lang, self.sources[g], "pair", other.encode(), int(self.sums[i, h])
            for value, term in self.best[i]:
                yield self.lang, self.sources[g], "term", term, value


def _emitted(units: DataFrame, block_size: int, top: int) -> DataFrame:
    """Partial results (lang, source, part, item, value) of units, totals first in each."""
    schema = pa.schema(
        [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())]
    )

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            key, unit = None, None
            for batch in batches:
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                row = 0
                while row < batch.num_rows:
                    if keys[row] != key:
                        if unit is not None:
                            yield from unit.rows()
                        key, unit = keys[row], _Unit(keys[row], keys[row][2], block_size, top)
                    if batch.column(3)[row].as_py() == 0:
                        unit.sources.append(batch.column(4)[row].as_py().decode())
                        unit.totals.append(batch.column(7)[row].as_py())
                        unit.whole = batch.column(8)[row].as_py()
                        row += 1
                        continue
                    if unit.sums is None:
                        unit.start()
                    most = max(1, _CELLS // len(unit.sources))
                    end = row
                    while end < batch.num_rows and end - row < most and keys[end] == key:
                        end += 1
                    part = batch.slice(row, end - row)
                    unit.add(*(part.column(i).to_pylist() for i in (4, 5, 6)))
                    row = end
            if unit is not None:
                yield from unit.rows()

        for some in itertools.batched(results(), _OUT_ROWS):
            columns = zip(zip(*some, strict=True), schema.types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)

    ordered = units.repartition("lang", "salt", "block").sortWithinPartitions("lang", "salt", "block", "kind", "item")
    return ordered.mapInArrow(emit, "lang string, source string, part string, item binary, value long")


def divergences(
    stripes: DataFrame, top: int = 200, terms_per_unit: int = 20_000, sources_per_unit: int = 256
) -> DataFrame:
    """(lang, source, part, item, value, rank) from merged stripes.

    A source's share of a term is p = 1 + floor(10^9 (count + 1) / (N + V)), V kept terms, N their
    occurrences in the source; the value against q is floor((p - q)^2 / q). Part ``pair`` has each other
    source of the language with the sum over all kept terms, part ``term`` the ``top`` terms the source holds and
    of which it has a larger share than its whole language. Ranks are by value, ties by item. Languages are dealt out in
    units of some terms and some sources; each unit begins with the totals of its language.
    """
    kept, held = stripes.where(F.length("term") > 0), stripes.where(F.length("term") == 0)
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    sums = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    # One row per language and source.
    named = held.select("lang", F.size("sources").alias("held"), F.explode("sources").alias("source"))
    named = named.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n", "v"])
    totals = pinned(
        named.withColumns(
            {"total": F.col("n") + F.col("v"), "whole": F.sum("n").over(Window.partitionBy("lang")) + F.col("v")}
        )
    )
    sized = totals.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.max("v") / terms_per_unit)).alias("salts"),
        F.ceil(F.max("held") / sources_per_unit).alias("blocks"),
    )
    block = F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block")
    none = [F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("array<long>").alias("counts")]
    heads = totals.join(sized, "lang").select("*", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")).select(
        "lang", "salt", block, F.lit(0).alias("kind"), F.col("source").cast("binary").alias("item"), *none, "total", "whole"
    )
    bodies = kept.join(sized, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("salts")).alias("salt"), block, F.lit(1).alias("kind"),
        F.col("term").alias("item"), "sources", "counts",
        F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("whole"),
    )
    partial = _emitted(heads.unionByName(bodies), sources_per_unit, top)
    # A term lies in one unit; the sums of a pair come from several.
    found = partial.groupBy("lang", "source", "part", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")
    )
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).withColumn(
        "item", F.col("item").cast("string")
    )


def source_divergences(docs: DataFrame, top: int = 200, **options) -> DataFrame:
    """Divergences of all sources of ``docs``; options are those of :func:`stripes_of`.

    Repeated rows count as documents, a group whose texts hold no kept term takes part with counts of 0, a
    language without kept terms has pairs of value 0, and an empty table gives no rows.
    """
    return divergences(stripes_of(docs, **options), top)
