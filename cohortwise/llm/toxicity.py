"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, width, homoglyphs of other scripts, digits and signs
that stand for letters, doubled letters. The lexicon holds beginnings of words with the log
odds of a toxic document, learned from labelled documents; exceptions are words that
begin like an entry but are not toxic, and phrases of two words that hold an entry but are not toxic; they
void the entry's hit. The weight found, related to
the length of the text, is turned into a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.texts import in_slices

# Letters of other scripts, and i and l, which digit 1 stands for both.
_LOOKALIKE = str.maketrans(
    "абвеіјкмнорсѕтухԁԛԝɑɡαβεηικνορτυχ" "l|",
    "abbeijkmhopcstyxdqwagabenikvoptux" "ii",
)
# Digits and signs written for letters.
_SIGNS = str.maketrans("0134578@$!€", "oieastbasie")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_SIGN = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[^\W\d_])|[@$!€]+(?=[^\W\d_])")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][.\-_*]){2,}[^\W\d_](?![^\W\d_])")
_DOUBLED = re.compile(r"(.)\1+")
_WORD = re.compile(r"[^\W\d_]+")

_SHORTEST, _LONGEST = 4, 10


def folded_words(text: str | None) -> list[str]:
    """The words of a text in the form in which they are matched."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text or "")).lower()
    text = _SPELLED.sub(lambda m: re.sub(r"[.\-_*]", "", m[0]), text)
    text = _SIGN.sub(lambda m: m[0].translate(_SIGNS), text).translate(_LOOKALIKE)
    return _WORD.findall(_DOUBLED.sub(r"\1", text))


def entries_of(words: Sequence[str]) -> set[str]:
    """Beginnings of the words with 4 to 10 letters, and whole words, marked by spaces."""
    out = set()
    for word in set(words):
        out.update(f" {word[:n]}" for n in range(_SHORTEST, min(len(word), _LONGEST) + 1))
        if len(word) > 2:
            out.add(f" {word} ")
    return out


def phrases_of(words: Sequence[str], begins: frozenset[str]) -> set[str]:
    """Neighbouring words, at least one of which an entry of ``begins`` hits, marked by spaces."""

    def is_hit(word: str) -> bool:
        marked = f" {word} "
        return marked in begins or any(marked[:n] in begins for n in range(_SHORTEST + 1, min(len(marked), _LONGEST + 2)))

    hit = {w for w in set(words) if is_hit(w)}
    return {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if a in hit or b in hit}


@dataclass(frozen=True)
class Lexicon:
    """Weights of entries, exceptions, and the logistic curve over a document's features."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    _built: list = field(default_factory=list, repr=False, compare=False)

    def _automaton(self):
        if not self._built:
            automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                automaton.add_word(phrase, (len(phrase), 0.0))
            automaton.make_automaton()
            self._built.append(automaton)
        return self._built[0]

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.curve)

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight per word and the logarithm of the weight; both 0 without hits."""
        words = folded_words(text)
        if not words or not self.weights and not self.exceptions:
            return 0.0, 0.0
        # Of the entries that begin at one word the heaviest counts, and none under an exception.
        at_word: dict[int, float] = {}
        voided: list[tuple[int, int]] = []
        for end, (size, weight) in self._automaton().iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight:
                at_word[start] = max(weight, at_word.get(start, 0.0))
            else:
                voided.append((start, end))
        for start, end in voided:
            for at in range(start, end):
                at_word.pop(at, None)
        total = sum(at_word.values())
        return total / (len(words) + 20), float(np.log1p(total))

    def score(self, features: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1.0 / (1.0 + np.exp(-(a + b * features[:, 0] + c * features[:, 1])))


def fit_curve(
    features: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, steps: int = 50, ridge: float = 1e-3
) -> tuple[float, ...]:
    """Logistic regression by Newton's method on standardised features; rows count by weight, all alike by default."""
    if not len(label):
        return 0.0, 0.0, 0.0
    weight = np.ones(len(label)) if weight is None else weight / weight.mean()
    mean = np.average(features, axis=0, weights=weight)
    spread = np.sqrt(np.average((features - mean) ** 2, axis=0, weights=weight)) + 1e-9
    x = np.column_stack([np.ones(len(label)), (features - mean) / spread])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + ridge * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(curvature, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    rates = w[1:] / spread
    return float(w[0] - rates @ mean), float(rates[0]), float(rates[1])


def _document_counts(
    texts: DataFrame,
    among: frozenset[str] | None = None,
    entries: Callable[[Sequence[str]], set[str]] = entries_of,
) -> DataFrame:
    """(entry, documents) over ``text``; only entries of ``among`` if it is given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            counts: Counter[str] = Counter()
            for text in batch.column(0):
                found = entries(folded_words(text.as_py()))
                counts.update(found if among is None else found & among)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["entry", "documents"],
            )

    rows = texts.select("text").mapInArrow(count, "entry string, documents long")
    return rows.groupBy("entry").agg(F.sum("documents").alias("documents"))


def _chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: float):
    """Weights of the entries, and exceptions: whole words that begin like an entry but are clean."""
    odds = {
        e: float(np.log((a + 0.5) / (n_toxic + 1.0)) - np.log((clean.get(e, 0) + 0.5) / (n_clean + 1.0)))
        for e, a in toxic.items()
    }
    strong = {e: w for e, w in odds.items() if w >= least}
    weights = {
        e: w
        for e, w in strong.items()
        # A beginning that tells as much as a longer one stands for it.
        if not any(strong.get(e[:n], 0.0) >= w - 0.3 for n in range(_SHORTEST + 1, len(e)))
    }
    begins = set(weights)
    exceptions = frozenset(
        e
        for e, w in odds.items()
        if e[-1] == " " and w < 0 and any(e[:n] in begins for n in range(_SHORTEST + 1, len(e)))
    )
    return weights, exceptions


def _exception_phrases(
    toxic: DataFrame, clean: DataFrame, weights: dict[str, float], sizes: tuple[int, int], least_documents: int
) -> frozenset[str]:
    """Phrases around hits that are commoner in clean documents than in toxic ones, each by its share."""
    begins = frozenset(weights)
    found = partial(phrases_of, begins=begins)
    usual = _document_counts(clean, entries=found).where(F.col("documents") >= least_documents)
    usual = {r["entry"]: r["documents"] for r in usual.collect()}
    if not usual:
        return frozenset()
    rare = {r["entry"]: r["documents"] for r in _document_counts(toxic, frozenset(usual), found).collect()}
    return frozenset(
        p for p, n in usual.items() if (rare.get(p, 0) + 0.5) / (sizes[0] + 1.0) < (n + 0.5) / (sizes[1] + 1.0)
    )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train: Column | None = None,
    train_rows: int = 8000,
    least_documents: int = 4,
    least_weight: float = 1.5,
) -> Lexicon:
    """A lexicon from labelled documents.

    At most ``train_rows`` documents of each label are used, those with the smallest hash
    of their id among the labels for which ``train`` holds; this bounds what is broadcast and what
    reaches the driver. Half of them give the entries (those in at least
    ``least_documents`` toxic ones), the other half the curve, in which a row weighs as many usable
    labels as it stands for, so that scores keep the balance of all labels, however many are cut. Labels other than 0 and 1, null ids
    and ids with both labels are not used. Without labels all scores are one half.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable if train is None else usable.where(train)
    one = usable.groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("other")
    ).where("label = other").withColumn("draw", F.xxhash64("id"))
    # A group per label, so two rows at most.
    usable_of = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    taken = [one.where(F.col("label") == x).orderBy("draw", "id").limit(train_rows) for x in (0, 1)]
    sample = taken[0].unionByName(taken[1]).select("id", "label", (F.pmod("draw", F.lit(2)) == 0).alias("entry_half"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # No more than 2 * train_rows rows are broadcast.
    labelled = texts.join(F.broadcast(sample), "id").select("text", "label", "entry_half").cache()
    half = {x: labelled.where(F.col("entry_half") & (F.col("label") == x)) for x in (0, 1)}
    # Entries of ``train_rows`` documents at most, so their number is bounded by the sample.
    counted = _document_counts(half[1]).where(F.col("documents") >= least_documents).collect()
    toxic = {r["entry"]: r["documents"] for r in counted}
    clean = {r["entry"]: r["documents"] for r in _document_counts(half[0], frozenset(toxic)).collect()}
    sizes = half[1].count(), half[0].count()
    weights, exceptions = _chosen(toxic, clean, *sizes, least_weight)
    exceptions |= _exception_phrases(half[1], half[0], weights, sizes, least_documents)
    lexicon = Lexicon(weights, exceptions)
    rows = _features(labelled.where(~F.col("entry_half")).select("text", "label"), lexicon, "label int").collect()
    labelled.unpersist()
    found = np.array([[r["per_word"], r["weight"]] for r in rows]).reshape(-1, 2)
    stands_for = {x: n / min(n, train_rows) for x, n in usable_of.items()}
    weight = np.array([stands_for[r["label"]] for r in rows], float)
    curve = fit_curve(found, np.array([r["label"] for r in rows], float), weight)
    return Lexicon(weights, exceptions, curve)


def _features(rows: DataFrame, lexicon: Lexicon, keep: str) -> DataFrame:
    """Feature columns for rows of (text, one other column)."""
    shared, kept = rows.sparkSession.sparkContext.broadcast(lexicon), rows.columns[1]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shared.value.features(t.as_py()) for t in batch.column(0)]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *columns], [kept, "per_word", "weight"]
            )

    return rows.mapInArrow(features, f"{keep}, per_word double, weight double")


def score_toxicity(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score) for every row of ``docs``: the probability that it is toxic.

    Only the text is used. Null and empty texts have no hits and get the curve's value there.
    Rows are scored one by one, so null ids and repeated rows need no care.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    a, b, c = lexicon.curve
    line = F.lit(a) + F.lit(b) * F.col("per_word") + F.lit(c) * F.col("weight")
    return _features(rows, lexicon, f"id {kind}").select(
        F.col("id").alias(id_col), (1.0 / (1.0 + F.exp(-line))).alias("score")
    )


def drop_toxic(
    docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [shared.value.features(t.as_py()) for t in batch.column(at)]
            scores = shared.value.score(np.array(found, float).reshape(-1, 2))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
