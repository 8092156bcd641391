"""Licence phrases by a positional index of rare words, in DataFrame functions only.

A text's words are looked up in a small index: for every template the words of highest inverse document
frequency (over the whole corpus) in its mandatory phrase and where they stand. A text that holds the phrase
holds all its words, so these are also its own rarest words of the template. Each posting says where the
template would start; the starts are intersected over all postings, and a template counts if all words of
its mandatory phrase and enough of the others stand in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: ASCII other than letters and digits separates words.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    """A licence text; ``key`` is the phrase of it that must stand in place word by word."""

    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> set[int]:
        words, key = self.words, self.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return set(range(at, at + len(key)))


# The phrases whose every place is reported.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
# Opening or typical sentences of public licences.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "source and binary forms",
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee",
        "with or without fee",
    ),
)


def license_words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    words = F.split(F.translate(text, _UPPER, _UPPER.lower()), _BETWEEN)
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def document_frequencies(words: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """In how many rows each word of the templates occurs, over all rows.

    ``words`` has a column ``words``. Only as many counts as the templates have words reach the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    counts = words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counts.collect()}


def rare_places(template: Template, frequency: dict[str, int], most: int) -> list[tuple[str, int]]:
    """The ``most`` rarest words of the mandatory phrase with all their places in it."""
    key = [(w, i) for i, w in enumerate(template.words) if i in template.key_places]
    rarest = sorted({w for w, _ in key}, key=lambda w: (frequency[w], w))[:most]
    return [(w, i) for w, i in key if w in rarest]


def _shifted_hits(word: str, offset: int) -> Column:
    return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["place"] - offset)


def _starts(template: Template, frequency: dict[str, int], most: int) -> Column:
    """Where the template would start: the starts on which all postings of its rare words agree."""
    postings = [_shifted_hits(word, offset) for word, offset in rare_places(template, frequency, most)]
    agreed = F.array_distinct(postings[0])
    for starts in postings[1:]:
        agreed = F.array_intersect(agreed, starts)
    return agreed


def _in_place(template: Template, start: Column, places: set[int]) -> list[Column]:
    return [
        F.coalesce(F.get("words", start + i) == F.lit(w), F.lit(False))
        for i, w in enumerate(template.words)
        if i in places
    ]


def _coverage(template: Template, start: Column) -> Column:
    """Share of the template's words in place; 0 unless all of its mandatory phrase is."""
    every = _in_place(template, start, set(range(len(template.words))))
    key = _in_place(template, start, template.key_places)
    count = sum((c.cast("int") for c in every[1:]), every[0].cast("int"))
    whole = key[0]
    for c in key[1:]:
        whole = whole & c
    return F.when(whole, count / F.lit(float(len(every)))).otherwise(F.lit(0.0))


def _whole(template: Template, starts: str) -> Column:
    return F.filter(starts, lambda s: _coverage(template, s) == 1.0)


def _best(template: Template, starts: str) -> Column:
    shares = F.transform(starts, lambda s: _coverage(template, s))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Sequence[Template] = BASE,
    templates: Sequence[Template] = TEMPLATES,
    coverage: float = 0.8,
    rare_words: int = 3,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    ``n_base`` counts all places of the base phrases, which need all their words; first_word and last_word are
    the smallest and largest of these places, null if there is none. ``labels`` adds templates of which at least
    ``coverage`` of the words stand in place; ``score`` is the best share found, 0 if none. Null texts
    have no words. Rows are judged one by one, so null ids, repeated rows and other columns don't matter.
    """
    every = [*base, *templates]
    words = docs.select(F.col(id_col).alias("id"), license_words(F.col(text_col)).alias("words"))
    frequency = document_frequencies(words, every)
    wanted = sorted({w for t in every for w, _ in rare_places(t, frequency, rare_words)})
    hit = F.transform(
        "words",
        lambda w, i: F.when(w.isin(wanted), F.struct(w.alias("word"), i.alias("place"))),
    )
    placed = words.withColumn("hits", F.filter(hit, lambda h: h.isNotNull()))
    starts = placed.select(
        "id", "words",
        *[_starts(t, frequency, rare_words).alias(f"t{i}") for i, t in enumerate(every)],
    )
    shares = starts.select(
        "id", F.size("words").cast("long").alias("n_words"),
        *[(_whole if t in base else _best)(t, f"t{i}").alias(f"t{i}") for i, t in enumerate(every)],
    )
    base_found = [(t.label, F.size(f"t{i}") > 0) for i, t in enumerate(base)]
    more_found = [
        (t.label, F.col(f"t{i}") >= coverage) for i, t in enumerate(every) if i >= len(base)
    ]

    def listed(found: list[tuple[str, Column]]) -> Column:
        names = F.array(*[F.when(is_there, F.lit(label)) for label, is_there in found])
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ",")

    places = [f"t{i}" for i in range(len(base))]
    firsts, lasts = [F.array_min(p) for p in places], [F.array_max(p) for p in places]
    best = [F.when(there, F.lit(1.0)).otherwise(F.lit(0.0)) for _, there in base_found]
    best += [F.col(f"t{i}") for i in range(len(base), len(every))]
    return shares.select(
        F.col("id").alias(id_col), "n_words",
        sum((F.size(p) for p in places[1:]), F.size(places[0])).cast("long").alias("n_base"),
        F.array_min(F.array(*firsts)).cast("long").alias("first_word"),
        F.array_max(F.array(*lasts)).cast("long").alias("last_word"),
        listed(base_found).alias("base_labels"),
        listed(base_found + more_found).alias("labels"),
        F.array_max(F.array(*best)).alias("score"),
    )
