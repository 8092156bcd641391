"""K-means of several starts side by side.

Every round is one aggregation for all starts: points are multiplied by the open starts, each is
given its nearest centre, and counts, sums and squares per start and centre come back, a few rows whatever
the number of points. Starts are drawn as in k-means++: a point's chance is its squared distance to the centres
drawn so far, by a race of exponential arrival times from a hash, so a draw is one minimum.

Now and then the rounds make a new base: each point's centre of that round, and by how much it is nearer than the next.
While no centre of a start has moved by half of that since, the point cannot change sides. Sums of such
settled points, kept by bands of that distance, are added as they are; only open bands are read again.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

Point = tuple[float, ...]

#: Bands of the distance by which a centre is nearer than the next: half powers of two from 2^-20 up.
_BANDS = 44
_LOWEST = 40
_FIRST_BASE = 16
_DIGITS = 13
_ROWS_PER_PARTITION = 250_000


@dataclass
class Start:
    """One start: its centres, the cost found for the centres before, and how far they moved last."""

    number: int
    centres: list[Point]
    cost: float = math.inf
    moved: float = math.inf
    rounds: int = 0
    base: list[Point] = field(default_factory=list)

    def farthest(self) -> float:
        """The longest way of a centre since the base."""
        return max(math.dist(a, b) for a, b in zip(self.centres, self.base, strict=True))

    def advance(self, sums: dict[int, list[float]], dims: int) -> None:
        """New centres from (count, squares, sums per column) of each centre's points; an empty one stays."""
        cost, moved, centres = 0.0, 0.0, []
        for i, old in enumerate(self.centres):
            n, squares, *total = sums.get(i, [0, 0.0, *[0.0] * dims])
            if not n:
                centres.append(old)
                continue
            new = tuple(t / n for t in total)
            cost += squares - 2 * sum(o * t for o, t in zip(old, total, strict=True)) + n * sum(o * o for o in old)
            moved += sum((a - b) ** 2 for a, b in zip(new, old, strict=True))
            centres.append(new)
        self.centres, self.cost, self.moved, self.rounds = centres, cost, moved, self.rounds + 1


def _starts(starts: Sequence[Start], **more: dict[int, int]) -> str:
    """One row per start: its number and its centres' values m0, m1, ..., laid end to end.

    A constant of plain fields, so that generated code stays small and is the same in every round.
    """
    rows = []
    for start in starts:
        values = [f"{float(x)!r}D AS m{i}" for i, x in enumerate(x for centre in start.centres for x in centre)]
        rows.append(f"struct({', '.join([f'{start.number} AS start', *[f'{v[start.number]} AS {n}' for n, v in more.items()], *values])})")
    return f"explode(array({', '.join(rows)})) AS s"


def _distances(cols: Sequence[str], k: int) -> str:
    """Columns d0, d1, ... with the squared distances to the centres in ``s``."""
    n = len(cols)
    off = [[f"({c} - s.m{i * n + j})" for j, c in enumerate(cols)] for i in range(k)]
    return ", ".join(f"{' + '.join(f'{o} * {o}' for o in row)} AS d{i}" for i, row in enumerate(off))


def _nearest(k: int) -> str:
    """The smallest of d0, d1, ...; the first of equal ones."""
    cases = [
        f"WHEN {' AND '.join(f'd{i} <= d{j}' for j in range(k) if j != i)} THEN {i}" for i in range(k - 1)
    ]
    return f"CASE {' '.join(cases)} ELSE {k - 1} END" if k > 1 else "0"


def _sums(cols: Sequence[str]) -> str:
    squares = " + ".join(f"{c} * {c}" for c in cols)
    return ", ".join(["count(1) AS n", f"sum({squares}) AS q", *[f"sum({c}) AS t{i}" for i, c in enumerate(cols)]])


class _Held:
    """Rows kept in memory or on disk under a name of their own, until they are let go.

    Rounds are SQL statements over that name, which are quicker to build than chains of calls.
    """

    def __init__(self, df: DataFrame) -> None:
        self.spark, self.df, self.name = df.sparkSession, df.persist(StorageLevel.MEMORY_AND_DISK), f"kmeans_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(self.name)

    def read(self, sql: str) -> DataFrame:
        """``sql`` with {rows} as the name of these rows."""
        return self.spark.sql(sql.replace("{rows}", self.name))

    def release(self) -> None:
        self.df.unpersist()
        self.spark.catalog.dropTempView(self.name)


def draw_starts(points: _Held, key: str, cols: Sequence[str], k: int, seed: int, n_init: int) -> list[Start]:
    """``n_init`` starts of ``k`` centres, or fewer where there are fewer different points.

    A draw depends on the points' keys and values, not on how they are partitioned.
    """
    starts = [Start(i, []) for i in range(n_init)]
    for step in range(k):
        # Every draw so far found a point, so all starts have the same number of centres.
        distances = f"{_distances(cols, step)}," if step else ""
        weight = "1D" if not step else f"least({', '.join(f'd{i}' for i in range(step))}, double('inf'))"
        u = (
            f"(cast(conv(substr(md5(concat_ws('|', {key}, {seed} + s.start, {step})), 1, {_DIGITS}), 16, 10) AS double)"
            f" + 0.5D) / {float(16**_DIGITS)!r}D"
        )
        drawn = {r[0]: tuple(r[1]) for r in points.read(f"""
            SELECT start, min_by(z, struct(-ln(u) / w AS arrival, {key})) FROM (
              SELECT start, z, u, {key}, {weight} AS w FROM (
                SELECT s.start AS start, array({', '.join(cols)}) AS z, {distances} {u} AS u, {key}
                FROM (SELECT {key}, {', '.join(cols)}, {_starts(starts)} FROM {{rows}})))
            WHERE w > 0 GROUP BY start""").collect()}
        if len(drawn) < len(starts):
            break
        for start in starts:
            start.centres.append(drawn[start.number])
    return [s for s in starts if s.centres]


class _Rounds:
    """Rounds over the points, from the newest base where there is one."""

    def __init__(self, points: _Held, cols: Sequence[str]) -> None:
        self.points, self.cols = points, cols
        self.base: _Held | None = None
        self.settled: dict[tuple[int, int, int], list] = {}

    def rebase(self, starts: Sequence[Start]) -> None:
        """Store each point's centre and band for the centres as they are."""
        self.close()
        cols, k = self.cols, len(starts[0].centres)
        ordered = f"sort_array(array({', '.join(f'd{i}' for i in range(k))}))"
        ahead = f"sqrt({ordered}[1]) - sqrt({ordered}[0])" if k > 1 else f"{2.0**_BANDS!r}D"
        self.base = _Held(self.points.read(f"""
            SELECT start, {', '.join(cols)}, c, cast(CASE WHEN ahead > 0 THEN
              greatest(0, least({_BANDS}, {_LOWEST} + floor(2 * log2(ahead)))) ELSE 0 END AS int) AS band
            FROM (SELECT *, {_nearest(k)} AS c, {ahead} AS ahead FROM (
              SELECT s.start AS start, {', '.join(cols)}, {_distances(cols, k)}
              FROM (SELECT {', '.join(cols)}, {_starts(starts)} FROM {{rows}})))""").sortWithinPartitions("band"))
        folded = self.base.read(f"SELECT start, c, band, {_sums(cols)} FROM {{rows}} GROUP BY start, c, band")
        self.settled = {(r[0], r[1], r[2]): list(r[3:]) for r in folded.collect()}
        for start in starts:
            start.base = start.centres

    def advance(self, starts: Sequence[Start]) -> None:
        cols, k = self.cols, len(starts[0].centres)
        sums: dict[int, dict[int, list]] = {s.number: {} for s in starts}
        source, opened = self.points, f"SELECT {', '.join(cols)}, {_starts(starts)} FROM {{rows}}"
        if self.base is not None:
            open_below = {s.number: _open_bands(s.farthest()) for s in starts}
            for (number, c, band), found in self.settled.items():
                if number in sums and band >= open_below[number]:
                    _add(sums[number], c, found)
            source, opened = self.base, f"""
                SELECT {', '.join(cols)}, s FROM (
                  SELECT {', '.join(cols)}, start, band, {_starts(starts, below=open_below)} FROM {{rows}}
                  WHERE band < {max(open_below.values())}) WHERE s.start = start AND band < s.below"""
        found = source.read(f"""
            SELECT start, c, {_sums(cols)} FROM (SELECT *, {_nearest(k)} AS c FROM (
              SELECT s.start AS start, {', '.join(cols)}, {_distances(cols, k)} FROM ({opened})))
            GROUP BY start, c""")
        for number, c, *total in found.collect():
            _add(sums[number], c, total)
        for start in starts:
            start.advance(sums[start.number], len(cols))

    def close(self) -> None:
        """Let go of the base; rounds read the points again."""
        if self.base is not None:
            self.base.release()
        self.base, self.settled = None, {}


def _open_bands(way: float) -> int:
    """The first band whose points stay where they are when no centre went farther."""
    if way == 0:
        return 1
    return min(_BANDS + 1, max(1, _LOWEST + 1 + math.floor(2 * math.log2(2 * way * (1 + 1e-9)))))


def _add(sums: dict[int, list], c: int, found: Sequence[float]) -> None:
    sums[c] = [a + b for a, b in zip(sums[c], found, strict=True)] if c in sums else list(found)


def best_kmeans(
    points: DataFrame, key: str, cols: Sequence[str], k: int = 4, seed: int = 42, n_init: int = 10,
    tol: float = 1e-4, still: float = 1e-12, max_iter: int = 300,
) -> Start:
    """The cheapest of ``n_init`` starts over the double columns ``cols`` of stored ``points``.

    All starts advance together until the squared way of a start's centres in a round is at most ``tol``; the cheapest
    goes on until it is at most ``still``. ``max_iter`` guards each part against a start that never rests, and a
    warning is given then. Without points the result has no centres.
    """
    rows = points.count()
    held = _Held(points.select(key, *cols).coalesce(max(1, -(-rows // _ROWS_PER_PARTITION))))
    rounds = _Rounds(held, cols)
    try:
        starts = draw_starts(held, key, cols, k, seed, n_init)
        if not starts:
            return Start(0, [])
        _run(rounds, starts, tol, max_iter)
        # The cost is that of the centres before the last, shortest way.
        best = min(starts, key=lambda s: (s.cost, s.number))
        rounds.close()
        _run(rounds, [best], still, max_iter)
    finally:
        rounds.close()
        held.release()
    if best.moved > still:
        warnings.warn(f"k-means was stopped after {max_iter} rounds", stacklevel=2)
    return best


def _run(rounds: _Rounds, starts: Sequence[Start], limit: float, max_iter: int) -> None:
    done, rebase_at, active = 0, _FIRST_BASE, [s for s in starts if s.moved > limit]
    while active and done < max_iter:
        if done == rebase_at:
            rounds.rebase(active)
            rebase_at *= 2
        rounds.advance(active)
        done += 1
        active = [s for s in active if s.moved > limit]


def assigned(points: DataFrame, cols: Sequence[str], centres: Sequence[Point], out: str) -> DataFrame:
    """Add ``out``, the place of the nearest of ``centres``."""
    beside = points.selectExpr("*", _starts([Start(0, list(centres))]))
    distances = beside.selectExpr(*points.columns, *_distances(cols, len(centres)).split(", "))
    return distances.selectExpr(*points.columns, f"{_nearest(len(centres))} AS {out}")
