"""Intermediates that ad-hoc reports of one session share, kept for a time.

Frames are told apart by the meaning of their plans, so two reports that derive the same
intermediate, each for itself, find one stored copy. Copies lie in executor memory and on executor disks;
what a lost executor held is computed again from its lineage.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from cohortwise.operators.features import all_metrics
from cohortwise.operators.rollups import attendance_days, concept_months
from cohortwise.plans import scores
from cohortwise.sources.tables import CohortTables

#: The intermediates that feed many reports; a refresh stores them, a session may share them.
SHARED: dict[str, Callable[[CohortTables], DataFrame]] = {
    "student_metrics": all_metrics,
    "attendance_days": lambda t: attendance_days(t, "group_id", "day"),
    "concept_months": lambda t: concept_months(t, "concept_name", "course_id", "start"),
    "score_sketches": scores.score_sketches,
}


@dataclass
class _Held:
    frame: DataFrame
    until: float


class SharedFrames:
    """Persisted frames by the meaning of their plans, each kept for ``seconds``.

    A frame is computed when the first action needs it. After its time it is released at the next call of
    ``share`` and derived anew, so results are at most that old. Frames that the caller persisted before stay the
    caller's: they are handed back as they are and never released here.
    """

    def __init__(self, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self._seconds, self._clock = seconds, clock
        self._held: dict[int, list[_Held]] = {}
        self._lock = threading.Lock()

    def share(self, df: DataFrame) -> DataFrame:
        """The stored frame that means the same as ``df``; ``df`` itself, persisted, if there is none."""
        with self._lock:
            now = self._clock()
            self._drop(lambda held: held.until <= now)
            key = df.semanticHash()
            for held in self._held.get(key, []):
                if held.frame.sameSemantics(df):
                    return held.frame
            level = df.storageLevel
            if level.useMemory or level.useDisk:
                return df
            df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.setdefault(key, []).append(_Held(df, now + self._seconds))
            return df

    def release(self) -> None:
        """Let go of all frames."""
        with self._lock:
            self._drop(lambda held: True)

    def _drop(self, ends: Callable[[_Held], bool]) -> None:
        for key, alike in list(self._held.items()):
            for held in alike:
                if ends(held):
                    held.frame.unpersist()
            kept = [held for held in alike if not ends(held)]
            if kept:
                self._held[key] = kept
            else:
                del self._held[key]

    def __len__(self) -> int:
        return sum(map(len, self._held.values()))


def shared_tables(tables: CohortTables, frames: SharedFrames) -> CohortTables:
    """The same tables, with the intermediates that are not stored yet shared through ``frames``.

    An intermediate is derived when a report first asks for it.
    """

    def provider(build: Callable[[CohortTables], DataFrame]):
        def provide(columns: tuple[str, ...]) -> DataFrame:
            df = frames.share(build(tables))
            return df.select(*columns) if columns else df

        return provide

    return tables.with_providers(
        {name: provider(build) for name, build in SHARED.items() if not tables.has(name)}
    )
