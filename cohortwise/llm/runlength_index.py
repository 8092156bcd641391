"""A run-length compressed Burrows-Wheeler index over many short texts.

The index keeps one entry per run of equal letters in the transform, with the text
position at both ends of the run (sampled run ends) and how far the suffixes on the two sides
of a run border agree. Inside a run that length shrinks by one with every step to the right,
so the samples are enough to stream the matching statistics of all positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Texts of one index hold fewer letters, ends included.
MOST_LETTERS = 1 << 21
_BITS = 21
_MASK = (1 << _BITS) - 1


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Suffix order, rank of every position and whether all ranks differ."""
    keys.sort()
    order = keys & _MASK
    keys >>= _BITS
    new = np.empty(len(keys), bool)
    new[0] = False
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    rank = np.empty(len(keys), np.int32)
    place = np.cumsum(new, dtype=np.int32)
    rank[order] = place
    return order, rank, int(place[-1]) + 1 == len(keys)


def _shifted(x: np.ndarray, by: int, room: np.ndarray) -> np.ndarray:
    """x at ``by`` positions to the right, 0 beyond the end of the same text."""
    out = np.zeros(len(x), np.int64)
    out[: max(0, len(x) - by)] = x[by:]
    out[room < by] = 0
    return out


def _suffix_order(
    letters: np.ndarray, room: np.ndarray, depth: int
) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of the suffixes up to the end of their text, then by position; ranks by doubled prefixes."""
    bits = max(1, int(letters.max()).bit_length())
    at, width, keys = np.arange(len(letters), dtype=np.int64), 1, letters
    while 2 * width * bits <= 63 - _BITS:
        keys = (keys << width * bits) | _shifted(keys, width, room)
        width *= 2
    order, rank, done = _ranked((keys << _BITS) | at)
    levels = [(width, rank)]
    while not done and width < depth:
        keys = (rank.astype(np.int64) << 2 * _BITS) | (_shifted(rank, width, room) << _BITS) | at
        order, rank, done = _ranked(keys)
        width *= 2
        levels.append((width, rank))
    return order, levels


def _agreement(
    x: np.ndarray, y: np.ndarray, letters: np.ndarray, levels: Sequence[tuple[int, np.ndarray]], least: int
) -> np.ndarray:
    """Number of equal letters at positions x and y, read off the ranks; 0 if surely below ``least``."""
    full, n = np.zeros(len(x), np.int64), len(letters)
    possible = np.arange(len(x))
    for width, rank in levels:
        if width <= least:
            possible = possible[rank[x[possible]] == rank[y[possible]]]
    x, y = x[possible], y[possible]
    out = np.zeros(len(x), np.int64)
    for width, rank in reversed(levels):
        inside = (x < n) & (y < n)
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        step = np.where(same, width, 0)
        out += step
        x += step
        y += step
    alive = np.ones(len(x), bool)
    for _ in range(levels[0][0]):
        alive &= (x < n) & (y < n)
        alive &= letters[np.minimum(x, n - 1)] == letters[np.minimum(y, n - 1)]
        out += alive
        x += alive
        y += alive
    full[possible] = out
    return full


@dataclass(frozen=True)
class RunLengthIndex:
    """Runs of the transform; positions and agreements at the two ends of each run."""

    letters: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    last: np.ndarray
    first_agrees: np.ndarray
    last_agrees: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def build(cls, texts: Sequence[bytes], least: int = 1) -> RunLengthIndex:
        """Index ``texts``; matches of fewer than ``least`` letters may be left out."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        used = np.zeros(256, np.int64)
        used[raw] = 1
        code = np.cumsum(used)  # 1 and up; 0 ends a text
        letters = code[raw]
        letters[ends] = 0
        if len(letters) >= MOST_LETTERS:
            raise ValueError(f"{len(letters)} letters, the most is {MOST_LETTERS}")
        room = np.repeat(ends, sizes + 1) - np.arange(len(letters))
        order, levels = _suffix_order(letters, room, int(sizes.max()) + 1)
        before = letters[order - 1]  # position 0 follows the last end
        # An end is never part of a run: no match goes on into another text.
        border = np.empty(len(order) + 1, bool)
        border[0] = border[-1] = True
        border[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads, tails = np.flatnonzero(border[:-1]), np.flatnonzero(border[1:])
        agrees = np.zeros(len(heads) + 1, np.int64)
        agrees[1:-1] = _agreement(order[heads[1:] - 1], order[heads[1:]], letters, levels, least)
        return cls(
            before[heads], tails - heads + 1, order[heads], order[tails],
            agrees[:-1], agrees[1:], starts, ends,
        )

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest string that also starts at another position."""
        n = int(self.ends[-1]) + 1
        at = np.arange(n)
        best = np.zeros(n, np.int64)
        for sampled, agrees in ((self.first, self.first_agrees), (self.last, self.last_agrees)):
            value, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            value[sampled] = agrees
            known[sampled] = sampled
            known = np.maximum.accumulate(known)
            best = np.maximum(best, value[known] - (at - known))
        room = np.repeat(self.ends, self.ends - self.starts + 1) - at
        return np.minimum(best, room)

    def long_matches(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the stretches covered by matches of ``length`` letters."""
        hit = self.matching_statistics() >= length
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(self.starts, begin, "right") - 1
        return text, begin - self.starts[text], stop - 1 + length - self.starts[text]
