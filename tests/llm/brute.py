"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(lowered(text)) if w]


def shingles(text, n):
    found = words(text)
    if not found:
        return set()
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))}


def groups(nodes, links):
    """Smallest node of each node's component."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return least


def near_duplicates(rows, n, percent):
    """{id: (number of shingles, component)} for rows with distinct ids."""
    sets = {i: shingles(t, n) for i, t in rows}
    holders = defaultdict(list)
    for i, found in sets.items():
        for s in found:
            holders[s].append(i)
    common = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    links = [
        (a, b) for (a, b), c in common.items()
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)
    ]
    least = groups(sets, links)
    return {i: (len(sets[i]), least[i]) for i in sets}


def repeats(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        edges = [0, *(x for s in spans for x in s), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
        out.append((len(b), sum(e - s for s, e in spans), len(spans), kept))
    return out


def digest(row):
    return (*row[:3], hashlib.sha256(row[3]).hexdigest())


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judge(url, rules):
    host, path = host_and_path(url)
    fits = [
        (len(h + p), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def linked_vectors(rows, threshold):
    """{id: (links, component)} for rows with distinct ids."""
    good = [(i, np.array(v, float)) for i, v in rows if usable(v) and any(v)]
    links = [
        (a, b) for (a, x), (b, y) in combinations(good, 2)
        if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold
    ]
    count = Counter(i for pair in links for i in pair)
    least = groups([i for i, _ in rows], links)
    return {i: (count[i], least[i]) for i, _ in rows}


def best_products(rows, asks, k, factor):
    whole = [(i, np.floor(factor * np.array(v, float)).astype(np.int64)) for i, v in rows if usable(v) and v]
    out = set()
    for q, x in whole:
        if asks(q):
            scored = sorted((-int(x @ y), i) for i, y in whole if i != q and len(x) == len(y))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_places(text):
    """(words, places, first, last, labels) of the base phrases."""
    found, places, labels = WORD.findall(lowered(text)), [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for i in range(len(found)):
            if found[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return (
        len(found), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)),
    )
