"""The contracts of the operators in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = WORD.findall((text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def joined(pairs, nodes) -> dict:
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def near_duplicates(docs: list[tuple[int, str | None]], percent: int = 75) -> set:
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    pairs = {(a, b) for own in by.values() for x, a in enumerate(own) for b in own[x + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = joined(links, sets)
    return {(i, len(sets[i]), root[i]) for i in sets}


def near_vectors(rows: list[tuple[int, list | None, int | None]], least: float = 0.93) -> dict:
    """vec_id -> (links, component)."""
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for a, (i, x, la) in enumerate(good):
        for j, y, lb in good[a + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j), links[j].add(i)
    root = joined([(a, b) for a in links for b in links[a]], [r[0] for r in rows])
    return {r[0]: (len(links[r[0]]), root[r[0]]) for r in rows}


BASE = (
    ("assign", re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
)


def secrets(text: str | None) -> tuple[list[int], list[str], str]:
    """Counts of the base kinds, their spans, and the digest of those."""
    spans, counts = [], []
    for k, (kind, pattern, least, group) in enumerate(BASE):
        own = [m for m in pattern.finditer(text or "") if len(m[group]) >= least]
        counts.append(len(own))
        spans += [(m.start(), k, m.end(), kind) for m in own]
    written = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
    return counts, written, hashlib.sha256(",".join(written).encode()).hexdigest()


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def shares(sizes: list[int], weights: list[float], most: float = 3) -> list[float]:
    full, target = set(), [0.0] * len(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        rest = sum(sizes) - sum(most * sizes[i] for i in full)
        total = sum(weights[i] for i in open_)
        target = [most * s if i in full else rest * weights[i] / total for i, s in enumerate(sizes)]
        over = {i for i in open_ if target[i] > most * sizes[i]}
        if not over:
            return target
        full |= over


def tiles(item: list[str], text: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling as it is defined: the longest common run of unmarked words, again and again."""
    a_free, b_free, out = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and a_free[a + n] and b_free[b + n] and item[a + n] == text[b + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (a, b, n)
        if best is None:
            return out
        out.append(best)
        for i in range(best[2]):
            a_free[best[0] + i] = b_free[best[1] + i] = False


def ruled(url: str | None, rules) -> tuple[str, str, str | None, str | None]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut].translate(UPPER), re.split(r"[?#]", rest[cut:])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def maximal(conversations: dict[int, list[tuple]]) -> dict[int, int]:
    """conv_id of each conversation that begins no longer one, with its number of copies."""
    groups = defaultdict(list)
    for i, turns in conversations.items():
        groups[tuple(turns)].append(i)
    begun = {t[:n] for t in groups for n in range(len(t))}
    return {min(ids): len(ids) for t, ids in groups.items() if t not in begun}


def clusters(rows: list[tuple[int, list]], most: int = 40, rounds: int = 5) -> dict:
    """(vec_id, components) -> (cluster, distance, centroid) in Python integers."""
    import math

    points = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    z = [p for _, p in sorted(points, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:most]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(z))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, p in points:
            own[near(p)[1]].append(p)
        z = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if own[k] else c for k, c in enumerate(z)]
    return {(i, tuple(p)): (near(p)[1], near(p)[0], ",".join(map(str, z[near(p)[1]]))) for i, p in points}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs: list[tuple]) -> set:
    count = defaultdict(int)
    for i, t in docs:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").translate(UPPER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out
