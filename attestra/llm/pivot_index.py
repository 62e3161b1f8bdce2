"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Near
vectors see the same pivots, so each vector is posted to the inverted lists of
the pairs among its nearest pivots; two vectors meet where they share two or
more. There the pivots they share are counted, down to DEEPER times as many
places of the order, and only the vectors of pairs that share as many as links do
are fetched and verified by their cosine in double precision: what is posted is
ids and pivots. How many links share is tried out on each group's own vectors.

Only vectors of one label and length are compared, so each such group has
pivots of its own, drawn from its members: about eight times the square root of
their number, so that lists stay short as a group grows. Vectors and pivots are
seen from the pivots' mean: in a group whose vectors all lie close together the
directions from there still differ. How close they lie tells how many pivots
describe a vector; where even links could not be told from chance, the group is
one list and every two of its vectors are compared.

Equal vectors are one class before anything is posted. Groups are dealt out by
chunks, each with a copy of the pivots. A long list is cut into blocks and every
two of its blocks meet in a task of their own, so no list is ever held in one
place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import components, stage
from .words import tidy

#: Pivots of a group, at least and at most; between them PER_ROOT for each square root of its vectors, rounded up to a power of two.
FEWEST, MOST, PER_ROOT = 32, 4096, 8
#: Pivots of a group are less similar to each other than this, as seen from their mean.
APART = 0.6
#: Pivots that describe a vector: for groups of up to so many pivots, (residual similarity of a link, nearest pivots), most similar first.
#: Measured: two vectors at that similarity share two pivots with a chance of 0.94 or more (0.91 in the last row of 256).
NEAREST = {64: ((0.8, 6), (0.6, 8), (0.35, 12)), 256: ((0.9, 6), (0.8, 8), (0.6, 12), (0.35, 16)), 1024: ((0.85, 8), (0.75, 12), (0.6, 16)), 4096: ((0.92, 8), (0.85, 12), (0.75, 16))}
#: Places of the order in which shared pivots are counted, for each that vectors are posted by; a group's pivots are so many times as many at least.
DEEPER = 3
#: Share of the tried links that may have fewer shared pivots than what is asked for, and vectors they are tried on.
MISSED, TRIED = 0.002, 512
#: Vectors of a group that are described in one task, and of a list that meet in one.
CHUNK, BLOCK = 4096, 1024
#: Vectors of a list up to which it is verified together with others.
SHORT = 16
SEED = 5
#: The list of everything.
ALL = -1
GROUP, UNIT = ["label", "dim"], ["label", "dim", "key", "u", "v"]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay. Scaled first, so that squares of large numbers do not overflow."""
    x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def spread(x: np.ndarray, apart: float = APART) -> np.ndarray:
    """The unit vectors that are not near an earlier one; near pivots would rank vectors by noise."""
    kept = np.zeros_like(x)
    n = 0
    for v in x:
        if not n or (kept[:n] @ v).max() < apart:
            kept[n] = v
            n += 1
    return kept[:n]


def described(pivots: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and directions of a group's pivots, and how many of them describe a vector; none where all vectors have to meet."""
    mean = pivots.mean(0)
    n = len(pivots)
    # Mean cosine of two pivots, and how similar two linked vectors are when seen from the mean.
    dense = ((pivots.sum(0) ** 2).sum() - n) / max(1, n * (n - 1))
    link = (least - dense) / (1 - dense) if n > 1 and dense < 1 - 1e-9 else 0.0
    for most in sorted(NEAREST):
        if n <= most:
            break
    while most > min(NEAREST) and link < NEAREST[most][-1][0]:
        most = max(m for m in NEAREST if m < most)  # fewer pivots, whose order is less of a chance
    k = next((k for level, k in NEAREST[most] if link >= level), 0)
    away = pivots[:most] - mean
    away = spread(_unit(away[np.abs(away).max(1) > 1e-12]))
    return mean, away, min(k, len(away)) if len(away) > 1 else 0


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row, nearest first."""
    s = x @ pivots.T
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def deepened(vectors: np.ndarray, mean: np.ndarray, pivots: np.ndarray, k: int, least: float) -> tuple[int, int]:
    """How many pivots of the order are compared, and how many of them two vectors have to share to be verified.

    Some of the group's ``vectors`` get partners at a cosine of ``least``, away
    from them at random and towards other vectors; of those that meet in a list,
    all but MISSED share as many. One less is asked for, as the vectors are
    pivots themselves and see themselves first.
    """
    deep = max(k, min(DEEPER * k, len(pivots) // DEEPER))
    if deep == k:
        return k, 2
    rng = np.random.default_rng(SEED)
    base = vectors[:TRIED]
    need = deep
    for away in (rng.normal(size=base.shape), np.roll(base, 1, axis=0)):
        away = _unit(away - (away * base).sum(1, keepdims=True) * base)
        a, b = (nearest_pivots(v - mean, pivots, deep) for v in (base, least * base + np.sqrt(1 - least * least) * away))
        same = a[:, :, None] == b[:, None, :]
        meet = same[:, :k, :k].sum((1, 2)) >= 2
        if meet.any():
            need = min(need, int(np.quantile(same.sum((1, 2))[meet], MISSED)) - 1)
    return deep, max(2, need)


def _keys(near: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of nearest pivots, the nearest pairs first."""
    pairs = [np.sort(near[:, list(c)].astype(np.int64), axis=1) for c in combinations(range(near.shape[1]), 2)]
    return np.stack([p[:, 0] << 20 | p[:, 1] for p in pairs], 1)


def _binary(values: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    data = pa.Array.from_buffers(pa.large_binary(), len(keep), [None, pa.py_buffer((offsets * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(pa.array(keep), data, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _bodies(wide: bool):
    """``vec_id``, ``label``, ``dim`` and the numbers as bytes; null where a vector links with nothing."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(length)])
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])  # noqa: B023, E731
            fine = (count(~np.isfinite(values)) == 0) & (count(values != 0) > 0) & pc.is_valid(b.column("label")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(length.astype(np.int32)), _binary(values + kind(0), offsets, fine)], names=["vec_id", "label", "dim", "body"])

    return tidy(run)


def _matrix(column: pa.Array, kind, dim: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(-1, dim) if data.ctypes.data % np.dtype(kind).itemsize == 0 else np.frombuffer(data.tobytes(), kind).reshape(-1, dim)


def _runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Key, start and end of each run of rows that are equal in ``names``."""
    cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
    cut = np.concatenate([[0], np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1, [len(batch)]])
    for a, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield tuple(cols[:, a].tolist()), a, e


def _post(wide: bool, least: float, exact: bool):
    """Describe the vectors of each chunk by its pivots, which come first."""
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, seen = None, [], None
        for b in batches:
            if not len(b):
                continue
            member = b.column("member").to_numpy()
            for key, a, e in _runs(b, [*GROUP, "chunk"]):
                if key != own:
                    own, held, seen = key, [], None
                n = int((member[a:e] == 0).sum())
                if n:
                    held.append(_unit(_matrix(b.column("body").slice(a, n), kind, key[1]).astype(np.float64)))
                if a + n == e:
                    continue
                if seen is None:
                    mean, pivots, k = described(np.concatenate(held), least)
                    seen = mean, pivots, k, *(deepened(np.concatenate(held), mean, pivots, k, least) if k >= 2 and not exact else (0, 0))
                mean, pivots, k, deep, need = seen
                part = b.slice(a + n, e - a - n)
                if k < 2 or exact:
                    keys, near = np.full((len(part), 1), ALL), np.zeros((len(part), 0), np.int32)
                else:
                    near = nearest_pivots(_unit(_matrix(part.column("body"), kind, key[1]).astype(np.float64)) - mean, pivots, deep)
                    keys = _keys(near[:, :k])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel().astype(t))) for v, t in ((keys, np.int64), (near, np.int16))]
                told = [pa.array(np.full(len(part), v, np.int32)) for v in (k, need)]
                yield pa.RecordBatch.from_arrays([part.column("class"), part.column("label"), part.column("dim"), *lists, *told], names=["class", "label", "dim", "keys", "near", "k", "need"])

    return tidy(run)


def _own(near_a: np.ndarray, near_b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pairs whose two lowest shared pivots are those of the list: of the lists that two vectors share, this one counts the pair."""
    shared = np.sort(np.where((near_a[:, :, None] == near_b[:, None, :]).any(2), near_a.astype(np.int64), 1 << 20), axis=1)[:, :2]
    return (shared[:, 0].astype(np.int64) << 20 | shared[:, 1]) == key


def _of_list(near: np.ndarray, key: int) -> np.ndarray:
    """The same for all pairs of a long list: whether they share no pivots up to the list's higher one but its two."""
    high = key & (1 << 20) - 1
    seen = np.zeros((len(near), high + 1), np.float32)
    row, at = np.nonzero(near <= high)
    seen[row, near[row, at]] = 1
    return seen @ seen.T == 2


def _by_unit(batches: Iterator[pa.RecordBatch], unit, short) -> Iterator[list]:
    """What ``unit(key, parts)`` makes of each unit of two rows and more, and ``short(batch, runs)`` of a batch's short lists of one block."""
    own, parts = None, []
    for b in batches:
        if not len(b):
            continue
        runs, found = list(_runs(b, UNIT)), []
        # The last run may go on in the next batch, and the first may have begun in the one before.
        if own is not None and runs[0][0] != own:
            found += [unit(own, parts)] if sum(map(len, parts)) > 1 else []
            own, parts = None, []
        inner = runs[1:-1] if own is not None else runs[:-1]
        if own is not None:
            parts.append(b.slice(0, runs[0][2]))
            if len(runs) > 1:
                found.append(unit(own, parts))
                own, parts = None, []
        small = [r for r in inner if 1 < r[2] - r[1] <= SHORT and r[0][3] == r[0][4]]
        if small:
            found.append(short(b, small))
        found += [unit(key, [b.slice(a, e - a)]) for key, a, e in inner if e - a > SHORT or key[3] != key[4] and e - a > 1]
        if own is None:
            own, parts = runs[-1][0], [b.slice(runs[-1][1], len(b) - runs[-1][1])]
        yield found
    if sum(map(len, parts)) > 1:
        yield [unit(own, parts)]


def _nears(column: pa.Array) -> np.ndarray:
    """Rows of pivots, all of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _count():
    """Count the pivots that the pairs of each list and unit share; the rows of the vectors to verify there.

    A row stays if it has a partner that shares enough pivots with it and that
    no other list counts. Rows come out at most once, so a group of near copies
    makes no more of them than were posted.
    """
    names = ["class", *GROUP, "key", "block", "u", "v"]

    def unit(key: tuple, parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        near = np.concatenate([_nears(p.column("near")) for p in parts])
        k, need = parts[0].column("k")[0].as_py(), parts[0].column("need")[0].as_py()
        pivots, at = np.unique(near, return_inverse=True)
        seen = np.zeros((len(near), len(pivots)), np.float32)
        seen[np.arange(len(near))[:, None], at.reshape(near.shape)] = 1
        enough = seen @ seen.T >= need
        np.fill_diagonal(enough, False)
        if key[3] != key[4]:  # pairs within one of the blocks meet elsewhere
            other = np.concatenate([p.column("block").to_numpy() for p in parts]) != key[3]
            enough &= other[:, None] != other
        if enough.any():
            enough &= _of_list(near[:, :k], key[2])
        some, start, out = enough.any(1), 0, []
        for p in parts:
            out.append(p.select(names).filter(pa.array(some[start : start + len(p)])))
            start += len(p)
        return out

    def short(batch: pa.RecordBatch, runs: list[tuple[tuple, int, int]]) -> list[pa.RecordBatch]:
        length = pc.list_value_length(batch.column("near")).to_numpy()
        width = np.concatenate([[0], np.cumsum(length)])
        flat, ks, needs = batch.column("near").flatten().to_numpy(), batch.column("k").to_numpy(), batch.column("need").to_numpy()
        # A bit for each pivot.
        bits = np.zeros((len(batch), (int(flat.max(initial=0)) // 64 + 1) * 64), np.uint8)
        bits[np.repeat(np.arange(len(batch)), length), flat] = 1
        bits = np.packbits(bits, axis=1).view(np.uint64)
        stays = np.zeros(len(batch), bool)
        shapes: dict[tuple, list] = {}
        for key, a, e in runs:
            shapes.setdefault((e - a, int(ks[a])), []).append((a, key[2]))
        for (m, k), own in shapes.items():
            start, keys = np.array([o[0] for o in own]), np.array([o[1] for o in own], np.int64)
            x, y = np.triu_indices(m, 1)
            i, j = (start[:, None] + x).ravel(), (start[:, None] + y).ravel()
            enough = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) >= needs[i]
            i, j, r = i[enough], j[enough], np.repeat(keys, len(x))[enough]
            mine = _own(flat[width[i][:, None] + np.arange(k)], flat[width[j][:, None] + np.arange(k)], r)
            stays[i[mine]] = stays[j[mine]] = True
        return [batch.select(names).filter(pa.array(stays))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_unit(batches, unit, short):
            for kept in found:
                yield from kept

    return tidy(run)


def _meet(wide: bool, least: float):
    """Verify the pairs of each list and unit; rows of link counts and of edges that connect what is linked.

    Short lists are verified many at a time, those of equal length together.
    """
    kind, names = np.float64 if wide else np.float32, ["a", "b", "n"]
    none = np.zeros(0, np.int64)

    def column(parts: list[pa.RecordBatch], c: str) -> np.ndarray:
        return np.concatenate([p.column(c).to_numpy() for p in parts])

    def vectors(parts: list[pa.RecordBatch], dim: int) -> np.ndarray:
        return _unit(np.concatenate([_matrix(p.column("body"), kind, dim) for p in parts]).astype(np.float64))

    def unit(key: tuple, parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a long list or of two of its blocks: ends of edges, classes with links, and how many."""
        ids, other, weight = column(parts, "class"), column(parts, "block") != key[3], column(parts, "weight")
        x = vectors(parts, key[1])
        link = x @ x.T >= least
        np.fill_diagonal(link, False)
        if key[3] != key[4]:  # pairs within one of the blocks meet elsewhere
            link &= other[:, None] != other
        if key[2] != ALL and link.any():
            link &= _of_list(np.concatenate([_nears(p.column("near")) for p in parts]), key[2])
        counted, label = link @ weight, np.arange(len(ids))
        while True:
            best = np.minimum(label, np.where(link, label, len(ids)).min(1))
            if (best == label).all():
                break
            label = best
        tied, some = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(counted)
        return ids[tied], ids[label[tied]], ids[some], counted[some]

    def short(batch: pa.RecordBatch, runs: list[tuple[tuple, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of many short lists of one block."""
        ids, weight, out = batch.column("class").to_numpy(), batch.column("weight").to_numpy(), []
        width = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("near")).to_numpy())])
        near = batch.column("near").flatten().to_numpy()
        shapes: dict[tuple, list] = {}
        for key, a, e in runs:
            shapes.setdefault((key[1], e - a, int(width[a + 1] - width[a])), []).append((a, key[2]))
        for (dim, m, k), own in shapes.items():
            start, keys = np.array([o[0] for o in own]), np.array([o[1] for o in own], np.int64)
            at = start[:, None] + np.arange(m)
            x = vectors([batch.take(pa.array(at.ravel()))], dim).reshape(len(own), m, dim)
            r, i, j = np.nonzero(np.triu(x @ x.transpose(0, 2, 1) >= least, 1))
            i, j, r = at[r, i], at[r, j], keys[r]
            if len(i) and k:
                mine = _own(near[width[i][:, None] + np.arange(k)], near[width[j][:, None] + np.arange(k)], r)
                i, j = i[mine], j[mine]
            out.append((ids[i], ids[j], np.concatenate([ids[i], ids[j]]), np.concatenate([weight[j], weight[i]])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        a, b, c, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none,) * 4
        c, at = np.unique(c, return_inverse=True)
        n = np.bincount(at, n, len(c)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([c, a])), pa.concat_arrays([pa.nulls(len(c), pa.int64()), pa.array(b)]), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_unit(batches, unit, short):
            yield rows(found)

    return tidy(run)


def _units(posted: DataFrame) -> DataFrame:
    """The lists of two and more, cut into blocks: a row for each class, list and pair of blocks in which it meets others."""
    lists = posted.select("class", *GROUP, F.explode("keys").alias("key"))
    lengths = lists.groupBy(*GROUP, "key").agg(F.count("*").alias("m")).where("m > 1")
    lists = lists.join(lengths, [*GROUP, "key"]).withColumn("blocks", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}"))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("u"), F.greatest("block", j).alias("v")))
    return lists.withColumn("unit", F.explode(others)).select("class", *GROUP, "key", "block", "unit.u", "unit.v")


def near_vectors(vectors: DataFrame, least: float = 0.93, exact: bool = False) -> DataFrame:
    """Links between vectors of equal label with a cosine of ``least`` or more.

    Output, a row for each input row: ``vec_id``; ``n_links``, other rows linked
    directly; ``component_id``, the smallest vec_id reached by links, its own
    included; ``kept``, whether that is its own.

    Vectors without a label, null, empty or zero ones, and those with null or
    non-finite numbers link with nothing. Vectors of different lengths do not
    link. Repeated rows are further vectors; a null vec_id is never the smallest.
    An empty table gives an empty result; other columns play no part. Every link
    that is reported is one. Pairs that share fewer than two of their nearest
    pivots, or fewer of the further ones than nearly all links do, are missed; with ``exact`` every two vectors of a label are
    compared, in blocks, and none is. Vectors are told apart by 64-bit hashes.
    """
    wide = dict(vectors.dtypes)["embedding"] != "array<float>"
    numbers = F.col("embedding").cast("array<double>") if wide else F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), numbers.alias("embedding"))
    rows = rows.mapInArrow(_bodies(wide), "vec_id long, label long, dim int, body binary")
    rows = stage(rows.withColumn("class", F.when(F.col("body").isNotNull(), F.xxhash64("label", "body"))), "vectors")
    classes = rows.where("class is not null").groupBy("class").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("body").alias("body"), F.min("vec_id").alias("smallest"), F.count("*").alias("weight"))
    classes = stage(classes, "classes")

    # Pivots of a group: of each of its salts the class whose hash is lowest.
    sizes = classes.groupBy(*GROUP).agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.pow(F.lit(2), F.ceil(F.log2(PER_ROOT * F.sqrt("n"))))))
    sizes = stage(sizes.withColumn("pivots", wanted.cast("long")).withColumn("chunks", F.expr(f"(n + {CHUNK - 1}) div {CHUNK}")), "groups")
    draw = F.xxhash64("class", F.lit(SEED))
    members = classes.select("class", *GROUP, "body").join(sizes, GROUP).withColumn("draw", draw)
    pivots = members.groupBy(*GROUP, F.pmod("draw", F.col("pivots")).alias("salt")).agg(F.min_by("body", F.struct("draw", "class")).alias("body"), F.first("chunks").alias("chunks"))
    pivots = pivots.select(*GROUP, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("member"), F.col("salt").alias("class"), "body")
    members = members.select(*GROUP, F.pmod(F.xxhash64("class"), F.col("chunks")).alias("chunk"), F.lit(1).alias("member"), "class", "body")
    chunks = pivots.unionByName(members).repartition(*GROUP, "chunk").sortWithinPartitions(*GROUP, "chunk", "member", "class")
    posted = stage(chunks.mapInArrow(_post(wide, least, exact), "class long, label long, dim int, keys array<long>, near array<short>, k int, need int"), "posted")

    # Ids and pivots go to the lists; vectors only where the list leaves them something to verify.
    whole = F.get("keys", F.lit(0)) == ALL
    described_by = posted.where(~whole).select("class", "near", "k", "need")
    counted = _units(posted.where(~whole)).join(described_by, "class").repartition(*UNIT).sortWithinPartitions(*UNIT, "class")
    counted = stage(counted.mapInArrow(_count(), "class long, label long, dim int, key long, block long, u long, v long"), "counted")
    body = posted.select("class", F.slice("near", 1, F.greatest("k", F.lit(0))).alias("near")).join(classes.select("class", "body", "weight"), "class")
    units = counted.unionByName(_units(posted.where(whole))).join(body, "class").repartition(*UNIT).sortWithinPartitions(*UNIT, "class")
    met = stage(units.mapInArrow(_meet(wide, least), "a long, b long, n long"), "met")

    counts = met.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    found = components(met.where("b is not null").select("a", "b"), "vectors")
    reach = classes.select("class", "smallest", "weight").join(counts.withColumnRenamed("a", "class"), "class", "left").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    reach = stage(reach, "reached")
    roots = reach.groupBy("root").agg(F.min("smallest").alias("component_id"))
    reach = reach.join(roots, "root").select("class", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").join(reach, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
