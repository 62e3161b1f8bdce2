"""N-gram Jaccard self-join by T-occurrence search.

A set of n shingles can only have a Jaccard similarity of t with another one if
they share T = ceil(t n) shingles. DivideSkip splits the inverted lists of a
query into the T-1 longest ones, which are only probed, and the rest, which is
merged: any partner then occurs at least once in the short lists. Over a
cluster:

1. every text becomes a sorted set of 64-bit shingle hashes, equal sets are one
   class, and fixed-size sketches tell which shingles have long lists: those that
   stand out themselves, then those of common words. Any order that all tasks
   share gives the same links; a good one gives short lists;
2. each class posts its id to its n-T+1 shortest lists. Tasks merge the sorted
   runs of their part of the lists and keep lists with two classes or more.
   Members of lists that turn out long post once more, to others instead;
3. pairs from lists of up to SMALL classes whose sizes and outlines (bitmaps
   of the hashes) allow the overlap are probed in the long lists: sets are sorted, so each list
   of the query that is left is a binary search;
4. longer lists meet representatives first. Lists whose classes are one component
   are done; the members of the others are compared with further representatives
   and at last with each other, so that a group of thousands of copies costs rows
   in proportion to its members, and yet no link between two components stays unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import components, stage
from .words import CHUNK, buffers, mix, ranked_sets, shingle_sets, tidy

#: Counters of the sketch of list lengths, and of that of word counts; their size does not depend on the data.
SKETCH = 1 << 20
#: Bits of the filter by which sets of candidates are read again, at most.
FILTER_BITS = 1 << 30
#: Parts that posting lists are dealt to before Spark groups them into tasks.
PARTS = 1 << 12
#: Postings a map task holds before it writes a run of each part.
RUN = 1 << 20
#: Members of one long list that go to the same part.
LIST_SPLIT = 1 << 16
#: Rounds in which members of unsettled lists meet further representatives before they meet each other.
STAR_ROUNDS = 1
#: Classes of a list up to which all its pairs are candidates at once, and mean length of the lists left over for which they are.
SMALL, LEFT_OVER = 48, 128
#: Bits of a set's outline, at least.
OUTLINE = 1024
REPRESENTATIVES = 2
#: Classes of a list and level that meet in one task.
BLOCK = 256


UNIT = ["list", "level", "u", "v"]
PROFILE = ["doc_id", "text_hash", "n", "class", "outline", "bucket", "hits"]


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def class_id(x: np.ndarray) -> int:
    """63 bits that stand for a whole set: a sum that does not depend on order, mixed with the size."""
    return int(mix(np.array([mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(x))]))[0] >> np.uint64(1))


def outline(x: np.ndarray) -> bytes:
    """A bitmap of the low bits of the hashes, two to four bits for each and at least OUTLINE; a half laid over the other is one of half the size."""
    m = np.zeros(max(OUTLINE, 1 << (2 * len(x) - 1).bit_length()), bool)
    m[(x & np.uint64(len(m) - 1)).astype(np.int64)] = True
    return np.packbits(m, bitorder="little").tobytes()


def level(n: int, percent: int) -> int:
    """Sizes whose sets can link are at most one level apart."""
    return int(np.log(n) / -np.log(percent / 100) + 1e-9) if percent < 100 else n % 251


def _level(n, percent: int):
    """``level`` as a column."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(-np.log(percent / 100))) + 1e-9) if percent < 100 else F.pmod(n, F.lit(251))


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(44)).astype(np.int64)


def _profile(percent: int, k: int):
    """Rows of the first pass: id, size and class of each document; counters of the sketch that stand out in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(2 * SKETCH, np.int64), []

        def counted(h):
            np.add(counts[SKETCH:], np.bincount(_bucket(h), minlength=SKETCH), out=counts[SKETCH:])

        def flush():
            if held:
                np.add(counts[:SKETCH], np.bincount(_bucket(np.concatenate(held)), minlength=SKETCH), out=counts[:SKETCH])
                held.clear()

        for batch in batches:
            size, ids, bars, n_held = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch), 0
            for t, x in shingle_sets(batch.column("text"), k, counted):
                size[t] = len(x)
                if len(x):
                    ids[t], bars[t] = class_id(x), outline(x)
                    held.append(x)
                    n_held += len(x)
                    if n_held >= RUN:
                        flush()
                        n_held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(size), pa.array(ids, mask=size == 0), pa.array(bars, pa.binary()), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.int64())], names=PROFILE)
        mean = counts[:SKETCH].mean()
        tall = np.flatnonzero(counts > np.where(np.arange(2 * SKETCH) < SKETCH, mean + 4 * np.sqrt(mean) + 3, 2 * counts[SKETCH:].mean() + 2))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(tall), pa.int64())] * 4, pa.nulls(len(tall), pa.binary()), pa.array(tall.astype(np.int32)), pa.array(counts[tall])], names=PROFILE)

    return tidy(run)


def _inside(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes the bitmap of ``_bitmap`` may hold."""
    at = x.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _runs(percent: int, k: int, heights, parts: int, only=None, long=None):
    """Sorted runs of postings by part: the shortest n-T+1 lists of each class that the task meets first.

    ``only`` and ``long`` are bitmaps of the classes to post, and of lists that turned out long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tall, seen, grams, ids, n_held = heights.value, set(), [], [], 0
        cost = (64 * np.log2(1 + tall[SKETCH:])).astype(np.int64)

        def flush():
            if not grams:
                return None
            g, c, v = np.concatenate(grams), *(np.repeat(np.array([i[f] for i in ids], t), [i[1] for i in ids]) for f, t in ((0, np.int64), (2, np.uint8)))
            copies = tall[_bucket(g)] // LIST_SPLIT + 1
            salt = np.where(copies > 1, mix(c.astype(np.uint64)) % copies.astype(np.uint64), np.uint64(0))
            part = (mix(g + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((g, part))
            g, c, v, part = g[order], c[order], v[order], part[order]
            cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            grams.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), *(pa.array([u[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for u in (g, c, v))], names=["part", "grams", "classes", "levels"])

        for batch in batches:
            for _, x, rank in ranked_sets(batch.column("text"), k, cost, _bucket):
                if not len(x) or (i := class_id(x)) in seen or only and not _inside(np.array([i]), only.value)[0]:
                    continue
                seen.add(i)
                short = len(x) - int(need(len(x), percent)) + 1
                lev = level(len(x), percent)
                height = tall[_bucket(x)]
                if long:
                    height = np.maximum(height, SMALL * _inside(x, long.value))
                x = x[np.argsort((height << 16) + np.minimum(rank, 65535), kind="stable")[:short]]
                grams.append(x), ids.append((i, short, lev))
                n_held += len(x)
                if n_held >= RUN:
                    yield flush()
                    n_held = 0
        if (last := flush()) is not None:
            yield last

    return tidy(run)


def _merge(heights):
    """Merge the sorted runs of a task's parts: pairs (a, b) of near sizes from short lists, rows (list, a) of long or split ones.

    Of a long list the pairs of its smallest class with the others come as well.
    """
    names = ["list", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tall = heights.value
        runs = [tuple(np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.int64, np.uint8), strict=True)) for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("grams", "classes", "levels")), strict=True)]
        if not runs:
            return
        g, c, v = (np.concatenate(x) for x in zip(*runs, strict=True))
        del runs
        order = np.argsort(g, kind="stable")  # merges runs that are sorted already
        g, c, v = g[order], c[order], v[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        length = np.diff(start)
        split = tall[_bucket(g[start[:-1]])] >= LIST_SPLIT
        pairs, done = [], set()
        for a, m, apart in zip(start[:-1][(length > 1) | split].tolist(), length[(length > 1) | split].tolist(), split[(length > 1) | split].tolist(), strict=True):
            own, at = np.unique(c[a : a + m], return_index=True)
            if apart or len(own) > SMALL:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g[a]).view(np.int64)), pa.array(own), pa.nulls(len(own), pa.int64())], names=names)
                lev = v[a : a + m][at].astype(np.int64)
                close = own[1:][np.abs(lev[1:] - lev[0]) <= 1]
                pairs.append(np.stack([np.full(len(close), own[0]), close], 1))
                continue
            if len(own) < 2 or (key := own.tobytes()) in done:  # one list is enough for the same members
                continue
            done.add(key)
            x, y = np.triu_indices(len(own), 1)
            lev = v[a : a + m][at].astype(np.int64)
            close = np.abs(lev[x] - lev[y]) <= 1
            pairs.append(np.stack([own[x[close]], own[y[close]]], 1))
        if pairs:
            pairs = np.concatenate(pairs)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])]
            for i in range(0, len(pairs), 1 << 16):
                p = pairs[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=names)

    return tidy(run)


def _possible(percent: int):
    """Keep the pairs whose sizes and outlines leave room for the overlap: each bit of one set alone is a shingle of it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [b.column(c).to_numpy() for c in ("n_a", "n_b")]
            least = -(-percent * (n[0] + n[1]) // (100 + percent))
            keep = 100 * np.minimum(*n) >= percent * np.maximum(*n)
            bits = [buffers(b.column(c)) for c in ("o_a", "o_b")]
            size = [np.diff(offsets) for _, offsets in bits]
            near = np.flatnonzero(keep)
            for wide in {(int(size[0][i]), int(size[1][i])) for i in near}:
                own = near[(size[0][near] == wide[0]) & (size[1][near] == wide[1])]
                for at in np.array_split(own, max(1, len(own) * max(wide) // CHUNK)):
                    x, y = (data[offsets[at][:, None] + np.arange(w)] for (data, offsets), w in zip(bits, wide, strict=True))
                    while x.shape[1] > y.shape[1]:
                        x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
                    while y.shape[1] > x.shape[1]:
                        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
                    alone = [np.bitwise_count(u & ~v).sum(1, dtype=np.int64) for u, v in ((x, y), (y, x))]
                    keep[at] = np.minimum(n[0][at] - alone[0], n[1][at] - alone[1]) >= least[at]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return tidy(run)


def _meet(percent: int):
    """Pairs of a unit's classes that are not in one component and whose sizes and outlines leave room for the overlap.

    Of the lower level any two classes meet, of the upper one each with those of
    the lower; of two blocks, classes of one with those of the other.
    """

    def unit(rows: list) -> np.ndarray:
        ids, root, n, upper, block = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        width = min(len(r[5]) for r in rows)
        bits = np.empty((len(rows), width >> 3), np.uint64)
        for i, r in enumerate(rows):
            bits[i] = np.bitwise_or.reduce(np.frombuffer(r[5], np.uint64).reshape(-1, width >> 3), 0)
        out, two = [], block.any() and not block.all()
        for i in np.flatnonzero(upper == 0):
            ok = (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((upper == 1) | (ids > ids[i]))
            if two:
                ok &= block != block[i]
            j = np.flatnonzero(ok)
            alone = np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64), np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64)
            j = j[np.minimum(n[i] - alone[0], n[j] - alone[1]) >= -(-percent * (n[i] + n[j]) // (100 + percent))]
            out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
        return np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []
        for b in batches:
            for *key, i, root, n, upper, block, bits in zip(*(b.column(c).to_pylist() for c in (*UNIT, "class", "root", "n", "upper", "block", "o")), strict=True):
                if key != own:
                    if len(rows) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in unit(rows)], names=["a", "b"])
                    own, rows = key, []
                rows.append((i, root, n, upper, block != key[2], bits))
        if len(rows) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in unit(rows)], names=["a", "b"])

    return tidy(run)


def _sets(k: int, bits):
    """The sets of the classes that the filter names, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bits.value, set()
        for batch in batches:
            ids, sets, held = [], [], 0
            for _, x in shingle_sets(batch.column("text"), k):
                if len(x) and (i := class_id(x)) not in seen and _inside(np.array([i]), wanted)[0]:
                    seen.add(i), ids.append(i), sets.append(x.tobytes())
                    held += len(x)
                if held >= RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["class", "grams"])
                    ids, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["class", "grams"])

    return tidy(run)


def _probe(percent: int):
    """Binary probes of the smaller set in the larger one, given up as soon as too many fail."""

    def links(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        if 100 * len(x) < percent * len(y):
            return False
        least = -(-percent * (len(x) + len(y)) // (100 + percent))
        spare = len(x) - least
        step = max(64, 2 * spare)
        for a in range(0, len(x), step):
            part = x[a : a + step]
            at = np.searchsorted(y, part)
            at[at == len(y)] = 0
            spare -= int((y[at] != part).sum())
            if spare < 0:
                return False
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            keep = [links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(xs, ys, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tidy(run)


def _bitmap(hashes: DataFrame, column: str):
    """A broadcast bitmap of the low bits of distinct hashes: about 16 bits for each, FILTER_BITS at most, OR-ed together by Spark.

    More hashes than it has room for only make it less selective.
    """
    size = min(FILTER_BITS, max(1 << 15, 1 << (16 * max(1, hashes.count()) - 1).bit_length()))
    at = F.pmod(F.col(column), F.lit(size))
    rows = hashes.groupBy(F.shiftright(at, 15).alias("page")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(1 << 15))).alias("bits")).collect()
    out = np.zeros(size >> 3, np.uint8)
    for r in rows:
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["page"] << 12 : (r["page"] << 12) + len(page)] = page
    return hashes.sparkSession.sparkContext.broadcast(out)


def _holding(bits, holds: bool):
    """Rows whose ``_key`` the bitmap may hold, or those whose it does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_inside(b.column("_key").to_numpy(), bits.value) == holds))

    return tidy(run)


def classes(docs: DataFrame, percent: int = 75, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, roots)``: each row's doc_id, shingle count and class; each class of a component of several rows, with its root class and smallest doc_id.

    ``members(doc_id, text_hash, n, class, outline)`` has a row for each row of ``docs``; class is
    null without words. ``roots(class, root, component_id)`` has the classes that are
    linked with another class or that several rows share; the others are a row alone.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    profile = stage(docs.mapInArrow(_profile(percent, k), "doc_id long, text_hash long, n long, class long, outline binary, bucket int, hits long"), "profile")
    members = profile.where("n is not null").select("doc_id", "text_hash", "n", "class", "outline")
    counts = profile.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits")).toArrow()  # 2 * SKETCH rows at most
    tall = np.zeros(2 * SKETCH, np.int64)
    tall[counts.column("bucket").to_numpy()] = counts.column("hits").to_numpy()
    heights = spark.sparkContext.broadcast(tall)

    sizes = members.where("class is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("outline").alias("o"))
    sizes = stage(sizes, "classes")

    def possible(pairs: DataFrame, name: str) -> DataFrame:
        """Sizes first, so that outlines travel with near sizes only."""
        for side in "ab":
            pairs = pairs.join(sizes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}")), side)
        pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        for side in "ba":
            pairs = pairs.join(sizes.select(F.col("class").alias(side), F.col("o").alias(f"o_{side}")), side)
        return stage(pairs.select("a", "b", "n_a", "n_b", "o_a", "o_b").mapInArrow(_possible(percent), "a long, b long"), name)

    def merged(name: str, **filters) -> DataFrame:
        runs = docs.mapInArrow(_runs(percent, k, heights, PARTS, **filters), "part int, grams binary, classes binary, levels binary")
        return stage(runs.repartition("part").mapInArrow(_merge(heights), "list long, a long, b long"), name)

    posted = merged("merged")
    pair = F.col("list").isNull()
    short, long = posted.where(pair).select("a", "b"), posted.where(~pair)
    if not long.isEmpty():
        # Lists that turned out long are skipped by their members, who post to their next shortest ones; only they can link through them.
        posted = merged("merged-again", only=_bitmap(long.select("a").distinct(), "a"), long=_bitmap(long.select("list").distinct(), "list"))
        short = short.unionByName(posted.where(pair).select("a", "b"))
    short = possible(short.distinct(), "pairs")
    lists = posted.where("list is not null").select("list", F.col("a").alias("class")).distinct()
    # Lists with the same smallest class are one from here on: shingles of one passage have the same members over and over.
    shared = lists.groupBy("list").agg(F.count("*").alias("m"), F.min("class").alias("head")).where("m > 1").select("list", "head")
    lists = lists.join(shared, "list").select(F.col("head").alias("list"), "class").distinct()
    lists = stage(lists.join(sizes.select("class", "n"), "class"), "lists")
    nodes = short.select(F.col("a").alias("class")).union(short.select("b")).union(lists.select("class"))
    nodes = stage(nodes.distinct(), "nodes")
    if nodes.isEmpty():
        return members, _components(members, spark.createDataFrame([], "class long, root long"))
    sets = docs.mapInArrow(_sets(k, _bitmap(nodes, "class")), "class long, grams binary")
    sets = stage(sets.join(nodes, "class", "left_semi").groupBy("class").agg(F.first("grams").alias("grams")), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x, y = sets.select(F.col("class").alias("a"), F.col("grams").alias("x")), sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
        return stage(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_probe(percent), "a long, b long"), name)

    def rooted(links: DataFrame, name: str) -> DataFrame:
        found = components(links, name).select(F.col("node").alias("class"), "root")
        return stage(nodes.join(found, "class", "left").select("class", F.coalesce("root", "class").alias("root")), f"{name}-roots")

    # Each class meets one partner first; pairs that are then in one component need no probe.
    links = verified(short.groupBy("b").agg(F.min("a").alias("a")), "first-links")
    roots = rooted(links, "first-join")
    todo = short
    for side in "ab":
        todo = todo.join(roots.select(F.col("class").alias(side), F.col("root").alias(f"root_{side}")), side)
    todo = todo.where("root_a <> root_b").select("a", "b")
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    for turn in range(STAR_ROUNDS + 1):
        left = lists.join(roots, "class")
        mixed = left.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
        # What is settled stays settled: each round has fewer lists.
        left = stage(left.join(mixed.select("list", "m"), "list"), f"left-{turn}")
        lists = left.select("list", "class", "n")
        rows, squares = left.agg(F.count("*"), F.sum("m")).first()
        last = not rows or turn == STAR_ROUNDS or squares <= LEFT_OVER * rows
        if rows:
            if last:
                # Sets that can link are on one level or on neighbouring ones; blocks of a list and level meet two by two.
                level = _level(F.col("n"), percent)
                rows = left.withColumn("e", F.explode(F.array(F.struct(level.alias("level"), F.lit(0).alias("upper")), F.struct((level - 1).alias("level"), F.lit(1).alias("upper"))))).select("list", "class", "root", "n", "e.*")
                groups = rows.groupBy("list", "level").agg(F.count("*").alias("m"), F.min("upper").alias("lowest")).where("m > 1 and lowest = 0")
                rows = rows.join(groups, ["list", "level"]).withColumn("blocks", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
                others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("u"), F.greatest("block", j).alias("v")))
                units = rows.withColumn("unit", F.explode(others)).select("list", "level", "unit.u", "unit.v", "class", "root", "n", "upper", "block")
                units = units.join(sizes.select("class", "o"), "class").repartition(*UNIT).sortWithinPartitions(*UNIT, "class")
                pairs = units.mapInArrow(_meet(percent), "a long, b long")
            else:
                other = left.select("list", F.col("class").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"))
                drawn = [F.min(F.struct(F.xxhash64("class", F.lit(turn * REPRESENTATIVES + r)).alias("h"), "class", "root", "n")).alias(f"r{r}") for r in range(REPRESENTATIVES)]
                heads = left.groupBy("list").agg(*drawn).select("list", F.explode(F.array(*[f"r{r}" for r in range(REPRESENTATIVES)])).alias("r"))
                heads = heads.select("list", F.col("r.class").alias("a"), F.col("r.root").alias("root_a"), F.col("r.n").alias("n_a")).distinct()
                pairs = heads.join(other, "list").where("root_a <> root_b").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.distinct().join(short, ["a", "b"], "left_anti")
            pairs = stage(pairs, f"pairs-{turn}") if last else possible(pairs, f"pairs-{turn}")
            todo, short = todo.unionByName(pairs), short.unionByName(pairs)
        new = verified(todo, f"links-{turn}")
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = rooted(links, f"join-{turn}")
        if last:
            break
        todo = short.limit(0)
    return members, _components(members, roots)


def _components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes whose component has several rows. Written, so that the join of all rows with it can split a hot class."""
    reach = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    reach = stage(reach.join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("root"), "least", "m"), "reach")
    least = reach.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("m").alias("size")).where("size > 1")
    return stage(reach.join(least, "root").select("class", "root", "component_id"), "components")


def _placed(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Each row's doc_id, text hash, shingle count, class, component, and the component's root class where it has several rows."""
    members, roots = classes(docs, percent, k)
    return members.select("doc_id", "text_hash", "n", "class").join(roots, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """Component of every document under "100 * shared >= percent * union" of distinct k-word shingles.

    Input: ``doc_id`` and ``text``; further columns are ignored. Output, a row for
    each input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest
    doc_id reachable by links, the document's own included.

    Words are runs of other than blank, tab, line feed, vertical tab, form feed
    and carriage return, A-Z lower-cased. Fewer than k words are one sequence;
    null, empty or blank texts have no shingle and link with nothing. Rows of one
    doc_id are separate texts with the same name. An empty table gives an empty
    result. A null doc_id is ordinary, but never the smallest. Sets are compared
    by 64-bit hashes, classes by 63 bits.
    """
    return _placed(docs, percent, k).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns stay.

    Texts without a word are no copies of each other and all stay. Of repeated
    rows with the same doc_id and text one stays, and of several texts under the
    smallest doc_id of a component the one with the smallest hash. Texts without a
    link stay apart under one doc_id, null or not.
    """
    # Components are told apart by their root classes: a doc_id, null or repeated, may name texts of several.
    grouped = stage(_placed(docs, percent, k).where("root is not null"), "grouped")
    heads = stage(grouped.where("doc_id <=> component_id").groupBy(F.col("root").alias("_group")).agg(F.min("text_hash").alias("head")), "heads")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("text_hash").eqNullSafe(F.col("head"))
    apart = grouped.join(heads, F.col("root") == F.col("_group"), "left").select("doc_id", "text_hash", stays.alias("stays"))
    apart = stage(apart.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("stays").alias("_stays"), F.count("*").alias("_m")), "decided")
    gone = apart.where("not _stays").select("_id", "_hash")
    gone = stage(gone, "gone")
    if gone.isEmpty():
        return docs
    # A row that the bitmap doesn't hold stays; only the others are shuffled to be compared. The row travels as one column.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_own_id"), F.xxhash64("text").alias("_own_hash"))
    rows = rows.withColumn("_key", F.xxhash64("_own_id", "_own_hash"))
    bits = _bitmap(gone.select(F.xxhash64("_id", "_hash").alias("key")), "key")
    stays, maybe = (rows.mapInArrow(_holding(bits, holds), rows.schema) for holds in (False, True))
    kept = maybe.join(gone, F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_hash").eqNullSafe(F.col("_hash")), "left_anti")
    out = stays.unionByName(kept).select("_row.*")
    twice = apart.where("_stays and _m > 1").select("_id", "_hash")
    if twice.isEmpty():
        return out
    names = docs.columns
    match = out["doc_id"].cast("long").eqNullSafe(twice["_id"]) & F.xxhash64(out["text"]).eqNullSafe(twice["_hash"])
    once = out.join(twice, match, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, match, "left_anti").unionByName(once).select(names)
