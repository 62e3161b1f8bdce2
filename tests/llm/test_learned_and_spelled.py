"""Centroids, toxicity and spelling variants against plain computations, and over odd rows."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import factor_toxicity, kd_clusters, queries, range_spelling

VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(df):
    """The brute force's rows, told apart by id and by components."""
    return {(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in kd_clusters.clusters(df).collect()}


def wanted(rows):
    return {(i, c, d, hashlib.sha256(z.encode()).hexdigest()) for (i, _), (c, d, z) in brute.clusters([(r[0], r[1]) for r in rows]).items()}


def test_clusters_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.QUERIES["op11_kd_clusters"](spark, sf)
    assert {(r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got.collect()} == wanted(rows)
    by = {r["cluster"]: (r["a"], r["b"]) for r in got.groupBy("cluster").agg(F.sum("distance").alias("a"), F.max("cluster_inertia").alias("b")).collect()}
    assert all(a == b for a, b in by.values()) and {r.inertia for r in got.select("inertia").distinct().collect()} == {sum(a for a, _ in by.values())}


def test_clusters_of_odd_vectors(spark):
    """Tight groups far apart, whose nodes go whole; copies; ties between equal centroids; vectors that are not kept; a null id."""
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        middle = rng.normal(0, 4, 64)
        rows += [(len(rows) + k, (middle + rng.normal(0, 0.01, 64)).tolist(), g) for k in range(80)]
    rows += [(5000 + k, rows[7][1], None) for k in range(300)] + [(5000, rows[7][1], 1)] * 2
    odd = [(9000, None, 1), (9001, [], 1), (9002, [1.0] * 63, 1), (9003, [None] + [0.0] * 63, 1), (9004, [float("nan")] * 64, 1), (9005, [float("-inf")] * 64, 1)]
    kept = [(9100, [0.0] * 64, None), (9101, [-1e-9] * 64, 2), (9102, [3000.5] * 64, 2)]
    df = spark.createDataFrame(rows + odd + kept, VECTORS).repartition(4)
    single = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows + kept]
    assert clustered(df) == wanted(single)
    assert clustered(df.withColumns({c: F.lit("other") for c in ("cluster", "distance", "point", "n")})) == wanted(single)
    assert kd_clusters.clusters(df.limit(0)).count() == 0
    assert kd_clusters.clusters(spark.createDataFrame(odd, VECTORS)).count() == 0
    assert kd_clusters.clusters(spark.createDataFrame([(None, [1.0] * 64, 1)] * 3, VECTORS).repartition(2)).collect()[0]["distance"] == 0
    with pytest.raises(Exception, match="too large"):
        kd_clusters.clusters(spark.createDataFrame([(1, [1e30] * 64, 1)], VECTORS)).collect()


@pytest.mark.parametrize("scale", [200, 1 << 24])
def test_trees(scale):
    """What trees add up and find is what all distances say, in doubles and in integers; whole nodes are used, and ties go to the first."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-scale, scale, (1, 64)) + rng.integers(-9, 9, (300, 64)) for _ in range(9)]).astype(np.int32)
    tree, order = kd_clusters.Tree.grown(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(len(points)))
    z = np.concatenate([points[::150].astype(np.int64), points[:300:150].astype(np.int64)])
    own = np.array([min(range(len(z)), key=lambda k: (sum((int(a) - int(b)) ** 2 for a, b in zip(p, z[k], strict=True)), k)) for p in tree.points])
    got, distance = tree.nearest(z)
    assert (got == own).all() and (distance == ((tree.points.astype(np.int64) - z[own]) ** 2).sum(1)).all()
    count, sums = tree.totals(z)
    assert (count == np.bincount(own, minlength=len(z))).all() and all((sums[k] == tree.points[own == k].sum(0, dtype=np.int64)).all() for k in range(len(z)))
    few = points[::300].astype(np.int64)
    assert len(tree.walk(few)[1]) < len(points)  # some nodes went whole


def test_gradient_of_pairs():
    rng = np.random.default_rng(1)
    term, start = rng.integers(0, 6, 14), np.array([0, 4, 4, 9, 14])
    for a, b in zip(start[:-1], start[1:], strict=True):
        term[a:b] = rng.permutation(6)[: b - a]
    w, v, y, share = rng.normal(size=6), rng.normal(size=(6, 3)), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])

    def loss(w, v, bias):
        p = factor_toxicity.chance(bias + factor_toxicity.raw(w, v, term, start)[0])
        return -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    pairs = [sum(v[i] @ v[j] for n, i in enumerate(t) for j in t[:n]) for t in (term[a:b] for a, b in zip(start[:-1], start[1:], strict=True))]
    assert np.allclose(factor_toxicity.raw(w * 0, v, term, start)[0], pairs)
    own, dw, dv, db = factor_toxicity.gradient(w, v, 0.3, term, start, y, share)
    step = 1e-6
    for k, i in enumerate(own):
        e = np.zeros(6)
        e[i] = step
        assert abs((loss(w + e, v, 0.3) - loss(w - e, v, 0.3)) / (2 * step) - dw[k]) < 1e-5
        for f in range(3):
            e = np.zeros((6, 3))
            e[i, f] = step
            assert abs((loss(w, v + e, 0.3) - loss(w, v - e, 0.3)) / (2 * step) - dv[k, f]) < 1e-5
    assert abs((loss(w, v, 0.3 + step) - loss(w, v, 0.3 - step)) / (2 * step) - db) < 1e-5


def test_pairs_beat_weights():
    """An insult and a group apart are harmless, together toxic; each is as frequent alone. Weights alone cannot tell, pairs can, also where the pair was never seen."""
    rng, texts, labels = random.Random(4), [], []
    insults, groups = [f"insult{k}" for k in range(6)], [f"group{k}" for k in range(6)]
    for _ in range(4000):
        kind = rng.randrange(4)
        t = [f"word{rng.randrange(300)}" for _ in range(20)]
        i, g = rng.randrange(6), rng.randrange(6)
        if kind == 3 and (i, g) == (2, 5):
            g = 0  # kept for the test
        t += [insults[i]] * (kind in (1, 3)) + [groups[g]] * (kind in (2, 3))
        rng.shuffle(t)
        texts.append(" ".join(t))
        labels.append(float(kind == 3))
    fitted = factor_toxicity.fit(pa.array(texts[:3000]), np.array(labels[:3000]), np.ones(3000))
    plain = factor_toxicity.fit(pa.array(texts[:3000]), np.array(labels[:3000]), np.ones(3000), factors=0)

    def scores(model, texts):
        return model.score(*factor_toxicity.terms(*factor_toxicity.buffers(pa.array(texts))))

    y = np.array(labels[3000:])
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss(scores(fitted, texts[3000:])) < 0.5 * loss(scores(plain, texts[3000:]))
    alone = scores(fitted, ["insult2 word1", "group5 word1"])
    assert scores(fitted, ["insult2 group5 word1"])[0] > 0.5 > alone.max()


def test_toxicity_of_the_held_out(spark):
    """Of documents that no label was learned from, nearly all toxic ones are found and no clean one is."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    rows = queries.QUERIES["op12_factor_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    found = [r.predicted for r in rows if r.toxic == 1]
    assert len(found) > 80 and np.mean(found) >= 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.005


def test_toxicity_of_odd_rows(spark):
    rows = [(i, f"some text {'idiot' if i % 3 == 0 else 'friend'} number {i}", None) for i in range(300)]
    odd = [(1000, None, "a"), (1001, "", None), (1002, " \n", "b"), (None, "idiot", "c"), (1003, "idiot " * 200_000, "c"), (1004, "\x00퟿\U0001f600", None), (1003, "an idiot", "c"), (1003, "an idiot", "c")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] * 2 + [(None, 1), (5, None), (7, 9), (1001, 0)], "doc_id long, toxic int")
    out = factor_toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows + odd)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.held_out, r.score, r.predicted)
    got = {r.doc_id: r for r in out}
    assert got[1003].predicted == 1 and got[None].predicted == 1 and not got[None].held_out and got[1000].score == got[1001].score == got[1002].score < 0.5
    wide = docs.withColumns({c: F.lit("x") for c in ("score", "toxic", "_id", "_t", "held_out", "count")})
    assert sorted(factor_toxicity.toxicity(wide, labels.withColumn("text", F.lit("y"))).collect(), key=key) == sorted(out, key=key)
    assert factor_toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in factor_toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def _spelled(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("chunk", [range_spelling.CHUNK, 2])
def test_variants(spark, monkeypatch, chunk):
    """Random words with edits at every place, repeated letters, letters up to ÿ, chains of forms; the same when hardly two words may share a key."""
    rng, words, texts = random.Random(9), [], []
    letters = "abcàÿ÷"
    for _ in range(40):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        words.append(w)
        for p in range(len(w) + 1):
            words += [w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :], w[:p] + w[p + 1 :]]
    words += ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "aaaaaaa", "abababab", "ababababa"]
    for i in range(60):
        texts.append((i, " ".join(rng.choice(words) for _ in range(150))))
    chain = "1".join(["lettersx"] * 2 + ["Lettersxy"] * 40 + ["letterszy"] * 900)
    texts += [(None, chain), (77, chain), (77, None), (78, ""), (78, "a" * 70_000), (79, "A" * 70_000 + "." + "a" * 70_001 + "-" + "a" * 70_001)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = brute.variants(texts)
    assert _spelled(range_spelling.variants(df, chunk)) == want and len(want) > 200
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of two forms
    monkeypatch.setattr(range_spelling, "CHUNK", 64)
    assert _spelled(range_spelling.variants(df.withColumns({c: F.lit("x") for c in ("word", "n", "run", "h", "key", "a", "b", "id", "root")}), chunk)) == want
    assert range_spelling.variants(df.limit(0)).count() == 0


def test_rectangles():
    """A wavelet tree reports what lies in a rectangle, and nothing else."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 37, 256):
        values = rng.permutation(n)
        tree = range_spelling.Wavelet(values)
        box = rng.integers(0, n + 1, (4, 50))
        lo, hi, low, high = np.minimum(box[0], box[1]), np.maximum(box[0], box[1]), np.minimum(box[2], box[3]), np.maximum(box[2], box[3])
        of, value = tree.report(lo, hi, low, high)
        want = {(k, v) for k in range(50) for v in values[lo[k] : hi[k]].tolist() if low[k] <= v < high[k]}
        assert set(zip(of.tolist(), value.tolist(), strict=True)) == want and len(of) == len(want)


def test_edits_at_every_place():
    """Near pairs of one key of the whole word are the pairs of one edit, each told once in each direction."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(150)})
    rows = np.zeros((len(words), 8), np.uint8)
    for k, w in enumerate(words):
        rows[k, : len(w)] = np.frombuffer(w.encode(), np.uint8)
    x, y = range_spelling.near(7, 0, 7, rows, np.array([len(w) for w in words]))
    got = sorted(zip(x.tolist(), y.tolist(), strict=True))
    want = sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if 7 in (len(a), len(b)) and brute.one_edit(a, b))
    assert got == want
