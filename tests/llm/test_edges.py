"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

from __future__ import annotations

import zlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import chat_snapshots, kernel_language, mil_quality, mixing, ngram_join, pivot_index, secrets, sharding, staging, string_tiling, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["size", "class", "n", "position", "_id", "root", "score", "shard", "key", "count", "first", "block"]
PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps all day long in the warm sun"
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann den ganzen tag"


@pytest.fixture(scope="module")
def odd(spark):
    """Texts null, empty, blank, long, equal and near; ids null and repeated; every column null somewhere."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a", 1),
        (2, PROSE, "en", "a", 2),
        (2, PROSE, "en", "a", 2),
        (3, PROSE + " again", None, None, None),
        (4, "", "de", "b", 0),
        (5, None, None, None, None),
        (None, DE, "de", None, 1),
        (None, DE, "de", "b", 1),
        (6, " \t\n ", "de", "b", 1),
        (7, "one two", "en", "b", 1),
        (7, "ONE  Two", "en", "c", 1),
        (8, long, "en", "c", 1),
        (9, long + " end", "en", "c", 1),
        (10, "x" * 300_000, "en", "c", 1),
        (11, "é\u2028ü\x00\x0b\U0001f600 \ud7ff", None, "", 1),
        (12, PROSE.upper(), "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (4, 0, 0), (None, 1, 0), (7, 0, None), (8, 7, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "jumps over the lazy dog and then it sleeps"), (1, "jumps over the lazy dog and then it sleeps"), (2, None), (3, ""), (None, "too short"), (4, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6")], "item_id long, text string")


def clashing(df):
    return df.withColumns({c: F.lit("other") for c in CLASH if c not in df.columns})


OVER_DOCS = {
    "secrets": lambda d, s: secrets.secrets(d),
    "language": lambda d, s: kernel_language.languages(d),
    "shards": lambda d, s: sharding.interleaved(d),
    "join": lambda d, s: ngram_join.near_duplicates(d),
    "dedup": lambda d, s: ngram_join.deduplicated(d),
    "mixing": lambda d, s: mixing.mixed(d),
    "mixed rows": lambda d, s: mixing.mixed_documents(d),
    "packed": lambda d, s: mixing.packed(d),
    "quality": lambda d, s: mil_quality.quality(d, s["labels"]),
    "of quality": lambda d, s: mil_quality.of_quality(d, s["labels"]),
    "tiling": lambda d, s: string_tiling.contaminated(d, s["benchmark"]),
    "decontaminated": lambda d, s: string_tiling.decontaminated(d, s["benchmark"]),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_documents(name, odd, labels, benchmark):
    """Each runs over odd rows, over none, and gives the same with further columns of clashing names."""
    side = {"labels": labels, "benchmark": benchmark}
    run = OVER_DOCS[name]
    out = run(odd, side)
    want = sorted(map(repr, out.collect()))
    kept = out.columns
    assert sorted(map(repr, run(clashing(odd), side).select(kept).collect())) == want
    assert run(odd.limit(0), side).collect() == []
    empty = {k: v.limit(0) for k, v in side.items()}
    run(odd, empty).collect()
    if name in ("secrets", "language", "shards", "join", "mixing", "quality"):
        assert len(want) == odd.count()
    if name in ("dedup", "mixed rows", "of quality", "decontaminated"):
        assert kept == odd.columns


def test_join_of_odd_texts(odd):
    got = [tuple(r) for r in ngram_join.near_duplicates(odd).collect()]
    by = {}
    for i, n, c in got:
        by.setdefault(i, set()).add((n, c))
    n = len(brute.shingles(PROSE))
    assert by[1] == by[2] == by[12] == {(n, 1)} and by[3] == {(n + 1, 1)}
    assert by[4] == {(0, 4)} and by[5] == {(0, 5)} and by[6] == {(0, 6)} and by[7] == {(1, 7)}
    assert by[9] == {(len(brute.shingles(odd.where("doc_id = 9").first().text)), 8)}


def test_dedup_of_odd_texts(odd):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in ngram_join.deduplicated(odd).collect())
    assert [i for i, _ in got] == [-1, 1, 4, 5, 6, 7, 8, 10, 11]


def test_dedup_tells_texts_of_one_id_apart(spark):
    """Unlinked texts under a null or a repeated doc_id all stay, and so does a second component of the same smallest doc_id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c + " end"), (3, d), (None, d + " end"), (4, e), (4, e), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in ngram_join.deduplicated(docs).collect())
    assert got == sorted([(-1, a), (-1, b), (1, c), (1, d), (4, e), (-1, "")])


def test_join_in_a_large_group(spark):
    """Near copies by the hundred that share all but a few words, in one chain of classes, and a common passage."""
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:40] + [f"own{i}"] + base[41:])) for i in range(150)]
    rows += [(1000 + i, " ".join(base[:30] + [f"q{i}r{j}" for j in range(40)])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == brute.near_duplicates(rows)


def test_mixture_stage(spark):
    """Of each source whole documents come, each as often as the target asks for or once less; words are off by half a document at most, and reruns agree."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == docs.columns
    got, again = ([tuple(r) for r in df.select("doc_id", "source").collect()] for df in (out, corpus_pipeline.mixture(spark, docs, "")))
    assert sorted(got, key=repr) == sorted(again, key=repr)
    size = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.collect()}
    names = sorted({s for s, _ in size.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for t, n in size.values() if t == s) for s in names}
    target = dict(zip(names, brute.shares([total[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    for s in names:
        taken = [i for i, t in got if t == s]
        own = [i for i, (t, n) in size.items() if t == s and n]
        assert abs(sum(size[i][1] for i in taken) - target[s]) <= max((size[i][1] for i in own), default=0) / 2 + 1
        times = [taken.count(i) for i in own]
        assert max(times) - min(times) <= 1 and max(times) <= 3


def test_sharding_stage(spark):
    """What the last stage returns is the contract of the sharding query, over its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.shards(spark, docs.unionByName(docs), "").collect()
    assert len(got) == 2 * docs.count()
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    counts = [sum(r.shard == k for r in got) for k in range(8)]
    assert max(counts) - min(counts) <= 1


def test_staged_tables_go(spark, odd, tmp_path, monkeypatch):
    """Tables are kept by application below the shared folder, and ``clear`` removes those of this one alone."""
    import os

    monkeypatch.setattr(staging, "staging_root", lambda spark: str(tmp_path))
    (tmp_path / "other").mkdir()
    assert staging.stage(odd, "odd").count() == odd.count()
    assert sorted(os.listdir(tmp_path)) == sorted(["other", f"attestra-{spark.sparkContext.applicationId}"])
    staging.clear(spark)
    assert os.listdir(tmp_path) == ["other"]


def test_tiles_are_greedy():
    """Random items and texts of few words, where runs cross and overlap, against the definition."""
    import random

    import pyarrow as pa

    random.seed(3)
    for _ in range(200):
        some = "abcdefgh"[: random.choice([1, 2, 3, 8])]
        item, text = ([random.choice(some) for _ in range(random.randint(1, n))] for n in (18, 30))
        want = brute.tiles(item, text, 2)
        got = list(string_tiling.Items([7], [" ".join(item)], 2).matches(pa.array([" ".join(text)])))
        assert got == ([(0, 0, len(want), sum(x[2] for x in want), len(item))] if want else []), (item, text)


def test_tiling_of_one_word_over_and_over():
    """Memory by common runs: pairs of positions would be a hundred million."""
    import tracemalloc

    import pyarrow as pa

    tracemalloc.start()
    found = list(string_tiling.Items([7], ["same " * 1000], 5).matches(pa.array(["same " * 100_000]), 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1, 1000, 1000)] and peak < 200e6


def test_benchmark_in_blocks(odd, benchmark):
    """Several blocks, one pass each, give what one block gives."""
    for run in (string_tiling.contaminated, string_tiling.decontaminated):
        want = sorted(map(repr, run(odd, benchmark).collect()))
        assert sorted(map(repr, run(odd, benchmark, block_items=2).collect())) == want


def test_tiling_sees_reordered_passages(spark):
    a, b = " ".join(f"left{i}" for i in range(12)), " ".join(f"right{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"pre {b}, and {a} post"), (2, f"{a[:40]} nothing else")], "doc_id long, text string")
    got = string_tiling.contaminated(docs, spark.createDataFrame([(7, f"{a} {b}")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_tiles, r.matched_words, r.coverage) for r in got] == [(1, 2, 24, 1.0)]


def test_vectors_of_odd_kinds(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.1], 0), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [float("nan"), 1.0, 1.0], 0), (9, [1.0, None, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (11, v, 1), (12, [1.0, 2.0], 0), (2, v, 0), (None, [-1.0, 0.0, 0.5], 3), (14, [0.0, -0.0, 1.0], 5), (15, [-0.0, 0.0, 1.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for table in (df, clashing(df)):
        got = sorted((tuple(r) for r in pivot_index.near_vectors(table).collect()), key=repr)
        by = {}
        for r in got:
            by.setdefault(r[0], []).append(r[1:])
        assert by[1] == [(3, 1, True)] and by[2] == [(3, 1, False)] * 2 and by[3] == [(3, 1, False)]
        assert all(by[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
        assert by[None] == [(0, None, True)] and by[15] == [(1, 14, False)]
    assert pivot_index.near_vectors(df.limit(0)).collect() == []


def test_long_lists_of_vectors(spark, monkeypatch):
    """Lists longer than a block meet block by block."""
    import numpy as np

    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    rng = np.random.default_rng(3)
    center = rng.normal(size=8)
    rows = [(i, (center + rng.normal(size=8) * 0.25).tolist(), 0) for i in range(120)] + [(500 + i, rng.normal(size=8).tolist(), 0) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.near_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(x[0] for x in got.values()) >= 0.9 * sum(x[0] for x in want.values())


def test_urls_of_odd_kinds(spark):
    urls = [None, "", "x", "://", "http://", "http://A.Example.NET/en/x?q=1#f", "http://net", "http://NET/", "https://a.org/fr/", "https://a.org/FR/", "s://example.com/de/", "s://x?y#z", "s://h#f/p", "a://b://c/d", "http://net/\n", "http://ÄNET/x", "http://b.example.net/en"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[5])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string")
    for table in (df, clashing(df)):
        got = url_rules.judged(table).collect()
        assert len(got) == len(rows)
        for r in got:
            host, path, rule, verdict = brute.ruled(urls[r.page_id] if r.page_id is not None else urls[5], url_rules.RULES)
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert url_rules.judged(df.limit(0)).collect() == []


def test_mined_rules_decide(spark):
    """A path token that goes with blocked hosts blocks pages that no written rule fits."""
    rows = [(i, f"http://h{i}.net/promo/{i}") for i in range(40)] + [(100 + i, f"http://h{i}.org/fr/news/{i}") for i in range(40)]
    rows += [(500, "http://elsewhere.info/promo/7"), (501, "http://elsewhere.info/fr/news/7")]
    got = {r.page_id: r for r in url_rules.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[500].verdict, got[500].mined_rule) == ("block", "path0:promo") and got[501].verdict == "allow"


def test_pruning():
    rules = [(frozenset("a"), "block", 0.9, 0.1), (frozenset("ab"), "block", 0.9, 0.05), (frozenset("ac"), "block", 0.95, 0.05), (frozenset("ab"), "allow", 0.8, 0.05)]
    assert [(sorted(r[0]), r[1]) for r in url_rules.pruned(rules)] == [(["a"], "block"), (["a", "b"], "allow"), (["a", "c"], "block")]


def test_secrets_by_owner(spark):
    copied, own = "AKIAQWERTYUIOPAS12", "zT9qL2mV7xB4nR8wK1cJ6pY3"
    rows = [(i, f"key {copied} here", f"s{i}") for i in range(4)] + [(9, f"value {own} end", "s9"), (10, 'Password: "hunter2secret" API_KEY=abcdefgh.12 tokenx=1', "s1"), (11, "é😀 secret=abcdefgh " + "0123456789abcdef" * 2, "s1"), (12, None, None), (13, "token=short", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.secrets(clashing(df)).collect()}
    for i, t, _ in rows:
        counts, spans, digest = brute.secrets(t)
        assert ([got[i].n_assign, got[i].n_access, got[i].n_hex], got[i].base_sha256) == (counts, digest)
        assert set(spans) <= set(got[i].spans.split(",")) | {""}
    assert got[0].n_copied == 1 and got[0].most_repositories == 4 and got[0].n_live == 0
    assert got[9].n_live == 1 and got[9].spans == f"bare:6:{6 + len(own)}"


def test_chats_of_odd_kinds(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "bot", "yo"), (2, 1, "user", "hi"), (3, 1, "user", "hi"), (3, 2, "bot", "yo"), (3, 2, "bot", "yo"), (4, 1, None, None), (4, 2, "user", ""), (5, 1, None, ""), (None, 1, "user", "hi"), (6, None, "user", "<|im_end|>"), (7, 5, "user", "hi"), (7, 9, "bot", "yo"), (7, 11, "bot", "more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for table in (df, clashing(df)):
        got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_snapshots.rendered(table).collect()}
        assert got == {4: (2, 1), 5: (1, 1), 6: (1, 1), 7: (3, 1)}
    assert chat_snapshots.rendered(df.limit(0)).collect() == []
    text = {r.conv_id: r.chat for r in chat_snapshots.rendered(df).collect()}
    assert text[4] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n<|im_end|>" and "< |im_end|>" in text[6]


def test_shares():
    for sizes in ([10, 1000, 5], [7], [0, 0], [100, 1, 1, 1], [0, 50]):
        w = [(1, 2, 3)[i % 3] for i in range(len(sizes))]
        got = mixing.shares(sizes, w)
        if sum(sizes):
            assert max(abs(a - b) for a, b in zip(got, brute.shares(sizes, w), strict=True)) < 1e-6


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 7, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(out) == list(range(n))


def test_packed_blocks(spark):
    rows = [(i, " ".join(f"s{i % 2}d{i}w{j}" for j in range(10 + i)), f"s{i % 2}") for i in range(40)]
    out = mixing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16, shards=4).collect()
    assert {r.shard for r in out} == set(range(4))
    assert all(len(r.words) == 16 or len(r.words) < 16 and r.block >= 0 for r in out)
    assert all(w.startswith(r.source) for r in out for w in r.words)


def test_mixed_documents_come_near_their_targets(spark):
    """A source is off its target by half of its longest document at most, also where one document holds most of its words."""
    size = {i: 4000 if i % 20 == 7 else 20 + i for i in range(100)}
    rows = [(i, " ".join(f"w{j}" for j in range(n)), f"s{i % 5}") for i, n in size.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    longest, words = {}, {}
    for i, _, s in rows:
        longest[s], words[s] = max(longest.get(s, 0), size[i]), words.get(s, 0) + size[i]
    target = dict(zip(sorted(words), brute.shares([words[s] for s in sorted(words)], [1, 2, 3, 1, 2]), strict=True))
    for seed in range(3):
        taken, copies = dict.fromkeys(words, 0), {}
        for r in mixing.mixed_documents(docs, seed=seed).collect():
            taken[r.source] += size[r.doc_id]
            copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in words) and max(copies.values()) <= 3


def test_stages_of_odd_rows(spark, odd, labels, benchmark, tmp_path):
    """Every stage runs over what the one before kept, and over nothing."""
    labels.write.parquet(f"{tmp_path}/labels.parquet"), benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, odd.limit(0), str(tmp_path)).collect() == []


def test_pipeline(spark, sf):
    """Against the contracts: no item, no near copy, no rejected document is left; all others are there."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in out.collect()}
        step_out = step(spark, out, sf)
        if i < 4:
            assert step_out.columns == docs.columns
        path = f"{corpus_pipeline.stage.__globals__['staging_root'](spark)}/test-{name}-{id(sf)}"
        step_out.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        after = {r.doc_id for r in out.collect()}
        assert after <= before.keys()
        if name == "ngram_jaccard_join":
            want = brute.near_duplicates([(i, r.text) for i, r in before.items()])
            assert after == {c for i, n, c in want if n} | {i for i, n, _ in want if not n}
        if name == "benchmark_decontamination":
            assert string_tiling.contaminated(out, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0 < len(before) - len(after)
    assert out.count() > 0


def test_sharded_rows_keep_their_texts(spark):
    """Every row comes back whole, with the places of ``interleaved``; repeated rows have one each."""
    rows = [(i, f"text {i % 7}", ("a", "b", None)[i % 3], i) for i in range(200)] + [(5, "text 5", None, 5)] * 40 + [(None, None, None, k) for k in range(3)] + [(1, None, "a", 0), (1, "", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int").withColumn("_id", F.lit("x")).withColumn("_row", F.lit("y"))
    out = sharding.sharded(df)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "_id", "_row", "size", "text_crc32", "law", "shard", "slot"]
    assert sorted((r.doc_id or -1, r.text or "", r.source or "") for r in got) == sorted((i or -1, t or "", s or "") for i, t, s, _ in rows)
    names = ("doc_id", "size", "text_crc32", "law", "shard", "slot")
    want = sorted(map(repr, (tuple(r) for r in sharding.interleaved(df).select(*names).collect())))
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got))) == want
    assert all(zlib.crc32((r.text or "").encode()) == r.text_crc32 for r in got)
    # Of each source every shard has its share, give or take one and a row of the cut.
    for s in ("a", "b", None):
        counts = [sum(r.source == s and r.shard == k for r in got) for k in range(8)]
        assert max(counts) - min(counts) <= 2, (s, counts)
    assert sharding.sharded(df.limit(0)).collect() == []
