"""The registered queries against their contracts in plain Python, over whole small tables."""

from __future__ import annotations

import glob
import os
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import chat_snapshots, kernel_language, mil_quality, mixing, pivot_index, queries, string_tiling, url_rules


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_vectors(spark, sf):
    want = brute.near_vectors([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()])
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows(spark, sf, "op1_pivot_index")}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)  # no link that is none
    assert sum(x[0] for x in got.values()) >= 0.9 * sum(x[0] for x in want.values())


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, sf)
    got = Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    rel = con.sql(queries.ORACLE_SQL[name])
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in at] == sorted(df.columns)
    assert got == Counter(tuple(r[i] for i in at) for r in rel.fetchall()) and got


@pytest.fixture(scope="module")
def planted(spark):
    """Vectors of 64 numbers by label: far apart, two dense clusters (mean cosine 0.65 and 0.8), near copies of one; each with links of 0.931 to 0.99 and exact copies."""
    rng, rows = np.random.default_rng(7), []
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    for label, mean, n in ((0, 0, 400), (1, 0.65, 400), (2, 0.8, 400), (4, 0.95, 100)):
        x = unit(np.sqrt(mean) * unit(rng.normal(size=64)) + np.sqrt(1 - mean) * unit(rng.normal(size=(n, 64))))
        base, t = x[: n // 4], rng.uniform(0.931, 0.99, size=(n // 4, 1))
        away = rng.normal(size=base.shape)
        away = unit(away - (away * base).sum(1, keepdims=True) * base)
        for v in np.concatenate([x, t * base + np.sqrt(1 - t * t) * away, x[:10]]):
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def test_planted_links(planted):
    """No link that is none; of all links, and of those of each label, and of those of the queries (ids divisible by 20), 0.9 or more."""
    rows, df = planted
    want = brute.near_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df).collect()}
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    for own in [[i for i, _, lab in rows if lab == k] for k in (0, 1, 2, 4)] + [[i for i in want if i % 20 == 0]]:
        assert sum(got[i][0] for i in own) >= 0.9 * sum(want[i][0] for i in own) > 0
    assert {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df, exact=True).collect()} == want


@pytest.fixture(scope="module")
def many(spark):
    """One label of 20,000 vectors with a mean cosine of 0.65; 5000 of them have a partner at a cosine of 0.9301."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.sqrt((x * x).sum(-1, keepdims=True))
    x = unit(np.sqrt(0.65) * unit(rng.normal(size=64)) + np.sqrt(0.35) * unit(rng.normal(size=(15000, 64))))
    away = rng.normal(size=(5000, 64))
    away = unit(away - (away * x[:5000]).sum(1, keepdims=True) * x[:5000])
    x = np.concatenate([x, 0.9301 * x[:5000] + np.sqrt(1 - 0.9301**2) * away]).astype(np.float32)
    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * 64)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.ListArray.from_arrays(at, pa.array(x.ravel())), "label": np.zeros(len(x), np.int32)})
    return x, spark.createDataFrame(table).repartition(8)


def test_recall_in_a_large_group(spark, many, monkeypatch):
    """Of links that are as weak as may be 0.98 are found and no others, and most lists leave no vector to fetch."""
    x, df = many
    x = pivot_index._unit(x.astype(np.float64))
    want = sum(int((x[i : i + 2000] @ x.T >= 0.93).sum()) for i in range(0, len(x), 2000)) - len(x)
    written, kept = {}, pivot_index.stage
    monkeypatch.setattr(pivot_index, "stage", lambda d, name: written.setdefault(name, kept(d, name)))
    found = pivot_index.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert want >= 9000 and 0.98 * want <= found <= want
    posted = written["posted"].agg(F.sum(F.size("keys"))).first()[0]
    assert written["counted"].count() < 0.2 * posted


def test_lists_stay_short(planted):
    """Pivots of a dense group still differ, and a group of near copies is one list."""
    x = {k: np.array([v for _, v, lab in planted[0] if lab == k], float) for k in (1, 2, 4)}
    for k in (1, 2):
        mean, pivots, n = pivot_index.described(pivot_index._unit(x[k])[:64], 0.93)
        near = pivot_index.nearest_pivots(pivot_index._unit(x[k]) - mean, pivots, n)
        lists = Counter(pivot_index._keys(near).ravel().tolist())
        assert len(pivots) > 50 and max(lists.values()) < len(x[k]) / 4
    assert pivot_index.described(pivot_index._unit(x[4])[:32], 0.93)[2] == 0


def test_urls(spark, sf):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = rows(spark, sf, "op2_url_rules")
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        host, path, rule, verdict = brute.ruled(urls[r.page_id], url_rules.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_tiling(spark, sf, documents):
    items = {r.item_id: brute_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for d in documents:
        w = brute_words(d.text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for i, item in items.items():
            if any(tuple(item[j : j + 5]) in grams for j in range(len(item) - 4)):
                t = brute.tiles(item, w, string_tiling.LEAST)
                if sum(x[2] for x in t) >= string_tiling.COVERAGE * len(item):
                    want.add((d.doc_id, i, sum(x[2] for x in t)))
    got = {(r.doc_id, r.item_id, r.matched_words) for r in rows(spark, sf, "op3_string_tiling")}
    assert got == want and want


def brute_words(text):
    import re

    return re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or "").translate(brute.UPPER))


def test_secrets(spark, sf, documents):
    texts = {d.doc_id: d.text for d in documents}
    got = {r.doc_id: r for r in rows(spark, sf, "op4_secret_owners")}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        counts, spans, digest = brute.secrets(texts[i])
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, digest)
        assert set(spans) <= set(r.spans.split(",")) | {""}


def test_language(spark, sf, documents):
    lang = {d.doc_id: d.lang for d in documents}
    got = rows(spark, sf, "op5_kernel_language")
    assert {r.doc_id for r in got} == lang.keys() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == brute.held_out(r.doc_id) for r in got)
    tested = [r for r in got if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.95 * len(tested) > 0


def test_shards(spark, sf, documents):
    text = {d.doc_id: (d.text or "").encode() for d in documents}
    got = rows(spark, sf, "op6_interleaved_shards")
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t) + 1, zlib.crc32(t)) for i, t in text.items()}
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for k in count:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(count[k]))
    source = {d.doc_id: d.source for d in documents}
    for s, n in Counter(source.values()).items():
        own = Counter(r.shard for r in got if source[r.doc_id] == s)
        assert all(abs(own[k] - n / 8) <= 2 for k in range(8))


def test_near_duplicates(spark, sf, documents):
    want = brute.near_duplicates([(d.doc_id, d.text) for d in documents])
    got = {tuple(r) for r in rows(spark, sf, "op7_ngram_join")}
    assert got == want
    assert any(i != c for i, _, c in want)


def test_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = rows(spark, sf, "op8_mil_quality")
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == brute.held_out(r.doc_id) for r in got)
    tested = [r for r in got if r.held_out and label.get(r.doc_id) is not None]
    assert sum(r.predicted == label[r.doc_id] for r in tested) >= 0.9 * len(tested) > 0


def test_quality_gradient():
    """The hand-written gradient of every weight against differences."""
    texts = pa.array(["good words in a row " * 40, "x y 1 2 3", "bad bad bad " * 50, None, "one\ntwo; three"])
    labels = np.array([1.0, 0, 0, 1, 1])
    model = mil_quality.fit(texts, labels)
    data, offsets = mil_quality.buffers(texts)
    x, start = mil_quality.passages(data, offsets)
    x = (x - model.mean) / model.scale
    w = {k: v + 0.1 for k, v in model.weights.items()}

    def loss(w):
        p = mil_quality._forward(w, x, start)[0]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    grad = mil_quality.gradient(w, x, start, labels)
    for k in w:
        for at in [np.unravel_index(i, w[k].shape) for i in np.random.default_rng(1).integers(0, w[k].size, 12)]:
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - grad[k][at]) < 1e-6 + 1e-4 * abs(grad[k][at]), k


def test_string_kernel():
    """Kernel values against sets of n-grams in plain Python, in two scripts, and the ridge scores against a plain solution."""
    texts = ["the cat sat", "THE hat", "", "aa", "漢字かな交じり文", "漢字の文字" * 3, "\U0001f600 ab"]
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    land = kernel_language.Landmarks([kernel_language.presence(t) for t in texts])
    got = land.kernel([kernel_language.presence(t) for t in texts])
    want = [[len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5 for b in grams] for a in grams]
    assert np.allclose(got, want)
    # A long text of a large alphabet holds what it holds, and no more.
    wide = "".join(chr(0x4E00 + i % 20000) for i in range(0, 700_000, 7))
    assert len(kernel_language.presence(wide)) == len({wide[i : i + n] for n in (1, 2, 3) for i in range(len(wide) - n + 1)})
    assert len(kernel_language.presence("\u9999")) == 1


def test_mined_rules_on_held_out_pages(spark):
    """A third of the pages that written rules judge is hidden; mined rules give those it matches the same verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = url_rules.parsed(pages).withColumn("hidden", F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0)
    index = url_rules.mine(rows.where("not hidden"))
    found = [(index.best(r.tokens), r.verdict) for r in rows.where("hidden and verdict is not null").collect()]
    hits = [(best[1], verdict) for best, verdict in found if best]
    assert len(hits) >= 0.5 * len(found) and sum(a == b for a, b in hits) >= 0.9 * len(hits)


def test_mined_rules_need_all_their_pages(spark):
    """A token that rules judge on one host alone says nothing of other hosts; one that is judged wherever it stands does."""
    urls = [f"http://a.example.com/de/x{i}" for i in range(10)] + [f"http://b{i}.com/y/{i}" for i in range(40)] + [f"http://c{i}.net/bad/{i}" for i in range(20)] + ["http://d.io/bad/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judged(pages).collect()}
    assert all(got[i].verdict == "allow" and got[i].mined_rule is None for i in range(10, 50))
    assert got[70].verdict == "block" and "path0:bad" in got[70].mined_rule


def test_added_secret_spans(spark, sf, documents):
    """Every added span is a live-looking value of one owner, and no such value is left out."""
    import re

    got = {r.doc_id: r for r in rows(spark, sf, "op4_secret_owners")}
    bare, owners, repos = {}, defaultdict(set), defaultdict(set)
    for d in documents:
        base = [tuple(map(int, x.split(":")[1:])) for x in brute.secrets(d.text)[1]]
        values = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", d.text or "")]
        live = lambda v: re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= 10 and not re.search("(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234", v)
        bare[d.doc_id] = [(a, b, v) for a, b, v in values if live(v) and not any(x < b and y > a for x, y in base)]
        taken = [v for *_, v in bare[d.doc_id]] + [m[g] for _, p, least, g in brute.BASE for m in p.finditer(d.text or "") if len(m[g]) >= least]
        for v in taken:
            owners[v].add(d.source), repos[v].add((d.source, d.doc_id))
    for i, r in got.items():
        want = {f"bare:{a}:{b}" for a, b, v in bare[i] if len(owners[v]) == 1 and len(repos[v]) < 10}
        assert {x for x in r.spans.split(",") if x.startswith("bare")} == want


def test_drawn_slots():
    """Sources come to their expectation, shards to their size, and counts differ from shard to shard."""
    want = np.array([1000.4, 20.6, 0.0, 5e3])
    out = mixing.drawn(want, np.array([2000, 20, 0, 10**9]), 8, 1)
    assert out.sum(0).tolist() == [1000, 20, 0, 5000] and np.ptp(out.sum(1)) <= 1 and np.ptp(out[:, 0]) > 0
    assert mixing.drawn(np.array([3e11, 1e10]), np.array([10**12] * 2), 4, 1).sum(0).tolist() == [3 * 10**11, 10**10]


def test_packed_blocks(spark, sf, documents):
    """The blocks hold the words that ``mixed`` says are taken, in the order of the documents."""
    size = {d.doc_id: brute.WORD.findall(d.text or "") for d in documents}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    blocks = mixing.packed(docs).collect()
    for k in range(mixing.SHARDS):
        assert sorted(r.slot for r in blocks if r.shard == k) == list(range(sum(r.shard == k for r in blocks)))
    taken = sum(r.taken for r in mixing.mixed(docs).collect())
    assert sum(len(r.words) for r in blocks) == taken
    for r in blocks[:200]:
        if len(r.doc_ids) == 1:
            own = size[r.doc_ids[0]]
            assert any(own[i : i + len(r.words)] == r.words for i in range(len(own)))


def test_chats(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    convs = {i: [x[1:] for x in sorted(t)] for i, t in turns.items()}
    got = rows(spark, sf, "op9_chat_snapshots")
    assert {r.conv_id: r.n_copies for r in got} == brute.maximal(convs)
    for r in got:
        assert r.n_turns == len(convs[r.conv_id])
        assert r.chat == "\n".join(f"<|im_start|>{a}\n{t}<|im_end|>" for a, t in convs[r.conv_id])


def test_long_conversations(spark, monkeypatch):
    """Conversations of many stretches of turns, with repeated, null and negative turn numbers, against plain lists."""
    monkeypatch.setattr(chat_snapshots, "STRETCH", 1)
    rng = np.random.default_rng(11)
    line = [(int(t), "user" if t % 2 else None, f"t{t % 5}") for t in range(-7, 40)]
    rows = [(c, *turn) for c, n in enumerate((1, 2, 9, 20, 20, 46, 47)) for turn in line[:n]]
    rows += [(50, t, r, x + "!" if t == 3 else x) for t, r, x in line[:30]] + [(51, None, "a", "b"), (51, None, "a", None), (51, 0, "a", "c")] + rows[:5]
    rng.shuffle(rows)
    rows = [(int(c), None if t is None else int(t), r, x) for c, t, r, x in rows]
    convs = {}
    for c in {r[0] for r in rows}:
        own = {r[1:] for r in rows if r[0] == c}
        convs[c] = [x[1:] for x in sorted(own, key=lambda x: [(v is not None, v if v is not None else 0) for v in x[:1]] + [(v is not None, v or "") for v in x[1:]])]
    got = chat_snapshots.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: (r.n_copies, r.n_turns) for r in got} == {i: (n, len(convs[i])) for i, n in brute.maximal(convs).items()}


def test_mixing(spark, sf, documents):
    got = {r.doc_id: r for r in rows(spark, sf, "op10_block_mixing")}
    again = {r.doc_id: r.taken for r in rows(spark, sf, "op10_block_mixing")}
    size = {d.doc_id: len(brute.WORD.findall(d.text or "")) for d in documents}
    assert {i: r.size for i, r in got.items()} == size and {i: r.taken for i, r in got.items()} == again
    by = defaultdict(int)
    for d in documents:
        by[d.source] += size[d.doc_id]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute.shares([by[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    taken = defaultdict(int)
    for d in documents:
        r = got[d.doc_id]
        assert r.source_size == by[d.source] and abs(r.target - target[d.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[d.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 200 for s in names)
