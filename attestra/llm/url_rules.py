"""URL filters by association rules.

Written rules (host and path prefixes) judge the pages they fit and label them
for learning: Spark's FP-growth mines which combinations of URL tokens go with
"block" or "allow" among those pages. Rules are pruned by support, by
confidence, and where a part of the combination does as well. Confidence is
taken over all pages that hold the combination, judged or not: a token that is
only known from where the written rules happen to reach, while most of its
pages lie elsewhere, proves nothing about those. What is left matches further
pages through an inverted index from token to rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: (verdict, host, path prefix) as written; a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE = 0.01, 0.75
#: Judged pages that a mined rule rests on, at least, however few there are.
LEAST_PAGES = 5
#: Mined rules that may be left after pruning by support and confidence among judged pages; their index goes to every task.
MOST_RULES = 50_000
DEFAULT = "allow"
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, rest = re.match(r"(?s)([^/?#]*)(.*)", url[at + 3 :]).groups()
    return host.translate(_UPPER), re.match(r"(?s)[^?#]*", rest).group()


def tokens(url: str | None) -> list[str]:
    """What a URL is made of: scheme, host labels, path segments by place, file endings, names of query fields.

    A segment of digits alone stands for any number. No host, no token.
    """
    host, path = parts(url)
    if not host:
        return []
    out = {f"scheme:{url[: url.find('://')].lower()}"}
    labels = host.split(":")[0].split(".")
    out |= {f"host:{x}" for x in labels[:-1]} | {f"top:{labels[-1]}"}
    for i, x in enumerate(p for p in path.split("/") if p):
        out.add(f"path{i}:{'#' if x.isdigit() else x}")
        if "." in x:
            out.add(f"ends:{x.rpartition('.')[2]}")
    query = re.search(r"\?([^#]*)", url)
    out |= {f"query:{x.partition('=')[0]}" for x in (query[1].split("&") if query else []) if x}
    return sorted(out)


def ruled(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest written rule that fits."""
    fits = [(len(h) + len(p), h, p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (lambda b: (b[1] + b[2], b[3]))(max(fits)) if fits else None


@dataclass
class Index:
    """Mined rules by number, and for each token the rules it is in."""

    rules: list[tuple[frozenset, str, float, float]]  # tokens, verdict, confidence, support

    def __post_init__(self):
        self.by_token: dict[str, list[int]] = {}
        for i, (items, *_) in enumerate(self.rules):
            for t in items:
                self.by_token.setdefault(t, []).append(i)

    def within(self, page) -> list[int]:
        """Rules whose tokens are all there."""
        hits: dict[int, int] = {}
        for t in page:
            for i in self.by_token.get(t, ()):
                hits[i] = hits.get(i, 0) + 1
        return [i for i, n in hits.items() if n == len(self.rules[i][0])]

    def best(self, page: list[str]) -> tuple[str, str, float] | None:
        """Tokens, verdict and confidence of the best rule whose tokens are all there."""
        full = self.within(page)
        if not full:
            return None
        i = max(full, key=lambda i: (self.rules[i][2], self.rules[i][3], len(self.rules[i][0]), sorted(self.rules[i][0])))
        return " & ".join(sorted(self.rules[i][0])), self.rules[i][1], self.rules[i][2]


def pruned(found: list[tuple[frozenset, str, float, float]]) -> list[tuple[frozenset, str, float, float]]:
    """Rules without a shorter one of the same verdict inside them that is as sure."""
    found = sorted(found, key=lambda r: (len(r[0]), sorted(r[0]), r[1]))
    index = Index(found)
    return [r for i, r in enumerate(found) if not any(j != i and found[j][1] == r[1] and found[j][2] >= r[2] for j in index.within(r[0]))]


def _parsed(rules):
    names = ["page_id", "host", "path", "rule", "verdict", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(1).to_pylist()
            where = [parts(u) for u in urls]
            hits = [ruled(*w, rules) or (None, None) for w in where]
            cols = [pa.array(c, pa.string()) for c in ([w[0] for w in where], [w[1] for w in where], [h[0] for h in hits], [h[1] for h in hits])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([tokens(u) for u in urls], pa.list_(pa.string()))], names=names)

    return run


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """Each page's host and path, the written rule that fits and its verdict (or null), and its tokens."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return rows.mapInArrow(_parsed(rules), "page_id long, host string, path string, rule string, verdict string, tokens array<string>")


def _held(shared):
    """How many rows hold the tokens of each rule; rows of rule number and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                for i in shared.value.within(page):
                    counts[i] = counts.get(i, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["rule_no", "n"])

    return run


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least_pages: int = LEAST_PAGES) -> Index:
    """Rules of ``rows(tokens, verdict)``: combinations that ``support`` of the judged rows, and ``least_pages``, hold with one verdict, and which have it in ``confidence`` of all rows that hold them.

    Tokens that always come together are mined as one, the first by name, so
    that they do not multiply the combinations. Frequent tokens are mean tokens
    a row over support at most; only they and the rules reach the driver.
    """
    spark = rows.sparkSession
    rows = rows.where(F.size("tokens") > 0).withColumn("_row", F.monotonically_increasing_id())
    judged = F.col("verdict").isNotNull()
    n = rows.where(judged).count()
    if not n:
        return Index([])
    support = min(1.0, max(support, least_pages / n))
    mark = [F.bit_xor(F.xxhash64("_row", F.lit(k))) for k in (1, 2)]
    each = rows.select("_row", judged.alias("judged"), F.explode("tokens").alias("token"))
    each = each.groupBy("token").agg(F.count("*").alias("m"), F.count_if("judged").alias("k"), *[c.alias(f"h{i}") for i, c in enumerate(mark)])
    often = [r[0] for r in each.where(F.col("k") >= support * n).groupBy("m", "h0", "h1").agg(F.min("token")).select("min(token)").collect()]
    if not often:
        return Index([])
    items = F.array_intersect("tokens", F.array(*[F.lit(t) for t in sorted(often)]))
    baskets = rows.where(judged).select(F.concat(items, F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets.withColumn("items", F.array_sort("items"))
    sets = stage(sets, "itemsets")
    said = F.filter("items", lambda t: t.startswith("verdict:"))
    with_verdict = sets.where((F.size(said) == 1) & (F.size("items") > 1)).select(F.array_except("items", said).alias("items"), F.get(said, F.lit(0)).alias("said"), F.col("freq").alias("both"))
    sure = with_verdict.join(sets.where(F.size(said) == 0), "items").where(F.col("both") >= confidence * F.col("freq"))
    found = [(frozenset(r["items"]), r["said"].partition(":")[2], r["both"], r["freq"]) for r in sure.limit(MOST_RULES + 1).collect()]
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; raise the support")
    # Rows that no written rule judges count against a rule: it has to hold where its tokens are, not where it was seen.
    shared = spark.sparkContext.broadcast(Index(found))
    others = dict(rows.where(~judged).select("tokens").mapInArrow(_held(shared), "rule_no int, n long").groupBy("rule_no").agg(F.sum("n")).collect())
    rules = [(items, verdict, both / (held + others.get(i, 0)), both / n) for i, (items, verdict, both, held) in enumerate(found)]
    return Index(pruned([r for r in rules if r[2] >= confidence]))


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c) for c in ("page_id", "host", "path", "rule")}
            best = [None if v else shared.value.best(t) for v, t in zip(b.column("verdict").to_pylist(), b.column("tokens").to_pylist(), strict=True)]
            verdict = [v or (m[1] if m else DEFAULT) for v, m in zip(b.column("verdict").to_pylist(), best, strict=True)]
            more = {"verdict": pa.array(verdict, pa.string()), "mined_rule": pa.array([m and m[0] for m in best], pa.string()), "confidence": pa.array([m and m[2] for m in best], pa.float64())}
            yield pa.RecordBatch.from_pydict(cols | more)

    return run


def judged(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """Verdict on each page's URL.

    Output, a row for each input row: ``page_id``, ``host``, ``path``, ``rule``
    (the written rule, or null), ``verdict`` (``allow`` or ``block``),
    ``mined_rule`` and ``confidence`` (of the mined rule that decided, or null).
    Written rules go first, the longest wins. Without one, the mined rule of the
    highest confidence, then support, then number of tokens, then tokens by name
    decides; without that, ``allow``. URLs that are null or hold no ``://`` have
    an empty host and path and no token; URLs are read whole, however long. Of
    tokens, ``tokens`` tells which there are. A null page_id is an ordinary
    value. Repeated rows have a row each; an empty table gives an empty result;
    other columns play no part. More than MOST_RULES rules are an error.
    """
    rows = stage(parsed(pages, rules), "urls")
    index = pages.sparkSession.sparkContext.broadcast(mine(rows, **options))
    return rows.mapInArrow(_judge(index), "page_id long, host string, path string, rule string, verdict string, mined_rule string, confidence double")
