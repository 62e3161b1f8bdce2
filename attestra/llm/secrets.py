"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every text by pattern. Their values are then counted
over the whole corpus by distinct repositories and distinct owners: a value
that many owners or many repositories carry was copied from documentation, a
tutorial or a template, one that a single owner has in few repositories and that
looks random is likely live. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

# The patterns, in the order in which equal starts are listed.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BARE = r"[A-Za-z0-9+/_-]+"
#: (kind, pattern that finds it, shortest value, group of the value). Runs of one class are found at their full length at once.
KINDS = (("assign", ASSIGN, 8, 2), ("access", r"AKIA[A-Z0-9]{12,}", 16, 0), ("hex", r"[0-9a-f]{32,}", 32, 0), ("bare", r"[A-Za-z0-9+/_-]{24,}", 24, 0))
BASE = 3
#: Matches that are added up in one fold.
STRETCH = 512
#: Owners, or repositories, from which on a value counts as copied; words that mark a stand-in.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
STAND_IN = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there, also within other functions."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(sizes: Column) -> Column:
    """Running sums of an array, by stretches: a fold copies what it has, so that one over all would take the square of the length."""
    none = F.array().cast("array<bigint>")

    def folded(values: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + x)).alias("sums"))

        return F.aggregate(values, F.struct(F.lit(0).cast("long").alias("at"), none.alias("sums")), step, lambda acc: acc["sums"])

    def by_stretches(all_sizes: Column) -> Column:
        parts = F.when(F.size(all_sizes) > 0, F.sequence(F.lit(0), F.floor((F.size(all_sizes) - 1) / STRETCH).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(parts, lambda k: folded(F.slice(all_sizes, k * STRETCH + 1, F.lit(STRETCH))))

    last = lambda c: F.get(c, F.size(c) - 1)
    joined = lambda inner: F.flatten(F.zip_with(inner, folded(F.transform(inner, last)), lambda c, top: F.transform(c, lambda x: x + top - last(c))))
    return _let(sizes, lambda all_sizes: _let(by_stretches(all_sizes), joined))


def _found(text: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches as array of (start, kind, end, value), by code points.

    What lies between matches and the matches themselves alternate, so an end
    is the length of all that stands before it.
    """
    _, pattern, least, group = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(match: Column, value: Column) -> Column:
        sizes = F.zip_with(match, F.slice(gaps, F.lit(1), F.size(match)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        span = lambda end: lambda m, i: F.struct((F.get(end, i) - F.length(m)).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(end, i).cast("int").alias("end"), F.get(value, i).alias("value"))
        return F.filter(_let(_running(sizes), lambda end: F.transform(match, span(end))), lambda s: F.length(s["value"]) >= least)

    found = _let(matches, lambda m: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: spans(m, v)) if group else spans(m, m))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def live_looking(value: Column) -> Column:
    """Letters and digits, ten different characters or more, no stand-in word."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10) & ~value.rlike(STAND_IN)


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Spans of secrets in every text of ``docs``, told apart by who else has the value.

    Output, a row for each input row: ``doc_id``; ``n_assign``, ``n_access``,
    ``n_hex``; ``base_sha256`` of the base spans and ``spans``, as
    ``kind:start:end`` by start, then kind; ``n_copied`` spans whose value
    ``copied_owners`` or more owners, or ``copied_repositories`` or more
    repositories, have; ``n_live`` spans that look random and whose value one owner
    alone has, in fewer repositories than that; ``most_repositories``, the largest
    number of repositories that one of the row's values is in. An owner is a
    ``source`` and a repository a document of it unless other columns are named:
    a corpus that knows its repositories should name them. Spans of kind ``bare`` (no name and no known form
    give them away, and they overlap no other span) are added only if live.

    Null text is an empty one; null owners and repositories count as one value.
    Repeated rows have a row each and count once. An empty table gives an empty
    result; other columns play no part.
    """
    text = F.coalesce("text", F.lit(""))
    names = F.struct(F.col(owner).cast("string")), F.struct(F.col(repository).cast("string"))
    base = reduce(F.concat, [_found(text, k) for k in range(BASE)])
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(*names[:1]).alias("owner"), F.xxhash64(*names).alias("repository"), base.alias("spans"), _found(text, BASE).alias("bare"))
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash"), live_looking(s["value"]).alias("live")))
    rows = stage(rows.select("doc_id", "owner", "repository", hashed("spans").alias("spans"), F.filter(hashed("bare"), lambda s: s["live"]).alias("bare")).withColumn("row", F.monotonically_increasing_id()), "candidates")

    each = rows.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("span"))
    # Bare spans beside others: none of those before may reach into it, none of those behind may begin in it.
    beside = rows.where(F.size("bare") > 0).select("row", "owner", "repository", F.explode(F.concat("spans", "bare")).alias("span"))
    up, down = (Window.partitionBy("row").orderBy(*c).rowsBetween(Window.unboundedPreceding, Window.currentRow) for c in (("span.start", "span.kind"), (F.col("span.start").desc(), F.col("span.kind").desc())))
    own = F.col("span.kind") < BASE
    reached, begun = F.max(F.when(own, F.col("span.end"))).over(up), F.min(F.when(own, F.col("span.start"))).over(down)
    apart = beside.withColumn("clear", (F.coalesce(reached, F.lit(-1)) <= F.col("span.start")) & (F.coalesce(begun, F.lit(1 << 31)) >= F.col("span.end"))).where(~own & F.col("clear")).drop("clear")
    each = each.unionByName(apart).withColumn("hash", F.col("span.hash"))
    # By value, owner and repository, then by value and owner, then by value: each step is combined before it is shuffled.
    spread = each.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("r"))
    spread = spread.groupBy("hash").agg(F.sum("r").alias("repositories"), F.count("*").alias("owners"))
    judged = each.join(spread, "hash")
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    live = F.col("span.live") & (F.col("owners") == 1) & ~copied
    judged = judged.where((F.col("span.kind") < BASE) | live)
    found = judged.groupBy("row").agg(
        F.collect_list(F.struct("span.start", "span.kind", "span.end")).alias("kept"),
        F.count_if(copied).alias("n_copied"),
        F.count_if(live).alias("n_live"),
        F.max("repositories").alias("most_repositories"),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    basic = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    zero = F.lit(0).cast("long")
    return rows.join(found, "row", "left").select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(_written(basic), 256).alias("base_sha256"),
        _written(F.coalesce("kept", none)).alias("spans"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_copied", "n_live", "most_repositories")],
    )
