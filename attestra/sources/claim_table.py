"""A table of claims that is written by commits and read as of one.

Claims are kept as Parquet by parts, a part being one of a month's buckets by
name. An upsert rewrites the parts that its claims fall in and no others, and
ends by creating the manifest of the next version, a small file that says where
every part lies. Who reads sees one version as a whole. Who finds the version
taken by another writer takes what that one wrote as older, and tries again; if
both touched different parts, nothing is written twice. A version exists from
the moment its manifest is complete, so what a lost writer leaves is never read:
others wait for a manifest that is being written, and remove one that nobody has
finished for a minute; its writer, should it still be there, then sees that the
version is not its own.

The file system has to create a file exclusively (HDFS and local ones do).
"""

from __future__ import annotations

import datetime
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import METADATA, exists, folder_name

FIELDS = [c.split()[0] for c in METADATA.split(", ")] + ["ocr_result"]
SCHEMA = f"{METADATA}, ocr_result string, folder string"
AMOUNTS = ("claimed_amount", "verified_amount")
#: Parts of a month. A part is rewritten by one task: some 100 MB of claims are a good size.
BUCKETS = 16
ATTEMPTS = 50
#: Milliseconds after which an unfinished manifest counts as left behind.
PATIENCE = 60_000


class Taken(Exception):
    """Another writer has made this version."""


class ClaimTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """``buckets`` counts for a table that is not there yet; one that is keeps its own."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._hadoop.Path(path)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def _named(self) -> list[int]:
        where = self._at(f"{self.path}/commits")
        return sorted(int(f.getPath().getName()[:-5]) for f in self._files.listStatus(where) if f.getPath().getName().endswith(".json")) if self._files.exists(where) else []

    def _read(self, version: int) -> dict | None:
        """A manifest, or nothing if its writer has not finished it."""
        with_text = self._files.open(self._at(self._manifest(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8")
        finally:
            with_text.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def versions(self) -> list[int]:
        return [v for v in self._named() if self._read(v) is not None]

    def state(self, version: int | None = None) -> dict:
        """The manifest of a version, the last one unless named; an empty one for a table that is not there."""
        if version is not None:
            found = self._read(version) if version in self._named() else None
            if found is None:
                raise ValueError(f"no version {version} in {self.path}")
            return found
        for v in reversed(self._named()):
            if (found := self._read(v)) is not None:
                return found
        return {"version": 0, "buckets": self.buckets, "parts": {}}

    def read(self, version: int | None = None, months: list[str] | None = None) -> DataFrame:
        """Claims as of a version, ``folder`` being the name that a claim is known by; of ``months`` alone the parts of these are read."""
        parts = self.state(version)["parts"].values()
        return self._parts([p for p in parts if months is None or p["month"] in months])

    def _parts(self, parts: list[dict]) -> DataFrame:
        places = [f"{self.path}/data/{p['place']}" for p in parts]
        return self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)

    def _commit(self, version: int, manifest: dict) -> None:
        own = uuid.uuid4().hex
        try:
            out = self._files.create(self._at(self._manifest(version)), False)
        except Exception as e:
            if self._files.exists(self._at(self._manifest(version))):
                raise Taken from e
            raise
        out.write(json.dumps(manifest | {"writer": own}).encode())
        out.close()
        if version not in self._named() or (self._read(version) or {}).get("writer") != own:
            raise Taken

    def _unfinished(self, after: int) -> bool:
        """Whether a version later than ``after`` is being written; what was left behind goes."""
        for v in self._named():
            if v > after and self._read(v) is None:
                where = self._at(self._manifest(v))
                if self.spark.sparkContext._jvm.System.currentTimeMillis() - self._files.getFileStatus(where).getModificationTime() < PATIENCE:
                    return True
                self._files.delete(where, False)
        return False

    def upsert(self, claims: DataFrame, now: str | None = None, last: list[Column] | None = None, fill: bool = False) -> int:
        """Put claims in, each instead of the one of the same month and folder name, and return the version made.

        ``updated_at`` is ``now``, the present time unless given. Of several
        claims of one month and name in ``claims`` the last by ``last``, then by
        all fields, is put in. With ``fill`` a null field keeps what the table
        has; otherwise records are replaced whole. Amounts are kept as text with
        two decimals, halves to even; missing fields are null, other columns are
        left out; a null month is an empty one, a null name an empty one. No
        claims make no version.
        """
        now = now or datetime.datetime.now().isoformat()
        text = lambda c: F.bround(F.col(c).try_cast("decimal(20,6)"), 2).cast("string")
        have = set(claims.columns)
        put = {c: (text(c) if c in AMOUNTS else F.col(c).cast("string")) if c in have else F.lit(None).cast("string") for c in FIELDS}
        put |= {"month_year": F.coalesce(put["month_year"], F.lit("")), "individual_name": F.coalesce(F.trim(put["individual_name"]), F.lit("")), "updated_at": F.lit(now)}
        rows = claims.select(F.struct(*(last or [F.lit(0)])).alias("last"), F.struct(*[put[c].alias(c) for c in FIELDS]).alias("claim"))
        rows = rows.groupBy(F.col("claim.month_year").alias("month"), folder_name(F.col("claim.individual_name")).alias("folder")).agg(F.max(F.struct("last", "claim"))["claim"].alias("claim"))
        staged = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select("claim.*", "folder").write.parquet(staged)
        new = self.spark.read.schema(SCHEMA).parquet(staged)
        done: dict[str, dict] = {}
        base = None
        try:
            for _ in range(ATTEMPTS):
                state = self.state()
                while self._unfinished(state["version"]):
                    time.sleep(0.2)
                    state = self.state()
                parts = state["parts"]
                # Parts that were merged with what still stands need no second merge.
                left = None if base is None else {k for k in done if parts.get(k) != base.get(k)}
                base = parts
                done |= self._merged(new, state, left, fill)
                if not done:
                    return state["version"]
                version = state["version"] + 1
                try:
                    self._commit(version, {"version": version, "at": now, "buckets": state["buckets"], "parts": parts | done})
                    return version
                except Taken:
                    pass
        finally:
            self._files.delete(self._at(staged), True)
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def _merged(self, new: DataFrame, state: dict, left: set[str] | None, fill: bool) -> dict[str, dict]:
        """Write the parts that ``new`` touches (of these only ``left``), over what ``state`` holds, and say where they are."""
        if left is not None and not left:
            return {}
        month, bucket = F.col("month_year"), F.pmod(F.xxhash64("folder"), F.lit(state["buckets"])).cast("string")
        part = F.concat(F.substring(F.sha2(month, 256), 1, 16), F.lit("-"), bucket)
        new = new.withColumn("part", part)
        # As many rows as parts are touched: months times buckets at most.
        touched = {r["part"]: r["month_year"] for r in new.select("part", "month_year").distinct().collect() if left is None or r["part"] in left}
        if not touched:
            return {}
        if left is not None:
            new = new.where(F.col("part").isin(sorted(left)))
        old = self._parts([state["parts"][k] for k in sorted(touched) if k in state["parts"]]).withColumn("part", part)
        both = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
        one = lambda c: F.max(F.struct("new", F.struct(*FIELDS).alias("claim")))["claim"][c] if not fill else F.coalesce(F.max(F.when(F.col("new") == 1, F.col(c))), F.max(F.when(F.col("new") == 0, F.col(c))))
        rows = both.repartition("part").groupBy("part", "month_year", "folder").agg(*[one(c).alias(c) for c in FIELDS if c != "month_year"])
        place = uuid.uuid4().hex
        rows.write.partitionBy("part").parquet(f"{self.path}/data/{place}")
        return {k: {"month": m, "place": f"{place}/part={k}"} for k, m in touched.items()}

    def clean(self, keep: int = 1, older: int = 3_600_000) -> int:
        """Drop all but the last ``keep`` versions, and folders of data that none of those names and that are ``older`` milliseconds; how many folders went. Who reads an older version meanwhile loses it."""
        stay = self.versions()[-keep:]
        places = {p["place"].split("/")[0] for v in stay for p in self._read(v)["parts"].values()}
        for v in self._named():
            if stay and v < stay[0]:
                self._files.delete(self._at(self._manifest(v)), False)
        data, n, now = self._at(f"{self.path}/data"), 0, self.spark.sparkContext._jvm.System.currentTimeMillis()
        for f in self._files.listStatus(data) if exists(self.spark, f"{self.path}/data") else []:
            if f.getPath().getName() not in places and f.getModificationTime() <= now - older:
                n += bool(self._files.delete(f.getPath(), True))
        return n
