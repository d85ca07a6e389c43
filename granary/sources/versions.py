"""Tables that grow by committed versions: what an unfinished or repeated write leaves behind is never read.

A folder holds `data/<folder>/<table>` and `commits/<version>`. A write puts its rows into a data folder of its own, reads
back how many there are, and then writes one row to `commits`; only data folders that a commit names are read. A commit may
take earlier folders out (compaction), and has the name of its batch, so that a batch that comes again changes nothing. Two
writers that take the same version number clash: the second one's commit is refused, and its rows are not read. On a store
whose writes don't appear at once, writers must take turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "version long, batch string, folder string, replaces array<string>, keys array<string>, numbers map<string, double>"


class Versions:
    """The commits of a folder, and the tables that they make up."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[Row]:
        """All commits in order, one row for each write."""
        try:
            rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(rows, key=lambda r: r["version"])

    def current(self) -> list[Row]:
        """The commits whose folders are read: those that no later one replaces."""
        commits = self.commits()
        gone = {f for c in commits for f in c["replaces"]}
        return [c for c in commits if c["folder"] not in gone]

    def read(self, table: str, schema: str | StructType, commits: list[Row] | None = None) -> DataFrame:
        """The rows of a table in all current commits, or in the given ones."""
        paths = [f"{self.path}/data/{c['folder']}/{table}" for c in (self.current() if commits is None else commits)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, tables: dict, batch: str | None = None, numbers: dict[str, float] | None = None, keys: list[str] = (), replaces: list[str] = (), expect: int | None = None, measure=None, options: dict | None = None) -> Row | None:
        """Writes the tables as one version; gives its commit, or None if the batch is there already.

        tables: rows by name, or functions that make them of the tables written before.
        expect: the rows that the first table must have, else ValueError, and nothing changes. measure: a function of the
        tables, as they were written, that gives more numbers.
        """
        commits = self.commits()
        if batch is not None and any(c["batch"] == batch for c in commits):
            return None
        folder, written = uuid.uuid4().hex, {}
        for name, df in tables.items():
            df = df(written) if callable(df) else df
            df.write.options(**(options or {})).parquet(f"{self.path}/data/{folder}/{name}")
            written[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{folder}/{name}")
        if expect is not None and (n := next(iter(written.values())).count()) != expect:
            raise ValueError(f"{n} rows were written in place of {expect}")
        numbers = {k: float(v) for k, v in {**(numbers or {}), **(measure(written) if measure else {})}.items()}
        version = commits[-1]["version"] + 1 if commits else 1
        row = (version, batch, folder, list(replaces), list(keys), numbers)
        self.spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("error").parquet(f"{self.path}/commits/{version:012d}")
        return next(c for c in self.commits() if c["version"] == version)


#: The column that tells rows of equal content.
DIGEST = "_digest"


class Collection:
    """Rows that are kept between runs, each content once; adding rows that are there changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.versions, self.schema = Versions(spark, path), schema

    def rows(self) -> DataFrame:
        return self._stored().drop(DIGEST)

    def _stored(self) -> DataFrame:
        return self.versions.read("rows", f"{self.schema}, {DIGEST} string")

    def count(self) -> int:
        """Rows of all commits, from the commits."""
        return int(sum(c["numbers"]["rows"] for c in self.versions.current()))

    def add(self, df: DataFrame, batch_rows: int | None = None) -> int:
        """Adds the rows that aren't there yet, in commits of about batch_rows each, and gives their number.

        If a batch fails, earlier ones stay and the failing one leaves nothing; the same call again adds the rest.
        """
        if batch_rows is not None and batch_rows <= 0:
            raise ValueError(f"batches of {batch_rows} rows")
        names = [f.name for f in self.versions.spark.createDataFrame([], self.schema).schema]
        new = df.select(*names).withColumn(DIGEST, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)).dropDuplicates([DIGEST])
        new = new.join(self._stored().select(DIGEST), DIGEST, "left_anti").select(*names, DIGEST)
        n = new.count()
        parts = -(-n // batch_rows) if batch_rows else 1
        added = 0
        for i in range(parts if n else 0):
            part = new.where(F.pmod(F.xxhash64(DIGEST), F.lit(parts)) == i)
            size = part.count()
            if size:
                self.versions.add({"rows": part}, expect=size, numbers={"rows": size})
                added += size
        return added

    def page(self, size: int, key: list[str], after: tuple | None = None) -> DataFrame:
        """The next rows in order of the key, which no two rows share and is never null; after: the key of the last row seen."""
        rows = self.rows()
        if after is not None:
            later = F.lit(False)
            for i in range(len(key)):
                same = F.lit(True)
                for k, v in zip(key[:i], after[:i], strict=True):
                    same = same & (F.col(k) == F.lit(v))
                later = later | (same & (F.col(key[i]) > F.lit(after[i])))
            rows = rows.where(later)
        return rows.orderBy(*key).limit(size)

    def pages(self, size: int, key: list[str]) -> Iterator[list[Row]]:
        """All rows, page by page; a page is in memory at a time."""
        after = None
        while got := self.page(size, key, after).collect():
            yield got
            after = tuple(got[-1][k] for k in key)


class Results:
    """Result rows by pipeline; a run replaces those of its pipelines, all in one commit, and leaves the others untouched."""

    def __init__(self, spark: SparkSession, path: str, schema: str, pipeline: str = "pipeline"):
        self.versions, self.schema, self.pipeline = Versions(spark, path), schema, pipeline

    def replace(self, rows: DataFrame, pipelines: list[str], batch: str | None = None) -> None:
        """rows take the place of all rows of these pipelines; a pipeline without rows is empty from then on."""
        own = rows.where(F.col(self.pipeline).isin(list(pipelines)))
        self.versions.add({"rows": own}, batch=batch, keys=list(pipelines))

    def rows(self) -> DataFrame:
        """The latest rows of every pipeline."""
        commits = self.versions.current()
        latest = {p: c["folder"] for c in commits for p in c["keys"]}  # as many as there are pipelines
        out = self.versions.spark.createDataFrame([], self.schema)
        for c in commits:
            own = [p for p, folder in latest.items() if folder == c["folder"]]
            if own:
                out = out.unionByName(self.versions.read("rows", self.schema, [c]).where(F.col(self.pipeline).isin(own)))
        return out
