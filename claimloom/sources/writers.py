"""Writers: content-addressed bodies, public records, audits, checksums, and snapshots of a store."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses that may be published, and what an open retry becomes.
PUBLIC_STATUSES = (
    "SELECTED",
    "DUPLICATE_URL",
    "DUPLICATE_BODY",
    "ELIGIBLE_NOT_SELECTED",
    "EXCLUDED_DATE",
    "EXCLUDED_LANGUAGE",
    "EXCLUDED_RELEVANCE",
    "BLOCKED_ROBOTS",
    "FAILED_HTTP",
    "FAILED_EXTRACTION",
)


def found(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame | None:
    """The table at path, or None where there is nothing yet."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def save_bodies(bodies: DataFrame, path: str) -> None:
    """Append bodies(body) that aren't there yet, by the SHA-256 of their text, in folders of its first two digits. Null bodies are left out."""
    new = bodies.where("body IS NOT NULL").select(F.sha2(F.col("body").cast("binary"), 256).alias("sha"), "body").dropDuplicates(["sha"]).withColumn("shard", F.substring("sha", 1, 2))
    old = found(bodies.sparkSession, path)
    if old is not None:
        new = new.join(old.select("sha"), "sha", "left_anti")
    new.write.mode("append").option("compression", "gzip").partitionBy("shard").parquet(path)


def public_records(records: DataFrame, fields: list[str], key: str) -> DataFrame:
    """The public columns in order of key. An open retry is a failure; an unknown status fails the write."""
    status = F.when(F.col("status") == "RETRY_PENDING", "FAILED_HTTP").when(F.col("status").isin(*PUBLIC_STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.coalesce("status", F.lit("null")))))
    return records.withColumn("status", status).select(*fields).orderBy(key)


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, in order over the part files."""
    records.write.mode("overwrite").json(path)


def write_audit(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header; quotes within values are doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_audit, all columns as text; an empty cell is an empty text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of the files in a folder, by name: what a published collection is checked against. Files are hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("name")


def manifest_problems(written: DataFrame, found_now: DataFrame) -> DataFrame:
    """(name, problem): files of a manifest that are missing or changed, and files that it doesn't name."""
    a, b = written.select("name", F.col("sha256").alias("was")), found_now.select("name", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unexpected").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "name", "full").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def snapshot_id(rows: DataFrame) -> str:
    """First 16 digits of a SHA-256 of the rows in any order: of the sum of their hashes, so no task gathers them."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = rows.agg(F.sum(h).alias("h"), F.count("*").alias("n")).select(F.sha2(F.concat_ws(":", F.col("h").cast("string"), F.col("n").cast("string")), 256)).first()[0]
    return total[:16]


def collection_metadata(rows: DataFrame, key: str) -> str:
    r = rows.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("unique")).first()
    return json.dumps({"rows": r["rows"], "unique": r["unique"], "duplicates_merged": r["rows"] - r["unique"]}, sort_keys=True)


COMMITS = "n bigint, source string, batch bigint, tables map<string, array<string>>"


class Store:
    """Tables as immutable folders, and a log of commits, each of which is one row in one file.

    A commit names, for each table, the folders that make it up. `commit` writes all tables
    anew; `append` writes only new and changed rows, which replace older ones of their id when the
    table is read; `compact` merges folders. The file of the commit is written last and moved into
    place in one step, so a writer that fails before leaves the tables as they were, and readers
    see all of a commit or nothing of it. Readers keep the version that they opened. One writer
    at a time.

    A source's batch number makes a commit happen once: a batch that is in the log is skipped.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> DataFrame | None:
        return found(self.spark, f"{self.path}/commits", COMMITS, "json")

    def _last(self) -> dict | None:
        log = self._commits()
        row = None if log is None else log.orderBy(F.desc("n")).first()
        return None if row is None else row.asDict()

    def version(self) -> int | None:
        last = self._last()
        return None if last is None else last["n"]

    def has(self, source: str, batch: int) -> bool:
        """Whether a source's batch has been committed."""
        log = self._commits()
        return log is not None and not log.where((F.col("source") == source) & (F.col("batch") == batch)).isEmpty()

    def table(self, name: str, version: int | None = None) -> DataFrame:
        log = self._commits()
        row = None if log is None else (log if version is None else log.where(F.col("n") == version)).orderBy(F.desc("n")).first()
        if row is None:
            raise ValueError("the store is empty" if version is None else f"no version {version}")
        return self._read(row["tables"][name])

    def _read(self, folders: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in folders]
        if len(parts) == 1:
            return parts[0]
        columns = parts[0].columns
        every = reduce(DataFrame.unionByName, [p.withColumn("written", F.lit(k)) for k, p in enumerate(parts)])
        return every.groupBy("id").agg(F.max_by(F.struct(*columns), "written").alias("r")).select("r.*")

    def _log(self, tables: dict[str, list[str]], source: str | None, batch: int | None) -> int:
        n = (self.version() or 0) + 1
        self.spark.createDataFrame([(n, source, batch, tables)], COMMITS).coalesce(1).write.mode("append").json(f"{self.path}/commits")
        return n

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, list[str]]:
        folder = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        return {name: [f"{folder}/{name}"] for name in tables}

    def commit(self, tables: dict[str, DataFrame], source: str | None = None, batch: int | None = None) -> int:
        """Replace all tables; returns the version. A batch that the source has committed before changes nothing."""
        if source is not None and self.has(source, batch):
            return self.version()
        return self._log(self._write(tables), source, batch)

    def append(self, changes: dict[str, DataFrame], source: str | None = None, batch: int | None = None) -> int:
        """Add changes(id, ...) to the tables; tables that changes doesn't name stay. The first append makes the tables."""
        if source is not None and self.has(source, batch):
            return self.version()
        old = (self._last() or {"tables": {}})["tables"]
        new = self._write(changes)
        return self._log(old | {name: [*old.get(name, []), *folders] for name, folders in new.items()}, source, batch)

    def compact(self) -> int:
        """Write each table that is made up of several folders as one."""
        old = self._last()["tables"]
        several = {name: self._read(folders) for name, folders in old.items() if len(folders) > 1}
        return self._log(old | self._write(several), None, None)
