"""Loading into Parquet tables: upserts, stale rows, guards, run log, caches of computed vectors.

A Parquet table has no transactions: a new version is written beside the old
one, checked, and only then becomes current by a small pointer file.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source replace those of the target with the same keys; null keys match each other."""
    condition = None
    s, t = source.select(*keys).distinct().alias("s"), target.alias("t")
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        condition = c if condition is None else condition & c
    return t.join(s, condition, "left_anti").unionByName(source, allowMissingColumns=True)


def upsert_coalesced(target: DataFrame, source: DataFrame, key: str, keep_old: list[str]) -> DataFrame:
    """Upsert in which a null of the source keeps the old value, and the columns ``keep_old`` keep theirs once set."""
    a, b = target.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in target.columns if c != key]), source.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in target.columns if c != key])
    order = lambda c: (f"o_{c}", f"n_{c}") if c in keep_old else (f"n_{c}", f"o_{c}")
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(*order(c)).alias(c) for c in target.columns if c != key])


def without_stale_children(target: DataFrame, source: DataFrame, parent: str, child: str) -> DataFrame:
    """Children of the parents in the source that the source no longer has are left out; other parents' stay."""
    stale = target.join(source.select(parent).distinct(), parent, "left_semi").join(source.select(child).distinct(), child, "left_anti").select(child).distinct()
    return target.join(stale, child, "left_anti")


def cascade(children: DataFrame, deleted: DataFrame, parent: str) -> DataFrame:
    """Children without those of deleted parents."""
    return children.join(deleted.select(parent).distinct(), parent, "left_anti")


def backfilled(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``value`` where the column is null or blank."""
    return df.withColumn(column, F.when(F.trim(F.coalesce(column, F.lit(""))) == "", value).otherwise(F.col(column)))


def overlay(df: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """Manual overrides of a column win."""
    given = overrides.select(key, F.col(column).alias("__given"))
    return df.join(given, key, "left").withColumn(column, F.coalesce("__given", column)).drop("__given")


def unrelated_counts(before: DataFrame, after: DataFrame, scope: Column) -> DataFrame:
    """Rows outside the scope before and after a load; ``safe`` if they are as many."""
    a, b = before.where(~F.coalesce(scope, F.lit(False))).agg(F.count("*").alias("before")), after.where(~F.coalesce(scope, F.lit(False))).agg(F.count("*").alias("after"))
    return a.join(F.broadcast(b)).withColumn("safe", F.col("before") == F.col("after"))


def cached_vectors(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inputs that have a vector, inputs that need one, and cached vectors that no input has any more.

    A vector is reused if chunk, content hash and hash of the embedded text agree.
    """
    keys = ["chunk_id", "content_hash", "input_hash"]
    reused = inputs.join(cache.select(*keys, "embedding"), keys)
    return reused, inputs.join(cache.select(*keys), keys, "left_anti"), cache.join(inputs.select(*keys), keys, "left_anti")


def change_log(known: DataFrame, listed: DataFrame) -> DataFrame:
    """What a listing changes in an inventory: new, renamed and content_changed, several for one URL if so.

    Content counts as changed if its length is known now and length, instant or tag differ, a null
    differing from a value.
    """
    fields = ["title", "content_length", "last_modified", "etag"]
    a = known.select("pdf_url", F.lit(True).alias("is_known"), *[F.col(c).alias(f"old_{c}") for c in fields])
    joined = listed.select("pdf_url", *fields).join(a, "pdf_url", "left")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    kinds = F.array(
        F.when(F.col("is_known").isNull(), "new"),
        F.when(F.col("is_known") & differs("title"), "renamed"),
        F.when(F.col("is_known") & F.col("content_length").isNotNull() & (differs("content_length") | differs("last_modified") | differs("etag")), "content_changed"),
    )
    return joined.select("pdf_url", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change_type"))


class Table:
    """A Parquet table with numbered versions in a folder that all executors share.

    A version counts as soon as its empty file ``current/n`` is there; the
    highest one is read, so there is no moment without a version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        """The names of the written versions, the oldest first; a name is a number and a random part."""
        fs, path = self._files()
        folder = path(f"{self.path}/current")
        return sorted((f.getPath().getName() for f in fs.listStatus(folder)), key=lambda n: int(n.split("-")[0])) if fs.exists(folder) else []

    def current(self) -> str | None:
        return next(reversed(self.versions()), None)

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def replace(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None, partition_by: list[str] | None = None) -> DataFrame:
        """Writes a new version, checks what was written, and makes it current; a failed check leaves the old one."""
        last = self.current()
        version = f"{int(last.split('-')[0]) + 1 if last else 1}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{version}")
        written = self.spark.read.parquet(f"{self.path}/{version}")
        if check is not None:
            check(written)
        fs, path = self._files()
        fs.create(path(f"{self.path}/current/{version}"), False).close()
        return written

    def append(self, df: DataFrame) -> None:
        """Adds rows to the current version, or begins one."""
        version = self.current()
        if version is None:
            self.replace(df)
        else:
            df.write.mode("append").parquet(f"{self.path}/{version}")


class Runs:
    """The log of loading runs: a row for each change of a run's state; the last one counts."""

    SCHEMA = "run_id string, status string, rows long, at timestamp"

    def __init__(self, table: Table):
        self.table = table

    def note(self, run_id: str, status: str, rows: int | None = None) -> None:
        spark = self.table.spark
        self.table.append(spark.createDataFrame([(run_id, status, rows)], "run_id string, status string, rows long").withColumn("at", F.current_timestamp()))

    def run(self, run_id: str, load: Callable[[], DataFrame]) -> DataFrame:
        """What ``load`` gives, noted as loading before and completed, with its rows, afterwards; or as failed."""
        self.note(run_id, "loading")
        try:
            loaded = load()
            self.note(run_id, "completed", loaded.count())
            return loaded
        except Exception:
            self.note(run_id, "failed")
            raise

    def states(self) -> DataFrame:
        """Each run with its last status."""
        rank = F.when(F.col("status") == "loading", 0).otherwise(1)
        return self.table.read().groupBy("run_id").agg(F.max_by(F.struct("status", "rows"), F.struct("at", rank)).alias("x")).select("run_id", "x.*")


def status_summaries(df: DataFrame, status: str, labels: Column, summary: str = "summary") -> DataFrame:
    """The table with its summary set from a status where it has none."""
    return df.withColumn(summary, F.coalesce(F.nullif(F.trim(F.col(summary)), F.lit("")), labels))


def inserted_once(target: DataFrame, source: DataFrame, key: str, flag: str) -> DataFrame:
    """Insert-ignore with one exception: a known row whose ``flag`` isn't set takes over a set one; all else stays."""
    new = source.groupBy(key).agg(*[F.max(x).alias(x) for x in source.columns if x != key])
    given = new.select(F.col(key), F.col(flag).alias("__flag"))
    kept = target.join(given, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("__flag", F.lit(False))).drop("__flag")
    return kept.unionByName(new.join(target.select(key), key, "left_anti"))


def backfill_steps(df: DataFrame, column: str, value: Column, key: str, size: int) -> DataFrame:
    """One resumable step of a backfill: the first ``size`` rows by key that lack the column are filled; it is done when a step changes none."""
    lacking = df.where(F.trim(F.coalesce(column, F.lit(""))) == "").orderBy(key).limit(size).select(key, F.lit(True).alias("__now"))
    return df.join(lacking, key, "left").withColumn(column, F.when(F.col("__now"), value).otherwise(F.col(column))).drop("__now")


def ensure_table(spark: SparkSession, name: str, schema: str, path: str) -> None:
    """Creates the table if it isn't there, and adds columns that it lacks; done twice it changes nothing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet LOCATION '{path}'")
    have = {c.lower() for c in spark.table(name).columns}
    missing = [c.strip() for c in schema.split(",") if c.split()[0].lower() not in have]
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(missing)})")


def analyzed(spark: SparkSession, name: str) -> DataFrame:
    """Computes the statistics of a table and gives its rows and bytes."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Statistics'")
    return found.select(F.lit(name).alias("name"), F.regexp_extract("data_type", r"(\d+) rows", 1).cast("long").alias("rows"))
