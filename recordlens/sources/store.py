"""Raw artifacts, staged tables, promotion, schema fingerprints and the health log.

Tables live below one base folder. A run writes each staged table to a new folder; promotion is
one appended row per table in the promotion log, so readers see either the old tables or all the
new ones, and a failed run leaves production as it was.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordlens.operators.ordered import pick_row, with_previous
from recordlens.session import read_if_there
from recordlens.sources import feeds

STATUS = ["OK", "OK_WITH_WARNINGS", "SOURCE_UNAVAILABLE", "SCHEMA_CHANGED", "ZERO_ROWS",
          "VALIDATION_FAILED", "BLOCKED", "PARTIAL"]


def artifact_dedupe(files: DataFrame, order: list[str], chunk) -> DataFrame:
    """Each file version with its hash and whether it repeats the version before it.

    A repeated version is not stored, and the stored one has the same hash; so comparing with the
    version before equals comparing with the latest stored one.
    """
    hashed = files.withColumn("sha256", F.sha2(F.col("content"), 256)).drop("content")
    f = with_previous(hashed, ["name"], order, ["sha256"], chunk)
    return f.withColumn("duplicate", F.coalesce(
        F.col("prev.sha256") == F.col("sha256"), F.lit(False))).drop("prev")


def latest_artifacts(files: DataFrame, order: list[str]) -> DataFrame:
    """Latest version per name (only this one is transformed, older copies are not read again)."""
    return pick_row(files, ["name"], order, last=True)


LOG = "run long, source string, table string, path string, columns array<string>, rows long"


class TableStore:
    """Staging, promotion and schema fingerprints below a base folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def stage(self, source: str, table: str, df: DataFrame) -> dict:
        path = f"{self.base}/staging/{source}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        rows = self.spark.read.parquet(path).count()  # answered from the file footers
        return {"source": source, "table": table, "path": path, "columns": df.columns, "rows": rows}

    def read_staged(self, staged: dict) -> DataFrame:
        return self.spark.read.parquet(staged["path"])

    def promotions(self) -> DataFrame | None:
        """The promotion log: run, source, table, path, columns, rows; None before the first promotion."""
        return read_if_there(self.spark, f"{self.base}/promotions", schema=LOG, recursive=True)

    def schema_changes(self, staged: list[dict]) -> list[dict]:
        """Staged tables whose ordered columns differ from those promoted last."""
        log = self.promotions()
        if log is None:
            return []
        known = {r["table"]: r["columns"] for r in  # one row per table
                 pick_row(log, ["table"], ["run"], last=True).select("table", "columns").collect()}
        return [{"table": s["table"], "previous": known[s["table"]], "current": s["columns"]}
                for s in staged if s["table"] in known and known[s["table"]] != s["columns"]]

    def _next_run(self) -> int:
        log = self.promotions()
        return 1 if log is None else (log.agg(F.max("run")).first()[0] or 0) + 1

    def _claim(self, run: int) -> bool:
        """Takes a run number by creating its file, which only one run can do."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.base}/claims/{run:012d}")
        fs = place.getFileSystem(conf)
        fs.mkdirs(place.getParent())
        if fs.getUri().getScheme() == "file":  # whose create looks first and creates then, so two runs could succeed
            return jvm.java.io.File(place.toUri().getPath()).createNewFile()
        try:
            fs.create(place, False).close()
            return True
        except Py4JJavaError:
            if fs.exists(place):
                return False
            raise

    def promote(self, staged: list[dict]) -> list[str]:
        """Appends the staged tables to the log under a run number of their own.

        Runs that promote at the same time take different numbers, and readers follow the greatest. A run that
        stops between claim and append leaves a gap in the numbers and nothing else. The claim is as exclusive as
        the file system's create without overwrite.
        """
        run = self._next_run()
        while not self._claim(run):
            run += 1
        rows = [(run, s["source"], s["table"], s["path"], s["columns"], s["rows"]) for s in staged]
        # a folder of its own: appends to one folder share its temporary part, which the first to finish removes
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{self.base}/promotions/{run:012d}")
        return [s["table"] for s in staged]

    def production(self, table: str) -> DataFrame | None:
        log = self.promotions()
        if log is None:
            return None
        hit = log.filter(F.col("table") == table).orderBy(F.desc("run")).select("path").first()
        return None if hit is None else self.spark.read.parquet(hit[0])


def health_record(source: str, started: str, finished: str, **fields) -> dict:
    record = {c: "" for c in feeds.HEALTH}
    record.update(source_name=source, run_started_at=started, run_finished_at=finished, status="OK")
    record.update({k: str(v) for k, v in fields.items()})
    return record


def append_health(spark: SparkSession, base: str, records: list[dict]) -> None:
    """Appends run records; every run leaves one, good or bad."""
    schema = ", ".join(f"{c} string" for c in feeds.HEALTH)
    spark.createDataFrame([tuple(r[c] for c in feeds.HEALTH) for r in records], schema).coalesce(1) \
        .write.mode("append").parquet(f"{base.rstrip('/')}/source_health")


def read_health(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/source_health")


def daily_health(health: DataFrame) -> DataFrame:
    """Runs per day, source and status."""
    return health.groupBy(
        F.substring("run_started_at", 1, 10).alias("day"), "source_name", "status"
    ).agg(F.count("*").alias("runs"))
