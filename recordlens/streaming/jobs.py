"""Streaming jobs over session events, probe history and landed feed files."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from recordlens.functions import text
from recordlens.operators import sequences
from recordlens.operators.ordered import pick_row, time_chunk, with_previous
from recordlens.session import cut
from recordlens.sources import tables
from recordlens.streaming.carry import last_carry, output, start_batches, start_with_carry

EVENT_SCHEMA = (
    "sessionId string, timestamp long, eventType string, filePath string, branchPath string, "
    "metadata struct<lines: int, sizeBytes: long, imports: int, exports: int>, "
    "badges array<string>, diffSummaryHash string"
)


def session_stream_source(spark: SparkSession, directory: str, *, max_files: int = 1000) -> DataFrame:
    """Session logs (JSON lines, one file per session) as a stream of flat events."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).json(directory)
    return flat_events(raw)


def flat_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "sessionId", F.timestamp_millis("timestamp").alias("timestamp"), "eventType", "filePath",
        "branchPath", F.col("metadata.lines").alias("lines"),
        F.col("metadata.imports").alias("imports"), F.col("metadata.exports").alias("exports"))


def _append_updates(stream: DataFrame, base: str) -> StreamingQuery:
    """Writes every changed group of an update-mode aggregation under its batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )


def _current(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    """Latest written version of each group."""
    rows = spark.read.parquet(f"{base}/out")
    return pick_row(rows, keys, ["batch"], last=True).drop("batch")


# ------------------------------------------------------------------ latest state
def stream_latest_state(events: DataFrame, order: list[str], base: str,
                        session: str = "sessionId") -> StreamingQuery:
    """Last event per path as a streaming aggregate; the state is one row per path."""
    row = F.struct(*[c for c in events.columns if c not in (session, "filePath")])
    last = events.groupBy(session, "filePath").agg(F.max_by(row, F.struct(*order)).alias("last"))
    return _append_updates(last, base)


def latest_state_now(spark: SparkSession, base: str, session: str = "sessionId") -> DataFrame:
    rows = _current(spark, base, [session, "filePath"]).select(session, "filePath", "last.*")
    return rows.filter(~F.col("eventType").isin("unlink", "unlinkDir"))


# ------------------------------------------------------------------ session statistics
def stream_session_stats(events: DataFrame, order: list[str], base: str,
                         session: str = "sessionId") -> StreamingQuery:
    """Counts per session and branch; per-session figures follow from these few rows."""
    kind = F.col("eventType")
    file_event = ~kind.isin("addDir", "unlinkDir")
    per_branch = events.groupBy(session, "branchPath").agg(
        F.count_if(kind == "add").alias("created"), F.count_if(kind == "change").alias("modified"),
        F.count_if(kind == "unlink").alias("deleted"), F.count("*").alias("events"),
        F.count_if(file_event).alias("file_events"),
        F.min(F.when(file_event, F.struct(*order))).alias("first_seen"))
    return _append_updates(per_branch, base)


def session_stats_now(spark: SparkSession, base: str, session: str = "sessionId") -> DataFrame:
    rows = _current(spark, base, [session, "branchPath"])
    hot = F.when(F.col("file_events") > 0, F.struct(-F.col("file_events"), "first_seen"))
    return rows.groupBy(session).agg(
        F.sum("created").alias("created"), F.sum("modified").alias("modified"),
        F.sum("deleted").alias("deleted"), F.sum("events").alias("total_events"),
        F.min_by("branchPath", hot).alias("hottest_branch"),
        F.max("file_events").alias("hottest_count"))


# ------------------------------------------------------------------ edit rate
def edit_windows(events: DataFrame, *, window: str = "60 seconds", slide: str | None = None,
                 edits: int = 3) -> DataFrame:
    """Edits per path and time window with the thrashing flag; works on batch and stream."""
    files = events.filter(~F.col("eventType").isin("addDir", "unlinkDir"))
    return files.groupBy(F.window("timestamp", window, slide), "filePath").agg(
        F.count("*").alias("edits")).select(
        F.col("window.start").alias("window_start"), "filePath", "edits",
        (F.col("edits") >= edits).alias("thrashing"))


def stream_edit_rate(events: DataFrame, base: str, *, watermark: str = "10 minutes",
                     window: str = "60 seconds", slide: str | None = None,
                     edits: int = 3) -> StreamingQuery:
    """Closed windows are appended; events later than the watermark are dropped."""
    rate = edit_windows(events.withWatermark("timestamp", watermark), window=window, slide=slide,
                        edits=edits)
    return (
        rate.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )


# ------------------------------------------------------------------ edits just before each edit
EMIT_ROWS = 50_000
RECENT_EDITS = "filePath string, timestamp timestamp, event_id long, edits long, thrashing boolean"


def with_span(events: DataFrame, window_s: int, span_s: int) -> DataFrame:
    """File events with the span of time they count in, and again as context of the next span where that may
    look back at them; ``own`` tells the two apart.

    A busy path so is split by time, and a span needs nothing but its own rows.
    """
    at = F.unix_micros("timestamp")
    span = F.floor(at / (span_s * 1_000_000)).cast("long")
    files = events.filter(~F.col("eventType").isin("addDir", "unlinkDir") & F.col("timestamp").isNotNull())
    reaches = at > (span + 1) * (span_s * 1_000_000) - window_s * 1_000_000
    spans = F.array_compact(F.array(
        F.struct(span.alias("span"), F.lit(True).alias("own")),
        F.when(reaches, F.struct((span + 1).alias("span"), F.lit(False).alias("own")))))
    return files.select("filePath", "event_id", "timestamp", at.alias("at"), F.explode(spans).alias("s")).select(
        "filePath", "event_id", "timestamp", "at", "s.span", "s.own")


HELD_EDITS = pa.schema([("filePath", pa.string()), ("at", pa.int64()), ("event_id", pa.int64()), ("own", pa.bool_())])


def packed_edits(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD_EDITS) as out:
        out.write_table(pa.Table.from_pandas(rows[HELD_EDITS.names], HELD_EDITS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def edits_before(path: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each edit the number of edits of its path in the ``window`` up to it, itself included."""
    times, rank = np.unique(at, return_inverse=True)
    first = path * (len(times) + 1)
    place = np.sort(first + rank)
    since = first + np.searchsorted(times, at - window, side="right")
    return np.searchsorted(place, first + rank, side="right") - np.searchsorted(place, since, side="left")


class RecentEdits(StatefulProcessor):
    """Rows of many paths and one span wait in list state, packed by batch; a timer at the span's end counts and emits them."""

    def __init__(self, window_s: int, span_s: int, edits: int):
        self.window, self.span_s, self.edits = window_s * 1_000_000, span_s, edits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        if not self.rows.exists():
            # The last millisecond of the span: later rows of it would be behind the watermark.
            self.handle.registerTimer((int(key[1]) + 1) * self.span_s * 1000 - 1)
        for batch in rows:
            self.rows.appendList([(packed_edits(batch),)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = pa.concat_tables([pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.rows.get()])
        self.rows.clear()
        at, own = held["at"].to_numpy(), held["own"].to_numpy()
        path = held["filePath"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
        count = edits_before(path, at, self.window)[own]
        kept = held.filter(held["own"])
        for start in range(0, len(count), EMIT_ROWS):
            part, n = kept.slice(start, EMIT_ROWS), count[start:start + EMIT_ROWS]
            yield pd.DataFrame({
                "filePath": part["filePath"].to_pandas(), "timestamp": pd.to_datetime(part["at"].to_numpy(), unit="us"),
                "event_id": part["event_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                "edits": n, "thrashing": n >= self.edits})


def stream_recent_edits(events: DataFrame, base: str, *, watermark: str = "10 minutes", window_s: int = 60,
                        span_s: int = 600, edits: int = 3, buckets: int = 64) -> StreamingQuery:
    """For each edit the number of edits of its path in the ``window_s`` seconds up to it, and the thrashing flag.

    Edits that arrive out of order within the watermark count at their own time. A span's edits are emitted when
    the watermark has passed its end, and its state goes. Paths share state by hash in ``buckets``, so that quiet
    paths cost no call each; a task holds one bucket's edits of one span, and busier streams take more buckets,
    which a stream keeps for life. Needs the RocksDB state store (``session.stream_session``).
    """
    rows = with_span(events, window_s, span_s).withWatermark("timestamp", watermark)
    bucket = F.pmod(F.xxhash64("filePath"), F.lit(buckets))
    counted = rows.withColumn("bucket", bucket).groupBy("bucket", "span").transformWithStateInPandas(
        RecentEdits(window_s, span_s, edits), RECENT_EDITS, "Append", "eventTime")
    return (
        counted.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )


# ------------------------------------------------------------------ run groups
def stream_run_groups(events: DataFrame, order: list[str], base: str, *, gap_ms: int = 5000,
                      at_least: int = 3, session: str = "sessionId") -> StreamingQuery:
    """Activity runs across batches; the open run of each session is the carry.

    An open run re-enters the next batch as its last event with the weight of the run (a run of two
    as both its events), so the islands are the same as over all events at once.
    """
    columns = events.columns

    def step(batch: DataFrame, carry: DataFrame | None):
        rows = batch.withColumn("_w", F.lit(1).cast("bigint"))
        if carry is not None:
            two = F.col("run_count") == 2
            again = carry.select(
                F.explode(F.when(two, F.array("_first", "_last")).otherwise(F.array("_last"))).alias("r"),
                F.when(two, 1).otherwise(F.col("run_count")).cast("bigint").alias("_w"))
            again = again.select(*[F.col("r")[c].alias(c) for c in columns], "_w")
            rows = rows.unionByName(again)
        runs = cut(sequences.run_islands(rows, order, gap_ms=gap_ms, session=session, weight="_w"), "runs")
        last = runs.groupBy(F.col(session).alias("_s")).agg(F.max("_run").alias("_open"))
        marked = runs.join(last, F.col(session).eqNullSafe(F.col("_s"))).withColumn(
            "_is_open", F.col("_run") == F.col("_open"))
        closed = sequences.show_runs(marked.filter(~F.col("_is_open")), columns, at_least)
        still = marked.filter("_is_open").select(session, "run_count", "_first", "_last")
        return closed, still

    return start_with_carry(events, step, base, [session])


def run_groups_now(spark: SparkSession, base: str, columns: list[str], at_least: int = 3,
                   session: str = "sessionId") -> DataFrame:
    """Closed runs and the runs still open at the end of the data so far."""
    still = sequences.show_runs(last_carry(spark, base, [session]), columns, at_least)
    return output(spark, base).unionByName(still)


# ------------------------------------------------------------------ status and drift alerts
def stream_status_events(history: DataFrame, order: list[str], base: str) -> StreamingQuery:
    """Status changes and schema drift per source; the carry is each source's last probe."""
    columns = history.columns

    def step(batch: DataFrame, carry: DataFrame | None):
        rows = batch.withColumn("_old", F.lit(False))
        if carry is not None:
            rows = rows.unionByName(carry.withColumn("_old", F.lit(True)))
        h = with_previous(rows, ["source"], order, ["status", "schema_hash"],
                          time_chunk(F.col("ts"))).filter(~F.col("_old"))
        before, hashed = F.col("prev.status"), F.col("prev.schema_hash")
        changed = F.when(~before.eqNullSafe(F.col("status")), F.struct(
            F.lit("status_changed").alias("event"), before.alias("from_value"),
            F.col("status").alias("to_value")))
        drift = F.when(hashed.isNotNull() & (hashed != F.col("schema_hash")), F.struct(
            F.lit("schema_drift").alias("event"), hashed.alias("from_value"),
            F.col("schema_hash").alias("to_value")))
        out = h.select("source", *order, F.explode(F.array_compact(F.array(changed, drift))).alias("e"))
        last = pick_row(rows.select(*columns), ["source"], order, last=True)
        return out.select("source", *order, "e.*"), last

    return start_with_carry(history, step, base, ["source"])


# ------------------------------------------------------------------ streaks
def stream_streak(history: DataFrame, order: list[str], base: str) -> StreamingQuery:
    """Trailing successes per source; a failure in the batch resets what was carried."""

    def step(batch: DataFrame, carry: DataFrame | None):
        fresh = sequences.verified_streak(batch, order)
        broke = batch.groupBy(F.col("source").alias("_s")).agg(
            F.bool_or(~F.col("task_success")).alias("broke"))
        fresh = fresh.join(broke, F.col("source") == F.col("_s")).drop("_s")
        if carry is None:
            state = fresh.select("source", "streak", "probes")
        else:
            old = carry.select("source", F.col("streak").alias("s0"), F.col("probes").alias("p0"))
            keep = F.when(F.coalesce("broke", F.lit(False)), 0).otherwise(F.coalesce("s0", F.lit(0)))
            state = fresh.join(old, "source", "left").select(
                "source", (keep + F.coalesce("streak", F.lit(0))).alias("streak"),
                (F.coalesce("p0", F.lit(0)) + F.coalesce("probes", F.lit(0))).alias("probes"))
        return state, state

    return start_with_carry(history, step, base, ["source"])


# ------------------------------------------------------------------ feed files
def stream_ingest(spark: SparkSession, directory: str, candidates: dict[str, list[str]],
                  essential: list[str], base: str, *, max_files: int = 100) -> StreamingQuery:
    """New CSV files under drifting headers to one table; a file with known content is skipped.

    A batch holds at most ``max_files`` file names, the only thing the driver sees. Rows, hashes and
    quarantine are keyed by batch id, so a repeated batch replaces its own. A file without the essential
    headers goes to the quarantine with the reason; its hash stays unknown, so it is tried again when it
    comes again.
    """
    files = (
        spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files).load(directory)
    )
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = batch.groupBy("sha256").agg(F.min("path").alias("path"))
        if batch_id:
            known = session.read.parquet(f"{base}/known").filter(F.col("batch") < batch_id)
            new = new.join(known, "sha256", "left_anti")
        listed = sorted((r["path"], r["sha256"]) for r in new.collect())
        out = tables.empty_table(session, [*candidates, "SOURCE_FILE"])
        taken, refused = [], []
        digests = dict(listed)
        for paths in tables.csv_layouts(session, list(digests)).values():  # one scan each
            mapped, missing = tables.reconcile_columns(
                tables.csv_scan(session, paths, with_path=True), candidates, essential, [tables.SOURCE_PATH])
            if mapped is None:
                refused += [(path, digests[path], f"no column for {', '.join(missing)}") for path in paths]
            else:
                taken += [(digests[path], path) for path in paths]
                out = out.unionByName(mapped.withColumnRenamed(tables.SOURCE_PATH, "SOURCE_FILE").withColumn(
                    "SOURCE_FILE", tables.file_name(F.col("SOURCE_FILE"))))
        for name, frame in (
                ("out", out), ("known", session.createDataFrame(taken, "sha256 string, path string")),
                ("quarantine", session.createDataFrame(refused, "path string, sha256 string, reason string"))):
            frame.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")

    return start_batches(hashed, run, base)


def quarantined(spark: SparkSession, base: str) -> DataFrame:
    """Path, hash and reason of the files that gave no rows."""
    return spark.read.parquet(f"{base}/quarantine").drop("batch")


def ingested(spark: SparkSession, base: str) -> DataFrame:
    return output(spark, base)


def marks_ingested(spark: SparkSession, base: str) -> DataFrame:
    """Ingested rows per normalised mark, for monitoring."""
    return ingested(spark, base).groupBy(text.normalize_mark(F.col("N_NUMBER")).alias("N_NUMBER")).agg(
        F.count("*").alias("rows"))
