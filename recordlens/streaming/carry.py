"""Micro-batches that continue where the batch before ended, without a growing in-memory state.

Between batches a log of carries is kept next to the output: each batch writes one short row per key it
touched, under its batch id, and every ``compact`` batches the latest rows of all keys are written together, so
what a batch writes follows the batch and what it reads stays short. The newest row of a key counts. A batch
that is run again after a failure reads the same folders and writes its own again, so the result does not
change. Inside a batch the ordinary, skew-safe batch operators do the work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlens.operators.ordered import pick_row
from recordlens.session import read_if_there, remove_folder

COMPACT = 16
Step = Callable[[DataFrame, "DataFrame | None"], "tuple[DataFrame, DataFrame]"]


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pick_row(rows, keys, ["_batch"], last=True).drop("_batch")


def _compacted(batch_id: int, compact: int) -> int:
    """Last batch before this one after which the log was compacted; -1 for none."""
    return batch_id // compact * compact - 1


def _log(spark: SparkSession, base: str, first: int, end: int) -> DataFrame:
    """Rows compacted after batch ``first`` and those of the batches behind it up to ``end``."""
    parts = [(f"{base}/compact/batch={first}", first)] if first >= 0 else []
    parts += [(f"{base}/carry/batch={k}", k) for k in range(first + 1, end)]
    return reduce(DataFrame.unionByName, [
        spark.read.parquet(path).withColumn("_batch", F.lit(k)) for path, k in parts])


def carry_before(spark: SparkSession, base: str, batch_id: int, keys: Sequence[str], compact: int) -> DataFrame:
    """Newest carry row of every key after the batches before ``batch_id``. A missing folder is an error."""
    return _newest(_log(spark, base, _compacted(batch_id, compact), batch_id), keys)


def start_with_carry(stream: DataFrame, step: Step, base: str, keys: Sequence[str], *,
                     compact: int = COMPACT) -> StreamingQuery:
    """Runs ``step(batch, carry) -> (output, new carry)`` on every micro-batch.

    The step sees the carry of the batch's keys alone and returns that of the keys it touched. Only the first
    batch may do without a carry: a missing one later is an error, not an empty state.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # keys, output and carry read it
        try:
            carry = None
            if batch_id:
                touched = batch.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
                same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_t_{k}")), keys, F.lit(True))
                carry = carry_before(spark, base, batch_id, keys, compact).join(touched, same, "left_semi")
            out, new_carry = step(batch, carry)
            out.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
            new_carry.write.mode("overwrite").parquet(f"{base}/carry/batch={batch_id}")
        finally:
            batch.unpersist()
        if (batch_id + 1) % compact == 0:
            together = _newest(_log(spark, base, _compacted(batch_id, compact), batch_id + 1), keys)
            together.write.mode("overwrite").parquet(f"{base}/compact/batch={batch_id}")
        kept = _compacted(batch_id, compact)
        if batch_id == kept + 1 and kept >= 0:  # a repeated batch needs the log from here on, none older
            for k in range(kept - compact + 1, kept + 1):
                remove_folder(spark, f"{base}/carry/batch={k}")
            remove_folder(spark, f"{base}/compact/batch={kept - compact}")

    return start_batches(stream, run, base)


def start_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], base: str) -> StreamingQuery:
    """Calls ``run(batch, batch id)`` for what the stream holds now."""
    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )


def output(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/out").drop("batch")


def last_carry(spark: SparkSession, base: str, keys: Sequence[str]) -> DataFrame:
    """Newest carry of every key; the folder names hold the batch ids."""
    rows = spark.read.parquet(f"{base}/carry")
    together = read_if_there(spark, f"{base}/compact")
    if together is not None:
        rows = rows.unionByName(together)
    return _newest(rows.withColumnRenamed("batch", "_batch"), keys)
