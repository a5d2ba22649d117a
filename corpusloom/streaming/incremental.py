"""Incremental execution on Structured Streaming: which tasks are done is the stream's state; results go to separate logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.resume import tried
from corpusloom.runtime import ship

MADE = "value string, error string, attempts int, raw string, status string"
COUNTERS = ("requested", "skipped", "success", "failed")
#: Which rows a log holds: results as they are used, results with the raw output, failures.
LOGS = {"scores": "success", "raw": "success", "errors": "failed"}


def executed(tasks: DataFrame, call: Callable[[dict], str], key: str = "key", attempts: int = 3, wait: Callable[[int], float] | None = None, buckets: int = 1024) -> DataFrame:
    """A stream of tasks with value, error, attempts, raw and status: success, failed, or skipped.

    The state tells for which keys a call succeeded. Such a key is never called again; one that failed is called when it
    arrives again. Of equal keys in one batch the first success ends the calls. Null keys are a key like any other.

    Keys lie in `buckets` by a hash, and a bucket's state is its keys that are done: Python is entered once a bucket that
    has tasks instead of once a key, and a bucket's rows still come in bounded batches. The number must stay the same as
    long as the checkpoint lives.
    """
    ship(tasks.sparkSession)
    names, made_names = tasks.columns, [c.split()[0] for c in MADE.split(", ")]

    def of_bucket(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, new = set(state.get[0]) if state.exists else set(), False
        for b in batches:
            made = []
            for name, row in zip(b["__key"], b[names].to_dict("records"), strict=True):
                known = name in done
                value, error, n, raw = (None, None, 0, None) if known else tried(call, row, attempts, wait)
                made.append((value, error, n, raw, "skipped" if known else "failed" if error is not None else "success"))
                if not known and error is None:
                    done.add(name)
                    new = True
            yield b[names].assign(**{c: pd.Series([m[k] for m in made], index=b.index, dtype="int32" if k == 2 else object) for k, c in enumerate(made_names)})
        if new:
            state.update((list(done),))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema) + ", " + MADE
    told = F.base64(key) if tasks.schema[key].dataType.typeName() == "binary" else F.col(key).cast("string")
    named = tasks.withColumn("__key", F.coalesce(F.concat(F.lit("="), told), F.lit(""))).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    return named.groupBy("__bucket").applyInPandasWithState(of_bucket, schema, "done array<string>", "append", GroupStateTimeout.NoTimeout)


def start_tasks(spark: SparkSession, tasks: DataFrame, out: str, call: Callable[[dict], str], key: str = "key", attempts: int = 3, wait: Callable[[int], float] | None = None) -> StreamingQuery:
    """Run what a stream of tasks has now: successes go to `out`/scores and `out`/raw, failures to `out`/errors.

    Every batch writes folders of its own number, so one that is run again after a failure replaces what it wrote, and its
    counters. The checkpoint lies in `out`; started again, the stream takes up what has arrived since.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        made = batch.persist()
        counts = {r["status"]: r["count"] for r in made.groupBy("status").count().collect()}
        row = (sum(counts.values()), *(counts.get(c, 0) for c in COUNTERS[1:]))
        spark.createDataFrame([row], ", ".join(f"{c} long" for c in COUNTERS)).coalesce(1).write.mode("overwrite").parquet(f"{out}/counters/epoch={epoch}")
        for log, status in LOGS.items():
            kept = [c for c in made.columns if c != "status" and not (log == "scores" and c in ("raw", "error")) and not (log == "raw" and c == "error") and not (log == "errors" and c == "value")]
            made.where(F.col("status") == status).select(kept).write.mode("overwrite").parquet(f"{out}/{log}/epoch={epoch}")
        made.unpersist()

    stream = executed(tasks, call, key, attempts, wait).writeStream.foreachBatch(each)
    return stream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def run_tasks(spark: SparkSession, tasks: DataFrame, out: str, call: Callable[[dict], str], key: str = "key", attempts: int = 3, wait: Callable[[int], float] | None = None) -> dict[str, int]:
    """start_tasks() to its end; returns how many tasks were requested, skipped, successful and failed in this run."""
    before = counters(spark, out)
    start_tasks(spark, tasks, out, call, key, attempts, wait).awaitTermination()
    after = counters(spark, out)
    return {c: after[c] - before[c] for c in COUNTERS}


def counters(spark: SparkSession, out: str) -> dict[str, int]:
    """The counters of all runs so far: one row a batch is read."""
    if not _exists(spark, f"{out}/counters"):
        return dict.fromkeys(COUNTERS, 0)
    return spark.read.parquet(f"{out}/counters").agg(*[F.sum(c).alias(c) for c in COUNTERS]).first().asDict()


def log(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A log of all runs: scores, raw or errors, with the epoch that wrote each row."""
    return spark.read.parquet(f"{out}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key with a watermark: an extension for event streams, beyond the studies."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
