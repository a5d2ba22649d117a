"""Resumable execution: pending tasks, the state of a log, retries inside a worker, ordered merges."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.dedup import last_wins


def completed(done: DataFrame, key: str = "key") -> DataFrame:
    """The keys of a log; one that is empty or repeated makes the job fail when it is read."""
    counted = done.groupBy(key).agg(F.count("*").alias("__n"))
    shown = F.coalesce(F.trim(F.col(key).cast("string")), F.lit(""))
    odd = F.when(shown == "", F.lit("empty key in the log")).when(F.col("__n") > 1, F.concat(F.lit("repeated key in the log: "), shown))
    return counted.select(F.when(odd.isNotNull(), F.raise_error(odd)).otherwise(F.col(key)).alias(key))


def pending(tasks: DataFrame, done: DataFrame, key: str = "key", strict: bool = False) -> DataFrame:
    """Tasks whose key the log doesn't have; with `strict` the log's keys must be those of completed()."""
    return tasks.join(completed(done, key) if strict else done.select(key).distinct(), key, "left_anti")


def resume_state(parts: DataFrame, manifest: DataFrame, key: str = "id", order: str = "ordinal", strict: bool = False) -> DataFrame:
    """(key, status) of what a resumed run keeps: the last row of each known key, if it is ok.

    Rows of keys that the manifest doesn't know are left out, or with `strict` make the job fail when they are read.
    """
    known = manifest.select(key).distinct().withColumn("__known", F.lit(True))
    last = last_wins(parts, key, order).join(known, key, "left")
    if strict:
        odd = F.raise_error(F.concat(F.lit("unknown id in the log: "), F.col(key).cast("string")))
        last = last.withColumn("__known", F.when(F.col("__known").isNull(), odd).otherwise(F.col("__known")))
    return last.where("__known and status = 'ok'").drop("__known")


def ordered_merge(manifest: DataFrame, results: DataFrame, key: str = "id", strict: bool = False) -> DataFrame:
    """Every manifest row with its result, status "missing" where there is none; sort by the ordinal when writing.

    With `strict` a row without result makes the job fail when it is read.
    """
    merged = manifest.join(results, key, "left")
    lacking = F.raise_error(F.concat(F.lit("no result for "), F.col(key).cast("string"))) if strict else F.lit("missing")
    return merged.withColumn("status", F.when(F.col("status").isNull(), lacking).otherwise(F.col("status")))


def retry_delay(attempt: Column, key: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds before an attempt: doubled each time up to `most`, plus a tenth of it at most by a hash of the key."""
    from corpusloom.functions.text import unit_hash

    wait = F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
    return wait * (1 + F.pmod(unit_hash(key, attempt), F.lit(1000)) / 10000.0)


def tried(call: Callable[[dict], str], row: dict, attempts: int, wait: Callable[[int], float] | None) -> tuple[str | None, str | None, int, str | None]:
    """(value, error, attempts, raw): ValueError is tried again after its wait; its second argument is the raw output."""
    error, raw = "", None
    for k in range(1, attempts + 1):
        if k > 1 and wait is not None:
            time.sleep(wait(k - 1))
        try:
            return call(row), None, k, raw
        except ValueError as e:
            error, raw = str(e.args[0]) if e.args else "", str(e.args[1]) if len(e.args) > 1 else raw
        except Exception as e:
            return None, f"{type(e).__name__}: {e}", k, raw
    return None, error, attempts, raw


def call_rows(tasks: DataFrame, call: Callable[[dict], str], attempts: int = 3, wait: Callable[[int], float] | None = None, call_batch: Callable[[list[dict]], list[str]] | None = None) -> DataFrame:
    """tasks with value, error, attempts and raw of calling a function, first for a whole batch if `call_batch` is given.

    Where a batch fails, or without one, rows are called one by one: a failed row keeps its error and stops no other;
    ValueError is tried again after wait(attempt) seconds, anything else is not. raw is the last rejected output, where
    the error carries one as its second argument. Retries happen inside the worker, so no task of Spark's is run again.
    """
    names = tasks.columns

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, made = b.to_dict("records"), None
            if call_batch is not None:
                with contextlib.suppress(Exception):
                    values = call_batch(rows)
                    made = [(v, None, 1, None) for v in values] if len(values) == len(rows) else None
            if made is None:
                made = [tried(call, r, attempts, wait) for r in rows]
            yield b.assign(**{c: pd.Series([m[k] for m in made], index=b.index, dtype=object) for k, c in enumerate(("value", "error", "attempts", "raw"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return tasks.select(*names).mapInPandas(of_batches, f"{schema}, value string, error string, attempts int, raw string")
