"""Blind studies: tasks, unblinding, repeats, comparisons of systems, the pilot's gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import paired_bootstrap
from corpusloom.functions.text import pstrip
from corpusloom.functions.verdicts import yes_no


def candidate_tasks(samples: DataFrame, mapping: DataFrame, predictions: DataFrame) -> DataFrame:
    """One anonymous task per sample and label: (task, sample_id, anon_id, candidate); the system stays behind."""
    rows = samples.select("sample_id").join(mapping, "sample_id").join(predictions.select("sample_id", "system", "prediction"), ["sample_id", "system"])
    return rows.select(F.lit("candidate").alias("task"), "sample_id", "anon_id", F.col("prediction").alias("candidate"))


def unblind(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Records with their system; a record that the mapping doesn't know makes the job fail when it is read."""
    joined = records.join(mapping, ["sample_id", "anon_id"], "left")
    known = F.when(F.col("system").isNull(), F.raise_error(F.concat(F.lit("no system for "), F.col("sample_id").cast("string"), F.lit(" "), F.col("anon_id")))).otherwise(F.col("system"))
    return joined.withColumn("system", known)


def complete_pairs(rows: DataFrame, keys: Sequence[str], value: str, repeat: str = "is_repeat") -> DataFrame:
    """(keys, a, b): the values of the original and the repeat, where there is exactly one of each."""
    is_repeat = F.col(repeat)
    found = rows.groupBy(*keys).agg(F.max(F.when(~is_repeat, F.col(value))).alias("a"), F.max(F.when(is_repeat, F.col(value))).alias("b"), F.count_if(~is_repeat).alias("__o"), F.count_if(is_repeat).alias("__r"))
    return found.where("__o = 1 and __r = 1").select(*keys, "a", "b")


def compare_systems(scores: DataFrame, systems: Sequence[str], fields: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """Every pair of systems on the samples both have, by score and by error rate, with the better one named.

    A sample's systems are first brought to one row, so the pairs of systems come from that row and no self-join is needed.
    """
    values = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in (*fields, "major_error")]
    long = scores.withColumn("major_error", F.col("major_error").cast("int")).select("sample_id", "system", F.explode(F.array(*values)).alias("x"))
    wide = long.groupBy("sample_id", "x.field").pivot("system", list(systems)).agg(F.max("x.v"))
    gaps = [F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.col(a) - F.col(b)).alias("gap")) for i, a in enumerate(systems) for b in systems[i + 1 :]]
    rows = wide.select("field", F.explode(F.array(*gaps)).alias("g")).select("g.pair", "field", "g.gap").where("gap is not null")
    out = paired_bootstrap(rows, "gap", ["pair", "field"], resamples, seed)
    first, second = F.split_part("pair", F.lit(">"), F.lit(1)), F.split_part("pair", F.lit(">"), F.lit(2))
    higher = (F.col("difference") > 0) == (F.col("field") != "major_error")
    return out.withColumn("better", F.when(F.col("difference") == 0, "equal").when(higher, first).otherwise(second))


def round_robin(rows: DataFrame, place: str, systems: Sequence[str]) -> DataFrame:
    """Each row with the system of its place in turn."""
    return rows.withColumn("system", F.element_at(F.array(*map(F.lit, systems)), (F.pmod(F.col(place), F.lit(len(systems))) + 1).cast("int")))


def pilot_stability(log: DataFrame, value: str) -> DataFrame:
    """(sample_id, anon_id, first, again): scores of a task and of its repeat, whose label ends in R."""
    first = log.where(~F.col("anon_id").endswith("R")).select("sample_id", "anon_id", F.col(value).alias("first"))
    again = log.where(F.col("anon_id").endswith("R")).select("sample_id", F.regexp_replace("anon_id", "R$", "").alias("anon_id"), F.col(value).alias("again"))
    return first.join(again, ["sample_id", "anon_id"])


def gate(complete: Column, first_pass: Column, within_one: Column, largest: Column) -> Column:
    """passed, or needs_review: all tasks done, 95 % at the first attempt, 90 % of repeats within one, none over two."""
    return F.when((complete == 1) & (first_pass >= 0.95) & (within_one >= 0.90) & (largest <= 2), "passed").otherwise("needs_review")


def arrange_blocks(samples: Sequence[str], repeats: Sequence[str], distance: int) -> list[tuple[str, bool]]:
    """Blocks of a small human study, each repeat at least `distance` places after its original.

    Built, not drawn until it fits: the originals in order with those to be repeated first, then each repeat at the
    earliest place that is far enough. Raises if the study is too short for that.
    """
    again = list(repeats)
    order = again + [s for s in samples if s not in set(again)]
    out: list[tuple[str, bool]] = [(s, False) for s in order]
    for k, s in enumerate(again):
        at = next(i for i, x in enumerate(out) if x == (s, False)) + distance
        if at > len(out):
            raise ValueError(f"{len(order)} samples are too few for repeats {distance} apart")
        out.insert(min(len(out), at + k), (s, True))
    return out


def unfilled(fields: Sequence[str], major: str = "major_error") -> Column:
    """Whether a human left a score or the error question of a row blank."""
    blank = [F.coalesce(pstrip(f), F.lit("")) == "" for f in (*fields, major)]
    return F.array_contains(F.array(*blank), True)


def human_annotations(rows: DataFrame, row: str, fields: Sequence[str], major: str = "major_error") -> DataFrame:
    """The filled rows of a human study's table of strings, scores as integers and the error question as a boolean.

    A score that is no integer from 1 to 5, or an answer that is neither yes nor no, makes the job fail and names its row.
    """

    def parsed(f: str, value: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"bad {f} in row "), F.col(row).cast("string")))
        return F.when(value.isNotNull(), value).otherwise(bad).alias(f)

    number = lambda f: F.when(pstrip(f).rlike(r"^[+-]?[0-9]+$"), pstrip(f).try_cast("int"))
    score = lambda f: F.when(number(f).between(1, 5), number(f))
    values = {f: parsed(f, score(f)) for f in fields} | {major: parsed(major, yes_no(F.col(major)))}
    return rows.where(~unfilled(fields, major)).withColumns(values)


def annotation_report(rows: DataFrame, row: str, name: Column, fields: Sequence[str], major: str = "major_error", most: int = 20) -> DataFrame:
    """One row: status, annotated_rows, missing_rows, and the names of the first `most` rows with blanks, in order."""
    marked = rows.select(F.col(row).alias("row"), name.alias("name"), unfilled(fields, major).alias("blank"))
    counts = marked.agg(F.count_if(~F.col("blank")).alias("annotated_rows"), F.count_if("blank").alias("missing_rows"))
    first = marked.where("blank").orderBy("row").limit(most).agg(F.array_sort(F.collect_list(F.struct("row", "name"))).alias("f"))
    status = F.when(F.col("missing_rows") == 0, "complete").otherwise("incomplete").alias("status")
    return counts.crossJoin(first).select(status, "annotated_rows", "missing_rows", F.col("f.name").alias("missing_examples"))  # one row each


def assess_pilot(log: DataFrame, wanted: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row of a pilot's counts and its gate's status; `wanted` has one row, expected_records.

    A record counts as first pass if it took one attempt, as a share of the records expected. Tasks of run "pilot" are
    compared with those of run "pilot-repeat", or whose label ends in R, field by field.
    """
    repeat = (F.col("run_id") == "pilot-repeat") | F.col("anon_id").endswith("R")
    candidates = log.where("task = 'candidate'")
    name = F.regexp_replace("anon_id", "R$", "")
    side = lambda df, end: df.select("sample_id", name.alias("anon_id"), *[F.col(f).alias(f + end) for f in fields])
    both = side(candidates.where(~repeat & (F.col("run_id") == "pilot")), "").join(side(candidates.where(repeat), "_again"), ["sample_id", "anon_id"])
    gaps = both.select(F.explode(F.array(*[F.abs(F.col(f) - F.col(f + "_again")) for f in fields])).alias("gap"))
    found = gaps.agg(F.count("*").alias("n_comparisons"), F.coalesce(F.avg((F.col("gap") <= 1).cast("int")), F.lit(0.0)).alias("w"), F.max("gap").alias("largest"))
    records = log.agg(F.count("*").alias("valid_records"), F.count_if(F.col("attempts") == 1).alias("first"))
    every = wanted.crossJoin(records).crossJoin(found)  # one row each
    first = F.coalesce(F.try_divide("first", "expected_records"), F.lit(0.0))
    status = F.coalesce(gate((F.col("valid_records") == F.col("expected_records")).cast("int"), first, F.col("w"), F.col("largest")), F.lit("needs_review"))
    return every.select("expected_records", "valid_records", F.round(first, 4).alias("first_pass_rate"), "n_comparisons", F.round("w", 4).alias("within_one"), "largest", status.alias("status"))
