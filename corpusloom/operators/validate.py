"""Checks of manifests and predictions as flag columns, issue rows and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.dedup import first_examples
from corpusloom.runtime import stored

#: The names of the checks.
TEXT_CODES = ("EMPTY_TEXT", "OUTER_WHITESPACE", "NON_NFC_UNICODE", "REPLACEMENT_CHARACTER", "CONTROL_CHARACTER")
PAIR_CODES = ("VERY_SHORT_SOURCE", "VERY_SHORT_REFERENCE", "REFERENCE_LONGER_THAN_SOURCE", "SOURCE_EQUALS_REFERENCE")


def text_flags(field: str) -> list[tuple[str, Column]]:
    """(code, condition) of the checks of one text field; an empty text has no further ones but outer space."""
    t = F.col(field)
    conditions = (X.pstrip(t) == "", X.has_outer_space(t), ~X.is_nfc(t), X.has_replacement(t), X.has_control(t))
    return list(zip(TEXT_CODES, conditions, strict=True))


def pair_flags(source: str, reference: str, n_source: str, n_reference: str) -> list[tuple[str, Column]]:
    """(code, condition) of the checks of a source with its reference; counts are word counts."""
    s, r = F.col(n_source), F.col(n_reference)
    conditions = (s.between(1, 19), r.between(1, 2), r > s, (F.col(source) == F.col(reference)) & (s > 0))
    return list(zip(PAIR_CODES, conditions, strict=True))


def codes(flags: Sequence[tuple[str, Column]]) -> Column:
    """The codes whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in flags]))


def issue_report(issues: DataFrame, line: str = "line", most: int = 5) -> DataFrame:
    """(code, n, examples): count and the first lines of each code. Issues are found once and stored; examples are cut before
    they are gathered."""
    issues = stored(issues.select("code", line), "issues")
    counts = issues.groupBy("code").agg(F.count("*").alias("n"))
    examples = first_examples(issues, ["code"], [line], most).groupBy("code").agg(F.sort_array(F.collect_list(line)).alias("examples"))
    return counts.join(examples, "code")


def repeated_ids(rows: DataFrame, id_col: str, line: str) -> DataFrame:
    """(id, line, first_line) of every row whose id an earlier line has."""
    first = rows.groupBy(id_col).agg(F.min(line).alias("first_line"), F.count("*").alias("__n")).where(F.col("__n") > 1)
    return rows.join(first, id_col).where(F.col(line) > F.col("first_line")).select(id_col, line, "first_line")


def audit_predictions(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per system: predicted, missing, unknown, repeated, empty and failed rows, and distinct settings.

    Predictions are read once; a system's settings are few, so their sets are gathered.
    """
    known = manifest.select("id").distinct().withColumn("wanted", F.lit(True))
    counted = predictions.groupBy("id", "system").agg(
        F.count("*").alias("n"), F.count_if(X.pstrip("prediction") == "").alias("n_empty"), F.count_if(F.col("status") != "ok").alias("n_failed"),
        F.count_if((F.col("status") == "ok") & F.col("error").isNotNull()).alias("n_ok_with_error"), F.count_if((F.col("status") != "ok") & F.col("error").isNull()).alias("n_silent"), F.sort_array(F.collect_set("config_id")).alias("configs"),
    )
    found = counted.join(known, "id", "left").groupBy("system").agg(
        F.sum("n").alias("n_rows"), F.count("wanted").alias("__known"), F.count_if(F.col("wanted").isNull()).alias("n_unknown"),
        F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("n_repeated"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_empty", "n_failed", "n_ok_with_error", "n_silent")],
        F.size(F.array_distinct(F.flatten(F.collect_set("configs")))).cast("long").alias("n_configs"),
    )
    return found.crossJoin(known.agg(F.count("*").alias("__all"))).withColumn("n_missing", F.col("__all") - F.col("__known")).drop("__all", "__known")


def incomplete(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem) for every expected key that is missing or repeated and every found one that isn't expected."""
    counted = found.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = expected.select(*keys).distinct().withColumn("__e", F.lit(1)).join(counted, list(keys), "full_outer")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def identity_leak(rows: DataFrame, public: Sequence[str], forbidden: Sequence[str]) -> Column:
    """Whether the serialised public columns name a forbidden word."""
    return F.lower(F.to_json(F.struct(*public))).rlike("|".join(forbidden))


def mismatches(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) of every field in which rows of a common key differ; null is equal to null. Texts meet as digests."""
    shown = lambda df, f: F.sha2(f, 256) if dict(df.dtypes)[f] == "string" else F.col(f)
    side = lambda df, end: df.select(key, *[shown(df, f).alias(f + end) for f in fields])
    differ = [F.when(~F.col(f"{f}__a").eqNullSafe(F.col(f"{f}__b")), F.lit(f)) for f in fields]
    return side(a, "__a").join(side(b, "__b"), key).select(key, F.explode(F.array_compact(F.array(*differ))).alias("field"))


def json_keys(body: str, expected: Sequence[str]) -> tuple[Column, Column]:
    """(missing, extra) keys of a JSON object against a closed schema; null for what is no object."""
    keys, wanted = F.json_object_keys(body), F.array(*map(F.lit, expected))
    return F.array_except(wanted, keys), F.array_except(keys, wanted)


def config_ids(rows: DataFrame, config: str = "config_id") -> DataFrame:
    """One row: the distinct settings in order, and whether there is just one."""
    found = F.sort_array(F.collect_set(config))
    return rows.agg(found.alias("config_ids"), (F.count_distinct(config) == 1).alias("uniform"))


#: The fields of a prediction line.
PREDICTION_FIELDS = ("id", "system", "config_id", "prediction", "status", "error")


def handoff_lines(lines: DataFrame, system: str, text: str = "text") -> DataFrame:
    """lines with `issues`: what is wrong with each prediction's JSON against the closed schema of six fields.

    A row of status ok has a prediction and no error, one of status error has an error; ids and settings aren't empty.
    """
    missing, extra = json_keys(text, PREDICTION_FIELDS)
    get = lambda f: F.get_json_object(text, f"$.{f}")
    blank = lambda c: F.coalesce(X.pstrip(c), F.lit("")) == ""
    known = F.coalesce(F.array_contains(F.json_object_keys(text), "status"), F.lit(False))
    status = F.coalesce(get("status"), F.lit(""))
    found = [
        ("no object", missing.isNull()), ("missing field", F.size(missing) > 0), ("extra field", F.size(extra) > 0), ("empty id", blank(get("id"))),
        ("wrong system", F.coalesce(get("system"), F.lit("")) != system), ("empty config_id", blank(get("config_id"))), ("empty prediction", (status == "ok") & blank(get("prediction"))),
        ("error in ok row", (status == "ok") & get("error").isNotNull()), ("error row without error", (status == "error") & blank(get("error"))), ("unknown status", known & ~status.isin("ok", "error")),
    ]
    return lines.withColumn("issues", codes(found))


def handoff(manifest: DataFrame, lines: DataFrame, system: str, text: str = "text", most: int = 50) -> dict:
    """The verdict on a file of predictions: counts, the first `most` issues in line order, and whether it can be handed on.

    It can if no line has an issue, ids are those of the manifest, each once, one setting is used and no row failed.
    """
    marked = handoff_lines(lines, system, text).withColumns({f: F.get_json_object(text, f"$.{f}") for f in ("id", "config_id", "status")})
    issues = marked.select("line", F.explode("issues").alias("issue"))
    expected = manifest.groupBy("id").agg(F.count("*").alias("wanted"))
    both = expected.join(marked.groupBy("id").agg(F.count("*").alias("n")), "id", "full_outer")
    ids = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("extra"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"), F.coalesce(F.sum(F.col("wanted") - 1), F.lit(0)).alias("manifest_duplicate"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("input")).first()
    rows = marked.agg(F.count("*").alias("output"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") == "error").alias("failed"), F.slice(F.sort_array(F.collect_set("config_id")), 1, most).alias("config_ids")).first()
    out = ids.asDict() | rows.asDict() | {"issue_count": issues.count(), "issues": [f"line {r.line}: {r.issue}" for r in issues.orderBy("line", "issue").limit(most).collect()]}
    wrong = out["issue_count"] + out["missing"] + out["extra"] + out["duplicate"] + out["manifest_duplicate"] + out["failed"] + (len(out["config_ids"]) > 1)
    return out | {"valid_for_handoff": not wrong}


def assert_manifest(rows: DataFrame, expected: int | None = None, fields: Sequence[str] = ("id", "split", "source", "reference"), filled: Sequence[str] = ("source", "reference")) -> DataFrame:
    """rows, if every one has an id of its own and filled texts and there are as many as expected; else ValueError.

    One pass counts the faults; the message names ten repeated ids at most.
    """
    if missing := sorted(set(fields) - set(rows.columns)):
        raise ValueError(f"fields missing: {missing}")
    empty = [F.count_if(F.coalesce(X.pstrip(c), F.lit("")) == "").alias(c) for c in filled]
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("id").cast("string"), F.lit("")) == "").alias("bad_ids"), *empty).first()
    again = [r[0] for r in rows.groupBy("id").count().where("count > 1").orderBy("id").limit(10).collect()]
    faults = [f"{found['bad_ids']} rows without id"] * bool(found["bad_ids"]) + [f"{found[c]} rows with empty {c}" for c in filled if found[c]] + [f"repeated ids: {again}"] * bool(again)
    if expected is not None and found["n"] != expected:
        faults.append(f"{found['n']} rows, {expected} expected")
    if faults:
        raise ValueError("; ".join(faults))
    return rows


def load_manifest(rows: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The first `limit` rows in order, ids as strings, asserted after the limit: what a run works on."""
    first = rows.withColumn("id", F.col("id").cast("string")).orderBy(order)
    return assert_manifest(first.limit(limit) if limit else first, fields=("id", "source"), filled=("source",))


def assert_predictions(predictions: DataFrame, expected: DataFrame, system: str, aliases: Sequence[str] = ()) -> DataFrame:
    """predictions, if they are of this system or an alias, all ok and filled, for just the ids of `expected`, each once;
    else ValueError with examples: five repeated ids and errors, ten missing and unknown ids at most."""
    wrong = ~F.col("system").isin(system, *aliases) | (F.col("status") != "ok") | (F.coalesce(X.pstrip("prediction"), F.lit("")) == "")
    counted = predictions.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("bad"))
    both = expected.select("id").distinct().withColumn("wanted", F.lit(True)).join(counted, "id", "full_outer")
    some = lambda c, n: [r[0] for r in both.where(c).select("id").orderBy("id").limit(n).collect()]
    faults = {"repeated": some("n > 1", 5), "errors": some("bad > 0", 5), "missing": some("n is null", 10), "unknown": some("wanted is null", 10)}
    if any(faults.values()):
        raise ValueError(", ".join(f"{k}: {v}" for k, v in faults.items() if v))
    return predictions


def assert_ids(found: dict[str, int], expected: dict[str, int], names: Sequence[str] = ("pad", "unk", "bos", "eos", "vocab_size")) -> None:
    """Raise unless a tokenizer's special ids and size are those that a model was made with."""
    if odd := {k: (found.get(k), expected.get(k)) for k in names if found.get(k) != expected.get(k)}:
        raise ValueError(f"tokenizer and model disagree: {odd}")


def assert_frozen(runtime: dict, frozen: dict, names: Sequence[str] = ("model", "base_url", "prompt_version")) -> None:
    """Raise unless a run has the model, address and prompt that its pilot was passed with."""
    if odd := [k for k in names if runtime.get(k) != frozen.get(k)]:
        raise ValueError(f"the runtime changed since the pilot: {', '.join(odd)}")
