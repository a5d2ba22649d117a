"""Coercion of loosely typed verdicts; what can't be coerced is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.draws import let
from corpusloom.functions.text import enum_canonical, pstrip, within_words

#: The error types, the labels of references, the scores, and the words for yes, no and confidence.
ERROR_TYPES = ("hallucination", "wrong_entity", "wrong_number_date", "contradiction", "omission", "repetition", "incoherence", "verbosity", "other", "none")
REFERENCE_LABELS = ("fully_supported", "partially_supported", "unsupported", "mismatched")
SCORE_FIELDS = ("faithfulness", "informativeness", "fluency", "conciseness")
YES, NO = ("true", "1", "yes", "có"), ("false", "0", "no", "không")
CONFIDENCE = {"very low": 1, "low": 2, "medium": 3, "high": 4, "very high": 5}


def kind_of(body: Column, path: str) -> Column:
    """Type of a JSON field: NULL where there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), path, "variant"))


def ordinal(text: Column, kind: Column) -> Column:
    """An integral number from 1 to 5, or its string; booleans, fractions and others are null."""
    number = F.when(kind != "BOOLEAN", pstrip(text).try_cast("double"))
    return let(number, lambda n: F.when((n == F.floor(n)) & n.between(1, 5), n.cast("int")))


def boolean(text: Column) -> Column:
    """true or false, however written."""
    return let(F.lower(pstrip(text)), lambda t: F.when(t == "true", True).when(t == "false", False))


def string_list(text: Column, kind: Column) -> Column:
    """A list of stripped strings from a list of strings or from one string; a blank string is an empty list."""
    listed = let(F.transform(F.from_json(text, "array<string>"), pstrip), lambda x: F.when(~F.exists(x, lambda i: i.isNull()), x))
    single = let(pstrip(text), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.array(x)))
    return let(kind, lambda k: F.when(k.isin("ARRAY<STRING>", "ARRAY<VOID>"), listed).when(k == "STRING", single))


def confidence(text: Column, kind: Column | None = None) -> Column:
    """1 to 5 from a word, an ordinal, or a probability in [0, 1]; exactly 1 is the ordinal, a boolean is nothing."""
    t = F.lower(pstrip(text))
    number = t.try_cast("double")
    out = F.coalesce(*[F.when(t == w, n) for w, n in CONFIDENCE.items()])
    whole = F.when((number == F.floor(number)) & number.between(1, 5), number.cast("int"))
    share = F.when(number.between(0, 1), F.least(F.lit(5), F.greatest(F.lit(1), F.floor(number * 4 + 0.5).cast("int") + 1)))
    found = F.coalesce(out, whole, share)
    return found if kind is None else F.when(kind != "BOOLEAN", found)


def limited(text: Column, kind: Column, most: int = 60) -> Column:
    """A string of at most `most` words, stripped."""
    return let(text, lambda t: F.when((kind == "STRING") & within_words(t, most), pstrip(t)))


def error_list(types: Column, major: Column) -> Column:
    """Canonical distinct error types: none or other where there are none, none dropped beside others; null if one is
    unknown."""
    named = F.array_distinct(F.filter(F.transform(types, enum_canonical), lambda x: x != ""))
    filled = let(named, lambda t: F.when(F.size(t) == 0, F.array(F.when(major, "other").otherwise("none"))).when(F.size(t) > 1, F.array_remove(t, "none")).otherwise(t))
    return let(filled, lambda t: F.when(F.size(F.array_except(t, F.array(*map(F.lit, ERROR_TYPES)))) == 0, t))


def yes_no(text: Column) -> Column:
    """A human's yes or no, in English or Vietnamese."""
    t = F.lower(pstrip(text))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def _field(body: Column, parsed: Column, name: str) -> tuple[Column, Column]:
    return F.get_json_object(body, f"$.{name}"), F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))


def _verdict(body: Column, fields: dict[str, Column]) -> Column:
    """A struct of the fields and `problem`: what is wrong first, or null. All fields are null where there is a problem."""
    keys, wanted = F.json_object_keys(body), F.array(*map(F.lit, fields))
    schema = F.when(keys.isNull(), "not an object").when((F.size(F.array_except(keys, wanted)) > 0) | (F.size(F.array_except(wanted, keys)) > 0), "schema mismatch")
    found = F.struct(schema.alias("schema"), *[c.alias(name) for name, c in fields.items()])

    def judged(r: Column) -> Column:
        problem = F.coalesce(r["schema"], *[F.when(r[name].isNull(), F.lit(name)) for name in fields])
        return let(problem, lambda p: F.struct(*[F.when(p.isNull(), r[name]).alias(name) for name in fields], p.alias("problem")))

    return let(found, judged)


def reference_verdict(body: Column) -> Column:
    """A reference's verdict from its JSON: exactly the five fields, a known label, five claims at most, confidence 1 to
    5, evidence and reason of 60 words at most; `problem` names the first that fails."""
    def strict(body: Column, parsed: Column) -> Column:
        get = lambda name: _field(body, parsed, name)
        (label, label_kind), claims = get("label"), string_list(*get("unsupported_claims"))
        return _verdict(body, {
            "label": F.when((label_kind == "STRING") & label.isin(*REFERENCE_LABELS), label),
            "unsupported_claims": F.when(F.size(claims) <= 5, claims),
            "evidence": limited(*get("evidence")),
            "confidence": confidence(*get("confidence")),
            "reason": limited(*get("reason")),
        })

    return let(body, lambda b: let(F.try_parse_json(b), lambda parsed: strict(b, parsed)))


def candidate_verdict(body: Column) -> Column:
    """A candidate's verdict from its JSON: exactly the eight fields, four scores from 1 to 5, a boolean, known error
    types, evidence and reason of 60 words at most; `problem` names the first that fails."""
    def strict(body: Column, parsed: Column) -> Column:
        get = lambda name: _field(body, parsed, name)
        text, kind = get("major_error")
        return let(F.when(kind.isin("BOOLEAN", "STRING"), boolean(text)), lambda major: _verdict(body, {
            **{f: ordinal(*get(f)) for f in SCORE_FIELDS},
            "major_error": major,
            "error_types": error_list(string_list(*get("error_types")), major),
            "evidence": limited(*get("evidence")),
            "reason": limited(*get("reason")),
        }))

    return let(body, lambda b: let(F.try_parse_json(b), lambda parsed: strict(b, parsed)))
