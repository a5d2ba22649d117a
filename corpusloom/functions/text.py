"""Scalar text functions as Column expressions; only NFC leaves the JVM, and only for texts that need it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.runtime import bound_batches

#: White space as str.split() and str.strip() see it, for Java patterns.
UWS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NOT_UWS = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
#: The same, spelled out.
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
URL = r"(?:https?://|www\.)\S+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """Unicode NFC. Texts of ASCII alone, the common case, are NFC already and aren't sent to Python, which gets the others in
    batches of bounded size: the session's Arrow batches are set to it."""
    bound_batches(SparkSession.active())
    other = col(c).rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfc(F.when(other, col(c))), col(c))


def is_nfc(c: Column | str) -> Column:
    return ~col(c).rlike(r"[^\x00-\x7f]") | (nfc(c) == col(c))


def pstrip(c: Column | str) -> Column:
    """Strip all Unicode white space from both ends (trim() knows the space alone); only the ends are looked at."""
    return F.btrim(col(c), F.lit(WHITE))


def clean_text(c: Column | str) -> Column:
    """Backspaces removed, then NFC."""
    return nfc(F.replace(col(c), F.lit("\b"), F.lit("")))


def normalize_metric(c: Column | str) -> Column:
    """NFC, lower case, white space collapsed and stripped; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(nfc(c)), f"{UWS}+", " ")), F.lit(""))


def normalize_corpus(c: Column | str) -> Column:
    """NFC, URLs to a space, white space collapsed and stripped, case kept; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(nfc(c), r"[\r\n\t]+", " "), URL, " "), f"{UWS}+", " ")), F.lit(""))


def words(c: Column | str) -> Column:
    """Words between Unicode white space."""
    return F.regexp_extract_all(col(c), F.lit(f"{NOT_UWS}+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    """Number of words, long; null has none."""
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("long")


def has_words(c: Column | str, n: int) -> Column:
    """Whether a text has n words, told from its first ones alone; null has none."""
    return F.coalesce(col(c).rlike(rf"\A(?:{UWS}*+{NOT_UWS}++){{{n}}}"), F.lit(False))


def tokens(c: Column | str) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"{WORD}+"), F.lit(0))


def token_text(c: Column | str) -> Column:
    """The tokens() with a space between them, without taking each out by itself."""
    return F.trim(F.regexp_replace(F.lower(col(c)), F.lit(WORD.replace("[", "[^", 1) + "+"), F.lit(" ")))


def has_control(c: Column | str) -> Column:
    return col(c).rlike(CONTROL)


def has_outer_space(c: Column | str) -> Column:
    return col(c).rlike(rf"\A{UWS}|{UWS}\z")


def has_replacement(c: Column | str) -> Column:
    return F.contains(col(c), F.lit("�"))


def full_match(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(rf"\A(?:{pattern})\z")


def joined_key(*parts: Column | str) -> Column:
    """Parts joined by "|"; a null part is empty instead of vanishing, so keys can't run together."""
    return F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def stable_seed(*parts: Column | str) -> Column:
    """First 8 bytes of the parts' SHA-256, unsigned, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(joined_key(*parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def record_key(task: Column | str, sample: Column | str, anon: Column | str, version: Column | str, model: Column | str, run: Column | str) -> Column:
    """Key of a score record; a missing run is "main"."""
    return joined_key(task, sample, anon, version, model, F.coalesce(col(run), F.lit("main")))


def redact_url(c: Column | str) -> Column:
    """A fingerprint in place of a URL: 12 hex digits of its host's SHA-256; without host a constant."""
    host = F.nullif(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    return F.when(host.isNotNull(), F.concat(F.lit("host-"), F.substring(F.sha2(F.lower(host), 256), 1, 12))).otherwise(F.lit("host-unknown"))


def within_words(c: Column | str, limit: int = 60) -> Column:
    return word_count(c) <= limit


def enum_canonical(c: Column | str) -> Column:
    """Stripped, lower case, hyphens and spaces as underscores."""
    return F.translate(F.lower(pstrip(c)), "- ", "__")


def without_fence(c: Column | str) -> Column:
    """The inside of a fenced code block, or the text itself, stripped."""
    return pstrip(F.regexp_replace(F.regexp_replace(pstrip(c), r"\A```(?:json|JSON)?", ""), r"```\z", ""))


def first_filled(*columns: Column | str) -> Column:
    """The first column that isn't blank, stripped; null if all are."""
    return F.coalesce(*[F.nullif(pstrip(c), F.lit("")) for c in columns])


def sample_id(given: Column | str, split: Column | str, line: Column | str) -> Column:
    """An id as it is given, or, where it is empty or missing, its split and line."""
    return F.coalesce(F.nullif(col(given).cast("string"), F.lit("")), F.concat_ws("_", col(split), col(line).cast("string")))


def config_id(beams: Column | str, penalty: Column | str, ngram: Column | str) -> Column:
    """Name of a decoding setting, as beam4_lp1.1_nr3; one beam is greedy."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", col(penalty).cast("double")), r"0+$", ""), r"\.$", "")
    return F.when(col(beams) == 1, F.lit("greedy")).otherwise(F.concat(F.lit("beam"), col(beams).cast("string"), F.lit("_lp"), short, F.lit("_nr"), col(ngram).cast("string")))


def without_prefixes(c: Column | str) -> Column:
    """A parameter name without wrapper prefixes, however often they stand there."""
    return F.regexp_replace(col(c), r"^(?:module\.|_orig_mod\.)+", "")


def unit_hash(*parts: Column | str) -> Column:
    """48-bit number of the parts' MD5, the same on any engine; draws are taken modulo from it."""
    return F.conv(F.substring(F.md5(joined_key(*parts)), 1, 12), 16, 10).cast("long")


def nfc_stripped(c: Column | str) -> Column:
    """NFC and strip alone, before words are counted for a ratio; null becomes empty."""
    return F.coalesce(pstrip(nfc(c)), F.lit(""))


def segmented(c: Column | str, words: Callable[[Column], Column] | None = None) -> Column:
    """Tokens of a text by any segmentation that gives a list, of which those with a letter, digit or underscore stay;
    without one, the plain tokens."""
    return tokens(c) if words is None else F.filter(words(F.lower(col(c))), lambda w: w.rlike(WORD))


def utc_stamp(at: Column | None = None) -> Column:
    """A moment, or now, as 2026-01-31T12:00:00.000000Z."""
    moment = F.current_timestamp() if at is None else at
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
