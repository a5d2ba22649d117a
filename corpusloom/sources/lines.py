"""Line-oriented text: pairs of lines and the interleaved corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import pstrip


def pair_lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pair, source, target): a text's lines two by two, blank ones removed first, an odd last one dropped."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), pstrip), lambda x: x != "")
    every = rows.select(id_col, lines.alias("__l")).where(F.size("__l") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__l") / 2).cast("int") - 1), lambda k: F.struct(k.cast("long").alias("pair"), F.get("__l", 2 * k).alias("source"), F.get("__l", 2 * k + 1).alias("target")))
    return every.select(id_col, F.explode(pairs).alias("p")).select(id_col, "p.*")


def write_interleaved(pairs: DataFrame, path: str, ordinal: str, source: str = "source", target: str = "target") -> None:
    """A text corpus of source and target lines in turn; line ends inside a text become spaces."""
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    lines = pairs.select(ordinal, F.posexplode(F.array(flat(F.col(source)), flat(F.col(target)))))
    lines.repartitionByRange(ordinal).sortWithinPartitions(ordinal, "pos").select(F.col("col").alias("value")).write.text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, score) of a vocabulary's tab-separated lines, quotes as they are."""
    return spark.read.csv(path, sep="\t", quote="", schema="piece string, score double")
