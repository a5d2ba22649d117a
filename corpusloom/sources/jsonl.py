"""JSON Lines: strict, tolerant and issue-collecting scans that know line numbers, and sinks.

Files are read in Spark's own splits, and a line keeps its file and number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, last, ended): lines of all files; line ends are LF or CR LF, a leading BOM is dropped.

    Files are read in Spark's own splits. A line's number is its place in its split, plus the lines of the splits before
    it; whether the file ends with a line end is told by its size. So no file is ever one row.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = raw.groupBy("file", "start", "size").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    blocks = blocks.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("all"), (F.col("size") - F.sum("bytes").over(whole)).isin(0, 3).alias("ended"))  # the reader drops a BOM, 3 bytes
    numbered = raw.withColumn("rn", F.row_number().over(Window.partitionBy("file", "start").orderBy("at"))).join(blocks, ["file", "start"])
    line = F.col("before") + F.col("rn")
    text = F.regexp_replace("value", "\r$", "")
    return numbered.select("file", line.cast("long").alias("line"), F.when(line == 1, F.regexp_replace(text, "^\ufeff", "")).otherwise(text).alias("text"), (line == F.col("all")).alias("last"), "ended")


def rewrite(spark: SparkSession, source: str, target: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Read JSON Lines strictly, change the rows, write them to a new path; the source is never overwritten."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a rewrite needs a path of its own")
    write_jsonl(change(read_jsonl(spark, source, schema).drop("file", "line")), target)


def lines_of(rows: DataFrame, name: str, body: str) -> DataFrame:
    """The same from rows that hold a file's text."""
    parts = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n")
    ended = F.element_at(parts, -1) == ""
    kept = F.when(ended, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    out = rows.select(name, ended.alias("ended"), kept.alias("__l")).select(name, "ended", F.size("__l").alias("__n"), F.posexplode("__l").alias("pos", "text"))
    return out.select(name, (F.col("pos") + 1).cast("long").alias("line"), "text", (F.col("pos") + 1 == F.col("__n")).alias("last"), "ended")


#: How a JSON value may begin.
BEGIN = r'^[ \t\r\n]*[{\["0-9tfnNI-]'


def whole_json(text: Column | str) -> Column:
    """Whether a text is one JSON value and nothing else; repeated keys, NaN and Infinity pass, unpaired surrogates don't.

    Spark's parsers stop after the first value. So the text is read as an element of a list and as a field of an object:
    what stands behind a value would have to go on in both, and nothing does.
    """
    t = F.col(text) if isinstance(text, str) else text

    def reads(before: str, after: str) -> Column:
        parsed = F.from_json(F.concat(F.lit(before), t, F.lit(after)), "a string, bad string", {"columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false"})
        return parsed["bad"].isNull()

    paired = F.regexp_replace(t, r"\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", " ")
    return t.rlike(BEGIN) & reads('{"a":[', "]}") & reads('{"a":', "}") & ~paired.rlike(r"\\u[dD][89a-fA-F]")


def judged(lines: DataFrame) -> DataFrame:
    """Lines with their issue: BLANK_LINE, INVALID_JSON, NOT_JSON_OBJECT, or null."""
    blank = F.trim("text") == ""
    issue = F.when(blank, "BLANK_LINE").when(~F.coalesce(whole_json("text"), F.lit(False)), "INVALID_JSON").when(~F.col("text").rlike(r"^[ \t\r\n]*\{"), "NOT_JSON_OBJECT")
    return lines.withColumn("issue", issue)


def scan(lines: DataFrame, schema: str | StructType, torn_tail: bool = False) -> DataFrame:
    """Rows of a strict scan: blank lines are skipped, any other bad line makes the job fail and names its place.

    With `torn_tail` a bad last line that no line end closes is dropped, as an interrupted writer leaves it.
    """
    rows = judged(lines).where("issue is null or issue <> 'BLANK_LINE'")
    if torn_tail:
        rows = rows.where(~(F.col("issue").isNotNull() & F.col("last") & ~F.col("ended")))
    where = F.concat(F.col("issue"), F.lit(" in line "), F.col("line").cast("string"), F.lit(" of "), F.col(lines.columns[0]).cast("string"))
    good = F.when(F.col("issue").isNotNull(), F.raise_error(where)).otherwise(F.col("text"))
    return rows.select(lines.columns[0], "line", F.from_json(good, schema).alias("r")).select(lines.columns[0], "line", "r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, torn_tail: bool = False, non_empty: bool = False) -> DataFrame:
    """Strict scan of files; with `non_empty` files without a row raise."""
    rows = scan(numbered_lines(spark, path), schema, torn_tail)
    if non_empty and rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, issue) of the bad lines of files."""
    return judged(numbered_lines(spark, path)).where("issue is not null").select("file", "line", "issue")


def written(df: DataFrame) -> Column:
    """A row as compact JSON, null fields included."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact JSON Lines; null fields are written, so rows keep their schema. The commit protocol makes it atomic."""
    write_lines(df.select(written(df)), path, mode)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One column of lines as text files."""
    lines.write.mode(mode).text(path)


def verified(df: DataFrame, path: str) -> DataFrame:
    """What a JSON Lines folder lacks of df, and has beyond it: no rows if it holds df exactly."""
    back = df.sparkSession.read.schema(df.schema).json(path)
    return df.exceptAll(back).withColumn("problem", F.lit("missing")).union(back.exceptAll(df).withColumn("problem", F.lit("unexpected")))


def write_document(rows: DataFrame, path: str) -> None:
    """A small report as one pretty JSON document, UTF-8 with a final line end, written through Spark's file system.

    A file that is there already makes it fail.
    """
    text = json.dumps([json.loads(r[0]) for r in rows.select(written(rows)).collect()], ensure_ascii=False, indent=2) + "\n"
    put_file(rows.sparkSession, path, text)


def put_file(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file through Spark's file system."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
