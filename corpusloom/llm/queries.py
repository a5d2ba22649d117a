"""The queries of the training-data operators: each applies its operator to its whole table and returns all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, ballkmeans, bpe, huffman, langid, merkle, mixing, packing, quality, resampling, secrets, simhash, warc
from corpusloom.llm.oracles import ORACLES as ORACLES
from corpusloom.runtime import scratch, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, keep_text=False)
    return both.select("doc_id", *bpe.with_digests(both))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read(spark, path, payload=False))
    own = [F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to"]
    return captures.select("page_id", *own, F.col("request.target_uri").alias("request_uri"), F.col("metadata.payload_bytes").alias("metadata_bytes"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, keep_text=False)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    huffman.save_documents(table(spark, sf_dir, "documents"), path, end_id=2)
    return huffman.read_checksums(spark, path)


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_decisions(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(F.encode(secrets.written(base), "UTF-8"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"), live)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"))
    return packing.place_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ballkmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballkmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_ann, op2_quality, op3_simhash, op4_bpe, op5_warc, op6_langid, op7_token_files, op8_merkle, op9_mixing, op10_secrets, op11_packing, op12_resampling, op13_ballkmeans)}
