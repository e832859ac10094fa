"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bitplane, conversation_repair, decontam, hilbert, langid, log_templates, mixing, periodic_runs,
               piece_encoding, quality, simhash, substring_dedup, warc_index)
from .common import table

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup(docs)
    return out.select("doc_id", "text", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), "removed")


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_index.capture_index(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured",
                      "offset", "length", "range_no", "place")


def op3_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shards(table(spark, sf_dir, "documents"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "window_start", "edits", "end")


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs", "shares")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.withColumn("prob", F.round("prob", 9))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "rule", "kept")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return groups.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.audit(rows, conversation_repair.damage(rows))


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = piece_encoding.encode(docs, piece_encoding.read_model(tokenizer_path(PIECE_MODEL)), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.collapse(periodic_runs.with_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    text = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = out.select("doc_id", "runs", "collapsed", longest.alias("top"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_warc_index, op3_log_templates, op4_bitplane_ids, op5_hilbert_shards, op6_decontamination,
    op7_language_mixture, op8_mixing, op9_quality_rules, op10_simhash_groups, op11_conversation_repair,
    op12_piece_encoding, op13_periodic_runs, pipeline)}

ORACLE_SQL: dict[str, str] = {}
