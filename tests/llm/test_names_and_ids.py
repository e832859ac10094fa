"""Extra columns with the operators' own helper names, repeated ids, and dimensions of long strings."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import common, decontam, hilbert, log_templates, mixing, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
HELPERS = ["_doc", "_hit", "_flags", "_file", "_at", "_f", "_of", "_n", "_all", "_before", "_rank", "_curve", "__curve", "_bad", "_prob",
           "_c_source", "_c_lang", "_c_topic", "_p_source", "_p_lang", "_p_topic", "_first", "_nth", "_key", "_fp", "_row"]


@pytest.fixture(scope="module")
def named(spark):
    docs = common.table(spark, SF, "documents")
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})


OPERATORS = {
    "dedup": lambda d: substring_dedup.dedup(d),
    "templates": lambda d: log_templates.drop_templates(d),
    "shards": lambda d: hilbert.shards(d),
    "leaks": lambda d: decontam.drop_leaks(d, common.table(d.sparkSession, SF, "benchmark")),
    "sample": lambda d: mixing.sample(d),
    "simhash": lambda d: simhash.keep_first(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_with_helper_names_keep_their_values(named, name):
    out = OPERATORS[name](named)
    assert set(named.columns) <= set(out.columns)
    rows = out.select("doc_id", *HELPERS).collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS)
    plain = OPERATORS[name](named.drop(*HELPERS))
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.select("doc_id").collect())


def test_repeated_ids_are_told_apart_by_their_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight", "un deux trois quatre cinq six")
    rows = [(1, a), (3, a), (3, b), (3, b), (None, a), (None, c), (None, None), (2, None)]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
                 if r.text is not None)
    assert got == [(0, c), (1, a), (3, b)]
    left = [r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.text is None]
    assert left == [2]


def test_long_common_prefixes_still_order_a_dimension(spark):
    df = spark.range(1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("https://the-same-long-prefix.example/site"), (F.col("id") % 8).cast(
        "string")).alias("source"), F.lit("en").alias("lang"), F.lit("x").alias("text"), F.lit(1).alias("n_chars"))
    where = defaultdict(set)
    for r in hilbert.shards(df, 8).select("source", "shard").collect():
        where[r.source].add(r.shard)
    assert len(where) == 8 and all(len(s) <= 2 for s in where.values())


def test_string_cuts_part_the_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.format_string("v%04d", "id")).alias("v"))
    cuts = hilbert.string_cuts(df, "v", 4)
    values = sorted(r.v for r in df.collect() if r.v is not None)
    assert cuts == [values[len(values) * k // 4 - 1 if len(values) * k % 4 == 0 else len(values) * k // 4] for k in (1, 2, 3)]
    assert hilbert.string_cuts(df.limit(0), "v", 4) == []
