"""The last stage of the pipeline lays the documents out in the order of the mix."""

import contextlib
import io
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from storelake.llm.mixing import mix_sources

SF = "/root/testdata/sf0.001"


def test_tokens_follow_the_mix(spark, tmp_path):
    rows = [(100 * s + i, f"word{i} " * (1 + i % 7), name) for s, (name, n) in enumerate({"a": 40, "b": 15, "c": 5}.items()) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = cp.mix(spark, docs, SF)
    mix.write.parquet(f"{tmp_path}/mix")
    wanted = [r.doc_id for r in mix_sources(docs).orderBy("slot", "offset").collect()]
    for x in (mix, spark.read.parquet(f"{tmp_path}/mix")):
        got = cp.tokens(spark, x, SF).orderBy("position").collect()
        assert [r.doc_id for r in got] == wanted and [r.position for r in got] == list(range(60))
        assert [r.first_token for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(60)]
    other = cp.tokens(spark, docs.orderBy(F.desc("doc_id")), SF).orderBy("position").collect()
    assert [r.doc_id for r in other] == sorted(wanted, reverse=True)


def test_ids_are_not_shuffled(spark, tmp_path):
    rows = [(i, f"word{i} " * (1 + i % 7), "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartitionByRange(4, "doc_id").write.parquet(f"{tmp_path}/mix")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables of any size
    try:
        out = cp.tokens(spark, spark.read.parquet(f"{tmp_path}/mix"), SF)
        with contextlib.redirect_stdout(io.StringIO()) as said:
            out.explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plan = said.getvalue()
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert "Scan parquet" in plan and not [m for m in moved if re.search(r"\bids#", m)]
