"""Registered queries: contract columns, SQL twins, and the pipeline against plain Python."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from yieldnorm.llm import queries
from yieldnorm.plans.sizing import materialize

from ..conftest import SF0001
from .test_exact_dedup import NORM
from .test_minhash import brute

COLUMNS = {
    1: "doc_id:bigint held_out:boolean score:double predicted:int", 2: "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    3: "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    4: "doc_id:bigint keep_id:bigint group_size:bigint kept:boolean text_sha256:string",
    5: "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean", 6: "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    7: "doc_id:bigint component_id:bigint kept:boolean", 8: "doc_id:bigint held_out:boolean score:double predicted:int",
    9: "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    10: "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    11: "anchor_id:bigint positive_id:bigint rank:int negative_id:bigint positive_score:bigint negative_score:bigint",
    12: "lang:string rank:bigint phrase:string a:bigint l:bigint r:bigint n:bigint score:bigint",
    13: "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string"}
BY_NUMBER = {int(n[2:].split("_")[0]): n for n in queries.QUERIES}


def test_each_operator_has_one_query():
    assert BY_NUMBER.keys() == COLUMNS.keys() == set(range(1, 14)) and len(queries.QUERIES) == 13
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_contract_columns(spark, n):
    types = dict(entry.queries()[BY_NUMBER[n]](spark, SF0001).dtypes)
    for c in COLUMNS[n].split():
        name, kind = c.split(":")
        assert types[name] == kind


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF0001)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_workers_of_the_pipeline_get_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text")).repartition(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    try:
        spark.conf.set(key, "1m")
        corpus_pipeline.STAGES[1][1](spark, docs, "")
        assert spark.conf.get(key) == "1m"  # the session's own limit stays
        spark.conf.unset(key)
        corpus_pipeline.STAGES[1][1](spark, docs, "")
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 20_000_000 and max(got) <= 8 << 20
    finally:
        spark.conf.set(key, had) if had is not None else spark.conf.unset(key)


def test_pipeline_stages(spark):
    docs, kept = spark.read.parquet(f"{SF0001}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF0001), name)
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    scored = queries.op1_quality(spark, SF0001).collect()
    assert sorted(r.doc_id for r in kept["quality"]) == sorted(r.doc_id for r in scored if r.predicted)
    best = {}
    for r in kept["quality"]:
        best[r.text.translate(NORM)] = max(r.doc_id, best.get(r.text.translate(NORM), -1))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(best.values())
    data = [(r.doc_id, r.text) for r in kept["exact_dedup"]]
    least = {}
    for (d, _), c in zip(data, brute(data)):
        least[c] = min(d, least.get(c, d))
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted(least.values())
    times, texts = {}, {r.doc_id: r.text for r in kept["near_dedup"]}
    for r in kept["mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == texts[r.doc_id]
    assert max(times.values()) <= 3
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r.text.split()) for r in kept["mixing"]) - total) < 0.25 * total
    starts = {}
    for r in kept["packing"]:
        if r.start == 0:
            starts[r.doc_id] = starts.get(r.doc_id, 0) + 1
    assert starts == times
