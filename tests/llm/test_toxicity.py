import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from yieldnorm.llm import toxicity

SF01 = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    docs = docs.withColumn("x", F.lit(1)).withColumn("half", F.lit("no"))
    out = toxicity.classify(docs, labels)
    assert out.count() == docs.count()
    r = out.join(labels, "doc_id").filter("held_out").agg(
        F.sum(F.col("predicted") * F.col("toxic")) / F.sum("toxic"), F.sum(F.col("predicted") * F.col("toxic")) / F.sum("predicted")).first()
    assert r[0] >= 0.85 and r[1] >= 0.9


def test_counts_equal_brute_force(spark):
    data = [("Bad bad good", 1, 0), ("good day", 0, 0), ("day, bad!", 0, 1), ("", 1, 1)]
    got = {r.bucket: r for r in toxicity.count_words(spark.createDataFrame(data, "text string, y int, half int")).collect()}
    h, _ = toxicity.words(np.frombuffer(b"bad good day", np.uint8), np.array([0, 12]))
    bad, good, day = (got[int(x % np.uint64(toxicity.BUCKETS))] for x in h)
    assert [(r.n00, r.n01, r.n10, r.n11) for r in (bad, good, day)] == [(0, 1, 1, 0), (1, 0, 1, 0), (1, 1, 0, 0)]
    assert bin(bad.seen & (2**64 - 1)).count("1") <= 3 and len(got) == 3


def test_class_models_are_distributions():
    n, seen = np.zeros(50), np.zeros(50, np.int64)
    n[:4], seen[:4] = [9, 1, 2, 0], [7, 1, 3, 1]
    shared = toxicity.continuation(seen)
    assert np.isclose(shared.sum(), 1) and np.isclose(np.exp(toxicity.class_log(n, shared)).sum(), 1)


def test_normalised_equals_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 5, 40, 1, 200, 0]
    row = np.repeat(np.arange(6), sizes)
    e = rng.normal(size=len(row))
    got = toxicity.normalised(e, row, 6, 32)
    for k, n in enumerate(sizes):
        x = e[row == k]
        best = max((x[i:i + 32].sum() / 32 for i in range(max(1, n - 31))), default=0) if n else 0
        assert np.allclose(got[k], [x.mean() if n else 0, best])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x " * 50_000), (3, "x " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 1), (5, 0)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in toxicity.classify(docs, labels.filter("false")).collect()} == {0.0}
    assert toxicity.classify(docs.filter("false"), labels).count() == 0


def test_words_do_not_cross_rows():
    data = pa.array(["ab", "cd", None, "Éa b"])
    got = [(i, j, len(h), row.tolist()) for i, j, h, row in toxicity.lowered(data)]
    assert got == [(0, 4, 4, [0, 1, 3, 3])]


def test_every_word_has_counts_of_its_own(spark):
    n = 3000  # two of these words are equal modulo 2**20
    data = [(" ".join(f"w{i}" for i in range(n)), 0, 0), (" ".join(f"a{i} z" for i in range(200)), 1, 0)]
    got = {r.bucket: r for r in toxicity.count_words(spark.createDataFrame(data, "text string, y int, half int")).collect()}
    text = b"z " + b" ".join(b"w%d" % i for i in range(n))
    h, _ = toxicity.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(h % np.uint64(1 << 20))) < n + 1 and len(got) == n + 201
    z, *ws = (got[int(x % np.uint64(toxicity.BUCKETS))] for x in h)
    assert z.seen == 200 and all((r.n00, r.n10, r.seen) == (1, 0, 1) for r in ws)


def test_joined_words_score_as_broadcast_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("-1L doc_id", "null text", "lang", "source", "n_chars"))
    whole, some, none = ({(r.doc_id, round(r.score, 6)) for r in toxicity.classify(docs, labels, max_bytes=m).collect()}
                         for m in (toxicity.MODEL_BYTES, 20 * 2000, 0))
    assert whole == some == none and len({s for _, s in whole}) > 50
