import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldnorm.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, size int, h int"


def rows():
    rng = np.random.default_rng(4)
    out = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", "hot" if i < 200 else f"s{i % 7}", 1, 2) for i in range(500)]
    out += [(600, None, None, None, None, None), (601, "a\tb\x0bc d", None, None, None, None), (None, "x y", "en", "s1", 1, 1)]
    out += [(700, "r r r", "en", "tiny", 1, 1)] * 4 + [(800, "long " * 30_000, "en", "s2", 1, 1), (900, "", "en", "none", 1, 1)]
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(size, weights):
    total, capped = sum(size), set()
    while True:
        free = [i for i in range(len(size)) if i not in capped]
        rest = total - sum(3 * size[i] for i in capped)
        t = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if t[i] > 3 * size[i]]
        if not over:
            return [3 * size[i] if i in capped else t[i] for i in range(len(size))]
        capped |= set(over)


def test_sizes_and_targets(spark):
    data = rows()
    mixed = mixing.mix(spark.createDataFrame(data, SCHEMA), block_words=64, shard_blocks=32)
    got = mixed.select("doc_id", "source", "size", "source_size", "target", mixing.taken().alias("taken")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, words(t)) for d, t, *_ in data)
    names = sorted({r[3] for r in data if r[3] is not None}) + [None]
    size = [sum(words(r[1]) for r in data if r[3] == s) for s in names]
    want = brute_targets(size, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, n, t in zip(names, size, want):
        own = [r for r in got if r.source == s]
        assert all(r.source_size == n and r.target == pytest.approx(t) for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 0.5
    assert all(r.taken <= 3 * r.size for r in got)


def test_pieces_tile_what_is_taken_and_shards_hold_their_quota(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    mixed = mixing.mix(df, block_words=64, shard_blocks=32)
    dealt = mixing.deal(mixed).collect()
    total = mixed.agg(F.sum("size")).first()[0]
    assert abs(sum(r.words for r in dealt) - total) <= 20
    blocks = {(r.source, r["pass"], r.block, r.shard) for r in dealt}
    per = np.bincount([s for *_, s in {(r.source, r.block, r.shard) for r in dealt}])
    assert len(per) == -(-per.sum() // 32) and per.max() - per.min() <= 1
    assert len({(s, b) for s, _, b, _ in blocks}) == len({(s, b, k) for s, _, b, k in blocks})  # a block is in one shard
    covered = {}
    for r in dealt:
        covered.setdefault((r.doc_id, r.source, r["pass"]), []).append((r.first, r.words))
    for k, v in covered.items():
        if k[0] not in (700, None):
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:]))


def test_reruns_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = (sorted(map(str, mixing.mix(d).select("doc_id", "source", "size", "target", mixing.taken()).collect()))
            for d in (df, df.repartition(9)))
    assert a == b


def test_splitting_tree_is_exact():
    rng = np.random.default_rng(2)
    quota, capacity = np.array([500, 30, 0, 270]), np.array([100] * 8)
    q = mixing.split_quotas(quota, capacity, rng)
    assert (q.sum(0) == quota).all() and (q.sum(1) == capacity).all() and (q >= 0).all()
    many = np.mean([mixing.split_quotas(quota, capacity, rng)[3] for _ in range(300)], axis=0)
    assert np.allclose(many, quota / 8, atol=1.5)


def test_whole_documents_and_empty_table(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mixing.mix_documents(df)
    assert out.schema == df.schema
    took = out.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("w")).collect()
    plan = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    longest = {s: max(words(r[1]) for r in rows() if r[3] == s) for s in plan}
    assert all(abs(r.w - plan[r.source]) <= longest[r.source] for r in took)
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_dealt_mix_is_what_documents_are_summed_from(spark):
    df = spark.createDataFrame(rows() + [(950, "", "en", "none", 1, 1)] * 3, SCHEMA)
    mix, held = mixing.dealt(df, block_words=64, shard_blocks=32)
    got, pieces = held.collect(), mix.collect()
    want = mixing.mix(df, block_words=64, shard_blocks=32).select(
        "doc_id", "source", "size", "source_size", "target", mixing.taken().alias("taken"), F.size("pieces").alias("n_pieces"), "shards")
    assert sorted(map(str, got)) == sorted(map(str, want.collect())) and len(got) == df.count()
    assert sum(r.taken for r in got) == sum(r.words for r in pieces)
    per = np.bincount([s for r in got for s in r.shards])
    assert len(per) > 3 and per.tolist() == np.bincount([r.shard for r in pieces]).tolist()
    order = [(r.shard, r.place) for r in pieces]
    assert order == sorted(order) and len({(r.source_no, r.begin, r["pass"], r.first) for r in pieces}) == len(pieces)


def test_query_shows_the_shards_of_the_dealt_mix(spark):
    from yieldnorm.llm import queries
    got = queries.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    assert all(len(r.shards) == r.n_pieces and (r.n_pieces > 0) == (r.taken > 0) for r in got)
    assert any(r.shards for r in got)


def test_large_draws_have_the_hypergeometric_law(monkeypatch):
    """The draws by binomials, with numpy's limit lowered, against numpy's own draws: mean, spread and range."""
    cases = [(700, 300, 400), (50, 4000, 1000), (5, 5, 3), (2000, 2000, 3900), (1, 999, 500), (300, 300, 40)]
    for good, bad, n in cases:
        want = np.random.default_rng(1).hypergeometric(good, bad, n, 20_000)
        with monkeypatch.context() as m:
            m.setattr(mixing, "DRAW_LIMIT", 0)
            rng = np.random.default_rng(2)
            got = np.array([mixing.draw_good(good, bad, n, rng) for _ in range(20_000)])
        assert got.min() >= max(0, n - bad) and got.max() <= min(good, n)
        error = want.std() / np.sqrt(len(got))
        assert abs(got.mean() - n * good / (good + bad)) < 5 * error + 1e-9
        assert abs(got.std() - want.std()) < 0.04 * want.std() + 1e-9
        top = max(got.max(), want.max()) + 1
        a, b = (np.cumsum(np.bincount(x, minlength=top)) / len(x) for x in (got, want))
        assert np.abs(a - b).max() < 0.025  # Kolmogorov-Smirnov at about 1e-5


def test_a_plan_of_three_thousand_million_blocks():
    rng = np.random.default_rng(3)
    quota = np.array([2_000_000_000, 999_999_999, 1, 0, 400_000_000], np.int64)
    total = int(quota.sum())
    capacity = np.full(7, total // 7) + (np.arange(7) < total % 7)
    split = mixing.split_quotas(quota, capacity, rng)
    assert (split.sum(0) == quota).all() and (split.sum(1) == capacity).all() and split.min() >= 0
    share = quota / total
    spread = np.sqrt(capacity[0] * share * (1 - share))
    assert (np.abs(split - np.outer(capacity, share)) <= 6 * spread + 1).all()
    plan = mixing.make_plan(["a", "b"], [9 * 10 ** 12, 4 * 10 ** 12], shard_blocks=10 ** 8)
    assert plan.blocks.sum() > 3 * 10 ** 9 and (plan.quota.sum(0) == plan.blocks).all()
    again = mixing.make_plan(["a", "b"], [9 * 10 ** 12, 4 * 10 ** 12], shard_blocks=10 ** 8)
    assert (again.quota == plan.quota).all()
