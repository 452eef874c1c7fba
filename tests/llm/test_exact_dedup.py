import hashlib

import pytest

from yieldnorm.llm import exact_dedup
from yieldnorm.llm.common import LOWER, UPPER

SCHEMA = "doc_id long, text string, digest string, n int"
NORM = str.maketrans(UPPER, LOWER)


def rows():
    out = [(i, "Same Text", "d", 1) for i in range(40)] + [(100 + i, "other É", None, None) for i in range(7)]
    out += [(200, "other é", "x", 2), (201, None, "x", 2), (202, "", "x", 2), (None, "same text", "x", 2)]
    out += [(300, "twice", "a", 1)] * 3 + [(None, "no id", "a", 1)] * 2
    return out + [(400 + i, f"single {i}", "s", i) for i in range(30)]


def brute(data):
    groups = {}
    for r in data:
        groups.setdefault((r[1] or "").translate(NORM), []).append(r)
    out = []
    for t, g in groups.items():
        ids = [r[0] for r in g]
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(g), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out, groups


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("heavy,tracked", [(1000, 4096), (2, 8)])
def test_marks_equal_brute_force(spark, heavy, tracked):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = exact_dedup.mark_duplicates(df, heavy=heavy, tracked=tracked).collect()
    want, groups = brute(data)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("heavy,tracked", [(1000, 4096), (2, 8)])
def test_drop_keeps_one_row_of_each_text_with_all_columns(spark, heavy, tracked):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = exact_dedup.drop_duplicates(df, heavy=heavy, tracked=tracked)
    assert got.schema == df.schema
    _, groups = brute(data)
    kept = {(r.text or "").translate(NORM): r.doc_id for r in got.collect()}
    assert got.count() == len(groups) == len(kept)
    assert kept == {t: max((r[0] for r in g if r[0] is not None), default=None) for t, g in groups.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.mark_duplicates(df).count() == 0
    assert exact_dedup.drop_duplicates(df).count() == 0


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for out in (exact_dedup.mark_duplicates(df), exact_dedup.drop_duplicates(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
