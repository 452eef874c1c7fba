from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from yieldnorm.llm import minhash

from ..conftest import SF0001


def bag(t):
    w = t.lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def brute(data):
    """Class of each row by all pairs."""
    bags = [bag(t or "") for _, t, *_ in data]
    of = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            equal = (data[i][1] or "").lower() == (data[j][1] or "").lower()
            if of[i] != of[j] and (equal or similarity(bags[i], bags[j]) >= 0.8):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    return of


def planted():
    rng = np.random.default_rng(8)
    vocab = [f"v{i}" for i in range(3000)]
    data = []
    for g in range(12):
        base = list(rng.choice(vocab, int(rng.integers(5, 400))))
        for c in range(int(rng.integers(1, 7))):
            t = [w if rng.random() > 0.004 else "zz%d" % rng.integers(1e6) for w in base]
            data.append((len(data), " ".join(t), "doc"))
    for k in range(30):  # a chain: neighbours are close, ends are not
        base = [f"c{i}" for i in range(200)]
        data.append((len(data), " ".join(base[k * 4:] + [f"d{i}" for i in range(k * 4)]), "chain"))
    data += [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "hi", "x"), (904, "HI", "x"), (905, "hi there", "x"),
             (None, "one two three four five six", "x"), (906, "one two three four five six", "x"), (907, "rep " * 30_000, "x"), (908, "rep " * 30_001, "x")]
    return data + [(950, "same row same row same row", "x")] * 3


def partition(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(v, []).append(k)
    return sorted(sorted(g, key=str) for g in out.values())


def test_classes_equal_brute_force(spark):
    data = planted()
    df = spark.createDataFrame(data, "doc_id long, text string, class_id string").repartition(4)
    got = minhash.classes(df).collect()
    want = brute(data)
    ids = [(r[0], r[1]) for r in data]
    assert len(got) == len(data)
    have = {}
    for r in got:
        have.setdefault(r.doc_id, set()).add(r.class_id)
    assert all(len(v) == 1 for v in have.values())
    least = {}
    for (d, _), c in zip(ids, want):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    assert {d: {least[c]} for (d, _), c in zip(ids, want)} == have
    assert sum(r.kept for r in got) == len(set(want))
    kept = minhash.drop_near_duplicates(df)
    assert kept.schema == df.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)


def test_family_whose_members_lie_about_the_threshold(spark, monkeypatch):
    """A base text and copies, each a little under or over 0.8 of it and far less of each other; small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "GROUP_ROWS", 40)
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(150)]
    data = [(0, " ".join(base))]
    for k in range(1, 90):
        t = list(base)
        for i in rng.choice(150, int(rng.integers(2, 7)), replace=False):
            t[i] = f"x{rng.integers(1e9)}"
        data.append((k, " ".join(t)))
    for rows in (data, data[1:]):  # with and without the base that holds the family together
        got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert partition((r.doc_id, r.class_id) for r in got) == partition(zip((d for d, _ in rows), brute(rows)))


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.classes(docs).collect()
    assert partition((r.doc_id, r.class_id) for r in got) == partition(zip((d for d, _ in data), brute(data)))


def test_signatures_are_unbiased_for_multisets():
    rng = np.random.default_rng(1)
    pairs = []
    for t in range(150):
        a = [f"q{x}" for x in rng.integers(0, 5, 60)]
        b = [w if rng.random() > 0.03 else "zz" for w in a]
        pairs += [f"{t} " + " ".join(a), f"{t} " + " ".join(b)]
    sig = [np.frombuffer(s.as_py(), np.uint8) for s in minhash.sign(pa.array(pairs))]
    agree = [(sig[i] == sig[i + 1]).mean() for i in range(0, 300, 2)]
    true = [similarity(bag(pairs[i]), bag(pairs[i + 1])) for i in range(0, 300, 2)]
    assert abs(np.mean(agree) - np.mean(true)) < 0.015 and np.abs(np.subtract(agree, true)).max() < 0.2


@pytest.mark.parametrize("n,m", [(100, 90), (64, 32), (7, 3)])
def test_signatures_of_weights(n, m):
    """One shingle repeated: similarity is the ratio of the counts."""
    got = []
    for k in range(40):
        a, b = (np.frombuffer(s.as_py(), np.uint8) for s in minhash.sign(pa.array([f"u{k} " * (n + 4), f"u{k} " * (m + 4)])))
        got.append((a == b).mean())
    assert abs(np.mean(got) - m / n) < 0.03


def test_overlap_is_the_plain_one(spark):
    texts = ["a b c d e f a b c d e", "A b c d e f x", "", "a b", "a b", None]
    made = minhash._bag_list(pa.array(texts))
    for i in range(6):
        for j in range(6):
            assert minhash.overlap(made[i], made[j]) == pytest.approx(similarity(bag(texts[i] or ""), bag(texts[j] or "")))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(df).count() == 0 and minhash.drop_near_duplicates(df).count() == 0


def test_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, 1, 2), (2, text.upper(), 3, 4), (3, "other words", 5, 6)],
                               "doc_id long, text string, __n int, __k int")
    more = df.withColumns({c: df["__n"] for c in ("node_", "key_", "times_", "row_", "own_node_", "own_key_")})
    got = minhash.drop_near_duplicates(more)
    assert got.columns == more.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_small_groups_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP_BYTES", 500)
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.classes(docs).collect()
    assert partition((r.doc_id, r.class_id) for r in got) == partition(zip((d for d, _ in data), brute(data)))
