import numpy as np

from yieldnorm.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, row string, n_links int"


def planted(rng, dim=64):
    data = []
    for g in range(60):
        base = rng.normal(size=dim)
        for c in range(int(rng.integers(1, 6))):
            v = base + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.27, 0.4])
            data.append((len(data), v.astype(np.float32).tolist(), int(g % 4), "r", 1))
    same = rng.normal(size=dim).astype(np.float32).tolist()
    data += [(2000 + i, same, 1, "r", 1) for i in range(30)] + [(3000, same, None, "r", 1), (3001, same, 2, "r", 1), (None, same, 1, "r", 1)]
    data += [(3100, None, 1, "r", 1), (3101, [0.0] * dim, 1, "r", 1), (3102, [float("nan")] + same[1:], 1, "r", 1),
             (3103, [None] + same[1:], 1, "r", 1), (3104, [], 1, "r", 1), (3105, same[:32], 1, "r", 1), (3106, same[:32], 1, "r", 1)]
    return data + [(3200, same, 3, "r", 1)] * 2


def brute(data):
    ok = [v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v) and y is not None for _, v, y, *_ in data]
    n, links, of = len(data), [0] * len(data), list(range(len(data)))
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and data[i][2] == data[j][2] and len(data[i][1]) == len(data[j][1]):
                a, b = np.array(data[i][1], float), np.array(data[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    x, y = of[i], of[j]
                    of = [y if z == x else z for z in of]
    least = {}
    for k, c in enumerate(of):
        least[c] = min((x for x in (least.get(c), data[k][0]) if x is not None), default=None)
    return [(d[0], m, least[c]) for d, m, c in zip(data, links, of)]


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    data = planted(np.random.default_rng(6))
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    want = sorted(map(str, brute(data)))
    got = embed_dedup.near_duplicates(df).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)  # large buckets take several blocks
    monkeypatch.setattr(embed_dedup, "GROUP_ROWS", 50)
    got = embed_dedup.near_duplicates(df).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == want


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.93 share a bucket."""
    rng = np.random.default_rng(2)
    a, z = rng.normal(size=(3000, 64)), rng.normal(size=(3000, 64))
    a = embed_dedup.unit(a)
    z = embed_dedup.unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * z
    x, y = embed_dedup.buckets(a), embed_dedup.buckets(b)
    hit = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)])
    assert hit.mean() >= 0.99
    far = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, x[::-1])])
    assert far.mean() < 0.05


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = embed_dedup.hadamard(x)
    assert np.allclose((x ** 2).sum(1), (y ** 2).sum(1)) and np.allclose(embed_dedup.hadamard(y), x)


def test_empty_table(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
