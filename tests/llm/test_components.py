import numpy as np
import pytest

from yieldnorm.llm.components import components


def brute(edges):
    of = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(of)):
        for a, b in edges:
            if a != b:
                of[a] = of[b] = min(of[a], of[b])
    return of


@pytest.mark.parametrize("edges", [
    [], [(3, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(99, i) for i in range(40)] + [(1000, 2000)],
    [tuple(map(int, e)) for e in np.random.default_rng(5).integers(0, 120, (80, 2))] * 2])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)
