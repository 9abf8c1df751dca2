import random

import pytest

from marginflow.llm.common import checkpointed, components, gapless_rank


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [],
    [(1, 1), (None, 2), (3, None)],
    [(i, i + 1) for i in range(40)],
    [(7, i) for i in range(40)] + [(100, 101), (101, 100), (100, 101)],
    [(random.Random(1).randrange(0, 60), random.Random(i).randrange(0, 60)) for i in range(50)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == brute(edges)


def test_gapless_rank(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(1000), i) for i in range(500)] + [("a", 5, 999)] * 3
    df = spark.createDataFrame(rows, "g string, o long, i long")
    out = gapless_rank(df, ["g"], ["o", "i"], "rank", buckets=7).collect()
    assert len(out) == len(rows)
    for g in ("a", "b", None):
        assert sorted(x.rank for x in out if x.g == g) == list(range(sum(x[0] == g for x in rows)))
    assert gapless_rank(df.limit(0), ["g"], ["o"], "rank").count() == 0


def test_checkpoint_needs_a_shared_folder(spark):
    assert checkpointed(spark.range(3)).count() == 3
