import random

import numpy as np

from webloom.llm.components import connected, forest


def by_hand(links):
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root if top(i) != i}


def graphs():
    rnd = random.Random(1)
    yield [(i, i + 1) for i in range(300)]  # a path
    yield [(0, i) for i in range(1, 500)] + [(1000 + i, 999) for i in range(5)]  # a hub
    for n in (40, 400):
        yield [(rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(n)]
    yield [(5, 5), (5, 5)]


def test_forest():
    for g in graphs():
        a, b = np.array(g).T
        assert dict(zip(*map(list, forest(a, b)), strict=True)) == by_hand(g)
    assert len(forest(np.empty(0, np.int64), np.empty(0, np.int64))[0]) == 0


def test_connected(spark):
    for g in graphs():
        random.Random(2).shuffle(g)
        df = spark.createDataFrame(g, "a long, b long").repartition(5)
        got = [tuple(r) for r in connected(df).collect()]
        assert len(got) == len(dict(got)) and dict(got) == by_hand(g)


def test_connected_with_nulls_and_nothing(spark):
    assert connected(spark.createDataFrame([(None, 1), (1, None)], "a long, b long")).count() == 0
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
