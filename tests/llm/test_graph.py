"""Components against union-find, at once and in two parts."""

import random

from cartulary.llm.graph import components, merged


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    expected = {(x, find(x)) for x in parent}
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert {tuple(r) for r in components(frame(links)).collect()} == expected
    assert {tuple(r) for r in merged(components(frame(links[:50])), frame(links[50:-1])).select("node", "component").collect()} == expected
    assert components(frame([])).count() == merged(components(frame([])), frame([])).count() == 0
