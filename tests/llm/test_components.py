import random

from argentum.llm.components import connected


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(40)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5), (7, 6), (6, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found) == {x for a, b in edges if a != b for x in (a, b)}
    for a in found:
        assert found[found[a]] == found[a]
    pairs = {(found[x], find(x)) for x in found}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
