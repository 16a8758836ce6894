import random

from veritome.llm.components import connected_components


def test_components_of_paths_stars_and_pairs(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 3), (50, 40)] + [(300, 300 + i) for i in range(1, 40)]
    edges += [(a, b) for a, b in ((200 + random.randrange(60), 200 + random.randrange(60)) for _ in range(40)) if a != b]
    random.shuffle(edges)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
