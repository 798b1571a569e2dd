import random

from tessellar.operators import graph

EDGE = "source string, target string, relation string"


def least_way(edges, start, target, most):
    """The least of all shortest ways, by lists of whole ways."""
    ways, seen = {start: []}, {start}
    for _ in range(most):
        new = {}
        for node, way in ways.items():
            for e in edges:
                for a, b in ((e[0], e[1]), (e[1], e[0])):
                    if a == node and b not in seen:
                        new[b] = min(new.get(b, [("~",)]), way + [e])
        if target in new:
            return new[target]
        seen |= set(new)
        ways = new
    return []


def test_the_least_of_all_shortest_ways(spark):
    """Two-sided walks give the way that a walk over whole lists gives: many ties, several relations between two nodes, loops, both directions."""
    rng = random.Random(11)
    for n, m in ((9, 16), (30, 45)):
        edges = sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice("xyz")) for _ in range(m)})
        frame = spark.createDataFrame(edges, EDGE)
        for start, target, most in (("n0", "n1", 6), ("n2", f"n{n - 1}", 6), ("n3", "n4", 2)):
            got = [(r.source, r.target, r.relation) for r in graph.trace(frame, start, target, most).orderBy("hop").collect()]
            assert got == least_way(edges, start, target, most), (start, target)


def test_both_ends_walk_less_far(spark):
    """Two trees of three branches joined at their roots: leaves of each meet after a fraction of what one side would visit."""
    edges = [(f"{t}{(i - 1) // 3}", f"{t}{i}", "x") for t in "ab" for i in range(1, 121)] + [("a0", "b0", "x")]
    frame = spark.createDataFrame(edges, EDGE)
    ahead, back = graph.two_sided(graph._ordered(frame), "a100", "b100", 9)
    assert len(ahead) + len(back) - 2 == 9
    visited = sum(layer.count() for layer in ahead + back)
    assert visited < 242 / 2
    assert len(graph.trace(frame, "a100", "b100", 9).collect()) == 9 and graph.trace(frame, "a100", "b100", 8).collect() == []
