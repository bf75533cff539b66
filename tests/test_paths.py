"""Flows by layers against listed paths, earliest matches against all pairs, and hubs."""

import random

import pytest

from tidewatch.operators import graph, motifs

EDGE = "src string, dst string, kind string, amount_minor long"


def links_of(edges, seed, depth):
    """The links on simple paths of at most depth edges from seed, by listing the paths."""
    hop = {}
    for a, b in edges:
        if a != b:
            hop.setdefault(a, set()).add(b)
    found, todo = set(), [(seed,)]
    while todo:
        path = todo.pop()
        found |= {(a, b) for a, b in zip(path, path[1:])}
        if len(path) <= depth:
            todo += [(*path, b) for b in hop.get(path[-1], ()) if b not in path]
    return found


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6])
def test_links_are_those_of_listed_paths(spark, depth):
    for seed, (nodes, n) in enumerate([(6, 14), (12, 26), (9, 50)]):
        r = random.Random(seed)
        edges = [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(n)] + [(f"n{i}", f"n{i + 1}") for i in range(3)]
        df = spark.createDataFrame([(a, b, "SENT", 1) for a, b in edges] + [(None, "n1", "SENT", 1), ("n1", None, "SENT", 1)], EDGE)
        seeds = ["n0", "n1", "absent", None]
        got = {(r["seed"], r["src"], r["dst"]) for r in graph.flow_links(df, spark.createDataFrame([(s,) for s in [*seeds, "n0"]], "id string"), depth).collect()}
        assert got == {(s, *x) for s in seeds if s for x in links_of(edges, s, depth)}


def test_a_hub_costs_its_degree(spark):
    """A leaf that sends to a hub of 10,000 leaves, all of which send back and to one sink: 10^8 paths and more, 20,001 links."""
    n = 10_000
    edges = [(f"l{i}", "hub", "SENT", i) for i in range(n)] + [("hub", f"l{i}", "SENT", i) for i in range(n)] + [(f"l{i}", "sink", "CASHED_OUT_TO", 1) for i in range(n)]
    df, seeds = spark.createDataFrame(edges, EDGE), spark.createDataFrame([("l0",)], "id string")
    got = graph.fund_flow(df, seeds)
    # back to the hub no leaf but the first leads, and l0 is where all paths begin
    assert got.count() == 2 + (n - 1) + (n - 1) and got.where("dst = 'hub'").collect()[0]["src"] == "l0"
    top = graph.largest_flows(df, seeds).orderBy("rank").collect()
    assert len(top) == 200 and [(r["src"], r["dst"], r["hop"]) for r in top[:3]] == [("l0", "sink", 1), ("l0", "hub", 1), ("hub", "l9999", 2)]


@pytest.mark.parametrize("strict", [True, False])
def test_first_match_equals_all_pairs(spark, strict):
    r = random.Random(7)
    some = lambda x: None if r.random() < 0.1 else x
    left = [(i, some(r.choice("ab")), r.choice("xy"), some(r.randrange(60))) for i in range(80)]
    right = [(some(r.choice("ab")), r.choice("xy"), some(r.randrange(60)), 1000 + i, r.choice("pq")) for i in range(60)]
    a, b = spark.createDataFrame(left, "id long, k string, j string, t long"), spark.createDataFrame(right, "rk string, rj string, u long, rid long, v string")
    got = {(x["id"], x["u"], x["rid"], x["v"]) for x in motifs.first_match(a, b, {"k": "rk", "j": "rj"}, "t", "u", 9, "rid", ["u", "rid", "v"], strict).collect()}
    want = set()
    for i, k, j, t in left:
        near = [(u, n, v) for rk, rj, u, n, v in right if None not in (k, t, rk, u) and (k, j) == (rk, rj) and t + strict <= u <= t + 9]
        if near:
            want.add((i, *min(near)))
    assert got == want and len(want) > 20
    assert motifs.first_match(a.limit(0), b, {"k": "rk"}, "t", "u", 9, "rid", ["v"]).count() == 0 == motifs.first_match(a, b.limit(0), {"k": "rk"}, "t", "u", 9, "rid", ["v"]).count()
