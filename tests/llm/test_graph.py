"""Links are shortened to stars in as few rounds as they need, and keep their components at any time."""

import random

from tallyforge.llm import graph


def roots(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def test_components_after_any_number_of_rounds(spark):
    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 520)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a long, b long")
    for rounds in (0, 1, 2):
        links, settled = graph.shortened(df, rounds)
        assert not settled and roots([(r.a, r.b) for r in links.collect()]) == roots(edges)
    assert {r.id: r.component for r in graph.components(df).collect()} == roots(edges)


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(graph, "_with_least", None)
    df = spark.createDataFrame([(k, k % 7) for k in range(7, 60)] + [(8, 8), (9, 2), (None, 3)], "a long, b long")
    assert {r.id: r.component for r in graph.components(df).collect()} == {k: k % 7 for k in range(60)}
    assert graph.components(df.limit(0)).count() == 0


def test_a_round_is_a_shuffle_for_each_operation_unless_there_are_hubs(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 130)] + [(129, 200), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    links, most, settled = graph._shape(df.selectExpr("greatest(a, b) a", "least(a, b) b"))
    assert (links, most, settled) == (len(edges), 29, False)
    plan = graph._round(df, links, most)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in plan
    # with hubs the same components
    plain = {r.id: r.component for r in graph.components(df).collect()}
    monkeypatch.setattr(graph, "HUB_LINKS", 3)
    monkeypatch.setattr(graph, "HUBS", 1000)
    assert plain == roots(edges) == {r.id: r.component for r in graph.components(df).collect()}
