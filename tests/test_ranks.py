"""Personalised ranks of many queries in blocks of edges, against a calculation vertex by vertex."""

import random
from collections import defaultdict

import pytest

from loomgraph.operators import ranks

LEAST, ROUNDS = 2e-3, 4


@pytest.fixture(scope="module")
def case(spark):
    """Edges around a few hubs, seeds of some queries, and all ranks."""
    r = random.Random(7)
    name = lambda i: f"v{i:03d}"
    edges = [(name(r.randrange(400)), name(r.randrange(400)), float(r.choice((1, 1, 2)))) for _ in range(900)]
    edges += [(name(h), name(i), 1.0) for h in (1, 2, 3) for i in range(400) if r.random() < 0.6]
    seeds = [(q, name(r.randrange(400))) for q in range(12) for _ in range(1 + q % 3)] + [(3, "unknown")]
    weight = defaultdict(float)
    for a, b, w in edges:
        weight[a, b] += w
        weight[b, a] += w
    out, ways = defaultdict(float), defaultdict(list)
    for (a, b), w in weight.items():
        out[a] += w
        ways[a].append((b, w))
    expected = {}
    for q in {q for q, _ in seeds}:
        own = sorted({u for p, u in seeds if p == q})
        mass, kept = {u: 1 / len(own) for u in own}, defaultdict(float)
        for _ in range(ROUNDS):
            following = defaultdict(float)
            for u, m in mass.items():
                kept[u] += 0.15 * m if m >= LEAST else m
                for v, w in ways[u] if m >= LEAST else []:
                    following[v] += 0.85 * m * w / out[u]
            mass = following
        for u, m in mass.items():
            kept[u] += m
        expected |= {(q, u): m for u, m in kept.items()}
    return spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "query_id int, uri string"), set(seeds), expected


def found(frame):
    return {(r["query_id"], r["uri"]): r["rank"] for r in frame.collect()}


@pytest.mark.parametrize("many", [2, 256])
def test_all_wanted_and_best(spark, case, monkeypatch, many):
    edges, seeds, own, expected = case
    monkeypatch.setattr(ranks, "LINK_BLOCK", 700)
    monkeypatch.setattr(ranks, "MANY_LINKS", many)
    links = ranks.Links(edges)
    assert links.blocks > 3
    assert found(ranks.pushed(links, seeds, ROUNDS, least=LEAST)) == pytest.approx(expected, abs=1e-12)
    some = sorted(expected)[::5]
    wanted = spark.createDataFrame([*some, (0, "nowhere")], "query_id int, uri string")
    assert found(ranks.pushed(links, seeds, ROUNDS, least=LEAST, wanted=wanted)) == pytest.approx({x: expected[x] for x in some}, abs=1e-12)
    among = {u for _, u in expected if u[-1] in "02468"}
    for k in (3, 30, 1000):
        best = {}
        for q in {q for q, _ in expected}:
            rows = sorted((-round(m, 12), u) for (p, u), m in expected.items() if p == q and u in among and (q, u) not in own)[:k]
            best |= {(q, u): -m for m, u in rows}
        assert found(ranks.pushed(links, seeds, ROUNDS, least=LEAST, among=spark.createDataFrame([(u,) for u in among], "uri string"), k=k)) == pytest.approx(best, abs=2e-12)
    links.drop()


def test_nothing(spark, case):
    edges, seeds, _, _ = case
    assert ranks.pushed(edges.limit(0), seeds.limit(0)).count() == 0
    assert found(ranks.pushed(edges.limit(0), seeds.where("uri = 'unknown'"))) == pytest.approx({(3, "unknown"): 0.15})


@pytest.mark.parametrize("many", [2, 256])
def test_pair_distances(spark, case, monkeypatch, many):
    """One to three steps, against a search from each end, over blocks of edges made once for many calls."""
    edges = case[0].unionByName(spark.createDataFrame([("v001", "v001", 1.0), *((f"w{i}", f"w{i + 1}", 1.0) for i in range(5)), ("w5", "v002", 1.0)], case[0].schema))
    ways = defaultdict(set)
    for a, b, _ in edges.collect():
        ways[a].add(b)
        ways[b].add(a)
    r = random.Random(3)
    names = [*sorted(ways), "unknown"]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(300)] + [("v001", x) for x in names] + [(x, y) for x in names if x[0] == "w" for y in names]
    expected = {}
    for a, b in pairs:
        reached = {a}
        for steps in (1, 2, 3):
            reached = reached | {y for x in reached for y in ways[x]}
            if a != b and b in reached:
                expected.setdefault((a, b), steps)
    assert {*expected.values()} == {1, 2, 3} and len(expected) < len({x for x in pairs if x[0] != x[1]})
    monkeypatch.setattr(ranks, "LINK_BLOCK", 700)
    monkeypatch.setattr(ranks, "MANY_LINKS", many)
    monkeypatch.setattr(ranks, "PAIRED_BLOCK", 40)
    given = spark.createDataFrame(pairs, "a string, b string")
    links = ranks.Links(edges)
    for way in (links, edges):
        assert {(x["a"], x["b"]): x["distance"] for x in ranks.pair_distances(way, given).collect()} == expected
    assert ranks.pair_distances(links, given.limit(0)).count() == 0
    links.drop()
    assert ranks.pair_distances(edges.limit(0), given).count() == 0


def test_pair_distances_of_hubs(spark):
    """Ends with 3,000 neighbours each, none in common: their neighbours aren't paired (9 million rows for a pair, 810 million in all)."""
    hubs = [(f"h{i}", f"n{i}_{j}", 1.0) for i in range(10) for j in range(3000)]
    links = ranks.Links(spark.createDataFrame([*hubs, ("n0_7", "n1_9", 1.0), ("n1_5", "n2_5", 1.0)], "src string, dst string, weight double"))
    pairs = spark.createDataFrame([(f"h{i}", f"h{j}") for i in range(10) for j in range(10) if i != j], "a string, b string")
    expected = {("h0", "h1"): 3, ("h1", "h0"): 3, ("h1", "h2"): 3, ("h2", "h1"): 3}
    assert {(x["a"], x["b"]): x["distance"] for x in ranks.pair_distances(links, pairs).collect()} == expected
    links.drop()
