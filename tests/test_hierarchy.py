import random

from loomgraph.operators import hierarchy


def brute(links):
    parent = {}
    for h, c, p in links:
        if c is not None and p is not None:
            parent[h, c] = min(p, parent.get((h, c), p))
    nodes = {(h, x) for h, c, p in links if c is not None and p is not None for x in (c, p)}
    out = {}
    for h, n in nodes:
        chain = [n]
        while (h, chain[-1]) in parent and parent[h, chain[-1]] not in chain:
            chain.append(parent[h, chain[-1]])
        if (h, chain[-1]) not in parent:
            out[h, n] = ("tree", chain[-1], len(chain) - 1, tuple(reversed(chain)))
        else:
            at = chain.index(parent[h, chain[-1]])
            out[h, n] = ("below_cycle" if at else "cycle", min(chain[at:]), at, tuple(reversed(chain[: at + 1])))
    return out


def check(spark, links):
    frame = spark.createDataFrame(links, "hierarchy string, child string, parent string")
    nodes = hierarchy.resolve(frame.withColumn("depth", frame["child"])).cache()  # depth clashes with a result column
    expected = brute(links)
    assert {(r["hierarchy"], r["node"]): (r["state"], r["root_node"], r["depth"]) for r in nodes.collect()} == {k: v[:3] for k, v in expected.items()}
    assert {(r["hierarchy"], r["node"]): tuple(r["path"]) for r in hierarchy.paths(nodes).collect()} == {k: v[3] for k, v in expected.items()}
    below = {(h, a, n) for (h, n), v in expected.items() for a in v[3][:-1]}
    pairs = [(r["hierarchy"], r["ancestor"], r["descendant"]) for r in hierarchy.nested_pairs(nodes).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == below


def test_trees_cycles_and_repeats(spark):
    rng = random.Random(5)
    links = [("a", f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 60)]  # one tree with many levels
    links += [("a", "c1", "c2"), ("a", "c2", "c3"), ("a", "c3", "c1"), ("a", "d1", "c2"), ("a", "d2", "d1"), ("a", "self", "self"), ("a", "e", "self")]
    links += [("b", "n1", "n0"), ("b", "n1", "n0"), ("b", None, "n0"), ("b", "n9", None)]
    links += [("b", f"k{i}", "hub") for i in range(80)] + [("b", "hub", "n1")]  # a hub with most of the rows
    links += [("c", f"z{i}", f"z{i + 1}") for i in range(70)]  # a chain
    check(spark, links)


def test_two_parents_take_the_smaller(spark):
    check(spark, [("a", "x", "p2"), ("a", "x", "p1")])


def test_empty(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "hierarchy string, child string, parent string")).count() == 0


def test_links_decode_terms_and_leave_out_unnamed_ends(spark):
    props = spark.createDataFrame([("h", "P89_falls_within", "subject"), ("h", "P89i_contains", "object")], "hierarchy string, predicate_local string, child_end string")
    rows = [
        ("<u:a>", "http://x/P89_falls_within", "u:b"), ("u:a", "https://x#p89_FALLS_within", "u:b"), ("u:b", "http://x/P89i_contains", "u:a"),
        ("u:a", "http://x/P89_falls_within", None), ("u:a", "http://x/P89_falls_within", ""), ("_:b1", "http://x/P89_falls_within", "u:b"), ("u:a", "http://x/other", "u:c"), (None, None, None),
    ]
    found = hierarchy.links(spark.createDataFrame(rows, "subject string, predicate string, object string"), props).collect()
    assert [tuple(r) for r in found] == [("h", "u:a", "u:b")]
