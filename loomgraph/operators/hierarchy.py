"""Parent-child rows -> full hierarchies: state, root, depth, entry-exit interval, paths and descendants.

Method: peel leaves to expose cycles, then build Euler tours and rank them as lists in parallel.

* Peeling goes in doubling strides: what is left after 2^k layers of leaves were peeled is exactly the set of
  2^k-th ancestors of all nodes, so one self-join of the ancestor map doubles the number of layers peeled. When a
  stride peels nothing, only nodes on cycles are left. Depth costs log2(depth) rounds, not depth rounds.
* Links from a node on a cycle to its parent are cut; every tree then has a root (a node without a parent, or a
  node on a cycle). The Euler tour is a linked list over enter/exit elements (a leaf is one element for both).
* List ranking doubles pointers until every element knows the end of its list, its distance to it and its balance of
  enters and exits. That gives root, depth and the entry-exit interval of every node, in log2(tree size) rounds.
* Ancestors and descendants are pairs of nested intervals. They are found by an equi-join on dyadic blocks of
  positions of bounded size, never by comparing all nodes of a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Cut

#: groups into which the children of one parent are divided for the sibling order
SIBLING_SALTS = 256
#: dyadic blocks have at most 2^LEVELS positions
LEVELS = 10


def links(triples: DataFrame, props: DataFrame) -> DataFrame:
    """Decoded child-parent links (hierarchy, child, parent) of the predicates listed in `props`, each once.

    `triples` needs subject, predicate, object; `props` needs hierarchy, predicate_local, child_end and is small
    metadata of fixed size. Statements with a null, empty or blank-node end make no link. Local names are
    compared without regard to namespace and case.
    """
    from ..functions.terms import decoded, local_key, named

    p = props.select("hierarchy", F.lower("predicate_local").alias("_p"), "child_end").distinct()
    s, o = decoded(F.col("subject")), decoded(F.col("object"))
    t = triples.select(s.alias("_s"), local_key(F.col("predicate")).alias("_p"), o.alias("_o")).where(named(F.col("_s")) & named(F.col("_o")))
    up = F.col("child_end") == "subject"
    return t.join(p, "_p").select("hierarchy", F.when(up, F.col("_s")).otherwise(F.col("_o")).alias("child"), F.when(up, F.col("_o")).otherwise(F.col("_s")).alias("parent")).distinct()


def _numbered(edges: DataFrame) -> tuple[Cut, Cut]:
    """Nodes (id, hierarchy, node) and links (id, pid; null for none) with 64-bit ids in place of names."""
    ends = edges.select("hierarchy", F.col("child").alias("node")).unionByName(edges.select("hierarchy", F.col("parent").alias("node")))
    nodes = Cut(ends.distinct().withColumn("id", F.monotonically_increasing_id()))
    ids = nodes.df
    # one parent at most; of several stated, the smallest name counts
    up = edges.groupBy("hierarchy", "child").agg(F.min("parent").alias("parent"))
    child = up.join(ids.withColumnRenamed("node", "child"), ["hierarchy", "child"]).select("hierarchy", "parent", "id")
    parent = ids.select("hierarchy", F.col("node").alias("parent"), F.col("id").alias("pid"))
    return nodes, Cut(child.join(parent, ["hierarchy", "parent"]).select("id", "pid"))


def _on_cycles(up: DataFrame) -> Cut:
    """Ids on cycles: what leaf peeling leaves."""
    left = Cut(up.select("id", F.col("pid").alias("anc")))
    rows = -1
    while True:
        t = left.df
        kept = t.select(F.col("anc").alias("id")).distinct()
        far = t.select(F.col("id").alias("anc"), F.col("anc").alias("far"))
        # nodes that still have a descendant 2^k links below them, with their ancestor 2^(k+1) links above;
        # a root without links drops out here as it has no row in t
        nxt = Cut(t.join(kept, "id", "left_semi").join(far, "anc").select("id", F.col("far").alias("anc")))
        n = nxt.df.count()
        left.drop()
        left = nxt
        if n == rows or n == 0:
            return left
        rows = n


def _cycle_names(up: DataFrame, cyclic: DataFrame, nodes: DataFrame) -> Cut:
    """(id, cyc): the smallest name on the cycle of each node on one."""
    on = up.join(cyclic.select("id"), "id", "left_semi").join(nodes.select("id", "node"), "id")
    state = Cut(on.select("id", F.col("pid").alias("to"), F.col("node").alias("cyc")))
    while True:
        t = state.df
        ahead = t.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("cyc").alias("cyc2"))
        nxt = Cut(t.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("cyc", "cyc2").alias("cyc"), (F.col("cyc2") < F.col("cyc")).alias("moved")))
        done = nxt.df.where("moved").isEmpty()
        state.drop()
        state = nxt
        if done:
            return state


def _tours(up: DataFrame, cyclic: DataFrame, nodes: DataFrame) -> DataFrame:
    """List elements (e, nxt, cnt, bal). e = 2 id on entering and 2 id + 1 on leaving; the last one has a null nxt.

    cnt counts positions and bal enters minus exits from e up to but without nxt. A leaf has one element of two positions.
    """
    tree = up.join(cyclic.select("id"), "id", "left_anti").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SIBLING_SALTS)))
    in_group = W.partitionBy("pid", "salt").orderBy("id")
    groups = tree.groupBy("pid", "salt").agg(F.min("id").alias("head")).withColumn("after", F.lead("head").over(W.partitionBy("pid").orderBy("salt")))
    first = groups.groupBy("pid").agg(F.min_by("head", "salt").alias("first")).withColumnRenamed("pid", "id")
    placed = tree.withColumn("sib", F.lead("id").over(in_group)).join(groups.select("pid", "salt", "after"), ["pid", "salt"])
    placed = placed.select("id", "pid", F.coalesce("sib", "after").alias("sib"))
    one = nodes.select("id").join(placed, "id", "left").join(first, "id", "left")
    leave = F.coalesce(F.col("sib") * 2, F.col("pid") * 2 + 1)
    leaf = F.col("first").isNull()

    def element(e, nxt, cnt, bal):
        return F.struct(e.alias("e"), nxt.alias("nxt"), F.lit(cnt).cast("long").alias("cnt"), F.lit(bal).cast("long").alias("bal"))

    enter = F.when(leaf, element(F.col("id") * 2, leave, 2, 0)).otherwise(element(F.col("id") * 2, F.col("first") * 2, 1, 1))
    exits = element(F.col("id") * 2 + 1, leave, 1, -1)
    return one.select(F.explode(F.when(leaf, F.array(enter)).otherwise(F.array(enter, exits))).alias("x")).select("x.*")


def _ranked(elements: DataFrame) -> Cut:
    """List ranking by pointer doubling: (e, last, cnt, bal) with cnt and bal from e to the end of its list.

    Each round joins the elements that haven't reached their end with those they point to.
    """
    state = Cut(elements.select("e", "nxt", F.col("e").alias("last"), "cnt", "bal"))
    while True:
        t = state.df
        ahead = t.select(F.col("e").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("last").alias("last2"), F.col("cnt").alias("cnt2"), F.col("bal").alias("bal2"))
        moved = t.where("nxt IS NOT NULL").join(ahead, "nxt").select("e", F.col("nxt2").alias("nxt"), F.col("last2").alias("last"), (F.col("cnt") + F.col("cnt2")).alias("cnt"), (F.col("bal") + F.col("bal2")).alias("bal"))
        nxt = Cut(t.where("nxt IS NULL").unionByName(moved))
        open_ = not nxt.df.where("nxt IS NOT NULL").isEmpty()
        state.drop()
        state = nxt
        if not open_:
            return state


def resolve(edges: DataFrame) -> DataFrame:
    """Every node of the hierarchies stated by (hierarchy, child, parent) rows.

    Columns: hierarchy, node, state (`tree`, `cycle`, `below_cycle`), root_node, depth INT, tree_id BIGINT,
    entry BIGINT, exit BIGINT, n_descendants BIGINT. v lies below u exactly if both have the same tree_id and
    u.entry < v.entry < u.exit. A node on a cycle is the root of the trees hanging from it: its root_node is the
    smallest name on the cycle, as for all nodes below it, depth counts from the first node on the cycle, and
    n_descendants leaves the cycle itself out. Repeated rows count once; of several parents of a node the smallest
    name counts; a link from a node to itself is a cycle of one; rows with a null end make no link. An empty input
    gives no rows. Other columns are ignored.
    """
    held = Cut(edges.where("child IS NOT NULL AND parent IS NOT NULL").select("hierarchy", "child", "parent").distinct())
    nodes, up = _numbered(held.df)
    held.drop()
    cyclic = _on_cycles(up.df)
    names = _cycle_names(up.df, cyclic.df, nodes.df)
    ranks = _ranked(_tours(up.df, cyclic.df, nodes.df))
    up.drop()
    cyclic.drop()
    enters = ranks.df.where("e % 2 = 0").select(F.expr("e div 2").alias("id"), F.expr("last div 2").alias("tree_id"), "cnt", "bal")
    leaves = ranks.df.where("e % 2 = 1").select(F.expr("e div 2").alias("id"), F.col("cnt").alias("left"))
    # tree_id is the root's id; its row gives the length of the whole tour and the root's name
    roots = enters.where("id = tree_id").select("tree_id", F.col("cnt").alias("total"))
    roots = roots.join(nodes.df.select(F.col("id").alias("tree_id"), F.col("node").alias("root_name")), "tree_id")
    roots = roots.join(names.df.select(F.col("id").alias("tree_id"), "cyc"), "tree_id", "left")
    known = nodes.df.join(enters, "id").join(leaves, "id", "left").join(roots, "tree_id")
    entry, exit_ = F.col("total") - F.col("cnt"), F.coalesce(F.col("total") - F.col("left"), F.col("total") - F.col("cnt") + 1)
    state = F.when(F.col("cyc").isNull(), "tree").when(F.col("id") == F.col("tree_id"), "cycle").otherwise("below_cycle")
    return known.select(
        "hierarchy", "node", state.alias("state"), F.coalesce("cyc", "root_name").alias("root_node"), (-F.col("bal")).cast("int").alias("depth"),
        "tree_id", entry.alias("entry"), exit_.alias("exit"), F.expr("((total - coalesce(left, cnt - 1)) - (total - cnt) - 1) div 2").alias("n_descendants"),
    )


def nested_pairs(resolved: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair of `resolve`'s result: hierarchy, ancestor, ancestor_depth, descendant, depth.

    The inside of an ancestor's interval is cut into maximal dyadic blocks of at most 2^LEVELS positions. A node lies
    in LEVELS + 1 dyadic blocks and in at most one of an ancestor's, so an equi-join on (tree, level, block)
    gives each pair once, and no join key has more than 2^LEVELS nodes.
    """
    size = F.expr(f"transform(sequence(0, {LEVELS}), l -> struct(l AS level, entry div shiftleft(1L, l) AS block))")
    inner = resolved.where("depth > 0").select("tree_id", F.col("node").alias("descendant"), "depth", F.explode(size).alias("b")).select("tree_id", "descendant", "depth", "b.*")
    # blocks of level l that lie in [lo, hi) while their parent block doesn't (or doesn't exist)
    lo, hi = "(entry + 1)", "exit"
    pieces = []
    for level in range(LEVELS + 1):
        a, b = f"(({lo} + {2**level - 1}) div {2**level})", f"({hi} div {2**level})"  # whole blocks: [a, b)
        if level == LEVELS:
            pieces.append(f"transform(CASE WHEN {a} < {b} THEN sequence({a}, {b} - 1) ELSE array() END, x -> struct({level} AS level, x AS block))")
            continue
        pa, pb = f"(({lo} + {2 ** (level + 1) - 1}) div {2 ** (level + 1)})", f"({hi} div {2 ** (level + 1)})"
        blocks = f"filter(array({a}, {b} - 1), x -> x >= {a} AND x < {b} AND NOT (x div 2 >= {pa} AND x div 2 < {pb}))"
        pieces.append(f"transform(array_distinct({blocks}), x -> struct({level} AS level, x AS block))")
    outer = resolved.where("n_descendants > 0").select(
        "hierarchy", "tree_id", F.col("node").alias("ancestor"), F.col("depth").alias("ancestor_depth"), F.explode(F.expr(f"concat({', '.join(pieces)})")).alias("b")
    )
    outer = outer.select("hierarchy", "tree_id", "ancestor", "ancestor_depth", "b.*")
    return outer.join(inner, ["tree_id", "level", "block"]).select("hierarchy", "ancestor", "ancestor_depth", "descendant", "depth")


def paths(resolved: DataFrame) -> DataFrame:
    """(hierarchy, node, path): the nodes from the root, or from the first node on the cycle, down to the node itself."""
    above = nested_pairs(resolved).groupBy("hierarchy", F.col("descendant").alias("node")).agg(F.sort_array(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("above"))
    both = resolved.select("hierarchy", "node").join(above, ["hierarchy", "node"], "left")
    up = F.transform(F.col("above"), lambda x: x["ancestor"])
    return both.select("hierarchy", "node", F.concat(F.coalesce(up, F.array().cast("array<string>")), F.array("node")).alias("path"))
