"""Iterative ranks and distances over edges: PageRank, personalised PageRank for one or many queries, breadth-first search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Cut
from .retrieval import _read, _written, top

#: the iterations end when a round moves less than this in all
TOLERANCE = 1e-6
MOST_ROUNDS = 200
#: edges of a block, about, when mass is pushed; edges of a vertex in a block from which on they are looked up last. Both change the work only.
LINK_BLOCK, MANY_LINKS = 1_200_000, 256
#: first ends of pairs in a block, at most, and in a block that is made to keep cores busy, at least
PAIRED_BLOCK, LEAST_PAIRED = 2048, 64


def _both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    return edges.select("src", "dst", *columns).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))


def _shares(edges: DataFrame, undirected: bool) -> tuple[DataFrame, DataFrame]:
    """(src, dst, share) of all edges of a pair together, and (src, out)."""
    e = edges.withColumn("w", F.col("weight").cast("double")).select("src", "dst", "w")
    e = (_both_ways(e, "w") if undirected else e).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("out"))
    return e.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), out


def pagerank(edges: DataFrame, damping: float = 0.85, seeds: DataFrame | None = None, undirected: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """(uri, rank) over weighted (src, dst, weight) edges, iterated until a round moves less than `tolerance` in all.

    Without seeds every vertex is a start, with seeds (uri) those among the vertices are, evenly. The mass of vertices without outgoing
    edges goes to the starts; that is the same as to let it go and scale all ranks to 1 in the end. `undirected` follows every edge both ways; its steps have real
    eigenvalues between -damping and damping, so Chebyshev's weights do in 25 rounds what takes 85 otherwise. A round is one join and one aggregation on 8-byte
    numbers. Contributions are pre-aggregated per task before they are shuffled, so a vertex with a third of all edges does no harm. Vertices are the ends of
    edges; without any there are no rows.
    """
    shares, _ = _shares(edges, undirected)
    links = Cut(shares)
    ids = Cut(links.df.select(F.explode(F.array("src", "dst")).alias("uri")).distinct().select("uri", F.monotonically_increasing_id().alias("id")))
    start = ids.df if seeds is None else ids.df.join(seeds.select("uri").distinct(), "uri", "left_semi")
    n = start.count()
    if not n:
        return ids.df.select("uri", F.lit(0.0).alias("rank")).where("false")
    number = lambda end, name: ids.df.select(F.col("uri").alias(end), F.col("id").alias(name))
    step = Cut(links.df.join(number("src", "id"), "src").join(number("dst", "to"), "dst").select("id", "to", (damping * F.col("share")).alias("share")))
    links.drop()
    first = start.select("id", F.lit(1.0 / n).alias("start"))
    state = Cut(ids.df.select("id").join(first, "id", "left").select("id", F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("start", F.lit(0.0)).alias("rank"), F.lit(0.0).alias("last")))
    nothing = F.lit(0.0)
    pull = 1.0
    for turn in range(MOST_ROUNDS):
        if undirected and turn:
            pull = 1 / (1 - damping**2 / 2) if turn == 1 else 1 / (1 - damping**2 * pull / 4)
        x = state.df
        given = step.df.join(x.select("id", "rank"), "id").select(F.col("to").alias("id"), nothing.alias("start"), nothing.alias("rank"), nothing.alias("last"), (F.col("rank") * F.col("share")).alias("got"))
        both = given.unionByName(x.withColumn("got", nothing)).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("start", "rank", "last", "got")))
        new = pull * ((1 - damping) * F.col("start") + F.col("got") - F.col("last")) + F.col("last") if turn else (1 - damping) * F.col("start") + F.col("got")
        seen = Observation()
        nxt = Cut(both.select("id", "start", new.alias("rank"), F.col("rank").alias("last")).observe(seen, F.sum(F.abs(F.col("rank") - F.col("last"))).alias("moved"), F.sum("rank").alias("mass")))
        state.drop()
        state = nxt
        if seen.get["moved"] < tolerance:
            break
    step.drop()
    return ids.df.join(state.df, "id").select("uri", (F.col("rank") / F.lit(seen.get["mass"])).alias("rank"))


def ranked_documents(ranks: DataFrame, documents: DataFrame, k: int, per_fc: int | None = None) -> DataFrame:
    """(uri, rank, fc): the k documents (uri, fc) of highest rank above 0, at most `per_fc` of each category; of equal ranks the smaller uri.

    Ranks are compared in steps of 1e-12. The best of each category are found in two steps, so no task ranks a whole category.
    """
    found = documents.join(ranks.where("rank > 0"), "uri").select("uri", "rank", "fc")
    if per_fc is not None:
        found = top(found.select(F.col("fc").alias("query_id"), F.col("uri").alias("doc_id"), F.col("rank").alias("score")), per_fc, 12).select(F.col("doc_id").alias("uri"), F.col("score").alias("rank"), F.col("query_id").alias("fc"))
    return found.orderBy(F.round("rank", 12).desc(), "uri").limit(k)


class Links:
    """Undirected weighted edges in blocks by the vertex they lead to, for `pushed`; of use for many calls."""

    def __init__(self, edges: DataFrame):
        ends = Cut(edges.select(F.explode(F.array("src", "dst")).alias("uri")).distinct())
        # numbers in the order of the URIs
        self.ids = Cut(ends.df.orderBy("uri").select("uri", F.monotonically_increasing_id().alias("id")))
        ends.drop()
        number = lambda end: self.ids.df.select(F.col("uri").alias(end), F.col("id").alias(f"{end}_id"))
        coded = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(number("src"), "src").join(number("dst"), "dst")
        coded = Cut(coded.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight"))
        both = _both_ways(coded.df, "weight")
        self.blocks = max(1, -(-2 * coded.df.count() // LINK_BLOCK))
        self.out = Cut(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("out")))
        rows = both.select(F.col("src").alias("u"), F.col("dst").alias("at"), "weight")
        self.packed = Cut(rows.withColumn("block", self.block("at")).groupBy("block").applyInArrow(_packed, _PACKED))
        coded.drop()

    def block(self, at: str):
        return F.pmod(F.xxhash64(at), F.lit(self.blocks)).cast("int")

    def keep(self) -> Links:
        for x in (self.ids, self.out, self.packed):
            x.keep()
        return self

    def exists(self) -> bool:
        return all(x.exists() for x in (self.ids, self.out, self.packed))

    def drop(self) -> None:
        for x in (self.ids, self.out, self.packed):
            x.drop()


def pushed(edges: DataFrame | Links, seeds: DataFrame, rounds: int = 4, damping: float = 0.85, least: float = 1e-4, wanted: DataFrame | None = None, among: DataFrame | None = None, k: int = 0) -> DataFrame:
    """(query_id, uri, rank): personalised PageRank of many queries at once, from the seeds (query_id, uri) of each, evenly.

    Mass is pushed along undirected weighted edges: a visit keeps 1 - damping of it and passes the rest on; what is less than `least` isn't
    passed on and stays, so a query reaches at most 1 / least vertices whatever the size of the graph. What is on its way after `rounds` stays where it is.
    Mass of seeds that are no vertices is left out; seeds count once. With `wanted` (query_id, uri) only these rows are made; with `among` (uri) only the `k` best of them for
    each query, its seeds left out; ranks equal to 12 decimals go to the smaller uri.

    A task adds up what the queries send into a block of edges, and only what is passed on or asked for leaves it.
    """
    links = edges if isinstance(edges, Links) else Links(edges)
    ids, blocks = links.ids.df, links.blocks
    each = seeds.select("query_id", "uri").distinct()
    kind = seeds.schema["query_id"].dataType.simpleString()
    large = (F.col("mass") >= least) & F.lit(rounds > 0)

    def sent(mass: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        return mass.join(links.out.df, "id").select(every, "query_id", F.col("id").alias("at"), (damping * F.col("mass") / F.col("out")).alias("mass"), F.lit(_PUSH).alias("kind"))

    def told(rows: DataFrame, what: int, mass=None) -> DataFrame:
        mass = F.lit(None).cast("double") if mass is None else mass
        return rows.select(links.block("id").alias("block"), "query_id", F.col("id").alias("at"), mass.alias("mass"), F.lit(what).alias("kind"))

    def met(rows: DataFrame, how: str) -> DataFrame:
        return links.packed.df.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_met(how, least, k, MANY_LINKS), f"query_id {kind}, id bigint, mass double")

    n = each.groupBy("query_id").agg(F.count("*").alias("n"))
    begun = Cut(each.join(n, "query_id").join(ids, "uri", "left").select("query_id", "uri", "id", (1.0 / F.col("n")).alias("mass")))
    start = begun.df.where("id IS NOT NULL").select("query_id", "id", "mass")
    moving, cuts = [start], [begun]
    for _ in range(rounds - 1):
        cuts.append(Cut(met(sent(moving[-1].where(large)), "passed")))
        moving.append(cuts[-1].df)
    whole = moving[0]
    for x in moving[1:]:
        whole = whole.unionByName(x)
    # what a vertex got, less what it passed on in all
    passed = Cut(whole.where(large).groupBy("query_id", "id").agg(F.sum("mass").alias("mass")))
    cuts.append(passed)
    rows = sent(passed.df).unionByName(told(passed.df, _BASE, -damping * F.col("mass")))
    if among is not None:
        rows = rows.unionByName(told(start, _BASE, F.lit(float("-inf"))))
        rows = rows.unionByName(told(among.select("uri").distinct().join(ids, "uri").withColumn("query_id", F.lit(None).cast(kind)), _AMONG))
        best = W.partitionBy("query_id").orderBy(F.round("mass", 12).desc(), "id")  # a query has at most k rows of each block
        found = met(rows, "best").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).join(ids, "id").select("query_id", "uri", F.col("mass").alias("rank"))
    else:
        rows = rows.unionByName(told(start, _BASE, F.col("mass")))
        alone = begun.df.where("id IS NULL").select("query_id", "uri", F.when(large, (1 - damping) * F.col("mass")).otherwise(F.col("mass")).alias("rank"))
        if wanted is not None:
            rows = rows.unionByName(told(wanted.select("query_id", "uri").distinct().join(ids, "uri"), _WANTED))
            alone = alone.join(wanted.select("query_id", "uri"), ["query_id", "uri"], "left_semi")
        found = met(rows, "all" if wanted is None else "wanted").join(ids, "id").select("query_id", "uri", F.col("mass").alias("rank")).unionByName(alone)
    result = Cut(found)
    for x in cuts if links is edges else (links, *cuts):
        x.drop()
    return result.df


_PACKED = "block int, us binary, counts binary, at binary, place binary, weight binary"
#: kinds of rows that meet a block: mass passed on from a vertex, what a vertex has before, a vertex whose rank is wanted, a vertex that may be among the best
_PUSH, _BASE, _WANTED, _AMONG = range(4)


def _packed(t: pa.Table) -> pa.Table:
    """The edges (u, at, weight) of a block in one row, each pair once and in the order of both ends: different u with their numbers of edges, different `at`, places among these, weights."""
    ats, place = np.unique(t["at"].to_numpy(), return_inverse=True)
    us, own = np.unique(t["u"].to_numpy(), return_inverse=True)
    pairs, which = np.unique(own.astype(np.int64) * len(ats) + place, return_inverse=True)
    weight = np.bincount(which, weights=t["weight"].to_numpy())
    columns = (us, np.bincount(pairs // len(ats), minlength=len(us)).astype(np.int32), ats, (pairs % len(ats)).astype(np.int32), weight)
    return pa.table([t["block"].slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _met(how: str, least: float, k: int, many_links: int):
    """What the rows of each query add up to in a block: `passed` gives what is passed on again, `best` the k best, `wanted` what is asked for, `all` everything.

    Vertices with many edges in the block give little to each. The most that some of them can give together is known beforehand, so they are looked up only for what could
    reach `least` or the k best with it: nothing is left out.
    """

    def run(links: pa.Table, rows: pa.Table) -> pa.Table:
        types = ("int64", "int32", "int64", "int32", "float64")
        us, counts, ats, place, weight = (np.frombuffer(links[c][0].as_py() if links.num_rows else b"", t) for c, t in zip(links.column_names[1:], types))
        kind, at, mass = (rows[c].to_numpy() for c in ("kind", "at", "mass"))
        vertices = np.union1d(ats, at[(kind == _BASE) | (kind == _WANTED)])
        place = np.searchsorted(vertices, ats)[place] if len(place) else place
        barred = ~np.isin(vertices, at[kind == _AMONG]) if how == "best" else None
        first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        most = np.maximum.reduceat(weight, first[:-1]) if len(us) else weight
        coded = rows["query_id"].combine_chunks().dictionary_encode()
        query = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        own = np.searchsorted(us, at)
        known = (kind == _PUSH) & (us[np.minimum(own, max(0, len(us) - 1))] == at) if len(us) else np.zeros(len(at), bool)
        use = np.flatnonzero((query >= 0) & ((kind != _PUSH) | known))
        use = use[np.argsort(query[use], kind="stable")]
        bounds = np.searchsorted(query[use], np.arange(len(coded.dictionary) + 1))
        out_q, out_v, out_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for q in range(len(coded.dictionary)):
            mine = use[bounds[q] : bounds[q + 1]]
            if not len(mine):
                continue
            pushes = mine[kind[mine] == _PUSH]
            p, m = own[pushes], mass[pushes]
            got = np.zeros(len(vertices))
            base = mine[kind[mine] == _BASE]
            np.add.at(got, np.searchsorted(vertices, at[base]), mass[base])
            if barred is not None:
                got[barred] = -np.inf
            many = counts[p] > many_links
            few, n = p[~many], counts[p[~many]].astype(np.int64)
            i = np.repeat(first[few] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got += np.bincount(place[i], weights=np.repeat(m[~many], n) * weight[i], minlength=len(got))
            # of those with many edges, the ones that give least come last
            p, m = p[many], m[many]
            by = np.argsort(m * most[p], kind="stable")
            p, m = p[by], m[by]
            together = np.cumsum(m * most[p])

            def bound() -> float:
                """What the k-th best has at least."""
                above = got[got > 0]
                return np.partition(above, len(above) - k)[len(above) - k] if len(above) >= k else 0.0

            limit = {"passed": least, "best": bound() if how == "best" else 0.0, "wanted": np.inf, "all": 0.0}[how]
            late = int(np.searchsorted(together, limit / 2, side="right")) if limit > 1e-10 else 0
            for j in range(late, len(p)):
                a, b = first[p[j]], first[p[j] + 1]
                got[place[a:b]] += m[j] * weight[a:b]
            rest = together[late - 1] if late else 0.0
            if how == "wanted":
                v = np.unique(np.searchsorted(vertices, at[mine[kind[mine] == _WANTED]]))
            else:
                floor = {"passed": least, "best": bound() if how == "best" else 0.0, "all": 0.0}[how] - rest - 1e-11
                v = np.flatnonzero((got > 0) & (got >= floor))
            for j in range(late if len(v) else 0):
                a, b = first[p[j]], first[p[j] + 1]
                x = np.minimum(np.searchsorted(place[a:b], v), b - a - 1)
                hit = place[a + x] == v
                got[v[hit]] += m[j] * weight[a + x[hit]]
            v = v[got[v] >= least] if how == "passed" else v[got[v] > 0]
            if how == "best":
                v = v[np.lexsort((v, -np.round(got[v], 12)))[:k]]
            out_q.append(np.full(len(v), q))
            out_v.append(vertices[v])
            out_m.append(got[v])
        q, v, m = (np.concatenate(x) for x in (out_q, out_v, out_m))
        return pa.table([coded.dictionary.take(pa.array(q)), pa.array(v), pa.array(m)], names=["query_id", "id", "mass"])

    return run


def distances(edges: DataFrame, sources: DataFrame, depth: int = 3, targets: DataFrame | None = None) -> DataFrame:
    """(uri, distance): fewest undirected steps from any of the sources (uri), up to `depth`; with targets (uri) for these only, -1 for those farther off."""
    both = _both_ways(edges)
    seen = Cut(sources.select("uri", F.lit(0).alias("distance")).distinct())
    for k in range(1, depth + 1):
        last = seen.df.where(F.col("distance") == k - 1).select(F.col("uri").alias("src"))
        new = both.join(last, "src", "left_semi").select(F.col("dst").alias("uri")).distinct().join(seen.df.select("uri"), "uri", "left_anti")
        nxt = Cut(seen.df.unionByName(new.select("uri", F.lit(k).alias("distance"))))
        seen.drop()
        seen = nxt
    if targets is None:
        return seen.df
    return targets.select("uri").distinct().join(seen.df, "uri", "left").select("uri", F.coalesce("distance", F.lit(-1)).alias("distance"))


def pair_distances(edges: DataFrame | Links, pairs: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs (a, b) that are one to three undirected steps apart.

    A block of edges holds the neighbours in it of every vertex. The neighbours of each `a` are listed once; in each block, the vertices next to any of them are marked once for
    all pairs of `a`, and the neighbours of each `b` there are looked up among the marks. So neighbours of both ends are never paired, whatever hubs the ends and the vertices
    between them are. Pairs are read from the shared folder by every block, and neither they nor edges are shuffled.
    """
    links = edges if isinstance(edges, Links) else Links(edges.select("src", "dst", F.lit(1.0).alias("weight")))
    number = lambda end: links.ids.df.select(F.col("uri").alias(end), F.col("id").alias(f"{end}_id"))
    p = Cut(pairs.select("a", "b").where("a <> b").distinct().join(number("a"), "a").join(number("b"), "b"))
    asked = Cut(p.df.groupBy("a_id").agg(F.collect_list("b_id").alias("bs")))
    n, cores = asked.df.count(), links.packed.df.sparkSession.sparkContext.defaultParallelism
    qs = max(1, -(-n // PAIRED_BLOCK), min(-(-2 * cores // links.blocks), n // LEAST_PAIRED))

    def met(rows: DataFrame, run, schema: str) -> DataFrame:
        blocks = rows.withColumn("qb", F.pmod(F.xxhash64("a_id"), F.lit(qs)).cast("int")).groupBy("qb").applyInArrow(_asked, "qb int, asked binary")
        # a product without a shuffle: a task streams its blocks of edges and holds its blocks of pairs
        each = links.packed.df.select("us", "counts", "at", "place").crossJoin(Cut(blocks).df.repartitionByRange(qs, "qb").hint("shuffle_replicate_nl"))
        return each.mapInArrow(run, schema)

    near = met(asked.df.select("a_id"), _next_to, "a_id bigint, xs array<bigint>").groupBy("a_id").agg(F.flatten(F.collect_list("xs")).alias("xs"))
    least = met(asked.df.join(near, "a_id"), _steps(MANY_LINKS), "a_id bigint, b_id bigint, distance int").groupBy("a_id", "b_id").agg(F.min("distance").alias("distance"))
    return p.df.join(least, ["a_id", "b_id"]).select("a", "b", "distance")


def _asked(rows: pa.Table) -> pa.Table:
    return pa.table([rows["qb"].slice(0, 1).cast(pa.int32()), pa.array([_written(rows.drop_columns(["qb"]))], pa.binary())], names=["qb", "asked"])


class _Adjacent:
    """The edges of a block, and the vertices of its other ends by place."""

    def __init__(self, us: bytes, counts: bytes, at: bytes, place: bytes, many: int = 0):
        self.us, self.counts, self.at, self.place = (np.frombuffer(x, t) for x, t in ((us, "int64"), (counts, "int32"), (at, "int64"), (place, "int32")))
        self.first, self.many = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64))), many

    def own(self, ids: np.ndarray) -> np.ndarray:
        """Places of the vertices among those with edges here, -1 for others."""
        return _found(self.us, ids)

    def places(self, own: int) -> np.ndarray:
        return self.place[self.first[own] : self.first[own + 1]]

    def _few(self, own: np.ndarray) -> np.ndarray:
        n = self.counts[own].astype(np.int64)
        return self.place[np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def mark(self, marks: np.ndarray, own: np.ndarray) -> None:
        """Marks what is next to any of `own`."""
        many = self.counts[own] > self.many
        marks[self._few(own[~many])] = True
        for j in own[many]:
            marks[self.places(j)] = True

    def meets(self, marks: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of `own` are next to a mark."""
        many = self.counts[own] > self.many
        out, few = np.zeros(len(own), bool), np.flatnonzero(~many)
        out[few] = np.bincount(np.repeat(np.arange(len(few)), self.counts[own[few]]), weights=marks[self._few(own[few])], minlength=len(few)) > 0
        for i in np.flatnonzero(many):
            at = self.places(own[i])
            # most often one of the first is marked
            out[i] = marks[at[: self.many + 1]].any() or marks[at[self.many + 1 :]].any()
        return out


def _found(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def _blocks(batches, many: int = 0):
    for b in batches:
        for i in range(b.num_rows):
            yield _Adjacent(*(b.column(c)[i].as_py() for c in ("us", "counts", "at", "place")), many), _read(b.column("asked")[i])


def _listed(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins and ends."""
    column = t[name].combine_chunks()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], ends))


def _next_to(batches):
    """What is next to each vertex in a block, if anything is."""
    for block, asked in _blocks(batches):
        ids = asked["a_id"].to_numpy()
        own = block.own(ids)
        ids, own = ids[own >= 0], own[own >= 0]
        for low in range(0, len(own), 256):
            found = [block.at[block.places(j)] for j in own[low : low + 256]]
            lists = pa.LargeListArray.from_arrays(np.cumsum([0, *(len(x) for x in found)]), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + 256]), lists.cast(pa.list_(pa.int64()))], names=["a_id", "xs"])


def _steps(many: int):
    """Steps between both ends of each pair by way of what a block holds, if there are three at most."""

    def run(batches):
        for block, asked in _blocks(batches, many):
            ids, (xs, x_first), (bs, b_first) = asked["a_id"].to_numpy(), _listed(asked, "xs"), _listed(asked, "bs")
            own_a, own_x, own_b, at_b = block.own(ids), block.own(xs), block.own(bs), _found(block.at, bs)
            one, two = np.zeros(len(block.at), bool), np.zeros(len(block.at), bool)
            steps = np.zeros(len(bs), np.int32)
            for q in range(len(ids)):
                low, high = b_first[q], b_first[q + 1]
                b, at, s = own_b[low:high], at_b[low:high], steps[low:high]
                if own_a[q] >= 0:
                    mine = block.places(own_a[q])
                    one[mine] = True
                    s[(at >= 0) & one[at]] = 1
                    left = np.flatnonzero((s == 0) & (b >= 0))
                    s[left[block.meets(one, b[left])]] = 2
                    one[mine] = False
                left = np.flatnonzero((s == 0) & (b >= 0))
                x = own_x[x_first[q] : x_first[q + 1]]
                x = x[x >= 0]
                if len(left) and len(x):
                    block.mark(two, x)
                    s[left[block.meets(two, b[left])]] = 3
                    two[:] = False
            near = steps > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(b_first))[near]), pa.array(bs[near]), pa.array(steps[near])], names=["a_id", "b_id", "distance"])

    return run
