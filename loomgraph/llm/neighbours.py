"""The k most similar vectors of every vector, by multi-index hashing.

Method: binary codes of a learned rotation (principal axes, then iterative quantization) are cut into TABLES substrings, and
each substring is an index of its own. Two codes within a Hamming distance of TABLES - 1 agree in at least one
substring. Probing goes further: a substring whose least certain bit (the one nearest to its threshold) is among the share
PROBED of least certain ones is looked up with that bit flipped as well, so that neighbours on both sides of a threshold meet.
All that meet in a bucket are compared by their floats, whatever the Hamming distance of the rest of their codes, and only the k best
of each bucket travel on.

Unit vectors travel as 24-bit fixed-point numbers, the precision of the fraction of a 32-bit float: a cosine is off by about 5e-8, half of STEP.
They are summed in 64 bits, so that the order of summation changes nothing.

The length of a substring grows as WIDTH * log2 of the number of vectors, so the rows of a bucket grow as a small power of it and
recall holds while the collection grows. A bucket that is too large all the same is cut into chunks, and every pair
of chunks is a cell of its own: nothing is capped, and no task holds more than two chunks. Vectors that many ids share are
searched once, with as many of their ids as can be neighbours.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Cut

TABLES = 3
#: share of the substrings that are looked up under a second key
PROBED = 1 / 3
#: bits of a substring: WIDTH * log2(rows / SPREAD)
WIDTH, SPREAD = 0.75, 20
#: rows that the rotation is fitted on (all rows are indexed)
FIT_ROWS = 8192
#: rows from which a bucket is cut into chunks, unless that made more than HOT_KEYS buckets to be known by every task
CHUNK, HOT_KEYS = 4096, 2**20
#: bytes that a task of the search should read; most tasks
TASK_BYTES, MOST_TASKS = 4 * 2**20, 100_000
SALTS = 64
#: cosines are compared in steps of this size, so that rounding breaks no tie
STEP = 1e-7
NEVER = -(2**62)


def _units(dims: int):
    """(id, embedding) -> (id, vec): unit vectors in 24-bit fixed point; rows without a usable embedding are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            norm = np.linalg.norm(flat, axis=1)
            ok = np.isfinite(norm) & (norm > 0)
            whole = np.rint(flat[ok] / norm[ok, None] * (2**23 - 1)).astype("<i4")
            packed = np.ascontiguousarray(whole.view(np.uint8).reshape(-1, dims, 4)[:, :, :3])
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(3 * dims), len(whole), [None, pa.py_buffer(packed)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), vec], names=["id", "vec"])

    return run


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    n = len(column)
    data = np.frombuffer(b"".join(column.to_pylist()) if n else b"", np.uint8).reshape(n, dims, 3)
    wide = np.zeros((n, dims, 4), np.uint8)
    wide[:, :, 1:] = data  # 256 times the number
    return wide.view("<i4").reshape(n, dims) / (256.0 * (2**23 - 1))


def rotation(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): principal axes rotated so that signs lose as little as possible (iterative quantization)."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ vt).T
    return mean, axes @ turn


class Index:
    """Keys of vectors: (row, table, key) for the substrings of their codes and for the probed ones. Travels to the tasks with the code."""

    def __init__(self, sample: np.ndarray, width: int, probed: float = PROBED):
        self.width = width
        self.mean, self.directions = rotation(sample, width * TABLES)
        margins = np.abs(self._projected(sample)).min(2)
        self.unsure = float(np.quantile(margins, probed)) if margins.size else 0.0

    def _projected(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.mean) @ self.directions).reshape(len(vectors), TABLES, self.width)

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self._projected(vectors)
        own = (p > 0) @ (1 << np.arange(self.width, dtype=np.int64))
        size = np.abs(p)
        rows, tables = np.nonzero(size.min(2) <= self.unsure)
        flipped = own[rows, tables] ^ (np.int64(1) << size.argmin(2)[rows, tables])
        every = np.indices(own.shape).reshape(2, -1)
        return np.concatenate([every[0], rows]), np.concatenate([every[1], tables]), np.concatenate([own.ravel(), flipped])


def _sizes(dims: int, index: Index):
    def run(batches):
        for batch in batches:
            _, t, key = index.keys(_matrix(batch.column(0), dims))
            for table in range(TABLES):
                found, n = np.unique(key[t == table], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), table, np.int32)), pa.array(found), pa.array(n.astype(np.int64))], names=["t", "key", "n"])

    return run


def _spread(dims: int, index: Index, hot: np.ndarray, chunks: np.ndarray):
    """(id, vec) -> (t, key, cell, side, id, vec): a row per key, in cut buckets a row per cell of its chunk.

    `hot` are the sorted TABLES * key + t of the cut buckets, `chunks` their numbers of chunks. side tells the two chunks of a cell apart, -1 if there is one.
    """

    def run(batches):
        for batch in batches:
            rows, t, key = index.keys(_matrix(batch.column(1), dims))
            code = key * TABLES + t
            at = np.searchsorted(hot, code)
            cut = np.zeros(len(code), bool)
            inside = at < len(hot)
            cut[inside] = hot[at[inside]] == code[inside]
            c = np.ones(len(code), np.int64)
            c[cut] = chunks[at[cut]]
            source = np.repeat(np.arange(len(code)), c)
            other = np.arange(len(source)) - np.repeat(np.cumsum(c) - c, c)
            each, mine = c[source], np.zeros(len(source), np.int64)
            if cut.any():
                seed = np.array([zlib.crc32(x.encode()) for x in batch.column(0).to_pylist()], np.int64)
                mine = seed[rows[source]] % each
            cell = np.where(cut[source], np.minimum(mine, other) * each + np.maximum(mine, other), -1)
            side = np.where(cut[source] & (mine != other), (mine > other).astype(np.int32), -1)
            take = pa.array(rows[source])
            columns = [pa.array(t[source].astype(np.int32)), pa.array(key[source]), pa.array(cell), pa.array(side.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "key", "cell", "side", "id", "vec"])

    return run


def _best(ids: np.ndarray, vectors: np.ndarray, side: np.ndarray, k: int):
    """(query index, candidate index, steps of similarity) of the k best others of each row; rows are in the order of ids."""
    n = len(ids)
    block = max(64, 2**22 // n)
    code = np.unique(ids, return_inverse=True)[1]
    k += n - int(code.max()) - 1  # ids that have several vectors here
    apart = (side >= 0).any()
    for start in range(0, n, block):
        q = np.arange(start, min(n, start + block))
        steps = np.rint(vectors[q] @ vectors.T / STEP).astype(np.int64)
        rank = steps * n - np.arange(n)  # equal similarity: the smaller id first
        rank[code[q][:, None] == code[None, :]] = NEVER
        if apart:  # a chunk's own pairs are compared in the cell that it has for itself
            rank[side[q][:, None] == side[None, :]] = NEVER
        top = min(k, n - 1)
        found = np.argpartition(-rank, top - 1, axis=1)[:, :top]
        value = np.take_along_axis(rank, found, 1)
        qi, ci = np.nonzero(value > NEVER)
        yield q[qi], found[qi, ci], np.take_along_axis(steps, found, 1)[qi, ci]


def _rerank(dims: int, k: int):
    """Rows of whole buckets, one bucket after another -> (id, other, steps)."""

    def bucket(table: pa.Table):
        if table.num_rows < 2:
            return
        table = table.group_by(["id", "vec", "side"]).aggregate([]).sort_by([("id", "ascending"), ("vec", "ascending")])  # copies of an id
        ids, vectors = table.column("id").combine_chunks(), _matrix(table.column("vec"), dims)
        names = ids.to_numpy(zero_copy_only=False)
        if len(names) < 2:
            return
        for q, c, s in _best(names, vectors, table.column("side").to_numpy(), k):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), ids.take(pa.array(c)), pa.array(s)], names=["id", "other", "steps"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b <= a:
                    continue
                if last is not None and tuple(keys[a]) != last:
                    yield from bucket(pa.Table.from_batches(held))
                    held = []
                last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from bucket(pa.Table.from_batches(held))

    return run


def neighbours(vectors: DataFrame, k: int = 5, dims: int = 128, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, other, rank): the k others with the largest cosine for every id, rank from 1.

    A usable embedding has `dims` finite numbers, not all zero; rows without one, or with a null id, take no part. Copies
    of an id count once; of several vectors of an id the most similar one counts. Equal similarity (in steps of STEP) goes
    to the smaller id. An id is never its own neighbour; with fewer than k others there are fewer rows. The search may
    miss neighbours (see the module). An empty table gives no rows.
    """
    usable = vectors.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("e"))
    usable = usable.where((F.col("id").isNotNull()) & (F.size("e") == dims) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x)))
    units = usable.mapInArrow(_units(dims), "id string, vec binary")  # read anew by each pass: cheaper than to write it
    hashed = units.select("id", F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    # vectors of many rows; the sum of all counts is the number of rows
    counts = Cut(hashed.groupBy("h", "h2").agg(F.count("*").alias("n")))
    rows = counts.df.agg(F.sum("n")).first()[0]
    out = "id string, other string, steps bigint"
    if not rows:
        return units.select("id", F.col("id").alias("other"), F.lit(1).alias("rank"))

    # ids that share one vector: beyond the k + 1 smallest they can be nobody's neighbours
    many = Cut(counts.df.where(F.col("n") > k + 1).select("h", "h2"))
    counts.drop()
    search, copies = units, None
    if not many.df.isEmpty():
        group = ["h", "h2"]
        ranked = hashed.join(many.df, group, "left_semi").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        some = ranked.withColumn("r", F.row_number().over(W.partitionBy(*group, "salt").orderBy("id"))).where(F.col("r") <= k + 1)
        some = some.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("id"))).where(F.col("r") <= k + 1)
        first = some.groupBy(*group).agg(F.sort_array(F.collect_list("id")).alias("first"))
        members = ranked.join(first, group)
        copies = members.select("id", F.explode("first").alias("other"), F.lit(round(1 / STEP)).cast("bigint").alias("steps")).where("id <> other")
        search = search.join(ranked.select("id").join(some.select("id"), "id", "left_anti"), "id", "left_anti")

    width = max(2, min(round(WIDTH * math.log2(max(2, rows / SPREAD))), dims // TABLES))
    # about FIT_ROWS rows by a hash, at most twice as many
    sample = units.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // FIT_ROWS))) == 0).select("vec").limit(2 * FIT_ROWS).toArrow()
    index = Index(_matrix(sample.column(0), dims), width)
    sizes = search.select("vec").mapInArrow(_sizes(dims, index), "t int, key bigint, n bigint").groupBy("t", "key").agg(F.sum("n").alias("n"))
    # every hot bucket has more than `chunk` of at most 2 * TABLES * rows entries, so HOT_KEYS bounds what is collected
    chunk = max(CHUNK, math.ceil(2 * TABLES * rows / HOT_KEYS))
    large = sizes.where(F.col("n") > chunk).select((F.col("key") * TABLES + F.col("t")).alias("code"), F.ceil(F.col("n") / chunk).alias("c")).orderBy("code").toArrow()
    hot, chunks = large.column(0).to_numpy(), large.column(1).to_numpy()
    spread = search.mapInArrow(_spread(dims, index, hot, chunks), "t int, key bigint, cell bigint, side int, id string, vec binary")
    tasks = min(MOST_TASKS, max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * TABLES * (1 + PROBED) * (3 * dims + 64) / TASK_BYTES)))
    met = spread.repartition(tasks, "t", "key", "cell").sortWithinPartitions("t", "key", "cell").mapInArrow(_rerank(dims, k), out)
    if copies is not None:
        met = met.unionByName(copies)
    best = F.sort_array(F.collect_set(F.struct((-F.col("steps")).alias("s"), F.col("other").alias("other"))))
    lists = met.groupBy("id").agg(F.slice(F.array_distinct(F.transform(best, lambda x: x["other"])), 1, k).alias("others"))
    return lists.select("id", F.posexplode("others").alias("rank", "other")).select("id", "other", (F.col("rank") + 1).alias("rank"))


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of which at least one has the other among its neighbours."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
