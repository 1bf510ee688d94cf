"""Ranked retrieval for batches of queries: BM25, vector search, rank fusion and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import Cut

#: Fixed values of the ranking functions.
K1, B = 1.5, 0.75
RRF = 60
ALPHA, DIVERSITY, SIBLING = 0.7, 0.2, 0.3
#: rows of a block of queries and of a block of vectors in the exact vector search
QUERY_BLOCK, VECTOR_BLOCK = 2048, 8192
#: the same for words; rows that a block of queries keeps at most, and pairs of query and document that are added at once
ASKED_BLOCK, TEXT_BLOCK, KEPT_ROWS, PAIRS = 16384, 4096, 1 << 21, 1 << 20
#: rows that all tasks of a search keep together for each document, and queries of a block that is made to keep cores busy
KEPT_PER_TEXT, LEAST_ASKED = 8, 64
#: share of the documents from which on a word is frequent, and the most such words
OFTEN, MOST_OFTEN = 0.1, 512
_WORD = r"[\p{L}\p{N}_]{2,}"


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, term, tf): lower-cased words of two letters, digits or underscores or more; null texts have none."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    return documents.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, over_fetch: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of highest BM25 score, above 0, for each query (query_id, text).

    Every different word of a query counts once. Documents are written once, as blocks of numbered words; a task reads its share of them from there against one block of queries and keeps
    k rows a query, so neither texts, queries nor scored pairs are shuffled. With `allowed` (doc_id), only those
    documents are ranked; by the reference's rule, with `over_fetch`, only the best over_fetch * k of all documents are searched for them. Equal scores go to the smaller doc_id.
    """
    docs = documents.select("doc_id", "text")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))  # rows of one id are one document
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    packed = Cut(docs.select("doc_id", words.alias("words")).mapInArrow(_packed_texts(TEXT_BLOCK), _TEXTS)).df
    n, total = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    avg = total / n if n else 1.0
    types = {c: f.schema[c].dataType.simpleString() for f, c in ((queries, "query_id"), (documents, "doc_id"))}
    fetched = k if allowed is None or over_fetch is None else over_fetch * k
    some = allowed is not None and over_fetch is None
    rows = packed.select("ids", "terms", "found", F.lit(None).cast("binary").alias("marks"))
    if some:
        places = packed.select("block", "ids").mapInArrow(_places, f"block bigint, place int, doc_id {types['doc_id']}").join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
        marks = Cut(places.groupBy("block").agg(F.collect_list("place").alias("places")).mapInArrow(_marks, "block bigint, marks binary")).df
        rows = packed.join(marks, "block").select("ids", "terms", "found", "marks")
    # shares of the documents: few enough that the rows that leave them are in proportion to the documents; blocks of queries that keep all cores busy
    asking, cores = queries.count(), documents.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(packed.rdd.getNumPartitions(), 4 * cores, KEPT_PER_TEXT * n // max(1, asking * fetched)))
    qs = max(1, -(-asking // max(1, min(ASKED_BLOCK, KEPT_ROWS // fetched))), min(-(-2 * cores // shares), asking // LEAST_ASKED))
    df = packed.select("terms").mapInArrow(_frequencies, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    asked = postings(queries.select(F.col("query_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("query_id"), "term").join(df, "term")
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int")).groupBy("qb").applyInArrow(_packed_queries, "qb int, queries binary")
    # a product without a shuffle: a task streams its share of the documents and holds its block of queries
    pairs = rows.coalesce(shares).crossJoin(Cut(asked).df.repartitionByRange(qs, "qb").hint("shuffle_replicate_nl"))
    met = pairs.mapInArrow(_scored(fetched, n, avg), f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double")
    # a query has at most `fetched` rows of each share
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fetched)
    if allowed is None or some:
        return best
    return top(best.drop("rank").join(allowed.select("doc_id").distinct(), "doc_id", "left_semi"), k)


_TEXTS = "block bigint, n bigint, total bigint, ids binary, terms binary, found binary"


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks() if column.num_chunks else pa.array([], column.type)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def _packed_texts(size: int):
    """Documents (doc_id, words) in blocks: ids with their lengths, different words with their numbers of documents, and (place of the document, place of the word, times). Documents without an id only count."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            b = b.filter(pc.greater(pc.fill_null(pc.list_value_length(b.column("words")), 0), 0))
            for start in range(0, b.num_rows, size):
                part = b.slice(start, size)
                length = pc.list_value_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = part.column("words").flatten().dictionary_encode()
                nv = len(coded.dictionary)
                key, tf = np.unique(np.repeat(np.arange(len(length)), length) * nv + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                doc, term = key // nv, key % nv
                terms = pa.table({"term": coded.dictionary, "df": pa.array(np.bincount(term, minlength=nv))})
                named = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                held = named[doc]
                ids = pa.table({"doc_id": part.column("doc_id").filter(pa.array(named)), "length": pa.array(length[named])})
                found = pa.table({"doc": pa.array((np.cumsum(named) - 1)[doc[held]].astype(np.int32)), "term": pa.array(term[held].astype(np.int32)), "tf": pa.array(tf[held].astype(np.int32))})
                numbers = [pa.array([x], pa.int64()) for x in (number, len(length), int(length.sum()))]
                yield _batch(_TEXTS, [*numbers, *(pa.array([_written(x)], pa.binary()) for x in (ids, terms, found))])
                number += 1

    return run


def _frequencies(batches):
    for b in batches:
        for x in b.column(0):
            t = _read(x)
            yield _batch("term, df", [_array(t["term"]), _array(t["df"])])


def _places(batches):
    for b in batches:
        for number, x in zip(b.column(0), b.column(1)):
            ids = _array(_read(x)["doc_id"])
            yield _batch("block, place, doc_id", [pa.array(np.full(len(ids), number.as_py())), pa.array(np.arange(len(ids), dtype=np.int32)), ids])


def _marks(batches):
    """A bit for each place of a block."""
    for b in batches:
        bits = []
        for x in b.column(1):
            places = x.values.to_numpy(zero_copy_only=False)
            held = np.zeros(int(places.max()) + 1, np.uint8)
            held[places] = 1
            bits.append(np.packbits(held).tobytes())
        yield _batch("block, marks", [b.column(0), pa.array(bits, pa.binary())])


def _packed_queries(rows: pa.Table) -> pa.Table:
    """A block of queries (query_id, term, df) in one row; the id of a query and its words are at the same place of two lists."""
    asker, coded = rows["query_id"].combine_chunks().dictionary_encode(null_encoding="encode"), rows["term"].combine_chunks().dictionary_encode()
    who, code = asker.indices.to_numpy(), coded.indices.to_numpy()
    df = np.zeros(len(coded.dictionary), np.int64)
    df[code] = rows["df"].to_numpy()
    by = np.lexsort((code, who))
    parts = pa.table({"query_id": asker.dictionary}), pa.table({"term": coded.dictionary, "df": pa.array(df)}), pa.table({"asker": pa.array(who[by]), "code": pa.array(code[by])})
    whole = pa.table({"part": pa.array([_written(x) for x in parts], pa.binary())})
    return pa.table([rows["qb"].slice(0, 1).cast(pa.int32()), pa.array([_written(whole)], pa.binary())], names=["qb", "queries"])


def _in_order(ids: pa.Array) -> np.ndarray:
    """Numbers that are in the order of the ids."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False)
    coded = ids.dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    return place[coded.indices.to_numpy()]


class _Best:
    """The k rows of highest score of each query of a block; scores equal to 9 decimals go to the smaller doc_id."""

    def __init__(self, ids: pa.Array, k: int, least: float):
        self.ids, self.k = ids, k
        self.least, self.found, self.held_rows = np.full(len(ids), least), [], 0

    def take(self, q: np.ndarray, doc_ids: pa.Array, scores: np.ndarray) -> None:
        self.found.append((q.astype(np.int32), doc_ids, scores))
        self.held_rows += len(q)
        if self.held_rows > max(1 << 19, 3 * len(self.ids) * self.k // 2):
            self.pruned()

    def pruned(self) -> None:
        ids = pa.concat_arrays([x[1] for x in self.found])
        q, s = (np.concatenate([x[i] for x in self.found]) for i in (0, 2))
        near = np.round(s, 9)
        order = np.lexsort((_in_order(ids), -near, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[place == self.k - 1]
        self.least[q[last]] = near[last]
        kept = order[place < self.k]
        self.found, self.held_rows = [(q[kept], ids.take(pa.array(kept)), s[kept])], len(kept)

    def rows(self):
        if self.found:
            self.pruned()
            q, d, s = self.found[0]
            for i in range(0, len(q), 1 << 16):
                yield _batch("query_id, doc_id, score", [self.ids.take(pa.array(q[i : i + (1 << 16)])), d.slice(i, 1 << 16), pa.array(s[i : i + (1 << 16)])])


class _Search(_Best):
    """The k best documents of a block of queries among blocks of documents: frequent words by a product of matrices, others by their pairs of query and document; a few documents at a time."""

    def __init__(self, block: pa.Scalar, k: int, n: int, avg: float):
        ids, terms, pairs = (_read(x) for x in _array(_read(block)["part"]))
        super().__init__(_array(ids["query_id"]), k, 0.0)
        self.avg, self.vocabulary = avg, _array(terms["term"])
        df, code, asker = terms["df"].to_numpy().astype(float), pairs["code"].to_numpy(), pairs["asker"].to_numpy()
        nq, nv = len(self.ids), len(df)
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        # words of so many documents that a product of matrices is cheaper; which words these are changes the work only
        often = np.argsort(-df, kind="stable")[:MOST_OFTEN]
        often = often[df[often] > OFTEN * n]
        self.column = np.full(nv, -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), nq))
        held = self.column[code] >= 0
        self.dense[self.column[code[held]], asker[held]] = self.idf[code[held]]
        # queries by word, of the other words
        seldom, seldom_asker = code[~held], asker[~held].astype(np.int32)
        self.askers, self.number = seldom_asker[np.argsort(seldom, kind="stable")], np.bincount(seldom, minlength=nv)
        self.first = np.cumsum(self.number) - self.number

    def add(self, ids: pa.Table, terms: pa.Table, found: pa.Table, marks: bytes | None) -> None:
        nq, length, doc_ids = len(self.ids), ids["length"].to_numpy(), _array(ids["doc_id"])
        at = pc.index_in(_array(terms["term"]), value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        doc, term, tf = (found[c].to_numpy() for c in ("doc", "term", "tf"))
        use = at >= 0
        if marks is None:
            use = use[term]
        else:
            allowed = np.zeros(len(length), bool)
            bits = np.unpackbits(np.frombuffer(marks, np.uint8))[: len(length)].astype(bool)
            allowed[: len(bits)] = bits
            use = use[term] & allowed[doc]
            # documents that aren't allowed take no place
            doc, doc_ids, length = (np.cumsum(allowed) - 1)[doc], doc_ids.filter(pa.array(allowed)), length[allowed]
        doc, term, tf = doc[use], at[term[use]], tf[use]
        weight = tf / (tf + K1 * (1 - B + B * length[doc] / self.avg))
        step = int(min(4096, max(16, (1 << 19) // nq)))
        for low in range(0, len(length), step):
            a, b = np.searchsorted(doc, (low, low + step))
            d, t, w = doc[a:b] - low, term[a:b], weight[a:b]
            rows = min(step, len(length) - low)
            c = self.column[t]
            x = np.zeros((rows, len(self.dense)))
            x[d[c >= 0], c[c >= 0]] = w[c >= 0]
            score = x @ self.dense
            rest = (c < 0) & (self.number[t] > 0)
            d, t, w = d[rest], t[rest], w[rest] * self.idf[t[rest]]
            times = self.number[t]
            # in parts, so that many askers of one word take no more memory
            cuts = np.searchsorted(np.cumsum(times), np.arange(PAIRS, times.sum() + PAIRS, PAIRS), side="right") if len(times) else []
            i = 0
            for j in cuts:
                j = min(max(j, i + 1), len(times))
                if i >= j:
                    continue
                m = times[i:j]
                place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - self.first[t[i:j]], m)
                score += np.bincount(np.repeat(d[i:j] * nq, m) + self.askers[place], weights=np.repeat(w[i:j], m), minlength=rows * nq).reshape(rows, nq)
                i = j
            di, qi = np.nonzero((score > 0) & (score >= self.least - 1e-9))
            self.take(qi, doc_ids.take(pa.array(di + low)), score[di, qi])


def _scored(k: int, n: int, avg: float):
    """The k best rows of each query among the documents of a task."""

    def run(batches):
        searches: dict[int, _Search] = {}
        for b in batches:
            for i in range(b.num_rows):
                value = {c: b.column(c)[i] for c in b.schema.names}
                qb = value["qb"].as_py()
                if qb not in searches:
                    searches[qb] = _Search(value["queries"], k, n, avg)
                searches[qb].add(*(_read(value[c]) for c in ("ids", "terms", "found")), value["marks"].as_py())
        for x in searches.values():
            yield from x.rows()

    return run


def top(scores: DataFrame, k: int, places: int = 9) -> DataFrame:
    """The k best (query_id, doc_id, score) rows of each query, with rank from 1; salted, so that no task ranks all rows of a query. Scores equal to `places` go to the smaller doc_id."""
    order = [F.round("score", places).desc(), F.col("doc_id")]
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", within: str | None = None) -> DataFrame:
    """(query_id, doc_id, distance, rank): the k nearest of all (doc_id, vec) for every (query_id, vec), exactly.

    metric l2 gives the squared Euclidean distance, cosine 1 - cosine. Queries meet vectors of their own length; vectors that are null or hold a null take no part. Vectors are written once
    in blocks; a task reads its share of them from there against one block of queries and keeps k rows a query, so vectors aren't shuffled and nothing passes through the driver. Equal distances
    (to 9 decimals) go to the smaller doc_id. With `within`, a column of both sides, only rows that agree in it meet.
    """
    usable = lambda f: f.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())).withColumn("part", F.col(within).cast("string") if within else F.lit(None).cast("string"))
    q, v = usable(queries).select("query_id", "vec", "part"), usable(vectors).select("doc_id", "vec", "part")
    types = {c: f.schema[c].dataType.simpleString() for f, c in ((q, "query_id"), (v, "doc_id"))}
    rows = Cut(v.mapInArrow(_packed_vectors(VECTOR_BLOCK), _VECTORS)).df
    asked = Cut(q).df
    n, asking, cores = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], asked.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(rows.rdd.getNumPartitions(), 4 * cores, KEPT_PER_TEXT * n // max(1, asking * k)))
    qs = max(1, -(-asking // QUERY_BLOCK), min(-(-2 * cores // shares), asking // LEAST_ASKED))
    blocks = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int")).groupBy("qb").applyInArrow(_packed_vector_queries, "qb int, queries binary")
    pairs = rows.coalesce(shares).crossJoin(Cut(blocks).df.repartitionByRange(qs, "qb").hint("shuffle_replicate_nl"))
    met = pairs.mapInArrow(_measured(k, metric), f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double")
    # a query has at most k rows of each share
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", (-F.col("score")).alias("distance"), "rank")


_VECTORS = "n bigint, dims int, part string, rows binary"


def _packed_vectors(size: int):
    """Vectors (doc_id, vec, part) in blocks of one length and part."""

    def run(batches):
        for b in batches:
            for (dims, part), at in _kinds(b):
                for start in range(0, len(at), size):
                    some = at[start : start + size]
                    t = pa.Table.from_batches([b.take(pa.array(some))]).select(["doc_id", "vec"])
                    yield _batch(_VECTORS, [pa.array([len(some)], pa.int64()), pa.array([dims], pa.int32()), pa.array([part], pa.string()), pa.array([_written(t)], pa.binary())])

    return run


def _kinds(rows: pa.RecordBatch | pa.Table):
    """((length, part), places) of the rows (vec, part)."""
    dims, coded = pc.list_value_length(rows.column("vec")).to_numpy(zero_copy_only=False), rows.column("part").to_pylist()
    parts = {x: i for i, x in enumerate(dict.fromkeys(coded))}
    named = list(parts)
    which = np.array([parts[x] for x in coded], np.int64)
    for key in np.unique(dims.astype(np.int64) * (len(named) + 1) + which):
        d, i = divmod(int(key), len(named) + 1)
        yield (d, named[i]), np.flatnonzero((dims == d) & (which == i))


def _packed_vector_queries(rows: pa.Table) -> pa.Table:
    return pa.table([rows["qb"].slice(0, 1).cast(pa.int32()), pa.array([_written(rows.select(["query_id", "vec", "part"]))], pa.binary())], names=["qb", "queries"])


class _Near(_Best):
    """The k nearest vectors of a block of queries of one length and part."""

    def __init__(self, queries: pa.Table, k: int, metric: str):
        super().__init__(_array(queries["query_id"]), k, -np.inf)
        self.metric = metric
        self.m = self.matrix(queries)

    def matrix(self, t: pa.Table) -> np.ndarray:
        x = _array(t["vec"]).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(t.num_rows, x.size // max(1, t.num_rows))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if self.metric == "cosine" else x

    def add(self, vectors: pa.Table) -> None:
        x, ids = self.matrix(vectors), _array(vectors["doc_id"])
        size, top_ = (x**2).sum(1), min(self.k, len(x))
        for start in range(0, len(self.m), 256):
            part = self.m[start : start + 256]
            far = 1 - part @ x.T if self.metric == "cosine" else (part**2).sum(1)[:, None] + size[None, :] - 2 * part @ x.T
            near = np.round(far, 9)
            most = np.fmin(np.partition(near, top_ - 1, axis=1)[:, top_ - 1], -self.least[start : start + 256])
            qi, ci = np.nonzero(near <= most[:, None])
            self.take(qi + start, ids.take(pa.array(ci)), -far[qi, ci])


def _measured(k: int, metric: str):
    """The k nearest of each query among the vectors of a task."""

    def run(batches):
        searches: dict[int, dict[tuple, _Near]] = {}
        for b in batches:
            for i in range(b.num_rows):
                value = {c: b.column(c)[i] for c in b.schema.names}
                qb = value["qb"].as_py()
                if qb not in searches:
                    asked = _read(value["queries"])
                    searches[qb] = {kind: _Near(asked.take(pa.array(at)), k, metric) for kind, at in _kinds(asked)}
                if found := searches[qb].get((value["dims"].as_py(), value["part"].as_py())):
                    found.add(_read(value["rows"]))
        for x in searches.values():
            for y in x.values():
                yield from y.rows()

    return run


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists: (query_id, doc_id, score, rank), the k best of each query."""
    union = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("query_id", "doc_id", "rank"))
    return top(union.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score")), k)


def of_category(found: DataFrame, fc: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of `found` (query_id, uri) that are of the category (query_id, fc) of their query by (fc, uri). What was found is looked up, so no query meets all documents of its category."""
    return found.join(fc, "query_id").join(categories.select("fc", "uri"), ["fc", "uri"], "left_semi")


def merged_slots(main: DataFrame, typed: DataFrame, pool: int, share: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score, rank): the best of `main` with int(pool * share) slots kept for `typed`; main wins duplicates."""
    slots = int(pool * share)
    first = main.where(F.col("rank") <= pool - slots).select("query_id", "doc_id", "score")
    rest = typed.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rest = rest.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("r") <= slots).select("query_id", "doc_id", "score")
    return top(first.unionByName(rest), pool)


def capped(ranked: DataFrame, flag: str, ratio: float = 0.25) -> DataFrame:
    """Rows of a ranked list without the flagged ones beyond max(1, int(ratio * n)) per query, best first."""
    n = F.count("*").over(W.partitionBy("query_id"))
    r = F.row_number().over(W.partitionBy("query_id", flag).orderBy("rank"))
    return ranked.withColumn("_n", n).withColumn("_r", r).where(~F.col(flag) | (F.col("_r") <= F.greatest(F.lit(1), F.floor(ratio * F.col("_n"))))).drop("_n", "_r")


def normalised(ranked: DataFrame) -> DataFrame:
    """score scaled to 0..1 within each query as `norm`; 1 if all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("norm", F.when(high - low < 1e-10, 1.0).otherwise((F.col("score") - low) / (high - low)))


# How much a type raises or lowers a score, by local name or label.
TYPE_MODIFIERS = {
    "E22_Man-Made_Object": 0.05, "E22_Human-Made_Object": 0.05, "Human-Made Object": 0.05, "Man-Made Object": 0.05, "E24_Physical_Human-Made_Thing": 0.05, "Physical Human-Made Thing": 0.05,
    "Physical Man-Made Thing": 0.05, "E39_Actor": 0.05, "Actor": 0.05, "E21_Person": 0.05, "Person": 0.05, "E74_Group": 0.05, "Group": 0.05, "E7_Activity": 0.03, "Activity": 0.03,
    "E5_Event": 0.03, "Event": 0.03, "E53_Place": 0.03, "Place": 0.03, "E18_Physical_Thing": 0.03, "Physical Thing": 0.03, "Linguistic Object": -0.35, "E33_Linguistic_Object": -0.35,
    "E33_E41_Linguistic_Appellation": -0.35, "E41_E33_Linguistic_Appellation": -0.35, "Linguistic Appellation": -0.35, "Inscription": -0.40, "E34_Inscription": -0.40,
    "E31_Document": -0.20, "Document": -0.20, "Appellation": -0.25, "E41_Appellation": -0.25, "PC67_refers_to": -0.25,
}
# Types that say little by themselves.
NON_INFORMATIVE = (
    "Linguistic Object", "E33_Linguistic_Object", "E33_E41_Linguistic_Appellation", "E41_E33_Linguistic_Appellation", "Linguistic Appellation", "Inscription", "E34_Inscription",
    "Appellation", "E41_Appellation", "PC67_refers_to",
)
# Bonus by steps from what a talk is about; degree from which an entity is lowered, and by how much; degree from which it is no seed.
FOCUS = {1: 0.15, 2: 0.10, 3: 0.05}
MEGA, MEGA_PENALTY, HUB = 2000, 0.15, 500
#: a category with fewer documents is searched as another one
SPARSE = 5


def type_modifier(doc_type, all_types):
    """The modifier of the first type, else of the first of all types that has one, else 0."""
    table = F.create_map(*(F.lit(x) for pair in TYPE_MODIFIERS.items() for x in pair))
    others = F.filter(F.transform(all_types, lambda t: F.try_element_at(table, F.regexp_extract(t, r"([^/#]*)$", 1))), lambda m: m.isNotNull())
    return F.coalesce(F.try_element_at(table, doc_type), F.try_element_at(others, F.lit(1)), F.lit(0.0))


def non_informative(doc_type, all_types):
    names = F.array(*(F.lit(x) for x in NON_INFORMATIVE))
    return F.coalesce(doc_type.isin(*NON_INFORMATIVE) | F.arrays_overlap(F.transform(all_types, lambda t: F.regexp_extract(t, r"([^/#]*)$", 1)), names), F.lit(False))


def focus_bonus(distances: DataFrame) -> DataFrame:
    """`distances` with the bonus of their column distance in its place, where there is one."""
    table = F.create_map(*(F.lit(x) for pair in FOCUS.items() for x in pair))
    return distances.withColumn("bonus", F.try_element_at(table, "distance")).where("bonus IS NOT NULL").drop("distance")


def seeds_without_hubs(seeds: DataFrame, degrees: DataFrame, most: int = HUB) -> DataFrame:
    """(query_id, uri) of `seeds` (query_id, uri, rank) with fewer than `most` edges (uri, degree); of a query that has none the first."""
    known = seeds.join(degrees, "uri", "left").withColumn("hub", F.coalesce("degree", F.lit(0)) >= most)
    some = known.withColumn("few", F.min(F.col("hub").cast("int")).over(W.partitionBy("query_id"))).withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return some.where("NOT hub OR (few = 1 AND r = 1)").select("query_id", "uri")


def excluded(ranked: DataFrame, shown: DataFrame) -> DataFrame:
    """`ranked` without the (query_id, doc_id) that were shown before; ranks close up."""
    kept = ranked.join(shown.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))


def interleaved(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, rank): the lists (query_id, doc_id, rank) taken in turn, each document once, k in all."""
    both = first.select("query_id", "doc_id", (2 * F.col("rank")).alias("place")).unionByName(second.select("query_id", "doc_id", (2 * F.col("rank") + 1).alias("place")))
    once = both.groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place", "doc_id"))).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def batches(sized: DataFrame, steps: tuple[tuple[int, int], ...] = ((4000, 4), (8000, 8), (16000, 16)), whole: int = 64) -> DataFrame:
    """(id, batch): texts (id, n characters) in batches of equal cost, in the order of their length.

    A batch has `whole` texts, divided by the factor of the largest step that a text reaches. Texts of a step are counted per bucket of lengths, so no task orders all of them.
    """
    factor = F.lit(1)
    for least, by in steps:
        factor = F.when(F.col("n") >= least, by).otherwise(factor)
    rows = sized.withColumn("factor", factor).withColumn("bucket", F.expr("n div 64"))
    before = rows.groupBy("factor", "bucket").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(W.partitionBy("factor").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("factor", "bucket").orderBy("n", "id")) - 1
    return rows.join(before.select("factor", "bucket", "before"), ["factor", "bucket"]).select("id", F.concat_ws("-", "factor", F.floor((F.col("before") + place) * F.col("factor") / whole)).alias("batch"))


def selected(candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, turn): a greedy choice of k candidates by relevance, connection and diversity.

    candidates: query_id, doc_id, norm, link, label, modifier, bonus, degree, vec; a query has at most a few hundred of them, as they come from ranked lists
    cut to a pool. The first is the one with the most norm times 1 + modifier. Later ones maximise ALPHA * norm + (1 - ALPHA) * link - DIVERSITY times the
    largest cosine to a chosen one (times SIBLING if a chosen one has the same label but for case and outer white space), all times 1 + modifier, plus bonus, less MEGA_PENALTY
    if the degree is above MEGA; of equal ones the smaller doc_id.
    """

    def choose(c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("doc_id", ignore_index=True)
        v = np.stack(c["vec"].to_list()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sims, boost = v @ v.T, 1 + c["modifier"].to_numpy()
        base = ALPHA * c["norm"].to_numpy() + (1 - ALPHA) * c["link"].to_numpy()
        more = c["bonus"].to_numpy() - np.where(c["degree"].to_numpy() > MEGA, MEGA_PENALTY, 0.0)
        chosen = [int(np.argmax(np.round(c["norm"].to_numpy() * boost, 12)))]
        labels = c["label"].fillna("").str.lower().str.strip().to_numpy()
        while len(chosen) < min(k, len(c)):
            near = sims[:, chosen].max(1)
            same = np.isin(labels, labels[chosen]) & (labels != "")
            value = np.round((base - DIVERSITY * near * np.where(same, SIBLING, 1.0)) * boost + more, 12)
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
        return c.iloc[chosen][["query_id", "doc_id"]].assign(turn=np.arange(1, len(chosen) + 1, dtype=np.int32))

    types = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "doc_id")}
    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id {types['query_id']}, doc_id {types['doc_id']}, turn int")
