"""Results per key when a few keys hold most of the rows.

Method: dense accumulator arrays. Rows are cut into equal splits whatever their keys are. Each split
dictionary-encodes its keys and accumulates into dense numpy arrays (bincount, scatter-min, scatter-max), so
a key with a third of all rows costs a split no more than any other. The arrays leave the split cut into
blocks of keys; a block's arrays are summed by a distributed reduction, where a key is met once per split.
No step ever gathers the rows of one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a split: the unit whose keys share one dictionary and one set of dense arrays
SPLIT_ROWS = 262_144
#: rows of input per block of keys in the reduction
ROWS_PER_BLOCK = 2_000_000

_MAX, _MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_PART = "block int, keys array<string>, n_rows array<long>, n_distinct array<long>, first_us array<long>, last_us array<long>"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SPLIT_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _accumulator(blocks: int, distinct: bool):
    """Split -> rows of array blocks. With `distinct`, rows are distinct (key, value) pairs and are counted as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split in _splits(batches):
            coded = split.column(0).combine_chunks()
            coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
            keys, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            size = len(keys)
            count = np.bincount(codes, minlength=size).astype(np.int64)
            first, last = np.full(size, _MAX), np.full(size, _MIN)
            if not distinct:
                stamp = split.column(1)
                known = stamp.is_valid().to_numpy(zero_copy_only=False) if isinstance(stamp, pa.Array) else stamp.is_valid().to_numpy()
                when = stamp.fill_null(0).to_numpy()
                np.minimum.at(first, codes[known], when[known])
                np.maximum.at(last, codes[known], when[known])
            nothing = np.zeros(size, np.int64)
            block = (pd.util.hash_array(keys.to_numpy(zero_copy_only=False).astype(object), categorize=False) % blocks).astype(np.int32)
            order = np.argsort(block, kind="stable")
            at, starts = np.unique(block[order], return_index=True)
            bounds = pa.array(np.append(starts, size).astype(np.int32))

            def lists(values):
                return pa.ListArray.from_arrays(bounds, values)

            arrays = [nothing if distinct else count, count if distinct else nothing, first, last]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), lists(keys.take(pa.array(order)).cast(pa.string())), *(lists(pa.array(a[order])) for a in arrays)],
                names=["block", "keys", "n_rows", "n_distinct", "first_us", "last_us"],
            )

    return run


def _sum_blocks(parts: pa.Table) -> pa.Table:
    """All array parts of one block -> one row per key."""
    flat = {c: pa.concat_arrays([x.flatten() for x in parts.column(c).chunks]) for c in parts.column_names[1:]}
    coded = flat["keys"].dictionary_encode()
    codes, size = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)

    def added(c):
        total = np.zeros(size, np.int64)
        np.add.at(total, codes, flat[c].to_numpy())
        return total

    first, last = np.full(size, _MAX), np.full(size, _MIN)
    np.minimum.at(first, codes, flat["first_us"].to_numpy())
    np.maximum.at(last, codes, flat["last_us"].to_numpy())
    return pa.table(
        {
            "key_value": coded.dictionary,
            "n_rows": added("n_rows"),
            "n_distinct": added("n_distinct"),
            "first_us": pa.array(first, mask=first == _MAX),
            "last_us": pa.array(last, mask=last == _MIN),
        }
    )


def per_key(rows: DataFrame, key: str, stamp: str | None = None, value: str | None = None) -> DataFrame:
    """One row per key: key_value, n_rows, n_distinct (of `value`), first_at, last_at (of `stamp`).

    Null keys are no keys and are left out; the empty string is a key. Repeated rows count each time. Null
    stamps are skipped; a key with null stamps only has null first_at and last_at. Null values are no values.
    Without `value`, n_distinct is 0. An empty table gives no rows. Columns other than those named are ignored.
    """
    k = F.col(key).cast("string").alias("key_value")
    us = F.unix_micros(F.col(stamp).cast("timestamp")) if stamp else F.lit(None).cast("long")
    blocks = max(8, int(rows.count() // ROWS_PER_BLOCK))
    parts = rows.select(k, us.alias("us")).where("key_value IS NOT NULL").mapInArrow(_accumulator(blocks, False), _PART)
    if value:
        # pairs are spread by key and value together: a hot key is as many small groups as it has values
        pairs = rows.select(k, F.col(value).alias("value")).where("key_value IS NOT NULL AND value IS NOT NULL").distinct()
        parts = parts.unionByName(pairs.select("key_value").mapInArrow(_accumulator(blocks, True), _PART))
    totals = parts.groupBy("block").applyInArrow(_sum_blocks, "key_value string, n_rows long, n_distinct long, first_us long, last_us long")
    return totals.select("key_value", "n_rows", "n_distinct", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"))


def heavy(rows: DataFrame, key: str, percent: int = 1) -> DataFrame:
    """The keys of `per_key` that hold at least `percent` % of all rows (rows with a null key count in the total).

    Columns: key_value, n_rows. An empty table gives no rows.
    """
    total = rows.count()
    return per_key(rows, key).where(F.col("n_rows") * 100 >= F.lit(percent * total)).select("key_value", "n_rows")
