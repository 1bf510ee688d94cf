"""Filling containers of fixed capacity with items of varying length.

Method: minimum bin slack. For one bin after another, a bitset dynamic program over the available lengths finds the
fullest feasible combination, which is then removed. A bitset is one integer whose bit s says that the sum s can be
reached; adding a length is a shift and an or.

Items are dealt evenly over groups of about GROUP_BINS bins by a hash of their keys, and each group is packed in a
task of its own from its histogram of lengths, so work grows in proportion to the data and no task with it. What a
group can't fill well (its last bins) goes into a second round of fewer groups. An item longer than the capacity is
divided: full containers of its own, and the rest is an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cut
from .tokens import FOLDER, token_counts

#: expected bins of a group, which also bounds what a task holds
GROUP_BINS = 512
#: a bin filled less than this share goes into the next round, where its items are packed anew
WELL_FILLED = 0.995
ROUNDS = 2


def fullest(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination of available items: [(index of the length, how many)], at most `counts` of each.

    Lengths are taken in the given order and the search ends when the capacity is reached exactly.
    """
    full, reached, steps = 1 << capacity, 1, []
    mask = (full << 1) - 1
    for i, (length, n) in enumerate(zip(lengths, counts)):
        n, chunk = min(n, capacity // length), 1
        while n > 0:  # 1, 2, 4, ... of the same length reach every number up to n
            take = min(chunk, n)
            new = (reached | reached << take * length) & mask
            if new != reached:
                steps.append((i, take, reached))
                reached = new
                if reached & full:
                    n = 0
                    break
            n -= take
            chunk *= 2
        if reached & full:
            break
    total, used = reached.bit_length() - 1, {}
    for i, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * lengths[i]
            used[i] = used.get(i, 0) + take
    return sorted(used.items())


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each item. Each bin has the longest item left and the fullest combination of others with it."""
    order = np.argsort(-lengths, kind="stable")
    values, starts, counts = np.unique(-lengths[order], return_index=True, return_counts=True)
    values, taken, bins, bin_no = [int(-v) for v in values], [0] * len(values), np.empty(len(lengths), np.int64), 0
    left = [int(c) for c in counts]
    top = 0
    while top < len(values):
        if not left[top]:
            top += 1
            continue
        left[top] -= 1
        room = capacity - values[top]
        live = [i for i in range(top, len(values)) if left[i] and values[i] <= room]
        found = fullest([values[i] for i in live], [left[i] for i in live], room) if live else []
        pattern = [(live[i], n) for i, n in found]
        left[top] += 1
        need = dict(pattern)
        need[top] = need.get(top, 0) + 1
        # the same combination serves as many bins as its items last for
        for _ in range(min(left[i] // n for i, n in need.items())):
            for i, n in need.items():
                at = starts[i] + taken[i]
                bins[order[at : at + n]] = bin_no
                taken[i] += n
                left[i] -= n
            bin_no += 1
    return bins


def _round(capacity: int, last: bool):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], ignore_index=True)
        bins = pack(group["n_tokens"].to_numpy(), capacity)
        fill = np.bincount(bins, weights=group["n_tokens"])
        well = np.ones(len(group), bool) if last else (fill >= WELL_FILLED * capacity)[bins]
        container = (np.int64(key[0]) << 24 | bins).astype(np.int64)
        return group.assign(container=pd.array(np.where(well, container, -1), dtype="int64"))[["container", "doc_id", "part", "n_parts", "start", "n_tokens"]]

    return run


_OUT = "container bigint, doc_id bigint, part int, n_parts int, start bigint, n_tokens bigint"


def containers(documents: DataFrame, capacity: int = 4096, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Texts (doc_id, text) assigned to containers of `capacity` tokens.

    Columns: container BIGINT, doc_id BIGINT, part INT (from 0), n_parts INT, start BIGINT (the part's first token), n_tokens
    BIGINT. Only a text of more than `capacity` tokens has several parts: all but the last fill a container each,
    the last is packed with others. Null and empty texts are no items; blank texts are. Rows with a null or
    repeated doc_id are items of their own; an empty table gives no rows; other columns are ignored.
    """
    sizes = Cut(token_counts(documents, name, folder).where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    n_parts = F.ceil(F.col("n") / capacity).cast("int")
    parts = sizes.df.select("doc_id", "row", "n", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    parts = parts.select("doc_id", "row", "part", "n_parts", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part").cast("long") * capacity).alias("n_tokens"))
    # a part that fills a container is alone in its bin, as nothing fits beside it
    done, items = None, parts
    for turn in range(ROUNDS):
        tokens = items.agg(F.sum("n_tokens")).first()[0] or 0
        groups = max(1, round(tokens / (capacity * GROUP_BINS)))
        first = turn << 34  # container numbers of different rounds never meet
        spread = items.withColumn("g", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "part", "row"), F.lit(groups)) + F.lit(first))
        packed = Cut(spread.groupBy("g").applyInPandas(_round(capacity, turn == ROUNDS - 1), _OUT))
        filled = packed.df.where("container >= 0")
        done = filled if done is None else done.unionByName(filled)
        items = packed.df.where("container < 0").withColumn("row", F.monotonically_increasing_id())
    return done
