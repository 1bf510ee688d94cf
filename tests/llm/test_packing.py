import collections
import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(1, 40))
def test_fullest_equals_brute_force(items, capacity):
    lengths, counts = [x for x, _ in items], [n for _, n in items]
    best = max(s for pick in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(pick, lengths))) <= capacity)
    found = packing.fullest(lengths, counts, capacity)
    assert sum(lengths[i] * n for i, n in found) == best and all(0 < n <= counts[i] for i, n in found)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_bins_hold_every_item_once(lengths):
    lengths = np.array(lengths)
    bins = packing.pack(lengths, 50)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 50 and (fill > 0).all() and len(fill) <= 2 * -(-lengths.sum() // 50)


def test_containers(spark):
    plain = tokens.encoding()
    docs = [(i, "word " * (i % 90)) for i in range(1, 300)] + [(900, "long text " * 400), (901, None), (902, ""), (903, "  "), (904, "same"), (904, "same"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, container int")
    rows = packing.containers(frame, capacity=128).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
    sizes = {i: len(plain.encode_ordinary(t or "")) for i, t in docs}
    total = sum(len(plain.encode_ordinary(t or "")) for _, t in docs)
    assert max(fill.values()) <= 128 and sum(fill.values()) == total and len(fill) <= 1.02 * -(-total // 128) + 1
    parts = collections.defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["part"], r["n_parts"], r["start"], r["n_tokens"]))
    assert sorted(parts[900]) == [(p, -(-sizes[900] // 128), p * 128, min(128, sizes[900] - p * 128)) for p in range(-(-sizes[900] // 128))]
    assert all(len(v) == 1 for i, v in parts.items() if i not in (900, 904)) and len(parts[904]) == 2
    assert 901 not in parts and 902 not in parts and 903 in parts and None in parts


def test_empty(spark):
    assert packing.containers(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
