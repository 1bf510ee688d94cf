import os
from pathlib import Path

import numpy as np
import pytest

from loomgraph.llm import neighbours as nb

SCHEMA = "id string, embedding array<float>, other string"


def brute(rows, k):
    ids = sorted({i for i, e in rows if ok(i, e)})
    best = {}
    vec = {}
    for i, e in rows:
        if ok(i, e):
            vec.setdefault(i, np.array(e, float) / np.linalg.norm(e))
    m = np.stack([vec[i] for i in ids])
    s = np.round(m @ m.T, 6)
    for a, i in enumerate(ids):
        best[i] = [ids[b] for b in np.lexsort((np.arange(len(ids)), -s[a])) if b != a][:k]
    return best


def ok(i, e):
    return i is not None and e is not None and len(e) == 16 and all(x is not None and np.isfinite(x) for x in e) and any(e)


def test_recall_with_clusters_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(f"u{i:04d}", [float(np.float32(x)) for x in centres[i % 12] + 0.2 * rng.normal(size=16)]) for i in range(600)]
    rows += rows[:40]  # copies of ids
    rows += [("zero", [0.0] * 16), ("null", None), ("short", [1.0]), (None, rows[0][1]), ("nan", [float("nan")] * 16), ("gap", [None] * 16)]
    found = nb.neighbours(spark.createDataFrame([(i, e, "clash") for i, e in rows], SCHEMA), 5, 16).collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], set()).add(r["other"])
    truth = brute(rows, 5)
    assert set(got) == set(truth) and all(len(v) == 5 and i not in v for i, v in got.items())
    assert sum(len(got[i] & set(t)) for i, t in truth.items()) / sum(map(len, truth.values())) >= 0.9


def test_one_vector_for_a_third_of_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{i:03d}", [1.0] * 16) for i in range(100)] + [(f"d{i:03d}", [float(x) for x in rng.normal(size=16)]) for i in range(200)]
    found = nb.neighbours(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), 5, 16).where("id like 'c%'").collect()
    got = {}
    for r in found:
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    first = [f"c{i:03d}" for i in range(6)]
    assert len(got) == 100
    for i, v in got.items():
        assert [v[r] for r in sorted(v)] == [x for x in first if x != i][:5]


def test_cut_buckets_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"u{i:03d}", [float(x) for x in rng.normal(size=16) * 0.1 + 1]) for i in range(200)]
    frame = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    whole = {(r["id"], r["rank"]): r["other"] for r in nb.neighbours(frame, 3, 16).collect()}
    monkeypatch.setattr(nb, "CHUNK", 20)
    assert {(r["id"], r["rank"]): r["other"] for r in nb.neighbours(frame, 3, 16).collect()} == whole


@pytest.mark.parametrize("rows", [[], [("a", [1.0] * 16, "")], [("a", None, "")]])
def test_too_few(spark, rows):
    assert nb.neighbours(spark.createDataFrame(rows, SCHEMA), 5, 16).count() == 0
    assert nb.pairs(nb.neighbours(spark.createDataFrame(rows, SCHEMA), 5, 16)).columns == ["id_a", "id_b"]


FOLDERS = [f for f in os.environ.get("RECALL_DIRS", "/root/testdata/sf0.01 /root/testdata/sf0.1").split() if Path(f).exists()]


@pytest.mark.parametrize("folder", FOLDERS)
def test_recall_against_brute_force_on_the_tables(spark, folder):
    """Of the five nearest of every 17th id by the given floats, at least 0.99 are found, at each size of the input."""
    table = spark.read.parquet(f"{folder}/graph_documents.parquet")
    rows = {r["id"]: r["embedding"] for r in table.select("id", "embedding").collect() if r["id"] and r["embedding"] and len(r["embedding"]) == 128 and None not in r["embedding"] and any(r["embedding"])}
    ids = sorted(rows)
    m = np.array([rows[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in nb.neighbours(table).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    found = 0
    asked = range(0, len(ids), 17)
    for q in asked:
        s = np.round(m @ m[q], 6)
        s[q] = -9
        found += len(got[ids[q]] & {ids[j] for j in np.lexsort((np.arange(len(ids)), -s))[:5]})
    print(f"recall in {folder}: {found / len(asked) / 5:.4f}")
    assert found / len(asked) / 5 >= 0.99
