import collections
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import heavy_keys

SCHEMA = "k string, t timestamp, v string, n_rows string"  # n_rows clashes with a result column
DAY = dt.datetime(2025, 3, 3)


def brute(rows):
    out = collections.defaultdict(lambda: [0, set(), None, None])
    for k, t, v, _ in rows:
        if k is None:
            continue
        o = out[k]
        o[0] += 1
        if v is not None:
            o[1].add(v)
        if t is not None:
            o[2] = t if o[2] is None else min(o[2], t)
            o[3] = t if o[3] is None else max(o[3], t)
    return {k: (o[0], len(o[1]), o[2], o[3]) for k, o in out.items()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "", "a", "b", "ü"]), st.sampled_from([None, DAY, DAY + dt.timedelta(1)]), st.sampled_from([None, "x", "y"]), st.just("q")), max_size=40))
def test_equals_brute_force(spark, rows):
    found = heavy_keys.per_key(spark.createDataFrame(rows, SCHEMA), "k", "t", "v").collect()
    assert {r["key_value"]: tuple(r)[1:] for r in found} == brute(rows)


def test_hot_key_over_several_splits(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(DAY).alias("t"), (F.col("id") % 7).cast("string").alias("v"))
    found = {r["key_value"]: r for r in heavy_keys.per_key(rows.repartition(5), "k", "t", "v").collect()}
    assert (found["hot"]["n_rows"], found["hot"]["n_distinct"]) == (1000, 7) and len(found) == 2001


def test_heavy_counts_null_rows_in_the_total(spark):
    rows = [("a",)] * 2 + [("b",)] * 1 + [(None,)] * 197
    assert [r["key_value"] for r in heavy_keys.heavy(spark.createDataFrame(rows, "k string"), "k").collect()] == ["a"]


def test_empty(spark):
    assert heavy_keys.per_key(spark.createDataFrame([], SCHEMA), "k", "t", "v").count() == 0
    assert heavy_keys.heavy(spark.createDataFrame([], SCHEMA), "k").count() == 0
