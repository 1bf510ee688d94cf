import pytest
from pyspark.sql import functions as F

from loomgraph.functions.typed import typed_text
from loomgraph.operators import wide

CATALOG = [("height", "int_mm", "cm"), ("weight", "int_g", "g"), ("pages", "int", None), ("day", "date", None), ("shown", "bool", None), ("worth", "decimal2", None), ("technique", "text", None), ("title", "text", None), ("absent", "text", None)]
CASES = [
    ("int", " 1480 ", "1480"), ("int", "+1480", "1480"), ("int", "1480.0", "1480"), ("int", "00003", "3"), ("int", "-", None), ("int", "1789-02-31", None), ("int", "0", "0"),
    ("int_mm", "10.2 CM", "102"), ("int_mm", "31,5", "315"), ("int_mm", "0.026 m", "26"), ("int_mm", "999mm", "999"), ("int_mm", "84", "840"), ("int_mm", "0000-00-00", None), ("int_mm", "tbd", None),
    ("int_g", "0,060 kg", "60"), ("int_g", "38478", "38478"), ("int_g", "10 g", "10"),
    ("decimal2", "CHF 1'902.41", "1902.41"), ("decimal2", "752 919,87 EUR", "752919.87"), ("decimal2", "1.224,74", "1224.74"), ("decimal2", "1,023.72", "1023.72"), ("decimal2", "129,44", "129.44"), ("decimal2", "5.00", "5.00"), ("decimal2", "n/a", None),
    ("date", "1851-02-06T00:00:00Z", "1851-02-06"), ("date", "1889/04/01", "1889-04-01"), ("date", "08.09.1921", "1921-09-08"), ("date", "9 mai 1942", "1942-05-09"), ("date", "28. Februar 1663", "1663-02-28"),
    ("date", "Sep 9, 1936", "1936-09-09"), ("date", "1 décembre 1508", "1508-12-01"), ("date", "1789-02-31", None), ("date", "0000-00-00", None), ("date", "s.d.", None), ("date", "undated", None), ("date", "29 February 1900", None),
    ("bool", "Y", "true"), ("bool", "nein", "false"), ("bool", "TRUE", "true"), ("bool", "0", "false"), ("bool", "?", None),
    ("text", "  oil ", "oil"), ("text", "unknown", None), ("text", "", None), ("text", None, None),
]


def test_casts(spark):
    rows = [(i, t, v) for i, (t, v, _) in enumerate(CASES)]
    unit = F.when(F.col("t") == "int_mm", "cm").when(F.col("t") == "int_g", "g")
    found = spark.createDataFrame(rows, "i int, t string, v string").select("i", typed_text(F.col("v"), F.col("t"), unit).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in found] == [x for _, _, x in CASES]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "attr string, col_type string, bare_unit string")


def triples(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "subject string, predicate string, object string, attr string")


def test_pivot_resolves_repeats_and_types(spark, catalog):
    rows = [
        ("<u:a>", "http://x/HEIGHT", "10 cm"), ("u:a", "http://y#height", "100mm"), ("u:a", "http://x/height", "50 cm"), ("u:a", "http://x/technique", "oil"), ("u:a", "http://x/technique", '"gold"@fr'),
        ("u:a", "http://x/technique", "oil"), ("u:a", "http://x/day", "tbd"), ("u:b", "http://x/day", "undated"), ("u:c", "http://x/other", "1"), (None, "http://x/day", "1900-01-01"), ("u:d", "http://x/shown", None),
        ("u:e", "http://x/title", "_:b3"), ("u:f", "http://x/worth", "x" * 100_000), ("u:g", None, "1"), ("u:h", "http://x/shown", "ja"),
    ]
    found = sorted(tuple(r) for r in wide.cells(triples(spark, rows), catalog).collect())
    assert found == [("u:a", "height", "100"), ("u:a", "technique", "gold"), ("u:a", "technique", "oil"), ("u:h", "shown", "true")]
    real = {r["subject"]: r for r in wide.typed_wide(triples(spark, rows), catalog).collect()}
    assert real["u:a"]["height"] == 100 and real["u:a"]["technique"] == ["gold", "oil"] and real["u:h"]["shown"] is True and "absent" not in real["u:a"].asDict()


def test_empty(spark, catalog):
    assert wide.cells(triples(spark, []), catalog).count() == 0
    assert wide.cells(triples(spark, [("u:c", "http://x/other", "1")]), catalog).columns == ["subject", "attr", "val"]
