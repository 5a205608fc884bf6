from itertools import pairwise

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from civicspark.operators.snapshots import etag_value, http_instant, inventory_changes, snapshot_changes

COLS = "snapshot_no int, pdf_url string, etag string, last_modified string, last_checked timestamp, state string"


def rows(spark, data):
    frame = spark.createDataFrame([(s, u, e, m, None, "clash") for s, u, e, m in data], COLS)
    return inventory_changes(frame)


def test_kinds_of_change(spark):
    a, b = '"x-1"', '"x-2"'
    day, iso, other = "Fri, 01 Mar 2024 10:00:00 GMT", "2024-03-01T12:00:00+02:00", "Sat, 02 Mar 2024 10:00:00 GMT"
    got = rows(spark, [
        (1, "same", a, day), (2, "same", f"W/{a}", iso), (3, "same", 'x-1', "Fri Mar  1 10:00:00 2024"),
        (1, "gone", a, day), (2, "gone", a, day), (3, "other", a, day),
        (1, "tag", a, day), (2, "tag", None, None), (3, "tag", b, day),
        (1, "time", None, day), (2, "time", None, other), (3, "time", None, other),
        (1, "back", a, day), (3, "back", b, other),
        (1, "twice", a, day), (1, "twice", a, day), (2, "twice", '"x-1-gzip"', None), (3, "twice", a, day),
        (1, "late", None, None), (2, "late", a, None), (3, "late", a, None),
        (2, None, a, day), (None, "n", a, day),
    ])
    assert sorted(map(tuple, got.collect())) == [
        (2, "back", "removed"), (2, "time", "changed"), (3, "back", "added"), (3, "gone", "removed"), (3, "other", "added"), (3, "tag", "changed"),
    ]


def test_empty(spark):
    assert rows(spark, []).count() == 0


def test_failed_buckets_are_enlarged(spark):
    a = spark.range(3000).select(F.lit(1).alias("snapshot"), F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    b = spark.range(1500, 5000).select(F.lit(2).alias("snapshot"), F.col("id").cast("string").alias("key"), F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("v"))
    got = {r[0]: r[1] for r in snapshot_changes(a.unionByName(b), first_cells=8, bucket_keys=200).groupBy("change_type").count().collect()}
    assert got == {"removed": 1500, "added": 2000, "changed": 750}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.integers(0, 12), st.integers(0, 2), max_size=10), min_size=2, max_size=4))
def test_against_brute_force(spark, states):
    data = [(s, str(k), v) for s, d in enumerate(states, 1) for k, v in d.items()]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(data, "snapshot int, key string, v int")).collect()}
    first, last = min((s for s, *_ in data), default=0), max((s for s, *_ in data), default=0)
    want = set()
    for s, (a, b) in enumerate(pairwise(states), 2):
        if not first < s <= last:
            continue
        want |= {(s, str(k), "added") for k in b.keys() - a.keys()} | {(s, str(k), "removed") for k in a.keys() - b.keys()} | {(s, str(k), "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert got == want


def test_spellings(spark):
    frame = spark.createDataFrame([("Tue, 31 May 2022 21:07:17 GMT",), ("2022-05-31T23:07:17+02:00",), ("Tue May 31 21:07:17 2022",), ("Tuesday, 31-May-22 21:07:17 GMT",), ("2022-05-31T21:07:17Z",), ("nonsense",), (None,)], "t string")
    got = [r[0] for r in frame.select(http_instant(F.col("t"))).collect()]
    assert got[:5] == [1654031237] * 5 and got[5:] == [None, None]
    tags = spark.createDataFrame([('W/"a-gzip"',), ("a",), ('"a"',), ("",), (None,)], "t string").select(etag_value(F.col("t"))).collect()
    assert [r[0] for r in tags] == ["a", "a", "a", None, None]
