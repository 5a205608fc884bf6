"""Every query of the core against its SQL in another engine, on the smallest tables."""

import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

from civicspark.catalog import CATALOG
from civicspark.queries import oracle_sql, queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def connection(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


def plain(value):
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return str([plain(x) for x in value])
    if isinstance(value, list):
        return str([plain(x) for x in value])
    if value is None or pd.isna(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, data, connection, name):
    got = rows(queries()[name](spark, data).toPandas())
    assert got == rows(connection.execute(oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs_without_sql(spark, data, name):
    """The schema is stable, and what a query gives twice is the same."""
    first, again = queries()[name](spark, data), queries()[name](spark, data)
    assert first.schema == again.schema and rows(first.toPandas()) == rows(again.toPandas())


def test_operators_have_queries():
    """No operator of the inventory that is data work is without a query."""
    covered = " ".join(covers for covers, _, _ in CATALOG.values())
    for code in ("S13", "K7", "F4", "J14", "A22", "W5", "O8", "U4", "T22", "D13", "X8", "G11", "Q16", "R13", "V7", "I3", "Z50"):
        assert code in covered.split()


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """The tables empty, and with rows of nulls added."""
    root = tmp_path_factory.mktemp("odd")
    for name in os.listdir(data):
        table = spark.read.parquet(f"{data}/{name}")
        nulls = table.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])
        table.limit(0).write.parquet(f"{root}/empty/{name}")
        table.unionByName(nulls).write.parquet(f"{root}/nulls/{name}")
    return root


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", ["agenda_items", "answered_interpellations", "balanced_search", "chunk_windows", "commission_members", "deduplicated_documents", "fuzzy_title_links", "hybrid_search", "letter_dates", "minutes_parts", "motion_parts", "object_cards", "preavis_parts", "preindex_findings", "recognized_pages", "regulation_articles", "removed_blocks", "response_events", "session_items", "teasers", "vector_topk"])
def test_empty_tables_and_nulls(spark, odd, name, kind):
    assert queries()[name](spark, f"{odd}/{kind}").count() >= (1 if kind == "nulls" else 0)
