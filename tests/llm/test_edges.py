"""Every query of the problems on empty tables, on rows of nulls, and on tables with extra columns of any name."""

import pytest
from pyspark.sql import functions as F

from civicspark.llm import queries
from civicspark.operators import snapshots

TABLES = ("document_metadata", "chunks", "documents", "eval_items", "source_targets", "site_inventory")
#: Names that operators use within.
CLASHING = "id key n text value token source document piece leaf home shard visit h r l a b form name place entity pair bucket cell snapshot word skeleton kind lines".split()
QUERIES = {**queries.queries(), "p4_found": lambda s, d: snapshots.inventory_changes(s.read.parquet(f"{d}/site_inventory.parquet"))}


@pytest.fixture(scope="module")
def folders(spark, data, tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    for name in TABLES:
        table = spark.read.parquet(f"{data}/{name}.parquet")
        table.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
        nulls = table.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields])
        nulls.write.parquet(f"{root}/nulls/{name}.parquet")
        free = [c for c in CLASHING if c not in table.columns]
        table.unionByName(nulls).select("*", *[F.lit(i).alias(c) for i, c in enumerate(free)]).write.parquet(f"{root}/clashing/{name}.parquet")
    return root


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_to_find(spark, folders, name, kind):
    found = QUERIES[name](spark, f"{folders}/{kind}")
    assert found.count() == 0 or name in ("p9_shares", "p10_redacted")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith("_found")))
def test_extra_columns_and_null_rows_change_nothing(spark, data, folders, name):
    assert set(map(tuple, QUERIES[name](spark, data).collect())) == set(map(tuple, QUERIES[name](spark, f"{folders}/clashing").collect()))
