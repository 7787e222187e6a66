"""Every registered query of the engine against its SQL, and the shape of the plans that matter at scale."""

import decimal
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import repository_queries, scenarios  # noqa: F401
from tidemark.plans.resolve import resolve

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(scenarios.QUERIES))
def test_query_matches_sql(spark, base, name):
    df = scenarios.QUERIES[name](spark, DATA)
    want = base.sql(scenarios.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert ours == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_resolution_is_one_shuffle_and_pushes_keys_only(spark, tmp_path):
    scenarios.part_log(spark, DATA).write.partitionBy("branch_id").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    text = plan(resolve(log, scenarios.CHAIN2, scenarios.PK).where("p_partkey = 7 AND p_brand = 'x'"))
    assert text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text
    assert re.search(r"PushedFilters: \[[^\]]*p_partkey", text) and not re.search(r"PushedFilters: \[[^\]]*p_brand", text)
    assert re.search(r"PartitionFilters: \[[^\]]*branch_id", text)
    pruned = plan(resolve(log, scenarios.CHAIN1, scenarios.PK).select("p_partkey", "p_size"))
    assert "p_name" not in re.search(r"ReadSchema: (\S+)", pruned)[1]


def test_a_value_filter_below_the_choice_would_be_wrong(spark):
    """The hazards that the order of choice, tombstones and filters guards against."""
    log = scenarios.part_log(spark, DATA)
    right = resolve(log, scenarios.CHAIN2, scenarios.PK).where("p_brand <> 'Brand#99'").count()
    assert right != resolve(log.where("p_brand <> 'Brand#99' OR op = 3"), scenarios.CHAIN2, scenarios.PK).count()
    gone = resolve(log, scenarios.CHAIN1, scenarios.PK).count()
    assert gone != resolve(log.where(F.col("op") != 3), scenarios.CHAIN1, scenarios.PK).count()
