"""Merges above the limit: refused unless the caller asks for them, by proposals and by the registered queries too."""

import os
import shutil
from functools import partialmethod

import pytest
from pyspark.sql import functions as F

from tidemark import repository_queries
from tidemark.cli import main as cli
from tidemark.repository import MERGE_LIMIT, Refused, Repository

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_large_proposal_is_merged_where_asked(spark, tmp_path):
    r = Repository.create(spark, str(tmp_path / "r"), "r", "ada")
    r.track("t", spark.range(MERGE_LIMIT + 1).select(F.col("id").alias("k"), F.lit(0).alias("v")), ["k"])
    r.branch("b")
    r.update_where("t", None, {"v": 1}, branch="b", author="bob")
    n = r.propose("b", "main", "All", "bob")
    with pytest.raises(Refused):
        r.merge_proposal(n, "t", "ada")
    assert r.proposals("merged").isEmpty() and r.read("t").where("v = 1").isEmpty()
    assert cli([r.path, "merge-proposal", str(n), "t", "ada", "--chunked"], spark) == 0
    r.refresh()
    assert r.proposals("merged").count() == 1 and r.read("t").where("v = 1").count() == MERGE_LIMIT + 1


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """The registered queries' repository over more customers than DATA has, where any merge is a large one."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    path = str(tmp_path_factory.mktemp("tables"))
    for name in ("part", "nation", "region"):
        shutil.copy(f"{DATA}/{name}.parquet", path)
    customers = spark.range(1, 301).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"), F.lit(1).alias("c_nationkey"))
    customers.write.parquet(f"{path}/customer.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Repository, "merge", partialmethod(Repository.merge, limit=0))
        repository_queries.shop(spark, path)
    return path


def test_the_registered_repository_is_built_whatever_the_size_of_part(spark, built):
    s = repository_queries.shop(spark, built)
    assert s.repo.proposals().first().state == "merged" and s.noted["refused"].count(("large",)) == 1


def test_erased_history_holds_every_customer(spark, built):
    names = {r.c_custkey: r.c_name for r in repository_queries.erased_history(spark, built).collect()}
    assert names == {k: "<erased>" if k == 7 else f"c{k}" for k in range(1, 301)}
    assert tuple(repository_queries.sealed_columns(spark, built).first()) == (200, True, True)
