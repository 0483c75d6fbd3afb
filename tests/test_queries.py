"""Every registered query against its oracle on the smallest scale."""

import os

import pytest

import __spark_entry__ as job

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def oracle():
    import check

    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(job.queries()))
def test_query(spark, oracle, name):
    import check

    ok, note = check.compare(spark, oracle, FOLDER, name)
    assert ok, note


def test_entry(spark):
    out = job.entry(spark)
    assert out.columns == ["config_label", "n_scenarios", "section_precision_mean", "section_recall_mean"] and out.count() == 2


def test_oracles_belong_to_queries():
    assert set(job.oracle_sql()) <= set(job.queries())
