"""Every registered query against its SQL twin on the smallest sample tables."""

import os

import pytest

from checks.catalog import ORACLES, QUERIES
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_every_query_without_twin_is_known():
    assert sorted(set(QUERIES) - set(ORACLES)) == [
        "predict_binary", "search_text", "tag_articles", "train_binary", "train_industry"]
