"""Every registered query with a SQL check gives the same rows on the small tables."""

import pytest

from tests.compare import checking_db, difference
from wardline.catalog import ORACLES, QUERIES, models

@pytest.fixture(scope="module")
def con(sf_dir):
    return checking_db(sf_dir)


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """What the checks compare does not depend on the number of rounds; each takes a quarter of a second."""
    monkeypatch.setattr(models, "PARAMS", {"maxIter": 5, "maxDepth": 4})


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


def test_checks_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
