"""Every registered query with a SQL check agrees with it on whole tables."""

import pytest

from workload.compare import differences
from workload.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), CHECKS[name], sf_dir) is None


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
