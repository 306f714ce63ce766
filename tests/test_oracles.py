"""Every registered query against its oracle SQL in DuckDB, at the smallest scale."""
import pytest

from tests import oracle
from tidelake import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.difference(df, con, ORACLES[name]) is None
    else:  # tests/test_fuzzy.py holds these against plain Python
        assert name in ("fuzzy_typo_evidence",)
        assert df.count() > 0
