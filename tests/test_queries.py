import pytest

from tests.compare import both
from tidelog import queries


@pytest.mark.parametrize("key", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sf, key):
    got, want = both(queries.QUERIES[key](spark, sf), queries.ORACLES[key], sf)
    assert got[0] == want[0]
    assert got[1] == want[1]
    if key not in ("shard_progress_explode",):
        assert want[1]
