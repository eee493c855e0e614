import os

import pytest

from stratalog.plans import catalog, details, restoring  # noqa: F401
from tests.oracle import duck, mismatch

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose rare cases only the larger tables have.
RARE = ["undo_traces", "state_at", "snapshot_counts", "rewind_events", "strict_outcomes", "event_restores", "purge_pairs", "session_undo"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, SF_DIR)
    if name in catalog.ORACLES:
        assert mismatch(found, con, catalog.ORACLES[name]) is None
    else:
        assert found.count() > 0


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize("name", RARE)
def test_query_on_larger_tables(spark, name):
    assert mismatch(catalog.QUERIES[name](spark, LARGER), duck(LARGER), catalog.ORACLES[name]) is None
