"""Cases in which registered queries failed on larger tables."""

import pytest
from pyspark.sql import functions as F

from stratalog.operators import sequence
from tests.test_rewind import event, journal
from tests.test_sequence import keyed, layer


@pytest.mark.parametrize("few", [64, 0])
def test_rows_of_one_number_are_restored_each_on_its_own(spark, few):
    held = layer(spark, {8: ({"id": 8, "a": 1}, None), 9: ({"id": 9, "a": 1}, None), 10: ({"id": 10, "a": 2}, None), 11: ({"id": 11}, None), 12: ({"id": 12}, None)})
    number = F.when(F.col("fid") < 10, 900).when(F.col("fid") > 10, 901).otherwise(10)
    rows = held.withColumn("fid", number.cast("long"))
    change = lambda old, new: {"changed_only": {"a": {"old": old, "new": new}}}
    events = [keyed(event(1, 900, "UPDATE", change(0, 5)), 8), event(2, 900, "UPDATE", change(5, 1)), event(3, 10, "UPDATE", change(1, 2))]
    done = sequence.restored(journal(spark, events), rows, ("id",), few=few)
    told = sorted((r["event_id"], r["slot"].replace("\u0001", ":"), r["reason"]) for r in done.events.collect())
    assert told == [(1, "row:900", "taken_back"), (2, "row:900", "taken_back"), (2, "row:900", "taken_back"), (3, "row:10", "taken_back")]
    left = sorted((r["fid"], r["slot"].replace("\u0001", ":"), sorted(r["attributes"].items())) for r in sequence.rows_after(rows, done).collect())
    assert left == [
        (10, "row:10", [("a", "1"), ("id", "10")]),
        (900, "row:900", [("a", "0"), ("id", "8")]),
        (900, "row:900", [("a", "5"), ("id", "9")]),
        (901, "row:901", [("id", "11")]),
        (901, "row:901", [("id", "12")]),
    ]
