"""The state at many instants against one reading for each."""

import json

import pytest

from stratalog.operators import intervals, snapshot
from tests.test_rewind import event, journal, point, stamp, world


def test_many_instants_equal_single_ones(spark):
    rows, states = world(11, 150, entities=12)
    rows.append(event(200, 3, "UPDATE", {"_restore_ref": 20}, ref=20, created=stamp(149)))
    j = journal(spark, rows)
    cutoffs = [stamp(n) for n in range(0, 150, 3)] + ["2024-03-01T00:00:41", "2023-01-01T00:00:00+00:00", "2030-01-01T00:00:00+00:00", stamp(30)]
    found = intervals.states_at(j, cutoffs)
    by = {}
    for r in found.collect():
        by.setdefault(r["at"], {})[r["entity"]] = r
    assert set(by) <= set(cutoffs) and "2023-01-01T00:00:00+00:00" not in by
    for n in range(0, 149, 3):
        now = {int(k.split(":")[1]): {f: json.loads(v) for f, v in r["attributes"].items()} for k, r in by.get(stamp(n), {}).items()}
        assert now == {e: attributes for e, (attributes, _) in states[n].items()}
    for at in (stamp(60), "2024-03-01T00:00:41", "2030-01-01T00:00:00+00:00"):
        single = {r["entity"]: r for r in snapshot.state_at(j, at).collect()}
        assert {k: {c: r[c] for c in r.asDict() if c != "at"} for k, r in by[at].items()} == {k: r.asDict() for k, r in single.items()}


def test_an_interval_ends_where_the_next_value_begins(spark):
    rows = [event(n, 1, "UPDATE", {"changed_only": {"v": {"old": n, "new": n + 1}}}, point(n), point(n + 1), created=stamp(10 * n)) for n in range(1, 5)]
    cutoffs = [stamp(n) for n in (5, 12, 14, 20, 99)]
    held = intervals.intervals(journal(spark, rows), cutoffs).where("kind = 0").orderBy("since").collect()
    assert [(r["v"]["value"], r["since"], r["until"]) for r in held] == [("2", 1, 3), ("3", 3, 4), ("5", 4, 5)]


def test_refusals(spark):
    j = journal(spark, [event(1, 1, "INSERT", {"all_attributes": {"v": 1}}, point(1), point(1), created="2024-03-01T02:00:00+02:00")])
    with pytest.raises(ValueError):
        intervals.states_at(j, [])
    with pytest.raises(Exception, match="not a uniform time"):
        intervals.states_at(j, [stamp(1)]).count()
    assert intervals.states_at(journal(spark, []), [stamp(1)]).count() == 0


def test_values_are_dealt_by_entity_and_not_by_instant(spark):
    rows = [event(n, n, "INSERT", {"all_attributes": {"v": n}}, None, point(n), created=stamp(1)) for n in range(1, 5)]
    found = intervals.states_at(journal(spark, rows), [stamp(n) for n in range(2, 8)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not [x for x in dealt if " at#" in x or "(at#" in x]
    assert found.count() == 4 * 6 and len(found.collect()) == 4 * 6
