"""The ladder of proofs: one event for each stage, and rows that moved to other numbers followed through a batch."""

from stratalog.operators import ladder, sequence
from tests.test_rewind import event, journal, point
from tests.test_sequence import keyed, layer

ROWS = {
    1: ({"id": 1, "a": 1, "b": 1}, point(1)),
    2: ({"id": 2, "a": 9, "b": 9}, point(2)),
    30: ({"id": 30, "a": 3, "b": 3}, point(3)),
    31: ({"id": 31, "a": 3, "b": 3}, point(3)),
    40: ({"id": 40, "a": 4, "b": 44}, point(4)),
    50: ({"id": 50, "a": 5, "b": 5}, point(55)),
    6: ({"id": 6, "a": 6, "b": 0}, point(66)),
    7: ({"id": 7, "a": 70, "b": 70}, point(77)),
}


def inserted(n, number, a, b, shape):
    return event(n, number, "INSERT", {"all_attributes": {"id": number, "a": a, "b": b}}, shape, shape)


def test_removals(spark):
    events = [
        keyed(inserted(1, 900, 0, 0, point(0)), 2),
        inserted(2, 1, 1, 1, point(1)),
        inserted(3, 3, 3, 3, point(3)),
        inserted(4, 4, 4, 4, point(4)),
        inserted(5, 5, 5, 5, point(5)),
        inserted(6, 6, 6, 66, point(6)),
        inserted(7, 7, 1000, 1000, point(1000)),
        inserted(8, 800, 1000, 1000, point(1000)),
    ]
    events[1] = (*events[1][:8], '{"all_attributes": {"id": 1, "a": 1, "b": 1}}', *events[1][9:])
    found = {r["event_id"]: (r["stage"], r["target_fid"]) for r in ladder.removals(journal(spark, events), layer(spark, ROWS), ("id",)).collect()}
    assert found == {
        1: ("key", 2), 2: ("number", 1), 3: ("snapshot", 31), 4: ("but_one", 40), 5: ("values", 50), 6: ("evidence", 6), 7: ("gone", None), 8: ("absent", None),
    }


def test_updates(spark):
    change = lambda n, number, a, b, old=None, new=None: event(n, number, "UPDATE", {"changed_only": {"a": {"old": a[0], "new": a[1]}, "b": {"old": b[0], "new": b[1]}}}, old, new)
    events = [
        keyed(change(1, 900, (0, 1), (0, 1)), 2),
        change(2, 1, (0, 1), (0, 1)),
        change(3, 5, (0, 5), (0, 5), point(0), point(55)),
        change(4, 4, (0, 4), (0, 44)),
        change(5, 2, (9, 8), (9, 8)),
        change(6, 7, (0, 1000), (0, 1000)),
        change(7, 800, (0, 3), (0, 3)),
    ]
    found = {r["event_id"]: (r["stage"], r["target_fid"]) for r in ladder.updates(journal(spark, events), layer(spark, ROWS), ("id",)).collect()}
    assert found == {
        1: ("key", 2), 2: ("number", 1), 3: ("elsewhere", 50), 4: ("elsewhere", 40), 5: ("already_at_old", None), 6: ("unproven", None), 7: ("absent", None),
    }


def test_events_follow_a_row_to_its_new_number(spark):
    events = [
        event(1, 5, "INSERT", {"all_attributes": {"a": 1, "b": 1}}, point(1), point(1)),
        event(2, 5, "UPDATE", {"changed_only": {"a": {"old": 1, "new": 2}}}, point(1), point(2)),
        event(3, 5, "UPDATE", {"changed_only": {"a": {"old": 2, "new": 3}}}, point(2), point(3)),
    ]
    rows = {5: ({"a": 70, "b": 7}, point(8)), 9: ({"a": 3, "b": 1}, point(3))}
    held, j = layer(spark, rows), journal(spark, events)
    done = sequence.restored(j, held, relocate=True)
    assert {r["event_id"]: (r["reason"], r["found_by"]) for r in done.events.collect()} == {3: ("taken_back", "content"), 2: ("taken_back", "content"), 1: ("deleted", "content")}
    assert [r["fid"] for r in sequence.rows_after(held, done).collect()] == [5]
    stay = sequence.restored(j, held)
    assert {r["reason"] for r in stay.events.collect()} == {"geometry_mismatch", "only_the_number_matches"}
