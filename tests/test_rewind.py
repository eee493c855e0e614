"""Rewind against a sequential model: edits of a small world, its journal, and the way back."""

import json
import random
import struct

from pyspark.sql import functions as F

from stratalog.functions import payload
from stratalog.operators import applying, planning, rewind, snapshot
from stratalog.sources.journal import JOURNAL

DS = "ogr::/d/a.gpkg|layername=l"


def point(x):
    return struct.pack("<BIdd", 1, 1, float(x), 0.0)


def stamp(n):
    return f"2024-03-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}+00:00"


def event(n, entity, op, attributes, old=None, new=None, ref=None, created=None, ds=DS):
    body = json.dumps(attributes)
    fields = {
        "event_id": n, "project_fingerprint": "p", "datasource_fingerprint": ds, "layer_name_snapshot": "a", "provider_type": "ogr",
        "feature_identity_json": json.dumps({"fid": entity}), "operation_type": op, "attributes_json": body, "geometry_wkb": old,
        "user_name": "u", "session_id": None if ref else "s", "created_at": created or stamp(n), "restored_from_event_id": ref,
        "entity_fingerprint": f"fid:{entity}", "event_schema_version": 6, "new_geometry_wkb": new,
    }
    return tuple(fields.get(f.name) for f in JOURNAL.fields)


def journal(spark, rows):
    return spark.createDataFrame(rows, JOURNAL)


def world(seed, steps, entities=6, first=0):
    """Consistent edits: the journal rows and the state after each."""
    rng, state, rows, states = random.Random(seed), {}, [], []
    for n in range(first, first + steps):
        e = rng.randrange(entities)
        if e not in state:
            state = {**state, e: ({"v": n, "t": "x"}, point(n))}
            rows.append(event(n, e, "INSERT", {"all_attributes": state[e][0]}, state[e][1], state[e][1]))
        elif rng.random() < 0.25:
            rows.append(event(n, e, "DELETE", {"all_attributes": state[e][0]}, state[e][1]))
            state = {k: v for k, v in state.items() if k != e}
        else:
            old, shape = state[e]
            field = rng.choice("vt")
            new, moved = {**old, field: rng.choice([None, n, f"w{n}"])}, point(n) if rng.random() < 0.4 else None
            delta = {field: {"old": old[field], "new": new[field]}} if new != old else {}
            rows.append(event(n, e, "UPDATE", {"changed_only": delta}, shape if moved else None, moved))
            state = {**state, e: (new, moved or shape)}
        states.append(dict(state))
    return rows, states


def plain(frame):
    cut = lambda e: int(e.split(":")[1].split("@")[0])
    return {cut(r["entity"]): ({k: json.loads(v) for k, v in r["attributes"].items()}, bytes(r["geometry_wkb"])) for r in frame.collect()}


def test_state_follows_the_edits(spark):
    rows, states = world(1, 120)
    j = journal(spark, rows)
    for n in (0, 40, 119):
        assert plain(snapshot.state_at(j, stamp(n))) == states[n]


def test_rewind_gives_the_state_of_the_cutoff(spark):
    rows, states = world(5, 160, entities=20)
    j = journal(spark, rows)
    cut = 110
    events = rewind.rewind_events(rewind.window_events(j, rewind.Cutoff(stamp(cut))))
    # Ids that were used again are other entities; this world has one life for each id only where no split is found.
    split = {r["entity"].split("@")[0] for r in events.select("entity").collect() if "@" in r["entity"]}
    now = snapshot.state_at(j, stamp(10_000))
    back = plain(applying.apply_plan(now, applying.outcomes(now, events)))
    keep = lambda s: {k: v for k, v in s.items() if f"fid:{k}" not in split}
    assert keep(back) == keep(states[cut - 1])
    assert planning.preflight(events, rewind.Cutoff(stamp(cut))).first()["verdict"] in ("GO", "GO_WITH_WARNINGS")


def test_traces_neutralise_what_they_compensated(spark):
    rows = [
        event(1, 1, "INSERT", {"all_attributes": {"v": 1}}, point(1), point(1)),
        event(10, 1, "UPDATE", {"changed_only": {"v": {"old": 1, "new": 2}}}),
        event(11, 1, "UPDATE", {"changed_only": {"v": {"old": 2, "new": 3}}}),
        event(20, 1, "UPDATE", {"_restore_ref": 10}, ref=10),
        event(30, 1, "UPDATE", {"changed_only": {"v": {"old": 1, "new": 9}}}),
    ]
    out = rewind.rewind_events(rewind.window_events(journal(spark, rows), rewind.Cutoff(stamp(5))))
    assert [r["event_id"] for r in out.collect()] == [30]
    stats = rewind.rewind_stats(rewind.window_events(journal(spark, rows), rewind.Cutoff(stamp(5)))).first()
    assert (stats["raw"], stats["user"], stats["traces_active"], stats["dedup_dropped"], stats["dedup_active"]) == (4, 3, 1, 2, 1)


def test_traces_of_traces_are_resolved(spark):
    rows = [
        event(1, 1, "DELETE", {"all_attributes": {"v": 7}}, point(3)),
        event(2, 1, "INSERT", {"_restore_ref": 1}, ref=1),
        event(3, 1, "DELETE", {"_restore_ref": 2}, ref=2),
        event(4, 1, "INSERT", {"_restore_ref": 3}, ref=3),
    ]
    j = journal(spark, rows)
    assert plain(snapshot.state_at(j, stamp(9))) == {1: ({"v": 7}, point(3))}
    assert snapshot.snapshot_counts(j, stamp(9)).first()["n_traces_resolved"] == 3


def test_updates_before_a_delete_are_fused(spark):
    rows = [
        event(1, 1, "UPDATE", {"changed_only": {"v": {"old": 1, "new": 2}}}, point(1), point(2)),
        event(2, 1, "UPDATE", {"changed_only": {"v": [2, 3]}}),
        event(3, 1, "DELETE", {"all_attributes": {"v": 3, "t": "x"}}, point(2)),
    ]
    (row,) = rewind.rewind_events(journal(spark, rows)).collect()
    assert (row["event_id"], row["operation_type"], row["fused"], bytes(row["geometry_wkb"])) == (1, "DELETE", 3, point(1))
    assert json.loads(row["attributes_json"]) == {"all_attributes": {"v": 1, "t": "x"}}


def test_long_chains_become_one_update(spark):
    rows = [event(n, 1, "UPDATE", {"changed_only": {"v": {"old": n, "new": n + 1}}}) for n in range(1, 13)]
    (row,) = rewind.rewind_events(journal(spark, rows)).collect()
    assert (row["event_id"], row["fused"], json.loads(row["attributes_json"])) == (1, 12, {"changed_only": {"v": {"old": 1, "new": 13}}})


def test_lives_within_the_window_leave_nothing(spark):
    ops = ["INSERT", "UPDATE", "INSERT", "DELETE", "DELETE"]
    rows = [event(n, 1, op, {"all_attributes": {"v": 1}} if op != "UPDATE" else {"changed_only": {}}) for n, op in enumerate(ops, 1)]
    assert rewind.survivors(journal(spark, rows).withColumn("entity", F.lit("e"))).count() == 0


def test_empty_journal_and_unreadable_cutoff(spark):
    empty = journal(spark, [])
    assert snapshot.state_at(empty, stamp(1)).count() == 0
    assert rewind.rewind_events(empty).count() == 0
    rows, _ = world(2, 30)
    for bad in ("", None, "soon"):
        assert rewind.window_events(journal(spark, rows), rewind.Cutoff(bad)).count() == 0


def test_broken_payloads_have_no_attributes(spark):
    rows = [(t,) for t in ("{bad", None, "", "[1]", '{"all_attributes": 5}')]
    out = spark.createDataFrame(rows, "attributes_json string").select(payload.as_text(payload.old_attributes()).alias("t"))
    assert {r["t"] for r in out.collect()} == {""}
