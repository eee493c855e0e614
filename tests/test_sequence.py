"""Restores in sequence against a model that writes to its rows one event after another."""

import json
import random

import pytest

from stratalog.operators import claims, sequence
from tests.test_rewind import DS, event, journal, point

ROWS = "datasource_fingerprint string, fid long, attributes map<string,string>, geometry_wkb binary"


def keyed(row, key):
    out = list(row)
    out[6] = json.dumps({"fid": 900, "pk_field": "id", "pk_value": str(key)})
    return tuple(out)


def _sides(row):
    body = json.loads(row[8])
    if "all_attributes" in body:
        return body["all_attributes"], body["all_attributes"]
    delta = {f: d for f, d in body.get("changed_only", {}).items() if f != "updated_at"}
    return {f: d["old"] for f, d in delta.items()}, {f: d["new"] for f, d in delta.items()}


def _claims(deletes, rows):
    """Rounds of claims, pair by pair."""
    fits = {}
    for e in deletes:
        want = {f: v for f, v in _sides(e)[0].items() if v is not None and f != "id"}
        if want:
            shape = e[9]
            fits[e[0]] = (tuple(sorted(want)), shape, [r for r in sorted(rows) if all(f in rows[r][0] and rows[r][0][f] == v for f, v in want.items()) and (shape is None or rows[r][1] == shape)])
    won, free, waiting = {}, set(rows), [e[0] for e in deletes if e[0] in fits]
    while True:
        asks, place = {}, {}
        for e in waiting:
            cls = (fits[e][0], fits[e][1], tuple(fits[e][2]))
            left = [r for r in fits[e][2] if r in free]
            n = place.get(cls, 0)
            place[cls] = n + 1
            if n < len(left):
                asks.setdefault(left[n], e)
        if not asks:
            return won
        for r, e in asks.items():
            won[e] = r
            free.discard(r)
        waiting = [e for e in waiting if e not in won]


def model(events, rows):
    """Reasons and rows left; ``rows``: fid -> (attributes, shape). Events come in the order of the restore."""
    state = {f"row{f}": (dict(a), s) for f, (a, s) in rows.items()}
    by_key = {}
    for f in sorted(rows, reverse=True):
        if "id" in rows[f][0]:
            by_key[str(rows[f][0]["id"])] = f
    twins, again, reasons = _claims([e for e in events if e[7] == "DELETE"], rows), {}, {}
    for e in events:
        identity, (old, new), op = json.loads(e[6]), _sides(e), e[7]
        is_keyed = "pk_field" in identity
        if is_keyed:
            k = identity["pk_value"]
            slot = f"row{by_key[k]}" if k in by_key else f"key{k}"
        else:
            n = identity["fid"]
            slot = again.get(n, f"row{n}" if n in rows else f"fid{n}")
            if op == "DELETE":
                slot = f"new{e[0]}"
                again[n] = f"row{twins[e[0]]}" if e[0] in twins else slot
        there = slot in state
        now, shape = state.get(slot, ({}, None))
        shared = [f for f in new if f in now]
        as_left = shared and all(now[f] == new[f] for f in shared) and (e[19] is None or shape == e[19])
        at_old = all(f in now and now[f] == v for f, v in old.items()) and (e[9] is None or shape == e[9]) and (old or e[9] is not None)
        if op == "DELETE":
            reason = "key_is_there" if there else "twin_is_there" if e[0] in twins else "inserted"
        elif op == "INSERT":
            reason = "target_is_gone" if not there else "deleted" if is_keyed or as_left else "only_the_number_matches"
        elif not there:
            reason = "target_absent"
        elif at_old:
            reason = "already_at_old"
        elif is_keyed:
            reason = "taken_back"
        elif e[19] is not None:
            reason = "taken_back" if shape == e[19] else "geometry_mismatch"
        elif not new:
            reason = "nothing_captured"
        elif not shared:
            reason = "nothing_to_compare"
        else:
            reason = "taken_back" if all(now[f] == new[f] for f in shared) else "attribute_mismatch"
        reasons[e[0]] = reason
        if reason == "inserted":
            state[slot] = (dict(old), e[9])
        elif reason == "deleted":
            del state[slot]
        elif reason == "taken_back":
            state[slot] = ({f: old.get(f, v) for f, v in now.items()}, e[9] if e[9] is not None else shape)
    return reasons, state


def layer(spark, rows):
    return spark.createDataFrame([(DS, f, {k: json.dumps(v) for k, v in a.items()}, s) for f, (a, s) in rows.items()], ROWS)


def run(spark, events, rows, parts=None):
    held = layer(spark, rows)
    done = sequence.restored(journal(spark, events), held, ("id",), parts=parts)
    reasons = {r["event_id"]: r["reason"] for r in done.events.collect()}
    left = {}
    for r in sequence.rows_after(held, done).collect():
        name = r["slot"].replace("key\u0001id\u0001", "key").replace("\u0001", "")
        left[name] = ({k: json.loads(v) for k, v in r["attributes"].items()}, r["geometry_wkb"] and bytes(r["geometry_wkb"]))
    return reasons, left


def test_two_updates_of_one_row_are_both_taken_back(spark):
    events = [
        event(1, 5, "UPDATE", {"changed_only": {"a": {"old": 1, "new": 2}}}),
        event(2, 5, "UPDATE", {"changed_only": {"a": {"old": 2, "new": 3}}}),
    ]
    reasons, left = run(spark, events, {5: ({"a": 3}, None)})
    assert reasons == {1: "taken_back", 2: "taken_back"} and left == {"row5": ({"a": 1}, None)}


def test_a_refused_update_stops_what_needs_it_but_not_the_rest(spark):
    change = lambda n, a, b: event(n, 5, "UPDATE", {"changed_only": {"a": {"old": a, "new": b}}})
    events = [change(1, 0, 9), change(2, 1, 2), change(3, 2, 3), change(4, 7, 8), change(5, 3, 9)]
    reasons, left = run(spark, events, {5: ({"a": 3}, None)})
    assert reasons == {5: "already_at_old", 4: "attribute_mismatch", 3: "taken_back", 2: "taken_back", 1: "attribute_mismatch"}
    assert left == {"row5": ({"a": 1}, None)}


def test_a_number_follows_the_row_that_was_inserted_again(spark):
    events = [
        event(1, 5, "INSERT", {"all_attributes": {"a": 1}}, None, point(1)),
        event(2, 5, "UPDATE", {"changed_only": {"a": {"old": 1, "new": 2}}}),
        event(3, 5, "DELETE", {"all_attributes": {"a": 2}}, point(1)),
    ]
    other = {5: ({"a": 70}, point(8))}
    reasons, left = run(spark, events, other)
    assert reasons == {3: "inserted", 2: "taken_back", 1: "deleted"} and left == {"row5": other[5]}
    reasons, left = run(spark, events[1:], other)
    assert left == {"row5": other[5], "new3": ({"a": 1}, point(1))}


def test_no_row_is_claimed_twice(spark):
    same = [event(n, n, "DELETE", {"all_attributes": {"a": 1}}, point(2)) for n in (1, 2, 3)]
    wider = event(4, 4, "DELETE", {"all_attributes": {"a": 1, "b": 1}}, point(2))
    rows = {10: ({"a": 1, "b": 1}, point(2)), 11: ({"a": 1, "b": 2}, point(2))}
    found = claims.claimed_twins(journal(spark, [*same, wider]), layer(spark, rows), parts=3).collect()
    assert {(r["event_id"], r["fid"]) for r in found} == {(4, 10), (2, 11)}
    reasons, left = run(spark, same, rows)
    assert reasons == {3: "twin_is_there", 2: "twin_is_there", 1: "inserted"} and len(left) == 3


@pytest.mark.parametrize("seed, parts", [(1, None), (2, 9)])
def test_against_the_model(spark, seed, parts):
    rng = random.Random(seed)
    rows = {f: ({"id": f, "a": rng.randrange(3), "b": rng.choice([None, 1, 2])}, rng.choice([None, point(1), point(2)])) for f in range(1, 9)}
    events = []
    for n in range(1, 100):
        entity = rng.choice([3, rng.randrange(1, 14)])
        op = rng.choice(["UPDATE"] * 5 + ["INSERT", "DELETE"])
        if op == "UPDATE":
            names = rng.choice([["a"], ["b"], ["a", "b"], ["c"], []])
            body = {"changed_only": {f: {"old": rng.randrange(3), "new": rng.randrange(3)} for f in names}}
            moved = (point(rng.randrange(1, 3)), point(rng.randrange(1, 3))) if rng.random() < 0.3 else (None, None)
        else:
            body = {"all_attributes": {"id": entity, "a": rng.randrange(3), "b": rng.choice([None, 1])}}
            shape = point(rng.randrange(1, 3))
            moved = (shape, shape if op == "INSERT" else None)
        row = event(n, entity, op, body, *moved)
        events.append(keyed(row, entity) if entity % 3 == 0 or rng.random() < 0.2 else row)
    reasons, left = run(spark, events, rows, parts)
    want, state = model(events[::-1], rows)
    assert reasons == want
    assert left == state
    assert len(set(want.values())) >= 10


def test_nothing_to_restore(spark):
    rows = {1: ({"a": 1}, None)}
    assert run(spark, [], rows) == ({}, {"row1": ({"a": 1}, None)})
    assert run(spark, [event(1, 1, "UPDATE", {})], {}) == ({1: "target_absent"}, {})
