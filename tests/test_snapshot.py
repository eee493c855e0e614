"""States, traces of traces and captured ids against sequential models."""

import json
import random

from pyspark.sql import functions as F


from stratalog.operators import rewind, snapshot
from stratalog.streaming import capture
from tests.test_rewind import event, journal, point, stamp


def brute_origins(rows):
    """Resolves traces one by one, recursively: event_id -> (full, geometry, delta, new geometry, missing)."""
    by = {r[0]: r for r in rows}
    names = ["full", "geometry", "delta", "moved", "missing"]
    done = {}

    def content(r):
        body = json.loads(r[8])
        full = body.get("all_attributes")
        delta = body.get("changed_only")
        return {"full": full, "geometry": r[9], "delta": delta, "moved": r[19], "missing": False}

    def resolve(i):
        if i in done:
            return done[i]
        r, own = by[i], content(by[i])
        ref = r[16]
        if ref is not None:
            s = by.get(ref)
            whole = r[7] in ("INSERT", "DELETE")
            usable = s is not None and s[17] == r[17] and s[2] == r[2] and (s[15], s[0]) < (r[15], r[0])
            told = resolve(ref) if usable else None
            usable = usable and (not whole or told["full"] is not None or told["geometry"] is not None)
            if not usable:
                own["missing"] = True
            elif whole:
                own |= {"full": told["full"], "geometry": told["geometry"], "delta": told["delta"]}
            else:
                turned = {k: {"old": v["new"], "new": v["old"]} for k, v in (told["delta"] or {}).items()}
                own |= {"full": None, "delta": turned, "moved": told["geometry"]}
        done[i] = own
        return own

    return {i: tuple(resolve(i)[n] for n in names) for i in by}


def chains(seed, n=240):
    rng, rows = random.Random(seed), []
    ids = rng.sample(range(10, 5000), n)
    for k, i in enumerate(ids):
        entity, op = rng.randrange(6), rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"])
        ref = rng.choice(ids[max(0, k - 12) : k + 3]) if rng.random() < 0.5 else None
        if ref is not None and rng.random() < 0.8:
            near = [r for r in rows if r[0] == ref]
            if near:
                entity, op = json.loads(near[0][6])["fid"], rng.choice([near[0][7], op])
        body = {"_restore_ref": ref} if ref else {"all_attributes": {"a": k}} if op != "UPDATE" else {"changed_only": {"a": {"old": k - 1, "new": k}}}
        shape = point(k) if rng.random() < 0.6 else None
        rows.append(event(i, entity, op, body, shape, point(-k) if rng.random() < 0.3 else None, ref, stamp(k)))
    return rows


def test_traces_of_traces_match_brute_force(spark):
    for seed in range(3):
        rows = chains(seed)
        want = brute_origins(rows)
        assert sum(r[16] is not None and not want[r[0]][4] for r in rows) > 20
        got = snapshot.effective_events(journal(spark, rows)).collect()
        assert len(got) == len(rows)
        for r in got:
            full, geometry, delta, moved, missing = want[r["event_id"]]
            read = lambda m: None if m is None else {k: json.loads(v) for k, v in m.items()}
            assert read(r["full"]) == full and r["missing"] == missing
            geometry_now = None if r["geometry_wkb"] is None else bytes(r["geometry_wkb"])
            assert geometry_now == geometry and (None if r["new_geometry_wkb"] is None else bytes(r["new_geometry_wkb"])) == moved
            pairs = None if r["delta"] is None else {k: {"old": json.loads(v["old"]), "new": json.loads(v["new"])} for k, v in r["delta"].items()}
            assert pairs == delta


def test_a_chain_whose_ids_come_late(spark):
    """Three traces of one another, in time order but with falling ids."""
    rows = [
        event(90, 1, "INSERT", {"all_attributes": {"v": 1}}, point(1), point(1), created=stamp(1)),
        event(80, 1, "DELETE", {"_restore_ref": 90}, ref=90, created=stamp(2)),
        event(70, 1, "INSERT", {"_restore_ref": 80}, ref=80, created=stamp(3)),
        event(60, 1, "DELETE", {"_restore_ref": 70}, ref=70, created=stamp(4)),
        event(50, 1, "INSERT", {"_restore_ref": 60}, ref=60, created=stamp(5)),
    ]
    j = journal(spark, rows)
    state = snapshot.state_at(j, stamp(9)).collect()
    assert [(r["last_event_id"], r["attributes"], bytes(r["geometry_wkb"])) for r in state] == [(50, {"v": "1"}, point(1))]
    assert snapshot.snapshot_counts(j, stamp(9)).first().asDict() == {"n_entities": 1, "n_absent": 0, "n_unknown": 0, "n_traces_resolved": 4, "n_traces_missing": 0}


def test_naive_cutoffs_are_prefixes(spark):
    rows = [event(n, n, "INSERT", {"all_attributes": {"v": n}}, created=stamp(n)) for n in range(1, 6)]
    j = journal(spark, rows)
    for at, last in (("2024-03-01T00:00:03", 2), ("2024-03-01T00:00:03+00:00", 3), ("2024-03-01T00:00:03Z", 3), ("2024-03-01", 0), ("2024-03-02", 5), ("2024-03-01T02:00:03+02:00", 3), ("junk", 0)):
        state = snapshot.state_at(j, at)
        assert sorted(r["last_event_id"] for r in state.collect()) == list(range(1, last + 1)), at
        window = {r["event_id"] for r in rewind.window_events(j, rewind.Cutoff(at, inclusive=False)).collect()}
        assert at == "junk" or not window & set(range(1, last + 1)), at
        changed = {r["last_event_id"] for r in snapshot.changed_after(snapshot.state_at(j, stamp(9)), j, at).collect()}
        assert changed == (set() if at == "junk" else set(range(last + 1, 6))), at


def test_a_review_says_what_it_left_out(spark):
    j = journal(spark, [event(n, n, "INSERT", {"all_attributes": {}}, created=stamp(n)) for n in range(10)])
    rows, told = snapshot.review(j, stamp(7), budget=5)
    assert [r["event_id"] for r in rows.collect()] == [7, 6, 5, 4, 3]
    assert tuple(told.first()) == (8, 5, True, "only the newest 5 of 8 events were read")
    assert tuple(snapshot.review(j, stamp(7))[1].first()) == (8, 8, False, None)


def test_ids_of_a_batch_are_unique_and_follow_time(spark):
    rows = [event(0, n % 7, "INSERT", {"all_attributes": {"n": n}}, created=stamp(n * 37 % 40)) for n in range(40)]
    batch = journal(spark, rows).withColumn("event_id", F.lit(None).cast("long"))
    first = None
    for parts in (20, 3, 20):
        got = capture.numbered(batch.repartition(parts), 5 << 36).collect()
        ids = [r["event_id"] for r in got]
        assert sorted(ids) == list(range(5 << 36, (5 << 36) + 40))
        in_time = [r["created_at"] for r in sorted(got, key=lambda r: r["event_id"])]
        assert in_time == sorted(in_time)
        named = {r["attributes_json"]: r["event_id"] for r in got}
        first = first or named
        assert named == first
    mixed = batch.limit(10).withColumn("event_id", F.when(F.col("entity_fingerprint") == "fid:1", F.lit(77).cast("long")))
    got = [r["event_id"] for r in capture.numbered(mixed, 100).collect()]
    assert sorted(x for x in got if x != 77) == list(range(100, 100 + len(got) - got.count(77)))

