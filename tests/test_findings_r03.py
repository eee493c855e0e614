"""Cases in which registered queries and their SQL went apart on larger tables."""

from pyspark.sql import functions as F

from stratalog import session
from stratalog.operators import applying, claims, ladder, retention, rewind, sequence, targets
from stratalog.plans import restoring
from tests.test_rewind import event, journal
from tests.test_sequence import keyed, layer


def test_one_pass_takes_the_pairs_of_the_journal_as_it_is(spark):
    ops = {1: "INSERT", 2: "INSERT", 3: "DELETE", 4: "DELETE", 5: "UPDATE"}
    j = journal(spark, [event(n, 1, op, {"all_attributes": {}}) for n, op in ops.items()])
    left = lambda *x: sorted(r["event_id"] for r in retention.purge_pairs(j, *x).collect())
    assert left(1) == [1, 4, 5] and left(2) == left(3) == left() == [5] and left(0) == [1, 2, 3, 4, 5]


def test_a_row_without_fields_and_shape_stays(spark):
    rows = layer(spark, {1: ({}, None), 2: ({"a": 1}, None)})
    events = [event(1, 1, "UPDATE", {"changed_only": {"a": {"old": 0, "new": 1}}})]
    done = sequence.restored(journal(spark, events), rows, ("id",))
    left = {r["fid"]: (r["attributes"], r["geometry_wkb"]) for r in sequence.rows_after(rows, done).collect()}
    assert left == {1: ({}, None), 2: ({"a": "1"}, None)}


def test_rows_of_one_number(spark):
    held = layer(spark, {8: ({"id": 8, "a": 1}, None), 9: ({"id": 9, "a": 1}, None), 10: ({"id": 10, "a": 2}, None)})
    rows = held.withColumn("fid", F.when(F.col("fid") == 8, 8).otherwise(900).cast("long"))
    change = {"changed_only": {"a": {"old": 0, "new": 1}}}
    updates = journal(spark, [keyed(event(1, 8, "UPDATE", change), 8), event(2, 900, "UPDATE", change), event(3, 8, "UPDATE", change)])
    met = targets.resolved(updates, rows)
    assert sorted(r["event_id"] for r in met.collect()) == [1, 1, 2, 2, 2, 2, 3]
    assert {(r["event_id"], r["proof"]) for r in targets.proofs(met).collect()} == {(1, "pk"), (2, "attribute_mismatch"), (3, "post_attributes")}
    rows = rows.where("fid = 900")
    gone = [event(n, n, "DELETE", {"all_attributes": {"id": n, "a": a}}) for n, a in ((1, 1), (2, 2))]
    assert sorted(tuple(r) for r in claims.claimed_twins(journal(spark, gone), rows, ("id",)).select("event_id", "fid").collect()) == [(1, 900), (2, 900)]


def test_short_sequences_take_no_rounds(spark, monkeypatch):
    rows = layer(spark, {n: ({"a": 9 if n % 2 else 5}, None) for n in range(1, 5)})
    change = lambda old, new: {"changed_only": {"a": {"old": old, "new": new}}}
    told = [event(10 * k + n, n, "UPDATE", change(k, k + 1 if k % 2 else 77)) for k in range(4) for n in range(1, 5)]
    told.append(keyed(event(200, 6, "DELETE", {"all_attributes": {"a": 3}}), 6))
    told.append(keyed(event(150, 6, "UPDATE", change(2, 3)), 6))
    steps, settled = [], sequence.settled

    def counted(df):
        steps.append(df)
        return settled(df)

    monkeypatch.setattr(sequence, "settled", counted)

    def found(few):
        steps.clear()
        done = sequence.restored(journal(spark, told), rows, ("id",), few=few)
        events = sorted((r["event_id"], r["slot"], r["reason"], r["outcome"]) for r in done.events.collect())
        left = sorted((r["slot"], str(r["fid"]), str(r["attributes"]), str(r["geometry_wkb"])) for r in sequence.rows_after(rows, done).collect())
        return events, left, len(steps)

    folded, rounds, mixed = found(64), found(0), found(2)
    assert folded[:2] == rounds[:2] == mixed[:2] and len({r for _, _, r, _ in folded[0]}) > 2
    assert folded[2] < 8 < rounds[2]


def test_plans_carry_only_what_is_read(spark, monkeypatch):
    seen, settled = [], session.settled

    def noted(df):
        seen.append(df.columns)
        return settled(df)

    for place in (session, rewind, restoring):
        monkeypatch.setattr(place, "settled", noted)
    change = lambda old, new: {"changed_only": {"a": {"old": old, "new": new}}}
    rows = [event(1, 1, "INSERT", {"all_attributes": {"a": 1}})]
    rows += [event(n, 1, "UPDATE", change(n - 1, n)) for n in range(2, 16)]
    now, decided = restoring._decided(journal(spark, rows))
    assert applying.apply_plan(now, decided).count() <= 1
    assert seen and not any({"field_schema_json", "layer_name_snapshot", "_now"} & set(c) for c in seen)


def test_later_steps_of_the_ladder_read_what_is_left(spark, monkeypatch):
    seen, settled = [], session.settled

    def noted(df):
        seen.append(df.columns)
        return settled(df)

    monkeypatch.setattr(ladder, "settled", noted)
    rows = layer(spark, {1: ({"a": 1, "b": 2}, None), 2: ({"a": 5, "b": 6}, None)})
    update = lambda n, fid, a, b: event(n, fid, "UPDATE", {"changed_only": {"a": {"old": 0, "new": a}, "b": {"old": 0, "new": b}}})
    found = ladder.updates(journal(spark, [update(1, 1, 1, 2), update(2, 1, 5, 6), update(3, 2, 7, 7)]), rows)
    assert sorted((r["event_id"], r["target_fid"], r["stage"]) for r in found.collect()) == [(1, 1, "number"), (2, 2, "elsewhere"), (3, None, "unproven")]
    assert sum("attributes_json" in c for c in seen) == 2
