"""Two-level scans against one sequential pass, with one entity that holds half of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from stratalog.operators import rewind, scans
from tests.test_rewind import DS, event, journal, stamp

PARTS = (1, 7, 40)


def _events(seed, n, ops=("INSERT", "UPDATE", "DELETE", "UPDATE")):
    rng = random.Random(seed)
    for k in range(n):
        yield k, 0 if rng.random() < 0.5 else 1 + rng.randrange(30), rng.choice(ops), rng


@pytest.fixture(scope="module")
def edits(spark):
    rows = [event(k, e, op, {}, created=stamp(k // 3)) for k, e, op, _ in _events(3, 600)]
    return journal(spark, rows).withColumn("entity", F.col("entity_fingerprint"))


def _chains(rows):
    chains = {}
    for r in sorted(rows, key=lambda r: (r["created_at"], r["event_id"])):
        chains.setdefault(r["entity_fingerprint"], []).append(r)
    return chains


@pytest.mark.parametrize("parts", PARTS)
def test_survivors(edits, parts):
    gone = set()
    for chain in _chains(edits.collect()).values():
        lives = []
        for r in chain:
            if r["operation_type"] == "INSERT":
                lives.append([r["event_id"]])
            elif lives and r["operation_type"] == "UPDATE":
                lives[-1].append(r["event_id"])
            elif lives:
                gone |= {r["event_id"], *lives.pop()}
    left = {r["event_id"] for r in rewind.survivors(edits, parts).collect()}
    assert left == set(range(600)) - gone


@pytest.mark.parametrize("parts", PARTS)
def test_reused_ids(edits, parts):
    want = {}
    for name, chain in _chains(edits.collect()).items():
        before, turn = None, None
        for r in chain:
            op = r["operation_type"]
            opened = before is not None and before != "DELETE" and turn == "INSERT"
            if (op == "INSERT" and before is not None and not opened) or (op == "UPDATE" and before == "DELETE"):
                want[name] = r["event_id"]
            before, turn = op, op if op != "UPDATE" else turn
    assert {r["entity_fingerprint"]: r["split_id"] for r in rewind.reused_ids(edits.drop("entity"), parts).collect()} == want


@pytest.mark.parametrize("parts", PARTS)
def test_neutralised(spark, parts):
    rows, spans = [], []
    for k, e, op, rng in _events(8, 400):
        ref = rng.randrange(k) if k and rng.random() < 0.05 else None
        rows.append(event(k, e, op, {}, ref=ref, created=stamp(k)))
        if ref is not None:
            spans.append((k, e, ref))
    lives = journal(spark, rows).withColumn("entity", F.col("entity_fingerprint"))
    traces = {k for k, _, _ in spans}
    dropped = {ref for _, _, ref in spans if ref not in traces}
    for k, e, ref in spans:
        if ref not in traces:
            dropped |= {i for i, r in enumerate(rows) if i not in traces and r[6] == f'{{"fid": {e}}}' and ref <= i < k}
    found = rewind.neutralised(lives, parts)
    assert {r["event_id"] for r in found.where("dropped").collect()} == dropped
    assert found.count() == 400 - len(traces)


def test_a_large_group_lies_in_many_buckets(edits):
    rows = scans.bucketed(edits, ["datasource_fingerprint", "entity"], ["created_at", "event_id"], 20)
    sizes = {r[0]: r[1] for r in rows.groupBy(scans.BUCKET).count().collect()}
    assert len(sizes) > 15 and max(sizes.values()) < 3 * 600 / len(sizes)
    hot = rows.where("entity = 'fid:0'").groupBy(scans.BUCKET).agg(F.min("event_id"), F.max("event_id")).orderBy(scans.BUCKET).collect()
    assert len(hot) > 5 and all(a[2] < b[1] for a, b in zip(hot, hot[1:]))


def test_empty(spark):
    none = journal(spark, []).withColumn("entity", F.lit(DS))
    assert rewind.survivors(none, 5).count() == rewind.neutralised(none, 5).count() == rewind.reused_ids(none, 5).count() == 0
