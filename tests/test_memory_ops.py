"""The folded log against a loop over its operations."""

import random

import pytest
from pyspark.sql import functions as F

from turnlake.operators import memory_ops

SCHEMA = "scope long, at long, seq long, op string, mem_id long, kind string, content string, pin string, old long, turn_ids array<long>, quote string"


def operation(at, seq, op, mem_id, old=None, content=None, pin=None, scope=1, turn_ids=(0,), quote="q"):
    return (scope, at, seq, op, mem_id, "Decision" if op == "create" else None, content, pin, old, list(turn_ids) if turn_ids is not None else None, quote)


def replayed(log):
    """({place: verdict}, {(scope, mem_id): state}, [(place, states then)]) by a loop."""
    items, verdicts, history = {}, {}, []
    for scope, at, seq, op, mem_id, kind, content, pin, old, turn_ids, quote in sorted(log, key=lambda r: (r[1], r[2])):
        key = (scope, old if op == "supersede" else mem_id)
        it = items.get(key)
        if not turn_ids or not quote:
            verdict = "no provenance"
        elif op == "supersede" and mem_id == old:
            verdict = "supersedes itself"
        elif op == "create":
            verdict = "exists" if it else "ok"
        elif not it:
            verdict = "no such item"
        elif op == "supersede" and (scope, mem_id) not in items:
            verdict = "no such successor"
        elif it["status"] == "deleted" or (op != "delete" and it["status"] != "active"):
            verdict = "has ended"
        else:
            verdict = "ok"
        verdicts[scope, at, seq] = verdict
        if verdict == "ok":
            if op == "create":
                it = items[key] = {"kind": kind, "content": content, "pin": None, "status": "active", "created_at": at, "successor": None, "version": 0}
            it["version"] += 1
            it["changed_at"] = at
            if op == "update":
                it["content"] = content
            elif op == "pin":
                it["pin"] = pin
            elif op == "supersede":
                it["status"], it["successor"] = "superseded", mem_id
            elif op == "delete":
                it["status"] = "deleted"
        history.append((at, {k: dict(v) for k, v in items.items()}))
    return verdicts, items, history


def head(items, key):
    seen = []
    while items[key]["successor"] is not None and key not in seen:
        seen.append(key)
        key = (key[0], items[key]["successor"])
    return min(k[1] for k in seen[seen.index(key) :]) if key in seen else key[1]


def some_log(seed, n=400, items=12, scopes=3):
    rng, log = random.Random(seed), []
    for i in range(n):
        op = rng.choices(memory_ops.OPS, [4, 4, 5, 1, 3])[0]
        at = i // 3  # three operations at one time
        log.append(operation(at, i % 3, op, rng.randrange(items), rng.randrange(items) if op == "supersede" else None, f"c{i}" if op in ("create", "update") else None, rng.choice(["user_pinned", "none"]) if op == "pin" else None, rng.randrange(scopes), rng.choice([(1,), (1, 2), (), None]) if rng.random() < 0.1 else (1,), "" if rng.random() < 0.05 else "q"))
    return log


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_a_loop(spark, seed):
    log = some_log(seed)
    verdicts, items, history = replayed(log)
    found = memory_ops.judged(spark.createDataFrame(log, SCHEMA).withColumn("item", F.lit("theirs")))
    assert {(r["scope"], r["at"], r["seq"]): r["verdict"] for r in found.collect()} == verdicts and len(set(verdicts.values())) >= 6
    rows = memory_ops.heads(memory_ops.state(found)).collect()
    names = ("kind", "content", "pin", "status", "created_at", "changed_at", "successor", "version")
    assert {(r["scope"], r["mem_id"]): {n: r[n] for n in names} for r in rows} == items
    assert {(r["scope"], r["mem_id"]): r["head"] for r in rows} == {k: head(items, k) for k in items}
    times = sorted({r[1] for r in log})[:: len(log) // 30]
    asked = spark.createDataFrame([(s, t) for s in range(3) for t in times], "scope long, at long")
    then = {(r["scope"], r["at"], r["mem_id"]): (r["content"], r["pin"], r["status"]) for r in memory_ops.as_of(memory_ops.versions(found), asked).collect()}
    want = {}
    for t in times:
        last = [states for at, states in history if at <= t][-1]
        want |= {(s, t, m): (x["content"], x["pin"], x["status"]) for (s, m), x in last.items()}
    assert then == want


def test_long_chains_and_cycles(spark):
    n = 300
    rows = [(1, i, i + 1) for i in range(n - 1)] + [(1, n - 1, None)]  # a chain
    rows += [(2, i, (i + 1) % 7 + 10 * (i >= 99)) for i in range(7)] + [(2, 50, 3), (2, 51, 50)]  # a cycle and a tail into it
    rows += [(3, 5, 5000)]  # a successor that is no item here
    frame = spark.createDataFrame(rows, "scope long, mem_id long, successor long")
    found = {(r["scope"], r["mem_id"]): r["head"] for r in memory_ops.heads(frame).collect()}
    assert all(found[1, i] == n - 1 for i in range(n))
    assert all(found[2, i] == 0 for i in (*range(7), 50, 51)) and found[3, 5] == 5000
    assert memory_ops.heads(frame.where("successor IS NULL")).first()["head"] == n - 1


def test_odd_logs(spark):
    log = [operation(1, 0, "create", 1), operation(1, 0, "create", 1), operation(None, 0, "create", 2), operation(2, 0, "forget", 1), operation(2, 1, None, 1), operation(3, 0, "supersede", 1, None), operation(4, 0, "pin", 1, pin="user_pinned", scope=None)]
    found = memory_ops.judged(spark.createDataFrame(log, SCHEMA))
    assert sorted(r["verdict"] for r in found.collect()) == ["malformed"] * 5 + ["ok", "ok"]
    assert [(r["mem_id"], r["version"]) for r in memory_ops.state(found).collect()] == [(1, 1)]
    none = memory_ops.judged(spark.createDataFrame([], SCHEMA))
    assert none.count() == memory_ops.heads(memory_ops.state(none)).count() == memory_ops.versions(none).count() == 0


def test_quotes(spark):
    turns = spark.createDataFrame([(1, 0, "He said:\n\tI LIKE   green tea (a lot)."), (1, 1, "i like green tea"), (1, 2, None), (2, 0, "x")], "scope long, turn long, text string")
    log = [operation(0, 0, "create", 1, quote="i like  GREEN tea"), operation(0, 1, "create", 2, quote="tea (A LOT).", turn_ids=(1, 0)), operation(0, 2, "create", 3, quote="black tea"), operation(0, 3, "create", 4, quote="like", turn_ids=(1, 2, 9)), operation(0, 4, "create", 5, quote=" ", turn_ids=(0,)), operation(0, 5, "create", 6, quote=None, turn_ids=None), operation(0, 6, "create", 7, quote="like", scope=2)]
    found = {r["mem_id"]: (r["quote_turn"], r["first"], r["last"]) for r in memory_ops.quoted(spark.createDataFrame(log, SCHEMA), turns).collect()}
    none = (None, None, None)
    assert found == {1: (0, 10, 28), 2: (0, 25, 37), 3: none, 4: (1, 2, 6), 5: none, 6: none, 7: none}
