"""Layers of plans against a plain topological sort."""

import random

import pytest

from tessera.operators import planning

TASKS, NEEDS = "plan_id long, task_id string", "plan_id long, task_id string, needs string"


def plain(tasks, needs):
    out, left = {}, set(tasks)
    inside = {(p, t, n) for p, t, n in needs if n is not None and (p, t) in left and (p, n) in left}
    layer = 1
    while ready := {(p, t) for p, t in left if not any((p, t) == (a, b) and (a, n) in left for a, b, n in inside)}:
        out |= dict.fromkeys(ready, layer)
        left, layer = left - ready, layer + 1
    return out | dict.fromkeys(left)


@pytest.mark.parametrize("seed", [1])
def test_layers_equal_a_plain_sort(spark, seed):
    rng = random.Random(seed)
    tasks = [(p, f"t{i}") for p in range(4) for i in range(12)]
    needs = [(p, f"t{i}", f"t{rng.randrange(i) if rng.random() < 0.97 and i else rng.randrange(14)}") for p in range(4) for i in range(12) for _ in range(rng.randrange(3))]
    needs += [(9, "t1", "t2"), (0, "t1", None), (0, "unknown", "t1")]
    found = planning.layers(spark.createDataFrame([*tasks, tasks[0]], TASKS), spark.createDataFrame(needs, NEEDS)).collect()
    assert {(r.plan_id, r.task_id): r.layer for r in found} == plain(tasks, needs) and len(found) == len(tasks)
    missing = {(r.plan_id, r.task_id): r.missing for r in found}
    assert all(missing[k] == sorted({n for p, t, n in needs if (p, t) == k and n is not None and (p, n) not in set(tasks)}) for k in missing)


def test_chains_cycles_and_budgets(spark):
    tasks = [(1, f"t{i:02}") for i in range(20)] + [(2, "a"), (2, "b"), (2, "c"), (2, "d")]
    needs = [(1, f"t{i:02}", f"t{i - 1:02}") for i in range(1, 20)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "a")]
    planned = planning.layers(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(needs, NEEDS))
    costs = spark.createDataFrame([(1, f"t{i:02}", 0, 10) for i in range(20)], "plan_id long, task_id string, priority int, cost long")
    rows = {(r.plan_id, r.task_id): (r.layer, r.status, r.decision) for r in planning.budgeted(planned, costs, spark.createDataFrame([(1, 35)], "plan_id long, budget long")).collect()}
    assert [rows[1, f"t{i:02}"][0] for i in range(20)] == list(range(1, 21))
    assert [rows[1, f"t{i:02}"][2] for i in range(5)] == ["DO", "DO", "DO", "DEFER", "DEFER"]
    assert rows[2, "d"] == (1, "READY", "DO") and {rows[2, x][1:] for x in "abc"} == {("BLOCKED", "BLOCKED")}
    empty = planning.layers(spark.createDataFrame([], TASKS), spark.createDataFrame([], NEEDS))
    assert empty.count() == 0


def test_research_tasks(spark):
    asked = spark.createDataFrame([(1, "甲和乙有什么区别？"), (2, "what is it"), (3, None)], "question_id long, question string")
    rows = [tuple(r) for r in planning.research_tasks(asked).collect()]
    first = [r for r in rows if r[0] == 1]
    assert [r[2] for r in first] == [*(f"task-{i + 1}" for i in range(len(first) - 1)), "task-synthesis"] and len(first) > 2
    assert first[-1][1:4] == (1, "task-synthesis", "SYNTHESIS") and first[-1][5] == [r[2] for r in first[:-1]]
    assert [r for r in rows if r[0] == 2] == [(2, 0, "task-1", "FACT_LOOKUP", "what is it", [])]
    assert len([r for r in rows if r[0] == 3]) == 1
    laid = planning.layers(planning.research_tasks(asked).selectExpr("question_id plan_id", "task_id"), planning.research_tasks(asked).selectExpr("question_id plan_id", "task_id", "explode(needs) needs"))
    assert {r.layer for r in laid.where("plan_id = 1 and task_id = 'task-synthesis'").collect()} == {2}
