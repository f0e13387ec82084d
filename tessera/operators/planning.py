"""Layered plans: what can be done at once, what has to wait, what never can; and how far a budget goes.

A round takes all tasks without open dependencies as one layer and closes what waited for them; every round is written to
the shared folder, so a plan of any depth has a short lineage. What is left when no task is ready stands in a cycle or
behind one. Tasks that need something that isn't in their plan are ready as if it were done, and say so.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import cut, drop_cut


def layers(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """plan_id, task_id, layer (from 1), status (READY; WAITING: from the second layer on; BLOCKED: in a cycle or behind one, without a layer), missing (needs that aren't in the plan). tasks: plan_id, task_id; needs: plan_id, task_id, needs."""
    tasks = tasks.select("plan_id", "task_id").where("plan_id is not null and task_id is not null").distinct()
    wanted = needs.select("plan_id", "task_id", "needs").where("needs is not null").distinct().join(tasks, ["plan_id", "task_id"], "left_semi")
    known = tasks.select("plan_id", F.col("task_id").alias("needs"), F.lit(True).alias("known"))
    each = wanted.join(known, ["plan_id", "needs"], "left")
    missing = each.where("known is null").groupBy("plan_id", "task_id").agg(F.array_sort(F.collect_set("needs")).alias("missing"))
    open_ = cut(each.where("known").select("plan_id", "task_id", "needs"))
    left, done = cut(tasks), None
    for layer in count(1):
        ready = cut(left.join(open_.select("plan_id", "task_id").distinct(), ["plan_id", "task_id"], "left_anti"))
        if ready.isEmpty():
            break
        mine = ready.withColumn("layer", F.lit(layer))
        done = mine if done is None else done.unionByName(mine)
        if layer % 16 == 0:  # a short plan however deep the layers go
            done = cut(done)
        new_left = cut(left.join(ready, ["plan_id", "task_id"], "left_anti"))
        new_open = cut(open_.join(ready.select("plan_id", F.col("task_id").alias("needs")), ["plan_id", "needs"], "left_anti").select("plan_id", "task_id", "needs"))
        drop_cut(left)
        drop_cut(open_)
        left, open_ = new_left, new_open
    stuck = left.withColumn("layer", F.lit(None).cast("int"))
    rows = stuck if done is None else done.unionByName(stuck)
    status = F.when(F.col("layer").isNull(), "BLOCKED").when(F.col("layer") == 1, "READY").otherwise("WAITING")
    none = F.array().cast(missing.schema["missing"].dataType)
    return rows.join(missing, ["plan_id", "task_id"], "left").select("plan_id", "task_id", "layer", status.alias("status"), F.coalesce("missing", none).alias("missing"))


def budgeted(planned: DataFrame, costs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds place, spent and decision (DO, DEFER, BLOCKED) to layered tasks. costs: plan_id, task_id, priority, cost; budgets: plan_id, budget. A plan's tasks are done layer by layer, in a layer by priority and id; what a layer leaves goes to the next, and from the first task on that no longer fits all are deferred. A task without a cost is free, a plan without a budget has none."""
    rows = planned.join(costs, ["plan_id", "task_id"], "left").join(budgets, "plan_id", "left")
    w = Window.partitionBy("plan_id").orderBy(F.col("layer").asc_nulls_last(), F.coalesce("priority", F.lit(0)), "task_id")
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("spent", F.sum(F.coalesce("cost", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    decision = F.when(F.col("layer").isNull(), "BLOCKED").when(F.col("spent") <= F.coalesce("budget", F.lit(0)), "DO").otherwise("DEFER")
    return rows.select(*planned.columns, "place", "spent", decision.alias("decision"))


def research_tasks(questions: DataFrame) -> DataFrame:
    """question_id, layer, task_id, task_type, text, needs: the layered plan of each question. One that splits into parts has a task for each part and a synthesis that needs them all; any other is one lookup."""
    parts = F.coalesce(T.split_question(F.col("question")), F.array().cast("array<string>"))
    rows = questions.withColumn("_parts", parts)
    one = F.array(F.struct(F.lit(0).alias("layer"), F.lit("task-1").alias("task_id"), F.lit("FACT_LOOKUP").alias("task_type"), F.col("question").alias("text"), F.array().cast("array<string>").alias("needs")))
    names = F.transform("_parts", lambda p, i: F.concat(F.lit("task-"), (i + 1).cast("string")))
    each = F.transform("_parts", lambda p, i: F.struct(F.lit(0).alias("layer"), F.concat(F.lit("task-"), (i + 1).cast("string")).alias("task_id"), T.task_type(p).alias("task_type"), p.alias("text"), F.array().cast("array<string>").alias("needs")))
    last = F.struct(F.lit(1).alias("layer"), F.lit("task-synthesis").alias("task_id"), F.lit("SYNTHESIS").alias("task_type"), F.col("question").alias("text"), names.alias("needs"))
    tasks = F.when(F.size("_parts") <= 1, one).otherwise(F.array_append(each, last))
    return rows.select("question_id", F.inline(tasks))
