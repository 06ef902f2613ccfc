"""What a workflow's statuses mean: classified by category, name and board, then confirmed or overridden by people.

A model is rows of (workflow_id, status_id, flow_state, confidence, confirmed_by, confirmed_at, valid_from,
valid_to); of a status at most one is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["workflow_id", "status_id"]
MODEL = [*KEY, "flow_state", "confidence", "confirmed_by", "confirmed_at", "valid_from", "valid_to"]
# Words of waiting and of active statuses, and confidences.
WAIT = r"(?i)\b(blocked|waiting|await\w*|on\s+hold|hold|uat|staging|queue|ready\s+for|pending|triage|selected\s+for)\b"
ACTIVE = r"(?i)\b(progress|develop\w*|implement\w*|review|coding|test\w*|qa|dev)\b"
FROM_CATEGORY, FROM_NAME, UNSURE, FROM_BOARD, QUEUED, CERTAIN, HIGH = 0.95, 0.8, 0.45, 0.75, 0.7, 1.0, 0.75


def classify(category: Column, name: Column, column: Column) -> tuple[Column, Column]:
    """(flow state, confidence) from a status's category, its name, and its board column: started, done, queue or null.

    New and done are what the category says.  Of names waiting words count before active ones; a name
    without either waits, unsurely.  The board then moves what stands in its done column to done, active
    work in a queue to waiting, and what waits unsurely in a started column to active.
    """
    told = category.isin("new", "done")
    by_name = F.when(name.rlike(WAIT), "wait").when(name.rlike(ACTIVE), "active").otherwise("wait")
    sure = F.when(name.rlike(WAIT) | name.rlike(ACTIVE), FROM_NAME).otherwise(UNSURE)
    told = F.coalesce(told, F.lit(False))
    in_done, in_queue, in_started = (F.coalesce(column == c, F.lit(False)) for c in ("done", "queue", "started"))
    to_done, to_wait = ~told & in_done, ~told & in_queue & (by_name == "active")
    to_active = ~told & in_started & (by_name == "wait") & (sure <= 0.5)
    state = F.when(told, category).when(to_done, "done").when(to_wait, "wait").when(to_active, "active").otherwise(by_name)
    return state, F.when(told, FROM_CATEGORY).when(to_done | to_active, FROM_BOARD).when(to_wait, QUEUED).otherwise(sure)


def fallback(model: DataFrame, statuses: DataFrame, at: Column) -> DataFrame:
    """``model`` with an unsure row for every status (workflow_id, status_id, category, name) that has no open one."""
    missing = statuses.join(model.where("valid_to is null").select(*KEY), KEY, "left_anti")
    state, sure = classify(F.col("category"), F.col("name"), F.lit(None).cast("string"))
    none = F.lit(None)
    rows = missing.select(*KEY, state.alias("flow_state"), F.least(sure, F.lit(UNSURE)).alias("confidence"), none.cast("string").alias("confirmed_by"), none.cast("timestamp").alias("confirmed_at"), at.alias("valid_from"), none.cast("timestamp").alias("valid_to"))
    return model.select(*MODEL).unionByName(rows)


def pending(model: DataFrame) -> DataFrame:
    """Open rows that nobody confirmed and that are less than sure."""
    return model.where((F.col("valid_to").isNull()) & F.col("confirmed_by").isNull() & (F.col("confidence") < HIGH))


def confirm(model: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open rows confirmed by decisions (workflow_id, status_id, confirmed_by, confirmed_at); the rest as it is."""
    said = decisions.select(*KEY, F.col("confirmed_by").alias("__by"), F.col("confirmed_at").alias("__at"))
    is_open = F.col("valid_to").isNull() & F.col("__by").isNotNull()
    joined = model.join(said, KEY, "left")
    return joined.withColumns({"confirmed_by": F.when(is_open, F.col("__by")).otherwise(F.col("confirmed_by")), "confirmed_at": F.when(is_open, F.col("__at")).otherwise(F.col("confirmed_at"))}).select(*MODEL)


def override(model: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open rows closed where decisions (workflow_id, status_id, flow_state, confirmed_by, valid_from) start, and those certain rows."""
    said = decisions.select(*KEY, F.col("valid_from").alias("__at"), F.col("flow_state").alias("__state"), F.col("confirmed_by").alias("__by"))
    joined = model.join(said, KEY, "left").withColumn("__open", F.col("valid_to").isNull() & F.col("__at").isNotNull())
    closed = joined.withColumn("valid_to", F.when(F.col("__open"), F.col("__at")).otherwise(F.col("valid_to"))).select(*MODEL)
    made = joined.where("__open").select(*KEY, F.col("__state").alias("flow_state"), F.lit(CERTAIN).alias("confidence"), F.col("__by").alias("confirmed_by"), F.col("__at").alias("confirmed_at"), F.col("__at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return closed.unionByName(made)
