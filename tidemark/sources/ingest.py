"""Raw records of a code host and an issue tracker, landed as JSON, mapped to the entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

PULLS = "id string, number int, state string, isDraft boolean, createdAt timestamp, mergedAt timestamp, updatedAt timestamp, author struct<login:string>, mergedBy struct<login:string>, headRefName string, baseRefName string, title string, body string"
ISSUES = "id string, key string, fields struct<created:timestamp, issuetype:struct<name:string>, status:struct<id:string>, priority:struct<name:string>, resolutiondate:timestamp>, changelog struct<histories:array<struct<id:string, created:timestamp, author:struct<accountId:string>, items:array<struct<field:string, `from`:string, `to`:string, fromString:string, toString:string>>>>>"


def read_landed(spark, path: str, schema: str) -> DataFrame:
    """Landed JSON lines with a fixed schema; records that don't parse are in ``_corrupt``, never an error."""
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(schema).add("_corrupt", T.StringType())
    return spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def pull_state(state: Column, merged_at: Column) -> Column:
    name = F.lower(state)
    return F.when(merged_at.isNotNull() | (name == "merged"), "merged").when(name == "closed", "closed").otherwise("open")


def review_state(state: Column) -> Column:
    name = F.lower(F.trim(state))
    return F.when(name.isin("approved", "changes_requested", "commented", "dismissed", "pending"), name).otherwise("commented")


def pulls(raw: DataFrame, repo_id: str) -> DataFrame:
    return raw.where("id is not null").select(
        "id",
        F.lit(repo_id).alias("repo_id"),
        "number",
        F.col("author.login").alias("author"),
        pull_state(F.col("state"), F.col("mergedAt")).alias("state"),
        F.coalesce("isDraft", F.lit(False)).alias("is_draft"),
        F.col("createdAt").alias("created_at"),
        F.col("mergedAt").alias("merged_at"),
        F.col("mergedBy.login").alias("merged_by"),
        F.col("updatedAt").alias("updated_at"),
        F.col("headRefName").alias("head_ref"),
        F.col("baseRefName").alias("base_ref"),
    )


def file_churn(haloc: Column, patch: Column, additions: Column, deletions: Column) -> Column:
    """A file's own count where there is a patch, else the larger of lines added and deleted."""
    return F.when(patch.isNotNull(), F.coalesce(haloc, F.lit(0))).otherwise(F.greatest(additions, deletions))


def deployments(api: DataFrame, releases: DataFrame, merges: DataFrame) -> DataFrame:
    """Deployments as the host tells; releases, and else merges to the default branch, only for repositories without any.

    Each has repo_id, id, environment, status, created_at, finished_at.  Only an ended one is finished.
    """
    columns = ["repo_id", "id", "environment", "status", "created_at", "finished_at", "source"]
    ended = F.lower("status").isin("success", "failure", "error", "inactive")
    own = api.withColumns({"finished_at": F.when(ended, F.col("finished_at")), "source": F.lit("api")}).select(columns)
    told = releases.withColumn("source", F.lit("release")).select(columns).join(own.select("repo_id").distinct(), "repo_id", "left_anti")
    known = own.select("repo_id").union(told.select("repo_id")).distinct()
    proxy = merges.withColumn("source", F.lit("merge_proxy")).select(columns).join(known, "repo_id", "left_anti")
    return own.unionByName(told).unionByName(proxy)


def issues(raw: DataFrame) -> DataFrame:
    f = lambda name: F.col(f"fields.{name}")
    return raw.where("id is not null").select("id", "key", f("issuetype.name").alias("type"), f("status.id").alias("status_id"), f("priority.name").alias("priority"), f("created").alias("created_at"), f("resolutiondate").alias("resolved_at"))


def changes(raw: DataFrame) -> DataFrame:
    """(issue_id, id, at, actor, field, from, to, from_name, to_name): the change log, a row for each change."""
    history = raw.select(F.col("id").alias("issue_id"), F.explode("changelog.histories").alias("h"))
    item = history.select("issue_id", "h.id", F.col("h.created").alias("at"), F.col("h.author.accountId").alias("actor"), F.posexplode("h.items").alias("n", "i"))
    return item.select("issue_id", F.concat_ws("-", "id", "n").alias("id"), "at", "actor", F.lower("i.field").alias("field"), F.col("i.from").alias("from"), F.col("i.to").alias("to"), F.col("i.fromString").alias("from_name"), F.col("i.toString").alias("to_name"))


def status_transitions(raw: DataFrame) -> DataFrame:
    """Status changes, and for each issue one to its first status when it was created."""
    moved = changes(raw).where("field = 'status'").select("issue_id", "id", F.col("from").alias("from_status"), F.col("to").alias("to_status"), "at", "actor")
    first = moved.groupBy("issue_id").agg(F.min_by("from_status", F.struct("at", "id")).alias("first"))
    made = issues(raw).join(first, F.col("id") == F.col("issue_id"), "left").withColumn("s", F.coalesce("first", "status_id"))
    return moved.unionByName(made.select(F.col("id").alias("issue_id"), F.concat("id", F.lit("-init")).alias("id"), F.col("s").alias("from_status"), F.col("s").alias("to_status"), F.col("created_at").alias("at"), F.lit(None).cast("string").alias("actor")))


def key_validity(raw: DataFrame) -> DataFrame:
    """(issue_id, key, valid_from, valid_to): which key an issue had when."""
    renamed = changes(raw).where("field = 'key'").select("issue_id", "at", "from_name", "to_name")
    first = renamed.groupBy("issue_id").agg(F.min_by("from_name", "at").alias("first"))
    starts = issues(raw).join(first, F.col("id") == F.col("issue_id"), "left").select(F.col("id").alias("issue_id"), F.coalesce("first", "key").alias("key"), F.col("created_at").alias("valid_from"))
    every = starts.unionByName(renamed.select("issue_id", F.col("to_name").alias("key"), F.col("at").alias("valid_from")))
    return every.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("issue_id").orderBy("valid_from")))


def sprint_ids(field: Column) -> Column:
    """The sprint ids in a field's value: ``id=..`` of each bean, else comma-separated numbers."""
    beans = F.regexp_extract_all(field, F.lit(r"\bid=(\d+)"), F.lit(1))
    plain = F.filter(F.transform(F.split(field, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$"))
    return F.array_distinct(F.when(field.contains("id="), beans).otherwise(F.coalesce(plain, F.array().cast("array<string>"))))


def sprint_changes(raw: DataFrame, sprints: DataFrame) -> DataFrame:
    """(sprint_id, issue_id, change, at, was_present_at_start) from the change log; ``sprints``: sprint_id, start_at."""
    none = F.array().cast("array<string>")
    both = changes(raw).where("field = 'sprint'").select("issue_id", "at", F.coalesce(sprint_ids(F.col("from")), none).alias("a"), F.coalesce(sprint_ids(F.col("to")), none).alias("b"))
    added = both.select("issue_id", "at", F.lit("added").alias("change"), F.explode(F.array_except("b", "a")).alias("sprint_id"))
    removed = both.select("issue_id", "at", F.lit("removed").alias("change"), F.explode(F.array_except("a", "b")).alias("sprint_id"))
    known = added.unionByName(removed).join(sprints.select("sprint_id", "start_at"), "sprint_id", "left")
    return known.select("sprint_id", "issue_id", "change", "at", F.coalesce(F.col("at") <= F.col("start_at"), F.lit(False)).alias("was_present_at_start"))


#: Names of board columns that say where work stands.
DONE_NAMES = ("done", "closed", "released", "complete", "completed", "resolved")
QUEUE_NAMES = ("backlog", "to do", "todo", "open", "selected for development", "ready", "queue")


def board_columns(columns: DataFrame) -> DataFrame:
    """Add is_started_col and is_done_col by name to (board_id, column_name, status_ids)."""
    name = F.lower(F.trim("column_name"))
    done = name.isin(*DONE_NAMES)
    return columns.withColumns({"is_started_col": ~done & ~name.isin(*QUEUE_NAMES), "is_done_col": done})
