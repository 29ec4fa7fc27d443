"""Saved-run files and job tables: metadata, statistics, checks, retention, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.answers import _kind
from tessera.operators.lexical import top_k
from tessera.session import materialize

# --- fixed values -----------------------------------------------------------
RUN_TYPES = ("inspect", "ask", "debug-bundle")
UNKNOWN_TYPE = "unknown"
STAMP = r"\A\d{8}T\d{6}Z\z"
STAMP_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
NO_OBJECT = "could not read a JSON object"
BAD_QUERY = "query must be a string when present"
NO_RESULTS = "inspect trace must contain a results list"
BAD_MODE = "inspect trace mode must be a string when present"
NO_ANSWER = "ask trace must contain generated_answer"
NO_SNAPSHOT = "ask trace must contain retrieval_snapshot"
NO_RETRIEVAL = "ask trace must contain retrieval_results"
NO_DOCTOR = "debug bundle must contain doctor"
NO_TRACES = "debug bundle must contain traces"
BAD_TRACES = "debug bundle traces.{} must be a list when present"
UNMANAGED = "trace file is not a managed trace artifact"
STALE_AFTER = "90 seconds"
# ----------------------------------------------------------------------------


def run_type(name: Column) -> Column:
    return (
        F.when(F.contains(name, F.lit("-inspect-")), "inspect")
        .when(F.contains(name, F.lit("-ask-")), "ask")
        .when(F.endswith(name, F.lit("-debug-bundle.json")), "debug-bundle")
        .otherwise(UNKNOWN_TYPE)
    )


def is_managed(name: Column) -> Column:
    """Names that the listing commands look at."""
    return F.endswith(name, F.lit(".json")) & (run_type(name) != UNKNOWN_TYPE)


def run_timestamp(name: Column) -> Column:
    prefix = F.regexp_extract(name, r"\A[^-]*", 0)
    return F.when(prefix.rlike(STAMP), F.try_to_timestamp(prefix, F.lit(STAMP_FORMAT)))


def run_log_metadata(log: DataFrame) -> DataFrame:
    """Managed entries of a log (file_name, content, size_bytes, modified_at).

    `payload` is the parsed object, null when the content is no JSON object.
    """
    parsed = log.filter(is_managed(F.col("file_name"))).withColumn(
        "json", F.try_parse_json("content")
    )
    payload = F.when(_kind(F.col("json")) == "OBJECT", F.col("json"))
    typed = (
        parsed.withColumn("payload", payload)
        .withColumn("type", run_type(F.col("file_name")))
        .withColumn("timestamp", run_timestamp(F.col("file_name")))
    )
    query = F.try_variant_get("payload", "$.query", "variant")
    text = F.when(
        F.col("type").isin("inspect", "ask") & (_kind(query) == "STRING"),
        F.try_variant_get("payload", "$.query", "string"),
    )
    return typed.withColumn("query", text).drop("json")


def run_log_stats(log: DataFrame) -> DataFrame:
    """Per type (all types present) and in total: count, bytes, oldest and newest."""
    seen = run_log_metadata(log)
    spark = log.sparkSession
    types = spark.createDataFrame([(t,) for t in RUN_TYPES], "type string")
    measures = (
        F.count("*").alias("run_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.min("timestamp").alias("oldest_timestamp"),
        F.max("timestamp").alias("newest_timestamp"),
    )
    by_type = types.join(seen.groupBy("type").agg(*measures), "type", "left").na.fill(
        0, ["run_count", "size_bytes"]
    )
    return by_type.unionByName(seen.agg(*measures).withColumn("type", F.lit("total")))


def run_issues(kind: Column, payload: Column) -> Column:
    """Messages of the shape rules an entry breaks; empty when it is valid."""

    def at(path: str) -> Column:
        return _kind(F.try_variant_get(payload, path, "variant"))

    def present(path: str) -> Column:
        return F.try_variant_get(payload, path, "variant").isNotNull()

    wrong_query = F.when(~at("$.query").isin("STRING", "VOID"), BAD_QUERY)
    inspect = [
        F.when(at("$.results") != "ARRAY", NO_RESULTS),
        F.when(~at("$.mode").isin("STRING", "VOID"), BAD_MODE),
    ]
    ask = [
        F.when(at("$.generated_answer") != "OBJECT", NO_ANSWER),
        F.when(at("$.retrieval_snapshot") != "OBJECT", NO_SNAPSHOT),
        F.when(at("$.retrieval_results") != "ARRAY", NO_RETRIEVAL),
    ]
    bundle = [
        F.when(at("$.doctor") != "OBJECT", NO_DOCTOR),
        F.when(at("$.traces") != "OBJECT", NO_TRACES),
        *(
            F.when(
                (at("$.traces") == "OBJECT")
                & present(f"$.traces.{key}")
                & (at(f"$.traces.{key}") != "ARRAY"),
                BAD_TRACES.format(key),
            )
            for key in ("inspect", "ask")
        ),
    ]
    rules = (
        F.when(kind == "inspect", F.array(wrong_query, *inspect))
        .when(kind == "ask", F.array(wrong_query, *ask))
        .when(kind == "debug-bundle", F.array(wrong_query, *bundle))
        .otherwise(F.array(wrong_query, F.lit(UNMANAGED)))
    )
    return F.when(payload.isNull(), F.array(F.lit(NO_OBJECT))).otherwise(
        F.filter(rules, lambda m: m.isNotNull())
    )


def verify_run_log(log: DataFrame) -> DataFrame:
    """Managed entries with `issues` and `valid`."""
    seen = run_log_metadata(log)
    return seen.withColumn("issues", run_issues(F.col("type"), F.col("payload"))).withColumn(
        "valid", F.size("issues") == 0
    )


def verify_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count("*").alias("total_count"),
        F.count_if("valid").alias("valid_count"),
        F.count_if(~F.col("valid")).alias("invalid_count"),
    )


def retention(log: DataFrame, keep: int) -> DataFrame:
    """Managed entries with `kept`: true for the newest `keep`.

    Only the key of the last kept entry is needed, found by a distributed top-n;
    no global sort or single-task window.
    """
    seen = run_log_metadata(log)
    age = F.struct("modified_at", "file_name")
    if keep <= 0:
        return seen.withColumn("kept", F.lit(False))
    newest = seen.select(age.alias("age")).orderBy(F.desc("age")).limit(keep)
    edge = newest.agg(F.min("age").alias("age")).select("age").scalar()
    return seen.withColumn("kept", F.coalesce(age >= edge, F.lit(False)))


def latest(
    df: DataFrame, n: int, by: str | None = None, order: tuple[str, ...] = ("modified_at", "file_name")
) -> DataFrame:
    """Newest `n` rows, of the whole table or per value of `by`."""
    keys = [F.desc(c) for c in order]
    if by is None:
        return df.orderBy(*keys).limit(n)
    return top_k(df, n, [by], keys, "recency")


def mark_stale(jobs: DataFrame, now: Column, after: str = STALE_AFTER) -> DataFrame:
    """Running jobs without a heartbeat since `now - after` become interrupted."""
    stale = (F.col("status") == "running") & (
        F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") <= now - F.expr(f"INTERVAL {after}"))
    )
    return jobs.withColumn(
        "finished_at", F.when(stale, now).otherwise(F.col("finished_at"))
    ).withColumn("status", F.when(stale, "interrupted").otherwise(F.col("status")))


def number_events(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """`sequence` per job in order of (created_at, id), after the `prior` maximum.

    Events are cut into ranges of (job, created_at, id) of about one size, numbered within
    (range, job) and shifted by the counts of the job's earlier ranges: a busy job, or one
    busy hour of it, is spread over many tasks.  Events without a time come first, those
    without a job are a job of their own.  `prior` has (job_id, sequence).
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["job_id", "created_at", "id"]
    # Stored, so that a repeated task cannot see other ranges than the first run did.
    ranged = materialize(
        events.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    )
    before = Window.partitionBy("job_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("job_id", "part")
        .agg(F.count("*").alias("n"))
        .select("job_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    if prior is not None:
        top = prior.groupBy(F.col("job_id").alias("top_job")).agg(F.max("sequence").alias("top"))
        shifts = shifts.join(top, F.col("job_id").eqNullSafe(F.col("top_job")), "left").select(
            "job_id", "part", (F.col("shift") + F.coalesce("top", F.lit(0))).alias("shift")
        )
    shifts = shifts.select(F.col("job_id").alias("shift_job"), F.col("part").alias("shift_part"), "shift")
    local = Window.partitionBy("part", "job_id").orderBy("created_at", "id")
    same = (F.col("part") == F.col("shift_part")) & F.col("job_id").eqNullSafe(F.col("shift_job"))
    return (
        ranged.withColumn("local", F.row_number().over(local))
        .join(shifts, same)
        .withColumn("sequence", F.col("local") + F.col("shift"))
        .drop("local", "part", "shift_job", "shift_part", "shift")
    )


def tail_events(
    events: DataFrame, after_id: int = 0, limit: int = 200, job_id: int | None = None
) -> DataFrame:
    """Next events after a cursor, oldest first."""
    rows = events.filter(F.col("id") > after_id)
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    return rows.orderBy("id").limit(limit)
