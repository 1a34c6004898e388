"""Run-trace analytics: cost, node statistics, call pairing, attempts, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators.batch import sticky_sum

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
PRICE_COLUMNS = ("price_in", "price_out", "price_cache_read", "price_cache_write")


def model_prices(spark: SparkSession) -> DataFrame:
    """Fixed price list, one row per model."""
    return spark.createDataFrame(
        list(C.MODEL_PRICES),
        "model string, provider string, context_window int, price_in double, price_out double, "
        "price_cache_read double, price_cache_write double",
    )


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per call.  Unknown model, an unpriced used component or no known
    component give null; zero only comes from zero prices."""
    parts = list(zip(TOKEN_COLUMNS, PRICE_COLUMNS))
    used_unpriced = " OR ".join(f"({t} IS NOT NULL AND {p} IS NULL)" for t, p in parts)
    any_known = " OR ".join(f"({t} IS NOT NULL AND {p} IS NOT NULL)" for t, p in parts)
    total = " + ".join(f"coalesce({t} / 1000000D * {p}, 0D)" for t, p in parts)
    listed = prices.select("model", "context_window", *PRICE_COLUMNS).withColumn("_listed", F.lit(True))
    priced = calls.join(F.broadcast(listed), "model", "left")  # eleven fixed rows
    return (
        priced.withColumn(
            "cost",
            F.expr(f"CASE WHEN _listed IS NULL OR ({used_unpriced}) OR NOT ({any_known}) THEN NULL ELSE {total} END"),
        )
        .withColumn("pricing_unknown", F.col("cost").isNull())
        .drop("_listed", "context_window", *PRICE_COLUMNS)
    )


def node_stats(spans: DataFrame, group: list[str] = ["tier", "node"]) -> DataFrame:
    return spans.groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("duration_s").alias("total_s"),
        F.max("duration_s").alias("max_s"),
        F.avg("duration_s").alias("mean_s"),
        F.count("error").alias("errors"),
    )


def timing_summary(costed_calls: DataFrame, walls: DataFrame, key: list[str]) -> DataFrame:
    """Totals per run key; walls holds one (key, wall_time_s) row per run."""
    totals = costed_calls.groupBy(*key).agg(
        F.sum("latency_s").alias("call_latency_s"),
        F.count(F.lit(1)).alias("call_count"),
        *[F.sum(c).alias(c.replace("_tokens", "_token_count")) for c in TOKEN_COLUMNS],
        F.sum("repair_attempt_count").alias("repair_attempt_count"),
        sticky_sum(F.when(~F.col("pricing_unknown"), F.col("cost"))).alias("total_cost"),
        F.bool_or("pricing_unknown").alias("pricing_unknown"),
    )
    return walls.join(totals, key, "left").withColumn(
        "estimated_other_time_s", F.greatest(F.col("wall_time_s") - F.coalesce("call_latency_s", F.lit(0.0)), F.lit(0.0))
    )


def slowest_spans(spans: DataFrame, n: int = 10) -> DataFrame:
    return spans.orderBy(F.desc("duration_s"), "span_id").limit(n)


def prefix_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def prefix_registry(calls: DataFrame, text: str, order: str, level: str = "full") -> DataFrame:
    """One body per hash, first call wins; copies combine map-side before the shuffle."""
    body = F.min_by(F.col(text), F.col(order)) if level == "full" else F.lit("")
    return (
        calls.where(F.length(text) > 0)
        .withColumn("prefix_hash", prefix_hash(F.col(text)))
        .groupBy("prefix_hash")
        .agg(
            body.alias("body"),
            F.min(order).alias("first_call"),
            F.count(F.lit(1)).alias("n_calls"),
        )
    )


BODY_COLUMNS = ("messages", "raw_response", "parsed_response", "validation_result", "final_result", "repair_attempts")


def at_level(calls: DataFrame, level: str) -> DataFrame:
    """off keeps nothing, summary drops the bodies, full keeps everything."""
    if level == "off":
        return calls.limit(0)
    return calls if level == "full" else calls.drop(*[c for c in BODY_COLUMNS if c in calls.columns])


def degradation_counts(degradations: DataFrame) -> DataFrame:
    return degradations.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def scope_of_label(label: Column) -> dict[str, Column]:
    """sq_id and domain from a call label such as `1.1|assignment`."""
    head = F.split_part(label, F.lit("|"), F.lit(1))
    is_question = head.rlike(r"^\d[^|]*") & F.contains(head, F.lit("."))
    return {
        "sq_id": F.when(is_question, head),
        "domain": F.when(is_question, F.concat(F.lit("D"), F.split_part(head, F.lit("."), F.lit(1)))),
    }


def domain_of_node(node: Column) -> Column:
    return F.nullif(F.regexp_extract(node, r"(?:^|_)(D\d)(?:_|$)", 1), F.lit(""))


def pair_calls(events: DataFrame) -> DataFrame:
    """Match completed and failed events with their started event by parent id.

    Both sides carry unique event ids, so the join key cannot be hot; events
    without a parent never enter the join.
    """
    started = events.where(F.col("event_type") == "call.started").select(
        F.col("event_id").alias("start_id"), F.col("ts").alias("started_at"), "run_id"
    )
    ends = (
        events.where(F.col("event_type").isin("call.completed", "call.failed") & F.col("parent_event_id").isNotNull())
        .groupBy(F.col("parent_event_id").alias("start_id"))
        .agg(F.min_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("end"))
    )
    return started.join(ends, "start_id", "left").select(
        "run_id",
        "start_id",
        "started_at",
        F.col("end.event_id").alias("end_id"),
        F.col("end.ts").alias("ended_at"),
        F.coalesce(F.replace(F.col("end.event_type"), F.lit("call."), F.lit("")), F.lit("outstanding")).alias("state"),
    )


def attempt_ladder(attempts: DataFrame) -> DataFrame:
    """Per call: attempts, transient errors, whether a retry succeeded.

    Needs call_id, model, attempt, validated, error.
    """
    return attempts.groupBy("model", "call_id").agg(
        F.max("attempt").alias("attempts"),
        F.count("error").alias("transient_errors"),
        F.max_by("validated", "attempt").alias("validated"),
        (F.max_by("validated", "attempt") & (F.max("attempt") > 1)).alias("retry_success"),
    )


def ladder_rates(ladder: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return ladder.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg("attempts").alias("mean_attempts"),
        rate(F.col("validated")).alias("validated_rate"),
        rate(F.col("retry_success")).alias("retry_success_rate"),
        rate(F.col("attempts") > 1).alias("repair_rate"),
    )


def expected_backoff(status: Column, attempt: Column, retry_after: Column) -> Column:
    """Seconds a client should have waited before the next attempt."""
    growth = F.pow(F.lit(2.0), attempt)
    return F.when(
        status == 429,
        F.when(retry_after.isNotNull(), F.least(F.greatest(retry_after, F.lit(0.0)), F.lit(120.0))).otherwise(
            F.least(F.lit(2.0) * growth, F.lit(60.0))
        ),
    ).otherwise(F.least(F.lit(0.25) * growth, F.lit(2.0)))


def broken_references(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Event references that point at no artifact."""
    refs = events.select("event_id", F.explode("artifact_refs").alias("artifact_ref"))
    return refs.join(artifacts.select("artifact_ref").distinct(), "artifact_ref", "left_anti")


def cache_rates(calls: DataFrame, group: list[str]) -> DataFrame:
    hit = F.lower(F.trim("cache_header"))
    tri = F.when(hit == "hit", 1.0).when(hit == "miss", 0.0)
    return calls.groupBy(*group).agg(
        F.avg(tri).alias("hit_rate"), F.count(tri).alias("known"), F.count_if(tri.isNull()).alias("unknown")
    )


def contains_any(text: Column, markers) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


def classify_error(status: Column, name: Column, message: Column) -> dict[str, Column]:
    """retryable flag and error class from a provider error."""
    text = F.lower(F.concat_ws(" ", name, message))
    transient = contains_any(text, C.TRANSIENT_MARKERS)
    retryable = (
        F.when(status.isin(*C.RETRYABLE_STATUS), True)
        .when((status >= 400) & (status < 500), False)
        .otherwise(transient)
    )
    kind = (
        F.when(contains_any(text, C.AUTH_MARKERS), "auth")
        .when(contains_any(text, C.INVALID_REQUEST_MARKERS), "invalid_request")
        .when(retryable, "retryable")
        .otherwise("other")
    )
    return {"retryable": retryable, "error_class": kind}


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("root", "started_at").alias("root"), F.max("started_at").alias("started_at"))


def tail(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def sessions(events: DataFrame, key: list[str], gap: str = "30 minutes", chunk: str = "DAY") -> DataFrame:
    """Activity sessions per key.

    Sessions are first merged inside (key, calendar chunk), which spreads a
    hot key over the whole time range; only the short list of partial sessions
    of a key is then stitched across chunk borders.
    """
    partial = (
        events.withColumn("_chunk", F.date_trunc(chunk, "ts"))
        .groupBy(*key, "_chunk", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v"))
        .select(*key, F.col("w.start").alias("_start"), F.col("w.end").alias("_end"), "_n", "_v")
    )
    w = Window.partitionBy(*key).orderBy("_start")
    stitched = partial.withColumn(
        "_new", F.coalesce(F.col("_start") >= F.lag("_end").over(w), F.lit(True)).cast("int")
    ).withColumn("_session", F.sum("_new").over(w))
    return (
        stitched.groupBy(*key, "_session")
        .agg(
            F.min("_start").alias("session_start"),
            F.max("_end").alias("session_end"),
            F.sum("_n").alias("n_events"),
            F.sum("_v").alias("total_value"),
        )
        .drop("_session")
    )


def windowed_counts(events: DataFrame, size: str, slide: str | None, key: list[str]) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.groupBy(w.alias("w"), *key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *key, "n", "total_value")
    )


def safe_headers(headers: Column) -> Column:
    """Response headers that may be kept, names in lower case."""
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.map_filter(lowered, lambda k, _: k.isin(*C.SAFE_HEADERS))
