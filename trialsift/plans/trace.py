"""Run-trace queries over the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators import trace as O
from trialsift.plans.registry import query, sql_draw, sql_in, sql_list
from trialsift.sources import corpus

# event_type of the given table -> trace event type
KINDS = {
    "signup": "call.started",
    "purchase": "call.completed",
    "error": "call.failed",
    "click": "call.attempt",
    "view": "node.completed",
}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def stamp(column: str):
    """Time as text: independent of the session time zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


_EVENTS = f"""ev AS (SELECT event_id, ts, user_id, {_KIND_SQL} AS event_type, value, regexp_extract(props,'\\d+')::INT AS k FROM events),
 tev AS (SELECT *, 'run-'||(user_id%10) AS run_id, CASE WHEN event_type IN ('call.completed','call.failed') AND event_id-1-k%7>=0 THEN event_id-1-k%7 END AS parent_event_id FROM ev)"""


def trace_events(spark, sf):
    return (
        corpus.table(spark, sf, "events")
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .selectExpr(
            "event_id",
            "ts",
            "user_id",
            f"{_KIND_SQL} AS event_type",
            "value",
            "k",
            "concat('run-', user_id % 10) AS run_id",
            "CASE WHEN event_type IN ('purchase','error') AND event_id-1-k%7 >= 0 THEN event_id-1-k%7 END AS parent_event_id",
        )
    )


_SPANS = f"""{_EVENTS}, spans AS (SELECT 'span_'||event_id AS span_id, CASE WHEN k%5=0 THEN 'trial' ELSE 'outcome' END AS tier,
   'judgment_D'||(k%5+1)||CASE WHEN k%2=0 THEN '_retry' ELSE '' END AS node, value/100 AS duration_s,
   CASE WHEN event_type='call.failed' THEN 'Timeout' END AS error FROM tev)"""


def spans(spark, sf):
    return trace_events(spark, sf).selectExpr(
        "concat('span_', event_id) AS span_id",
        "IF(k % 5 = 0, 'trial', 'outcome') AS tier",
        "concat('judgment_D', k % 5 + 1, IF(k % 2 = 0, '_retry', '')) AS node",
        "value / 100 AS duration_s",
        "IF(event_type = 'call.failed', 'Timeout', NULL) AS error",
    )


@query(
    "node_stats",
    f"""WITH {_SPANS} SELECT tier, node, regexp_extract(node,'D\\d') AS domain, count(*) AS calls, round(sum(duration_s),4) AS total_s, max(duration_s) AS max_s,
      round(avg(duration_s),6) AS mean_s, count(error) AS errors FROM spans GROUP BY tier, node""",
)
def node_stats(spark, sf):
    stats = O.node_stats(spans(spark, sf))
    return stats.withColumns(
        {
            "domain": O.domain_of_node(F.col("node")),
            "total_s": F.round("total_s", 4),
            "mean_s": F.round("mean_s", 6),
        }
    )


@query("slowest_spans", f"WITH {_SPANS} SELECT span_id, tier, node, duration_s FROM spans ORDER BY duration_s DESC, span_id LIMIT 10")
def slowest_spans(spark, sf):
    return O.slowest_spans(spans(spark, sf).select("span_id", "tier", "node", "duration_s"))


_MODELS = [m[0] for m in C.MODEL_PRICES] + ["unlisted-model"]
_CALLS = f"""calls AS (SELECT conv_id, conv_id||'-'||turn AS call_id, {sql_list(_MODELS)}[conv_id%{len(_MODELS)}+1] AS model, length(text)/100.0::DOUBLE AS latency_s,
   CASE WHEN {sql_draw("'i'||conv_id||'-'||turn", 10)}>0 THEN length(text)::BIGINT END AS input_tokens,
   CASE WHEN {sql_draw("'o'||conv_id||'-'||turn", 10)}>0 THEN turn*10+5 END AS output_tokens,
   CASE WHEN {sql_draw("'r'||conv_id||'-'||turn", 10)}=0 THEN turn*3 END AS cache_read_tokens,
   CASE WHEN {sql_draw("'w'||conv_id||'-'||turn", 10)}=0 THEN turn*2 END AS cache_write_tokens,
   {sql_draw("'p'||conv_id||'-'||turn", 3)}::INT AS repair_attempt_count, ['hit',' MISS ','stale'][{sql_draw("'c'||conv_id||'-'||turn", 3)}+1] AS cache_header, turn, role, text FROM conversations),
 prices(model, p_in, p_out, p_r, p_w) AS (VALUES {", ".join("(" + ",".join("NULL::DOUBLE" if v is None else (f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE") for v in (m[0], *m[3:])) + ")" for m in C.MODEL_PRICES)}),
 priced AS (SELECT c.*, CASE WHEN p.model IS NULL OR (input_tokens IS NOT NULL AND p_in IS NULL) OR (output_tokens IS NOT NULL AND p_out IS NULL)
     OR (cache_read_tokens IS NOT NULL AND p_r IS NULL) OR (cache_write_tokens IS NOT NULL AND p_w IS NULL)
     OR coalesce(input_tokens, output_tokens, cache_read_tokens, cache_write_tokens) IS NULL THEN NULL
   ELSE coalesce(input_tokens*p_in,0)/1e6 + coalesce(output_tokens*p_out,0)/1e6 + coalesce(cache_read_tokens*p_r,0)/1e6 + coalesce(cache_write_tokens*p_w,0)/1e6 END AS cost
   FROM calls c LEFT JOIN prices p USING (model))"""


def calls(spark, sf):
    seed = lambda tag: f"md5(concat('{tag}', conv_id, '-', turn))"
    d = lambda tag, m: f"CAST(CAST(conv(substring({seed(tag)}, 1, 8), 16, 10) AS BIGINT) % {m} AS INT)"
    models = ", ".join(f"'{m}'" for m in _MODELS)
    return corpus.table(spark, sf, "conversations").selectExpr(
        "conv_id",
        "concat(conv_id, '-', turn) AS call_id",
        f"array({models})[CAST(conv_id % {len(_MODELS)} AS INT)] AS model",
        "length(text) / 100D AS latency_s",
        f"IF({d('i', 10)} > 0, CAST(length(text) AS BIGINT), NULL) AS input_tokens",
        f"IF({d('o', 10)} > 0, turn * 10 + 5, NULL) AS output_tokens",
        f"IF({d('r', 10)} = 0, turn * 3, NULL) AS cache_read_tokens",
        f"IF({d('w', 10)} = 0, turn * 2, NULL) AS cache_write_tokens",
        f"{d('p', 3)} AS repair_attempt_count",
        f"array('hit', ' MISS ', 'stale')[{d('c', 3)}] AS cache_header",
        "turn",
        "role",
        "text",
    )


@query("call_cost", f"WITH {_CALLS} SELECT call_id, model, round(cost*1e6,4) AS cost_micro, cost IS NULL AS pricing_unknown FROM priced")
def call_cost(spark, sf):
    costed = O.call_costs(calls(spark, sf), O.model_prices(spark))
    return costed.select("call_id", "model", F.round(F.col("cost") * 1e6, 4).alias("cost_micro"), "pricing_unknown")


@query(
    "timing_summary",
    f"""WITH {_CALLS}, walls AS (SELECT conv_id, (conv_id%50)*1.5::DOUBLE AS wall_time_s FROM conversations WHERE turn=0)
     SELECT w.conv_id, w.wall_time_s, round(sum(latency_s),4) AS call_latency_s, count(*) AS call_count, sum(input_tokens)::BIGINT AS input_token_count,
      sum(output_tokens)::BIGINT AS output_token_count, sum(cache_read_tokens)::BIGINT AS cache_read_token_count, sum(cache_write_tokens)::BIGINT AS cache_write_token_count,
      sum(repair_attempt_count)::BIGINT AS repair_attempt_count, CASE WHEN NOT bool_or(cost IS NULL) THEN round(sum(cost)*1e6,4) END AS cost_micro,
      bool_or(cost IS NULL) AS pricing_unknown, round(greatest(w.wall_time_s-sum(latency_s),0),4) AS estimated_other_time_s
     FROM walls w JOIN priced USING (conv_id) GROUP BY w.conv_id, w.wall_time_s""",
)
def timing_summary(spark, sf):
    costed = O.call_costs(calls(spark, sf), O.model_prices(spark))
    walls = (
        corpus.table(spark, sf, "conversations")
        .where("turn = 0")
        .selectExpr("conv_id", "(conv_id % 50) * 1.5D AS wall_time_s")
    )
    out = O.timing_summary(costed, walls, ["conv_id"])
    return out.withColumn("cost_micro", F.round(F.col("total_cost") * 1e6, 4)).drop("total_cost").withColumns(
        {c: F.round(c, 4) for c in ("call_latency_s", "estimated_other_time_s")}
    )


@query(
    "cache_hit_rate",
    f"""WITH {_CALLS} SELECT model, avg(CASE lower(trim(cache_header)) WHEN 'hit' THEN 1.0::DOUBLE WHEN 'miss' THEN 0 END) AS hit_rate,
      count(*) FILTER (lower(trim(cache_header)) IN ('hit','miss')) AS known, count(*) FILTER (lower(trim(cache_header)) NOT IN ('hit','miss')) AS unknown FROM calls GROUP BY ALL""",
)
def cache_hit_rate(spark, sf):
    return O.cache_rates(calls(spark, sf), ["model"])


@query(
    "prefix_registry",
    """SELECT substr(sha256(text),1,16) AS prefix_hash, any_value(md5(text)) AS body_md5, min(doc_id) AS first_call, count(*) AS n_calls
     FROM documents WHERE length(text)>0 GROUP BY 1""",
)
def prefix_registry(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    return O.prefix_registry(docs, "text", "doc_id").select(
        "prefix_hash", F.md5("body").alias("body_md5"), "first_call", "n_calls"
    )


@query(
    "degradation_counts",
    f"""WITH {_EVENTS} SELECT CASE WHEN event_type='call.failed' THEN 'sq_call_failed_to_ni' WHEN k%2=0 THEN 'context_trimmed' ELSE 'quote_downgraded_to_ni' END AS category,
      CASE WHEN event_type='call.failed' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM tev WHERE event_type IN ('call.failed','node.completed') GROUP BY ALL""",
)
def degradation_counts(spark, sf):
    events = trace_events(spark, sf).where("event_type IN ('call.failed', 'node.completed')")
    return O.degradation_counts(
        events.selectExpr(
            "CASE WHEN event_type = 'call.failed' THEN 'sq_call_failed_to_ni' WHEN k % 2 = 0 THEN 'context_trimmed' ELSE 'quote_downgraded_to_ni' END AS category",
            "IF(event_type = 'call.failed', 'error', 'warning') AS severity",
        )
    )


PAIRS_SQL = f"""WITH {_EVENTS}, e AS (SELECT *, row_number() OVER (PARTITION BY parent_event_id ORDER BY ts, event_id) AS rn FROM tev WHERE parent_event_id IS NOT NULL)
     SELECT s.run_id, s.event_id AS start_id, strftime(s.ts,{STAMP}) AS started_at, e.event_id AS end_id, strftime(e.ts,{STAMP}) AS ended_at,
      coalesce(replace(e.event_type,'call.',''),'outstanding') AS state
     FROM tev s LEFT JOIN e ON e.parent_event_id=s.event_id AND e.rn=1 WHERE s.event_type='call.started'"""


@query("span_pairs", PAIRS_SQL)
def span_pairs(spark, sf):
    return O.pair_calls(trace_events(spark, sf)).withColumns({c: stamp(c) for c in ("started_at", "ended_at")})


_ATTEMPTS = f"""att AS (SELECT event_id//4 AS call_id, {sql_list(_MODELS)}[(event_id//4)%{len(_MODELS)}+1] AS model, (event_id%4+1)::INT AS attempt,
   event_type<>'error' AS validated, CASE WHEN event_type='error' THEN 'rate limited' END AS error FROM events),
 lad AS (SELECT model, call_id, max(attempt) AS attempts, count(error) AS transient_errors, arg_max(validated, attempt) AS validated,
   arg_max(validated, attempt) AND max(attempt)>1 AS retry_success FROM att GROUP BY ALL)"""


def _attempts(spark, sf):
    models = ", ".join(f"'{m}'" for m in _MODELS)
    return corpus.table(spark, sf, "events").selectExpr(
        "event_id div 4 AS call_id",
        f"array({models})[CAST((event_id div 4) % {len(_MODELS)} AS INT)] AS model",
        "CAST(event_id % 4 + 1 AS INT) AS attempt",
        "event_type <> 'error' AS validated",
        "IF(event_type = 'error', 'rate limited', NULL) AS error",
    )


@query("attempt_ladder", f"WITH {_ATTEMPTS} SELECT * FROM lad")
def attempt_ladder(spark, sf):
    return O.attempt_ladder(_attempts(spark, sf))


@query(
    "attempt_rates",
    f"""WITH {_ATTEMPTS} SELECT model, count(*) AS calls, avg(attempts) AS mean_attempts, avg(validated::INT) AS validated_rate,
      avg(retry_success::INT) AS retry_success_rate, avg((attempts>1)::INT) AS repair_rate FROM lad GROUP BY ALL""",
)
def attempt_rates(spark, sf):
    return O.ladder_rates(O.attempt_ladder(_attempts(spark, sf)))


@query(
    "call_scopes",
    """WITH l AS (SELECT o_orderkey, CASE o_custkey%4 WHEN 0 THEN (o_custkey%5+1)||'.'||(o_orderkey%3+1)||'|assignment' WHEN 1 THEN 'metadata'
       WHEN 2 THEN 'supplement_annotation:doc.pdf' ELSE (o_custkey%5+1)||'.1' END AS call_label FROM orders)
     SELECT o_orderkey, call_label, CASE WHEN call_label[1] BETWEEN '0' AND '9' THEN split_part(call_label,'|',1) END AS sq_id,
      CASE WHEN call_label[1] BETWEEN '0' AND '9' THEN 'D'||split_part(call_label,'.',1) END AS domain FROM l""",
)
def call_scopes(spark, sf):
    labels = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """CASE o_custkey % 4 WHEN 0 THEN concat(o_custkey % 5 + 1, '.', o_orderkey % 3 + 1, '|assignment') WHEN 1 THEN 'metadata'
           WHEN 2 THEN 'supplement_annotation:doc.pdf' ELSE concat(o_custkey % 5 + 1, '.1') END AS call_label""",
    )
    return labels.withColumns(O.scope_of_label(F.col("call_label")))


@query(
    "backoff_audit",
    f"""WITH {_EVENTS}, f AS (SELECT [429,500,503,408][k%4+1] AS status, (k//4)%7 AS attempt, CASE WHEN k%3=0 THEN value END AS retry_after, value FROM tev WHERE event_type='call.failed')
     SELECT status, attempt::BIGINT AS attempt, count(*) AS n, round(sum(CASE WHEN status=429 THEN CASE WHEN retry_after IS NULL THEN least(2*pow(2,attempt),60) ELSE least(retry_after,120) END ELSE least(0.25*pow(2,attempt),2) END),4) AS expected_s,
      count(*) FILTER (value < CASE WHEN status=429 THEN CASE WHEN retry_after IS NULL THEN least(2*pow(2,attempt),60) ELSE least(retry_after,120) END ELSE least(0.25*pow(2,attempt),2) END) AS too_early FROM f GROUP BY ALL""",
)
def backoff_audit(spark, sf):
    failed = (
        trace_events(spark, sf)
        .where("event_type = 'call.failed'")
        .selectExpr("array(429,500,503,408)[k % 4] AS status", "(k div 4) % 7 AS attempt", "IF(k % 3 = 0, value, NULL) AS retry_after", "value")
    )
    wait = O.expected_backoff(F.col("status"), F.col("attempt"), F.col("retry_after"))
    return (
        failed.withColumn("wait", wait)
        .groupBy("status", "attempt")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("wait"), 4).alias("expected_s"),
            F.count_if(F.col("value") < F.col("wait")).alias("too_early"),
        )
    )


_ERRORS = ["Rate limit exceeded", "Incorrect API key provided", "Maximum context length is 131072", "teapot", "service unavailable"]
_NAMES = ["RateLimitError", "AuthenticationError", "BadRequestError", "OddError", "APIError"]


def _sql_any(text, markers):
    return "(" + " OR ".join(f"contains({text},'{m}')" for m in markers) + ")"


@query(
    "error_classes",
    f"""WITH {_EVENTS}, f AS (SELECT [429,401,400,NULL,503,404][k%6+1] AS status, lower({sql_list(_NAMES)}[(k//6)%5+1]||' '||{sql_list(_ERRORS)}[(k//6)%5+1]) AS t FROM tev WHERE event_type='call.failed'),
     g AS (SELECT *, CASE WHEN status IN (408,409,425,429,500,502,503,504) THEN true WHEN status>=400 AND status<500 THEN false ELSE {_sql_any("t", C.TRANSIENT_MARKERS)} END AS retryable FROM f)
     SELECT status, retryable, CASE WHEN {_sql_any("t", C.AUTH_MARKERS)} THEN 'auth' WHEN {_sql_any("t", C.INVALID_REQUEST_MARKERS)} THEN 'invalid_request' WHEN retryable THEN 'retryable' ELSE 'other' END AS error_class,
      count(*) AS n FROM g GROUP BY ALL""",
)
def error_classes(spark, sf):
    pick = lambda values: "array(" + ", ".join(f"'{v}'" for v in values) + ")[(k div 6) % 5]"
    failed = (
        trace_events(spark, sf)
        .where("event_type = 'call.failed'")
        .selectExpr("array(429,401,400,NULL,503,404)[k % 6] AS status", f"{pick(_NAMES)} AS name", f"{pick(_ERRORS)} AS message")
    )
    kinds = O.classify_error(F.col("status"), F.col("name"), F.col("message"))
    return failed.withColumns(kinds).groupBy("status", "retryable", "error_class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "broken_references",
    f"""WITH {_EVENTS}, r AS (SELECT event_id, unnest(['calls/'||(event_id%5000)||'.json','context/'||k||'.json']) AS artifact_ref FROM tev)
     SELECT event_id, artifact_ref FROM r WHERE artifact_ref NOT IN (SELECT 'calls/'||o_orderkey||'.json' FROM orders WHERE o_orderstatus<>'P' UNION ALL SELECT 'context/'||p_size||'.json' FROM part)""",
)
def broken_references(spark, sf):
    events = trace_events(spark, sf).select(
        "event_id",
        F.array(
            F.concat(F.lit("calls/"), F.col("event_id") % 5000, F.lit(".json")),
            F.concat(F.lit("context/"), F.col("k"), F.lit(".json")),
        ).alias("artifact_refs"),
    )
    artifacts = (
        corpus.table(spark, sf, "orders")
        .where("o_orderstatus <> 'P'")
        .selectExpr("concat('calls/', o_orderkey, '.json') AS artifact_ref")
        .unionByName(corpus.table(spark, sf, "part").selectExpr("concat('context/', p_size, '.json') AS artifact_ref"))
    )
    return O.broken_references(events, artifacts)


@query(
    "latest_run",
    f"""WITH {_EVENTS}, runs AS (SELECT run_id, min(ts) AS started_at FROM tev GROUP BY ALL)
     SELECT 'runs/'||arg_max(run_id, started_at) AS root, strftime(max(started_at),{STAMP}) AS started_at FROM runs""",
)
def latest_run(spark, sf):
    runs = (
        trace_events(spark, sf)
        .groupBy("run_id")
        .agg(F.min("ts").alias("started_at"))
        .withColumn("root", F.concat(F.lit("runs/"), F.col("run_id")))
    )
    return O.latest_run(runs).withColumn("started_at", stamp("started_at"))


@query("tail_events", f"WITH {_EVENTS} SELECT event_id, event_type, strftime(ts,{STAMP}) AS ts FROM tev ORDER BY tev.ts DESC, event_id DESC LIMIT 20")
def tail_events(spark, sf):
    return O.tail(trace_events(spark, sf).select("event_id", "event_type", "ts"), 20).withColumn("ts", stamp("ts"))


TUMBLING_SQL = f"""WITH {_EVENTS} SELECT strftime(time_bucket(INTERVAL 6 hours, ts),{STAMP}) AS window_start, strftime(time_bucket(INTERVAL 6 hours, ts)+INTERVAL 6 hours,{STAMP}) AS window_end,
  event_type, count(*) AS n, round(sum(value),4) AS total_value FROM tev GROUP BY ALL"""


def _as_text(df):
    return df.withColumns(
        {
            "window_start": stamp("window_start"),
            "window_end": stamp("window_end"),
            "total_value": F.round("total_value", 4),
        }
    )


@query("event_windows_tumbling", TUMBLING_SQL)
def event_windows_tumbling(spark, sf):
    return _as_text(O.windowed_counts(trace_events(spark, sf), "6 hours", None, ["event_type"]))


@query(
    "event_windows_sliding",
    f"""WITH {_EVENTS}, x AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 2 hours, ts), time_bucket(INTERVAL 2 hours, ts)-INTERVAL 2 hours, time_bucket(INTERVAL 2 hours, ts)-INTERVAL 4 hours]) AS ws FROM tev)
     SELECT strftime(ws,{STAMP}) AS window_start, strftime(ws+INTERVAL 6 hours,{STAMP}) AS window_end, event_type, count(*) AS n, round(sum(value),4) AS total_value FROM x GROUP BY ALL""",
)
def event_windows_sliding(spark, sf):
    return _as_text(O.windowed_counts(trace_events(spark, sf), "6 hours", "2 hours", ["event_type"]))


@query(
    "event_sessions",
    f"""WITH {_EVENTS}, x AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts)+INTERVAL 8 hours THEN 0 ELSE 1 END AS fresh FROM tev),
     y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM x)
     SELECT user_id, strftime(min(ts),{STAMP}) AS session_start, strftime(max(ts)+INTERVAL 8 hours,{STAMP}) AS session_end, count(*) AS n_events, round(sum(value),4) AS total_value
     FROM y GROUP BY user_id, sid""",
)
def event_sessions(spark, sf):
    out = O.sessions(trace_events(spark, sf), ["user_id"], "8 hours")
    return out.withColumns(
        {c: stamp(c) for c in ("session_start", "session_end")} | {"total_value": F.round("total_value", 4)}
    )


@query(
    "safe_headers",
    f"""WITH {_EVENTS} SELECT event_id, CASE WHEN k%3=0 THEN 'retry-after='||k||';' ELSE '' END||'x-request-id=r'||event_id AS headers FROM tev""",
)
def safe_headers(spark, sf):
    """Response headers that may be kept."""
    sent = F.map_concat(
        F.create_map(F.lit("X-Request-ID"), F.concat(F.lit("r"), "event_id"), F.lit("Authorization"), F.lit("secret")),
        F.when(F.col("k") % 3 == 0, F.create_map(F.lit("Retry-After"), F.col("k").cast("string"))).otherwise(
            F.create_map(F.lit("Set-Cookie"), F.lit("secret"))
        ),
    )
    kept = trace_events(spark, sf).select("event_id", F.array_sort(F.map_entries(O.safe_headers(sent))).alias("h"))
    return kept.select("event_id", F.array_join(F.transform("h", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


@query(
    "trace_levels",
    f"""WITH {_EVENTS}, c AS (SELECT count(*) AS n, sum(length(props))::BIGINT AS chars FROM events)
     SELECT 'full' AS level, n, chars FROM c UNION ALL SELECT 'summary', n, NULL FROM c UNION ALL SELECT 'off', 0, NULL FROM c""",
)
def trace_levels(spark, sf):
    """Calls that each trace level keeps, and the characters of their bodies."""
    calls = corpus.table(spark, sf, "events").select("event_id", F.col("props").alias("raw_response"))
    parts = []
    for level in ("off", "summary", "full"):
        kept = O.at_level(calls, level)
        body = F.sum(F.length("raw_response")) if "raw_response" in kept.columns else F.lit(None).cast("bigint")
        parts.append(kept.agg(F.count(F.lit(1)).alias("n"), body.alias("chars")).select(F.lit(level).alias("level"), "n", "chars"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
