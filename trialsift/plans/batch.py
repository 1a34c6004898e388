"""Manifest, resume, upsert and totals queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators import batch as B
from trialsift.operators.skew import hot_key_join
from trialsift.plans import registry_records as PRR
from trialsift.plans.registry import REGISTRY, query, sql_draw
from trialsift.sources import corpus

MODEL, VERSION = "gpt-oss-120b", "0.1.0"
_CONST = f"'assignment' AS effect_of_interest, '{MODEL}' AS model_sq, '{VERSION}' AS pipeline_version"

_LISTS = "['Outcome 1','Outcome 1; Outcome  2 ;;','  ; ;','Outcome 1;Outcome 2; Outcome   3']"
_ENTRIES = f"""entries AS (SELECT o_orderkey AS entry_id, 'T'||o_orderkey AS trial_id, {_LISTS}[o_custkey%4+1] AS outcomes_text, {_CONST} FROM orders),
 lists AS (SELECT *, [y for y in [trim(regexp_replace(x,'\\s+',' ','g')) for x in string_split(outcomes_text,';')] if y<>''] AS outcomes FROM entries),
 asked AS (SELECT entry_id, trial_id, effect_of_interest, model_sq, pipeline_version, unnest(outcomes) AS outcome FROM lists),
 results AS (SELECT DISTINCT 'T'||l_orderkey AS trial_id, 'Outcome '||l_linenumber AS outcome, {_CONST} FROM lineitem WHERE l_returnflag='A'
   UNION ALL SELECT 'T'||o_orderkey, '__TRIAL__', '__NA__', '{MODEL}', '{VERSION}' FROM orders WHERE o_orderstatus='P' AND o_custkey%5=0)"""


def _settings(df):
    return B.overlay_defaults(
        df, {"effect_of_interest": "assignment", "model_sq": MODEL, "pipeline_version": VERSION}
    )


def entries(spark, sf):
    texts = F.array(*[F.lit(t) for t in ("Outcome 1", "Outcome 1; Outcome  2 ;;", "  ; ;", "Outcome 1;Outcome 2; Outcome   3")])
    raw = corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry_id"),
        F.concat(F.lit("T"), F.col("o_orderkey")).alias("trial_id"),
        F.element_at(texts, (F.col("o_custkey") % 4 + 1).cast("int")).alias("outcomes_text"),
    )
    return _settings(raw.withColumn("outcomes", B.outcome_list(F.col("outcomes_text"))).drop("outcomes_text"))


def results(spark, sf):
    done = (
        corpus.table(spark, sf, "lineitem")
        .where("l_returnflag = 'A'")
        .select(
            F.concat(F.lit("T"), F.col("l_orderkey")).alias("trial_id"),
            F.concat(F.lit("Outcome "), F.col("l_linenumber")).alias("outcome"),
        )
    )
    skips = (
        corpus.table(spark, sf, "orders")
        .where("o_orderstatus = 'P' AND o_custkey % 5 = 0")
        .select(
            F.concat(F.lit("T"), F.col("o_orderkey")).alias("trial_id"),
            F.lit(C.SKIP_OUTCOME).alias("outcome"),
            F.lit(C.SKIP_EFFECT).alias("effect_of_interest"),
            F.lit(MODEL).alias("model_sq"),
            F.lit(VERSION).alias("pipeline_version"),
        )
    )
    return _settings(done).unionByName(skips)


@query(
    "manifest_outcomes",
    f"WITH {_ENTRIES} SELECT entry_id, CASE WHEN len(outcomes)>0 THEN array_to_string(outcomes,'|') END AS outcomes FROM lists",
)
def manifest_outcomes(spark, sf):
    return entries(spark, sf).select("entry_id", F.array_join("outcomes", "|").alias("outcomes"))


@query(
    "resume_missing_pairs",
    f"WITH {_ENTRIES} SELECT a.entry_id, a.trial_id, a.outcome FROM asked a ANTI JOIN results r USING (trial_id, outcome, effect_of_interest, model_sq, pipeline_version)",
)
def resume_missing_pairs(spark, sf):
    asked = B.requested_pairs(entries(spark, sf))
    return B.missing_pairs(asked, results(spark, sf)).select("entry_id", "trial_id", "outcome")


@query(
    "completed_pairs",
    f"WITH {_ENTRIES} SELECT a.entry_id, a.trial_id, a.outcome FROM asked a SEMI JOIN results r USING (trial_id, outcome, effect_of_interest, model_sq, pipeline_version)",
)
def completed_pairs(spark, sf):
    asked = B.requested_pairs(entries(spark, sf))
    return B.completed_pairs(asked, results(spark, sf)).select("entry_id", "trial_id", "outcome")


_STATUS = f"""{_ENTRIES}, st AS (SELECT l.entry_id, l.trial_id, count(a.outcome) AS n_requested, count(r.outcome) AS n_done,
   bool_or(s.trial_id IS NOT NULL) AS has_skip FROM lists l LEFT JOIN asked a USING (entry_id)
   LEFT JOIN results r ON r.trial_id=a.trial_id AND r.outcome=a.outcome AND r.effect_of_interest=a.effect_of_interest
   LEFT JOIN (SELECT trial_id FROM results WHERE outcome='__TRIAL__') s ON s.trial_id=l.trial_id GROUP BY ALL),
 status AS (SELECT entry_id, trial_id, n_requested, n_done, CASE WHEN has_skip THEN 'existing_skip_record'
   WHEN n_requested>0 AND n_done=n_requested THEN 'all_requested_pairs_completed' END AS skip_reason FROM st)"""


@query("entry_fast_skip", f"WITH {_STATUS} SELECT * FROM status")
def entry_fast_skip(spark, sf):
    return B.entry_status(entries(spark, sf), results(spark, sf))


@query(
    "entry_audit_events",
    f"""WITH {_STATUS} SELECT 'batch.entry.skipped' AS event_type, 'skipped' AS status, trial_id, entry_id,
      '{{"reason":"'||skip_reason||'","trial_id":"'||trial_id||'"}}' AS payload FROM status WHERE skip_reason IS NOT NULL""",
)
def entry_audit_events(spark, sf):
    return B.entry_events(B.entry_status(entries(spark, sf), results(spark, sf)))


_LINE = """CASE WHEN skip_reason IS NOT NULL THEN '['||entry_id||'] '||trial_id||': skipped'
   WHEN n_requested=0 THEN '['||entry_id||'] '||trial_id||': ineligible'
   ELSE '['||entry_id||'] '||trial_id||': assessed '||(n_requested-n_done)||' pair(s), skipped '||n_done END"""


@query("progress_lines", f"WITH {_STATUS} SELECT entry_id, {_LINE} AS line FROM status")
def progress_lines(spark, sf):
    status = B.entry_status(entries(spark, sf), results(spark, sf))
    return status.select(
        "entry_id",
        B.progress_line(
            F.col("entry_id"),
            F.col("trial_id"),
            F.col("skip_reason").isNotNull(),
            F.col("n_requested") - F.col("n_done"),
            F.col("n_done"),
        ).alias("line"),
    )


@query(
    "entry_status_counts",
    f"""WITH {_STATUS} SELECT coalesce(skip_reason, CASE WHEN n_requested=0 THEN 'from_metadata' ELSE 'to_assess' END) AS status,
      count(*) AS n_entries, sum(n_requested-n_done)::BIGINT AS n_open FROM status GROUP BY ALL""",
)
def entry_status_counts(spark, sf):
    status = B.entry_status(entries(spark, sf), results(spark, sf))
    label = F.coalesce("skip_reason", F.when(F.col("n_requested") == 0, "from_metadata").otherwise("to_assess"))
    return status.groupBy(label.alias("status")).agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum(F.col("n_requested") - F.col("n_done")).alias("n_open")
    )


_ROWS = f"""SELECT 'T'||l_orderkey AS trial_id, 'Outcome '||(l_linenumber%3) AS outcome, {_CONST}, l_linenumber AS batch_seq,
   l_orderkey||'-'||l_linenumber||'-'||l_partkey||'-'||l_suppkey AS assessment_id, ['Low','Some concerns','High'][l_partkey%3+1] AS overall_judgment FROM lineitem"""


@query(
    "upsert_latest_wins",
    f"""WITH x AS ({_ROWS}) SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, outcome, effect_of_interest, model_sq, pipeline_version
       ORDER BY batch_seq DESC, assessment_id DESC) AS rn FROM x) WHERE rn=1""",
)
def upsert_latest_wins(spark, sf):
    rows = corpus.table(spark, sf, "lineitem").select(
        F.concat(F.lit("T"), F.col("l_orderkey")).alias("trial_id"),
        F.concat(F.lit("Outcome "), F.col("l_linenumber") % 3).alias("outcome"),
        F.col("l_linenumber").alias("batch_seq"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("assessment_id"),
        F.element_at(F.array(*[F.lit(j) for j in C.JUDGMENTS]), (F.col("l_partkey") % 3 + 1).cast("int")).alias(
            "overall_judgment"
        ),
    )
    rows = _settings(rows)
    return B.latest_wins(rows.where("batch_seq <= 3"), rows.where("batch_seq > 3"))


@query(
    "skip_rows",
    f"""WITH e AS ({REGISTRY["eligibility"][1]}) SELECT 'S'||o_orderkey AS assessment_id, '2024-01-01T00:00:00Z' AS created_at, 'T'||o_orderkey AS trial_id, nct AS nct_number,
      '__TRIAL__' AS outcome, '__NA__' AS effect_of_interest, NULL::VARCHAR AS title, NULL::VARCHAR AS overall_judgment,
      {", ".join(f"NULL::VARCHAR AS d{i}_judgment" for i in range(1, 6))}, NULL::INT AS flagged_sq_count, NULL::INT AS uncertain_sq_count,
      1 AS requires_human_review, study_design, '{MODEL}' AS model_sq, '{MODEL}' AS model_aux, '{VERSION}' AS pipeline_version,
      NULL::VARCHAR AS inputs_hash, '["ineligible study_design='||study_design||': '||study_design_basis||'"]' AS errors
      FROM orders JOIN e ON nct='NCT'||lpad(o_custkey::VARCHAR,8,'0') WHERE NOT eligible""",
)
def skip_rows(spark, sf):
    """One audit row for every order of a trial that the eligibility decision leaves out."""
    out = PRR.eligibility(spark, sf).where("NOT eligible").withColumnRenamed("nct", "nct_number")
    orders = corpus.table(spark, sf, "orders").select("o_orderkey", F.format_string("NCT%08d", "o_custkey").alias("nct_number"))
    # a trial may own a large share of the orders, and has one decision
    skipped = hot_key_join(orders, out, ["nct_number"], "inner").select(
        F.concat(F.lit("S"), "o_orderkey").alias("assessment_id"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.concat(F.lit("T"), "o_orderkey").alias("trial_id"),
        "nct_number",
        "study_design",
        "study_design_basis",
        F.lit(MODEL).alias("model_sq"),
        F.lit(MODEL).alias("model_aux"),
        F.lit(VERSION).alias("pipeline_version"),
        F.lit(None).cast("string").alias("inputs_hash"),
    )
    return B.skip_rows(skipped)


@query(
    "manifest_error_rows",
    f"""SELECT coalesce(CASE WHEN o_custkey%2=0 THEN 'T'||o_orderkey END, 'manifest-entry-'||o_orderkey) AS trial_id, '__TRIAL__' AS outcome,
      '__NA__' AS effect_of_interest, 'unclear' AS study_design, 'manifest entry failed before assessment' AS study_design_basis,
      'manifest entry '||o_orderkey||' failed: ValueError: '||o_orderpriority AS errors FROM orders WHERE {sql_draw("'fail'||o_orderkey", 20)}=0""",
)
def manifest_error_rows(spark, sf):
    failed = (
        corpus.table(spark, sf, "orders")
        .where(corpus.draw(F.concat(F.lit("fail"), F.col("o_orderkey")), 20) == 0)
        .select(
            F.expr("IF(o_custkey % 2 = 0, concat('T', o_orderkey), NULL)").alias("trial_id"),
            F.col("o_orderkey").alias("entry_index"),
            F.concat(F.lit("ValueError: "), F.col("o_orderpriority")).alias("error"),
        )
    )
    return B.manifest_error_rows(failed)


_TIMING = f"""t AS (SELECT o_orderpriority, o_orderstatus, 'T'||o_orderkey AS trial_id, o_totalprice/1000 AS wall_time_s, o_totalprice/2000 AS call_latency_s,
   (o_custkey%20)::INT AS call_count, CASE WHEN o_orderstatus='P' OR {sql_draw("'in'||o_orderkey", 3)}>0 THEN o_custkey END AS i,
   CASE WHEN {sql_draw("'out'||o_orderkey", 3)}>0 THEN o_custkey*2 END AS o, {sql_draw("'cost'||o_orderkey", 4000)}=0 AS pricing_unknown, o_totalprice/1e6 AS cost FROM orders),
 timing AS (SELECT *, CASE WHEN coalesce(i,o) IS NOT NULL THEN coalesce(i,0)+coalesce(o,0) END AS token_count FROM t)"""


def timings(spark, sf):
    t = corpus.table(spark, sf, "orders").select(
        "o_orderpriority",
        "o_orderstatus",
        F.concat(F.lit("T"), F.col("o_orderkey")).alias("trial_id"),
        (F.col("o_totalprice") / 1000).alias("wall_time_s"),
        (F.col("o_totalprice") / 2000).alias("call_latency_s"),
        (F.col("o_custkey") % 20).cast("int").alias("call_count"),
        F.when((F.col("o_orderstatus") == "P") | (corpus.draw(F.concat(F.lit("in"), F.col("o_orderkey")), 3) > 0), F.col("o_custkey")).alias("i"),
        F.when(corpus.draw(F.concat(F.lit("out"), F.col("o_orderkey")), 3) > 0, F.col("o_custkey") * 2).alias("o"),
        (corpus.draw(F.concat(F.lit("cost"), F.col("o_orderkey")), 4000) == 0).alias("pricing_unknown"),
        (F.col("o_totalprice") / 1e6).alias("cost"),
    )
    return t.withColumn("token_count", B.known_total(F.col("i"), F.col("o")))


@query(
    "batch_totals_sticky_null",
    f"""WITH {_TIMING} SELECT o_orderpriority, o_orderstatus, count(*) AS processed_entries, round(sum(wall_time_s),6) AS total_wall_time_s,
      round(sum(call_latency_s),6) AS total_call_latency_s, sum(call_count)::BIGINT AS total_calls,
      CASE WHEN NOT bool_or(token_count IS NULL) THEN sum(token_count)::BIGINT END AS total_tokens,
      CASE WHEN NOT bool_or(pricing_unknown) THEN round(sum(cost),8) END AS total_cost FROM timing GROUP BY ALL""",
)
def batch_totals_sticky_null(spark, sf):
    """Totals of groups with and without unknown addends: status P always knows its input tokens."""
    totals = B.batch_totals(timings(spark, sf), ["o_orderpriority", "o_orderstatus"])
    # digits the addends have, so that the summation order cannot turn a rounding tie
    return totals.withColumns(
        {
            "total_wall_time_s": F.round("total_wall_time_s", 6),
            "total_call_latency_s": F.round("total_call_latency_s", 6),
            "total_cost": F.round("total_cost", 8),
        }
    )


@query("slowest_trials", f"WITH {_TIMING} SELECT trial_id, wall_time_s FROM timing ORDER BY wall_time_s DESC, trial_id LIMIT 5")
def slowest_trials(spark, sf):
    return B.slowest(timings(spark, sf).select("trial_id", "wall_time_s"), 5)
