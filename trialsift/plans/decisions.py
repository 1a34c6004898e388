"""Routing, judgment, rollup and review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators import answers as A
from trialsift.operators import decisions as D
from trialsift.plans.registry import query, sql_draw
from trialsift.sources import corpus

KEY = D.PAIR_KEY

# ---- SQL side, written from the rule summaries rather than from the operator code

_CODES = "['Y','PY','PN','N','NI']"


def _code(seed: str) -> str:
    return f"{_CODES}[{sql_draw(seed, 5)}+1]"


def _q(sq: str) -> str:
    return "q" + sq.replace(".", "")


PAIRS = """pairs AS (
  SELECT 'T'||o_custkey AS trial_id, 'O'||o_orderkey AS outcome,
         CASE WHEN o_custkey % 3 = 0 THEN 'adhering' ELSE 'assignment' END AS effect FROM orders)"""

RAW_WIDE = f"""{PAIRS}, raw AS (SELECT trial_id, outcome, effect, {
    ", ".join(f"{_code(f"trial_id||'|'||outcome||'|{s}'")} AS {_q(s)}" for s in C.ALL_SQS)
} FROM pairs)"""

Y, N, YQ, NQ = "('Y','PY')", "('N','PN')", "('Y','PY','NI')", "('N','PN','NI')"

_ROUTE_STEPS = [
    (
        "r1",
        {
            "q23": f"CASE WHEN q21 IN {YQ} OR q22 IN {YQ} THEN q23 ELSE 'NA' END",
            "q32": f"CASE WHEN q31 IN {NQ} THEN q32 ELSE 'NA' END",
            "q43": f"CASE WHEN q41 IN {NQ} AND q42 IN {NQ} THEN q43 ELSE 'NA' END",
            "q52": f"CASE WHEN q51 IN {NQ} THEN q52 ELSE 'NA' END",
            "q53": f"CASE WHEN q51 IN {NQ} THEN q53 ELSE 'NA' END",
        },
    ),
    (
        "r2",
        {
            "q24": f"CASE WHEN effect='adhering' OR q23 IN {Y} THEN q24 ELSE 'NA' END",
            "q33": f"CASE WHEN q32 IN {N} THEN q33 ELSE 'NA' END",
            "q44": f"CASE WHEN q43 IN {YQ} THEN q44 ELSE 'NA' END",
        },
    ),
    (
        "r3",
        {
            "q25": f"CASE WHEN effect='adhering' OR q24 IN {YQ} THEN q25 ELSE 'NA' END",
            "q34": f"CASE WHEN q33 IN {YQ} THEN q34 ELSE 'NA' END",
            "q45": f"CASE WHEN q44 IN {YQ} THEN q45 ELSE 'NA' END",
        },
    ),
    (
        "r4",
        {
            "q26": f"CASE WHEN effect='assignment' OR q23 IN {NQ} OR q24 IN {YQ} OR q25 IN {YQ} THEN q26 ELSE 'NA' END",
        },
    ),
    ("routed", {"q27": f"CASE WHEN effect='assignment' AND q26 IN {NQ} THEN q27 ELSE 'NA' END"}),
]


def _routed() -> str:
    parts, previous = [RAW_WIDE], "raw"
    for name, changes in _ROUTE_STEPS:
        replaced = ", ".join(f"{expr} AS {col}" for col, expr in changes.items())
        parts.append(f"{name} AS (SELECT * REPLACE ({replaced}) FROM {previous})")
        previous = name
    return ", ".join(parts)


ROUTED = _routed()

_PART1 = f"""(CASE WHEN q21 IN {N} AND q22 IN {N} THEN 'Low' WHEN q23 IN {N} THEN 'Low' WHEN q23='NI' THEN 'Some concerns'
  WHEN q24 IN {N} THEN 'Some concerns' WHEN q25 IN {Y} THEN 'Some concerns' ELSE 'High' END)"""
_PART2 = f"""(CASE WHEN q26 IN {Y} THEN 'Low' WHEN q27 IN {N} THEN 'Some concerns' ELSE 'High' END)"""
_OK45 = f"(q24 IN {N} AND q25 IN {N})"
_CLEAN = f"((q21 IN {N} AND q22 IN {N}) OR q23 IN {Y})"

# (judgment, rationale) CASE pairs per domain
_SQL_TABLES = {
    "D1": (
        f"""CASE WHEN q12 IN {Y} THEN CASE WHEN q11 IN {N} THEN 'Some concerns' WHEN q13 IN {Y} THEN 'Some concerns' ELSE 'Low' END
        WHEN q12='NI' THEN CASE WHEN q13 IN {Y} THEN 'High' ELSE 'Some concerns' END ELSE 'High' END""",
        f"""CASE WHEN q12 IN {Y} THEN CASE WHEN q11 IN {N} THEN '1.2=Y/PY, 1.1=N/PN' WHEN q13 IN {Y} THEN '1.2=Y/PY, 1.3=Y/PY'
          ELSE '1.2=Y/PY, 1.1=Y/PY/NI, 1.3=N/PN/NI' END
        WHEN q12='NI' THEN CASE WHEN q13 IN {Y} THEN '1.2=NI, 1.3=Y/PY' ELSE '1.2=NI, 1.3=N/PN/NI' END ELSE '1.2=N/PN' END""",
    ),
    "D2 assignment": (
        f"CASE WHEN {_PART1}='Low' AND {_PART2}='Low' THEN 'Low' WHEN {_PART1}='High' OR {_PART2}='High' THEN 'High' ELSE 'Some concerns' END",
        f"'assignment: deviation component='||{_PART1}||', analysis component='||{_PART2}",
    ),
    "D2 adhering": (
        f"CASE WHEN {_CLEAN} AND {_OK45} THEN 'Low' WHEN q26 IN {Y} THEN 'Some concerns' ELSE 'High' END",
        f"""CASE WHEN {_CLEAN} AND {_OK45} AND q21 IN {N} AND q22 IN {N} THEN 'adhering: 2.1=N/PN, 2.2=N/PN, 2.4/2.5=N/PN/NA'
          WHEN {_CLEAN} AND {_OK45} THEN 'adhering: 2.3=Y/PY/NA, 2.4/2.5=N/PN/NA'
          WHEN {_CLEAN} THEN 'adhering: 2.4/2.5=Y/PY/NI, 2.6='||CASE WHEN q26 IN {Y} THEN 'Y/PY' ELSE 'N/PN/NI' END
          ELSE 'adhering: 2.3=N/PN/NI, 2.6='||CASE WHEN q26 IN {Y} THEN 'Y/PY' ELSE 'N/PN/NI' END END""",
    ),
    "D3": (
        f"""CASE WHEN q31 IN {Y} OR q32 IN {Y} OR q33 IN {N} THEN 'Low' WHEN q33='NA' THEN NULL
        WHEN q34 IN {N} THEN 'Some concerns' ELSE 'High' END""",
        f"""CASE WHEN q31 IN {Y} THEN '3.1=Y/PY' WHEN q32 IN {Y} THEN '3.1=N/PN/NI, 3.2=Y/PY' WHEN q33 IN {N} THEN '3.2=N/PN/NI, 3.3=N/PN'
        WHEN q33='NA' THEN NULL WHEN q34 IN {N} THEN '3.3=Y/PY/NI, 3.4=N/PN' ELSE '3.3=Y/PY/NI, 3.4=Y/PY/NI' END""",
    ),
    "D4": (
        f"""CASE WHEN q41 IN {Y} OR q42 IN {Y} THEN 'High'
        WHEN q42 IN {N} AND (q43 IN {N} OR q44 IN {N}) THEN 'Low'
        WHEN q43 IN {N} OR q44 IN {N} OR q45 IN {N} THEN 'Some concerns' ELSE 'High' END""",
        f"""CASE WHEN q41 IN {Y} OR q42 IN {Y} THEN '4.1=Y/PY or 4.2=Y/PY'
        WHEN q42 IN {N} THEN CASE WHEN q43 IN {N} THEN '4.1=N/PN/NI, 4.2=N/PN, 4.3=N/PN' WHEN q44 IN {N} THEN '4.3=Y/PY/NI, 4.4=N/PN'
           WHEN q45 IN {N} THEN '4.4=Y/PY/NI, 4.5=N/PN' ELSE '4.4=Y/PY/NI, 4.5=Y/PY/NI' END
        WHEN q43 IN {N} THEN '4.2=NI, 4.3=N/PN' WHEN q44 IN {N} THEN '4.2=NI, 4.4=N/PN' WHEN q45 IN {N} THEN '4.2=NI, 4.5=N/PN'
        ELSE '4.2=NI, 4.5=Y/PY/NI' END""",
    ),
    "D5": (
        f"""CASE WHEN q52='NA' THEN 'Low' WHEN q52 IN {Y} OR q53 IN {Y} THEN 'High' ELSE 'Some concerns' END""",
        f"""CASE WHEN q52='NA' THEN '5.1=Y/PY; 5.2/5.3 structurally NA' WHEN q52 IN {Y} OR q53 IN {Y} THEN '5.2=Y/PY or 5.3=Y/PY'
        WHEN q52 IN {N} AND q53 IN {N} THEN '5.2=N/PN, 5.3=N/PN, 5.1=N/PN/NI'
        ELSE '5.1/5.2/5.3 completed without Low or High pattern' END""",
    ),
}
_J = {name: t[0] for name, t in _SQL_TABLES.items()}
_R = {name: f"({t[1]})||' -> '||({t[0]})" for name, t in _SQL_TABLES.items()}
_J["D2"] = f"CASE WHEN effect='assignment' THEN {_J['D2 assignment']} ELSE {_J['D2 adhering']} END"
_R["D2"] = f"CASE WHEN effect='assignment' THEN {_R['D2 assignment']} ELSE {_R['D2 adhering']} END"

JUDGED = f"{ROUTED}, judged AS (" + " UNION ALL ".join(
    f"""SELECT trial_id, outcome, effect, '{d}' AS domain, '{"trial" if d == "D1" else "outcome"}' AS scope,
      {_J[d]} AS judgment, {_R[d]} AS rationale FROM routed"""
    for d in C.DOMAINS
) + ")"

_OVERALL_CASE = """CASE WHEN n_judged < 5 THEN NULL WHEN n_high > 0 THEN 'High' WHEN n_some = 0 THEN 'Low'
   WHEN n_some >= 3 THEN 'High' ELSE 'Some concerns' END"""
_OVERALL_WHY = """CASE WHEN n_judged < 5 THEN NULL WHEN n_high > 0 THEN '>=1 domain High -> High' WHEN n_some = 0 THEN 'all domains Low -> Low'
   WHEN n_some >= 3 THEN n_some||' domains Some concerns >= threshold 3 -> High'
   ELSE n_some||' domains Some concerns < threshold 3 -> Some concerns' END"""
ROLLED = f"""{JUDGED}, counted AS (SELECT trial_id, outcome, effect,
   count(*) FILTER (judgment='High') AS n_high, count(*) FILTER (judgment='Some concerns') AS n_some,
   count(judgment) AS n_judged FROM judged GROUP BY ALL),
 rolled AS (SELECT *, {_OVERALL_CASE} AS overall_judgment, {_OVERALL_WHY} AS overall_rationale,
   CASE WHEN n_judged = 5 THEN n_high = 0 AND n_some >= 2 END AS policy_review FROM counted)"""


def _raw_wide(spark, sf) -> DataFrame:
    return D.pivot_answers(corpus.raw_answers(spark, sf), KEY)


def _routed_df(spark, sf) -> DataFrame:
    return D.route(_raw_wide(spark, sf))


# ---- queries

@query(
    "route_answers",
    f"WITH {ROUTED} SELECT trial_id, outcome, effect, {', '.join(_q(s) for s in C.ALL_SQS)} FROM routed",
)
def route_answers(spark, sf):
    return _routed_df(spark, sf)


def _judge_one(domain: str, effect: str | None = None):
    def run(spark, sf):
        raw = corpus.raw_answers(spark, sf, C.DOMAIN_SQS[domain])
        if effect:
            raw = raw.where(F.col("effect") == effect)
        wide = D.pivot_answers(raw, KEY, C.DOMAIN_SQS[domain])
        # Questions of other domains do not take part: give the router empty columns.
        others = {D.col_of(s): F.lit(None).cast("string") for s in C.ALL_SQS if s not in C.DOMAIN_SQS[domain]}
        routed = D.route(wide.withColumns(others))
        verdict = D.domain_verdict(domain, effect)
        return routed.select(*KEY, verdict.alias("v")).select(
            *KEY, F.col("v.judgment").alias("judgment"), F.col("v.rationale").alias("rationale")
        )

    return run


for _name, _domain, _effect in (
    ("judge_d1", "D1", None),
    ("judge_d2_assignment", "D2", "assignment"),
    ("judge_d2_adhering", "D2", "adhering"),
    ("judge_d3", "D3", None),
    ("judge_d4", "D4", None),
    ("judge_d5", "D5", None),
):
    _table = f"{_domain} {_effect}" if _effect else _domain
    _where = f"WHERE effect='{_effect}'" if _effect else ""
    query(
        _name,
        f"WITH {ROUTED} SELECT trial_id, outcome, effect, {_J[_table]} AS judgment, {_R[_table]} AS rationale FROM routed {_where}",
    )(_judge_one(_domain, _effect))


@query(
    "domain_judgments",
    f"""WITH {JUDGED} SELECT *, CASE WHEN judgment IS NULL THEN domain||' answers do not reach a judgment' END AS error FROM judged""",
)
def domain_judgments(spark, sf):
    return D.judge(_routed_df(spark, sf))


@query(
    "na_answers",
    f"""WITH {ROUTED} SELECT trial_id, outcome, effect, 'D'||substr(sq_id,1,1) AS domain, sq_id, answer,
      '{C.NA_JUSTIFICATION}' AS justification FROM (
      {" UNION ALL ".join(f"SELECT trial_id, outcome, effect, '{s}' AS sq_id, {_q(s)} AS answer FROM routed" for s in C.ALL_SQS)}
      ) WHERE answer='NA'""",
)
def na_answers(spark, sf):
    return D.na_answers(_routed_df(spark, sf))


@query(
    "overall_rollup",
    f"WITH {ROLLED} SELECT trial_id, outcome, effect, n_high, n_some, n_judged, overall_judgment, overall_rationale, policy_review FROM rolled",
)
def overall_rollup(spark, sf):
    return D.rollup(D.judge(_routed_df(spark, sf)))


@query(
    "domain_pivot",
    f"""WITH {ROLLED} SELECT r.trial_id, r.outcome, r.effect,
     {", ".join(f"max(CASE WHEN j.domain='{d}' THEN j.judgment END) AS {d.lower()}" for d in C.DOMAINS)},
     any_value(overall_judgment) AS overall_judgment, any_value(overall_rationale) AS overall_rationale,
     any_value(policy_review) AS policy_review
     FROM rolled r JOIN judged j USING (trial_id, outcome, effect) GROUP BY ALL""",
)
def domain_pivot(spark, sf):
    return D.wide_judgments(D.judge(_routed_df(spark, sf)))


@query(
    "judgment_counts",
    f"""WITH {ROLLED} SELECT effect, coalesce(overall_judgment,'undefined') AS overall_judgment, count(*) AS n,
     count(*) FILTER (policy_review) AS n_policy_review FROM rolled GROUP BY ALL""",
)
def judgment_counts(spark, sf):
    """Flagship: answers -> route -> judge -> rollup -> counts."""
    routed = _routed_df(spark, sf)
    verdicts = routed.select(*KEY, *[D.domain_judgment(d) for d in C.DOMAINS])
    return (
        D.with_overall(verdicts)
        .groupBy("effect", F.coalesce("overall_judgment", F.lit("undefined")).alias("overall_judgment"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("policy_review").alias("n_policy_review"))
    )


def _hidden(seed: str) -> str:
    return f"{sql_draw(seed, 3)} = 0"


_PARTIAL = f"""{PAIRS}, raw AS (SELECT trial_id, outcome, effect, {
    ", ".join(
        f"CASE WHEN {_hidden(f"'hide'||trial_id||'|'||outcome||'|{s}'")} THEN NULL ELSE "
        f"{_code(f"trial_id||'|'||outcome||'|{s}'")} END AS {_q(s)}"
        for s in C.ALL_SQS
    )
} FROM pairs)"""

# SQL twin of the frontier: g = gate (1 ask, 0 not applicable, NULL open)
_FRONT_STEPS = [
    {
        "23": f"CASE WHEN q21 IN {YQ} OR q22 IN {YQ} THEN 1 WHEN q21 IN {N} AND q22 IN {N} THEN 0 END",
        "32": f"CASE WHEN q31 IN {NQ} THEN 1 WHEN q31 IS NOT NULL THEN 0 END",
        "43": f"CASE WHEN q41 IS NULL OR q42 IS NULL THEN NULL WHEN q41 IN {NQ} AND q42 IN {NQ} THEN 1 ELSE 0 END",
        "52": f"CASE WHEN q51 IN {NQ} THEN 1 WHEN q51 IS NOT NULL THEN 0 END",
        "53": f"CASE WHEN q51 IN {NQ} THEN 1 WHEN q51 IS NOT NULL THEN 0 END",
    },
    {
        "24": f"CASE WHEN effect='adhering' THEN 1 WHEN q23 IN {Y} THEN 1 WHEN q23 IS NOT NULL THEN 0 END",
        "33": f"CASE WHEN q32 IN {N} THEN 1 WHEN q32 IS NOT NULL THEN 0 END",
        "44": f"CASE WHEN q43 IN {YQ} THEN 1 WHEN q43 IS NOT NULL THEN 0 END",
    },
    {
        "25": f"CASE WHEN effect='adhering' THEN 1 WHEN q24 IN {YQ} THEN 1 WHEN q24 IS NOT NULL THEN 0 END",
        "34": f"CASE WHEN q33 IN {YQ} THEN 1 WHEN q33 IS NOT NULL THEN 0 END",
        "45": f"CASE WHEN q44 IN {YQ} THEN 1 WHEN q44 IS NOT NULL THEN 0 END",
    },
    {
        "26": f"""CASE WHEN effect='assignment' THEN 1 WHEN q23 IN {NQ} OR q24 IN {YQ} OR q25 IN {YQ} THEN 1
          WHEN q23 IS NULL OR q24 IS NULL OR q25 IS NULL THEN NULL ELSE 0 END""",
    },
    {"27": f"CASE WHEN effect='adhering' THEN 0 WHEN q26 IN {NQ} THEN 1 WHEN q26 IS NOT NULL THEN 0 END"},
]


def _frontier_sql() -> str:
    raw_copy = ", ".join(f"q{_q(s)[1:]} AS raw{_q(s)[1:]}" for s in C.ALL_SQS)
    always = ["11", "12", "13", "21", "22", "31", "41", "42", "51"]
    parts = [_PARTIAL, f"f0 AS (SELECT *, {raw_copy}, {', '.join(f'1 AS g{s}' for s in always)} FROM raw)"]
    for i, step in enumerate(_FRONT_STEPS):
        parts.append(f"g{i} AS (SELECT *, {', '.join(f'{e} AS g{s}' for s, e in step.items())} FROM f{i})")
        rep = ", ".join(f"CASE WHEN g{s}=1 THEN q{s} WHEN g{s}=0 THEN 'NA' END AS q{s}" for s in step)
        parts.append(f"f{i + 1} AS (SELECT * REPLACE ({rep}) FROM g{i})")
    ask = ", ".join(f"CASE WHEN g{_q(s)[1:]}=1 AND raw{_q(s)[1:]} IS NULL THEN '{s}' END" for s in C.ALL_SQS)
    na = ", ".join(f"CASE WHEN g{_q(s)[1:]}=0 THEN '{s}' END" for s in C.ALL_SQS)
    return (
        f"WITH {', '.join(parts)} SELECT trial_id, outcome, effect, concat_ws(',', {ask}) AS ask_now, "
        f"concat_ws(',', {na}) AS not_applicable FROM f{len(_FRONT_STEPS)}"
    )


@query("wave_frontier", _frontier_sql())
def wave_frontier(spark, sf):
    raw = corpus.raw_answers(spark, sf)
    seed = F.concat(F.lit("hide"), F.concat_ws("|", "trial_id", "outcome", "sq_id"))
    partial = raw.withColumn("answer", F.when(corpus.draw(seed, 3) != 0, F.col("answer")))
    return D.wave_frontier(D.pivot_answers(partial, KEY))


@query(
    "d1_shared_across_outcomes",
    f"""WITH {ROUTED}, t1 AS (SELECT 'T'||c_custkey AS trial_id, CASE WHEN c_custkey % 3 = 0 THEN 'adhering' ELSE 'assignment' END AS effect,
       {_code("'T'||c_custkey||'|1.1'")} AS q11, {_code("'T'||c_custkey||'|1.2'")} AS q12, {_code("'T'||c_custkey||'|1.3'")} AS q13 FROM customer),
     d1 AS (SELECT trial_id, effect, {_J["D1"]} AS d1 FROM t1),
     dd AS (SELECT r.trial_id, r.outcome, r.effect, d1.d1, {", ".join(f"{_J[d]} AS {d.lower()}" for d in C.DOMAINS[1:])}
       FROM routed r LEFT JOIN d1 USING (trial_id, effect)),
     counted AS (SELECT *, {"+".join(f"CASE WHEN d{i}='High' THEN 1 ELSE 0 END" for i in range(1, 6))} AS n_high,
       {"+".join(f"CASE WHEN d{i}='Some concerns' THEN 1 ELSE 0 END" for i in range(1, 6))} AS n_some,
       {"+".join(f"CASE WHEN d{i} IS NULL THEN 0 ELSE 1 END" for i in range(1, 6))} AS n_judged FROM dd)
     SELECT trial_id, outcome, effect, d1, d2, d3, d4, d5, {_OVERALL_CASE} AS overall_judgment, {_OVERALL_WHY} AS overall_rationale,
       CASE WHEN n_judged = 5 THEN n_high = 0 AND n_some >= 2 END AS policy_review FROM counted""",
)
def d1_shared_across_outcomes(spark, sf):
    d1_wide = D.pivot_answers(corpus.trial_answers(spark, sf), ["trial_id", "effect"], C.DOMAIN_SQS["D1"])
    d1 = d1_wide.select("trial_id", "effect", D.domain_judgment("D1"))
    outcome_sqs = [s for s in C.ALL_SQS if not s.startswith("1.")]
    wide = D.pivot_answers(corpus.raw_answers(spark, sf, outcome_sqs), KEY, outcome_sqs)
    wide = wide.withColumns({D.col_of(s): F.lit(None).cast("string") for s in C.DOMAIN_SQS["D1"]})
    per_outcome = D.route(wide).select(
        *KEY, *[D.domain_judgment(d) for d in C.DOMAINS[1:]]
    )
    joined = D.share_trial_domain(per_outcome, d1)
    return D.with_overall(joined).select(
        *KEY, "d1", "d2", "d3", "d4", "d5", "overall_judgment", "overall_rationale", "policy_review"
    )


_EVIDENCE = f"""{PAIRS}, sq(sq_id) AS (VALUES {", ".join(f"('{s}')" for s in C.ALL_SQS)}),
 base AS (SELECT trial_id, outcome, effect, sq_id, trial_id||'|'||outcome||'|'||sq_id AS seed FROM pairs CROSS JOIN sq),
 ev AS (SELECT *, {_code("seed")} AS answer,
   CASE WHEN {sql_draw("'e'||seed", 53)} = 0 THEN 'TimeoutError: request timed out' END AS error,
   {sql_draw("'v'||seed", 10)} < 8 AS quote_found, {sql_draw("'a'||seed", 4)}::INT AS segments_available,
   CASE WHEN {sql_draw("'d'||seed", 3)} > 0 THEN {sql_draw("'r'||seed", 100)} / 100.0::DOUBLE END AS retrieval_top_score FROM base),
 fin AS (SELECT *, CASE WHEN error IS NOT NULL OR answer='NI' THEN true ELSE quote_found END AS quote_verified FROM ev),
 flagged AS (SELECT *, CASE WHEN error IS NOT NULL OR NOT quote_verified THEN 'NI' ELSE answer END AS final_answer,
   coalesce(retrieval_top_score < 0.35, false) AS weak FROM fin),
 done AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'FLAGGED' WHEN answer<>'NI' AND NOT quote_verified THEN 'FLAGGED'
     WHEN answer='NI' AND segments_available>0 AND weak THEN 'FLAGGED' WHEN weak THEN 'UNCERTAIN'
     WHEN answer='NI' AND segments_available=0 THEN 'UNCERTAIN' ELSE 'CONFIDENT' END AS flag,
   CASE WHEN error IS NOT NULL THEN 'signaling-question call failed: '||error
     WHEN answer<>'NI' AND NOT quote_verified THEN 'supporting quote could not be verified in the source text'
     WHEN answer='NI' AND segments_available>0 AND weak THEN 'answer is NI despite available supplements and a weak best retrieved passage'
     WHEN weak THEN 'best retrieved passage is below the relevance threshold'
     WHEN answer='NI' AND segments_available=0 THEN 'answer is NI with no domain-relevant supplementary material available' END AS flag_reason
   FROM flagged)"""


def _evidence(spark, sf) -> DataFrame:
    return (
        corpus.answer_evidence(spark, sf)
        .withColumn("quote", F.lit(""))
        .withColumn("page", F.lit(None).cast("int"))
        .withColumn("justification", F.lit(""))
    )


@query(
    "confidence_flags",
    f"WITH {_EVIDENCE} SELECT trial_id, outcome, effect, sq_id, answer, final_answer, quote_verified, flag, flag_reason FROM done",
)
def confidence_flags(spark, sf):
    return A.finalize(_evidence(spark, sf)).select(
        *KEY, "sq_id", "answer", "final_answer", "quote_verified", "flag", "flag_reason"
    )


@query(
    "answer_degradations",
    f"""WITH {_EVIDENCE} SELECT trial_id, outcome, effect, 'D'||substr(sq_id,1,1) AS domain, sq_id,
      CASE WHEN error IS NOT NULL THEN 'sq_call_failed_to_ni' ELSE 'quote_downgraded_to_ni' END AS category,
      CASE WHEN error IS NOT NULL THEN 'error' ELSE 'warning' END AS severity,
      CASE WHEN error IS NOT NULL THEN 'signaling-question call failed: '||error ELSE 'supporting quote could not be verified in the source text' END AS reason,
      CASE WHEN error IS NULL THEN answer END AS raw_answer, final_answer
      FROM done WHERE error IS NOT NULL OR (answer<>'NI' AND NOT quote_verified)""",
)
def answer_degradations(spark, sf):
    return A.degradations(A.finalize(_evidence(spark, sf)), KEY)


_FINAL_WIDE = f"""{_EVIDENCE}, raw AS (SELECT trial_id, outcome, effect,
   {", ".join(f"max(CASE WHEN sq_id='{s}' THEN final_answer END) AS {_q(s)}" for s in C.ALL_SQS)} FROM done GROUP BY ALL)"""


def _with_routed(prefix: str) -> str:
    return ROLLED.replace(RAW_WIDE, prefix)


@query(
    "human_review_basis",
    f"""WITH {_with_routed(_FINAL_WIDE)}, answered AS (
      {" UNION ALL ".join(f"SELECT trial_id, outcome, effect, '{s}' AS sq_id FROM routed WHERE {_q(s)} <> 'NA'" for s in C.ALL_SQS)}),
     lists AS (SELECT trial_id, outcome, effect,
       string_agg(CASE WHEN flag='FLAGGED' THEN 'D'||substr(sq_id,1,1)||' '||sq_id END, ', ' ORDER BY sq_id) AS f,
       string_agg(CASE WHEN flag='UNCERTAIN' THEN 'D'||substr(sq_id,1,1)||' '||sq_id END, ', ' ORDER BY sq_id) AS u,
       string_agg(CASE WHEN NOT quote_verified THEN 'D'||substr(sq_id,1,1)||' '||sq_id END, ', ' ORDER BY sq_id) AS v
       FROM done JOIN answered USING (trial_id, outcome, effect, sq_id) GROUP BY ALL),
     basis AS (SELECT trial_id, outcome, effect, nullif(concat_ws('; ', 'flagged SQ answer(s): '||f, 'uncertain SQ answer(s): '||u,
       'unverified quote(s): '||v), '') AS reliability_basis FROM lists)
     SELECT r.trial_id, r.outcome, r.effect, overall_judgment, overall_rationale,
       coalesce(policy_review,false) OR reliability_basis IS NOT NULL AS requires_human_review,
       CASE WHEN coalesce(policy_review,false) OR reliability_basis IS NOT NULL THEN
         concat_ws('; ', CASE WHEN policy_review THEN overall_rationale END, reliability_basis) END AS review_basis
     FROM rolled r LEFT JOIN basis b USING (trial_id, outcome, effect)""",
)
def human_review_basis(spark, sf):
    return _reviewed(spark, sf)


def _reviewed(spark, sf) -> DataFrame:
    return D.reviewed(A.finalize(_evidence(spark, sf)), KEY)


_OVERALL_AUDIT = "'judgment.overall.completed' AS event_type"


@query(
    "domain_audit_events",
    f"""WITH {JUDGED} SELECT j.trial_id, j.outcome, j.effect, 'judgment.domain.completed' AS event_type,
      CASE WHEN judgment IS NULL THEN 'failed' ELSE 'completed' END AS status, domain,
      CASE domain {" ".join(
        "WHEN '" + d + "' THEN '{'||" + "||','||".join("'\"" + s + "\":\"'||" + _q(s) + "||'\"'" for s in C.DOMAIN_SQS[d]) + "||'}'"
        for d in C.DOMAINS)} END AS input_sq_answers,
      judgment AS output_judgment, rationale AS algorithm_rationale
      FROM judged j JOIN routed r USING (trial_id, outcome, effect)""",
)
def domain_audit_events(spark, sf):
    return D.judgment_audit(_routed_df(spark, sf))


def _dropped(seed: str) -> str:
    return f"{sql_draw(seed, 40)} = 0"


@query(
    "fanin_missing",
    f"""WITH {PAIRS}, sq(sq_id) AS (VALUES {", ".join(f"('{s}')" for s in C.ALL_SQS)}),
     m AS (SELECT trial_id, outcome, effect, 'D'||substr(sq_id,1,1) AS domain, sq_id FROM pairs CROSS JOIN sq
       WHERE {_dropped("'lost'||trial_id||'|'||outcome||'|'||sq_id")})
     SELECT trial_id, outcome, effect, domain, domain||' missing expected SQ answer(s): '||string_agg(sq_id, ', ' ORDER BY sq_id) AS error
     FROM m GROUP BY trial_id, outcome, effect, domain""",
)
def fanin_missing(spark, sf):
    raw = corpus.raw_answers(spark, sf)
    seed = F.concat(F.lit("lost"), F.concat_ws("|", "trial_id", "outcome", "sq_id"))
    return D.missing_answers(raw.where(corpus.draw(seed, 40) != 0))


@query(
    "answer_conflicts",
    f"""WITH base AS (SELECT 'T'||o_custkey AS trial_id, o_orderpriority AS outcome, sq_id, {_code("o_orderkey||'|'||sq_id")} AS answer
       FROM orders CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in C.ALL_SQS)}) s(sq_id))
     SELECT trial_id, outcome, sq_id, min(answer) AS first_answer, max(answer) AS last_answer, count(*) AS n_rows
     FROM base GROUP BY ALL HAVING min(answer) <> max(answer)""",
)
def answer_conflicts(spark, sf):
    orders = corpus.table(spark, sf, "orders").select(
        F.concat(F.lit("T"), F.col("o_custkey")).alias("trial_id"),
        F.col("o_orderpriority").alias("outcome"),
        F.col("o_orderkey"),
        F.explode(F.array(*[F.lit(s) for s in C.ALL_SQS])).alias("sq_id"),
    )
    raw = orders.withColumn("answer", corpus.code_of(F.concat_ws("|", "o_orderkey", "sq_id")))
    return D.answer_conflicts(raw, ["trial_id", "outcome"])


@query(
    "raw_answer_quarantine",
    f"""SELECT coalesce(quarantine_reason,'accepted') AS verdict, count(*) AS n, sum(length(quote))::BIGINT AS quote_chars FROM (
      SELECT quote, nullif(concat_ws('; ', CASE WHEN answer NOT IN ('Y','PY','PN','N','NI') THEN 'answer code not allowed' END,
        CASE WHEN length(quote) > 4000 THEN 'quote too long' END, CASE WHEN length(justification) > 1000 THEN 'justification too long' END), '') AS quarantine_reason
      FROM (SELECT text AS quote, left(text, n_chars - n_chars//2) AS justification, ['Y','PY','PN','N','NI','NA','yes'][{sql_draw("'code'||doc_id", 7)}+1] AS answer FROM documents))
     GROUP BY ALL""",
)
def raw_answer_quarantine(spark, sf):
    docs = corpus.table(spark, sf, "documents")
    codes = F.array(*[F.lit(c) for c in (*C.RAW_CODES, "NA", "yes")])
    supplied = docs.select(
        F.col("text").alias("quote"),
        F.expr("left(text, n_chars - n_chars div 2)").alias("justification"),
        F.element_at(codes, corpus.draw(F.concat(F.lit("code"), F.col("doc_id")), 7) + 1).alias("answer"),
    )
    return (
        A.quarantine(supplied)
        .groupBy(F.coalesce("quarantine_reason", F.lit("accepted")).alias("verdict"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("quote")).alias("quote_chars"))
    )
