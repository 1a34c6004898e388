"""Agreement queries: judged documents against the label table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.operators import answers as A
from trialsift.operators import decisions as D
from trialsift.operators import evaluate as E
from trialsift.plans import decisions as PD
from trialsift.plans.registry import query, sql_draw
from trialsift.sources import corpus

_DOC_WIDE = f"""raw AS (SELECT 'D'||doc_id AS trial_id, source AS outcome, lang, doc_id,
   CASE WHEN doc_id % 3 = 0 THEN 'adhering' ELSE 'assignment' END AS effect, {
    ", ".join(f"{PD._code(f"'D'||doc_id||'|{s}'")} AS {PD._q(s)}" for s in C.ALL_SQS)
} FROM documents)"""
_DOC_ROUTED = PD.ROUTED.replace(PD.RAW_WIDE, _DOC_WIDE)
_PRED = f"""{_DOC_ROUTED}, pred AS (SELECT doc_id, lang, outcome AS source, {
    ", ".join(f"{PD._J[d]} AS {d.lower()}" for d in C.DOMAINS)} FROM routed)"""


def _sql_gold(i: int) -> str:
    return f"""CASE WHEN toxic=1 AND {i}=1 THEN 'High' WHEN quality=1 AND {sql_draw(f"'gold'||doc_id||'D{i}'", 3)} > 0 THEN 'Low'
      ELSE ['Low','Some concerns','High'][{sql_draw(f"'gold'||doc_id||'D{i}'", 3)}+1] END"""


_GOLD = f"gold AS (SELECT doc_id, {', '.join(f'{_sql_gold(i)} AS g{i}' for i in range(1, 6))} FROM labels)"


def _norm(prefix: str) -> str:
    high = "+".join(f"CASE WHEN {prefix}{i}='High' THEN 1 ELSE 0 END" for i in range(1, 6))
    some = "+".join(f"CASE WHEN {prefix}{i}='Some concerns' THEN 1 ELSE 0 END" for i in range(1, 6))
    missing = " OR ".join(f"{prefix}{i} IS NULL" for i in range(1, 6))
    return f"CASE WHEN {missing} THEN NULL WHEN {high}>0 OR {some}>=3 THEN 'High' WHEN {some}>0 THEN 'Some concerns' ELSE 'Low' END"


CELLS = f"""{_PRED}, {_GOLD}, joined AS (SELECT * FROM gold JOIN pred USING (doc_id)),
 cells AS ({" UNION ALL ".join(f"SELECT 'D{i}' AS domain, lang, source, doc_id, g{i} AS gold, d{i} AS pred FROM joined" for i in range(1, 6))}
   UNION ALL SELECT 'overall', lang, source, doc_id, {_norm("g")}, {_norm("d")} FROM joined),
 clean AS (SELECT * FROM cells WHERE pred IS NOT NULL)"""


def _stats(source: str, group: str) -> str:
    return f"""agg AS (SELECT {group}, count(*) AS n, avg(CASE WHEN gold=pred THEN 1.0::DOUBLE ELSE 0 END) AS po FROM {source} GROUP BY ALL),
 gm AS (SELECT {group}, gold AS label, count(*) AS c FROM {source} GROUP BY ALL),
 pm AS (SELECT {group}, pred AS label, count(*) AS c FROM {source} GROUP BY ALL),
 lab AS (SELECT {group}, n, po, unnest(['Low','Some concerns','High']) AS label FROM agg),
 marg AS (SELECT lab.*, coalesce(gm.c,0)/n::DOUBLE AS pg, coalesce(pm.c,0)/n::DOUBLE AS pp FROM lab
   LEFT JOIN gm USING ({group}, label) LEFT JOIN pm USING ({group}, label)),
 ch AS (SELECT {group}, any_value(n) AS n, any_value(po) AS po, sum(pg*pp) AS pe, sum((pg+pp)/2*(1-(pg+pp)/2))/2 AS pc FROM marg GROUP BY ALL)"""


def predictions(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", "lang", "source")
    # answers are drawn wide: one row per document, no pivot and no shuffle
    wide = docs.selectExpr(
        "*",
        "IF(doc_id % 3 = 0, 'adhering', 'assignment') AS effect",
        *[f"""{corpus.code_sql(f"concat('D', doc_id, '|{s}')")} AS {D.col_of(s)}""" for s in C.ALL_SQS],
    )
    routed = D.route(wide)
    return routed.select(
        "doc_id", "lang", "source", *[D.domain_judgment(d) for d in C.DOMAINS]
    )


def gold(spark, sf):
    labels = corpus.table(spark, sf, "labels")

    def one(i):
        d = corpus.draw(F.concat(F.lit("gold"), F.col("doc_id"), F.lit(f"D{i}")), 3)
        code = F.element_at(F.array(F.lit("L"), F.lit("S"), F.lit("H")), d + 1)
        if i == 1:
            return F.when(F.col("toxic") == 1, "H").when((F.col("quality") == 1) & (d > 0), "L").otherwise(code)
        return F.when((F.col("quality") == 1) & (d > 0), "L").otherwise(code)

    return labels.select("doc_id", *[E.expand_label(one(i)).alias(f"g{i}") for i in range(1, 6)])


def _overall(prefix):
    renamed = [F.col(f"{prefix}{i}") for i in range(1, 6)]
    n = lambda label: sum((F.when(c == label, 1).otherwise(0) for c in renamed), F.lit(0))
    known = ~F.array_contains(F.array(*[c.isNull() for c in renamed]), True)
    return F.when(
        known,
        F.when((n("High") > 0) | (n("Some concerns") >= C.OVERALL_HIGH_SC_THRESHOLD), "High")
        .when(n("Some concerns") > 0, "Some concerns")
        .otherwise("Low"),
    )


def cells(spark, sf):
    joined = E.join_predictions(gold(spark, sf), predictions(spark, sf), ["doc_id"])
    entries = [
        F.struct(F.lit(f"D{i}").alias("domain"), F.col(f"g{i}").alias("gold"), F.col(f"d{i}").alias("pred"))
        for i in range(1, 6)
    ] + [F.struct(F.lit("overall").alias("domain"), _overall("g").alias("gold"), _overall("d").alias("pred"))]
    return joined.select("doc_id", "lang", "source", F.explode(F.array(*entries)).alias("c")).select(
        "doc_id", "lang", "source", "c.*"
    )


_CLOSE = lambda x: f"abs(1.0-{x}) <= 1e-9*greatest(1.0,abs({x}))"
_COEF = lambda x: f"CASE WHEN {_CLOSE(x)} THEN CASE WHEN {_CLOSE('po')} THEN 1.0::DOUBLE END ELSE (po-{x})/(1-{x}) END"


@query(
    "agreement_by_domain",
    f"WITH {CELLS}, {_stats('clean', 'domain')} SELECT domain, n, po AS percent_agreement, {_COEF('pe')} AS cohen_kappa, {_COEF('pc')} AS gwet_ac FROM ch",
)
def agreement_by_domain(spark, sf):
    return E.agreement_report(cells(spark, sf), ["domain"])


@query(
    "agreement_by_group",
    f"WITH {CELLS}, {_stats('clean', 'domain, lang')} SELECT domain, lang, n, po AS percent_agreement, {_COEF('pe')} AS cohen_kappa, {_COEF('pc')} AS gwet_ac FROM ch",
)
def agreement_by_group(spark, sf):
    return E.agreement_report(cells(spark, sf), ["domain", "lang"])


@query(
    "confusion_matrix",
    f"""WITH {CELLS}, l(label) AS (VALUES ('Low'),('Some concerns'),('High'))
     SELECT d.domain, a.label AS gold, b.label AS pred, count(c.doc_id) AS n_pairs
     FROM (SELECT DISTINCT domain FROM clean) d CROSS JOIN l a CROSS JOIN l b
     LEFT JOIN clean c ON c.domain=d.domain AND c.gold=a.label AND c.pred=b.label GROUP BY ALL""",
)
def confusion_matrix(spark, sf):
    return E.confusion_matrix(cells(spark, sf), ["domain"])


@query("missing_predictions", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)")
def missing_predictions(spark, sf):
    return E.missing_predictions(
        corpus.table(spark, sf, "labels"),
        corpus.table(spark, sf, "documents").select("doc_id").where(F.col("doc_id") % 11 != 0),
        ["doc_id"],
    )


_INTERVAL = """, v AS (SELECT domain, list_sort(list(po)) AS p, list_sort(list(g)) AS g FROM scored GROUP BY ALL)
 SELECT domain, p[round_even((len(p)-1)*0.025,0)::INT+1] AS percent_agreement_low, p[round_even((len(p)-1)*0.975,0)::INT+1] AS percent_agreement_high,
  g[round_even((len(g)-1)*0.025,0)::INT+1] AS gwet_ac_low, g[round_even((len(g)-1)*0.975,0)::INT+1] AS gwet_ac_high FROM v"""

_SCORED = f"""chance AS (SELECT domain, iter, n, po,
   (((r0+c0)/2*(1-(r0+c0)/2)) + ((r1+c1)/2*(1-(r1+c1)/2)) + ((r2+c2)/2*(1-(r2+c2)/2)))/2 AS pc FROM (
   SELECT domain, iter, sum(w) AS n, sum(CASE WHEN gold=pred THEN w ELSE 0 END)/sum(w)::DOUBLE AS po,
    {", ".join(f"sum(CASE WHEN gold='{l}' THEN w ELSE 0 END)/sum(w)::DOUBLE AS r{i}, sum(CASE WHEN pred='{l}' THEN w ELSE 0 END)/sum(w)::DOUBLE AS c{i}" for i, l in enumerate(C.JUDGMENTS))}
   FROM sampled GROUP BY ALL)),
 scored AS (SELECT domain, iter, po, {_COEF('pc')} AS g FROM chance)"""


def _count_draws_sql(iterations: int) -> str:
    """sampled: label-pair counts of each iteration, split off one class after the other by binomial quantiles."""
    pairs = [(a, b) for a in C.JUDGMENTS for b in C.JUDGMENTS]
    counts = ", ".join(f"count(*) FILTER (gold='{a}' AND pred='{b}') AS c{k}" for k, (a, b) in enumerate(pairs))
    parts = [
        f"counted AS (SELECT domain, count(*) AS rest, {counts} FROM clean GROUP BY domain)",
        f"d0 AS (SELECT *, i AS iter, rest AS rem FROM counted CROSS JOIN range({iterations}) r(i))",
    ]
    for k in range(len(pairs) - 1):
        p, u = f"(c{k}::DOUBLE/rest)", f"((('0x'||substr(md5(iter||'|'||domain||'|{k}'),1,8))::BIGINT + 0.5)/4294967296.0::DOUBLE)"
        mass = f"exp(lgamma(rem+1) - lgamma(j+1) - lgamma(rem-j+1) + j*ln({p}) + (rem-j)*ln(1-{p}))"
        fold = f"list_reduce(range(0, rem+1), lambda a, j: {{'c': a.c+{mass}, 'k': a.k+(a.c+{mass}<{u})::BIGINT}}, {{'c': 0::DOUBLE, 'k': 0::BIGINT}}).k"
        parts.append(f"e{k} AS (SELECT *, CASE WHEN rem=0 OR c{k}=0 THEN 0 WHEN c{k}=rest THEN rem ELSE least({fold}, rem) END AS w{k} FROM d{k})")
        parts.append(f"d{k + 1} AS (SELECT * REPLACE (rem-w{k} AS rem, rest-c{k} AS rest) FROM e{k})")
    last = len(pairs) - 1
    union = " UNION ALL ".join(
        f"SELECT domain, iter, '{a}' AS gold, '{b}' AS pred, {'rem' if k == last else f'w{k}'} AS w FROM d{last}" for k, (a, b) in enumerate(pairs)
    )
    return ", ".join([*parts, f"sampled AS ({union})"])


_ROWS_SQL = f"""WITH {CELLS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY
       list_position(['Low','Some concerns','High'], gold), list_position(['Low','Some concerns','High'], pred), doc_id)-1 AS pos,
       count(*) OVER (PARTITION BY domain) AS n FROM clean),
     draws AS (SELECT domain, i AS iter, ('0x'||substr(md5(i||'|'||doc_id),1,8))::BIGINT % n AS pos
       FROM numbered CROSS JOIN range(200) r(i)),
     sampled AS (SELECT d.domain, d.iter, x.gold, x.pred, 1 AS w FROM draws d JOIN numbered x USING (domain, pos)),
     {_SCORED} {_INTERVAL}"""


@query("bootstrap_ci", _ROWS_SQL)
def bootstrap_ci(spark, sf):
    """Interval from drawing every cell."""
    return E.bootstrap_interval(cells(spark, sf), ["domain"], "doc_id")


@query("bootstrap_ci_rows", _ROWS_SQL)
def bootstrap_ci_rows(spark, sf):
    return bootstrap_ci(spark, sf)


@query("bootstrap_ci_counts", f"WITH {CELLS}, {_count_draws_sql(C.BOOTSTRAP_ITERATIONS)}, {_SCORED} {_INTERVAL}")
def bootstrap_ci_counts(spark, sf):
    """An interval of the same distribution, from label counts split by binomial quantiles."""
    return E.count_bootstrap_interval(cells(spark, sf), ["domain"])


@query(
    "cluster_bootstrap",
    f"""WITH {CELLS}, sampled AS (SELECT domain, i AS iter, gold, pred,
       ({"+".join(f"CASE WHEN u>={cut} THEN 1 ELSE 0 END" for cut in E.POISSON_CUTS)}) AS w
       FROM (SELECT *, ('0x'||substr(md5('cluster|'||i||'|'||source),1,8))::BIGINT AS u FROM clean CROSS JOIN range(200) r(i))),
     {_SCORED} {_INTERVAL}""",
)
def cluster_bootstrap(spark, sf):
    return E.cluster_bootstrap_interval(cells(spark, sf), ["domain"], "source")


@query(
    "question_metrics",
    f"""WITH {PD._EVIDENCE}, x AS (SELECT 'D'||substr(sq_id,1,1) AS domain, answer, final_answer, error, flag, {PD._code("'gold'||seed")} AS gold_answer,
       {PD._code("'run2'||seed")} AS second_answer FROM done),
     y AS (SELECT *, CASE WHEN CASE WHEN final_answer IN ('Y','PY') THEN 1 WHEN final_answer IN ('N','PN') THEN 2 ELSE 3 END =
        CASE WHEN gold_answer IN ('Y','PY') THEN 1 WHEN gold_answer IN ('N','PN') THEN 2 ELSE 3 END THEN 1.0::DOUBLE ELSE 0 END AS hit FROM x)
     SELECT domain, count(*) AS n, avg(hit) AS collapsed_accuracy, avg(CASE WHEN error IS NULL THEN hit END) AS parsed_only_accuracy,
       avg(CASE WHEN final_answer='NI' AND error IS NULL AND answer='NI' THEN 1.0::DOUBLE ELSE 0 END) AS substantive_ni_rate,
       avg(CASE WHEN error IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS failure_ni_rate,
       avg(CASE WHEN answer=second_answer THEN 1.0::DOUBLE ELSE 0 END) AS run_consistency,
       avg(CASE WHEN flag='CONFIDENT' THEN hit END) AS accuracy_confident, avg(CASE WHEN flag='UNCERTAIN' THEN hit END) AS accuracy_uncertain,
       avg(CASE WHEN flag='FLAGGED' THEN hit END) AS accuracy_flagged
     FROM y GROUP BY ROLLUP(domain)""",
)
def question_metrics(spark, sf):
    finished = A.finalize(PD._evidence(spark, sf))
    seed = F.concat_ws("|", "trial_id", "outcome", "sq_id")
    return E.question_metrics(
        finished.select(
            F.concat(F.lit("D"), F.substring("sq_id", 1, 1)).alias("domain"),
            "answer",
            "final_answer",
            "error",
            "flag",
            corpus.code_of(F.concat(F.lit("gold"), seed)).alias("gold_answer"),
            corpus.code_of(F.concat(F.lit("run2"), seed)).alias("second_answer"),
        )
    )


_ARMS = [m for m in C.MODEL_PRICES if m[0] != "google/gemma-4-31b-it:free"]


def _arm_values() -> str:
    return ", ".join(f"({i}, '{m[0]}', '{m[1]}', '{C.MODEL_IDS[m[0]]}')" for i, m in enumerate(_ARMS))


@query(
    "arm_versions",
    f"""WITH arms(arm, model, provider, snapshot) AS (VALUES {_arm_values()}),
     p AS (SELECT {sql_draw("'arm'||o_orderkey", len(_ARMS))} AS arm FROM orders)
     SELECT model, '0.1.0+eval.'||substr(sha256('{{"aux_model": "'||model||'", "base_version": "0.1.0", "consort_enabled": false, "provider": "'
       ||provider||'", "retriever": "hybrid", "snapshot": "'||snapshot||'"}}'),1,12) AS pipeline_version, count(*) AS n_pairs
     FROM p JOIN arms USING (arm) GROUP BY ALL""",
)
def arm_versions(spark, sf):
    arms = spark.createDataFrame(
        [(i, m[0], m[1], C.MODEL_IDS[m[0]]) for i, m in enumerate(_ARMS)],
        "arm int, model string, provider string, snapshot string",
    )
    counted = (
        corpus.table(spark, sf, "orders")
        .select(corpus.draw(F.concat(F.lit("arm"), F.col("o_orderkey")), len(_ARMS)).alias("arm"))
        .groupBy("arm")
        .agg(F.count(F.lit(1)).alias("n_pairs"))
    )
    return counted.join(F.broadcast(arms), "arm").select(
        "model", E.pipeline_version("0.1.0", F.col("model"), F.col("provider"), F.col("snapshot")).alias("pipeline_version"), "n_pairs"
    )
