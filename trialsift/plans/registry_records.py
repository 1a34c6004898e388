"""Registry, eligibility and metadata queries: one record per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import payload as P
from trialsift.operators import registry as R
from trialsift.plans.registry import query, sql_draw, sql_list
from trialsift.sources import corpus

KINDS = ("INTERVENTIONAL", "Interventional", "OBSERVATIONAL", "INTERVENTIONAL")
ALLOC = ("RANDOMIZED", "NON_RANDOMIZED", "", "randomized")
MODELS = ("PARALLEL", "single-group", "CROSSOVER", "FACTORIAL", "Parallel Assignment")
COUNTS = ("120", '"96"', "null", "48.5")
DESIGNS = ("parallel_rct", "cluster_rct", "crossover_rct", "single_arm", "non_rct", "unclear")


def _body(pick) -> str:
    """JSON text of a registry record as a concat expression over customer columns."""
    parts = [
        "'{\"protocolSection\":{\"designModule\":{\"studyType\":\"'", pick("k", KINDS), "'\",\"designInfo\":{\"allocation\":\"'", pick("a", ALLOC),
        "'\",\"interventionModel\":\"'", pick("m", MODELS), "'\",\"maskingInfo\":{\"masking\":\"DOUBLE\"}},\"enrollmentInfo\":{\"count\":'", pick("c", COUNTS),
        "'}},\"outcomesModule\":{\"primaryOutcomes\":[{\"measure\":\" Overall survival in '", "c_mktsegment", "' \",\"timeFrame\":\"'", "c_nationkey",
        "' months\"}],\"secondaryOutcomes\":[{\"measure\":\" \"},{\"measure\":\"Time to event '", "c_nationkey",
        "'\"}]},\"armsInterventionsModule\":{\"armGroups\":[{\"label\":\"Drug\"},{},{\"label\":\"Placebo\"}]}}}'",
    ]
    return parts


def _pick_sql(tag, values):
    return f"{sql_list(values)}[{sql_draw(f"'{tag}'||c_custkey", len(values))}+1]"


def _pick_spark(tag, values):
    listed = ", ".join("'" + v + "'" for v in values)
    return (
        f"array({listed})[CAST(CAST(conv(substring(md5(concat('{tag}', c_custkey)), 1, 8), 16, 10) AS BIGINT) % {len(values)} AS INT)]"
    )


_REG = f"""reg AS (SELECT c_custkey, 'NCT'||lpad(c_custkey::VARCHAR,8,'0') AS nct, c_mktsegment, c_nationkey, c_custkey%13=0 AS broken, {_pick_sql("k", KINDS)} AS kind, {_pick_sql("a", ALLOC)} AS alloc,
   {_pick_sql("m", MODELS)} AS model, {_pick_sql("c", COUNTS)} AS cnt, {_pick_sql("d", DESIGNS)} AS study_design, CASE WHEN c_custkey%2=0 THEN 'stated in the methods' END AS stated FROM customer),
 des AS (SELECT *, CASE WHEN broken THEN NULL WHEN kind='OBSERVATIONAL' THEN 'non_rct' WHEN model='single-group' THEN 'single_arm' WHEN model='CROSSOVER' THEN 'crossover_rct'
    WHEN upper(alloc) LIKE '%RANDOM%' AND upper(model) LIKE '%PARALLEL%' THEN 'parallel_rct' END AS rdesign FROM reg),
 des2 AS (SELECT *, CASE rdesign WHEN 'non_rct' THEN 'ClinicalTrials.gov studyType is OBSERVATIONAL.' WHEN 'single_arm' THEN 'ClinicalTrials.gov interventionModel is SINGLE_GROUP.'
    WHEN 'crossover_rct' THEN 'ClinicalTrials.gov interventionModel is CROSSOVER.' WHEN 'parallel_rct' THEN 'ClinicalTrials.gov reports studyType=INTERVENTIONAL, allocation=RANDOMIZED, interventionModel=PARALLEL.' END AS rbasis FROM des)"""


def registry(spark, sf):
    body = "concat(" + ", ".join(_body(_pick_spark)) + ")"
    return corpus.table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "concat('NCT', lpad(c_custkey, 8, '0')) AS nct",
        f"IF(c_custkey % 13 = 0, '{{\"protocolSection\": ', {body}) AS body",
    )


def records(spark, sf):
    return R.parse_records(registry(spark, sf))


@query("registry_design", "WITH " + _REG + " SELECT nct, rdesign AS design, rbasis AS basis, rdesign='parallel_rct' AS in_scope FROM des2")
def registry_design(spark, sf):
    return records(spark, sf).select("nct", R.registry_design().alias("d")).select("nct", "d.design", "d.basis", "d.in_scope")


def trials(spark, sf):
    meta = corpus.table(spark, sf, "customer").selectExpr(
        "concat('NCT', lpad(c_custkey, 8, '0')) AS nct",
        f"{_pick_spark('d', DESIGNS)} AS study_design",
        "IF(c_custkey % 2 = 0, 'stated in the methods', NULL) AS study_design_basis",
    )
    return meta.join(records(spark, sf), "nct", "left")


@query(
    "eligibility",
    f"""WITH {_REG} SELECT nct, coalesce(rdesign='parallel_rct', study_design IN ('parallel_rct','unclear')) AS eligible,
      coalesce(rbasis, CASE WHEN study_design='parallel_rct' THEN coalesce(stated,'LLM metadata classified the study as a parallel-group RCT.')
       WHEN study_design<>'unclear' THEN coalesce(stated,'positive metadata evidence indicates an out-of-scope design.')
       ELSE 'eligibility ambiguous; proceeding with human-review flag instead of skipping on uncertainty' END) AS study_design_basis,
      coalesce(rdesign, study_design) AS study_design, rdesign IS NULL AND study_design='unclear' AS needs_review FROM des2""",
)
def eligibility(spark, sf):
    return R.reconcile(R.decide_eligibility(trials(spark, sf))).select(
        "nct", "eligible", "study_design", "study_design_basis", "needs_review"
    )


@query(
    "registered_outcomes",
    f"""WITH {_REG} SELECT nct, 0 AS ordinal, trim('Overall survival in '||c_mktsegment) AS measure, true AS is_primary FROM reg WHERE NOT broken
     UNION ALL SELECT nct, 1, 'Time to event '||c_nationkey, false FROM reg WHERE NOT broken""",
)
def registered_outcomes(spark, sf):
    return R.registered_outcomes(records(spark, sf))


_BLOCK_SQL = """concat_ws(chr(10), '[ClinicalTrials.gov]', 'Allocation: '||nullif(alloc,''), 'Masking: DOUBLE', CASE WHEN cnt='120' THEN 'Enrollment count: 120' END,
      'Primary outcomes:  Overall survival in '||c_mktsegment||'  ('||c_nationkey||' months)', 'Secondary outcomes:  ', 'Secondary outcomes: Time to event '||c_nationkey, 'Arms: Drug; Placebo')"""


@query("registry_blocks", f"WITH {_REG} SELECT nct, CASE WHEN broken THEN '' ELSE {_BLOCK_SQL} END AS block FROM reg")
def registry_blocks(spark, sf):
    return records(spark, sf).select("nct", R.registry_block().alias("block"))


@query("outcome_best_match")
def outcome_best_match(spark, sf):
    """Registered match of every assessed outcome; the score has no SQL form."""
    assessed = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "concat('NCT', lpad(o_custkey, 8, '0')) AS nct",
        """CASE o_orderkey % 3 WHEN 0 THEN concat('Overall survival in ', lower(substring(o_orderpriority, 3)))
           WHEN 1 THEN concat('Time to event ', o_custkey % 25) ELSE 'Adverse events' END AS outcome""",
    )
    return R.match_outcomes(assessed, records(spark, sf))


_VARIANTS = "[upper(o_orderpriority), ' Time  to event ', '', 'time to EVENT', o_orderstatus, 'Adverse events', o_orderstatus||'  x']"


@query(
    "outcome_list_normalise",
    f"""WITH l AS (SELECT o_orderkey, unnest(list_concat(['  '||o_orderpriority], {_VARIANTS})) AS x, generate_subscripts(list_concat(['  '||o_orderpriority], {_VARIANTS}),1) AS i FROM orders),
     c AS (SELECT o_orderkey, trim(regexp_replace(x,'\\s+',' ','g')) AS x, i FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, lower(x) ORDER BY i) AS rn FROM c WHERE x<>'')
     SELECT o_orderkey, string_agg(x,'|' ORDER BY i) AS outcomes FROM f WHERE rn=1 GROUP BY ALL""",
)
def outcome_list_normalise(spark, sf):
    orders = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "concat('  ', o_orderpriority) AS primary",
        "array(upper(o_orderpriority), ' Time  to event ', '', 'time to EVENT', o_orderstatus, 'Adverse events', concat(o_orderstatus, '  x')) AS others",
    )
    return orders.select(
        "o_orderkey", F.array_join(R.normalize_outcomes(F.col("primary"), F.col("others")), "|").alias("outcomes")
    )


@query(
    "trial_id_precedence",
    """WITH x AS (SELECT doc_id, text, string_split(text,chr(10))[1] AS label, CASE doc_id%4 WHEN 0 THEN 'see nct'||lpad(doc_id::VARCHAR,8,'0') END AS cfg, CASE doc_id%4 WHEN 1 THEN 'NCT'||lpad(doc_id::VARCHAR,8,'0') END AS hint FROM documents),
     y AS (SELECT *, coalesce(upper(nullif(regexp_extract(cfg,'(?i)\\bNCT\\d{8}\\b'),'')), upper(nullif(regexp_extract(hint,'(?i)\\bNCT\\d{8}\\b'),''))) AS nct FROM x)
     SELECT doc_id, coalesce(nct, nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(label),'[^\\x00-\\x7F]','','g')),'[^a-z0-9]+','-','g'),'-'),''), substr(sha256(text),1,12)) AS trial_id FROM y""",
)
def trial_id_precedence(spark, sf):
    docs = corpus.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "text",
        "split(text, '\n')[0] AS label",
        "IF(doc_id % 4 = 0, concat('see nct', lpad(doc_id, 8, '0')), NULL) AS cfg",
        "IF(doc_id % 4 = 1, concat('NCT', lpad(doc_id, 8, '0')), NULL) AS hint",
        "CAST(NULL AS STRING) AS extracted",
    )
    with_nct = docs.withColumn("nct", R.choose_nct(F.col("cfg"), F.col("hint"), F.col("extracted")))
    return R.trial_ids(with_nct, "nct", "label", "text").select("doc_id", "trial_id")


@query(
    "assessed_outcomes",
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN ['M1','M2'] WHEN 1 THEN ['P'||o_custkey, o_orderstatus] ELSE [o_orderpriority] END AS l FROM orders)
     SELECT o_orderkey, unnest(l) AS outcome FROM x""",
)
def assessed_outcomes(spark, sf):
    orders = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "IF(o_orderkey % 3 = 0, array('M1', 'M2'), NULL) AS manifest",
        "IF(o_orderkey % 3 = 1, array(concat('P', o_custkey), o_orderstatus), array()) AS metadata",
        "o_orderpriority AS primary",
    )
    return orders.select(
        "o_orderkey", R.assessed_outcomes(F.col("manifest"), F.col("metadata"), F.col("primary")).alias("outcome")
    )


# ---- model responses

def responses(spark, sf):
    """Conversation turns wrapped the way model answers arrive: bare, fenced, in prose, broken."""
    return corpus.table(spark, sf, "conversations").selectExpr(
        "conv_id",
        "turn",
        "text",
        """IF(turn % 2 = 0, to_json(named_struct('answer', 'PY', 'quoted_text', text, 'reasoning', array(role, ' ', 'stated'))),
             to_json(named_struct('answer', 'N', 'quote', text, 'rationale', role))) AS body""",
    ).selectExpr(
        "conv_id",
        "turn",
        """CASE (conv_id + turn) % 5 WHEN 0 THEN body WHEN 1 THEN concat('```json\n', body, '\n```') WHEN 2 THEN concat('Here it is: ', body, ' done')
           WHEN 3 THEN substring(body, 1, length(body) - 1) ELSE text END AS response""",
    )


@query(
    "response_json_recovery",
    """WITH r AS (SELECT conv_id, turn, (CASE WHEN turn%2=0 THEN json_object('answer','PY','quoted_text',text,'reasoning',json_array(role,' ','stated'))
       ELSE json_object('answer','N','quote',text,'rationale',role) END)::VARCHAR AS body, (conv_id+turn)%5 AS kind FROM conversations)
     SELECT conv_id, turn, CASE WHEN kind<3 THEN body END AS payload, CASE kind WHEN 0 THEN 'raw' WHEN 1 THEN 'fence' WHEN 2 THEN 'balanced' END AS step,
       CASE WHEN kind>=3 THEN 'no JSON object found' END AS error FROM r""",
)
def response_json_recovery(spark, sf):
    """Recovered JSON object per response with the step that found it."""
    return responses(spark, sf).select("conv_id", "turn", P.recover_json(F.col("response")).alias("r")).select(
        "conv_id", "turn", "r.payload", "r.step", "r.error"
    )


@query(
    "answer_alias_folding",
    """SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'PY' ELSE 'N' END AS answer, md5(CASE WHEN turn%2=0 THEN text ELSE '['||conv_id||'] '||text END) AS quote_md5, CASE WHEN turn%2=0 THEN role||chr(10)||'stated' ELSE role END AS justification
     FROM conversations""",
)
def answer_alias_folding(spark, sf):
    bodies = corpus.table(spark, sf, "conversations").selectExpr(
        "conv_id",
        "turn",
        """IF(turn % 2 = 0, to_json(named_struct('answer', 'PY', 'quoted_text', text, 'reasoning', array(role, ' ', 'stated'))),
             to_json(named_struct('answer', 'N', 'quote', concat('[', conv_id, '] ', text), 'rationale', role))) AS body""",
    )
    return bodies.select("conv_id", "turn", P.folded_answer(F.col("body")).alias("a")).select(
        "conv_id", "turn", "a.answer", F.md5("a.quote").alias("quote_md5"), "a.justification"
    )


@query(
    "metadata_alias_folding",
    """SELECT o_orderkey, o_orderpriority AS title, 'drug '||o_custkey AS intervention, CASE WHEN o_orderkey%3=0 THEN o_orderstatus||'|second' ELSE o_orderstatus END AS all_outcomes,
      CASE WHEN o_orderkey%2=0 THEN 'double_blind' ELSE 'open_label' END AS blinding, 'NCT'||lpad(o_custkey::VARCHAR,8,'0') AS nct_number, 'parallel_rct' AS study_design FROM orders""",
)
def metadata_alias_folding(spark, sf):
    bodies = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """IF(o_orderkey % 2 = 0,
             to_json(named_struct('result', named_struct('title', o_orderpriority, 'intervention', concat('drug ', o_custkey), 'outcomes', IF(o_orderkey % 3 = 0, array(o_orderstatus, 'second'), array(o_orderstatus)),
               'masking', 'double_blind', 'nct_id', concat('registered: nct', lpad(o_custkey, 8, '0')), 'design', 'parallel_rct'))),
             to_json(named_struct('title', o_orderpriority, 'intervention', array('drug', concat(o_custkey, ' ')), 'all_outcomes', IF(o_orderkey % 3 = 0, array(o_orderstatus, 'second'), array(o_orderstatus)),
               'blinding', 'open_label', 'nct_number', concat('NCT', lpad(o_custkey, 8, '0')), 'study_design', 'parallel_rct'))) AS body""",
    )
    from trialsift.functions import text as T

    return bodies.select("o_orderkey", P.folded_metadata(F.col("body")).alias("m")).select(
        "o_orderkey",
        "m.title",
        "m.intervention",
        F.array_join("m.all_outcomes", "|").alias("all_outcomes"),
        "m.blinding",
        T.extract_nct(F.col("m.nct_number")).alias("nct_number"),
        "m.study_design",
    )


@query(
    "token_usage",
    """SELECT o_orderkey, CASE WHEN o_orderkey%4<3 THEN o_custkey END AS input_tokens, CASE WHEN o_orderkey%4<2 THEN o_custkey*2 END AS output_tokens,
      CASE WHEN o_orderkey%4=0 THEN o_custkey+1 WHEN o_orderkey%4=1 THEN o_custkey+2 END AS cache_read_tokens, CASE WHEN o_orderkey%4=1 THEN o_custkey+3 END AS cache_write_tokens FROM orders""",
)
def token_usage(spark, sf):
    bodies = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 4
            WHEN 0 THEN to_json(named_struct('usage', named_struct('prompt_tokens', o_custkey, 'completion_tokens', o_custkey * 2, 'prompt_tokens_details', named_struct('cached_tokens', o_custkey + 1))))
            WHEN 1 THEN to_json(named_struct('usage_metadata', named_struct('input_tokens', o_custkey, 'output_tokens', o_custkey * 2, 'input_token_details', named_struct('cache_read', o_custkey + 2, 'cache_write', o_custkey + 3))))
            WHEN 2 THEN to_json(named_struct('response_metadata', named_struct('token_usage', named_struct('prompt_tokens', o_custkey, 'completion_tokens', 'many'))))
            ELSE '{"content": "no usage"}' END AS body""",
    )
    return bodies.select("o_orderkey", *[c.alias(n) for n, c in P.token_usage(F.col("body")).items()])
