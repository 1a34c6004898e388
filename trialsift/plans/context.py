"""Context queries over paper sections and selected supplement segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import text as T
from trialsift.operators import context as X
from trialsift.operators import retrieval as R
from trialsift.operators import structure as S
from trialsift.operators import trace as O
from trialsift.operators.skew import hot_key_join
from trialsift.operators.registry import comparison_block, enrollment_count, metadata_block, registry_block
from trialsift.plans import registry_records as PRR
from trialsift.plans import retrieval as PR
from trialsift.plans import structure as PS
from trialsift.plans import trace as PT
from trialsift.plans.registry import query, sql_in
from trialsift.session import materialize
from trialsift.sources import corpus

strip, words = PS.sql_strip, PS.sql_words
NL2 = "chr(10)||chr(10)"


def sql_cap(x: str, budget: int) -> str:
    return f"CASE WHEN len({words(x)})<={budget} THEN {strip(x)} ELSE array_to_string(({words(x)})[1:{budget}],' ') END"


def rows(spark, sf):
    """One row per paper with its sections in order."""
    texts = S.document_texts(S.page_offsets(corpus.paper_pages(spark, sf)))
    return X.document_rows(PS.sections(spark, sf), texts)


#: What is known of each paper beside its text: metadata, its registry record, outcome comparison and boxes of its pages.
_FACTS = f"""{PRR._REG}, facts AS (SELECT doc_id, concat_ws(chr(10), '[Trial metadata]', 'trial_id: T'||doc_id, 'title: '||source, 'intervention: drug '||lang, CASE WHEN doc_id%2=0 THEN 'comparator: placebo' END,
   'primary_outcome: Overall survival', 'effect_of_interest: '||CASE WHEN doc_id%3=0 THEN 'adhering' ELSE 'assignment' END, 'nct_number: NCT'||lpad(doc_id::VARCHAR,8,'0'), 'all_outcomes: Overall survival; '||source) AS meta,
   CASE WHEN nct IS NULL OR broken THEN '' ELSE {PRR._BLOCK_SQL} END AS registry, CASE WHEN NOT broken AND cnt='120' THEN 120 END AS enrolled,
   CASE WHEN NOT broken THEN concat_ws(chr(10), '[Registered outcome comparison]', 'Published outcome: Overall survival', 'Best registered outcome: Overall survival in '||c_mktsegment,
     'Similarity score: '||CASE WHEN c_nationkey%2=0 THEN '0.75' ELSE '0.25' END, 'Outcome change detected: '||CASE WHEN c_nationkey%2=0 THEN 'False' ELSE 'True' END, 'Registered as primary: True') END AS comparison,
   'Assessed for eligibility (n='||n_chars||'). Excluded later.' AS box FROM documents LEFT JOIN reg ON c_custkey=doc_id)"""


def facts(spark, sf):
    """(doc_id, meta, registry, enrolled, comparison, boxes) of each paper; a broken or missing record leaves its parts empty."""
    named = corpus.table(spark, sf, "customer").selectExpr("concat('NCT', lpad(c_custkey, 8, '0')) AS nct", "c_mktsegment", "c_nationkey")
    records = PRR.records(spark, sf).join(named, "nct")
    docs = corpus.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('T', doc_id) AS trial_id", "source AS title", "concat('drug ', lang) AS intervention",
        "IF(doc_id % 2 = 0, 'placebo', '') AS comparator", "'Overall survival' AS primary_outcome",
        "IF(doc_id % 3 = 0, 'adhering', 'assignment') AS effect_of_interest", "CAST(NULL AS STRING) AS blinding",
        "concat('NCT', lpad(doc_id, 8, '0')) AS nct_number", "array('Overall survival', source) AS all_outcomes",
        "array(concat('Assessed for eligibility (n=', n_chars, '). Excluded later.'), 'Figure 1.') AS boxes",
    )
    known = docs.join(records.withColumnRenamed("nct", "nct_number"), "nct_number", "left").withColumns(
        {
            "published_outcome": F.col("primary_outcome"),
            "registered_outcome": F.concat(F.lit("Overall survival in "), "c_mktsegment"),
            "outcome_change_detected": F.when(F.col("rec").isNotNull(), F.col("c_nationkey") % 2 != 0),
            "outcome_similarity_score": F.when(F.col("c_nationkey") % 2 == 0, 0.75).otherwise(0.25),
            "registered_as_primary": F.lit(True),
        }
    )
    return known.select(
        "doc_id",
        metadata_block(docs.columns).alias("meta"),
        registry_block().alias("registry"),
        enrollment_count().cast("bigint").alias("enrolled"),
        comparison_block().alias("comparison"),
        "boxes",
    )


def papers(spark, sf):
    return rows(spark, sf).join(facts(spark, sf), "doc_id")


_TOP = sql_in(C.TOP_LEVEL_SECTION_LABELS)


def _group_sql(name: str, groups: list[tuple[int, str, str]], fmt: str) -> str:
    """CTEs m_/g_/p_<name>: the parts of one label-group list (order, default label, test)."""
    union = " UNION ALL ".join(f"SELECT *, {o} AS o FROM sections WHERE {test}" for o, _, test in groups)
    head = "'['||disp||']'||chr(10)" if fmt == "bracket" else "disp||chr(10)"
    one = strip("'['||label||']'||chr(10)||" + strip("text")) if fmt == "bracket" else strip("label||chr(10)||text")
    return f"""m_{name} AS ({union}),
 g_{name} AS (SELECT m.doc_id, o, any_value(full_text) AS full_text, sum(length({strip("text")})) AS tot, min(char_start) FILTER (char_start<length(full_text)) AS st, arg_min(label,char_start) AS disp,
   string_agg({one}, {NL2} ORDER BY char_start) AS joined FROM m_{name} m JOIN docs USING (doc_id) GROUP BY m.doc_id, o),
 s_{name} AS (SELECT g.*, {strip("substring(full_text, st+1, coalesce((SELECT min(t.char_start) FROM sections t WHERE t.doc_id=g.doc_id AND t.char_start>st AND t.label IN " + _TOP + "), length(full_text))-st)")} AS cut FROM g_{name} g),
 p_{name} AS (SELECT doc_id, string_agg(CASE WHEN tot<500 AND cut<>'' THEN {strip(head + "||cut")} ELSE joined END, {NL2} ORDER BY o) AS body FROM s_{name} GROUP BY doc_id)"""


_PREFIX = f"""{_group_sql("x", [(1, "METHODS", "contains(label,'METHODS')"), (2, "RESULTS", "contains(label,'RESULTS')")], "bracket")},
 prefix AS (SELECT doc_id, concat_ws({NL2}, meta, nullif(registry,''), body) AS t FROM facts LEFT JOIN p_x USING (doc_id))"""


def prefixes(spark, sf):
    """(doc_id, c): capped trial-static prefix of each paper."""
    return papers(spark, sf).select("doc_id", X.shared_prefix(F.col("meta"), F.col("registry")).alias("c"))


@query(
    "shared_prefix",
    f"""WITH {PS.SECTIONS}, {_FACTS}, {_PREFIX}
     SELECT doc_id, len({words("t")})::INT AS original_tokens, md5({sql_cap("t", C.PREFIX_TOKEN_BUDGET)}) AS prefix_md5 FROM prefix""",
)
def shared_prefix(spark, sf):
    return prefixes(spark, sf).select("doc_id", "c.original_tokens", F.md5("c.text").alias("prefix_md5"))


_META = [
    (i, labels[0], f"label IN {sql_in(labels)}") for i, labels in enumerate(C.METADATA_LABELS.values())
]


@query(
    "metadata_source_text",
    f"""WITH {PS.SECTIONS}, {_group_sql("y", _META, "plain")},
     f AS (SELECT doc_id, coalesce(nullif({strip("body")},''), full_text) AS t FROM docs LEFT JOIN p_y USING (doc_id))
     SELECT doc_id, len({words("t")})::INT AS original_tokens, md5({sql_cap("t", C.METADATA_TOKEN_BUDGET)}) AS source_md5 FROM f""",
)
def metadata_source_text(spark, sf):
    capped = rows(spark, sf).select("doc_id", X.metadata_source_text().alias("c"))
    return capped.select("doc_id", "c.original_tokens", F.md5("c.text").alias("source_md5"))


def sql_sentences(x: str) -> str:
    return f"[trim(x) FOR x IN string_split(regexp_replace({PS.sql_squeeze(x)},'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)) IF trim(x)<>'']"


def sql_terms(terms: dict[str, int]) -> str:
    return "[" + ", ".join(f"{{'t': '{t}', 'm': {m}}}" for t, m in terms.items()) + "]"


def sql_excerpts(source: str, text: str, terms: str, budget: int) -> str:
    """CTEs that add `excerpt` to the rows of `source`, as `excerpts`: an ordered fold over weighed sentences."""
    toks = f"list_transform(regexp_extract_all(s,'{C.TOKEN_PATTERN}'), lambda t: lower(t))"
    weight = "list_sum(list_transform(q, lambda w: w.m * len(list_filter(e.toks, lambda t: t = w.t))))"
    return f"""ex0 AS (SELECT *, {sql_sentences(text)} AS ss, {terms} AS q FROM {source}),
 ex1 AS (SELECT *, list_transform(ss, lambda s, i: {{'i': i, 's': s, 'toks': {toks}}}) AS it FROM ex0),
 ex2 AS (SELECT *, list_sort(list_transform(it, lambda e: {{'neg': -{weight}, 'i': e.i, 'n': len(e.toks), 's': e.s}})) AS o FROM ex1),
 ex3 AS (SELECT * EXCLUDE (ss, it, q, o), list_reduce(o, lambda a, e: CASE WHEN a.used>={budget} OR (a.used>0 AND a.used+e.n>{budget}) THEN a
   ELSE {{'used': a.used+e.n, 'kept': list_append(a.kept, {{'i': e.i, 's': e.s}})}} END, {{'used': 0::BIGINT, 'kept': []::STRUCT(i BIGINT, s VARCHAR)[]}}) AS acc FROM ex2),
 excerpts AS (SELECT * EXCLUDE acc, array_to_string(list_transform(list_sort(acc.kept), lambda k: k.s), ' ') AS excerpt FROM ex3)"""


_SENT = sql_sentences("text")
_FLOW_RE = "(?i)\\b(randomi[sz]ed|assessed for eligibility|discontinued|lost to follow-up|analy[sz]ed|withdrew|withdrawn|withdrawal|N\\s*=\\s*\\d+)\\b"
_FLOW = f"""{_FACTS}, fs AS (SELECT doc_id, char_start, unnest({_SENT}) AS s, generate_subscripts({_SENT},1) AS i FROM sections WHERE contains(label,'RESULT')
   UNION ALL SELECT doc_id, 1000000000000, unnest({sql_sentences("box")}), generate_subscripts({sql_sentences("box")},1) FROM facts),
 fd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY char_start, i) AS rn FROM fs WHERE regexp_matches(s,'{_FLOW_RE}')),
 fl AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY char_start, i) AS lines FROM fd WHERE rn=1 GROUP BY ALL),
 flow AS (SELECT doc_id, comparison, concat_ws(chr(10), '[Participant flow text]'||chr(10)||lines, '[ClinicalTrials.gov enrolment count hint] enrollmentInfo.count = '||enrolled) AS block
   FROM facts LEFT JOIN fl USING (doc_id))"""


@query("participant_flow", f"WITH {PS.SECTIONS}, {_FLOW} SELECT doc_id, block FROM docs JOIN flow USING (doc_id)")
def participant_flow(spark, sf):
    return papers(spark, sf).select("doc_id", _flow_block().alias("block"))


def _flow_block():
    return X.flow_block(X.flow_sentences(F.col("boxes")), F.col("enrolled"))


def _domain_sql() -> str:
    tests = " ".join(
        f"WHEN '{d}' THEN " + " OR ".join(f"contains(lower(label),'{n}')" for n in C.DOMAIN_SECTIONS[d]) for d in C.DOMAINS
    )
    one = strip("'['||label||']'||chr(10)||" + strip("text"))
    return f"""fmt AS (SELECT *, {one} AS f FROM sections),
 picked AS (SELECT doc_id, domain, string_agg(f, {NL2} ORDER BY char_start) AS body FROM fmt CROSS JOIN (VALUES ('D1'),('D2'),('D3'),('D4'),('D5')) d(domain)
   WHERE (list_contains(tags,domain) OR CASE domain {tests} END) AND NOT contains(label,'METHODS') AND NOT contains(label,'RESULTS') GROUP BY ALL),
 abs AS (SELECT doc_id, arg_min(f, char_start) AS a FROM fmt WHERE contains(label,'ABSTRACT') GROUP BY ALL),
 fst AS (SELECT doc_id, arg_min(f, char_start) AS first_f FROM fmt GROUP BY ALL),
 base AS (SELECT doc_id, domain, coalesce(body,'') AS body, a, first_f FROM docs CROSS JOIN (VALUES ('D1'),('D2'),('D3'),('D4'),('D5')) d(domain)
   LEFT JOIN picked USING (doc_id, domain) LEFT JOIN abs USING (doc_id) LEFT JOIN fst USING (doc_id)),
 b2 AS (SELECT *, CASE WHEN length(body)<500 AND a IS NOT NULL THEN {strip("concat_ws(" + NL2 + ", a, body)")} ELSE body END AS t1 FROM base),
 b3 AS (SELECT doc_id, domain, CASE WHEN t1='' THEN first_f ELSE t1 END AS t FROM b2),
 b4 AS (SELECT b3.doc_id, domain, {sql_cap("t", C.DOMAIN_TOKEN_BUDGET)} AS t, nullif(CASE domain WHEN 'D3' THEN block WHEN 'D5' THEN comparison END, '') AS extra FROM b3 LEFT JOIN flow USING (doc_id)),
 dctx AS (SELECT doc_id, domain, CASE WHEN extra IS NOT NULL THEN {sql_cap(strip("concat_ws(" + NL2 + ", t, extra)"), C.DOMAIN_TOKEN_BUDGET)} ELSE t END AS t FROM b4)"""


def contexts(spark, sf):
    return X.domain_contexts(papers(spark, sf), _flow_block(), F.col("comparison"))


@query("domain_contexts", f"WITH {PS.SECTIONS}, {_FLOW}, {_domain_sql()} SELECT doc_id, domain, md5(t) AS text_md5, length(t)::INT AS n_chars FROM dctx")
def domain_contexts(spark, sf):
    return contexts(spark, sf).select(
        "doc_id", "domain", F.md5("domain_specific_text").alias("text_md5"), F.length("domain_specific_text").alias("n_chars")
    )


def _segments(spark, sf):
    return PR.index_segments(spark, sf).withColumn("source_file", F.concat(F.col("doc_id"), F.lit(".pdf")))


def blocks(spark, sf):
    return X.supplement_blocks(R.fused_top(PR.scored(spark, sf)), _segments(spark, sf))


_HEAD = "'[Supplement: '||i.doc_id||'.pdf; heading: '||heading||'; pages: '||array_to_string(pages,', ')||']'"
_BY_DOMAIN = "CASE domain " + " ".join(f"WHEN '{d}' THEN {sql_terms(R.query_tokens(d))}" for d in C.DOMAINS) + " END"
#: supp: the joined block of each source and domain, before the cap.
_SUPP = f"""shown AS (SELECT t.trial_id, t.domain, t.rank, i.char_count, {_HEAD} AS head, body FROM top t JOIN idx i USING (doc_id, seg_ord)),
 large AS (SELECT * FROM shown WHERE char_count>={C.LARGE_SEGMENT_CHARS}), {sql_excerpts("large", "body", _BY_DOMAIN, C.SUPPLEMENT_TOKEN_BUDGET)},
 blk AS (SELECT trial_id, domain, rank, {strip("head||chr(10)||body")} AS b FROM shown WHERE char_count<{C.LARGE_SEGMENT_CHARS}
   UNION ALL SELECT trial_id, domain, rank, {strip("head||chr(10)||excerpt")} FROM excerpts),
 supp AS (SELECT trial_id, domain, string_agg(b, {NL2} ORDER BY rank) AS t FROM blk GROUP BY ALL)"""


@query(
    "context_records",
    f"""WITH {PR.FUSED}, n AS (SELECT trial_id, count(*) AS segments_available FROM idx GROUP BY ALL),
     ts AS (SELECT trial_id, domain, CASE WHEN dense IS NOT NULL THEN round(greatest(0,least(1,dense)),6) END AS retrieval_top_score FROM top WHERE rank=1),
     c AS (SELECT trial_id, domain, count(*) AS segments_retrieved FROM top GROUP BY ALL)
     SELECT c.trial_id, c.domain, segments_retrieved, segments_available, retrieval_top_score, 'selected' AS supplement_status FROM c JOIN n USING (trial_id) JOIN ts USING (trial_id, domain)""",
)
def context_records(spark, sf):
    available = PR.index_segments(spark, sf).groupBy("trial_id").agg(F.count(F.lit(1)).alias("segments_available"))
    joined = blocks(spark, sf).join(available, "trial_id")
    return joined.select(
        "trial_id",
        "domain",
        "segments_retrieved",
        "segments_available",
        F.round("retrieval_top_score", 6).alias("retrieval_top_score"),
        X.supplement_status(F.col("segments_available"), F.col("supplement_block")).alias("supplement_status"),
    )


@query(
    "supplement_blocks",
    f"""WITH {PR.FUSED}, {_SUPP} SELECT trial_id, domain, md5({sql_cap("t", C.SUPPLEMENT_TOKEN_BUDGET)}) AS block_md5, len({words("t")})::INT AS original_tokens,
     least(len({words("t")}), {C.SUPPLEMENT_TOKEN_BUDGET})::INT AS kept_tokens FROM supp""",
)
def supplement_blocks(spark, sf):
    """Rank-ordered supplement text; large segments pass the greedy sentence fill."""
    return blocks(spark, sf).select(
        "trial_id", "domain", F.md5("supplement_block").alias("block_md5"), "supplement_report.original_tokens", "supplement_report.kept_tokens"
    )


@query(
    "context_trims",
    f"""WITH {PS.SECTIONS}, {_FLOW}, {_domain_sql()}, w AS (SELECT doc_id, domain, len({words("t")}) AS n FROM dctx)
     SELECT doc_id, domain, 'context_trimmed' AS category, 'warning' AS severity, 'domain_text exceeded its token budget and was trimmed' AS reason, 'domain_text' AS zone,
      n::INT AS original_tokens, 300 AS kept_tokens, (n-300)::INT AS dropped_tokens, 300 AS budget_tokens FROM w WHERE n>300""",
)
def context_trims(spark, sf):
    capped = contexts(spark, sf).select(
        "doc_id", "domain", F.lit("domain_text").alias("zone"), T.cap_tokens(F.col("domain_specific_text"), 300, with_text=False).alias("report")
    )
    return X.trim_degradations(capped, ["doc_id", "domain"])


_PRICE_WINDOWS = ", ".join(f"('{m[0]}',{m[2]})" for m in C.MODEL_PRICES)
_RESERVED = C.SQ_MAX_TOKENS + C.REASONING_MAX_TOKENS + C.REASONING_RESERVE_TOKENS


@query(
    "zone_budgets",
    f"""WITH {PT._CALLS}, win(model, context_window) AS (VALUES {_PRICE_WINDOWS}),
     z(zone, share, cap) AS (VALUES {", ".join(f"('{z}',{s}::DOUBLE,{C.ZONE_LEGACY_BUDGETS[z]})" for z, s in C.ZONE_SHARES.items())}),
     b AS (SELECT call_id, model, input_tokens, zone, least(greatest(1,floor((coalesce(context_window,{C.DEFAULT_CONTEXT_WINDOW})-{_RESERVED})*share)::INT),cap) AS budget_tokens FROM calls LEFT JOIN win USING (model) CROSS JOIN z)
     SELECT model, zone, any_value(budget_tokens) AS budget_tokens, count(*) AS n_calls, count(*) FILTER (input_tokens>budget_tokens) AS n_over FROM b GROUP BY model, zone""",
)
def zone_budgets(spark, sf):
    windows = O.model_prices(spark).select("model", "context_window")
    calls = PT.calls(spark, sf).select("model", "input_tokens").join(F.broadcast(windows), "model", "left")
    zones = calls.select("model", "input_tokens", F.explode(X.zone_budgets(F.col("context_window"))).alias("z"))
    return zones.groupBy("model", F.col("z.zone").alias("zone")).agg(
        F.max("z.budget_tokens").alias("budget_tokens"),
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(F.col("input_tokens") > F.col("z.budget_tokens")).alias("n_over"),
    )


def _templates(spark):
    """Supplied wording table: one row per question, plus effect-specific D2 rows."""
    both = [(s, "both", f"Question {s}?", f"Definitions of {s}.") for s in C.ALL_SQS]
    own = [(s, e, f"Question {s} ({e})?", f"Definitions of {s}.") for s in ("2.3", "2.4", "2.5", "2.6") for e in ("assignment", "adhering")]
    return spark.createDataFrame(both + own, "sq_id string, effect string, question_text string, answer_definitions string")


#: Bytes of supplement blocks that are sent to every task; more are joined by a shuffle.
BROADCAST_BLOCKS = 32 << 20


def _with_blocks(texts, blocks):
    """Each text beside the block of its source and domain.

    A source may hold most papers, but has one block a domain: the blocks go to the papers.
    """
    blocks = materialize(blocks)
    held = blocks.agg(F.sum(F.octet_length("supplement_block") + 64)).first()[0] or 0
    if held <= BROADCAST_BLOCKS:
        return texts.join(F.broadcast(blocks), ["trial_id", "domain"], "left")
    return hot_key_join(texts, blocks, ["trial_id", "domain"])


_OWN = "sq_id IN ('2.3','2.4','2.5','2.6')"


@query(
    "sq_prompts",
    f"""WITH {PS.SECTIONS}, {_FLOW}, {_domain_sql()}, {_PREFIX},
     sup AS (WITH {PR.FUSED}, {_SUPP} SELECT trial_id, domain, {sql_cap("t", C.SUPPLEMENT_TOKEN_BUDGET)} AS block FROM supp),
     a AS (SELECT doc_id, source, sq_id, 'D'||sq_id[1] AS domain, CASE WHEN doc_id%3=0 THEN 'adhering' ELSE 'assignment' END AS effect
       FROM documents CROSS JOIN (VALUES {", ".join(f"('{s}')" for s in C.ALL_SQS)}) q(sq_id))
     SELECT a.doc_id, sq_id, a.domain, sq_id||'|'||effect AS call_label, md5('[Static trial prefix]'||chr(10)||{sql_cap("prefix.t", C.PREFIX_TOKEN_BUDGET)}) AS prefix_md5,
      md5(concat_ws({NL2}, '[Domain source text]'||chr(10)||{strip("dctx.t")}, '[Supplement source text]'||chr(10)||{strip("coalesce(block,'')")},
        '[Signaling question]'||chr(10)||'Question '||sq_id||CASE WHEN {_OWN} THEN ' ('||effect||')' ELSE '' END||'?',
        '[Answer definitions]'||chr(10)||'Definitions of '||sq_id||'.')) AS suffix_md5
     FROM a JOIN dctx USING (doc_id, domain) JOIN prefix USING (doc_id) LEFT JOIN sup ON sup.trial_id=a.source AND sup.domain=a.domain""",
)
def sq_prompts(spark, sf):
    """All questions of every paper, with its prefix, its domain's text and its source's supplement block."""
    docs = corpus.table(spark, sf, "documents")
    askable = docs.select(
        "doc_id", corpus.effect_of(F.col("doc_id")).alias("effect"), F.explode(F.array(*[F.lit(s) for s in C.ALL_SQS])).alias("sq_id")
    )
    # a paper's facts and sources gather in arrays (one entry a row of its document), so that its texts are read and dealt once
    known = facts(spark, sf)
    known = known.groupBy("doc_id").agg(F.collect_list(F.struct(*known.columns[1:])).alias("known"))
    sources = docs.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("source").alias("trial_id"))).alias("sources"))
    prefix = F.transform("known", lambda k: X.shared_prefix(k["meta"], k["registry"])["text"])
    papers = rows(spark, sf).join(known, "doc_id").join(sources, "doc_id").withColumn("prefixes", prefix)
    papers = papers.withColumn("k", F.explode("known")).select("doc_id", "secs", "sources", "prefixes", "k.*")
    texts = X.domain_contexts(papers, _flow_block(), F.col("comparison"), keep=("sources", "prefixes"))
    # outer, for a filter on their size would make the prefixes twice; neither array is ever empty
    texts = texts.withColumn("shared_prefix", F.explode_outer("prefixes")).withColumn("s", F.explode_outer("sources"))
    texts = texts.select("doc_id", "domain", "domain_specific_text", "shared_prefix", "s.trial_id")
    texts = _with_blocks(texts, blocks(spark, sf).select("trial_id", "domain", "supplement_block"))
    prompts = X.sq_prompts(askable, texts, _templates(spark), ["doc_id"])
    return prompts.select("doc_id", "sq_id", "domain", "call_label", F.md5("prefix_text").alias("prefix_md5"), F.md5("suffix_text").alias("suffix_md5"))


@query(
    "annotation_prompts",
    f"""WITH {PS.CHOSEN}, pre AS (SELECT doc_id, array_to_string(({words("full_text")})[1:500],' ') AS preamble FROM (SELECT doc_id, string_agg(full_text,chr(10) ORDER BY win) AS full_text FROM win GROUP BY ALL))
     SELECT doc_id, segment_id, 'supplement_annotation:'||segment_id AS call_label, md5('Document preamble:'||chr(10)||preamble||{NL2}||'Segment heading: '||heading||chr(10)||'Domain tags: '||
       CASE WHEN len(tags)=0 THEN 'none' ELSE array_to_string(tags,', ') END||{NL2}||'Segment text:'||chr(10)||raw_text) AS prompt_md5 FROM chosen JOIN pre USING (doc_id) WHERE annotate""",
)
def annotation_prompts(spark, sf):
    chosen = S.annotation_choice(PS.segments(spark, sf))
    texts = S.document_texts(S.page_offsets(corpus.supplement_pages(spark, sf)))
    preambles = texts.select("doc_id", T.preamble(F.col("full_text")).alias("preamble"))
    return X.annotation_prompts(chosen, preambles).select("doc_id", "segment_id", "call_label", F.md5("prompt").alias("prompt_md5"))


_RERANK = {"the": 1, "and": 2, "la": 1, "der": 1}


@query(
    "sentence_rerank",
    f"WITH {sql_excerpts('documents', 'text', sql_terms(_RERANK), 120)} SELECT doc_id, excerpt FROM excerpts",
)
def sentence_rerank(spark, sf):
    """Query sentences of whole documents, re-ranked within a small token budget."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", R.rerank_sentences(F.col("text"), _RERANK, 120).alias("excerpt"))
