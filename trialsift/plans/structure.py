"""Text, section and segment queries over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import text as T
from trialsift.operators import structure as S
from trialsift.plans.registry import query, sql_draw, sql_in, sql_list
from trialsift.session import stage_table
from trialsift.sources import corpus

# ---- SQL twins
WS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"
PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"[w FOR w IN string_split({sql_squeeze(x)}, ' ') IF w <> '']"


def sql_norm_heading(x: str) -> str:
    return f"upper(trim({x}, {WS}||{PUNCT}))"


def sql_tags(label: str, text: str) -> str:
    hay = f"lower({label}||chr(10)||left({text},{C.TAG_SCAN_CHARS}))"
    parts = [
        "CASE WHEN " + " OR ".join(f"contains({hay},'{k}')" for k in C.SECTION_KEYWORDS[d]) + f" THEN '{d}' END"
        for d in C.DOMAINS
    ]
    return f"[t FOR t IN [{','.join(parts)}] IF t IS NOT NULL]"


def _sql_pages(headings, mark: str, every: int, stride: int, line: str = "line") -> str:
    return f"""pages AS (SELECT doc_id, page, CASE WHEN page % {every} = 0 THEN '{mark} '||{sql_list(headings)}[(doc_id*{stride}+page//{every})%{len(headings)}+1]||chr(10)||line ELSE line END AS text
   FROM (SELECT doc_id, page, {line} AS line FROM (SELECT doc_id, unnest(string_split(text,chr(10))) AS line, (generate_subscripts(string_split(text,chr(10)),1)-1)::INT AS page FROM documents)))"""


PAPER = _sql_pages(
    corpus.PAPER_HEADINGS, "##", 3, 7,
    "CASE WHEN page%5=1 THEN line||' In all, '||(100+page)||' participants were randomised.' ELSE line END",
)
SUPPLEMENT = _sql_pages(corpus.SUPPLEMENT_HEADINGS, "#", 2, 5)

PAPER_OFFSETS = f"""{PAPER}, po AS (SELECT *, coalesce(sum(length(text)+1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::INT AS page_start FROM pages)"""

HEADINGS = f"""{PAPER_OFFSETS}, ln AS (SELECT doc_id, page, page_start, unnest(string_split(text,chr(10))) AS line, generate_subscripts(string_split(text,chr(10)),1) AS i FROM po),
 lo AS (SELECT *, (page_start+coalesce(sum(length(line)+1) OVER (PARTITION BY doc_id, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::INT AS off FROM ln),
 heads AS (SELECT doc_id, page, off, {sql_norm_heading("regexp_replace(line,'^\\s{0,3}#{1,6}\\s+','')")} AS label FROM lo)"""

SECTIONS = f"""{HEADINGS}, h AS (SELECT * FROM heads WHERE label IN {sql_in(C.CANONICAL_SECTION_LABELS)}),
 docs AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS full_text, list(page_start ORDER BY page) AS starts FROM po GROUP BY ALL),
 b AS (SELECT a.doc_id, a.label, a.off AS char_start,
   coalesce((SELECT min(n.off) FROM h n WHERE n.doc_id=a.doc_id AND n.off>a.off AND (a.label='STATISTICAL ANALYSIS' OR n.label<>'STATISTICAL ANALYSIS')), length(full_text))::INT AS char_end, full_text, starts
   FROM h a JOIN docs USING (doc_id)),
 sec AS (SELECT doc_id, label, char_start, char_end, {sql_strip("substring(full_text, char_start+1, char_end-char_start)")} AS text, starts, false AS whole FROM b
   UNION ALL SELECT doc_id, 'FULL_TEXT', 0, length(full_text)::INT, full_text, starts, true FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM h)),
 sections AS (SELECT doc_id, label, char_start, char_end, text, whole, starts, {sql_tags("label", "text")} AS tags,
   list_sort(list_distinct(list_concat([coalesce(list_max([i-1 FOR i IN range(1,len(starts)+1) IF starts[i]<=char_start]),0)],
     [i-1 FOR i IN range(1,len(starts)+1) IF starts[i]>=char_start AND starts[i]<char_end]))) AS pages FROM sec)"""


@query(
    "page_offsets",
    f"WITH {PAPER_OFFSETS} SELECT doc_id, page, page_start, length(text)::INT AS n_chars FROM po",
)
def page_offsets(spark, sf):
    return S.page_offsets(corpus.paper_pages(spark, sf)).select(
        "doc_id", "page", "page_start", F.length("text").alias("n_chars")
    )


@query(
    "heading_lines",
    f'WITH {HEADINGS} SELECT doc_id, page, off AS "offset", label FROM heads WHERE label IN {sql_in(C.CANONICAL_SECTION_LABELS)}',
)
def heading_lines(spark, sf):
    return S.paper_headings(S.page_offsets(corpus.paper_pages(spark, sf)))


def sections(spark, sf):
    # each query reads them once, where their paper was dealt
    return S.build_sections(corpus.paper_pages(spark, sf))


def _section_view(df):
    return df.select(
        "doc_id",
        "label",
        "char_start",
        "char_end",
        F.md5("text").alias("text_md5"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.array_join("domain_tags", ",").alias("tags"),
    )


@query(
    "section_bounds",
    f"WITH {SECTIONS} SELECT doc_id, label, char_start, char_end, md5(text) AS text_md5, array_to_string(pages,',') AS pages, array_to_string(tags,',') AS tags FROM sections",
)
def section_bounds(spark, sf):
    return _section_view(sections(spark, sf))


@query(
    "domain_tags",
    f"WITH {SECTIONS} SELECT label, array_to_string(tags,',') AS tags, count(*) AS n FROM sections GROUP BY ALL",
)
def domain_tags(spark, sf):
    return sections(spark, sf).groupBy("label", F.array_join("domain_tags", ",").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


_HEAD_OF = f"""trim(regexp_replace(replace(replace(trim(trim(trim(trim(ltrim(trim(line,{WS}),'#'),{WS}),'*_'),{WS}),{WS}),'**',' '),'__',' '),'\\s+',' ','g'))"""
WINDOWS = f"""{SUPPLEMENT}, po AS (SELECT *, page//20 AS win, coalesce(sum(length(text)+1) OVER (PARTITION BY doc_id, page//20 ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::INT AS page_start FROM pages),
 win AS (SELECT doc_id, win, string_agg(text,chr(10) ORDER BY page) AS full_text, list(page_start ORDER BY page) AS starts, list(page ORDER BY page) AS all_pages,
   list(page ORDER BY page) FILTER ({sql_strip("text")}<>'') AS text_pages FROM po GROUP BY ALL),
 hl AS (SELECT * FROM (SELECT doc_id, win, page, page_start, {_HEAD_OF} AS head, line FROM (SELECT doc_id, win, page, page_start, unnest(string_split(text,chr(10))) AS line FROM po)) WHERE starts_with(trim(line,{WS}),'#') AND head<>'')"""


def _sql_votes() -> str:
    cols = []
    for name, lexicon in C.DOC_TYPE_LEXICONS.items():
        terms = "+".join(f"(length(lh)-length(replace(lh,'{t}','')))//{len(t)}" for t in lexicon)
        cols.append(f"coalesce(sum(CASE WHEN page<10 THEN {terms} END),0)::INT AS {name}")
    return ", ".join(cols)


TYPES = f"""{WINDOWS}, votes AS (SELECT d.doc_id, {_sql_votes()} FROM (SELECT DISTINCT doc_id FROM pages) d LEFT JOIN (SELECT *, lower(head) AS lh FROM hl) USING (doc_id) GROUP BY ALL),
 types AS (SELECT doc_id, greatest({",".join(C.DOC_TYPE_LEXICONS)}) AS votes, CASE WHEN greatest({",".join(C.DOC_TYPE_LEXICONS)})=0 THEN 'unknown'
   {" ".join(f"WHEN {n}=greatest({','.join(C.DOC_TYPE_LEXICONS)}) THEN '{n}'" for n in C.DOC_TYPE_LEXICONS)} END AS doc_type FROM votes)"""


@query("doc_type_vote", f"WITH {TYPES} SELECT doc_id, doc_type, votes FROM types")
def doc_type_vote(spark, sf):
    return S.document_types(S.supplement_windows(corpus.supplement_pages(spark, sf)))


SEGMENTS = f"""{TYPES}, cut0 AS (SELECT DISTINCT doc_id, win, {sql_norm_heading("head")} AS heading,
    page_start + greatest(instr(substring(full_text,page_start+1), head)-1, 0) AS start FROM hl JOIN win USING (doc_id, win)),
 cut1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, win ORDER BY start, heading) AS rn, lead(start) OVER (PARTITION BY doc_id, win ORDER BY start, heading) AS nxt FROM cut0),
 cut2 AS (SELECT c.doc_id, c.win, rn, heading, start, coalesce(nxt,length(full_text)) AS stop, {sql_strip("substring(full_text,start+1,coalesce(nxt,length(full_text))-start)")} AS raw_text, starts FROM cut1 c JOIN win w ON w.doc_id=c.doc_id AND w.win=c.win),
 cut3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, win ORDER BY rn)-1 AS seg FROM cut2 WHERE raw_text<>''),
 segs0 AS (SELECT doc_id, win, seg, 'doc__'||coalesce(nullif(trim(regexp_replace(heading,'[^A-Za-z0-9]+','_','g'),'_'),''),'SEGMENT')||'__'||win||'_'||seg AS segment_id, heading, start, stop, raw_text, starts, {sql_tags("heading", "raw_text")} AS tags FROM cut3
  UNION ALL SELECT doc_id, win, 0, 'doc__WINDOW_'||win||'__0', 'WINDOW_'||win, 0, length(full_text), {sql_strip("full_text")}, starts, ['D1','D2','D3','D4','D5'] FROM win w WHERE NOT EXISTS (SELECT 1 FROM hl WHERE hl.doc_id=w.doc_id AND hl.win=w.win)),
 segs AS (SELECT doc_id, win, seg, segment_id, heading, raw_text, tags, length(raw_text) AS char_count,
   list_sort(list_distinct(list_concat([win*20+coalesce(list_max([i-1 FOR i IN range(1,len(starts)+1) IF starts[i]<=start]),0)],
     [win*20+i-1 FOR i IN range(1,len(starts)+1) IF starts[i]>=start AND starts[i]<stop]))) AS pages FROM segs0)"""


@query(
    "window_segments",
    f"""WITH {SEGMENTS} SELECT doc_id, win::INT AS window_no, seg::INT AS segment_no, segment_id, heading, array_to_string(pages,',') AS pages,
      md5(raw_text) AS text_md5, array_to_string(tags,',') AS tags, char_count::INT AS char_count FROM segs""",
)
def window_segments(spark, sf):
    cut = S.cut_segments(S.supplement_windows(corpus.supplement_pages(spark, sf)))
    return cut.select(
        "doc_id",
        "window_no",
        "segment_no",
        "segment_id",
        "heading",
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.md5("raw_text").alias("text_md5"),
        F.array_join("domain_tags", ",").alias("tags"),
        "char_count",
    )


_N = "replace(" + sql_norm_heading("heading") + ",'_',' ')"
_NW = f"len({sql_words(_N)})"
_JUNK = f"""({_NW}>12 OR ({_NW}>8 AND NOT regexp_matches({_N},'^\\d+(\\.\\d+)*\\s+')) OR (length({_N})<=3 AND {_N}<>'SAP')
  OR regexp_matches({_N},'^(?i:PAGE\\s+\\d+\\s+OF\\s+\\d+)$') OR regexp_matches({_N},'^(?i:WINDOW[ _]\\d+)$') OR regexp_matches({_N},'^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}$')
  OR regexp_matches({_N},'^[A-Z][A-Z0-9_ /-]{{0,30}}:$') OR ({_NW}<=4 AND ends_with(trim(heading,{WS}),':'))
  OR ({_NW}<=3 AND {_NW}>0 AND len([w FOR w IN {sql_words(_N)} IF w NOT IN {sql_in(C.FORM_LABELS)}])=0)
  OR (length(regexp_replace({_N},'[^\\p{{L}}]','','g')) BETWEEN 1 AND 10 AND length(regexp_replace(heading,'[^!-/:-@\\[-`{{-~]','','g'))>=length(regexp_replace({_N},'[^\\p{{L}}]','','g'))))"""
FRAGMENTS = f"""{SEGMENTS}, frag AS (SELECT *, {_JUNK} OR (count(*) OVER (PARTITION BY doc_id, {sql_norm_heading("heading")})>=3 AND len({sql_words(sql_norm_heading("heading"))})<=8
   AND regexp_matches({sql_norm_heading("heading")},'\\p{{L}}')) OR char_count<60 AS is_fragment FROM segs)"""
MERGED = f"""{FRAGMENTS}, isl0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY win, seg) AS rn FROM frag),
 isl AS (SELECT *, sum(CASE WHEN NOT is_fragment OR rn=1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn)-1 AS seg_ord FROM isl0),
 merged AS (SELECT doc_id, seg_ord::INT AS seg_ord, arg_min(segment_id, rn) AS segment_id, CASE WHEN arg_min(is_fragment, rn) THEN 'WINDOW_START' ELSE arg_min(heading, rn) END AS heading,
   list_sort(list_distinct(flatten(list(pages)))) AS pages, coalesce(string_agg(raw_text, chr(10)||chr(10) ORDER BY rn) FILTER (raw_text<>''),'') AS raw_text, list_sort(list_distinct(flatten(list(tags)))) AS tags
   FROM isl GROUP BY doc_id, seg_ord)"""


@query("fragment_flags", f"WITH {FRAGMENTS} SELECT doc_id, segment_id, is_fragment FROM frag")
def fragment_flags(spark, sf):
    cut = S.cut_segments(S.supplement_windows(corpus.supplement_pages(spark, sf)))
    return S.mark_fragments(cut).select("doc_id", "segment_id", "is_fragment")


def _segment_view(df, *extra):
    return df.select(
        "doc_id",
        "seg_ord",
        "segment_id",
        "heading",
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.md5("raw_text").alias("text_md5"),
        F.array_join("domain_tags", ",").alias("tags"),
        "char_count",
        *extra,
    )


_SEG_VIEW = "doc_id, seg_ord, segment_id, heading, array_to_string(pages,',') AS pages, md5(raw_text) AS text_md5, array_to_string(tags,',') AS tags, length(raw_text)::INT AS char_count"


@query("merge_fragments", f"WITH {MERGED} SELECT {_SEG_VIEW} FROM merged")
def merge_fragments(spark, sf):
    cut = S.cut_segments(S.supplement_windows(corpus.supplement_pages(spark, sf)))
    return _segment_view(S.merge_fragments(S.mark_fragments(cut)))


GUARDED = f"""{MERGED}, cnt AS (SELECT doc_id, count(*) AS n FROM merged GROUP BY ALL),
 dec AS (SELECT t.doc_id, doc_type, doc_type NOT IN ('administrative','disclosure') AND coalesce(n,0) BETWEEN 3 AND 80 AS regular FROM types t LEFT JOIN cnt USING (doc_id)),
 wd AS (SELECT w.*, doc_type, count(*) OVER (PARTITION BY doc_id) AS nw, sum(length(full_text)) OVER (PARTITION BY doc_id) AS total,
    count(*) FILTER ({sql_strip("full_text")}<>'') OVER (PARTITION BY doc_id) AS nfull FROM win w JOIN dec USING (doc_id) WHERE NOT regular),
 wd2 AS (SELECT *, doc_type NOT IN ('administrative','disclosure') AND nw>1 AND total>6000 AND nfull>0 AS split FROM wd),
 guarded AS (SELECT doc_id, doc_type, seg_ord, segment_id, heading, pages, raw_text, tags FROM merged JOIN dec USING (doc_id) WHERE regular
  UNION ALL SELECT doc_id, doc_type, (row_number() OVER (PARTITION BY doc_id ORDER BY win)-1)::INT, 'doc__FULL_DOCUMENT_PART_'||(win+1)||'__'||win, 'FULL_DOCUMENT_PART_'||(win+1),
    coalesce(text_pages, all_pages), {sql_strip("full_text")}, {sql_tags("'FULL_DOCUMENT_PART_'||(win+1)", sql_strip("full_text"))} FROM wd2 WHERE split AND {sql_strip("full_text")}<>''
  UNION ALL SELECT doc_id, any_value(doc_type), 0, 'doc__FULL_DOCUMENT__0', 'FULL_DOCUMENT', coalesce(nullif(flatten(list(coalesce(text_pages,[]) ORDER BY win)),[]), flatten(list(all_pages ORDER BY win))),
    {sql_strip("string_agg(full_text, chr(10) ORDER BY win)")}, ['D1','D2','D3','D4','D5'] FROM wd2 WHERE NOT split GROUP BY doc_id)"""


@query("segment_guards", f"WITH {GUARDED} SELECT {_SEG_VIEW}, doc_type FROM guarded")
def segment_guards(spark, sf):
    return _segment_view(S.segment_documents(corpus.supplement_pages(spark, sf)), "doc_type")


CHOSEN = f"""{GUARDED}, chosen AS (SELECT *, len(tags)>0 AND row_number() OVER (PARTITION BY doc_id ORDER BY len(tags)>0 DESC, len(tags) DESC, segment_id)
   <= CASE WHEN doc_type IN ('administrative','disclosure') THEN 0 WHEN doc_type='unknown' THEN 5 ELSE 40 END AS annotate FROM guarded),
 ann AS (SELECT doc_id, segment_id, CASE {sql_draw("'ann'||doc_id||'|'||segment_id", 4)} WHEN 0 THEN 'No risk-of-bias relevant content.' WHEN 1 THEN ' Allocation was concealed. ' WHEN 2 THEN NULL ELSE 'Arm counts: 12 vs 14.' END AS annotation,
   CASE WHEN {sql_draw("'ann'||doc_id||'|'||segment_id", 4)}=2 THEN 'TimeoutError' END AS annotation_error FROM chosen WHERE annotate AND {sql_draw("'lost'||doc_id||'|'||segment_id", 9)}>0),
 annotated AS (SELECT c.* , CASE WHEN NOT annotate THEN 'not_run' WHEN annotation_error IS NOT NULL OR a.annotation IS NULL THEN 'failed' WHEN trim(a.annotation) IN ('','No risk-of-bias relevant content.') THEN 'succeeded_empty' ELSE 'succeeded_substantive' END AS annotation_status,
   trim(a.annotation) AS note FROM chosen c LEFT JOIN ann a USING (doc_id, segment_id))"""


@query("annotation_budget", f"WITH {CHOSEN} SELECT doc_id, doc_type, segment_id, annotate FROM chosen")
def annotation_budget(spark, sf):
    chosen = S.annotation_choice(S.segment_documents(corpus.supplement_pages(spark, sf)))
    return chosen.select("doc_id", "doc_type", "segment_id", "annotate")


def segments(spark, sf):
    return stage_table(
        spark, sf, "segments", lambda: S.segment_documents(corpus.supplement_pages(spark, sf))
    )


def annotated_segments(spark, sf):
    """Segments with supplied annotation results applied."""
    chosen = S.annotation_choice(segments(spark, sf))
    seed = F.concat_ws("|", "doc_id", "segment_id")
    pick = corpus.draw(F.concat(F.lit("ann"), seed), 4)
    results = (
        chosen.where(F.col("annotate") & (corpus.draw(F.concat(F.lit("lost"), seed), 9) > 0))
        .select(
            "doc_id",
            "segment_id",
            F.when(pick == 0, C.NO_RISK_ANNOTATION)
            .when(pick == 1, " Allocation was concealed. ")
            .when(pick == 3, "Arm counts: 12 vs 14.")
            .alias("annotation"),
            F.when(pick == 2, "TimeoutError").alias("annotation_error"),
        )
    )
    return S.apply_annotations(chosen, results)


@query(
    "annotation_status",
    f"""WITH {CHOSEN} SELECT doc_id, segment_id, annotation_status,
      md5(CASE WHEN annotation_status IN ('not_run','failed') THEN {sql_strip("raw_text")} WHEN annotation_status='succeeded_empty' THEN trim('No risk-of-bias relevant content.'||chr(10)||chr(10)||raw_text, {WS})
       ELSE trim(note||chr(10)||chr(10)||raw_text, {WS}) END) AS searchable_md5 FROM annotated""",
)
def annotation_status(spark, sf):
    done = annotated_segments(spark, sf)
    return done.select(
        "doc_id", "segment_id", "annotation_status", F.md5(S.searchable_text(done)).alias("searchable_md5")
    )


# ---- scalar text functions over whole texts

@query(
    "tokens",
    f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest([lower(t) FOR t IN regexp_extract_all(text,'{C.TOKEN_PATTERN}')]) AS token FROM documents) GROUP BY ALL",
)
def tokens(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    per_doc = docs.select("doc_id", F.explode("tokens").alias("token")).groupBy("token", "doc_id").agg(
        F.count(F.lit(1)).alias("tf")
    )
    return per_doc.groupBy("token").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


_CAP_WORDS = f"{sql_words('text')}"


@query(
    "token_cap",
    f"""WITH w AS (SELECT doc_id, text, {_CAP_WORDS} AS ws FROM documents)
     SELECT doc_id, len(ws)::INT AS original_tokens, least(len(ws),200)::INT AS kept_tokens, greatest(len(ws)-200,0)::INT AS dropped_tokens,
      md5(CASE WHEN len(ws)<=200 THEN {sql_strip("text")} ELSE array_to_string(ws[1:200],' ') END) AS text_md5 FROM w""",
)
def token_cap(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", T.cap_tokens(F.col("text"), 200).alias("c"))
    return docs.select(
        "doc_id", "c.original_tokens", "c.kept_tokens", "c.dropped_tokens", F.md5("c.text").alias("text_md5")
    )


@query(
    "sentences",
    f"""WITH s AS (SELECT doc_id, [trim(x) FOR x IN string_split(regexp_replace({sql_squeeze("text")},'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)) IF trim(x)<>''] AS ss FROM documents)
     SELECT doc_id, len(ss)::INT AS n_sentences, md5(array_to_string(ss,'|')) AS sentences_md5 FROM s""",
)
def sentences(spark, sf):
    docs = corpus.table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("ss"))
    return docs.select("doc_id", F.size("ss").alias("n_sentences"), F.md5(F.array_join("ss", "|")).alias("sentences_md5"))


@query(
    "nct_extract",
    """WITH x AS (SELECT o_orderkey, CASE o_custkey%4 WHEN 0 THEN 'registered as nct'||lpad(o_orderkey::VARCHAR,8,'0')||'.' WHEN 1 THEN 'XNCT'||lpad(o_orderkey::VARCHAR,8,'0')
        WHEN 2 THEN 'NCT'||o_orderkey ELSE ' NCT'||lpad(o_custkey::VARCHAR,8,'0')||' ' END AS t FROM orders)
     SELECT o_orderkey, nullif(upper(regexp_extract(t,'(?i)\\bNCT\\d{8}\\b')),'') AS found, CASE WHEN regexp_full_match(upper(trim(t)),'NCT\\d{8}') THEN upper(trim(t)) END AS strict FROM x""",
)
def nct_extract(spark, sf):
    texts = corpus.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """CASE o_custkey % 4 WHEN 0 THEN concat('registered as nct', lpad(o_orderkey, 8, '0'), '.') WHEN 1 THEN concat('XNCT', lpad(o_orderkey, 8, '0'))
           WHEN 2 THEN concat('NCT', o_orderkey) ELSE concat(' NCT', lpad(o_custkey, 8, '0'), ' ') END AS t""",
    )
    return texts.select(
        "o_orderkey", T.extract_nct(F.col("t")).alias("found"), T.strict_nct(F.col("t")).alias("strict")
    )


@query(
    "clean_text",
    f"""WITH p AS (SELECT doc_id, replace(text, '. ', '.'||chr(173)||chr(10)||' ')||chr(10)||' _Copyright 2024 holder_ '||chr(10)||'© all'||chr(10) AS md, replace(text,' ',chr(160)||chr(13)) AS raw FROM documents)
     SELECT doc_id, md5({sql_strip("array_to_string([rtrim(x," + WS + ") FOR x IN string_split(replace(regexp_replace(md,chr(173)||'\\s*\\n\\s*','','g'),chr(173),''),chr(10)) IF NOT (starts_with(lower(trim(trim(trim(x," + WS + "),'*_')," + WS + ")),'copyright ') OR starts_with(lower(trim(trim(trim(x," + WS + "),'*_')," + WS + ")),'© '))],chr(10))")}) AS page_md5,
      md5(array_to_string([y FOR y IN [{sql_squeeze("x")} FOR x IN string_split(replace(replace(raw,chr(13),chr(10)),chr(160),' '),chr(10))] IF y<>''],chr(10))) AS plain_md5 FROM p""",
)
def clean_text(spark, sf):
    docs = corpus.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.replace(F.col("text"), F.lit(". "), F.lit(".­\n ")), F.lit("\n _Copyright 2024 holder_ \n© all\n")
        ).alias("md"),
        F.replace(F.col("text"), F.lit(" "), F.lit(" \r")).alias("raw"),
    )
    return docs.select(
        "doc_id", F.md5(T.clean_page(F.col("md"))).alias("page_md5"), F.md5(T.clean_plain(F.col("raw"))).alias("plain_md5")
    )


@query(
    "slugs",
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(s),'[^a-z0-9]+','_','g'),'_'),''),'outcome') AS outcome_slug,
      coalesce(nullif(trim(regexp_replace(s,'[^A-Za-z0-9]+','_','g'),'_'),''),'SEGMENT') AS segment_slug,
      coalesce(nullif(trim(regexp_replace(s,'[^A-Za-z0-9_.-]+','-','g'),'-'),''),'item') AS path_slug,
      coalesce(nullif(trim(lower(regexp_replace(s,'[^A-Za-z0-9]','_','g')),'_'),''),'trial') AS ref_slug
     FROM (SELECT p_partkey, p_name||' ('||p_brand||') -- '||p_type||'!' AS s FROM part)""",
)
def slugs(spark, sf):
    s = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") -- "), F.col("p_type"), F.lit("!"))
    return corpus.table(spark, sf, "part").select(
        "p_partkey",
        T.slug_underscore(s).alias("outcome_slug"),
        T.slug_segment(s).alias("segment_slug"),
        T.slug_path(s).alias("path_slug"),
        T.slug_ref(s).alias("ref_slug"),
    )


@query(
    "content_hashes",
    f"""SELECT doc_id, substr(sha256(text),1,12) AS paper_hash, substr(sha256(text),1,16) AS prefix_hash, sha256(text||source||lang) AS inputs_hash,
      md5(array_to_string(({sql_words("text")})[1:500],' ')) AS preamble_md5 FROM documents""",
)
def content_hashes(spark, sf):
    t = F.col("text")
    return corpus.table(spark, sf, "documents").select(
        "doc_id",
        T.hex_digest(t, 12).alias("paper_hash"),
        T.hex_digest(t, 16).alias("prefix_hash"),
        F.sha2(F.concat("text", "source", "lang"), 256).alias("inputs_hash"),
        F.md5(T.preamble(t)).alias("preamble_md5"),
    )


@query(
    "table_like_pages",
    f"""WITH p AS (SELECT doc_id, left(text, n_chars//2)||CASE WHEN doc_id%3=0 THEN ' | --- |' ELSE '' END AS md, CASE WHEN doc_id%2=0 THEN 'Table 2. Missing total: randomised. ' ELSE '' END||text AS raw FROM documents),
     f AS (SELECT *, NOT (contains(md,'|') AND contains(md,'---')) AND regexp_matches(md||chr(10)||raw,'(?i)\\b(table|col\\d+|missing|total)\\b|[|]\\s*---') AS table_like,
      raw<>'' AND regexp_matches(raw,'(?i)\\b(figure|fig\\.?|diagram|consort|table|missing|lost to follow-up|withdrew|withdrawal|randomi[sz]ed)\\b') AND (md='' OR
       ({" OR ".join(f"(contains(lower(raw),'{t}') AND NOT contains(lower(md),'{t}'))" for t in C.STRUCTURED_TERMS)}) OR
       len(list_distinct({sql_words("lower(md)")})) < len({sql_words("raw")})*0.6) AS sparse FROM p)
     SELECT doc_id, table_like, sparse, md5(CASE WHEN sparse THEN concat_ws(chr(10)||chr(10), nullif({sql_strip("md")},''), nullif({sql_strip("'Spatial text fallback:'||chr(10)||raw")},'')) ELSE md END) AS page_md5 FROM f""",
)
def table_like_pages(spark, sf):
    pages = corpus.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "concat(left(text, n_chars div 2), IF(doc_id % 3 = 0, ' | --- |', '')) AS md",
        "concat(IF(doc_id % 2 = 0, 'Table 2. Missing total: randomised. ', ''), text) AS raw",
    )
    md, raw = F.col("md"), F.col("raw")
    return pages.select(
        "doc_id",
        T.looks_table_like(md, raw).alias("table_like"),
        T.needs_text_fallback(md, raw).alias("sparse"),
        F.md5(T.page_text(md, raw)).alias("page_md5"),
    )


_PAGE_LINES = 20


@query(
    "layout_headings",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS line, generate_subscripts(string_split(text,chr(10)),1)-1 AS n FROM documents),
     b AS (SELECT doc_id, n//{_PAGE_LINES} AS page, n, CASE WHEN n%7=0 THEN {sql_list(corpus.PAPER_HEADINGS)}[(doc_id*3+n//7)%{len(corpus.PAPER_HEADINGS)}+1] WHEN n%11=0 THEN '2.'||(n%9)||' Methods used' ELSE line END AS text,
       9.0::DOUBLE + CASE WHEN n%7=0 OR n%11=0 THEN (n%5)*0.75 ELSE (n%3)*0.25 END AS size, n%22=0 AS is_bold FROM l),
     m AS (SELECT *, median(size) OVER (PARTITION BY doc_id, page) AS med, {sql_norm_heading("text")} AS label FROM b)
     SELECT doc_id, page::INT AS page, n::INT AS line_no, text FROM m WHERE label<>'' AND length(label)<=80 AND len({sql_words("label")})<=8
       AND (label IN {sql_in(C.CANONICAL_SECTION_LABELS)} OR ((is_bold OR (med>0 AND size>=med+1.5)) AND (regexp_matches({sql_strip("text")},'^\\d+(\\.\\d+)*\\s+[A-Z]') OR (regexp_matches(text,'^\\p{{Lu}}') AND NOT contains(text,'.')))))""",
)
def layout_headings(spark, sf):
    """Headings by style: lines of a document as boxes with a size and a weight, twenty to a page."""
    lines = corpus.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    listed = ", ".join(f"'{h}'" for h in corpus.PAPER_HEADINGS)
    boxes = lines.selectExpr(
        "doc_id",
        f"n div {_PAGE_LINES} AS page",
        "n AS line_no",
        f"""CASE WHEN n % 7 = 0 THEN array({listed})[CAST((doc_id * 3 + n div 7) % {len(corpus.PAPER_HEADINGS)} AS INT)]
            WHEN n % 11 = 0 THEN concat('2.', n % 9, ' Methods used') ELSE line END AS text""",
        "9.0D + IF(n % 7 = 0 OR n % 11 = 0, (n % 5) * 0.75D, (n % 3) * 0.25D) AS size",
        "n % 22 = 0 AS is_bold",
    )
    found = S.layout_boxes(boxes).where("boxclass = 'section-header'")
    return found.select("doc_id", F.col("page").cast("int").alias("page"), "line_no", "text")
