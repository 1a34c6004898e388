"""Context assembly: prefix, domain text, supplement block, budgets and prompts.

All section work is row-local on one row per document that carries its
sections in order; only the top-k supplement segments are joined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import text as T
from trialsift.operators.retrieval import query_tokens, rerank_sentences


def document_rows(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per document: full_text and `secs`, its sections by start offset.

    Label tests happen once per section row, before collecting; a section is kept in one form only.
    """
    label = F.col("label")
    body = T.strip(F.col("text"))
    in_prefix = T.label_matches(label, C.PREFIX_SECTION_PRIORITY)
    domains = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.array_contains("domain_tags", d) | T.label_matches(label, C.DOMAIN_SECTIONS[d])) & ~in_prefix,
                    F.lit(d),
                )
                for d in C.DOMAINS
            ]
        )
    )
    groups = F.array_compact(
        F.array(
            *[F.when(T.label_matches(label, (n,)), F.lit(n)) for n in C.PREFIX_SECTION_PRIORITY],
            F.when(T.label_matches(label, ("ABSTRACT",)), F.lit("has ABSTRACT")),
            F.when(T.label_matches(label, ("RESULT",)), F.lit("flow")),
            *[F.when(F.upper(label).isin(*names), F.lit(g)) for g, names in C.METADATA_LABELS.items()],
            F.when(T.normalize_heading(label).isin(*C.TOP_LEVEL_SECTION_LABELS), F.lit("top")),
        )
    )
    prepared = sections.select(
        "doc_id",
        "char_start",
        "label",
        "text",
        F.length(body).alias("n_chars"),
        domains.alias("domains"),
        groups.alias("groups"),
    )
    secs = F.array_sort(
        F.collect_list(
            F.struct("char_start", "label", "text", "n_chars", "domains", "groups")
        )
    )
    return prepared.groupBy("doc_id").agg(secs.alias("secs")).join(texts.select("doc_id", "full_text"), "doc_id")


def _formatted(section: Column, form: str = "bracketed") -> Column:
    """A section under its label."""
    if form == "plain":
        return T.strip(F.concat(section["label"], F.lit("\n"), section["text"]))
    return T.strip(F.concat(F.lit("["), section["label"], F.lit("]\n"), T.strip(section["text"])))


def _in_group(name: str) -> Column:
    return F.filter("secs", lambda s: F.array_contains(s["groups"], name))


def _group_parts(group: str, default_label: str, form: str) -> Column:
    """Texts of one label group: the sections if long enough, else a slice of the full text.

    The slice runs from the group's first section to the next top-level one.
    """
    tops = F.transform(_in_group("top"), lambda s: s["char_start"])

    def parts(g: Column) -> Column:
        m = g["m"]
        total = F.aggregate(m, F.lit(0), lambda a, s: a + s["n_chars"])
        start = F.array_min(
            F.transform(F.filter(m, lambda s: s["char_start"] < F.length(g["t"])), lambda s: s["char_start"])
        )
        end = F.coalesce(F.array_min(F.filter(g["tops"], lambda x: x > start)), F.length(g["t"]))
        cut = T.strip(F.substring(g["t"], start + 1, end - start))
        label = F.coalesce(F.get(m, F.lit(0))["label"], F.lit(default_label))
        head = F.concat(F.lit("["), label, F.lit("]\n")) if form == "bracketed" else F.concat(label, F.lit("\n"))
        use_cut = (total < C.MIN_CANONICAL_SECTION_CHARS) & (F.coalesce(cut, F.lit("")) != "")
        return F.when(use_cut, F.array(T.strip(F.concat(head, cut)))).otherwise(
            F.transform(m, lambda s: _formatted(s, form))
        )

    return T.bound(F.struct(_in_group(group).alias("m"), tops.alias("tops"), F.col("full_text").alias("t")), parts)


def prefix_sections() -> Column:
    """METHODS then RESULTS texts for the shared prefix."""
    return F.concat(*[_group_parts(label, label, "bracketed") for label in C.PREFIX_SECTION_PRIORITY])


def metadata_source_text(budget: int = C.METADATA_TOKEN_BUDGET) -> Column:
    """Abstract and methods text for metadata extraction, full text when absent, capped."""
    parts = F.concat(*[_group_parts(g, names[0], "plain") for g, names in C.METADATA_LABELS.items()])
    joined = T.strip(F.array_join(parts, "\n\n"))
    return T.cap_tokens(F.coalesce(F.nullif(joined, F.lit("")), F.col("full_text")), budget)


def shared_prefix(metadata: Column, registry: Column, budget: int = C.PREFIX_TOKEN_BUDGET) -> Column:
    """Trial-static prefix: metadata, registry block, prefix sections; blank parts dropped."""
    parts = F.filter(F.concat(F.array(metadata, registry), prefix_sections()), lambda p: T.strip(p) != "")
    return T.cap_tokens(F.array_join(parts, "\n\n"), budget)


def flow_sentences(boxes: Column | None = None) -> Column:
    """Participant-flow sentences of result sections (then matching boxes), first occurrence kept."""
    results = F.transform(_in_group("flow"), lambda s: s["text"])
    sources = results if boxes is None else F.concat(results, F.filter(boxes, lambda b: b.rlike(C.FLOW_PATTERN)))
    every = F.flatten(F.transform(sources, T.sentences))
    return F.array_distinct(F.filter(every, lambda s: s.rlike(C.FLOW_PATTERN)))


def flow_block(sentences: Column, enrollment: Column) -> Column:
    lines = lambda s: F.when(F.size(s) > 0, F.concat(F.lit("[Participant flow text]\n"), F.array_join(s, "\n")))
    return F.concat_ws(
        "\n",
        T.bound(sentences, lines),
        F.concat(
            F.lit("[ClinicalTrials.gov enrolment count hint] enrollmentInfo.count = "), enrollment.cast("string")
        ),
    )


def domain_contexts(
    rows: DataFrame, flow: Column, comparison: Column, budget: int = C.DOMAIN_TOKEN_BUDGET, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Capped domain text per (document, domain); D3 gets the flow block, D5 the comparison.

    Columns named in `keep` stay beside them.  Texts are finished before they unfold: a filter on what they give
    cannot repeat their work, and each step is bound to be evaluated once.
    """
    picked = F.struct(
        *[
            F.array_join(
                F.transform(F.filter("secs", lambda s: F.array_contains(s["domains"], d)), lambda s: _formatted(s)), "\n\n"
            ).alias(d)
            for d in C.DOMAINS
        ]
    )
    prepared = rows.select(
        "doc_id",
        *keep,
        picked.alias("p"),
        _formatted(F.get(_in_group("has ABSTRACT"), F.lit(0))).alias("abstract"),
        _formatted(F.get("secs", F.lit(0))).alias("first"),
        F.nullif(flow, F.lit("")).alias("flow"),
        F.nullif(comparison, F.lit("")).alias("comparison"),
    )
    extra = {"D3": F.col("flow"), "D5": F.col("comparison")}
    entries = F.array(
        *[
            F.struct(
                F.lit(d).alias("domain"),
                T.strip(F.col(f"p.{d}")).alias("body"),
                extra.get(d, F.lit(None).cast("string")).alias("extra"),
            )
            for d in C.DOMAINS
        ]
    )

    def opened(e: Column) -> Column:
        short = (F.length(e["body"]) < C.DOMAIN_TEXT_MIN_CHARS) & F.col("abstract").isNotNull()
        return F.when(short, T.strip(F.concat_ws("\n\n", "abstract", e["body"]))).otherwise(e["body"])

    def finished(e: Column) -> Column:
        capped = T.bound(opened(e), lambda b: T.cap_tokens(F.when(b == "", F.coalesce("first", F.lit(""))).otherwise(b), budget))
        joined = lambda c: T.strip(F.concat_ws("\n\n", c["text"], e["extra"]))
        whole = T.bound(capped, lambda c: F.when(e["extra"].isNotNull(), T.cap_tokens(joined(c), budget)).otherwise(c))
        report = ("original_tokens", "kept_tokens", "dropped_tokens", "budget_tokens")
        return T.bound(
            whole,
            lambda c: F.struct(
                e["domain"].alias("domain"),
                c["text"].alias("domain_specific_text"),
                F.struct(*[c[n].alias(n) for n in report]).alias("domain_report"),
            ),
        )

    return prepared.select("doc_id", *keep, F.inline(F.transform(entries, finished)))


def supplement_blocks(selected: DataFrame, segments: DataFrame, budget: int = C.SUPPLEMENT_TOKEN_BUDGET) -> DataFrame:
    """Block per (trial, domain) from its few selected segments, in rank order, capped.

    Large segments contribute their best sentences only.
    """
    joined = selected.select("trial_id", "domain", "rank", "doc_id", "seg_ord", "dense").join(
        segments.select("doc_id", "seg_ord", "source_file", "heading", "pages", "body", "char_count"),
        ["doc_id", "seg_ord"],
    )
    body = F.col("body")
    excerpt = None
    for d in C.DOMAINS:
        text = rerank_sentences(body, query_tokens(d), budget)
        excerpt = F.when(F.col("domain") == d, text) if excerpt is None else excerpt.when(F.col("domain") == d, text)
    head = F.concat(
        F.lit("[Supplement: "), "source_file", F.lit("; heading: "), "heading", F.lit("; pages: "),
        F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit("]"),
    )
    block = T.strip(
        F.concat_ws("\n", head, F.when(F.col("char_count") >= C.LARGE_SEGMENT_CHARS, excerpt).otherwise(body))
    )
    merged = (
        joined.withColumn("block", block)
        .groupBy("trial_id", "domain")
        .agg(
            F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_b"),
            F.count(F.lit(1)).alias("segments_retrieved"),
            F.max(F.when(F.col("rank") == 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dense"))))).alias(
                "retrieval_top_score"
            ),
        )
    )
    capped = T.cap_tokens(F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n"), budget)
    return merged.withColumn("_c", capped).select(
        "trial_id",
        "domain",
        F.col("_c.text").alias("supplement_block"),
        F.col("_c").dropFields("text").alias("supplement_report"),
        "segments_retrieved",
        "retrieval_top_score",
    )


def supplement_status(available: Column, block: Column) -> Column:
    return (
        F.when(F.coalesce(available, F.lit(0)) == 0, "none_available")
        .when(F.length(T.strip(F.coalesce(block, F.lit("")))) == 0, "none_selected")
        .otherwise("selected")
    )


def zone_budgets(context_window: Column) -> Column:
    """array of struct(zone, budget_tokens, input_budget): window share, at most the fixed cap."""
    reserved = max(1, C.SQ_MAX_TOKENS + C.REASONING_MAX_TOKENS + C.REASONING_RESERVE_TOKENS)
    window = F.coalesce(context_window, F.lit(C.DEFAULT_CONTEXT_WINDOW))
    available = F.greatest(F.lit(1), window - reserved)
    return F.array(
        *[
            F.struct(
                F.lit(zone).alias("zone"),
                F.least(
                    F.greatest(F.lit(1), F.floor(available * F.lit(share)).cast("int")), F.lit(C.ZONE_LEGACY_BUDGETS[zone])
                ).alias("budget_tokens"),
                available.alias("input_budget"),
            )
            for zone, share in C.ZONE_SHARES.items()
        ]
    )


def trim_degradations(reports: DataFrame, key: list[str]) -> DataFrame:
    """Degradation rows for zones that lost tokens (key, zone, report)."""
    # unfolded, for a filter would be pushed below the reports and make their texts again
    lost = F.filter(F.array(F.struct("zone", "report")), lambda r: r["report"]["dropped_tokens"] > 0)
    return reports.select(*key, F.explode(lost).alias("_r")).select(
        *key,
        F.lit("context_trimmed").alias("category"),
        F.lit("warning").alias("severity"),
        F.concat("_r.zone", F.lit(" exceeded its token budget and was trimmed")).alias("reason"),
        "_r.zone",
        "_r.report.original_tokens",
        "_r.report.kept_tokens",
        "_r.report.dropped_tokens",
        "_r.report.budget_tokens",
    )


def sq_prompts(askable: DataFrame, contexts: DataFrame, templates: DataFrame, key: list[str]) -> DataFrame:
    """User prompt per askable question.

    templates: (sq_id, effect, question_text, answer_definitions), effect
    'both' being the fallback of an effect-specific wording.
    """
    exact = templates.where("effect <> 'both'").select(
        "sq_id", "effect", F.struct("question_text", "answer_definitions").alias("_own")
    )
    both = templates.where("effect = 'both'").select(
        "sq_id", F.struct("question_text", "answer_definitions").alias("_both")
    )
    # by key alone, as the contexts were made: their texts stay where they are and unfold beside their few questions
    question = F.struct(F.concat(F.lit("D"), F.substring("sq_id", 1, 1)).alias("domain"), "sq_id", "effect")
    asked = askable.groupBy(*key).agg(F.collect_list(question).alias("_asked"))
    part = lambda title, body: F.concat(F.lit(f"[{title}]\n"), body)
    sources = F.concat_ws(
        "\n\n",
        part("Domain source text", T.strip(F.col("domain_specific_text"))),
        part("Supplement source text", T.strip(F.coalesce("supplement_block", F.lit("")))),
    )
    own = F.filter("_asked", lambda q: q["domain"] == F.col("domain"))
    joined = (
        contexts.join(asked, key)
        .select(*key, "domain", "shared_prefix", sources.alias("_sources"), F.explode(own).alias("_q"))
        .select(*key, "domain", "shared_prefix", "_sources", "_q.sq_id", "_q.effect")
        # one template row per question and effect
        .join(F.broadcast(exact), ["sq_id", "effect"], "left")
        .join(F.broadcast(both), "sq_id", "left")
        .withColumn("_t", F.coalesce("_own", "_both"))
    )
    suffix = F.concat_ws(
        "\n\n",
        "_sources",
        part("Signaling question", F.col("_t.question_text")),
        part("Answer definitions", F.col("_t.answer_definitions")),
    )
    return joined.select(
        *key,
        "sq_id",
        "domain",
        F.concat_ws("|", "sq_id", "effect").alias("call_label"),
        part("Static trial prefix", F.coalesce("shared_prefix", F.lit(""))).alias("prefix_text"),
        suffix.alias("suffix_text"),
    )


def annotation_prompts(chosen: DataFrame, preambles: DataFrame) -> DataFrame:
    """User prompt per segment picked for annotation."""
    tags = F.array_join("domain_tags", ", ")
    return (
        chosen.where("annotate")
        .join(preambles, "doc_id")
        .select(
            "doc_id",
            "segment_id",
            F.concat(F.lit("supplement_annotation:"), "segment_id").alias("call_label"),
            F.concat(
                F.lit("Document preamble:\n"), "preamble",
                F.lit("\n\nSegment heading: "), "heading",
                F.lit("\nDomain tags: "), F.when(tags == "", "none").otherwise(tags),
                F.lit("\n\nSegment text:\n"), "raw_text",
            ).alias("prompt"),
        )
    )
