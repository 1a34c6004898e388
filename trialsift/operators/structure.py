"""Sections of papers and segments of supplements.

Input is page grain: (doc_id, page, text).  A document is one source row, so
windows and groups by doc_id are bounded by one document; all steps share the
hash partitioning by doc_id and cost a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import text as T


def page_offsets(pages: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:
    """Character offset of every page in the newline-joined text."""
    w = Window.partitionBy(*key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn(
        "page_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    )


def page_lines(offset_pages: DataFrame, label: Column) -> DataFrame:
    """One row per line with its offset in the document and its label; lines are summed by length, without their text."""
    lines = offset_pages.select(
        "doc_id", "page", "page_start", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).select("doc_id", "page", "page_start", "line_no", F.length("line").alias("_chars"), label.alias("label"))
    w = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("_chars") + 1).over(w), F.lit(0))
    return lines.withColumn("offset", (F.col("page_start") + inside).cast("int")).drop("page_start", "_chars")


def paper_headings(offset_pages: DataFrame) -> DataFrame:
    """Lines that carry a canonical section label, first label per offset; `#` marks before it go with the punctuation."""
    label = T.known_heading(F.col("line"), C.CANONICAL_SECTION_LABELS)
    return page_lines(offset_pages, label).where(F.col("label").isNotNull()).select("doc_id", "page", "offset", "label")


def dedupe_headings(headings: DataFrame) -> DataFrame:
    """Keep one heading per offset (label order decides a tie)."""
    return headings.groupBy("doc_id", "offset").agg(
        F.min_by("label", "label").alias("label"), F.min("page").alias("page")
    )


def is_layout_heading(
    text: Column, is_bold: Column, size: Column, page_median: Column
) -> Column:
    """Layout-line classifier on style and shape."""
    label = T.normalize_heading(text)
    short = (label != "") & (F.length(label) <= 80) & (F.size(T.words(label)) <= 8)
    styled = is_bold | ((page_median > 0) & (size >= page_median + 1.5))
    numbered = T.strip(text).rlike(r"^\d+(\.\d+)*\s+[A-Z]")
    title = text.rlike(r"^\p{Lu}") & ~F.contains(text, F.lit("."))
    return short & (label.isin(*C.CANONICAL_SECTION_LABELS) | (styled & (numbered | title)))


def layout_boxes(lines: DataFrame) -> DataFrame:
    """Classify layout lines (doc_id, page, text, size, is_bold) against the page's median size."""
    medians = lines.groupBy("doc_id", "page").agg(F.percentile("size", F.lit(0.5)).alias("page_median"))
    return lines.join(medians, ["doc_id", "page"]).withColumn(
        "boxclass",
        F.when(
            is_layout_heading(F.col("text"), F.col("is_bold"), F.col("size"), F.col("page_median")), "section-header"
        ).otherwise("text"),
    )


def document_texts(offset_pages: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:
    """Full text and page starts per document (or per window of one)."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "page_start", "text")))
    return offset_pages.groupBy(*key).agg(ordered.alias("_p")).select(
        *key,
        F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("full_text"),
        F.transform("_p", lambda p: p["page_start"]).alias("page_starts"),
    )


def pages_for_range(start: Column, end: Column, page_starts: Column, first_page: Column | int = 0) -> Column:
    """Pages whose start lies in [start, end), and the page `start` falls on."""
    base = F.lit(first_page) if isinstance(first_page, int) else first_page
    indexed = F.transform(page_starts, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    inside = F.transform(
        F.filter(indexed, lambda p: (p["s"] >= start) & (p["s"] < end)), lambda p: p["i"]
    )
    on = F.coalesce(
        F.array_max(F.transform(F.filter(indexed, lambda p: p["s"] <= start), lambda p: p["i"])), F.lit(0)
    )
    return F.transform(F.array_sort(F.array_distinct(F.concat(F.array(on), inside))), lambda i: (i + base).cast("int"))


def build_sections(pages: DataFrame) -> DataFrame:
    """Sections with bounds, pages, text and tags.

    A top-level section ends at the next top-level heading, any other at the
    next heading; a document without headings is one FULL_TEXT section and an
    empty one a degraded FULL_TEXT section with all tags.
    """
    offset_pages = page_offsets(pages)
    texts = document_texts(offset_pages)
    heads = dedupe_headings(paper_headings(offset_pages))
    w = Window.partitionBy("doc_id").orderBy("offset")
    top = F.col("label").isin(*C.TOP_LEVEL_SECTION_LABELS)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    bounded = heads.select(
        "doc_id",
        "label",
        F.col("offset").alias("char_start"),
        F.when(top, F.min(F.when(top, F.col("offset"))).over(later)).otherwise(F.lead("offset").over(w)).alias("_end"),
    )
    full_length = F.length("full_text")
    located = (
        texts.join(bounded, "doc_id", "left")
        .where(F.col("char_start").isNull() | (F.col("char_start") < full_length))
        .withColumns(
            {
                "char_start": F.coalesce("char_start", F.lit(0)),
                "char_end": F.coalesce("_end", full_length),
                "_whole": F.col("label").isNull(),
                "label": F.coalesce("label", F.lit("FULL_TEXT")),
            }
        )
    )
    body = F.expr("substring(full_text, char_start + 1, char_end - char_start)")
    with_text = located.withColumn("text", F.when(F.col("_whole"), F.col("full_text")).otherwise(T.strip(body)))
    degraded = T.strip(F.col("full_text")) == ""
    pages_all = F.sequence(F.lit(0), F.size("page_starts") - 1)
    return with_text.select(
        "doc_id",
        "label",
        F.when(F.col("_whole"), pages_all)
        .otherwise(pages_for_range(F.col("char_start"), F.col("char_end"), F.col("page_starts")))
        .alias("pages"),
        "char_start",
        "char_end",
        "text",
        F.when(degraded, T.ALL_TAGS()).otherwise(T.domain_tags(F.col("label"), F.col("text"))).alias("domain_tags"),
        F.when(degraded, "DEGRADED").otherwise("STANDARD").alias("parsing_quality"),
    )


# --------------------------------------------------------------------------
# supplements

def heading_of_line(line: Column) -> Column:
    """Heading text of a `#` line, null for other lines."""
    bare = T.strip(line)
    body = T.strip(T.strip(T.strip(F.ltrim(bare, F.lit("#"))), "*_"))
    flat = T.squeeze(F.replace(F.replace(body, F.lit("**"), F.lit(" ")), F.lit("__"), F.lit(" ")))
    return F.when(F.ltrim(line, F.lit(T.WHITESPACE)).startswith("#") & (flat != ""), flat)


def supplement_windows(pages: DataFrame, size: int = C.PARSE_WINDOW_PAGES) -> DataFrame:
    """One row per window of consecutive pages, with its text, page starts and headings.

    A window never holds more than `size` pages, so its row stays small.
    """
    win = pages.withColumn("window_no", F.floor(F.col("page") / size).cast("int")).withColumn(
        "headings", F.array_compact(F.transform(F.split("text", "\n"), heading_of_line))
    )
    ordered = F.array_sort(F.collect_list(F.struct("page", "text", "headings")))
    grouped = win.groupBy("doc_id", "window_no").agg(ordered.alias("_p"))
    lengths = F.transform("_p", lambda p: F.length(p["text"]) + 1)
    # at most `size` pages: prefix sums by slicing stay cheap, once the texts are measured
    starts = T.bound(
        lengths,
        lambda ls: F.transform(ls, lambda _, i: F.aggregate(F.slice(ls, 1, i), F.lit(0), lambda a, b: a + b)),
    )
    return grouped.select(
        "doc_id",
        "window_no",
        (F.col("window_no") * size).alias("first_page"),
        F.array_join(F.transform("_p", lambda p: p["text"]), "\n").alias("full_text"),
        starts.alias("page_starts"),
        F.transform(F.filter("_p", lambda p: T.strip(p["text"]) != ""), lambda p: p["page"]).alias("text_pages"),
        F.flatten(
            F.transform(
                "_p",
                lambda p, i: F.transform(p["headings"], lambda h: F.struct(i.alias("i"), p["page"].alias("page"), h.alias("h"))),
            )
        ).alias("headings"),
    )


def document_types(windows: DataFrame) -> DataFrame:
    """Type vote per document over headings of its first pages."""
    heads = windows.select("doc_id", F.explode_outer("headings").alias("h")).select(
        "doc_id",
        F.coalesce(F.when(F.col("h.page") < C.DOCTYPE_SCAN_PAGES, F.lower("h.h")), F.lit("")).alias("head"),
    )
    scores = []
    for doc_type, lexicon in C.DOC_TYPE_LEXICONS.items():
        terms = [f"(length(head) - length(replace(head, '{t}', ''))) div {len(t)}" for t in lexicon]
        scores.append(F.expr(f"sum({' + '.join(terms)})").alias(doc_type))
    voted = heads.groupBy("doc_id").agg(*scores)
    names = list(C.DOC_TYPE_LEXICONS)
    best = F.greatest(*names)
    choice = F.when(best <= 0, "unknown")
    for name in names:  # lexicon order is the tie-break order
        choice = choice.when(F.col(name) == best, name)
    return voted.select("doc_id", choice.alias("doc_type"), best.cast("int").alias("votes"))


def cut_segments(windows: DataFrame) -> DataFrame:
    """Segments between headings of each window, in document order."""
    found = windows.withColumn(
        "cuts",
        F.array_sort(
            F.array_distinct(
                F.transform(
                    "headings",
                    lambda h: F.struct(
                        F.greatest(
                            F.expr("0"),
                            F.call_function(
                                "locate", h["h"], F.col("full_text"), F.get("page_starts", h["i"]) + 1
                            )
                            - 1,
                            F.get("page_starts", h["i"]),
                        ).alias("start"),
                        T.normalize_heading(h["h"]).alias("heading"),
                    ),
                )
            )
        ),
    )
    n = F.size("cuts")
    pieces = F.transform(
        "cuts",
        lambda c, i: F.struct(
            c["heading"].alias("heading"),
            c["start"].alias("start"),
            F.coalesce(F.get(F.col("cuts"), i + 1)["start"], F.length("full_text")).alias("end"),
        ),
    )
    whole = F.array(
        F.struct(
            F.concat(F.lit("WINDOW_"), "window_no").alias("heading"),
            F.lit(0).alias("start"),
            F.length("full_text").alias("end"),
        )
    )
    cut = found.select(
        "doc_id",
        "window_no",
        "first_page",
        "full_text",
        "page_starts",
        (n == 0).alias("whole"),
        F.posexplode(F.when(n == 0, whole).otherwise(pieces)).alias("cut_no", "c"),
    )
    raw = T.strip(F.expr("substring(full_text, c.start + 1, c.end - c.start)"))
    kept = cut.withColumn("raw_text", raw).where(F.col("whole") | (F.col("raw_text") != ""))
    w = Window.partitionBy("doc_id", "window_no").orderBy("cut_no")
    numbered = kept.withColumn("segment_no", F.row_number().over(w) - 1)
    return numbered.select(
        "doc_id",
        "window_no",
        "segment_no",
        F.when(
            F.col("whole"), F.concat_ws("__", F.lit("doc"), F.col("c.heading"), F.lit("0"))
        )
        .otherwise(
            F.concat(
                F.lit("doc__"), T.slug_segment(F.col("c.heading")), F.lit("__"), "window_no", F.lit("_"), "segment_no"
            )
        )
        .alias("segment_id"),
        F.col("c.heading").alias("heading"),
        pages_for_range(F.col("c.start"), F.col("c.end"), F.col("page_starts"), F.col("first_page")).alias("pages"),
        "raw_text",
        F.when(F.col("whole"), T.ALL_TAGS()).otherwise(T.domain_tags(F.col("c.heading"), F.col("raw_text"))).alias(
            "domain_tags"
        ),
        F.length("raw_text").alias("char_count"),
    )


def is_junk_heading(heading: Column) -> Column:
    norm = F.replace(T.normalize_heading(heading), F.lit("_"), F.lit(" "))
    parts = T.words(norm)
    n = F.size(parts)
    pattern_hit = None
    for pattern in C.JUNK_HEADING_PATTERNS:
        hit = norm.rlike(pattern)
        pattern_hit = hit if pattern_hit is None else pattern_hit | hit
    form_label = (n > 0) & (F.size(F.array_except(parts, F.array(*[F.lit(x) for x in C.FORM_LABELS]))) == 0)
    letters = F.length(F.regexp_replace(norm, r"[^\p{L}]", ""))
    marks = F.length(F.regexp_replace(heading, r"[^!-/:-@\[-`{-~]", ""))
    return (
        (n > 12)
        | ((n > 8) & ~norm.rlike(r"^\d+(\.\d+)*\s+"))
        | ((F.length(norm) <= 3) & (norm != "SAP"))
        | pattern_hit
        | ((n <= 4) & T.strip(heading).endswith(":"))
        | ((n <= 3) & form_label)
        | ((letters > 0) & (letters <= 10) & (marks >= letters))
    )


def mark_fragments(segments: DataFrame) -> DataFrame:
    """Flag junk, recurring-furniture and tiny segments."""
    norm = T.normalize_heading(F.col("heading"))
    per_heading = Window.partitionBy("doc_id", "_norm")
    recurring = (
        (F.count(F.lit(1)).over(per_heading) >= 3)
        & (F.size(T.words(F.col("_norm"))) <= 8)
        & F.col("_norm").rlike(r"\p{L}")
    )
    return (
        segments.withColumn("_norm", norm)
        .withColumn(
            "is_fragment",
            is_junk_heading(F.col("heading")) | recurring | (F.col("char_count") < C.MIN_SEGMENT_CHARS),
        )
        .drop("_norm")
    )


def merge_fragments(marked: DataFrame) -> DataFrame:
    """Fold fragments into the segment before them; a leading fragment opens the document.

    The ordered fold is a gaps-and-islands sum: a new island starts at every
    non-fragment and at the first row.
    """
    w = Window.partitionBy("doc_id").orderBy("window_no", "segment_no")
    starts = F.when(~F.col("is_fragment") | (F.row_number().over(w) == 1), 1).otherwise(0)
    marked = marked.withColumn("_start", starts).withColumn("seg_ord", F.sum("_start").over(w) - 1)
    order = F.struct("window_no", "segment_no")
    first = lambda c: F.min_by(c, order)
    parts = F.array_sort(
        F.collect_list(F.struct("window_no", "segment_no", "raw_text", "pages", "domain_tags"))
    )
    merged = marked.groupBy("doc_id", "seg_ord").agg(
        first("segment_id").alias("segment_id"),
        F.when(first("is_fragment"), "WINDOW_START").otherwise(first("heading")).alias("heading"),
        parts.alias("_parts"),
    )
    text = F.array_join(
        F.filter(F.transform("_parts", lambda p: p["raw_text"]), lambda t: t != ""), "\n\n"
    )
    union = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda p: p[name]))))
    return merged.select(
        "doc_id",
        F.col("seg_ord").cast("int").alias("seg_ord"),
        "segment_id",
        "heading",
        union("pages").alias("pages"),
        text.alias("raw_text"),
        union("domain_tags").alias("domain_tags"),
        F.length(text).alias("char_count"),
    )


_SEGMENT_COLUMNS = (
    "doc_id", "doc_type", "seg_ord", "segment_id", "heading", "pages", "raw_text", "domain_tags", "char_count",
)


def segment_documents(pages: DataFrame) -> DataFrame:
    """Segments of every supplement with the document-level guards applied."""
    windows = supplement_windows(pages)
    merged = merge_fragments(mark_fragments(cut_segments(windows)))
    counts = merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    decided = (
        document_types(windows)
        .select("doc_id", "doc_type")
        .join(counts, "doc_id", "left")
        .withColumn(
            "_regular",
            ~F.col("doc_type").isin(*C.LOW_YIELD_DOC_TYPES)
            & F.coalesce(F.col("_n").between(C.MIN_SEGMENTS, C.MAX_SEGMENTS_PER_DOC), F.lit(False)),
        )
        .drop("_n")
    )
    kept = merged.join(decided.where("_regular"), "doc_id").select(*_SEGMENT_COLUMNS)
    whole = whole_documents(windows.join(decided.where("NOT _regular"), "doc_id"))
    return kept.unionByName(whole)


def whole_documents(windows: DataFrame) -> DataFrame:
    """Fallback segments: per-window parts of long documents, else one full-document segment."""
    ordered = F.array_sort(
        F.collect_list(F.struct("window_no", "full_text", "text_pages", "first_page", F.size("page_starts").alias("n")))
    )
    docs = windows.groupBy("doc_id", "doc_type").agg(ordered.alias("w"))
    total = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x["full_text"]))
    full = T.strip(F.array_join(F.transform("w", lambda x: x["full_text"]), "\n"))
    range_of = lambda x: F.sequence(x["first_page"], x["first_page"] + x["n"] - 1)
    pages_of = lambda x: F.when(F.size(x["text_pages"]) > 0, x["text_pages"]).otherwise(range_of(x))
    text_pages = F.flatten(F.transform("w", lambda x: x["text_pages"]))
    all_pages = F.flatten(F.transform("w", range_of))

    def part(x: Column) -> Column:
        heading = F.concat(F.lit("FULL_DOCUMENT_PART_"), x["window_no"] + 1)
        body = T.strip(x["full_text"])
        return F.struct(
            F.concat(F.lit("doc__"), heading, F.lit("__"), x["window_no"]).alias("segment_id"),
            heading.alias("heading"),
            pages_of(x).alias("pages"),
            body.alias("raw_text"),
            T.domain_tags(heading, body).alias("domain_tags"),
            F.length(body).alias("char_count"),
        )

    one = F.struct(
        F.lit("doc__FULL_DOCUMENT__0").alias("segment_id"),
        F.lit("FULL_DOCUMENT").alias("heading"),
        F.when(F.size(text_pages) > 0, text_pages).otherwise(all_pages).alias("pages"),
        full.alias("raw_text"),
        T.ALL_TAGS().alias("domain_tags"),
        F.length(full).alias("char_count"),
    )
    parts = F.transform(F.filter("w", lambda x: T.strip(x["full_text"]) != ""), part)
    split = (
        ~F.col("doc_type").isin(*C.LOW_YIELD_DOC_TYPES)
        & (F.size("w") > 1)
        & (total > C.LARGE_SEGMENT_CHARS)
        & (F.size(parts) > 0)
    )
    return docs.select(
        "doc_id", "doc_type", F.posexplode(F.when(split, parts).otherwise(F.array(one))).alias("seg_ord", "s")
    ).select("doc_id", "doc_type", "seg_ord", "s.*").select(*_SEGMENT_COLUMNS)


def annotation_choice(segments: DataFrame) -> DataFrame:
    """Mark the segments to annotate: most tags first, inside the document type's budget."""
    budget = (
        F.when(F.col("doc_type").isin(*C.LOW_YIELD_DOC_TYPES), 0)
        .when(F.col("doc_type") == "unknown", min(C.MAX_ANNOTATIONS_PER_DOC, C.UNKNOWN_TYPE_ANNOTATIONS))
        .otherwise(C.MAX_ANNOTATIONS_PER_DOC)
    )
    tagged = F.size("domain_tags") > 0
    w = Window.partitionBy("doc_id").orderBy(F.desc(tagged), F.desc(F.size("domain_tags")), "segment_id")
    return segments.withColumn("annotate", tagged & (F.row_number().over(w) <= budget))


def apply_annotations(chosen: DataFrame, annotations: DataFrame) -> DataFrame:
    """Join annotation results (doc_id, segment_id, annotation, annotation_error) and set the status."""
    # by document, as the segments were ranked: their texts stay where they are
    result = F.struct("segment_id", "annotation", "annotation_error")
    of_document = annotations.groupBy("doc_id").agg(F.collect_list(result).alias("_results"))
    own = F.filter("_results", lambda r: r["segment_id"] == F.col("segment_id"))
    joined = (
        chosen.join(of_document, "doc_id", "left")
        .withColumn("_own", F.explode_outer(own))
        .select(*chosen.columns, "_own.annotation", "_own.annotation_error")
    )
    text = F.trim("annotation")
    failed = F.col("annotation_error").isNotNull()
    empty = (F.coalesce(text, F.lit("")) == "") | (text == C.NO_RISK_ANNOTATION)
    status = (
        F.when(~F.col("annotate"), "not_run")
        .when(failed | F.col("annotation").isNull(), "failed")
        .when(empty, "succeeded_empty")
        .otherwise("succeeded_substantive")
    )
    return joined.withColumns(
        {
            "annotation_status": status,
            "annotation": F.when(status == "succeeded_substantive", text).otherwise(C.NO_RISK_ANNOTATION),
            "annotation_error": F.when(status == "failed", F.coalesce("annotation_error", F.lit("no result"))),
        }
    )


def searchable_text(segments: DataFrame) -> Column:
    """Annotation plus raw text, raw text alone while the annotation is only a placeholder."""
    placeholder = F.col("annotation_status").isin("not_run", "failed") & (F.col("annotation") == C.NO_RISK_ANNOTATION)
    return F.when(placeholder, T.strip(F.col("raw_text"))).otherwise(
        T.strip(F.concat(F.col("annotation"), F.lit("\n\n"), F.col("raw_text")))
    )
