"""Quote verification against the texts an answer was allowed to quote.

Quotes meet sources by document: a row holds a document's quotes, its sources and its pages as arrays,
so that a text passes a shuffle once, whatever is quoted from it.  Exact tests come first; the
similarity score is only taken where they leave something open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from trialsift import constants as C
from trialsift.functions.similarity import PIECE, partial_ratio
from trialsift.functions.unicode import normalize_quote
from trialsift.operators.skew import hot_key_join

ANSWER = ["doc_id", "answer_id"]


def page_texts(boxes: DataFrame) -> DataFrame:
    """Box texts of a page in reading order, one row per page."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return boxes.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), " ").alias("text")
    )


def normalized_pages(pages: DataFrame) -> DataFrame:
    """Normalised page text with the next page's text beside it."""
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.select("doc_id", "page", normalize_quote(F.col("text")).alias("page_text")).withColumn(
        "next_text", F.lead("page_text").over(w)
    )


def _certain(quote: str, text: str) -> bool:
    """Score 100 without any fuzzy work: contained, or the text itself lies inside a long quote."""
    return quote in text or (C.QUOTE_MIN_VERIFY_CHARS <= len(quote) >= len(text) and text in quote)


def _score(quote: str, text: str, cutoff: float, enough: float = 100.0) -> float:
    """Verification score, 0 below the cutoff; any that reaches `enough` will do."""
    if not quote or not text:
        return 0.0
    if _certain(quote, text):
        return 100.0
    return partial_ratio(quote, text, cutoff, enough) if len(quote) >= C.QUOTE_MIN_VERIFY_CHARS else 0.0


def _best_scores(pairs: list[tuple[str, str]], cutoff: float) -> list[float]:
    """Scores of (quote, text) pairs: the best one and all that reach it are exact, others may be 0.

    Texts that hold pieces of their quote come first, for a good score spares work on the others.
    """

    def shared(i: int) -> int:
        quote, text = pairs[i]
        return -sum(quote[k : k + PIECE] in text for k in range(0, max(1, len(quote) - PIECE + 1), max(1, len(quote) // 4)))

    scores = [0.0] * len(pairs)
    order = sorted(range(len(pairs)), key=shared) if len(pairs) > 1 else range(len(pairs))
    for i in order:
        scores[i] = _score(*pairs[i], cutoff)
        cutoff = max(cutoff, scores[i])
    return scores


def _held(table: DataFrame, name: str) -> DataFrame:
    """One row a document with its rows of the table as an array."""
    entry = F.struct(*[c for c in table.columns if c != "doc_id"])
    return table.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list(entry).alias(name))


def _told(
    answers: DataFrame, others: dict[str, DataFrame], fields: list[StructField], tell: Callable[..., Iterable[tuple]]
) -> DataFrame:
    """(doc_id, fields): what `tell` gives for each document from its quotes and its rows of the other tables.

    `tell` gets `quotes` by answer and a list of dicts for each other table; a document needs a row of the first one.
    """
    rows = _held(answers.select(*ANSWER, "norm_quote"), "quotes")
    for i, (name, table) in enumerate(others.items()):
        rows = rows.join(_held(table, name), "doc_id", "left" if i else "inner")
    schema = StructType([StructField("doc_id", answers.schema["doc_id"].dataType), *fields])
    arrow, names = to_arrow_schema(schema), list(others)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                # texts are unpacked a document at a time
                given = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                quotes: dict = {}
                for q in given["quotes"]:
                    quotes.setdefault(q["answer_id"], []).append(q["norm_quote"])
                out = [(given["doc_id"], *row) for row in tell(quotes, *(given[name] or [] for name in names))]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, field.type) for column, field in zip(zip(*out), arrow)], schema=arrow
                    )

    return rows.mapInArrow(run, schema)


def normalize_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("norm_quote", normalize_quote(F.coalesce("quote", F.lit(""))))


def normalize_sources(sources: DataFrame) -> DataFrame:
    """sources: doc_id, priority, source_document, text, page_required, source_page."""
    return sources.withColumn("norm_text", normalize_quote(F.coalesce("text", F.lit("")))).drop("text")


def verify(
    answers: DataFrame, sources: DataFrame, cutoff: float = C.QUOTE_VERIFY_THRESHOLD, best_only: bool = False
) -> DataFrame:
    """One scored row per (answer, source); a document has a handful of sources.

    With `best_only` only an answer's best score and the sources that reach it.
    """
    kept = [f for f in sources.schema.fields if f.name not in ("doc_id", "norm_text")]
    fields = [answers.schema["answer_id"], answers.schema["norm_quote"], *kept, StructField("score", DoubleType())]

    def tell(quotes, sources):
        known: dict = {}  # an unfound quote costs most and may be given for many answers
        for answer, texts in quotes.items():
            pairs = [(q, s) for q in texts for s in sources]
            scores = known.get(tuple(texts))
            if scores is None:
                given = [(q, s["norm_text"]) for q, s in pairs]
                scores = known[tuple(texts)] = _best_scores(given, cutoff) if best_only else [_score(*p, cutoff) for p in given]
            least = max(scores) if best_only else 0.0
            for (q, s), score in zip(pairs, scores):
                if score >= least:
                    yield (answer, q, *(s[f.name] for f in kept), score)

    return _told(answers, {"sources": sources}, fields, tell)


def exact_matches(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """First source in priority order that contains the quote verbatim."""
    joined = hot_key_join(answers.select(*ANSWER, "norm_quote"), sources, ["doc_id"], "inner")
    hit = joined.where((F.col("norm_quote") != "") & F.contains(F.col("norm_text"), F.col("norm_quote")))
    return hit.groupBy(*ANSWER).agg(
        F.min("priority").alias("priority"), F.min_by("source_document", "priority").alias("source_document")
    )


#: The hyphen join of `normalize_quote`, for texts that were folded apart.
_OVER_BREAK = r"(?U)(\w)-\s+(\w)"


def _page_sources(pages: DataFrame) -> DataFrame:
    """Pages with `mended`, the text of the page and the next one where a word is broken between them."""
    both = F.trim(F.concat_ws(" ", F.col("page_text"), F.col("next_text")))
    mended = F.regexp_replace(both, _OVER_BREAK, "$1$2")
    return pages.select("doc_id", "page", "page_text", "next_text", F.when(mended != both, mended).alias("mended"))


def page_candidates(quote: str, pages: list[dict]) -> list[tuple[int, str]]:
    """(page, text) of the pages alone and, where the quote may run over, joined with the next."""
    head = " ".join(quote.split(" ")[:2])
    out = []
    for p in pages:
        text = p["page_text"]
        if text is None:
            continue
        out.append((p["page"], text))
        # A word broken at the page's end is whole only in the joined text.
        if p["next_text"] is not None and (head in text or text.endswith("-")):
            out.append((p["page"], p["mended"] or f"{text} {p['next_text']}".strip(" ")))
    return out


def _best_page(quotes: list[str], pages: list[dict], threshold: float) -> tuple[int, float] | None:
    """(page, score) of an answer: an exact page settles it; else the best at the threshold, or without one."""
    tried = [(page, q, text) for q in quotes for page, text in page_candidates(q, pages)]
    exact = [page for page, q, text in tried if text and _certain(q, text)]
    if exact or not tried:
        return (min(exact), 100.0) if exact else None
    pairs = [(q, text) for _, q, text in tried]
    scores = _best_scores(pairs, threshold)
    if max(scores) < threshold:
        scores = _best_scores(pairs, 0.0)
    best = max(scores)
    return min(page for (page, _, _), score in zip(tried, scores) if score == best), best


def locate_pages(
    quotes: DataFrame, pages: DataFrame, threshold: float = C.QUOTE_VERIFY_THRESHOLD
) -> DataFrame:
    """Best page per verified quote: highest score at or over the threshold, earliest page on a tie.

    An exact page settles the quote at score 100.  Verified quotes no page reaches fall back to the
    best page without a threshold.
    """

    def tell(quotes, pages):
        for answer, texts in quotes.items():
            best = _best_page(texts, pages, threshold)
            if best is not None:
                yield (answer, *best)

    fields = [quotes.schema["answer_id"], pages.schema["page"], StructField("page_score", DoubleType())]
    return _told(quotes, {"pages": _page_sources(pages)}, fields, tell)


_SOURCE = ("priority", "source_document", "page_required", "source_page")


def _first_source(quotes: list[str], sources: list[dict], threshold: float) -> dict | None:
    """First source in priority order that verifies one of the quotes.

    Exact tests cover all sources; the fuzzy score is only taken where a source precedes the first exact one.
    """
    exact = None
    for s in sources:
        if s["norm_text"] and any(q and _certain(q, s["norm_text"]) for q in quotes):
            exact = s
            break
        if s["priority"] is None:
            break
    for s in sources:
        if s is exact or s["priority"] is None or (exact is not None and s["priority"] >= exact["priority"]):
            break
        if any(_score(q, s["norm_text"], threshold, threshold) >= threshold for q in quotes):
            return s
    return exact


def _in_order(sources: list[dict]) -> list[dict]:
    return sorted(sources, key=lambda s: (s["priority"] is None, s["priority"] or 0, s["source_document"] or ""))


def first_verifying_source(
    answers: DataFrame, sources: DataFrame, threshold: float = C.QUOTE_VERIFY_THRESHOLD
) -> DataFrame:
    """First source in priority order that verifies each quote."""

    def tell(quotes, sources):
        ordered = _in_order(sources)
        for answer, texts in quotes.items():
            found = _first_source(texts, ordered, threshold)
            if found is not None:
                yield (answer, *(found[c] for c in _SOURCE))

    fields = [answers.schema["answer_id"], *[sources.schema[c] for c in _SOURCE]]
    return _told(answers, {"sources": sources}, fields, tell)


def resolve(
    answers: DataFrame, sources: DataFrame, pages: DataFrame, threshold: float = C.QUOTE_VERIFY_THRESHOLD
) -> DataFrame:
    """Verified flag, page and source per answer, as finalisation needs them.

    `first_verifying_source` and `locate_pages` of a document, in one pass over its texts.
    """

    def tell(quotes, sources, pages):
        ordered = _in_order(sources)
        paged = [s for s in ordered if s["source_page"] is not None or s["page_required"] is False]
        known: dict = {}
        for answer, texts in quotes.items():
            if tuple(texts) not in known:
                known[tuple(texts)] = _first_source(texts, ordered, threshold)
            found = known[tuple(texts)]
            page = None
            if found is not None and found["page_required"] and found["source_page"] is None:
                located = _best_page(texts, pages, threshold)
                if located is None:
                    # A source that needs a page and has none does not count; the next one in order is tried.
                    found = _first_source(texts, paged, threshold)
                else:
                    page = located[0]
            if found is not None:
                yield (answer, *(found[c] for c in _SOURCE), page)

    fields = [answers.schema["answer_id"], *[sources.schema[c] for c in _SOURCE], StructField("_page", pages.schema["page"].dataType)]
    chosen = _told(answers, {"sources": sources, "pages": _page_sources(pages)}, fields, tell)
    resolved = chosen.withColumn("page", F.coalesce("_page", "source_page")).drop("_page")
    return (
        answers.join(resolved, ANSWER, "left")
        .withColumn("quote_found", F.col("priority").isNotNull() & (~F.col("page_required") | F.col("page").isNotNull()))
        .withColumns(
            {
                "page": F.when(F.col("quote_found"), F.col("page")),
                "source_document": F.when(F.col("quote_found"), F.col("source_document")),
            }
        )
        .drop("priority", "page_required", "source_page")
    )


def describe(answers: DataFrame, sources: DataFrame, threshold: float = C.QUOTE_VERIFY_THRESHOLD) -> DataFrame:
    """Audit row per answer: the best-scoring source (not the first verifying one) and why it failed.

    Sources without text are no candidates; an answer that has no others fails for that reason.
    """
    scored = verify(answers, sources.where("norm_text <> ''"), cutoff=0.0, best_only=True)
    best = scored.groupBy(*ANSWER).agg(
        F.max("score").alias("match_score"),
        F.min_by("source_document", F.struct(-F.col("score"), F.col("priority"))).alias("best_source"),
    )
    joined = answers.select(*ANSWER, "norm_quote").join(best, ANSWER, "left")
    score = F.coalesce("match_score", F.lit(0.0))
    verified = (F.col("norm_quote") != "") & (score >= threshold)
    return joined.select(
        *ANSWER,
        verified.alias("verified"),
        score.alias("match_score"),
        F.when(verified, F.col("best_source")).alias("matched_source_document"),
        F.lit("partial_ratio").alias("match_strategy"),
        F.col("norm_quote").alias("normalized_quote"),
        F.lit(threshold).cast("double").alias("threshold"),
        F.when(F.col("norm_quote") == "", "quote is empty")
        .when(F.col("match_score").isNull(), "source text is empty")
        .when(~verified, "quote did not meet verification threshold")
        .alias("failure_reason"),
    )


def faithfulness(described: DataFrame) -> DataFrame:
    """Locate rate and score distribution over described quotes."""
    band = F.least(F.floor(F.col("match_score") / 10) * 10, F.lit(100)).cast("int")
    return described.groupBy(band.alias("score_band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("verified").alias("n_verified"),
        F.count_if(F.col("match_score") >= 98).alias("n_98"),
    )
