"""Hybrid retrieval: BM25 and cosine lists fused by reciprocal rank.

Query vocabularies are fixed and small, so term counts are taken inside each
segment row and only vocabulary terms ever reach a shuffle.  A trial may own a
large share of all segments: per-trial statistics are combined map-side, joined
with hot keys split, and ranks come from `exact_rank`, which spreads a group.
"""

from __future__ import annotations

from collections import Counter
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialsift import constants as C
from trialsift.functions import text as T
from trialsift.operators.skew import exact_rank, hot_key_join, top_per_group
from trialsift.session import materialize

SEG_KEY = ["doc_id", "seg_ord"]
#: Trials whose statistics (at most one entry per vocabulary term each) are sent to every task; more are joined by a shuffle.
BROADCAST_TRIALS = 10_000


def query_tokens(domain: str) -> dict[str, int]:
    """Tokens of a domain's query with their multiplicity."""
    found = re.findall(C.TOKEN_PATTERN, " ".join(C.domain_key_terms(domain)))
    return dict(sorted(Counter(t.lower() for t in found).items()))


def vocabulary(domains=C.DOMAINS) -> list[str]:
    return sorted({t for d in domains for t in query_tokens(d)})


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def term_counts(segments: DataFrame, text: str, vocab: list[str]) -> DataFrame:
    """Add doc_len and tf (map of vocabulary terms present in the row)."""
    return (
        segments.withColumn("_tokens", T.tokens(F.col(text)))
        .withColumn("_present", F.expr(f"array_intersect(_tokens, array({_sql_list(vocab)}))"))
        .withColumn("doc_len", F.size("_tokens"))
        .withColumn(
            "tf",
            F.expr(
                "map_from_entries(transform(_present, t -> struct(t, size(filter(_tokens, x -> x = t)))))"
            ),
        )
        .drop("_tokens", "_present")
    )


def index_statistics(counted: DataFrame, domains=C.DOMAINS) -> DataFrame:
    """One row per trial: n_docs, avg_len, tagged counts per domain, df map."""
    sizes = counted.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg("doc_len").alias("avg_len"),
        *[F.expr(f"count_if(array_contains(domain_tags, '{d}'))").alias(f"n_{d}") for d in domains],
    )
    df = (
        counted.select("trial_id", F.explode(F.map_keys("tf")).alias("token"))
        .groupBy("trial_id", "token")
        .agg(F.count(F.lit(1)).alias("df"))
        .groupBy("trial_id")
        # at most one entry per vocabulary term
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("df"))
    )
    return sizes.join(df, "trial_id", "left")


def _bm25_sql(tokens: dict[str, int]) -> str:
    entries = ", ".join(f"struct('{t}' AS t, {m} AS m)" for t, m in tokens.items())
    k1, b = C.BM25_K1, C.BM25_B
    idf = "ln(1D + (n_docs - df[q.t] + 0.5D) / (df[q.t] + 0.5D))"
    norm = f"(tf[q.t] + {k1}D * (1D - {b}D + {b}D * doc_len / greatest(avg_len, 1D)))"
    term = f"q.m * {idf} * (tf[q.t] * {k1 + 1}D) / {norm}"
    return (
        f"aggregate(filter(array({entries}), q -> map_contains_key(tf, q.t)), 0D, (acc, q) -> acc + {term})"
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; a zero vector scores 0."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def document_cosines(vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """dense_of: cosine with each domain's query vector, by domain, once a row of `vectors` (doc_id, vec); null without a vector.

    A document's segments share its vector: they carry these few numbers through joins instead.
    """
    asked = query_vectors.where("domain IS NOT NULL").agg(F.collect_list(F.struct("domain", "query_vec")).alias("_asked"))
    scores = F.transform("_asked", lambda q: F.struct(q["domain"], cosine(q["query_vec"], F.col("vec"))))
    # five query vectors
    return vectors.crossJoin(F.broadcast(asked)).select(
        "doc_id", F.when(F.col("vec").isNotNull(), F.map_from_entries(scores)).alias("dense_of")
    )


def candidates(
    segments: DataFrame, text: str, query_vectors: DataFrame | None = None, domains=C.DOMAINS
) -> DataFrame:
    """Candidate rows per (trial, domain) with bm25 and dense scores.

    segments: trial_id, doc_id, seg_ord, domain_tags, optional vec or what `document_cosines` makes of it, and `text`
    or what `term_counts` makes of it.
    A domain's candidates are its tagged segments, or all of the trial's when
    fewer than two are tagged.
    """
    vocab = vocabulary(domains)
    dense = [] if query_vectors is None else ["dense_of" if "dense_of" in segments.columns else "vec"]
    keep = ["trial_id", *SEG_KEY, "domain_tags", *dense]
    if "tf" in segments.columns:
        counted = segments.select(*keep, "doc_len", "tf")
    else:
        counted = term_counts(segments.select(*keep, text), text, vocab).drop(text)
    statistics = materialize(index_statistics(counted, domains))
    if statistics.count() <= BROADCAST_TRIALS:
        scored = counted.join(F.broadcast(statistics), "trial_id")
    else:
        scored = hot_key_join(counted, statistics, ["trial_id"], "inner")
    per_domain = ", ".join(
        f"struct('{d}' AS domain, array_contains(domain_tags, '{d}') AS tagged, n_{d} AS n_tagged, "
        f"{_bm25_sql(query_tokens(d))} AS bm25)"
        for d in domains
    )
    rows = scored.select(
        "trial_id", *SEG_KEY, *dense, F.expr(f"inline(array({per_domain}))")
    ).where("tagged OR n_tagged < 2")
    if query_vectors is None:
        return rows.withColumn("dense", F.lit(None).cast("double")).drop("tagged", "n_tagged")
    if dense == ["dense_of"]:
        known = rows.join(F.broadcast(query_vectors.select("domain")), "domain")
        return known.withColumn("dense", F.col("dense_of")[F.col("domain")]).drop("dense_of", "tagged", "n_tagged")
    # five query vectors
    joined = rows.join(F.broadcast(query_vectors.select("domain", "query_vec")), "domain")
    return joined.withColumn(
        "dense", F.when(F.col("vec").isNotNull(), cosine(F.col("query_vec"), F.col("vec")))
    ).drop("vec", "query_vec", "tagged", "n_tagged")


def fuse(scored: DataFrame, k: int = C.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion; each list ranks only its positive scores, ties by index order.

    Candidates without any positive score stay in with rrf 0.
    """
    group = ["trial_id", "domain"]
    index = [F.asc(c) for c in SEG_KEY]
    base = scored.select(*group, *SEG_KEY, "bm25", "dense")
    parts = [base.withColumns({"bm25_rank": F.lit(None).cast("int"), "dense_rank": F.lit(None).cast("int")})]
    for name in ("bm25", "dense"):
        listed = base.where(F.col(name) > 0).select(*group, *SEG_KEY, name)
        ranked = exact_rank(listed, group, [F.desc(name), *index], "_r")
        parts.append(
            ranked.select(
                *group,
                *SEG_KEY,
                F.lit(None).cast("double").alias("bm25"),
                F.lit(None).cast("double").alias("dense"),
                (F.col("_r") if name == "bm25" else F.lit(None)).cast("int").alias("bm25_rank"),
                (F.col("_r") if name == "dense" else F.lit(None)).cast("int").alias("dense_rank"),
            )
        )
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # the key is unique per candidate, so this grouping cannot be skewed
    fused = merged.groupBy(*group, *SEG_KEY).agg(
        *[F.max(c).alias(c) for c in ("bm25", "dense", "bm25_rank", "dense_rank")]
    )
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return fused.withColumn("rrf", share("bm25_rank") + share("dense_rank"))


def rank_bound(top_k: int, k: int = C.RRF_K) -> int:
    """Rank past which a candidate of both lists cannot be among the first top_k.

    The first top_k of a list score 1 / (k + top_k) at least; two ranks past this one score less together.
    """
    return k + 2 * top_k


def fused_top(scored: DataFrame, top_k: int = C.RETRIEVAL_TOP_K, k: int = C.RRF_K) -> DataFrame:
    """The first top_k of `fuse` per (trial, domain), with `rank`, without ranking the lists whole.

    Only the first `rank_bound` rows of either list can win, and Spark cuts each task to these before it
    shuffles.  Where such a row stands further down in the other list, its rank is the number of
    that list's rows up to it: the rows are counted between these few places, map-side, and never sorted.
    `scored` is read several times and should be a stored table.
    """
    group, lists = ["trial_id", "domain"], ("bm25", "dense")
    index = [F.asc(c) for c in SEG_KEY]
    base = scored.select(*group, *SEG_KEY, *lists)
    bound = rank_bound(top_k, k)
    # without a positive score: in with 0, the first by index order
    rest = base.where(~F.coalesce(F.col("bm25") > 0, F.lit(False)) & ~F.coalesce(F.col("dense") > 0, F.lit(False)))
    found = top_per_group(rest, group, index, top_k, "_r").drop("_r").withColumns({f"{c}_rank": F.lit(None).cast("int") for c in lists})
    for name in lists:
        first = top_per_group(base.where(F.col(name) > 0), group, [F.desc(name), *index], bound, f"{name}_rank")
        found = found.unionByName(first.withColumns({f"{c}_rank": F.lit(None).cast("int") for c in lists if c != name}))
    # at most 2 * bound + top_k rows a group from here on
    found = found.groupBy(*group, *SEG_KEY).agg(*[F.max(c).alias(c) for c in (*lists, "bm25_rank", "dense_rank")])
    found = materialize(found)

    def place(name: str) -> Column:
        return F.struct((-F.col(name)).alias("neg"), *SEG_KEY)

    open_ = {c: (F.col(c) > 0) & F.col(f"{c}_rank").isNull() for c in lists}
    def before(name: str) -> Column:
        """Asked places that stand before this row in the list."""
        return F.size(F.filter(f"_{name}", lambda t: t < place(name)))

    asked = found.groupBy(*group).agg(
        *[F.array_sort(F.collect_list(F.when(open_[c], place(c)))).alias(f"_{c}") for c in lists]  # bounded as above
    )
    asked = asked.where(" OR ".join(f"size(_{c}) > 0" for c in lists))
    rows = hot_key_join(base, asked, group, "inner")
    passed = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.when(F.col(c) > 0, before(c)).alias("at"),
                F.size(f"_{c}").alias("n"),
            )
            for c in lists
        ]
    )
    counts = rows.select(*group, F.inline(passed)).where("at < n").groupBy(*group, "name", "at").agg(F.count(F.lit(1)).alias("_n"))
    # places without a row of their own do not occur: every place is a row of the list
    upto = Window.partitionBy(*group, "name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_rank", F.sum("_n").over(upto).cast("int"))
    places = asked.select(*group, F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_{c}").alias("_p")) for c in lists])))
    places = places.select(*group, "name", F.posexplode("_p").alias("at", "_p"))
    ranks = places.join(counts, [*group, "name", "at"]).groupBy(*group, *[F.col(f"_p.{c}").alias(c) for c in SEG_KEY])
    ranks = ranks.agg(*[F.max(F.when(F.col("name") == c, F.col("_rank"))).alias(f"_{c}_rank") for c in lists])
    whole = found.join(ranks, [*group, *SEG_KEY], "left")
    whole = whole.withColumns({f"{c}_rank": F.coalesce(f"{c}_rank", f"_{c}_rank") for c in lists}).drop(*[f"_{c}_rank" for c in lists])
    share = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return select_top(whole.withColumn("rrf", share("bm25_rank") + share("dense_rank")), top_k)


def select_top(fused: DataFrame, top_k: int = C.RETRIEVAL_TOP_K) -> DataFrame:
    order = [F.desc("rrf"), *[F.asc(c) for c in SEG_KEY]]
    return top_per_group(fused, ["trial_id", "domain"], order, top_k, "rank")


def top_relevance(selected: DataFrame) -> DataFrame:
    """Clamped cosine of the first-ranked segment, null without a dense score."""
    return selected.where("rank = 1").select(
        "trial_id",
        "domain",
        F.when(F.col("dense").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dense")))).alias("top_score"),
    )


def rerank_sentences(text: Column, query: dict[str, int], budget: int) -> Column:
    """Best sentences of a large segment within a token budget, in original order.

    The greedy fill skips what does not fit and goes on, so it is an ordered
    fold rather than a prefix sum.
    """
    entries = ", ".join(f"struct('{t}' AS t, {m} AS m)" for t, m in query.items())
    items = F.transform(
        T.sentences(text),
        lambda s, i: F.struct(i.alias("i"), s.alias("s"), T.tokens(s).alias("toks")),
    )
    # "(acc, e)" folds below run over one segment's sentences
    weighed = F.transform(
        items,
        lambda e: F.struct(
            (-F.aggregate(
                F.expr(f"array({entries})"),
                F.lit(0),
                lambda acc, q: acc + q["m"] * F.size(F.filter(e["toks"], lambda t: t == q["t"])),
            )).alias("neg"),
            e["i"].alias("i"),
            F.size(e["toks"]).alias("n"),
            e["s"].alias("s"),
        ),
    )
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,s:string>>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        full = acc["used"] >= budget
        too_large = (acc["used"] > 0) & (acc["used"] + e["n"] > budget)
        add = F.struct(
            (acc["used"] + e["n"]).alias("used"),
            F.concat(acc["kept"], F.array(F.struct(e["i"].alias("i"), e["s"].alias("s")))).alias("kept"),
        )
        return F.when(full | too_large, acc).otherwise(add)

    return F.aggregate(
        F.array_sort(weighed),
        empty,
        step,
        lambda acc: F.array_join(F.transform(F.array_sort(acc["kept"]), lambda e: e["s"]), " "),
    )


def recall_at_k(selected: DataFrame, gold: DataFrame, ks=(1, 2, 3, 4, 5)) -> DataFrame:
    """Mean share of gold segments found in the first k, per domain and k."""
    group = ["trial_id", "domain"]
    hits = gold.join(selected.select(*group, *SEG_KEY, "rank"), [*group, *SEG_KEY], "left")
    per_group = hits.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_gold"), *[F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in ks]
    )
    entries = F.array(
        *[F.struct(F.lit(k).alias("k"), (F.col(f"hit_{k}") / F.col("n_gold")).alias("recall")) for k in ks]
    )
    return (
        per_group.select("domain", F.explode(entries).alias("e"))
        .groupBy("domain", F.col("e.k").alias("k"))
        .agg(F.avg("e.recall").alias("recall"), F.count(F.lit(1)).alias("n_groups"))
    )
