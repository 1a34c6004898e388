"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5
    THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

#: The same links, counted per document.
OP3_LINKS = OP3.partition(", reach AS")[0] + """
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, count(l.y)::BIGINT AS n_links
FROM s LEFT JOIN link l ON l.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20
), keyed AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM win
), late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, min(doc_id) OVER p AS d0, first_value(i) OVER (PARTITION BY k ORDER BY doc_id, i) AS i0
    FROM keyed WINDOW p AS (PARTITION BY k))
  WHERE doc_id > d0 OR i > i0
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def _op9() -> str:
    """Every window of every template, by exact containment alone."""
    import re

    from trialsift.llm.license_minhash import TEMPLATES

    rows = []
    for name, text in TEMPLATES:
        words = re.findall(r"[^\W_]+", text.lower())
        grams = list(dict.fromkeys(" ".join(words[i : i + 5]) for i in range(len(words) - 4)))
        listed = ", ".join(f"'{g}'" for g in grams)
        rows.append(f"('{name}', {len(grams)}, {-(-3 * len(grams) // 2)}, [{listed}])")
    return rf"""
WITH t(licence, s, width, tg) AS (VALUES {", ".join(rows)}),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM w WHERE len(w) >= 5
), c AS (
  SELECT doc_id, g, licence, s, width, tg, greatest(len(g) - width + 1, 1) AS last FROM g JOIN t ON list_has_any(g, tg)
), win AS (
  SELECT *, unnest(list_distinct(list_append(range(1, last + 1, width - s + 1), last))) AS start FROM c
), v AS (
  SELECT doc_id, licence, start, len(list_intersect(list_distinct(g[start:start + width - 1]), tg)) / s AS held FROM win
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY held DESC, start) AS k FROM v WHERE held >= 0.8
)
SELECT doc_id, licence, held AS containment, (start - 1)::BIGINT AS start_word FROM best WHERE k = 1
"""


OP9 = _op9()



def _op13(clusters: int = 16, rounds: int = 3) -> str:
    """Every distance of every round, by components; one row of x is one vector."""
    near = """
  SELECT k, j, d FROM (SELECT k, j, d, row_number() OVER (PARTITION BY k ORDER BY d, j) AS p FROM (
    SELECT x.k, c.j, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c USING (i) GROUP BY x.k, c.j)) WHERE p = 1
"""
    steps = "".join(
        f", a{r} AS ({near.format(r=r)}), c{r + 1} AS ("
        f" SELECT j, i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN ("
        "  SELECT j, i, CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END AS v FROM ("
        f"   SELECT a.j, x.i, sum(x.v) AS s, count(*) AS n FROM a{r} a JOIN x USING (k) GROUP BY a.j, x.i)) m USING (j, i))"
        for r in range(rounds)
    )
    return rf"""
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS l FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS (SELECT k, unnest(l)::HUGEINT AS v, unnest(range(64)) AS i FROM e),
b AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), l) - 1 AS j, l FROM e),
c0 AS (SELECT j, unnest(l)::HUGEINT AS v, unnest(range(64)) AS i FROM b WHERE j < {clusters}){steps}
, last AS ({near.format(r=rounds)}),
h AS (SELECT j, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j)
SELECT e.vec_id, last.j::INTEGER AS cluster, last.d::BIGINT AS distance,
  (sum(last.d) OVER (PARTITION BY last.j))::BIGINT AS cluster_inertia, (sum(last.d) OVER ())::BIGINT AS inertia,
  h.h AS centroid_sha256
FROM last JOIN e USING (k) JOIN h USING (j)
"""


OP13 = _op13()

OP12 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (
  SELECT lang, unnest(w) AS x, unnest(list_append(w[2:], NULL)) AS y, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS z
  FROM w WHERE len(w) > 0
), g AS MATERIALIZED (
  SELECT lang, 1 AS k, x AS g, count(*) AS f FROM t GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM t WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM t WHERE z IS NOT NULL GROUP BY ALL
), keyed AS MATERIALIZED (SELECT lang || '|' || g AS key, f FROM g WHERE f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, g AS phrase, f AS a, string_split(g, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.*, k, array_to_string(c.w[1:k], ' ') AS x, array_to_string(c.w[k + 1:], ' ') AS y
  FROM c, (VALUES (1), (2)) AS ks(k) WHERE k < words
), s AS (
  SELECT cut.lang, phrase, a, cut.k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN keyed x ON x.key = cut.lang || '|' || cut.x JOIN keyed y ON y.key = cut.lang || '|' || cut.y
), low AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS p FROM s) WHERE p = 1
), cover AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3
  ) GROUP BY ALL
), best AS (
  SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, low.a DESC, encode(low.phrase)) AS rank
  FROM low LEFT JOIN cover USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * low.a
)
SELECT lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
