"""DuckDB SQL for operators whose method SQL does not share, but whose result it can state plainly."""

_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def repeats_sql(docs: str = "SELECT * FROM documents", n: int = 13) -> str:
    """op5_substring: windows of n words as texts, grouped. Ids must not repeat; rows without one keep all words."""
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format('text')} AS w FROM ({docs})),
  s AS (SELECT doc_id, r, unnest(range(1, len(w) - {n - 2})) AS i, w FROM d WHERE doc_id IS NOT NULL AND len(w) >= {n}),
  g AS (SELECT doc_id, r, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS t FROM s),
  f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING count(DISTINCT doc_id) > 1),
  gone AS (SELECT DISTINCT r, unnest(range(i, i + {n})) AS j FROM g JOIN f USING (t) WHERE first < doc_id),
  word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
  kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, j) GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def near_duplicates_sql(docs: str = "SELECT * FROM documents", n: int = 3, percent: int = 85) -> str:
    """op4_minhash: sets of shingles, pairs that share one, and what is reachable over links. Ids must not repeat."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(lowered)} AS w FROM ({docs})),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) END) AS h FROM d),
  c AS (SELECT list_sort(h) AS k, min(doc_id) AS node, len(any_value(h)) AS size FROM s WHERE len(h) > 0 GROUP BY list_sort(h)),
  e AS (SELECT node, size, unnest(k) AS x FROM c),
  p AS (SELECT a.node AS a, b.node AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.node < b.node AND 100 * a.size >= {percent} * b.size AND 100 * b.size >= {percent} * a.size
    GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= {percent} * (a.size + b.size - count(*))),
  l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  r AS (SELECT node AS a, node AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
  m AS (SELECT a AS node, min(b) AS component_id FROM r GROUP BY a)
  SELECT s.doc_id, len(h)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON c.k = list_sort(s.h) LEFT JOIN m USING (node)"""
