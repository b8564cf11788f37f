"""SQL for the operators that SQL can express, by brute force."""

WORDS = r"list_filter(regexp_split_to_array(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


JACCARD = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM docs),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM each x JOIN each y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
edges AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
walk AS (SELECT a, b FROM edges UNION SELECT walk.a, edges.b FROM walk JOIN edges ON walk.b = edges.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM walk WHERE a = doc_id), doc_id)) AS component_id FROM n"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS m FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.m * y.m) >= 0.93),
walk AS (SELECT a, b FROM edges UNION SELECT walk.a, edges.b FROM walk JOIN edges ON walk.b = edges.a),
out AS (SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM walk WHERE a = vec_id), vec_id)) AS component_id FROM v)
SELECT vec_id, n_links, component_id, component_id = vec_id AS kept FROM out"""

SUBSTRINGS = rf"""
WITH docs AS (SELECT doc_id, {WORDS.format(t="text")} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
hits AS (SELECT doc_id, i FROM wins JOIN firsts USING (h) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hits, (SELECT unnest(range(50)) AS k)),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM docs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""


def quality(metrics: dict, noise: int, spread: float, least: int) -> str:
    """The rules of quality_rules for its parameters."""
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, v_{m} AS v FROM shares WHERE NOT base_failed" for m in metrics)
    floor = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x[2]}" for m, x in metrics.items()) + " END"
    levels, tests = [], []
    for level, by in (("s", "lang, source, "), ("l", "lang, "), ("a", "")):
        levels.append(f"""{level}c AS (SELECT {by}metric, key, sum(n) AS n FROM sketch GROUP BY {by}metric, key),
{level}u AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY key) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total FROM {level}c),
{level}q AS (SELECT {by}metric, min(CASE WHEN upto >= ceil(0.25 * total) THEN key END) AS q1, min(CASE WHEN upto >= ceil(0.75 * total) THEN key END) AS q3 FROM {level}u GROUP BY {by}metric HAVING max(total) >= {least}),
{level}b AS (SELECT {by}metric, q1 - {spread} * greatest(q3 - q1, {floor}) AS low, q3 + {spread} * greatest(q3 - q1, {floor}) AS high FROM {level}q)""")
    joins = ""
    for m, (_, _, _, both) in metrics.items():
        joins += f" LEFT JOIN sb s_{m} ON s_{m}.metric = '{m}' AND s_{m}.lang IS NOT DISTINCT FROM d.lang AND s_{m}.source IS NOT DISTINCT FROM d.source LEFT JOIN lb l_{m} ON l_{m}.metric = '{m}' AND l_{m}.lang IS NOT DISTINCT FROM d.lang LEFT JOIN ab a_{m} ON a_{m}.metric = '{m}'"
        low, high = (f"coalesce(s_{m}.{x}, l_{m}.{x}, a_{m}.{x})" for x in ("low", "high"))
        if both:
            tests.append(f"coalesce(v_{m} * 2 * n_words <= {high} * 2 * n_words + {noise} * ({high} - {low}) AND v_{m} * 2 * n_words >= {low} * 2 * n_words - {noise} * ({high} - {low}), true)")
        else:
            tests.append(f"coalesce(v_{m} <= {high}, true)")
    shares = ", ".join(f"CASE WHEN {b} > 0 THEN CAST(floor({a} * 1000 / {b}) AS BIGINT) END AS v_{m}" for m, (a, b, _, _) in metrics.items())
    return rf"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format(t="text")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS k FROM starts),
again AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM wins, (SELECT unnest(range(5)) AS d) WHERE k > 1 GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM docs LEFT JOIN again USING (doc_id)),
shares AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {shares} FROM counts),
each AS ({each}),
sketch AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 10, 0)) << greatest(length(bin(v)) - 10, 0) AS key, count(*) AS n FROM each WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4),
{", ".join(levels)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM shares d{joins}"""
