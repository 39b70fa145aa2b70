"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from barlake.llm import backoff, prefixes, rolling, urls

ROUNDS = 80  # of propagation: 0.85 ** 80 is 2e-6
WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM d)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS j FROM d),
kept AS (
  SELECT w.doc_id, count(*) AS n, count(g.j) AS n_gone, string_agg(w.word, ' ' ORDER BY w.j) FILTER (g.j IS NULL) AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.j = w.j GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), {WORDS}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS x FROM (
    SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, coalesce(c.least, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) c USING (doc_id)
"""


TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""


def _url_filters() -> str:
    lower = lambda x: f"translate({x}, '{urls.UPPER}', '{urls.LOWER}')"
    by_length = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%'", h + p, a) for a, h, p in by_length]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in fits) + " END"
    link = urls.LINK.replace("'", "''")
    parts = [
        """rests AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)""",
        """hosted AS (SELECT page_id, html, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM rests)""",
        f"""paths AS (SELECT page_id, html, {lower('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosted)""",
        f"""judged AS (SELECT *, {rule} AS rule, {action} AS action FROM paths)""",
        """hosts AS (SELECT host, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY 1)""",
        f"""linked AS (SELECT host AS src, {lower('x')} AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (
            SELECT host, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS x FROM judged WHERE host <> '' AND html IS NOT NULL) GROUP BY 1, 2)""",
        """up AS (SELECT h.host AS src, p.host AS dst FROM hosts h JOIN hosts p ON p.host = substr(h.host, strpos(h.host, '.') + 1) AND p.host <> h.host)""",
        """edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM linked JOIN hosts ON host = dst
            UNION ALL SELECT src, dst, 1.0 FROM up UNION ALL SELECT dst, src, 1.0 FROM up) WHERE src <> dst GROUP BY 1, 2)""",
    ]
    for name, column, a, b in (("t", "allowed", "src", "dst"), ("u", "blocked", "dst", "src")):
        parts.append(f"{name}_move AS (SELECT {a} AS src, {b} AS dst, weight / sum(weight) OVER (PARTITION BY {a}) * {urls.DAMPING} AS share FROM edges)")
        parts.append(f"{name}0 AS (SELECT host, {column} / (SELECT sum({column}) FROM hosts) AS rank FROM hosts WHERE {column} > 0)")
        for i in range(1, ROUNDS + 1):
            parts.append(f"""{name}{i} AS MATERIALIZED (SELECT host, sum(m) AS rank FROM (SELECT host, rank * {1 - urls.DAMPING} AS m FROM {name}0
                UNION ALL SELECT dst, rank * share FROM {name}{i - 1} JOIN {name}_move ON src = host) GROUP BY 1)""")
    # Divided by their sum: the mass of hosts without out-links has gone back to the seeds.
    share = "SELECT host, {0} rank / (SELECT sum(rank) FROM {1}) AS x FROM {1}"
    parts.append(f"bad AS (SELECT host FROM ({share.format('', f'u{ROUNDS}')} UNION ALL {share.format('-', f't{ROUNDS}')}) GROUP BY 1 HAVING round(sum(x), 12) > 0)")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(action, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"


def queries() -> dict[str, str]:
    return {
        "op3_substring_dedup": SUBSTRING,
        "op4_exact_top_k": TOP_K,
        "op5_minhash_near_dedup": NEAR,
        "op9_url_filters": _url_filters(),
        "op10_lm_scoring": backoff.ORACLE_SQL,
        "op11_rolling_windows": rolling.ORACLE_SQL,
        "op12_prefix_trie": prefixes.ORACLE_SQL,
    }
