"""SQL for the queries that SQL can express on whole tables; ``ORACLES`` by query."""

from __future__ import annotations

from .decontaminate import WINDOW as PHRASE
from .jaccard_join import PERCENT, SHINGLE
from .substrings import WINDOW

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RUNS, ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'"

DECONTAMINATE = f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item, least(len(w), {PHRASE}) AS n, array_to_string(w[i:i + {PHRASE - 1}], ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - {PHRASE - 1}) + 1)) t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
seen AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT doc_id, i, n, item FROM seen JOIN win USING (n, s)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + k AS pos FROM hit, unnest(range(n)) t(k)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {RUNS}) AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - {SHINGLE - 1}) + 1)) t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b, c = p.n AND c = q.n AS same FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id),
component AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1),
own AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS copies, min(b) FILTER (same) AS copy FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(copy, d.doc_id)) AS class_id, 1 + coalesce(copies, 0) AS class_size, coalesce(n_links, 0) AS n_links, component_id FROM d JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id) LEFT JOIN own USING (doc_id)"""

SUBSTRINGS = f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {RUNS}) AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {WINDOW - 2})) t(i) WHERE len(w) >= {WINDOW}),
source AS (SELECT s, min(doc_id) AS first FROM win GROUP BY 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN source USING (s), unnest(range({WINDOW})) t(k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""

ORACLES: dict[str, str] = {"op3_decontaminate": DECONTAMINATE, "op6_jaccard": JACCARD, "op9_substrings": SUBSTRINGS}
