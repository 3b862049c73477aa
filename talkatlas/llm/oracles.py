"""DuckDB SQL for the queries that it can express on whole tables (unique, non-null ids)."""

from __future__ import annotations

from .decontaminate import SLOP
from .near_dup import SHINGLE

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words between blanks and the controls from tab to CR.
_SPACED = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def near_duplicates(table: str, percent: int = 85, k: int = SHINGLE) -> str:
    """op4: links by a join of shingles, components by a recursive search."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOW.format('text'))} AS w FROM {table}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i : i + {k} - 1], ' ')) END) AS t FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(least(x, y)) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM {table} d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN low ON low.x = d.doc_id
"""


def overlaps(table: str, bench: str, n: int = 10, slop: int = SLOP) -> str:
    """op7: windows joined by their words; proximity by counting a window's words in each stretch of a document."""
    return f"""
WITH bw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM.format(_LOW.format('text'))} AS w FROM {bench} WHERE text IS NOT NULL),
bwin AS (SELECT DISTINCT item, w[i : i + least(len(w), {n}) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {n} + 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_ALNUM.format(_LOW.format('text'))} AS w FROM {table}),
sizes AS (SELECT DISTINCT len(win) AS m FROM bwin),
dwin AS (SELECT doc_id, i, m, w[i : i + m - 1] AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item FROM dwin JOIN bwin USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id),
kinds AS (SELECT win, list_distinct(win) AS k, len(win) + {slop} AS reach FROM (SELECT DISTINCT win FROM bwin)),
tokens AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dw),
terms AS (SELECT win, unnest(k) AS t FROM kinds),
few AS (SELECT doc_id, win FROM (SELECT DISTINCT doc_id, t FROM tokens) JOIN terms USING (t) GROUP BY ALL HAVING count(*) = len(list_distinct(win))),
rare AS (SELECT win, arg_min(t, f) AS t FROM terms JOIN (SELECT t, count(*) AS f FROM tokens GROUP BY t) USING (t) GROUP BY win),
around AS (SELECT doc_id, win, p, reach, len(k) AS size FROM few JOIN rare USING (win) JOIN tokens USING (doc_id, t) JOIN kinds USING (win)),
begins AS (SELECT DISTINCT doc_id, win, reach, size, unnest(range(greatest(1, p - reach + 1), p + 1)) AS b FROM around),
near AS (SELECT DISTINCT g.doc_id, g.win FROM begins g JOIN dw USING (doc_id) WHERE len(list_intersect(list_distinct(w[b : b + reach - 1]), win)) = size),
nearby AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM near JOIN bwin USING (win) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(nearby.n, 0) AS n_near_items, sha256(coalesce(nearby.items, '')) AS near_items_sha256
FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN items i ON i.doc_id = dw.doc_id LEFT JOIN nearby ON nearby.doc_id = dw.doc_id
"""


def repeats(table: str, n: int = 20) -> str:
    """op10: windows as texts, the first of each by document and place."""
    return f"""
WITH w AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM {table}),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {n - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM w WHERE len(w) >= {n})),
later AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(struct_pack(d := doc_id, i := i)) AS first FROM win GROUP BY h HAVING count(*) > 1) f USING (h) WHERE struct_pack(d := doc_id, i := i) <> first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM later),
each AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN t END, ' ' ORDER BY e.p) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
