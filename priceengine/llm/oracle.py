"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

from priceengine.llm.decontaminate import SPAN
from priceengine.llm.divergence import MIN_DOCS, TOP
from priceengine.llm.mixing import MAX_COPIES, MAX_RATE

OP6 = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id < c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP7 = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(CAST(n AS DOUBLE), 0.5) AS raw FROM n),
whole AS (SELECT source, raw / (SELECT sum(raw) FROM w) * (SELECT sum(n) FROM w) * 1.0 / n AS rate FROM w),
parts AS (SELECT source, rate, greatest(CAST(ceil(rate / {MAX_RATE}) AS INT), 1) AS parts FROM whole),
rates AS (SELECT source, rate / parts AS rate FROM parts), cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < least({MAX_COPIES}, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS INT))
), rows AS (
  SELECT row_number() OVER () AS row, d.doc_id, d.source, d.text, unnest(range(0, p.parts)) AS part FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), u AS (
  SELECT *, (CAST(('0x' || substr(sha256('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || CASE WHEN part > 0 THEN ':' || part ELSE '' END), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM rows
), drawn AS (
  SELECT u.row, u.doc_id, u.source, u.text, count(c.k) AS copies FROM u JOIN cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c <= u.u
  GROUP BY ALL
), copied AS (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM drawn)
SELECT doc_id, source, copy,
       CAST(('0x' || substr(sha256('17s:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)), 1, 13)) AS BIGINT) AS order_key,
       sha256(coalesce(text, '')) AS text_sha256
FROM copied
"""


def _op2() -> str:
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT * FROM (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) >= 8),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
bw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM b),
hits AS (  -- every shift with as many agreeing words as the shortest leak has
  SELECT doc_id, item_id, p - q AS shift FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) >= 7
), laid AS (
  SELECT h.doc_id, h.item_id, h.shift, d.w AS dw, b.w AS bw,
         least(len(d.w) - greatest(shift, 0), len(b.w) - greatest(-shift, 0)) AS n
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)
), matched AS (
  SELECT doc_id, item_id, shift, n, list_transform(range(1, n + 1), lambda i: CASE WHEN dw[greatest(shift, 0) + i] = bw[greatest(-shift, 0) + i] THEN 1 ELSE 0 END) AS hit FROM laid
), agreed AS (
  SELECT doc_id, item_id, shift, n AS n_overlap, list_sum(hit) AS n_agree,
         list_max(list_transform(range(0, greatest(n - {SPAN}, 0) + 1), lambda i: list_sum(hit[i + 1 : i + {SPAN}]))) AS n_run
  FROM matched
)
SELECT doc_id, item_id, CAST(shift AS INT) AS shift, CAST(n_overlap AS INT) AS n_overlap, CAST(n_agree AS INT) AS n_agree, CAST(n_run AS INT) AS n_run FROM agreed
WHERE n_overlap >= 8 AND (n_agree >= n_overlap * 0.8 OR n_run >= {SPAN} * 0.8)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_agree DESC, n_overlap DESC, shift) = 1
"""


OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lang_c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_c) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
whole AS (
  SELECT g.lang, g.source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, g.source) AS n, lang_c, l.n AS lang_n, v
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, c, CAST(1 + 1000000000 * (c + 5) // (n + 5 * v) AS BIGINT) AS p, CAST(1 + 1000000000 * (lang_c + 5) // (lang_n + 5 * v) AS BIGINT) AS q FROM whole
), far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source) AS INTEGER) AS rank
FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
UNION ALL
SELECT lang, source, 'term', term, p - q, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank
FROM p WHERE c > 0 AND p > q QUALIFY rank <= {TOP}
"""


def _op13(levels: int = 5, upper: int = 3) -> str:
    """For sources of up to 16 ** levels rows, and up to 16 ** upper sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"

    def tree(name: str, depth: int) -> str:
        """name0 (tree, idx, h) has the leaves; of each level name_k those with more than one node, name_kids_k their runs; name_root (tree, h)."""
        out = []
        for k in range(depth):
            out.append(f"{name}_kids{k} AS (SELECT tree, idx // 16 AS idx, list(h ORDER BY idx) AS kids FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM {name}{k}) WHERE w > 1 GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT tree, idx, sha256(array_to_string(kids, '')) AS h FROM {name}_kids{k})")
        roots = " UNION ALL ".join(f"SELECT tree, h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS w FROM {name}{k}) WHERE w = 1" for k in range(depth + 1))
        return ", ".join([*out, f"{name}_root AS ({roots})"])

    def climb(first: str, name: str, depth: int, idx: str, tree_col: str) -> str:
        """Steps of `first` (acc, sib, ...) up the levels of a tree."""
        out, last = [], first
        for k in range(depth):
            pos = f"(x.{idx} // {16**k}) % 16"
            left, right = f"coalesce(array_to_string(kids[1:{pos}], ''), '')", f"coalesce(array_to_string(kids[{pos} + 2:], ''), '')"
            out.append(
                f"{first}_{k} AS (SELECT x.* EXCLUDE (acc, sib), CASE WHEN kids IS NULL THEN acc ELSE sha256({left} || acc || {right}) END AS acc, CASE WHEN kids IS NULL THEN sib ELSE sib || {left} || {right} END AS sib "
                f"FROM {last} x LEFT JOIN {name}_kids{k} y ON y.tree = x.{tree_col} AND y.idx = x.{idx} // {16 ** (k + 1)})"
            )
            last = f"{first}_{k}"
        return ", ".join(out)

    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
coded AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM documents d, crc
), low AS (SELECT *, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed_text FROM coded),
d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed_text')} AS changed FROM low),
placed AS (
  SELECT doc_id, leaf, changed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS idx FROM d
), a0 AS (SELECT tree, idx, leaf AS h FROM placed), {tree('a', levels)},
b0 AS (SELECT 0 AS tree, tree AS idx, h FROM a_root), {tree('b', upper)},
f AS (SELECT *, 0 AS top, changed AS acc, '' AS sib FROM placed), {climb('f', 'a', levels, 'idx', 'tree')},
s AS (SELECT * FROM f_{levels - 1}), {climb('s', 'b', upper, 'tree', 'top')}
SELECT doc_id, leaf, a_root.h AS subroot, b_root.h AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = b_root.h AS verified
FROM s_{upper - 1} s JOIN a_root ON a_root.tree = s.tree JOIN b_root ON b_root.tree = 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _op2(), "op6_line_dedup": OP6, "op7_mixing": OP7, "op12_divergence": OP12, "op13_manifest": _op13()}
