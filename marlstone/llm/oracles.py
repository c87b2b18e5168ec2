"""DuckDB SQL that gives the rows of the operators SQL can express."""

from . import preference

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, column: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


_DECONTAMINATION = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS ns WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars")
_LEAF = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _FIELDS)
_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
_BITS = "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC = f"""xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), {_BITS})), 4294967295)"""


def _tree(name: str, leaves: str) -> str:
    """All levels over the nodes of (tree, pos, n, node)."""
    return f"""{name} AS (SELECT 0 AS level, tree, pos, n, node FROM {leaves}
  UNION ALL SELECT level + 1, tree, pos // 16, (max(n) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY level, tree, pos // 16)"""


def _folds(name: str, begin: str, tree: str) -> str:
    """Every row's node folded with its siblings up a tree, and the siblings so far."""
    return f"""{name} AS (SELECT 0 AS level, row, tree, pos, node, sib FROM {begin}
  UNION ALL SELECT f.level + 1, f.row, f.tree, f.pos // 16, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.node ELSE t.node END, '' ORDER BY t.pos)),
    f.sib || string_agg(CASE WHEN t.pos = f.pos THEN '' ELSE t.node END, '' ORDER BY t.pos)
  FROM {name} f JOIN {tree} t ON t.level = f.level AND t.tree = f.tree AND t.pos // 16 = f.pos // 16 AND t.n > 1 GROUP BY f.level, f.row, f.tree, f.pos, f.node, f.sib)"""


_MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_LEAF} || {_TEXT.format('text')}) AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN sha256({_LEAF} || {_TEXT.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS other FROM documents),
p AS (SELECT *, row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS node FROM d),
{_tree('t', 'p')},
s AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, node FROM t WHERE n = 1),
{_tree('u', 's')},
p0 AS (SELECT row, tree, pos, coalesce(other, leaf) AS node, '' AS sib FROM p),
{_folds('f', 'p0', 't')},
f0 AS (SELECT row, 0 AS tree, tree AS pos, node, sib FROM f QUALIFY level = max(level) OVER (PARTITION BY row)),
{_folds('g', 'f0', 'u')},
e AS (SELECT row, node AS folded_root, sib FROM g QUALIFY level = max(level) OVER (PARTITION BY row)),
r AS (SELECT node AS root FROM u WHERE n = 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, root, sha256(sib) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN e ON p.row = e.row JOIN s ON s.pos = p.tree, r
"""

ORACLE: dict[str, str] = {
    "op8_chat_formatting": preference.ORACLE_SQL,
    "op9_benchmark_decontamination": _DECONTAMINATION,
    "op10_ngram_jaccard_join": _JACCARD,
    "op11_merkle_manifest": _MERKLE,
}
