"""DuckDB SQL of the queries that SQL can express, by plainer ways than the operators."""

from __future__ import annotations

# crc32 by its byte table, for strings of code points below U+0800
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))"""


def _crc32(text: str) -> str:
    """crc32 of an expression, where ``t`` of ``crc_table`` is in scope."""
    points = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    data = (f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] "
            "ELSE [192 + (c >> 6), 128 + (c & 63)] END))")
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)")


def _field(value: str) -> str:
    return (f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || "
            f"CAST({value} AS VARCHAR), '-')")


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(
        _field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0
      THEN {_leaf("(CAST(n_chars AS DECIMAL(20,0)) + 1)")} END AS other
  FROM documents, crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM hashed),
levels AS (
  SELECT tree, 0 AS l, pos AS i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM levels WHERE n > 1 GROUP BY tree, l, i // 2, n),
subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos,
    count(*) OVER () AS n FROM levels WHERE n = 1),
upper_levels AS (
  SELECT 0 AS l, pos AS i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM upper_levels WHERE n > 1 GROUP BY l, i // 2, n),
up AS (
  SELECT tree, pos, 0 AS l, leaf, coalesce(other, leaf) AS folded, '' AS path, n
  FROM leaves
  UNION ALL
  SELECT u.tree, u.pos, u.l + 1, u.leaf,
    sha256(CASE WHEN s.h IS NULL THEN u.folded WHEN (u.pos >> u.l) & 1 = 1 THEN s.h || u.folded
      ELSE u.folded || s.h END), u.path || coalesce(s.h, ''), (u.n + 1) // 2
  FROM up u LEFT JOIN levels s ON s.tree = u.tree AND s.l = u.l AND s.i = xor(u.pos >> u.l, 1)
  WHERE u.n > 1),
over AS (
  SELECT up.tree, up.pos, 0 AS l, up.folded, up.path, s.subroot, s.pos AS at, s.n
  FROM up JOIN subroots s USING (tree) WHERE up.n = 1
  UNION ALL
  SELECT u.tree, u.pos, u.l + 1,
    sha256(CASE WHEN s.h IS NULL THEN u.folded WHEN (u.at >> u.l) & 1 = 1 THEN s.h || u.folded
      ELSE u.folded || s.h END), u.path || coalesce(s.h, ''), u.subroot, u.at, (u.n + 1) // 2
  FROM over u LEFT JOIN upper_levels s ON s.l = u.l AND s.i = xor(u.at >> u.l, 1)
  WHERE u.n > 1)
SELECT leaves.doc_id, leaves.leaf, over.subroot, r.h AS root, sha256(over.path) AS proof_sha256,
  over.folded AS folded_root, over.folded = r.h AS verified,
  CASE WHEN leaves.tree = '' THEN NULL ELSE substr(leaves.tree, 2) END AS lang,
  CAST(leaves.pos AS BIGINT) AS pos
FROM over JOIN leaves USING (tree, pos), (SELECT h FROM upper_levels WHERE n = 1) r
WHERE over.n = 1
"""

# near words meet in what is left when one code point goes: two words of equal length with
# one left over in the same place, or the longer one without it and the shorter one
SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents),
counted AS (
  SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY id, run),
hashed AS (
  SELECT run, k, {_crc32("id || ':' || run")} AS h FROM counted, crc_table),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run))
      || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
short AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM short a JOIN short b USING (i, rest)
  WHERE a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM short a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM short a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, near AS form, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place
  FROM near),
forms AS (
  SELECT w.word, CASE WHEN b.near_n >= 5 * w.n THEN b.form END AS form, w.n,
    coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at
  WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms g ON g.word = walk.at
WHERE g.form IS NULL
"""

ORACLE: dict[str, str] = {"op12_spelling": SPELLING, "op13_manifest": MANIFEST}
