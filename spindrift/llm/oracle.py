"""DuckDB SQL of those operators that SQL can express, by definition rather than by method."""

from __future__ import annotations

PREFERENCE = """
WITH t AS (SELECT conv_id AS conv, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
talk AS (SELECT conv, min(turn) AS t0, arg_min(role || chr(1) || text, turn) AS opening, string_agg(turn || chr(1) || role || chr(2) || text, chr(3) ORDER BY turn) AS content,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS reward, max(turn) FILTER (role = 'assistant') AS last_reply FROM t GROUP BY 1),
d AS (SELECT min(conv) AS conv, count(*) AS n_copies, any_value(t0) AS t0, any_value(opening) AS opening, any_value(reward) AS reward, any_value(last_reply) AS last_reply FROM talk GROUP BY content),
p AS (SELECT *, lead(conv) OVER w AS rejected, row_number() OVER w AS rn FROM d WINDOW w AS (PARTITION BY t0, opening ORDER BY reward DESC, conv)),
pairs AS (SELECT conv AS chosen, rejected, n_copies, last_reply FROM p WHERE rejected IS NOT NULL OR rn = 1),
a AS (SELECT p.chosen, t.* FROM pairs p JOIN t ON t.conv = p.chosen WHERE rejected IS NOT NULL),
b AS (SELECT p.chosen, t.* FROM pairs p JOIN t ON t.conv = p.rejected),
cut AS (SELECT chosen, min(turn) AS cut FROM (SELECT coalesce(a.chosen, b.chosen) AS chosen, coalesce(a.turn, b.turn) AS turn, a.role AS ar, b.role AS br, a.text AS atext, b.text AS btext FROM a FULL JOIN b ON a.chosen = b.chosen AND a.turn = b.turn) WHERE ar IS DISTINCT FROM br OR atext IS DISTINCT FROM btext GROUP BY 1),
cp AS (SELECT p.*, CASE WHEN rejected IS NULL THEN coalesce(last_reply, 9223372036854775807) ELSE cut.cut END AS cut FROM pairs p LEFT JOIN cut ON cut.chosen = p.chosen),
r AS (SELECT cp.chosen, CASE WHEN t.turn < cp.cut THEN 0 ELSE 1 END AS side, t.turn, t.role, t.text FROM cp JOIN t ON t.conv = cp.chosen UNION ALL SELECT cp.chosen, 2, t.turn, t.role, t.text FROM cp JOIN t ON t.conv = cp.rejected AND t.turn >= cp.cut),
s AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, coalesce(sum(length(role) + length(text) + 13) OVER (PARTITION BY chosen, side ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 5 AS begin FROM r),
g AS (SELECT chosen, side, count(*) AS n, string_agg(shown, '' ORDER BY turn) AS shown, string_agg(CAST(begin AS BIGINT) || '-' || CAST(begin + length(text) AS BIGINT), ',' ORDER BY turn) FILTER (role = 'assistant') AS mask FROM s GROUP BY 1, 2)
SELECT cp.chosen AS chosen_id, cp.rejected AS rejected_id, CAST(0 AS BIGINT) AS part, cp.n_copies, coalesce(x.n, 0) AS prompt_turns, coalesce(y.n, 0) AS chosen_turns, CASE WHEN rejected IS NOT NULL THEN coalesce(z.n, 0) END AS rejected_turns,
  coalesce(x.shown, '') AS prompt, coalesce(y.shown, '') AS chosen, CASE WHEN rejected IS NOT NULL THEN coalesce(z.shown, '') END AS rejected, coalesce(y.mask, '') AS chosen_mask, CASE WHEN rejected IS NOT NULL THEN coalesce(z.mask, '') END AS rejected_mask
FROM cp LEFT JOIN g x ON x.chosen = cp.chosen AND x.side = 0 LEFT JOIN g y ON y.chosen = cp.chosen AND y.side = 1 LEFT JOIN g z ON z.chosen = cp.chosen AND z.side = 2
"""

DECONTAMINATE = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(len(w) - 4)) AS pos, unnest(list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1:k + 5], ' '))) AS s FROM d WHERE len(w) >= 5),
its AS (SELECT item_id, len(w) AS m, unnest(list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1:k + 5], ' '))) AS s FROM i WHERE len(w) >= 5),
win AS (SELECT DISTINCT doc_id, item_id, m, n, least(pos, greatest(0, n - m)) AS start FROM ds JOIN its USING (s)),
wc AS (SELECT win.doc_id, win.item_id, win.start, win.m, ds.s, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos >= win.start AND ds.pos < win.start + win.m - 4 GROUP BY ALL),
ic AS (SELECT item_id, m, s, count(*) AS c FROM its GROUP BY ALL),
total AS (SELECT doc_id, item_id, start, m, sum(c) AS a FROM wc GROUP BY ALL),
shared AS (SELECT wc.doc_id, wc.item_id, wc.start, wc.m, sum(least(wc.c, ic.c)) AS x FROM wc JOIN ic USING (item_id, m, s) GROUP BY ALL),
sim AS (SELECT t.doc_id, t.item_id, t.start, t.m, x / (a + (t.m - 4) - x) AS similarity FROM total t JOIN shared USING (doc_id, item_id, start, m))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, m AS size, round(similarity, 9) AS similarity FROM sim WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - 19)) AS start, unnest(list_transform(range(len(w) - 19), lambda k: array_to_string(w[k + 1:k + 20], ' '))) AS s FROM d WHERE len(w) >= 20),
again AS (SELECT doc_id, start FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM again),
words AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# kind: pattern (its value in group 1), least length of the value
_SECRETS = {"assign": (rf"""(?:{_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 6), "access": ("(AKIA[A-Z0-9]+)", 20), "hex": ("([0-9a-f]+)", 24)}


def _found(number: int, kind: str) -> str:
    """Matches with their places: what lies between matches, and the matches, add up to the text."""
    pattern, least = _SECRETS[kind]
    plain = pattern.replace("([A", "(?:[A").replace("([0", "(?:[0").replace("(AKIA", "(?:AKIA")
    upto = "list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, CAST(x.a AS BIGINT) AS a, CAST(x.a + x.n AS BIGINT) AS b FROM (
  SELECT doc_id, unnest(list_filter(list_transform(range(1, len(whole) + 1), lambda i: {{'a': {upto}, 'n': length(whole[i]), 'v': length(said[i])}}), lambda y: y.v >= {least})) AS x
  FROM (SELECT doc_id, string_split_regex(t, '{plain}') AS parts, regexp_extract_all(t, '{plain}') AS whole, regexp_extract_all(t, '{pattern}', 1) AS said FROM texts))"""


SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_found(i, kind) for i, kind in enumerate(_SECRETS))}),
joined AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS said FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM texts LEFT JOIN joined USING (doc_id)
"""

URL_RULES = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('com/', 'com', '/'), ('example.com/en/', 'example.com', '/en/'), ('www.example.com/en/', 'www.example.com', '/en/'), ('net/es/', 'net', '/es/'), ('net/fr/', 'net', '/fr/')) t(rule, h, q))
SELECT page_id, host, path, (SELECT rule FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(rule) DESC LIMIT 1) AS rule FROM p
"""

PAYLOADS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS size FROM t)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(text || repeat(chr(0), size - n)) AS payload_sha256 FROM p
"""
