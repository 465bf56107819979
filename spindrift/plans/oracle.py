"""DuckDB SQL that stands beside the registered queries: common table expressions and generators.

Each text is a list of (name, body) that ``with_`` puts in front of a final SELECT."""

from __future__ import annotations

from spindrift.functions.normalize import ADDRESS_WORDS, COUNTRY_ALIASES, LEGAL_SUFFIXES, NA_TOKENS

LIST_OF_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)

RAW = """
SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id,
  CASE WHEN p_partkey % 13 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE p_name || CASE p_partkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Ltd' WHEN 2 THEN '' ELSE ' Company' END END AS business_name,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_size || ' ' || p_type || ' Road sw1a1aa' ELSE p_size || ' ' || p_type || ' Street ' || (90000 + p_partkey % 50) END AS business_address,
  CASE p_partkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'usa' WHEN 2 THEN 'United States' WHEN 3 THEN 'India' ELSE 'Brazil' END AS country
FROM part"""


def _clean(column: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _core() -> str:
    out = "name_norm"
    for words in LEGAL_SUFFIXES:
        out = f"regexp_replace({out}, ' ({words})$', '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _canon() -> str:
    out = "address_norm"
    for word, short in ADDRESS_WORDS:
        out = f"replace({out}, ' {word}', ' {short}')"
    return out


_COUNTRY = "CASE lower(trim(country)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in COUNTRY_ALIASES.items()) + " ELSE lower(trim(country)) END"
NORM = f"SELECT *, {_clean('business_name')} AS name_norm, {_clean('business_address')} AS address_norm, coalesce({_COUNTRY}, '') AS country_norm FROM raw"
KEYS5 = """SELECT *, name_norm AS name_key, name_norm || '||' || country_norm AS name_country_key, address_norm || '||' || country_norm AS address_country_key,
  name_norm || '||' || address_norm AS name_address_key, name_norm || '||' || address_norm || '||' || country_norm AS full_key FROM norm"""
ENT = f"""SELECT *, replace(name_norm, ' ', '') AS name, replace(address_norm, ' ', '') AS addr, regexp_extract(address_norm, '[0-9]{{1,6}}') AS number,
  regexp_replace(address_norm, '[^0-9]', '', 'g') AS digits, regexp_replace(regexp_replace(address_norm, '[^0-9]', '', 'g'), '^0+$', '') AS nonzero,
  regexp_extract(address_norm, '[0-9]{{5,6}}') AS postal,
  CASE WHEN regexp_extract(address_norm, '([a-z]{{1,2}}[0-9][a-z0-9]?[0-9][a-z]{{2}})', 1) <> '' THEN regexp_extract(address_norm, '([a-z]{{1,2}}[0-9][a-z0-9]?[0-9][a-z]{{2}})', 1)
    ELSE reverse(regexp_extract(reverse(address_norm), '[0-9]{{4,6}}')) END AS postal_like,
  coalesce(list_extract(regexp_extract_all(address_norm, '[0-9]{{5,6}}'), -1), '') AS last_postal,
  regexp_extract(name_norm, '([^ ]+)$', 1) AS last_token, {_core()} AS core, replace({_core()}, ' ', '') AS core_compact, replace({_canon()}, ' ', '') AS canon_compact
FROM keys5"""
TRUTH = """SELECT 'S1-' || a.p_partkey AS s1, 'S' || (b.p_partkey % 3 + 1) || '-' || b.p_partkey AS c
FROM part a JOIN part b ON a.p_partkey % 3 = 0 AND b.p_partkey % 3 <> 0 AND a.p_name = b.p_name AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 2"""
BASE = [("raw", RAW), ("norm", NORM), ("keys5", KEYS5), ("ent", ENT), ("truth", TRUTH)]


def with_(ctes, final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + final


# --- blocks --------------------------------------------------------------------------------


def _part(field: str, cut: str | None, n: int) -> str:
    return {
        "<": f"substr({field}, 1, {n})",
        ">": f"right({field}, {n})",
        "~": f"CASE WHEN length({field}) <= {n} THEN {field} ELSE substr({field}, CAST(floor((length({field}) - {n}) / 2) AS BIGINT) + 1, {n}) END",
        "/": f"CAST(length({field}) // {n or 1} AS VARCHAR)",
        None: field,
    }[cut]


def keys_sql(specs, where: str) -> str:
    rows = []
    for s in specs:
        holds = [f"{f} <> ''" for f in dict.fromkeys(p[0] for p in s.parts())] + [f"length({f}) >= {n}" for f, n in s.least]
        columns = [_part(*p) for p in s.parts()]
        if s.country:
            holds.append("country_norm <> ''")
            columns.insert(0, "country_norm")
        if s.only:
            holds.append(f"(starts_with(entity_id, 'S1-') OR starts_with(entity_id, '{s.only}-'))")
        cap = "NULL" if s.cap is None else s.cap
        rows.append(f"SELECT '{s.name}' AS block, {' || chr(124) || '.join(f'({c})' for c in columns)} AS key, entity_id AS id, CAST({cap} AS BIGINT) AS cap, {int(s.exact)} AS exact FROM ent WHERE {where} AND {' AND '.join(holds)}")
    return "\nUNION ALL ".join(rows)


def block_ctes(specs, target: str, tag: str = "", left: str = "starts_with(entity_id, 'S1-')"):
    """lk, rk (keys), good (keys on both sides within their cap) and pairs of one direction."""
    counts = lambda side: f"SELECT block, key, cap, count(*) AS n FROM {side}k{tag} GROUP BY ALL HAVING cap IS NULL OR count(*) <= cap"
    return [
        (f"lk{tag}", keys_sql(specs, left)),
        (f"rk{tag}", keys_sql(specs, f"starts_with(entity_id, '{target}-')")),
        (f"lc{tag}", counts("l")),
        (f"rc{tag}", counts("r")),
        (f"good{tag}", f"SELECT l.block, l.key, l.n AS nl, r.n AS nr FROM lc{tag} l JOIN rc{tag} r ON l.block = r.block AND l.key = r.key"),
        (f"pairs{tag}", f"SELECT l.id AS source1_entity_id, r.id AS candidate_entity_id, l.block AS block_name, l.exact AS is_exact FROM lk{tag} l JOIN good{tag} g ON l.block = g.block AND l.key = g.key JOIN rk{tag} r ON r.block = l.block AND r.key = l.key"),
    ]


# --- scoring -------------------------------------------------------------------------------

EVIDENCE = """SELECT source1_entity_id, candidate_entity_id, count(*) AS evidence_rows, count(DISTINCT block_name) AS evidence_file_count, CAST(least(5, sum(is_exact)) AS BIGINT) AS exact_key_count,
  string_agg(DISTINCT block_name, ',' ORDER BY block_name) AS block_names FROM {pairs} GROUP BY ALL"""


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence by the row recurrence, in list functions."""
    return f"""list_reduce(string_split({a}, ''), lambda row, ch: list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, greatest(row[j + 1], acc[j], row[j] + CASE WHEN substr({b}, j, 1) = ch THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]), list_transform(range(length({b}) + 1), lambda x: CAST(0 AS BIGINT)))[length({b}) + 1]"""


def ranked_ctes(specs, target: str, tag: str):
    """evidence, features, base score and rank of one direction's pairs."""
    similarity = lambda f: f"SELECT l_{f} AS l, r_{f} AS r, CASE WHEN l_{f} = '' OR r_{f} = '' THEN 0.0 ELSE round(2.0 * {_lcs(f'l_{f}', f'r_{f}')} / (length(l_{f}) + length(r_{f})), 6) END AS s FROM (SELECT DISTINCT l_{f}, r_{f} FROM attr{tag})"
    ratio = lambda f: f"CASE WHEN l_{f} = '' OR r_{f} = '' THEN 0.0 ELSE round(least(length(l_{f}), length(r_{f})) / greatest(length(l_{f}), length(r_{f})), 6) END AS {f}_length_ratio"
    flag = lambda f: f"CASE WHEN l_{f} <> '' AND l_{f} = r_{f} THEN 1 ELSE 0 END AS {f}_exact"
    return [
        *block_ctes(specs, target, tag),
        (f"ev{tag}", EVIDENCE.format(pairs=f"pairs{tag}")),
        (f"attr{tag}", f"SELECT e.*, l.name_norm AS l_name, l.address_norm AS l_address, l.country_norm AS l_country, r.name_norm AS r_name, r.address_norm AS r_address, r.country_norm AS r_country FROM ev{tag} e JOIN ent l ON l.entity_id = e.source1_entity_id JOIN ent r ON r.entity_id = e.candidate_entity_id"),
        (f"sn{tag}", similarity("name")),
        (f"sa{tag}", similarity("address")),
        (f"feat{tag}", f"""SELECT source1_entity_id, candidate_entity_id, evidence_rows, evidence_file_count, exact_key_count, block_names, {flag('name')}, {flag('address')}, {flag('country')}, {ratio('name')}, {ratio('address')}, n.s AS name_similarity, a.s AS address_similarity
  FROM attr{tag} t JOIN sn{tag} n ON n.l = l_name AND n.r = r_name JOIN sa{tag} a ON a.l = l_address AND a.r = r_address"""),
        (f"base{tag}", f"SELECT *, round(30.0 * name_exact + 25.0 * address_exact + 8.0 * country_exact + 22.0 * name_similarity + 12.0 * address_similarity + 2.0 * name_length_ratio + 1.0 * address_length_ratio + 0.75 * least(evidence_file_count, 4) + 0.25 * least(exact_key_count, 5), 6) AS base_score FROM feat{tag}"),
        (f"ranked{tag}", f"SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY base_score DESC, candidate_entity_id) AS base_rank FROM base{tag}"),
    ]


def truth_ctes(target: str, tag: str):
    return [(f"gt{tag}", f"SELECT DISTINCT s1 AS source1_entity_id, c AS candidate_entity_id FROM truth WHERE starts_with(c, '{target}-')")]


F05 = "CASE WHEN {t} = 0 AND {p} = 0 THEN 1.0 WHEN {t} = 0 OR {p} = 0 THEN 0.0 ELSE 1.25 * {h} / (0.25 * {t} + {p}) END"


def f05(t="truth", p="predicted", h="hits") -> str:
    return F05.format(t=t, p=p, h=h)


def policy_cte(name: str, predicted: str, truth: str):
    """(name, body): truth, predictions and hits of every source-1 record."""
    return (name, f"""SELECT e.entity_id AS source1_entity_id, coalesce(t.n, 0) AS truth, coalesce(p.n, 0) AS predicted, coalesce(p.h, 0) AS hits FROM ent e
  LEFT JOIN (SELECT source1_entity_id, count(*) AS n FROM {truth} GROUP BY 1) t ON t.source1_entity_id = e.entity_id
  LEFT JOIN (SELECT q.source1_entity_id, count(*) AS n, count(g.candidate_entity_id) AS h FROM {predicted} q LEFT JOIN {truth} g USING (source1_entity_id, candidate_entity_id) GROUP BY 1) p ON p.source1_entity_id = e.entity_id
  WHERE starts_with(e.entity_id, 'S1-')""")


METRICS = f"""SELECT round(avg({f05()}), 9) AS macro_f05, round(sum(hits) / nullif(sum(predicted), 0), 9) AS precision, round(sum(hits) / nullif(sum(truth), 0), 9) AS recall,
  CAST(sum(predicted) AS BIGINT) AS n_predicted, CAST(sum(hits) AS BIGINT) AS n_hits, count(*) FILTER (truth = 0 AND predicted = 0) AS correctly_empty, count(*) FILTER (truth = 0 AND predicted > 0) AS fp_singletons"""
