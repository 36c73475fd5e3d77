"""DuckDB SQL that gives the results of the registered queries over the same parquet tables.

The statements are written on their own: dates by token lists, duplicates by
comparing all pairs, ancestors by a recursive query.
"""

from __future__ import annotations

MONTHS = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"
MONTH_TEXT = "'JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC'"


def fold(x: str) -> str:
    return f"lower(trim(strip_accents({x}), ' ' || chr(9) || chr(10) || chr(13)))"


def dashed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', '-', 'g'), '-')"


def code(letters: str) -> str:
    """Phonetic code of an upper-case letter text."""
    digits = f"translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    digits = f"regexp_replace({digits}, '[^0-9]', '0', 'g')"
    runs = (
        f"list_aggregate(list_filter(string_split({digits}, ''), lambda c, i: i = 1 OR c <> substr({digits}, (i - 1)::BIGINT, 1)), "
        "'string_agg', '')"
    )
    return f"substr({letters}, 1, 1) || rpad(substr(replace(substr({runs}, 2), '0', ''), 1, 3), 3, '0')"


def soundex(x: str) -> str:
    letters = f"regexp_replace(upper(strip_accents({x})), '[^A-Z]', '', 'g')"
    return f"CASE WHEN {letters} <> '' THEN {code(letters)} END"


def phonetic(x: str) -> str:
    letters = f"regexp_replace(upper(strip_accents({x})), '[^\\p{{L}}]', '', 'g')"
    return f"CASE WHEN coalesce({letters}, '') = '' THEN '' ELSE {code(letters)} END"


def halfeven(x: str, digits: int) -> str:
    """Rounding of the exact binary value of a double column."""
    s = 10**digits
    low = f"floor({x} * {s}e0)"
    half = f"({x})::FLOAT::DOUBLE"
    gap = f"(({half} * {2 * s}e0 - (2e0 * {low} + 1e0)) + ({x} - {half}) * {2 * s}e0)"
    return f"((CASE WHEN {gap} > 0 OR ({gap} = 0 AND {low}::BIGINT % 2 = 1) THEN {low} + 1e0 ELSE {low} END) / {s}e0)"


def title(x: str) -> str:
    """Every word capitalised."""
    return (
        f"list_aggregate(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')"
    )


DIGITS = r"regexp_full_match(trim(x, '.'''), '\d+')"
SLASH3 = r"regexp_full_match(trim(x, '.'''), '\d{1,2}[./-]\d{1,2}[./-]?\d{4}')"
SLASH = r"regexp_full_match(trim(x, '.'''), '(\d{1,2}[./-])?\d{1,2}[./-]?\d{4}')"
NUMBER = "trim(x, '.''')::BIGINT"


def last(tokens: str, value: str) -> str:
    """The last value the tokens give."""
    return f"list_filter(list_transform({tokens}, lambda x: CASE {value} END), lambda v: v IS NOT NULL)[-1]"


def parts(tokens: str, prefix: str) -> str:
    """Analytic year, month and day of a token list."""
    year = last(
        tokens,
        f"WHEN {DIGITS} THEN CASE WHEN {NUMBER} >= 1000 THEN {NUMBER}::INT END WHEN {SLASH} THEN right(trim(x, '.'''), 4)::INT",
    )
    month = last(
        tokens,
        f"WHEN list_contains({MONTHS}, x) THEN list_position({MONTHS}, x)::INT WHEN {SLASH3} AND NOT {DIGITS} "
        r"THEN regexp_extract(trim(x, '.'''), '^\d{1,2}[./-](\d{1,2})', 1)::INT",
    )
    day = last(
        tokens,
        f"WHEN {DIGITS} THEN CASE WHEN {NUMBER} BETWEEN 1 AND 31 THEN {NUMBER}::INT END WHEN {SLASH3} "
        r"THEN regexp_extract(trim(x, '.'''), '^(\d{1,2})', 1)::INT",
    )
    return f"{year} AS {prefix}y, {month} AS {prefix}m, {day} AS {prefix}d"


def iso(y: str, m: str, d: str) -> str:
    two = lambda p: f"lpad(greatest(coalesce({p}, 1), 1)::VARCHAR, 2, '0')"
    return f"lpad({y}::VARCHAR, 4, '0') || '-' || {two(m)} || '-' || {two(d)}"


def sort_key(y: str, m: str, d: str) -> str:
    return f"coalesce({y}::BIGINT * 10000 + greatest(coalesce({m}, 1), 1) * 100 + greatest(coalesce({d}, 1), 1), 0)"


# ------------------------------------------------------------ common tables

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def mon(i: str) -> str:
    return f"substr({MONTH_TEXT}, CAST(({i}) * 3 + 1 AS INT), 3)"


cte(
    "persons",
    "",
    f"""SELECT k + 1 AS person_id, 'I' || (k + 1) AS xref,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN replace(g, 'e', 'é') ELSE g END AS given_name,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 7 = 0 THEN upper(s) ELSE s END AS surname,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN yb::VARCHAR WHEN 2 THEN {mon('k % 12')} || ' ' || yb
    WHEN 3 THEN (1 + k % 28) || ' ' || {mon('k % 12')} || ' ' || yb WHEN 4 THEN 'ABT ' || yb
    WHEN 5 THEN 'BET ' || yb || ' AND ' || (yb + 3) WHEN 6 THEN 'BEF ' || yb
    WHEN 7 THEN yb || '-0' || (1 + k % 9) || '-1' || (k % 9)
    ELSE CASE WHEN k % 2 = 0 THEN 'unknown' ELSE (1 + k % 28) || '.' || (1 + k % 12) || '.' || yb END END AS birth_date,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN yd::VARCHAR WHEN 2 THEN 'AFT ' || yd
    ELSE (1 + k % 28) || ' ' || {mon('k % 12')} || ' ' || yd END AS death_date
FROM (SELECT c_custkey AS k, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS s,
        1700 + (c_custkey * 7919) % 250 AS yb, 1700 + (c_custkey * 7919) % 250 + (c_custkey * 31) % 95 - 3 AS yd
      FROM customer JOIN part ON p_partkey = c_custkey)""",
)
cte(
    "family_records",
    "",
    """SELECT t + 1 AS family_id, 'F' || (t + 1) AS xref, 'I' || (k + 1) AS husband_xref,
  'I' || (CASE WHEN k % 21 = 0 THEN k + 5000000 ELSE k + 2 END) AS wife_xref, t % 4 AS n_children, k
FROM (SELECT c_custkey // 3 AS t, min(c_custkey) AS k FROM customer GROUP BY 1)""",
)
cte(
    "family_child_records",
    "family_records",
    """SELECT family_id, xref AS family_xref, 'I' || (2 * k + 5 + j) AS child_xref, (j + 1)::INT AS sibling_order
FROM (SELECT *, unnest(range(n_children)) AS j FROM family_records)""",
)
cte(
    "raw_events",
    "",
    f"""SELECT o_orderkey AS event_id, o_custkey + 1 AS person_id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'birth' WHEN '2' THEN 'death' WHEN '3' THEN 'marriage'
    WHEN '4' THEN 'residence' ELSE 'baptism' END AS event_type,
  day(o_orderdate) || ' ' || {mon('month(o_orderdate) - 1')} || ' ' || year(o_orderdate) AS date_text,
  CASE o_orderkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN n_name || ' ,'
    ELSE replace(n_name, 'A', 'Á') END AS place
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
cte(
    "source_records",
    "",
    """SELECT s_suppkey AS seq, 'S' || s_suppkey AS xref,
  CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE 'Register ' || s_nationkey END AS title,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS author, 'Vol. ' || (s_suppkey % 7) AS publication
FROM supplier""",
)
cte(
    "media_records",
    "",
    """SELECT p_partkey AS seq, 'O' || p_partkey AS xref,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE replace(p_brand, '#', '') || '/' || p_partkey || '.jpg' END AS file, p_name AS title
FROM part""",
)
cte(
    "links",
    "persons family_records family_child_records",
    """SELECT 'I' || (k + 1) AS owner_xref, tag, target FROM (
  SELECT c_custkey AS k, 'SOUR' AS tag, 'S' || (c_custkey % 103) AS target FROM customer
  UNION ALL SELECT c_custkey, 'SOUR', 'S' || (c_custkey % 103) FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT c_custkey, 'SOUR', 'S' || ((c_custkey + 25) % 103) FROM customer WHERE c_custkey % 3 = 2
  UNION ALL SELECT c_custkey, 'OBJE', 'O' || (c_custkey - c_custkey % 10) FROM customer
  UNION ALL SELECT c_custkey, 'OBJE', 'O' || (c_custkey * 5) FROM customer WHERE c_custkey % 4 = 1
  UNION ALL SELECT c_custkey, 'NOTE', 'N' || (c_custkey % 1100) FROM customer
  UNION ALL SELECT c_custkey, 'FAMS', 'F' || (c_custkey + 1000000) FROM customer WHERE c_custkey % 97 = 0)
UNION ALL
SELECT owner_xref, tag, target FROM (
  SELECT husband_xref AS owner_xref, 'FAMS' AS tag, xref AS target FROM family_records
  UNION ALL SELECT wife_xref, 'FAMS', xref FROM family_records
  UNION ALL SELECT child_xref, 'FAMC', family_xref FROM family_child_records)
WHERE owner_xref IN (SELECT xref FROM persons)""",
)
cte(
    "record_xrefs",
    "persons family_records",
    """SELECT xref, person_id AS seq FROM persons
UNION ALL SELECT xref, person_id + 100000000 FROM persons WHERE person_id % 211 = 0
UNION ALL SELECT xref, family_id + 1000000000 FROM family_records""",
)
cte(
    "name_variants",
    "persons",
    """SELECT xref AS owner_xref, 1 AS seq, coalesce(given_name, '') AS given, coalesce(surname, '') AS surname FROM persons
WHERE given_name IS NOT NULL OR surname IS NOT NULL
UNION ALL
SELECT xref, 2, coalesce(given_name, ''), coalesce(upper(substr(surname, 1, 1)) || lower(substr(surname, 2)) || 's', '')
FROM persons WHERE person_id % 4 = 0""",
)
cte(
    "families",
    "family_records persons",
    """SELECT r.family_id, r.xref, f.person_id AS father_id, m.person_id AS mother_id FROM family_records r
LEFT JOIN persons f ON f.xref = r.husband_xref LEFT JOIN persons m ON m.xref = r.wife_xref""",
)
cte(
    "parent_children",
    "family_child_records persons families",
    """SELECT c.family_id, p.person_id AS child_id, f.father_id AS parent_id,
  CASE WHEN f.father_id IS NOT NULL THEN 'father' END AS role, c.sibling_order
FROM family_child_records c JOIN persons p ON p.xref = c.child_xref JOIN families f ON f.family_id = c.family_id""",
)
PLACE_KEY = (
    "nullif(lower(translate(trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '\\s*,\\s*$', '')), "
    "'àáâäãåèéêëìíîïòóôöùúûüçñ', 'aaaaaaeeeeiiiioooouuuucn')), '')"
)
cte("spelled", "raw_events", f"SELECT *, {PLACE_KEY.format(x='place')} AS place_key FROM raw_events")
cte(
    "places",
    "spelled",
    "SELECT place_key, arg_min(place, event_id) AS name FROM spelled WHERE place_key IS NOT NULL GROUP BY 1",
)
cte(
    "texts",
    "persons raw_events",
    """SELECT DISTINCT date_text FROM (SELECT birth_date AS date_text FROM persons UNION ALL SELECT death_date FROM persons
  UNION ALL SELECT date_text FROM raw_events) WHERE date_text IS NOT NULL""",
)
cte("tokens", "texts", "SELECT date_text, string_split_regex(upper(trim(date_text)), '[\\s,]+') AS t FROM texts")
_QUALIFIERS = (
    "CASE x WHEN 'ABT' THEN 'about' WHEN 'ABOUT' THEN 'about' WHEN 'BEF' THEN 'before' WHEN 'BEFORE' THEN 'before' "
    "WHEN 'AFT' THEN 'after' WHEN 'AFTER' THEN 'after' WHEN 'BET' THEN 'between' WHEN 'BETWEEN' THEN 'between' "
    "WHEN 'FROM' THEN 'from' WHEN 'TO' THEN 'to' WHEN 'EST' THEN 'estimated' WHEN 'CIR' THEN 'estimated' END"
)
cte(
    "imported",
    "tokens",
    f"""SELECT date_text, qualifier, y AS year, m AS month, d AS day,
  CASE WHEN y IS NOT NULL THEN {iso('y', 'm', 'd')} END AS iso, y IS NOT NULL AS valid
FROM (SELECT date_text,
  coalesce(list_filter(list_transform(t, lambda x: {_QUALIFIERS}), lambda v: v IS NOT NULL)[1], 'exact') AS qualifier,
  {last('t', f'WHEN {DIGITS} AND {NUMBER} >= 1000 THEN {NUMBER}::INT')} AS y,
  {last('t', f'WHEN list_contains({MONTHS}, x) THEN list_position({MONTHS}, x)::INT')} AS m,
  {last('t', f'WHEN {DIGITS} AND {NUMBER} BETWEEN 1 AND 31 THEN {NUMBER}::INT')} AS d
  FROM tokens)""",
)
_MODIFIERS = (
    "CASE t[1] WHEN 'ABT' THEN 'about' WHEN 'ABOUT' THEN 'about' WHEN 'AFT' THEN 'after' WHEN 'AFTER' THEN 'after' "
    "WHEN 'BEF' THEN 'before' WHEN 'BEFORE' THEN 'before' WHEN 'BET' THEN 'between' WHEN 'BETWEEN' THEN 'between' "
    "WHEN 'FROM' THEN 'from' WHEN 'TO' THEN 'to' WHEN 'EST' THEN 'estimated' WHEN 'CAL' THEN 'calculated' "
    "WHEN 'INT' THEN 'interpreted' WHEN 'PHRASE' THEN 'interpreted' ELSE 'exact' END"
)
cte(
    "split_dates",
    "tokens",
    r"""SELECT *, CASE WHEN is_range THEN t[2:cut - 1] ELSE t END AS ta, CASE WHEN is_range THEN t[cut + 1:] END AS tb FROM (
  SELECT *, len(t) >= 4 AND t[1] IN ('BET', 'BETWEEN', 'FROM') AND cut IS NOT NULL AND cut < len(t) AND NOT is_iso AS is_range FROM (
    SELECT *, regexp_full_match(trim(date_text), '\d{4}-\d{2}-\d{2}') AS is_iso,
      list_filter(list_transform(t, lambda x, i: CASE WHEN x IN ('AND', 'TO') AND i > 1 THEN i END), lambda v: v IS NOT NULL)[1] AS cut
    FROM tokens))""",
)
cte(
    "split_parts",
    "split_dates",
    f"SELECT date_text, t, is_iso, is_range, {parts('ta', 'a')}, {parts('tb', 'z')} FROM split_dates",
)
cte(
    "analytic",
    "split_parts",
    f"""SELECT date_text, year, month, day, precision, modifier, start_iso AS iso, start_iso,
  CASE WHEN is_range THEN CASE WHEN zy IS NOT NULL THEN {iso('zy', 'zm', 'zd')} END ELSE start_iso END AS end_iso,
  {sort_key('year', 'month', 'day')} AS start_sort,
  CASE WHEN is_range AND zy IS NOT NULL THEN {sort_key('zy', 'zm', 'zd')} ELSE {sort_key('year', 'month', 'day')} END AS end_sort
FROM (SELECT *, CASE WHEN year IS NULL THEN NULL WHEN is_iso THEN date_text
    WHEN is_range OR precision = 3 THEN {iso('year', 'month', 'day')} END AS start_iso
  FROM (SELECT *, CASE WHEN year IS NULL THEN 0 WHEN is_iso THEN 3 WHEN month > 0 AND day > 0 THEN 3 WHEN month > 0 THEN 2 ELSE 1 END AS precision
    FROM (SELECT date_text, is_iso, is_range, zy, CASE WHEN zy IS NOT NULL THEN zm END AS zm, CASE WHEN zy IS NOT NULL THEN zd END AS zd,
        CASE WHEN is_iso THEN 'exact' ELSE {_MODIFIERS} END AS modifier,
        CASE WHEN is_iso THEN substr(date_text, 1, 4)::INT ELSE ay END AS year,
        CASE WHEN is_iso THEN substr(date_text, 6, 2)::INT WHEN ay IS NOT NULL THEN am END AS month,
        CASE WHEN is_iso THEN substr(date_text, 9, 2)::INT WHEN ay IS NOT NULL THEN ad END AS day
      FROM split_parts)))""",
)
cte(
    "events",
    "spelled places imported",
    """SELECT e.event_id, e.person_id, e.event_type, e.date_text, i.iso AS date_iso, i.year AS date_year, e.place_key, p.name AS place
FROM spelled e LEFT JOIN imported i ON i.date_text = e.date_text LEFT JOIN places p ON p.place_key = e.place_key""",
)
BIRTHS, DEATHS = "('birth', 'christening', 'baptism')", "('death', 'burial')"
cte(
    "life",
    "events",
    f"""SELECT person_id,
  arg_min(date_text, event_id) FILTER (WHERE event_type IN {BIRTHS} AND date_text <> '') AS birth_text,
  arg_min(date_text, event_id) FILTER (WHERE event_type IN {DEATHS} AND date_text <> '') AS death_text,
  arg_min(date_year, event_id) FILTER (WHERE event_type IN {BIRTHS}) AS birth_year,
  arg_min(place, event_id) FILTER (WHERE event_type IN {BIRTHS}) AS birth_place,
  arg_min(date_year, event_id) FILTER (WHERE event_type IN {DEATHS}) AS death_year,
  arg_min(place, event_id) FILTER (WHERE event_type IN {DEATHS}) AS death_place,
  count(*) AS event_count
FROM events GROUP BY person_id""",
)
cte(
    "spouse_edges",
    "families",
    """SELECT father_id AS person_id, family_id FROM families WHERE father_id IS NOT NULL
UNION ALL SELECT mother_id, family_id FROM families WHERE mother_id IS NOT NULL""",
)
cte(
    "parent_edges",
    "spouse_edges parent_children",
    "SELECT DISTINCT s.person_id, c.child_id FROM spouse_edges s JOIN parent_children c USING (family_id)",
)
cte(
    "people",
    "persons life analytic parent_children spouse_edges parent_edges",
    """SELECT p.person_id, p.xref, p.given_name, p.surname, p.sex, p.birth_date, p.death_date,
  coalesce(nullif(concat_ws(' ', p.given_name, p.surname), ''), p.xref) AS display_name,
  l.birth_year, l.birth_place, l.death_year, l.death_place, coalesce(l.event_count, 0) AS event_count,
  p.person_id IN (SELECT child_id FROM parent_children) AS has_parents,
  p.person_id IN (SELECT person_id FROM spouse_edges) AS has_family,
  p.person_id IN (SELECT person_id FROM parent_edges) AS has_children,
  b.year AS byear, b.start_sort AS bs, b.end_sort AS be, b.precision AS bprec, b.iso AS biso, b.modifier AS bmod,
  d.year AS dyear, d.start_sort AS ds, d.end_sort AS de, d.precision AS dprec, d.iso AS diso, d.modifier AS dmod
FROM (SELECT q.* REPLACE (coalesce(q.birth_date, birth_text) AS birth_date, coalesce(q.death_date, death_text) AS death_date)
      FROM persons q LEFT JOIN (SELECT person_id AS pid, birth_text, death_text FROM life) t ON q.person_id = t.pid) p
LEFT JOIN life l ON l.person_id = p.person_id
LEFT JOIN analytic b ON b.date_text = p.birth_date LEFT JOIN analytic d ON d.date_text = p.death_date""",
)
cte(
    "person_sources",
    "links persons source_map",
    """SELECT DISTINCT p.person_id, m.source_xref FROM links l JOIN persons p ON p.xref = l.owner_xref
JOIN source_map m ON m.xref = l.target WHERE l.tag = 'SOUR'""",
)
cte(
    "source_map",
    "source_records",
    """SELECT r.xref, r.title, k.source_xref, k.author FROM (SELECT xref, coalesce(nullif(title, ''), xref) AS title FROM source_records) r
JOIN (SELECT coalesce(nullif(title, ''), xref) AS title, arg_min(xref, seq) AS source_xref, nullif(arg_min(author, seq), '') AS author
  FROM source_records GROUP BY 1) k USING (title)""",
)


def _quality(name_sign: str = "-", sourced: str = "event_count > 0") -> str:
    given, surname = "given_name IS NOT NULL", "surname IS NOT NULL"
    broken = "coalesce(dyear < byear, false)"
    terms = [
        f"CASE WHEN {given} AND {surname} THEN 0.25e0 WHEN {given} THEN {name_sign}0.15e0 WHEN {surname} THEN {name_sign}0.1e0 ELSE 0e0 END",
        "CASE WHEN sex IS NOT NULL THEN 0.05e0 ELSE 0e0 END",
        "CASE WHEN has_parents THEN 0.15e0 ELSE 0e0 END",
        "CASE WHEN has_children THEN 0.15e0 ELSE 0e0 END",
        f"CASE WHEN {sourced} THEN 0.15e0 ELSE 0e0 END",
        "CASE WHEN event_count > 0 THEN 0.1e0 ELSE 0e0 END",
        "CASE WHEN birth_date IS NOT NULL THEN 0.05e0 ELSE 0e0 END",
        "CASE WHEN birth_date IS NOT NULL THEN 0.1e0 ELSE 0e0 END",
        "CASE WHEN death_date IS NOT NULL THEN 0.05e0 ELSE 0e0 END",
        f"CASE WHEN {broken} THEN -0.2e0 ELSE 0e0 END",
    ]
    total = " + ".join(f"({t})" for t in terms)
    return (
        f"SELECT person_id, xref, {halfeven('raw', 2)} AS score FROM "
        f"(SELECT person_id, xref, greatest(0e0, least(1e0, {total})) AS raw FROM people)"
    )


cte("scores", "people", _quality())

# All pairs of persons, scored rule by rule.
cte(
    "rated",
    "people",
    f"""SELECT person_id, xref, display_name, sex, given_name IS NOT NULL AS has_g, surname IS NOT NULL AS has_s,
  coalesce({fold('given_name')}, '') AS gf, coalesce({fold('surname')}, '') AS sf,
  {phonetic("coalesce(given_name, '')")} AS gk, {phonetic("coalesce(surname, '')")} AS sk,
  byear, bs, be, dyear, has_parents AS fc, has_family AS fs, has_children AS ch, nullif({fold('birth_place')}, '') AS pl
FROM people""",
)


def _similar(x: str) -> str:
    """Greater of edit similarity and the phonetic floor, not yet rounded."""
    return (
        f"CASE WHEN a.{x}f = b.{x}f THEN 1e0 ELSE greatest(1e0 - levenshtein(a.{x}f, b.{x}f)::DOUBLE / greatest(length(a.{x}f), length(b.{x}f)), "
        f"CASE WHEN a.{x}k = b.{x}k THEN 0.55e0 ELSE 0e0 END) END"
    )


cte(
    "compared",
    "rated",
    f"""SELECT a_id, b_id, a_xref, b_xref, a_name, b_name, bscore, dscore, both_c, both_s, both_ch, pscore, same_sex, g, s,
  a_has_g, a_has_s FROM (
  SELECT *, CASE WHEN graw IS NULL THEN 0e0 ELSE {halfeven('graw', 2)} END AS g, CASE WHEN sraw IS NULL THEN 0e0 ELSE {halfeven('sraw', 2)} END AS s FROM (
    SELECT a.person_id AS a_id, b.person_id AS b_id, a.xref AS a_xref, b.xref AS b_xref, a.display_name AS a_name, b.display_name AS b_name,
      a.has_g AS a_has_g, a.has_s AS a_has_s,
      CASE WHEN a.has_g AND b.has_g THEN {_similar('g')} END AS graw,
      CASE WHEN a.has_s AND b.has_s THEN {_similar('s')} END AS sraw,
      CASE WHEN a.byear IS NULL OR b.byear IS NULL THEN 0 WHEN a.byear = b.byear THEN 1 WHEN a.bs <= b.be AND b.bs <= a.be THEN 2
        WHEN abs(a.byear - b.byear) <= 1 THEN 3 ELSE 0 END AS bscore,
      CASE WHEN a.dyear IS NULL OR b.dyear IS NULL THEN 0 WHEN a.dyear = b.dyear THEN 1 WHEN abs(a.dyear - b.dyear) <= 1 THEN 2 ELSE 0 END AS dscore,
      a.fc AND b.fc AS both_c, a.fs AND b.fs AS both_s, a.ch AND b.ch AS both_ch,
      CASE WHEN a.pl = b.pl THEN 1 WHEN contains(a.pl, b.pl) OR contains(b.pl, a.pl) THEN 2 ELSE 0 END AS pscore,
      coalesce(a.sex = b.sex, false) AS same_sex
    FROM rated a JOIN rated b ON a.person_id < b.person_id))""",
)
cte(
    "shared",
    "parent_children spouse_edges parent_edges",
    """SELECT a_id, b_id, string_agg(f, ', ' ORDER BY f::BIGINT) FILTER (WHERE kind = 'p') AS p, string_agg(f, ', ' ORDER BY f::BIGINT) FILTER (WHERE kind = 'm') AS m,
  count(*) FILTER (WHERE kind = 'c') AS c FROM (
  SELECT DISTINCT a.child_id AS a_id, b.child_id AS b_id, 'p' AS kind, a.family_id::VARCHAR AS f FROM parent_children a JOIN parent_children b USING (family_id) WHERE a.child_id < b.child_id
  UNION ALL SELECT DISTINCT a.person_id, b.person_id, 'm', a.family_id::VARCHAR FROM spouse_edges a JOIN spouse_edges b USING (family_id) WHERE a.person_id < b.person_id
  UNION ALL SELECT DISTINCT a.person_id, b.person_id, 'c', a.child_id::VARCHAR FROM parent_edges a JOIN parent_edges b USING (child_id) WHERE a.person_id < b.person_id)
GROUP BY 1, 2""",
)
cte("child_counts", "parent_edges", "SELECT person_id, count(*) AS n FROM parent_edges GROUP BY 1")


def _candidates(
    threshold: float = 0.55,
    weights: dict[str, float] | None = None,
    place: bool = False,
    custom: str | None = None,
) -> str:
    """Candidate pairs as a SELECT over the compared pairs."""
    w = {"name": 0.35, "birth": 0.2, "death": 0.1, "parents": 0.1, "marriage": 0.1, "children": 0.1, "place": 0.05}
    w.update(weights or {})
    total = sum(w.values()) + (0.1 if custom else 0.0)
    high, low = "greatest(g, s)", "least(CASE WHEN a_has_g THEN g ELSE s END, CASE WHEN a_has_s THEN s ELSE g END)"
    by_case = lambda c, *v: "CASE " + " ".join(f"WHEN {c} = {i + 1} THEN {x}" for i, x in enumerate(v)) + " ELSE 0e0 END"
    rules = {
        "name": ("nscore", "greatest(g, s)", "'noms similars'"),
        "birth": (
            by_case("bscore", "1e0", "0.8e0", "0.5e0"), by_case("bscore", "0.9e0", "0.7e0", "0.5e0"),
            "CASE bscore WHEN 1 THEN 'mateix any de naixement' WHEN 2 THEN 'períodes de naixement solapats' ELSE 'anys propers' END",
        ),
        "death": (
            by_case("dscore", "1e0", "0.5e0"), by_case("dscore", "0.9e0", "0.5e0"),
            "CASE dscore WHEN 1 THEN 'mateix any de defunció' ELSE 'anys propers' END",
        ),
        "parents": (
            "CASE WHEN p IS NOT NULL THEN 1e0 WHEN both_c THEN 0.2e0 ELSE 0e0 END",
            "CASE WHEN p IS NOT NULL THEN 0.95e0 ELSE 0.4e0 END",
            "CASE WHEN p IS NOT NULL THEN 'mateixes famílies paternals {' || p || '}' ELSE 'famílies paternals diferents' END",
        ),
        "marriage": (
            "CASE WHEN m IS NOT NULL THEN 1e0 WHEN both_s THEN 0.15e0 ELSE 0e0 END",
            "CASE WHEN m IS NOT NULL THEN 0.9e0 ELSE 0.3e0 END",
            "CASE WHEN m IS NOT NULL THEN 'mateix matrimoni {' || m || '}' ELSE 'matrimonis diferents' END",
        ),
        "children": (
            "CASE WHEN c > 0 THEN jaccard WHEN both_ch THEN 0.1e0 ELSE 0e0 END",
            "CASE WHEN c > 0 THEN jaccard ELSE 0.3e0 END",
            "CASE WHEN c > 0 THEN 'fills en comú: ' || c ELSE 'fills diferents' END",
        ),
    }
    if place:
        rules["place"] = (
            by_case("pscore", "1e0", "0.7e0"), by_case("pscore", "0.9e0", "0.6e0"),
            "CASE pscore WHEN 1 THEN 'mateix lloc de naixement' ELSE 'llocs relacionats' END",
        )
    if custom:
        w["sex"] = 0.1
        rules["sex"] = ("CASE WHEN same_sex THEN 0.5e0 ELSE 0e0 END", "0.5e0", "'mateix sexe'")
    points = ", ".join(f"{s} AS s_{r}, {c} AS c_{r}, {t} AS t_{r}" for r, (s, c, t) in rules.items())
    add = lambda p: " + ".join(f"CASE WHEN s_{r} > 0 THEN {w[r]!r}::DOUBLE * {p}_{r} ELSE 0e0 END" for r in rules)
    used = "concat_ws('|', " + ", ".join(f"CASE WHEN s_{r} > 0 THEN '{r}' END" for r in rules) + ")"
    said = "concat_ws('|', " + ", ".join(f"CASE WHEN s_{r} > 0 THEN t_{r} END" for r in rules) + ")"
    first = "coalesce(" + ", ".join(f"CASE WHEN s_{r} > 0 THEN t_{r} END" for r in rules) + ")"
    return f"""SELECT a_id, b_id, a_xref, b_xref, a_name, b_name, score, {halfeven('sure', 3)} AS confidence, rules_used, reasons, first_reason FROM (
  SELECT *, {halfeven('total', 3)} AS score FROM (
    SELECT *, (0e0 + {add('s')}) / {total!r}::DOUBLE AS total, (0e0 + {add('c')}) / {total!r}::DOUBLE AS sure,
      {used} AS rules_used, {said} AS reasons, {first} AS first_reason FROM (
      SELECT *, {points} FROM (
        SELECT *, {halfeven('nraw', 2)} AS nscore, CASE WHEN c > 0 THEN {halfeven('craw', 2)} END AS jaccard FROM (
          SELECT q.*, h.p, h.m, coalesce(h.c, 0) AS c,
            CASE WHEN a_has_g OR a_has_s THEN 0.6e0 * {high} + 0.4e0 * {low} ELSE 0e0 END AS nraw,
            h.c::DOUBLE / (n1.n + n2.n - h.c) AS craw
          FROM compared q LEFT JOIN shared h ON h.a_id = q.a_id AND h.b_id = q.b_id
          LEFT JOIN child_counts n1 ON n1.person_id = q.a_id LEFT JOIN child_counts n2 ON n2.person_id = q.b_id)))))
WHERE score >= {threshold!r}::DOUBLE"""


cte("candidates", "compared shared child_counts", _candidates())


def _finding(category: str, severity: str, message: str, ref: str, source: str, metadata: str = "'{}'") -> str:
    return f"SELECT '{category}' AS category, '{severity}' AS severity, {message} AS message, {ref} AS ref, {metadata} AS metadata FROM {source}"


def _groups(column: str, source: str) -> str:
    """Distinct spellings by folded form, longest first."""
    return f"""(SELECT key, list(raw ORDER BY length(raw) DESC, raw) AS v FROM
  (SELECT DISTINCT {column} AS raw, {fold(column)} AS key FROM {source} WHERE {column} <> '') WHERE key <> '' GROUP BY key HAVING count(*) > 1)"""


_DATES_OFF = "(SELECT xref, birth_date AS raw, byear AS year, 'naixement' AS label FROM people UNION ALL SELECT xref, death_date, dyear, 'defunció' FROM people)"
FINDINGS = {
    "finding_impossible_dates": _finding(
        "date", "warning", "'data de ' || label || ' impossible: ''' || raw || ''''", "xref",
        f"{_DATES_OFF} WHERE raw IS NOT NULL AND (year IS NULL OR year NOT BETWEEN 1500 AND 2100)",
        "'{\"year\":' || coalesce(year::VARCHAR, 'null') || '}'",
    ),
    "finding_missing_births": _finding("completeness", "warning", "'persona sense naixement'", "xref", "people WHERE birth_date IS NULL"),
    "finding_missing_deaths": _finding(
        "completeness", "info", "'persona sense defunció'", "xref",
        r"people WHERE death_date IS NULL AND sex IS NOT NULL AND NOT coalesce(regexp_matches(birth_date, '\b1[5-8]\d{2}\b'), false)",
    ),
    "finding_chronology": _finding(
        "chronology", "error", "'defunció (' || dyear || ') abans de naixement (' || byear || ')'", "xref", "people WHERE dyear < byear"
    ),
    "finding_duplicates": _finding(
        "duplicate", "warning", "'possible duplicat (' || first_reason || ')'", "a_xref || ' / ' || b_xref", "candidates"
    ),
    "finding_no_parents": _finding("relationships", "warning", "'persona sense pares'", "xref", "people WHERE NOT has_parents"),
    "finding_no_family": _finding("relationships", "info", "'persona sense família pròpia'", "xref", "people WHERE NOT has_family"),
    "finding_places": _finding(
        "place", "warning", "'topònims inconsistents: ' || list_aggregate(v, 'string_agg', ', ')", "v[1]", _groups("name", "places")
    ),
    "finding_given_names": _finding(
        "name", "info", "'variants de nom: ' || list_aggregate(v[2:], 'string_agg', ', ')", "v[1]", _groups("given_name", "people")
    ),
}
FINDING_NEEDS = "people candidates places"
cte("findings", FINDING_NEEDS, " UNION ALL ".join(FINDINGS.values()))

_TASKS = """SELECT person_id, xref, objective, kind, hypothesis, step FROM (
  SELECT person_id, xref, 1 AS step, 'birth' AS kind, CASE WHEN birth_date IS NULL THEN 'Buscar baptisme/naixement' ELSE 'Precisar data de naixement (dia i mes)' END AS objective,
    CASE WHEN birth_date IS NULL THEN 'Es desconeix la data de naixement' ELSE 'Només es coneix l''any' END AS hypothesis
  FROM people WHERE birth_date IS NULL OR bprec = 1
  UNION ALL SELECT person_id, xref, 2, 'marriage', 'Buscar matrimoni', 'No consta cap unió' FROM people WHERE sex IS NOT NULL AND NOT has_family
  UNION ALL SELECT person_id, xref, 3, 'death', 'Buscar defunció', 'Es desconeix la defunció' FROM people WHERE death_date IS NULL
  UNION ALL SELECT person_id, xref, 4, 'parents', 'Identificar pares', 'No es coneix la família d''origen' FROM people WHERE NOT has_parents)"""
cte("person_tasks", "people", _TASKS)
cte(
    "duplicate_tasks",
    "candidates",
    f"""SELECT a_id AS person_id, a_xref AS xref, 'Revisar possible duplicat entre ' || a_name || ' i ' || b_name AS objective, 'duplicate' AS kind,
  'Similitud ' || printf('%.2f', {halfeven('score', 2)}) AS hypothesis, b_id, score FROM candidates""",
)
cte(
    "tasks",
    "person_tasks duplicate_tasks",
    """SELECT *, 'open' AS status, CASE WHEN kind IN ('duplicate', 'death') THEN 'high' WHEN kind = 'parents' THEN 'low' ELSE 'medium' END AS priority FROM (
  SELECT person_id, xref, objective, kind, hypothesis, 0 AS block, 0e0 AS rank, person_id AS i, step AS j FROM person_tasks
  UNION ALL SELECT person_id, xref, objective, kind, hypothesis, 1, -score, person_id, b_id FROM duplicate_tasks)""",
)
cte(
    "parent_links",
    "families parent_children",
    """SELECT DISTINCT c.child_id, p.parent_id FROM parent_children c JOIN (
  SELECT family_id, father_id AS parent_id FROM families UNION ALL SELECT family_id, mother_id FROM families) p USING (family_id)
WHERE p.parent_id IS NOT NULL""",
)
cte(
    "walk",
    "persons parent_links",
    """SELECT root_id, person_id, min(depth)::INT AS depth FROM (
  WITH RECURSIVE steps(root_id, person_id, depth) AS (
    SELECT person_id, person_id, 0 FROM persons
    UNION SELECT s.root_id, l.parent_id, s.depth + 1 FROM steps s JOIN parent_links l ON l.child_id = s.person_id WHERE s.depth < 6)
  SELECT * FROM steps) GROUP BY 1, 2""",
)
cte(
    "import_events",
    "raw_events family_records",
    """SELECT person_id, NULL::BIGINT AS family_id, event_type, date_text, place FROM raw_events
UNION ALL SELECT NULL, family_id, 'marriage', (1800 + family_id % 150)::VARCHAR, 'Parish ' || (family_id % 11) FROM family_records""",
)
cte(
    "addresses",
    "",
    """SELECT CASE WHEN c_custkey % 3 = 0 THEN p_name || ' de la ' || n_name WHEN c_custkey % 3 = 1 THEN n_name || ' ' || p_name || ' parish ' || (c_custkey % 5) WHEN c_custkey % 2 = 0 THEN p_name ELSE upper(replace(p_name, ' ', '-')) END AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN part ON c_custkey = p_partkey""",
)
STOP = "('la', 'el', 'els', 'les', 'de', 'del', 'dels', 'l', 'san', 'santa', 'st')"
cte(
    "place_sets",
    "addresses",
    f"""SELECT place, list_distinct(list_filter(string_split_regex({fold('place')}, '\\s+'), lambda w: w <> '' AND w NOT IN {STOP})) AS t
FROM (SELECT DISTINCT name AS place FROM addresses)""",
)
cte(
    "words",
    "",
    f"""SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex({fold('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS token FROM documents""",
)
cte(
    "merge_decisions", "persons",
    """SELECT d.*, row_number() OVER (ORDER BY seq, primary_id, secondary_id) AS rank, a.person_id AS first_id, b.person_id AS second_id,
  upper(coalesce(a.xref, '')) = upper(coalesce(b.xref, '')) AS same
FROM (SELECT (c_custkey * 7919) % 1000003 AS seq, CASE WHEN c_custkey % 7 = 0 THEN 10 ELSE c_custkey + 1 END AS primary_id,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 WHEN c_custkey % 5 = 1 THEN c_custkey + 1000000 ELSE c_custkey + 2 END AS secondary_id FROM customer) d
LEFT JOIN persons a ON a.person_id = primary_id LEFT JOIN persons b ON b.person_id = secondary_id""",
)
# One decision after the other, with the list of those removed so far.
cte(
    "merge_loop", "merge_decisions",
    """SELECT 0::BIGINT AS rank, NULL::BIGINT AS primary_id, NULL::BIGINT AS secondary_id, NULL::VARCHAR AS conflict, []::BIGINT[] AS gone
UNION ALL
SELECT rank, primary_id, secondary_id, conflict, CASE WHEN conflict IS NULL THEN list_append(gone, secondary_id) ELSE gone END
FROM (SELECT d.rank, d.primary_id, d.secondary_id, merge_loop.gone, CASE WHEN d.primary_id = d.secondary_id THEN 'No es pot fusionar una persona amb si mateixa'
  WHEN first_id IS NULL OR second_id IS NULL OR list_contains(gone, first_id) OR list_contains(gone, second_id) THEN 'Una de les persones no existeix'
  WHEN same THEN 'xref duplicat; revisa la coherència' END AS conflict
FROM merge_loop JOIN merge_decisions d ON d.rank = merge_loop.rank + 1)""",
)
cte("merges", "merge_loop", "SELECT primary_id, secondary_id, conflict FROM merge_loop WHERE rank > 0")


def statement(needs: str, body: str) -> str:
    """A full statement: the common tables it needs, in order, and its body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    loops = "merge_loop" in order
    common = ",\n".join(f"{name} AS{'' if name == 'merge_loop' else ' MATERIALIZED'} ({CTES[name][1]})" for name in order)
    return f"WITH {'RECURSIVE ' if loops else ''}{common}\n{body}"


ORACLE: dict[str, str] = {}


def oracle(name: str, needs: str, body: str) -> None:
    ORACLE[name] = statement(needs, body)


# ------------------------------------------------------------------- files

# Every line of the rendered files, by level, tag and tag of the parent.
_FILE_LINES = r"""(
  SELECT 0 AS level, 'INDI' AS tag, NULL AS parent_tag, count(*) AS n, 0 AS with_value FROM persons
  UNION ALL SELECT 1, 'NAME', 'INDI', count(*), count(*) FROM persons WHERE given_name IS NOT NULL OR surname IS NOT NULL
  UNION ALL SELECT 1, 'SEX', 'INDI', count(*), count(*) FROM persons WHERE sex IS NOT NULL
  UNION ALL SELECT 1, t, 'INDI', count(*), 0 FROM (SELECT CASE event_type WHEN 'birth' THEN 'BIRT' WHEN 'death' THEN 'DEAT' WHEN 'marriage' THEN 'MARR' WHEN 'residence' THEN 'RESI' ELSE 'BAPM' END AS t FROM raw_events) GROUP BY t
  UNION ALL SELECT 2, c, t, count(*), count(*) FROM (SELECT CASE event_type WHEN 'birth' THEN 'BIRT' WHEN 'death' THEN 'DEAT' WHEN 'marriage' THEN 'MARR' WHEN 'residence' THEN 'RESI' ELSE 'BAPM' END AS t, unnest(['DATE', 'PLAC']) AS c FROM raw_events) GROUP BY t, c
  UNION ALL SELECT 1, tag, 'INDI', count(*), count(*) FROM links GROUP BY tag
  UNION ALL SELECT 0, 'FAM', NULL, count(*), 0 FROM family_records
  UNION ALL SELECT 0, 'HEAD', NULL, 1, 0 UNION ALL SELECT 1, 'CHAR', 'HEAD', 1, 1
  UNION ALL SELECT 1, 'HUSB', 'FAM', count(*), count(*) FROM family_records
  UNION ALL SELECT 1, 'WIFE', 'FAM', count(*), count(*) FROM family_records
  UNION ALL SELECT 1, 'CHIL', 'FAM', count(*), count(*) FROM family_child_records
  UNION ALL SELECT 0, 'SOUR', NULL, count(*), 0 FROM source_records
  UNION ALL SELECT 1, 'TITL', 'SOUR', count(*), count(*) FROM source_records WHERE title <> ''
  UNION ALL SELECT 1, 'AUTH', 'SOUR', count(*), count(*) FROM source_records WHERE author <> ''
  UNION ALL SELECT 1, 'PUBL', 'SOUR', count(*), count(*) FROM source_records
  UNION ALL SELECT 0, 'OBJE', NULL, count(*), 0 FROM media_records
  UNION ALL SELECT 1, 'FILE', 'OBJE', count(*), count(*) FROM media_records WHERE file IS NOT NULL
  UNION ALL SELECT 1, 'TITL', 'OBJE', count(*), count(*) FROM media_records
  UNION ALL SELECT 0, 'NOTE', NULL, count(*), count(*) FILTER (WHERE trim(string_split(text, chr(10))[1]) <> '') FROM documents
  UNION ALL SELECT 1, 'CONT', 'NOTE', count(*), count(*) FILTER (WHERE trim(l) <> '') FROM (SELECT unnest(string_split(text, chr(10))[2:]) AS l FROM documents))"""
_FILE_NEEDS = "persons raw_events links family_records family_child_records source_records media_records"
oracle(
    "gedcom_lines", _FILE_NEEDS,
    f"SELECT level, tag, sum(n)::BIGINT AS n, sum(with_value)::BIGINT AS with_value FROM {_FILE_LINES} GROUP BY level, tag HAVING sum(n) > 0",
)
oracle("gedcom_tree", _FILE_NEEDS, f"SELECT parent_tag, tag, sum(n)::BIGINT AS n FROM {_FILE_LINES} GROUP BY parent_tag, tag HAVING sum(n) > 0")
oracle(
    "gedcom_rejected_lines",
    "",
    r"""SELECT path, reason, count(*) AS n, min(line_no) AS first_line FROM (
  SELECT path, line_no, CASE WHEN NOT regexp_matches(l, '^\d') THEN 'nivell no numèric' WHEN trim(substr(l, 2)) = '' THEN 'falta el tag'
    WHEN starts_with(trim(substr(l, 2)), '@') AND NOT contains(trim(substr(l, 2)), ' ') THEN 'punter sense tag' END AS reason
  FROM (SELECT doc_id::VARCHAR AS path, trim(unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'))) AS l, unnest(range(1, 1 + len(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]')))) AS line_no FROM documents)
  WHERE l <> '') WHERE reason IS NOT NULL GROUP BY path, reason""",
)
oracle(
    "gedcom_documents", _FILE_NEEDS,
    """SELECT 'INDI' AS tag, count(*) AS n, count(DISTINCT xref) AS ids FROM persons UNION ALL SELECT 'FAM', count(*), count(DISTINCT xref) FROM family_records
UNION ALL SELECT 'SOUR', count(*), count(DISTINCT xref) FROM source_records UNION ALL SELECT 'OBJE', count(*), count(DISTINCT xref) FROM media_records
UNION ALL SELECT 'NOTE', count(*), count(DISTINCT doc_id) FROM documents""",
)
oracle("gedcom_persons", "persons", "SELECT xref, sex, coalesce(given_name, '') AS given, coalesce(surname, '') AS surname FROM persons")
oracle(
    "gedcom_names", "persons",
    "SELECT xref AS owner_xref, 1 AS position, coalesce(given_name, '') AS given, coalesce(surname, '') AS surname, '' AS suffix FROM persons WHERE given_name IS NOT NULL OR surname IS NOT NULL",
)
oracle("gedcom_families", "family_records", "SELECT xref, husband_xref, wife_xref FROM family_records")
oracle("gedcom_family_children", "family_child_records", "SELECT family_xref, child_xref, sibling_order FROM family_child_records")
oracle("gedcom_events", "raw_events", "SELECT 'I' || person_id AS owner_xref, 'person' AS owner_kind, event_type, date_text, trim(place) AS place FROM raw_events")
oracle(
    "gedcom_first_births", "raw_events",
    "SELECT 'person' AS owner_kind, 'I' || person_id AS owner_xref, arg_min(date_text, event_id) AS date_text, trim(arg_min(place, event_id)) AS place FROM raw_events WHERE event_type = 'birth' GROUP BY person_id",
)
oracle("gedcom_sources", "source_records", "SELECT xref, title, author, publication, '' AS page FROM source_records")
oracle("gedcom_media", "media_records", "SELECT xref, coalesce(file, '') AS file, title FROM media_records")
oracle("gedcom_notes", "", "SELECT 'N' || doc_id AS xref, md5(text) AS text_md5, length(text) AS n_chars FROM documents")
oracle(
    "import_in_two_parts", "persons family_records raw_events places source_map media_records person_sources links",
    """SELECT name, batch, n FROM (
  SELECT 'persons' AS name, 0::BIGINT AS batch, count(*) AS n FROM persons UNION ALL SELECT 'families', 1, count(*) FROM family_records
  UNION ALL SELECT 'events', 0, count(*) FROM raw_events UNION ALL SELECT 'places', 0, count(*) FROM places
  UNION ALL SELECT 'sources', 0, count(DISTINCT source_xref) FROM source_map UNION ALL SELECT 'media', 0, count(*) FROM media_records
  UNION ALL SELECT 'person_sources', 0, count(*) FROM person_sources UNION ALL SELECT 'person_media', 0, count(DISTINCT (owner_xref, target)) FROM links JOIN media_records ON xref = target WHERE tag = 'OBJE'
  UNION ALL SELECT 'rejected', 1, count(*) FROM family_records
  UNION ALL SELECT 'conflicts', 2, count(*) FROM persons WHERE person_id % 10 = 0) WHERE n > 0""",
)
cte("nation_people", "persons", "SELECT c_nationkey AS n, person_id, 'I' || person_id AS key, birth_date FROM customer JOIN persons ON person_id = c_custkey + 1")
# Documents in their order: the second of two with one teller is refused, and then its family is free for the third.
cte("nation_tellers", "nation_people", "SELECT DISTINCT a.n FROM nation_people a JOIN nation_people b ON b.n = a.n - 1 WHERE a.n % 5 = 1")
cte(
    "nation_refused", "nation_tellers",
    """SELECT n, 'persons|T' || (n - 1) || '|repeated' AS detail FROM nation_tellers
UNION ALL SELECT DISTINCT a.n, 'families|G' || (a.n - 1) || '|repeated' FROM nation_people a JOIN nation_people b ON b.n = a.n - 1 WHERE a.n % 5 = 2 AND b.n NOT IN (SELECT n FROM nation_tellers)""",
)
cte("nation_kept", "nation_refused", "SELECT *, count(*) OVER (PARTITION BY n) AS size FROM nation_people WHERE n NOT IN (SELECT n FROM nation_refused)")
cte("nation_heads", "nation_kept", "SELECT n, min(person_id) AS own, (SELECT min(person_id) FROM nation_people) AS least FROM nation_kept GROUP BY n")
_NATION = "'nation-' || lpad(n::VARCHAR, 2, '0')"
oracle(
    "import_documents", "nation_heads",
    f"""SELECT 'person' AS kind, key, '' AS detail FROM nation_kept UNION ALL SELECT 'person', 'T' || n - (CASE WHEN n % 5 = 1 THEN 1 ELSE 0 END), '' FROM nation_heads
UNION ALL SELECT 'event', key, 'birth|' || birth_date FROM nation_kept WHERE birth_date IS NOT NULL
UNION ALL SELECT 'family', 'G' || n - (CASE WHEN n % 5 = 2 THEN 1 ELSE 0 END), '|' FROM nation_heads
UNION ALL SELECT 'family', 'F1N' || n, 'I' || own || '|' || CASE WHEN own = least THEN 'I' || least ELSE '' END FROM nation_heads
UNION ALL SELECT 'child', 'F1N' || n, 'I' || own || '|2' FROM nation_heads UNION ALL SELECT 'child', 'F1N' || n, 'I' || least || '|1' FROM nation_heads WHERE own = least
UNION ALL SELECT 'person_source', key, 'Register ' || n FROM nation_kept UNION ALL SELECT 'event_source', key, 'Register ' || n FROM nation_kept WHERE birth_date IS NOT NULL
UNION ALL SELECT 'person_media', key, n || '.jpg' FROM nation_kept WHERE person_id % 3 = 0 UNION ALL SELECT 'event_media', key, n || '.jpg' FROM nation_kept WHERE birth_date IS NOT NULL
UNION ALL SELECT 'conflict', {_NATION}, detail FROM nation_refused
UNION ALL SELECT 'document', {_NATION}, CASE WHEN n IN (SELECT n FROM nation_refused) THEN 'false|1' ELSE 'true|0' END FROM (SELECT DISTINCT n FROM nation_people)
UNION ALL SELECT 'audit', name, size || '|' || size || '|' || size FROM (
  SELECT 'persons' AS name, (SELECT count(*) FROM nation_kept) + (SELECT count(*) FROM nation_heads) AS size
  UNION ALL SELECT 'families', 2 * count(*) FROM nation_heads UNION ALL SELECT 'events', (SELECT count(birth_date) FROM nation_kept) + (SELECT 2 * count(*) FROM nation_heads)
  UNION ALL SELECT 'sources', count(*) FROM nation_heads UNION ALL SELECT 'media', count(*) FROM nation_heads)""",
)
oracle(
    "family_detail_of_stored", "nation_heads",
    """SELECT 'F1N' || n AS xref, 'I' || own AS father_xref, CASE WHEN own = least THEN 'I' || least END AS mother_xref, 'I' || own AS children,
  'marriage:1 JAN ' || 1810 + n || ':Vic|divorce:' || 1850 + n || ':' AS events FROM nation_heads
UNION ALL SELECT 'G' || n - (CASE WHEN n % 5 = 2 THEN 1 ELSE 0 END), NULL, NULL, '', '' FROM nation_heads""",
)
oracle(
    "dashboard_of_stored", "nation_heads",
    """SELECT (SELECT count(*) FROM nation_kept) + (SELECT count(*) FROM nation_heads) AS persons, (SELECT 2 * count(*) FROM nation_heads) AS families,
  (SELECT count(birth_date) FROM nation_kept) AS events, (SELECT count(*) FROM nation_heads) AS sources, true AS dated""",
)
oracle("gedcom_links", "links", "SELECT owner_xref, 'person' AS owner_kind, tag, target FROM links")
oracle("lookup_person", "persons", "SELECT * FROM persons WHERE xref = 'I42'")
oracle("lookup_place", "places", "SELECT * FROM places WHERE place_key = 'nation_7'")

# ----------------------------------------------------------- normalisation

oracle("date_normalize", "imported", "SELECT date_text, qualifier, year, month, day, iso, valid FROM imported")
oracle("date_parse", "analytic", "SELECT date_text, year, month, day, precision, modifier, iso, start_iso, end_iso FROM analytic")
oracle(
    "date_keys", "analytic",
    f"""SELECT date_text, year IS NOT NULL AS valid, start_sort, end_sort, modifier = 'exact' AND precision = 3 AS is_exact,
  modifier IN ('between', 'from') AND end_iso IS NOT NULL AS is_range,
  CASE WHEN year IS NOT NULL THEN coalesce(try_cast(iso AS DATE), try_cast({iso('year', 'month', 'day')} AS DATE))::VARCHAR END AS calendar_date FROM analytic""",
)
oracle(
    "date_from_iso", "events",
    """SELECT event_id, date_text AS original, date_iso AS iso, substr(date_iso, 1, 4)::INT AS year, substr(date_iso, 6, 2)::INT AS month, substr(date_iso, 9, 2)::INT AS day, 3 AS precision,
  replace(date_iso, '-', '')::BIGINT AS start_sort FROM events""",
)
oracle(
    "date_compare", "people",
    """SELECT person_id, sign(bs - ds)::INT AS "order", coalesce(biso, '') = coalesce(diso, '') AND byear = dyear AND bprec = dprec AND bmod = dmod AS same,
  bs <= ds AND de <= be AS contains, bs <= de AND ds <= be AS overlaps FROM people WHERE byear IS NOT NULL AND dyear IS NOT NULL""",
)
_PERIODS = "(SELECT bs AS s, be AS e, count(*) AS n FROM people WHERE byear IS NOT NULL GROUP BY 1, 2)"
oracle(
    "date_overlaps", "people",
    f"SELECT a.s AS start_sort, a.e AS end_sort, sum(b.n)::BIGINT AS matches FROM {_PERIODS} a JOIN {_PERIODS} b ON a.s <= b.e AND b.s <= a.e GROUP BY 1, 2",
)
oracle(
    "date_contains", "people",
    f"SELECT a.s AS start_sort, a.e AS end_sort, sum(b.n)::BIGINT AS matches FROM {_PERIODS} a JOIN {_PERIODS} b ON a.s <= b.s AND b.e <= a.e GROUP BY 1, 2",
)
_NAMED = f"""(SELECT owner_xref, seq, CASE WHEN trim(given) = '' THEN given ELSE {title('given')} END AS given_name,
  nullif(coalesce({title("regexp_replace(surname, '[’''·.-]', ' ', 'g')")}, ''), '') AS surname FROM name_variants)"""
oracle(
    "name_normalize", "name_variants",
    f"""SELECT *, {soundex('surname')} AS soundex, nullif(left({dashed('lower(strip_accents(search_name))')}, 120), '') AS slug,
  nullif(regexp_replace(lower(strip_accents(search_name)), '[^a-z]', '', 'g'), '') AS metaphone
FROM (SELECT *, concat_ws(' ', nullif(given_name, ''), surname) AS search_name FROM {_NAMED})""",
)
oracle("fold_documents", "", f"SELECT doc_id, md5({fold('text')}) AS folded_md5, length({fold('text')}) AS n_chars FROM documents")
oracle(
    "slugs", "persons",
    f"""SELECT person_id, {dashed("lower(strip_accents(concat_ws(' ', given_name, surname)))")} AS name_slug,
  {dashed(fold("coalesce(surname, '')"))} AS place_slug, nullif({dashed('lower(strip_accents(given_name))')}, '') AS entity_slug FROM persons""",
)
oracle("document_slugs", "", f"SELECT doc_id, nullif({dashed('lower(strip_accents(text))')}, '') AS slug FROM documents")
oracle(
    "person_name_columns", "persons",
    """SELECT person_id, concat_ws(' ', CASE WHEN sex = 'M' THEN 'Sr.' END, given_name, surname) AS full_name,
  coalesce(nullif(concat_ws(' ', given_name, surname), ''), xref) AS display_name,
  concat_ws(' ', upper(substr(given_name, 1, 1)) || '.', upper(substr(surname, 1, 1)) || '.') AS initials FROM persons""",
)
oracle(
    "soundex", "words",
    f"SELECT token, {soundex('token')} AS soundex, nullif(regexp_replace(lower(strip_accents(token)), '[^a-z]', '', 'g'), '') AS metaphone FROM (SELECT DISTINCT token FROM words)",
)
oracle("phonetic_key", "persons", f"SELECT person_id, {phonetic('coalesce(surname, given_name)')} AS phonetic_key FROM persons")
oracle(
    "place_keys", "raw_events",
    f"""SELECT place, {PLACE_KEY.format(x='place')} AS place_key, replace({fold('place')}, ' ', '-') AS canonical,
  list_aggregate(list_filter(string_split_regex({fold('place')}, '\\s+'), lambda w: w <> '' AND w NOT IN {STOP}), 'string_agg', '|') AS tokens
FROM (SELECT DISTINCT place FROM raw_events)""",
)
oracle("name_keys", "persons", "SELECT person_id, coalesce(lower(trim(surname)), '') AS surname_key, coalesce(lower(trim(given_name)), '') AS given_key FROM persons")
oracle(
    "presentation_labels", "people scores",
    """SELECT p.person_id, coalesce(birth_year::VARCHAR, '?') || ' – ' || coalesce(death_year::VARCHAR, '?') AS life_span,
  CASE sex WHEN 'M' THEN 'Home' WHEN 'F' THEN 'Dona' ELSE 'Desconegut' END AS sex_label,
  CASE WHEN score >= 0.8e0 THEN 'Excel·lent' WHEN score >= 0.6e0 THEN 'Bona' WHEN score >= 0.4e0 THEN 'Regular' ELSE 'Baixa' END AS quality_label,
  floor(score * 100e0 + 0.5e0)::BIGINT || '%' AS percent FROM people p JOIN scores s USING (person_id)""",
)
oracle(
    "event_labels", "raw_events",
    """SELECT CASE event_type WHEN 'birth' THEN 'Naixement' WHEN 'death' THEN 'Defunció' WHEN 'marriage' THEN 'Matrimoni' WHEN 'residence' THEN 'Residència' ELSE 'Baptisme' END AS label,
  count(*) AS n FROM raw_events GROUP BY 1""",
)

# -------------------------------------------------------------- resolution

_CAPITAL = lambda c: f"upper(substr({c}, 1, 1)) || lower(substr({c}, 2))"
oracle(
    "person_rows", "persons",
    f"""SELECT *, nullif(full_name, '') AS search_name, nullif({dashed('lower(strip_accents(full_name))')}, '') AS slug, {soundex('surname')} AS soundex,
  nullif(regexp_replace(lower(strip_accents(full_name)), '[^a-z]', '', 'g'), '') AS metaphone FROM (
  SELECT *, concat_ws(' ', nullif(given_name, ''), surname) AS full_name FROM (
    SELECT xref, CASE WHEN given_name IS NOT NULL THEN {_CAPITAL('given_name')} WHEN surname IS NOT NULL THEN '' END AS given_name, {_CAPITAL('surname')} AS surname, sex, NULL::VARCHAR AS notes FROM persons))""".replace(
        "SELECT *, nullif(full_name", "SELECT xref, given_name, surname, sex, notes, nullif(full_name", 1
    ),
)
oracle(
    "place_dimension", "places",
    "SELECT p.place_key, p.name, n.n_nationkey::BIGINT AS existing_id FROM places p LEFT JOIN nation n ON n.n_name = p.name",
)
oracle("source_dedup", "source_map", "SELECT xref, title, source_xref, author FROM source_map")
oracle("media_rows", "media_records", "SELECT xref, coalesce(file, '') AS file_path, title AS caption FROM media_records")
oracle("family_parents", "families", "SELECT family_id, xref, father_id, mother_id FROM families")
oracle("parent_child_rows", "parent_children", "SELECT * FROM parent_children")
oracle("event_rows", "events", "SELECT event_id, person_id, event_type, date_text, date_iso, date_year, place_key, place FROM events")
oracle("person_source_links", "person_sources", "SELECT person_id, source_xref FROM person_sources")
oracle(
    "person_media_links", "links persons media_records",
    "SELECT DISTINCT p.person_id, m.xref AS media_xref FROM links l JOIN persons p ON p.xref = l.owner_xref JOIN media_records m ON m.xref = l.target WHERE l.tag = 'OBJE'",
)
oracle(
    "surrogate_keys", "media_records",
    """SELECT media_id, xref, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM (
  SELECT row_number() OVER (ORDER BY xref) AS media_id, xref, md5('media' || chr(0) || xref) AS h FROM media_records)""",
)
oracle(
    "import_summary", "persons families source_records media_records places raw_events parent_children",
    """SELECT 'persons' AS metric, count(*) AS value FROM persons UNION ALL SELECT 'families', count(*) FROM families UNION ALL SELECT 'sources', count(*) FROM source_records
UNION ALL SELECT 'media', count(*) FROM media_records UNION ALL SELECT 'places', count(*) FROM places UNION ALL SELECT 'events', count(*) FROM raw_events
UNION ALL SELECT 'children', count(*) FROM parent_children""",
)
_APPENDED = """(SELECT seq, title, CASE WHEN title IN (SELECT 'Register ' || n_nationkey FROM nation WHERE n_regionkey < 2) THEN 'stored'
  WHEN seq > min(seq) OVER (PARTITION BY title) THEN 'repeated' END AS reason FROM source_records)"""
oracle("incremental_append", "source_records", f"SELECT title, seq FROM {_APPENDED} WHERE reason IS NULL")
oracle("append_conflicts", "source_records", f"SELECT title, seq, reason FROM {_APPENDED} WHERE reason IS NOT NULL")
oracle("merge_conflicts", "merges", "SELECT primary_id, secondary_id, conflict FROM merges")
oracle(
    "apply_merges", "merges persons",
    "SELECT person_id, xref FROM persons WHERE person_id NOT IN (SELECT secondary_id FROM merges WHERE conflict IS NULL)",
)

# -------------------------------------------------------------- enrichment

oracle("derived_life_dates", "people", "SELECT person_id, birth_date, death_date FROM people")
oracle("families_as_child", "parent_children", "SELECT child_id AS person_id, family_id FROM parent_children")
oracle("families_as_spouse", "spouse_edges", "SELECT person_id, family_id FROM spouse_edges")
oracle("children_of_parents", "parent_edges", "SELECT person_id, child_id FROM parent_edges")
oracle("children_of_families", "parent_children", "SELECT family_id, child_id, min(sibling_order) AS sibling_order FROM parent_children GROUP BY 1, 2")
oracle("person_events_with_places", "events", "SELECT event_id, person_id, event_type, place FROM events")
oracle("referenced_places", "places", "SELECT place_key, name FROM places")
oracle("life_events", "life", "SELECT * FROM life")
oracle("events_by_person", "events", "SELECT person_id, string_agg(event_id || ':' || event_type, '|' ORDER BY event_id) AS events FROM events GROUP BY 1")

# --------------------------------------------------------------- integrity

ISSUES = {
    "duplicate_xref": ("record_xrefs", "SELECT 'error' AS level, 'duplicate_xref' AS code, xref, 'xref ''' || xref || ''' repetit al document' AS message FROM (SELECT *, row_number() OVER (PARTITION BY xref ORDER BY seq) AS rn FROM record_xrefs) WHERE rn > 1"),
    "missing_family_member": ("family_records persons", "SELECT 'error' AS level, 'missing_family_member' AS code, xref, 'La familia ''' || xref || ''' apunta a la persona inexistent ''' || target || ''' com a ' || role AS message FROM (SELECT xref, 'HUSB' AS role, husband_xref AS target FROM family_records UNION ALL SELECT xref, 'WIFE', wife_xref FROM family_records) WHERE target NOT IN (SELECT xref FROM persons)"),
    "missing_child": ("family_child_records persons", "SELECT 'error' AS level, 'missing_child' AS code, family_xref AS xref, 'El fill ''' || child_xref || ''' de ''' || family_xref || ''' no està definit' AS message FROM family_child_records WHERE child_xref NOT IN (SELECT xref FROM persons)"),
    "missing_family": ("links family_records", "SELECT 'error' AS level, 'missing_family' AS code, owner_xref AS xref, 'La persona ''' || owner_xref || ''' referencia la família inexistent ''' || target || '''' AS message FROM links WHERE tag IN ('FAMC', 'FAMS') AND target NOT IN (SELECT xref FROM family_records)"),
    "missing_source": ("links source_records", "SELECT 'warning' AS level, 'missing_source' AS code, owner_xref AS xref, 'La font ''' || target || ''' no està definida' AS message FROM links WHERE tag = 'SOUR' AND target NOT IN (SELECT xref FROM source_records)"),
    "missing_media": ("links media_records", "SELECT 'warning' AS level, 'missing_media' AS code, owner_xref AS xref, 'L''OBJE ''' || target || ''' no està definit' AS message FROM links WHERE tag = 'OBJE' AND target NOT IN (SELECT xref FROM media_records)"),
    "missing_note": ("links", "SELECT 'warning' AS level, 'missing_note' AS code, owner_xref AS xref, 'La nota ''' || target || ''' no està definida' AS message FROM links WHERE tag = 'NOTE' AND target NOT IN (SELECT 'N' || doc_id FROM documents)"),
    "bad_date": ("persons raw_events imported", "SELECT 'warning' AS level, 'bad_date' AS code, owner_xref AS xref, 'Data no reconeguda: ''' || date_text || '''' AS message FROM (SELECT 'I' || person_id AS owner_xref, date_text FROM raw_events UNION ALL SELECT xref, birth_date FROM persons) JOIN imported USING (date_text) WHERE NOT valid"),
    "no_name": ("persons name_variants", "SELECT 'warning' AS level, 'no_name' AS code, xref, 'Persona sense nom' AS message FROM persons WHERE xref NOT IN (SELECT owner_xref FROM name_variants WHERE given <> '' OR surname <> '')"),
}
for _code, (_needs, _body) in ISSUES.items():
    oracle(f"issues_{_code}", _needs, _body)
_ALL = {**ISSUES, "bad_date": ("raw_events imported", "SELECT 'warning' AS level, 'bad_date' AS code, 'I' || person_id AS xref, date_text AS message FROM raw_events JOIN imported USING (date_text) WHERE NOT valid")}
oracle(
    "issues_all", " ".join(n for n, _ in _ALL.values()),
    "SELECT level, code, count(*) AS n, count(DISTINCT xref) AS ids FROM (" + " UNION ALL ".join(b for _, b in _ALL.values()) + ") GROUP BY 1, 2",
)

# -------------------------------------------------------------- statistics

_UNRESOLVED = "SELECT count(*) FROM links WHERE tag IN ('SOUR', 'OBJE', 'NOTE') AND target NOT IN (SELECT xref FROM source_records UNION ALL SELECT xref FROM media_records UNION ALL SELECT 'N' || doc_id FROM documents)"
_KEYED = f"SELECT DISTINCT {PLACE_KEY.format(x='place')} AS k FROM import_events"
oracle(
    "import_statistics", "persons family_records import_events imported name_variants links source_records media_records",
    f"""SELECT 'persons' AS metric, '' AS key, count(*) AS value FROM persons UNION ALL SELECT 'families', '', count(*) FROM family_records
UNION ALL SELECT 'sources', '', count(*) FROM source_records UNION ALL SELECT 'media', '', count(*) FROM media_records
UNION ALL SELECT 'notes', '', count(*) FROM documents UNION ALL SELECT 'events', '', count(*) FROM import_events
UNION ALL SELECT 'events_by_type', event_type, count(*) FROM import_events GROUP BY event_type
UNION ALL SELECT 'sex_by', coalesce(sex, 'U'), count(*) FROM persons GROUP BY 2
UNION ALL SELECT 'surname_frequency', surname, count(*) FROM name_variants WHERE surname <> '' GROUP BY surname
UNION ALL SELECT 'persons_without_name', '', count(*) FROM persons WHERE xref NOT IN (SELECT owner_xref FROM name_variants WHERE given <> '' OR surname <> '')
UNION ALL SELECT 'places', '', count(k) FROM ({_KEYED})
UNION ALL SELECT 'persons_with_birth', '', count(*) FROM import_events WHERE event_type = 'birth'
UNION ALL SELECT 'persons_with_death', '', count(*) FROM import_events WHERE event_type = 'death'
UNION ALL SELECT 'birth_year_min', '', min(year) FROM import_events JOIN imported USING (date_text) WHERE event_type = 'birth'
UNION ALL SELECT 'birth_year_max', '', max(year) FROM import_events JOIN imported USING (date_text) WHERE event_type = 'birth'
UNION ALL SELECT 'unresolved_refs', '', ({_UNRESOLVED})""",
)
oracle("unresolved_references", "links source_records media_records", f"SELECT ({_UNRESOLVED}) AS unresolved_refs")
oracle("name_variant_surnames", "name_variants", "SELECT surname, count(*) AS n FROM name_variants WHERE surname <> '' GROUP BY 1")
oracle("import_events_by_type", "import_events", "SELECT event_type, count(*) AS n FROM import_events GROUP BY 1")
oracle("distinct_places", "import_events", f"SELECT count(k) AS places FROM ({_KEYED})")
oracle("import_birth_years", "import_events imported", "SELECT min(year) AS min_year, max(year) AS max_year FROM import_events JOIN imported USING (date_text) WHERE event_type = 'birth'")
oracle(
    "life_event_counts", "import_events",
    "SELECT count(*) FILTER (WHERE event_type = 'birth') AS persons_with_birth, count(*) FILTER (WHERE event_type = 'death') AS persons_with_death FROM import_events",
)
_DISTINCT_SOURCES = "(SELECT count(DISTINCT title) FROM source_map)"
oracle(
    "row_counts", "source_map media_records persons families raw_events places",
    f"""SELECT 'Source' AS entity, {_DISTINCT_SOURCES} AS n UNION ALL SELECT 'Media', count(*) FROM media_records UNION ALL SELECT 'Person', count(*) FROM persons
UNION ALL SELECT 'Family', count(*) FROM families UNION ALL SELECT 'Event', count(*) FROM raw_events UNION ALL SELECT 'Place', count(*) FROM places""",
)
oracle(
    "totals", "source_map media_records persons families raw_events",
    f"""SELECT (SELECT count(*) FROM persons) AS persons, (SELECT count(*) FROM families) AS families, (SELECT count(*) FROM raw_events) AS events,
  {_DISTINCT_SOURCES} AS sources, (SELECT count(*) FROM media_records) AS media""",
)
oracle("sex_distribution", "persons", "SELECT coalesce(sex, 'U') AS sex, count(*) AS n FROM persons GROUP BY 1")
_SEXES = "count(*) FILTER (WHERE sex = 'M') AS males, count(*) FILTER (WHERE sex = 'F') AS females"
oracle("males_females", "persons", f"SELECT {_SEXES} FROM persons")
oracle("surname_frequency", "persons", "SELECT surname, count(*) AS n FROM persons WHERE surname IS NOT NULL GROUP BY 1")
oracle(
    "incomplete_persons", "persons",
    """SELECT count(*) FILTER (WHERE given_name IS NULL AND surname IS NULL) AS persons_without_name,
  count(*) FILTER (WHERE given_name IS NULL AND surname IS NULL AND birth_date IS NULL AND death_date IS NULL) AS persons_without_data FROM persons""",
)


def _ages(source: str) -> str:
    return f"SELECT {halfeven('mean', 1)} AS average_age, max_age FROM (SELECT sum(dyear - byear)::DOUBLE / count(*) AS mean, max(dyear - byear) AS max_age FROM {source} WHERE dyear >= byear)"


oracle("age_at_death", "people", _ages("people"))
oracle("births_by_year", "people", "SELECT byear AS year, count(*) AS n FROM people WHERE byear IS NOT NULL GROUP BY 1")
oracle("deaths_by_year", "people", "SELECT dyear AS year, count(*) AS n FROM people WHERE dyear IS NOT NULL GROUP BY 1")
oracle("events_by_type", "raw_events", "SELECT event_type, count(*) AS n FROM raw_events GROUP BY 1")
oracle(
    "birth_year_range", "people events",
    "SELECT min(y) AS min_year, max(y) AS max_year FROM (SELECT byear AS y FROM people UNION ALL SELECT date_year FROM events WHERE event_type = 'birth')",
)
oracle("top_places", "events", "SELECT place AS name, count(*) AS n FROM events WHERE place <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
oracle("top_surnames", "persons", "SELECT surname, count(*) AS n FROM persons WHERE surname IS NOT NULL GROUP BY 1 ORDER BY n DESC, surname LIMIT 15")
oracle("largest_branches", "parent_children", "SELECT family_id, count(DISTINCT child_id) AS children FROM parent_children GROUP BY 1 ORDER BY children DESC, family_id LIMIT 5")
_FIRST = "(SELECT * FROM people ORDER BY person_id LIMIT 700)"
oracle("first_persons_statistics", "people", f"SELECT * FROM (SELECT count(*) AS persons, {_SEXES} FROM {_FIRST}), ({_ages(_FIRST)})")
_AVERAGE = f"(SELECT {halfeven('mean', 2)} FROM (SELECT sum(round(score * 100)::BIGINT)::DOUBLE / (count(*) * 100) AS mean FROM scores))"
oracle(
    "dashboard", "people families raw_events places scores candidates tasks source_map media_records",
    f"""SELECT (SELECT count(*) FROM people) AS persons, (SELECT count(*) FROM families) AS families, (SELECT count(*) FROM raw_events) AS events,
  (SELECT count(*) FROM places) AS places, (SELECT count(*) FROM people WHERE sex = 'M') AS males, (SELECT count(*) FROM people WHERE sex = 'F') AS females,
  (SELECT average_age FROM ({_ages('people')})) AS average_age, {_AVERAGE} AS average_quality, (SELECT count(*) FROM candidates) AS duplicates,
  (SELECT count(*) FROM tasks) AS pending_tasks, {_DISTINCT_SOURCES} AS sources, (SELECT count(*) FROM media_records) AS media""",
)

# ----------------------------------------------------------------- quality

oracle("quality_score", "scores", "SELECT * FROM scores")
oracle("quality_partial_names_added", "people", _quality(""))
oracle("quality_by_citations", "people person_sources", _quality("-", "person_id IN (SELECT person_id FROM person_sources)"))
_F = "SELECT person_id, '{n}' AS name, {c}::DOUBLE AS contribution, {w}::DOUBLE AS weight, {r} AS reason, '{d}' AS direction FROM people WHERE {t}"
_FULL = "given_name IS NOT NULL AND surname IS NOT NULL"
_FACTORS = [
    ("name", "0.25", "0.25", "'nom complet present'", "add", _FULL),
    ("name", "CASE WHEN given_name IS NOT NULL THEN 0.15 WHEN surname IS NOT NULL THEN 0.1 ELSE 0 END", "0.25", "'nom incomplet'", "subtract", f"NOT ({_FULL})"),
    ("sex", "0.05", "0.05", "'sexe registrat'", "add", "sex IS NOT NULL"),
    ("parents", "0.15", "0.15", "'pares identificats'", "add", "has_parents"),
    ("children", "0.15", "0.15", "'fills identificats'", "add", "has_children"),
    ("sources", "0.15", "0.15", "'fonts citades'", "add", "event_count > 0"),
    ("events", "0.1", "0.1", "event_count || ' esdeveniments'", "add", "event_count > 0"),
    ("places", "0.05", "0.05", "'1 llocs'", "add", "birth_date IS NOT NULL"),
    ("birth", "0.1", "0.1", "'naixement datat'", "add", "birth_date IS NOT NULL"),
    ("birth", "0", "0.1", "'sense naixement datat'", "add", "birth_date IS NULL"),
    ("death", "0.05", "0.05", "'defunció datada'", "add", "death_date IS NOT NULL"),
    ("death", "0", "0.05", "'sense defunció datada'", "add", "death_date IS NULL"),
    ("chronology", "0.2", "0.2", "'defunció abans de naixement'", "subtract", "dyear < byear"),
]
_FACTOR_SQL = [_F.format(n=n, c=c, w=w, r=r, d=d, t=t) for n, c, w, r, d, t in _FACTORS]
oracle("quality_factors", "people", " UNION ALL ".join(_FACTOR_SQL))
oracle("quality_factor_chronology", "people", _FACTOR_SQL[-1])
oracle(
    "quality_missing", "people",
    """SELECT person_id, concat_ws('|', CASE WHEN given_name IS NULL THEN 'given_name' END, CASE WHEN surname IS NULL THEN 'surname' END, CASE WHEN sex IS NULL THEN 'sex' END,
  CASE WHEN NOT has_parents THEN 'parents' END, CASE WHEN NOT has_children THEN 'children' END, CASE WHEN event_count = 0 THEN 'sources' END,
  CASE WHEN event_count = 0 THEN 'events' END, CASE WHEN birth_date IS NULL THEN 'places' END) AS missing,
  CASE WHEN dyear < byear THEN 'mort (' || dyear || ') abans de naixement (' || byear || ')' ELSE '' END AS issues FROM people""",
)
oracle(
    "quality_summary", "scores",
    f"SELECT {_AVERAGE} AS average_score, person_id AS best_person_id, xref AS best_xref, score AS best_score FROM scores ORDER BY score DESC, person_id LIMIT 1",
)
_CLASS = "CASE WHEN score >= 0.8e0 THEN 'excellent' WHEN score >= 0.6e0 THEN 'good' WHEN score >= 0.4e0 THEN 'regular' ELSE 'low' END"
oracle(
    "quality_distribution", "scores",
    f"SELECT c.class, count(s.class) AS n FROM (SELECT unnest(['excellent', 'good', 'regular', 'low']) AS class) c LEFT JOIN (SELECT {_CLASS} AS class FROM scores) s USING (class) GROUP BY 1",
)

# ---------------------------------------------------------------- findings

for _name, _body in FINDINGS.items():
    _needs = {"finding_duplicates": "candidates", "finding_places": "places"}.get(_name, "people")
    _columns = "category, severity, message, ref" if _name in ("finding_duplicates", "finding_places", "finding_given_names") else "*"
    oracle(_name, _needs, f"SELECT {_columns} FROM ({_body})")
oracle("findings_by_category", "findings", "SELECT category, severity, count(*) AS n FROM findings GROUP BY 1, 2")
_SEVERITIES = "count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos"
oracle("findings_by_severity", "findings", f"SELECT {_SEVERITIES} FROM findings")
oracle("finding_errors", "findings", "SELECT category, message, ref FROM findings WHERE severity = 'error'")
oracle(
    "finding_facets", "findings candidates",
    """SELECT 'errors' AS tab, count(*) AS n FROM findings WHERE severity = 'error' UNION ALL SELECT 'warnings', count(*) FROM findings WHERE severity = 'warning'
UNION ALL SELECT 'infos', count(*) FROM findings WHERE severity = 'info' UNION ALL SELECT 'incomplete', count(*) FROM findings WHERE category = 'completeness' AND severity <> 'error'
UNION ALL SELECT 'places', count(*) FROM findings WHERE category = 'place' AND severity <> 'error' UNION ALL SELECT 'duplicates', count(*) FROM candidates""",
)

# -------------------------------------------------------------- duplicates

_PAIR = "a_id, b_id, score, confidence, rules_used, reasons"
_PAIR_NEEDS = "compared shared child_counts"
oracle("duplicate_candidates", "candidates", f"SELECT {_PAIR} FROM candidates")
oracle("duplicate_rows", "candidates", "SELECT a_id, a_xref, a_name, b_id, b_xref, b_name, score FROM candidates")
oracle(
    "duplicate_rules_used", "candidates",
    "SELECT rule, count(*) AS pairs, max(score) AS best FROM (SELECT unnest(string_split(rules_used, '|')) AS rule, score FROM candidates) GROUP BY 1",
)
oracle("duplicate_top", "candidates", "SELECT a_id, b_id, score FROM candidates ORDER BY score DESC, a_id, b_id LIMIT 100")
oracle("duplicate_candidates_strict", _PAIR_NEEDS, f"SELECT {_PAIR} FROM ({_candidates(0.65, {'name': 0.4, 'birth': 0.15})})")
oracle("duplicate_candidates_with_place", _PAIR_NEEDS, f"SELECT {_PAIR} FROM ({_candidates(place=True)})")
oracle("duplicate_candidates_custom_rule", _PAIR_NEEDS, f"SELECT {_PAIR} FROM ({_candidates(custom='sex')})")
oracle("duplicates_of_person", "candidates", "SELECT a_id, b_id, score FROM candidates WHERE a_id = 10 OR b_id = 10")


def _group_key(surname: bool = True, year: bool = False) -> str:
    key_parts = [f"CASE WHEN given_name IS NOT NULL THEN nullif({fold('concat_ws(chr(32), given_name, surname)')}, '') END"]
    if surname:
        key_parts.append(f"nullif({fold('surname')}, '')")
    if year:
        key_parts.append(r"nullif(regexp_extract(birth_date, '\b(1[5-9]\d{2}|2\d{3})\b', 1), '')")
    return "concat_ws('*', " + ", ".join(key_parts) + ")"


def _group_rows(**options: bool) -> str:
    return f"SELECT key, count(*) AS size, 'nom similar (' || key || ')' AS reason FROM (SELECT {_group_key(**options)} AS key FROM persons) WHERE key <> '' GROUP BY key HAVING count(*) > 1"


def _members(source: str, **options: bool) -> str:
    return f"SELECT key, person_id FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM (SELECT person_id, {_group_key(**options)} AS key FROM {source})) WHERE key <> '' AND n > 1"


oracle("duplicate_groups", "persons", _group_rows())
oracle("duplicate_groups_with_year", "persons", _group_rows(year=True))
oracle("duplicate_groups_any_surname", "persons", _group_rows(surname=False))
oracle("duplicate_group_members", "persons", _members("persons", year=True))
_WHOLE = lambda t: fold(f"concat_ws(chr(32), {t}.given_name, {t}.surname)")
oracle(
    "quick_decisions", "persons",
    f"""SELECT a_id, b_id, same_g AND same_s AS likely, CASE WHEN same_g AND same_s THEN 'nom i cognom idèntics' WHEN NOT same_g AND same_s THEN 'cognom idèntic però sense nom' ELSE 'no coincideix' END AS message
FROM (SELECT a.person_id AS a_id, b.person_id AS b_id, a.given_name IS NOT NULL AND {_WHOLE('a')} = {_WHOLE('b')} AS same_g,
  coalesce({fold('a.surname')} = {fold('b.surname')}, false) AS same_s FROM persons a JOIN persons b ON b.person_id = a.person_id + 1)""",
)
oracle("merge_candidates", "persons", _members("(SELECT * FROM persons WHERE given_name ILIKE '%ol%' OR surname ILIKE '%ol%')"))

# ---------------------------------------------------------------- variants

oracle(
    "place_variants", "raw_events",
    f"SELECT v[1] AS canonical, list_aggregate(v, 'string_agg', '|') AS variants, 'totes normalitzen a ''' || key || '''' AS reason FROM {_groups('place', 'raw_events')}",
)
oracle(
    "place_variant_rows", "raw_events",
    f"SELECT key, unnest(v) AS raw, v[1] AS canonical, len(v)::BIGINT AS n_variants FROM {_groups('place', 'raw_events')}",
)
oracle(
    "name_variants", "persons",
    f"SELECT v[1] AS original, key AS normalized, list_aggregate(v[2:], 'string_agg', '|') AS alternatives, 'variants normalitzades a ''' || key || '''' AS reason FROM {_groups('surname', 'persons')}",
)
oracle("variant_join", "raw_events", f"SELECT n_name, place FROM nation JOIN (SELECT DISTINCT place FROM raw_events) ON {fold('n_name')} = {fold('place')}")
oracle(
    "known_variants", "persons",
    """SELECT person_id, CASE WHEN person_id % 2 = 0 THEN given_name ELSE ['Jose', 'JOSEP', 'maría', 'Joan', 'Pablo', 'Pere', 'Anna'][k] END AS name,
  CASE WHEN person_id % 2 = 0 THEN '' ELSE ['josep|josé', 'jose|josé', 'maría', 'juan', 'pau', 'pedre|pedro', ''][k] END AS known_variants
FROM (SELECT *, (length(coalesce(given_name, '')) + person_id) % 7 + 1 AS k FROM persons)""",
)
_SETS = "place_sets a JOIN place_sets b ON a.place < b.place AND len(a.t) > 0 AND len(b.t) > 0"
_JACCARD = f"(SELECT a, b, {halfeven('raw', 2)} AS similarity FROM (SELECT a.place AS a, b.place AS b, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS raw FROM {_SETS}))"
oracle("place_similarity", "place_sets", f"SELECT * FROM {_JACCARD} WHERE similarity >= 0.6e0")
oracle(
    "place_containment", "place_sets",
    "SELECT a.place AS \"outer\", b.place AS \"inner\" FROM place_sets a JOIN place_sets b ON a.place <> b.place AND len(b.t) > 0 AND list_has_all(a.t, b.t)",
)
oracle(
    "place_matches", "place_sets",
    f"SELECT a, b FROM {_JACCARD} WHERE similarity >= 0.8e0 UNION SELECT a.place, b.place FROM place_sets a JOIN place_sets b ON a.place < b.place AND replace({fold('a.place')}, ' ', '-') = replace({fold('b.place')}, ' ', '-')",
)


def _similar_names(source: str, least: str) -> str:
    keyed = f"(SELECT t AS f, {phonetic('t')} AS k FROM (SELECT DISTINCT {source}) WHERE t <> '')"
    # DuckDB counts edited bytes; the one folded letter of two bytes is mapped to one.
    raw = "greatest(1e0 - levenshtein(replace(a.f, 'ß', '~'), replace(b.f, 'ß', '~'))::DOUBLE / greatest(length(a.f), length(b.f)), CASE WHEN a.k = b.k THEN 0.55e0 ELSE 0e0 END)"
    return f"SELECT * FROM (SELECT a, b, {halfeven('raw', 2)} AS similarity FROM (SELECT a.f AS a, b.f AS b, {raw} AS raw FROM {keyed} a JOIN {keyed} b ON a.f < b.f)) WHERE similarity >= {least}"


oracle("name_similarity", "persons", _similar_names(f"{fold('concat_ws(chr(32), given_name, surname)')} AS t FROM persons", "0.6e0"))
oracle(
    "word_similarity", "",
    _similar_names(f"unnest(string_split_regex({fold('text')}, '[^\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark", "0.8e0"),
)

# ------------------------------------------------------ search and details

oracle(
    "person_search", "persons",
    "SELECT person_id, given_name, surname FROM persons WHERE (given_name ILIKE '%ge%' OR surname ILIKE '%ge%') AND sex = 'F' ORDER BY surname NULLS FIRST, given_name NULLS FIRST, person_id LIMIT 50 OFFSET 10",
)
_SUMMARY = "person_id, xref, given_name, surname, sex, display_name, birth_date, death_date, birth_year, death_year, birth_place, death_place"
_ORDER = "coalesce(surname, ''), coalesce(given_name, ''), person_id"
oracle(
    "person_search_catalog", "people scores events",
    f"""SELECT {_SUMMARY}, quality FROM people JOIN (SELECT person_id, score AS quality FROM scores) USING (person_id)
WHERE contains(lower(coalesce(given_name, '') || ' ' || coalesce(surname, '')), 'o') AND sex = 'M'
  AND person_id IN (SELECT person_id FROM events WHERE contains(lower(place), 'nation_1')) ORDER BY {_ORDER} LIMIT 100 OFFSET 5""",
)
oracle(
    "person_search_birth_year", "people scores",
    f"SELECT person_id, display_name, birth_year, score AS quality FROM people JOIN (SELECT person_id, score FROM scores) USING (person_id) WHERE contains(lower(surname), 't') AND birth_year = 1997 ORDER BY {_ORDER} LIMIT 100",
)
oracle("person_summaries", "people", f"SELECT {_SUMMARY} FROM people")
oracle(
    "person_parents", "parent_children families people",
    """SELECT c.child_id AS person_id, c.family_id, f.role, f.pid AS parent_person_id, p.display_name AS parent_display_name, p.birth_year AS parent_birth_year
FROM parent_children c JOIN (SELECT family_id, 'father' AS role, father_id AS pid FROM families UNION ALL SELECT family_id, 'mother', mother_id FROM families) f USING (family_id)
JOIN people p ON p.person_id = f.pid""",
)
oracle(
    "person_spouses", "spouse_edges families people events",
    """SELECT s.person_id, s.family_id, s.other AS spouse_person_id, p.display_name AS spouse_display_name, w.date_text AS marriage_date, w.place AS marriage_place
FROM (SELECT e.person_id, e.family_id, CASE WHEN f.father_id = e.person_id THEN f.mother_id ELSE f.father_id END AS other FROM spouse_edges e JOIN families f USING (family_id)) s
LEFT JOIN people p ON p.person_id = s.other
LEFT JOIN (SELECT (person_id - 1) // 3 + 1 AS family_id, arg_min(date_text, event_id) AS date_text, arg_min(place, event_id) AS place FROM events WHERE event_type = 'marriage' GROUP BY 1) w ON w.family_id = s.family_id""",
)
oracle(
    "person_children", "parent_edges people",
    "SELECT e.person_id, e.child_id AS child_person_id, p.display_name AS child_display_name, p.birth_year AS child_birth_year FROM parent_edges e JOIN people p ON p.person_id = e.child_id",
)
oracle("timeline", "events", "SELECT person_id, event_id, event_type, date_iso, date_year, place FROM events")
oracle(
    "person_sources", "person_sources source_map",
    "SELECT person_id, source_xref, m.title, m.author FROM person_sources JOIN (SELECT * FROM source_map WHERE xref = source_xref) m USING (source_xref)",
)
_EVERYONE = "(SELECT person_id FROM people)"
_AT = "row_number() OVER (PARTITION BY {0} ORDER BY {1})::INT - 1 AS at"
oracle(
    "person_detail_content", "people families parent_children spouse_edges parent_edges events person_sources source_map",
    f"""SELECT c.child_id AS person_id, 'parents' AS part, {_AT.format('c.child_id', 'c.family_id, f.role')},
  concat_ws('|', c.family_id, f.role, f.pid, coalesce(p.display_name, '')) AS entry
FROM (SELECT DISTINCT child_id, family_id FROM parent_children) c
JOIN (SELECT family_id, 'father' AS role, father_id AS pid FROM families UNION ALL SELECT family_id, 'mother', mother_id FROM families) f ON f.family_id = c.family_id
JOIN people p ON p.person_id = f.pid WHERE c.child_id IN {_EVERYONE}
UNION ALL SELECT s.person_id, 'spouses', {_AT.format('s.person_id', 's.family_id')}, concat_ws('|', s.family_id, coalesce(s.other::VARCHAR, ''), s.name)
FROM (SELECT e.person_id, e.family_id, o.other, coalesce(p.display_name, '') AS name
  FROM spouse_edges e JOIN (SELECT family_id, father_id AS own, mother_id AS other FROM families UNION ALL SELECT family_id, mother_id, father_id FROM families) o
    ON o.family_id = e.family_id AND o.own = e.person_id
  LEFT JOIN people p ON p.person_id = o.other WHERE e.person_id IN {_EVERYONE}) s
UNION ALL SELECT e.person_id, 'children', {_AT.format('e.person_id', 'coalesce(p.birth_year, 2147483647), p.display_name, e.child_id')},
  concat_ws('|', e.child_id, coalesce(p.display_name, ''), coalesce(p.birth_year::VARCHAR, ''))
FROM parent_edges e JOIN people p ON p.person_id = e.child_id WHERE e.person_id IN {_EVERYONE}
UNION ALL SELECT person_id, 'timeline', {_AT.format('person_id', 'coalesce(date_year, 2147483647), event_id')},
  concat_ws('|', event_id, event_type, coalesce(date_text, ''), coalesce(place_key, ''), coalesce(place, '')) FROM events WHERE person_id IN {_EVERYONE}
UNION ALL SELECT s.person_id, 'sources', {_AT.format('s.person_id', 'm.title')}, concat_ws('|', m.title, coalesce(m.author, ''))
FROM person_sources s JOIN (SELECT * FROM source_map WHERE xref = source_xref) m ON m.xref = s.source_xref WHERE s.person_id IN {_EVERYONE}""",
)
oracle(
    "person_detail", "people parent_children families spouse_edges parent_edges events candidates tasks person_sources source_map scores",
    """SELECT p.person_id, p.display_name,
  (SELECT count(*) FROM parent_children c JOIN (SELECT family_id, father_id AS pid FROM families UNION ALL SELECT family_id, mother_id FROM families) f USING (family_id) WHERE c.child_id = p.person_id AND f.pid IS NOT NULL) AS parents,
  (SELECT count(*) FROM spouse_edges s WHERE s.person_id = p.person_id) AS spouses,
  (SELECT count(*) FROM parent_edges s WHERE s.person_id = p.person_id) AS children,
  (SELECT count(*) FROM events s WHERE s.person_id = p.person_id) AS events,
  (SELECT count(*) FROM candidates s WHERE s.a_id = p.person_id) + (SELECT count(*) FROM candidates s WHERE s.b_id = p.person_id) AS duplicates,
  (SELECT count(*) FROM tasks s WHERE s.person_id = p.person_id) AS tasks,
  (SELECT count(*) FROM person_sources s WHERE s.person_id = p.person_id) AS sources,
  q.score AS quality,
  (SELECT arg_min(event_id, date_year::BIGINT * 100000000 + event_id) FROM events s WHERE s.person_id = p.person_id) AS first_event,
  coalesce((SELECT string_agg(m.title, '|' ORDER BY m.title) FROM person_sources s JOIN source_map m ON m.xref = s.source_xref WHERE s.person_id = p.person_id), NULL) AS titles
FROM people p JOIN scores q USING (person_id)""",
)
oracle(
    "family_list", "families people",
    """SELECT f.family_id, f.xref, a.display_name AS father_display_name, b.display_name AS mother_display_name
FROM (SELECT * FROM families ORDER BY family_id LIMIT 50 OFFSET 20) f LEFT JOIN people a ON a.person_id = f.father_id LEFT JOIN people b ON b.person_id = f.mother_id""",
)


def _family_rows(order: str) -> str:
    return f"""SELECT f.family_id, a.xref AS father_xref, b.xref AS mother_xref, coalesce(k.children, '') AS children FROM families f
LEFT JOIN people a ON a.person_id = f.father_id LEFT JOIN people b ON b.person_id = f.mother_id
LEFT JOIN (SELECT c.family_id, string_agg(p.xref, '|' ORDER BY {order}) AS children FROM parent_children c JOIN people p ON p.person_id = c.child_id GROUP BY 1) k ON k.family_id = f.family_id"""


oracle("family_detail", "families people parent_children", _family_rows("p.birth_date IS NULL, coalesce(p.birth_date, ''), p.display_name, p.person_id"))
oracle("family_detail_by_sibling", "families people parent_children", _family_rows("c.sibling_order, p.person_id"))
oracle("place_list", "places", "SELECT name FROM places WHERE name ILIKE '%nation_1%' ORDER BY name LIMIT 100 OFFSET 2")
oracle("ancestors", "walk", "SELECT root_id, person_id, depth FROM walk")
oracle(
    "ancestor_trees", "walk parent_links persons events",
    """SELECT w.root_id, l.child_id, l.parent_id, w.depth + 1 AS depth, p.xref, y.birth_year, y.death_year FROM walk w JOIN parent_links l ON l.child_id = w.person_id
JOIN persons p ON p.person_id = l.parent_id LEFT JOIN (SELECT person_id, arg_min(date_year, event_id) FILTER (WHERE event_type = 'birth') AS birth_year,
  arg_min(date_year, event_id) FILTER (WHERE event_type = 'death') AS death_year FROM events GROUP BY 1) y ON y.person_id = l.parent_id WHERE w.depth < 6""",
)
oracle(
    "ancestor_counts", "walk parent_links",
    "SELECT root_id, 1 + count(l.parent_id) AS person_count FROM walk w LEFT JOIN parent_links l ON l.child_id = w.person_id AND w.depth < 6 GROUP BY 1",
)
oracle("fulltext_persons", "persons", f"SELECT person_id FROM persons WHERE {fold('given_name')} IN ('blue') AND {fold('surname')} IN ('bolt')")
oracle("fulltext_documents", "words", "SELECT doc_id FROM words WHERE token IN ('the', 'and', 'with') GROUP BY doc_id HAVING count(DISTINCT token) = 3")
oracle("token_frequencies", "words", "SELECT token, count(DISTINCT doc_id) AS documents FROM words GROUP BY 1")

# ------------------------------------------------------------------- tasks

oracle("person_tasks", "person_tasks", "SELECT person_id, xref, objective, kind, hypothesis FROM person_tasks")
oracle("duplicate_tasks", "duplicate_tasks", "SELECT person_id, objective, hypothesis, b_id::VARCHAR AS related FROM duplicate_tasks")
oracle("research_tasks", "tasks", "SELECT person_id, objective, kind, status, priority FROM tasks ORDER BY block, rank, i, j LIMIT 200")
oracle("task_records", "tasks", "SELECT objective, status, count(*) AS n, count(DISTINCT person_id) AS persons FROM tasks GROUP BY 1, 2")
oracle("task_kinds", "tasks", "SELECT kind, count(*) AS n FROM tasks GROUP BY 1")
oracle("task_filter", "tasks", "SELECT person_id, xref, kind FROM tasks WHERE kind = 'parents' AND contains(lower(objective || ' ' || xref), 'i12')")
oracle(
    "tasks_per_kind", "tasks",
    "SELECT kind, rank::INT AS rank, person_id, objective FROM (SELECT kind, person_id, objective, row_number() OVER (PARTITION BY kind ORDER BY block, rank, i, j) AS rank FROM tasks) WHERE rank <= 12",
)
oracle("tasks_of_persons", "tasks persons", "SELECT person_id, objective, kind, priority FROM tasks WHERE person_id IN (SELECT person_id FROM persons)")

# ------------------------------------------------------------------- sinks

oracle("findings_json", "findings", "SELECT severity, category, count(*) AS n, sum(length(message))::BIGINT AS chars FROM findings GROUP BY 1, 2")
oracle(
    "findings_markdown", "findings",
    f"""SELECT 0 AS section, unnest(['# Informe de qualitat de dades', '', '**Total observacions:** ' || total, '**Errors:** ' || errors || ' · **Warnings:** ' || warnings, '']) AS line FROM (SELECT {_SEVERITIES} FROM findings)
UNION ALL SELECT 1, unnest(['## Observacions', '', '| Severitat | Categoria | Ref | Missatge |', '|---|---|---|---|'])
UNION ALL SELECT 2, '| ' || severity || ' | ' || category || ' | ' || coalesce(ref, '-') || ' | ' || message || ' |' FROM findings
UNION ALL SELECT 3, ''""",
)

_COUNTED = [
    ("Persones", "persons"), ("Famílies", "families"), ("Fonts (SOUR)", "source_records"), ("Mitjans (OBJE)", "media_records"),
    ("Llocs singulars", "places"), ("Esdeveniments", "raw_events"), ("Fills relacionats", "parent_children"),
]
_number = lambda t: f"(SELECT count(*) FROM {t})"
_status = lambda t, n: f"CASE WHEN {_number(t)} = {n} THEN 'OK' ELSE 'FAIL' END"
_BAD_DATES = "SELECT 'warning' AS level, 'bad_date' AS code, 'I' || person_id AS xref, 'Data no reconeguda: ''' || date_text || '''' AS message FROM raw_events JOIN imported USING (date_text) WHERE NOT valid"
_TOLD = {**ISSUES, "bad_date": ("raw_events imported", _BAD_DATES)}
_SUMMARY_LINES = (
    ["'# Informe d''importació'", "''", "'## Resum general'", "''", "'| Mètrica | Valor |'", "'|---|---|'"]
    + [f"'| {label} | ' || {_number(t)} || ' |'" for label, t in _COUNTED]
    + ["''", "'## Verificació de comptes'", "''"]
    + [
        f"'- **{label}**: ' || {_number(t)} || ' (esperat ' || {n} || ') → **' || {_status(t, n)} || '**'"
        for label, t, n in (("Persones", "persons", _number("persons")), ("Famílies", "families", _number("family_records")))
    ]
    + [
        "''",
        f"'**Resultat global:** ' || CASE WHEN {_number('families')} = {_number('family_records')} THEN 'SUPERAT' ELSE 'FALLIT' END",
        "''", "'## Coherència de dades'", "''",
    ]
)
oracle(
    "import_report",
    "persons families family_records source_records media_records places raw_events parent_children " + " ".join(n for n, _ in _TOLD.values()),
    f"""SELECT 0 AS section, unnest([{', '.join(_SUMMARY_LINES)}]) AS line
UNION ALL SELECT 1, unnest(['| Nivell | Codi | Xref | Missatge |', '|---|---|---|---|'])
UNION ALL SELECT 2, '| ' || level || ' | ' || code || ' | ' || xref || ' | ' || message || ' |' FROM ({' UNION ALL '.join(b for _, b in _TOLD.values())})
UNION ALL SELECT 3, unnest(['', '## Esdeveniments per tipus', '', '| Tipus | Quantitat |', '|---|---|'])
UNION ALL SELECT 4, '| ' || event_type || ' | ' || count(*) || ' |' FROM raw_events GROUP BY event_type
UNION ALL SELECT 5, unnest(['', '## Cognoms més freqüents (top 15)', '', '| Cognom | Persones |', '|---|---|'])
UNION ALL SELECT 6, '| ' || surname || ' | ' || n || ' |' FROM (SELECT surname, count(*) AS n FROM persons WHERE surname IS NOT NULL GROUP BY 1 ORDER BY n DESC, surname LIMIT 15)
UNION ALL SELECT 7, ''""",
)
