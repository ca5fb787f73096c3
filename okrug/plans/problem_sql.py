"""Plain SQL for the queries of the data problems, written apart from the operators that it checks."""

from __future__ import annotations

MONTHS = "['янв', 'фев', 'мар', 'апр', 'мая', 'июн', 'июл', 'авг', 'сен', 'окт', 'ноя', 'дек']"
ENGLISH = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"

INSTANTS = rf"""
raw AS (SELECT 'contracts_msp_enriched' AS table_name, row_id, sign_date AS raw, import_source_id AS source FROM contracts_msp_enriched
 UNION ALL SELECT 'msp_snapshot_rows', row_id, snapshot_date, source_id FROM msp_snapshot_rows),
trimmed AS (SELECT table_name, row_id, trim(replace(raw, chr(160), ' ')) AS s, time_zone AS tz FROM raw LEFT JOIN sources ON source_id = source WHERE raw IS NOT NULL),
parts AS (SELECT *, CASE
  WHEN regexp_matches(s, '^\d{{4}}[-.]\d\d[-.]\d\d(\D|$)') THEN [substr(s, 1, 4), substr(s, 6, 2), substr(s, 9, 2), substr(s, 11)]
  WHEN regexp_matches(s, '^\d{{8}}(\D|$)') THEN [substr(s, 1, 4), substr(s, 5, 2), substr(s, 7, 2), regexp_replace(substr(s, 9), '^T(\d\d)(\d\d)(\d\d)', 'T\1:\2:\3')]
  WHEN regexp_matches(s, '^\d\d[./]\d\d[./]\d{{4}}(\D|$)') THEN [substr(s, 7, 4), substr(s, 4, 2), substr(s, 1, 2), substr(s, 11)]
  WHEN regexp_matches(s, '^\d\d[.]\d\d[.]\d\d$') THEN ['20' || substr(s, 7, 2), substr(s, 4, 2), substr(s, 1, 2), '']
  WHEN regexp_matches(s, '^\d+ [а-я]+ \d{{4}}( г\.| года)?$') THEN [regexp_extract(s, '(\d{{4}})', 1), CAST(list_position({MONTHS}, substr(split_part(s, ' ', 2), 1, 3)) AS VARCHAR), split_part(s, ' ', 1), '']
  WHEN regexp_matches(s, '^[A-Z][a-z]+ \d+, \d{{4}}') THEN [regexp_extract(s, ', (\d{{4}})', 1), CAST(list_position({ENGLISH}, lower(substr(s, 1, 3))) AS VARCHAR), regexp_extract(s, ' (\d+),', 1), regexp_replace(s, '^[A-Z][a-z]+ \d+, \d{{4}}', '')]
 END AS p FROM trimmed),
clock AS (SELECT *, TRY_CAST(p[1] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') AS DATE) AS day, regexp_extract(p[4], '^[T ](\d+):(\d\d)(?::(\d\d)(?:\.\d+)?)?( [AP]M)?', ['h', 'm', 's', 'half']) AS c, trim(regexp_replace(p[4], '^[T ]\d+:\d\d(:\d\d(\.\d+)?)?( [AP]M)?', '')) AS z FROM parts),
local AS (SELECT *, day::TIMESTAMP + to_seconds(CASE WHEN c.half = '' THEN coalesce(TRY_CAST(c.h AS INT), 0) ELSE TRY_CAST(c.h AS INT) % 12 + CASE WHEN c.half = ' PM' THEN 12 ELSE 0 END END * 3600 + coalesce(TRY_CAST(c.m AS INT), 0) * 60 + coalesce(TRY_CAST(c.s AS INT), 0)) AS t FROM clock),
zoned AS (SELECT *, regexp_extract(z, '^(?:UTC)?([+-])(\d\d?):?(\d\d)?', ['sign', 'h', 'm']) AS o, timezone(tz, t) AS here FROM local),
instants AS (SELECT table_name, row_id, CASE
  WHEN regexp_full_match(s, '\d{{10}}') THEN CAST(s AS BIGINT)
  WHEN regexp_full_match(s, '\d{{13}}') THEN CAST(s AS BIGINT) // 1000
  WHEN z IN ('Z', 'UTC') THEN epoch(t)::BIGINT
  WHEN z IN ('MSK', 'МСК', '(мск)') THEN epoch(t)::BIGINT - 10800
  WHEN o.sign <> '' THEN epoch(t)::BIGINT - (CASE o.sign WHEN '-' THEN -1 ELSE 1 END) * (TRY_CAST(o.h AS INT) * 3600 + coalesce(TRY_CAST(o.m AS INT), 0) * 60)
  WHEN z = '' AND timezone(tz, here - INTERVAL 1 HOUR) = t THEN epoch(here)::BIGINT - 3600
  WHEN z = '' THEN epoch(here)::BIGINT END AS utc_epoch FROM zoned)"""


def _control(weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CAST(substr(f, {i}, 1) AS INT) * {w}" for i, w in enumerate(weights, 1)) + ") % 11 % 10"


VALID = f"""CASE WHEN regexp_full_match(f, '[0-9]{{10}}') THEN {_control((2, 4, 10, 3, 5, 9, 4, 6, 8))} = CAST(substr(f, 10, 1) AS INT)
 WHEN regexp_full_match(f, '[0-9]{{12}}') THEN {_control((7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} = CAST(substr(f, 11, 1) AS INT) AND {_control((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} = CAST(substr(f, 12, 1) AS INT) ELSE false END"""
FILLED = "CASE WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) BETWEEN 1 AND 9 THEN lpad(regexp_replace({0}, '[^0-9]', '', 'g'), 10, '0') ELSE regexp_replace({0}, '[^0-9]', '', 'g') END AS f"
REGISTER = f"""{INSTANTS},
reg AS (SELECT * FROM (SELECT s.row_id, received_at, category, category_code, (utc_epoch + 18000) // 86400 AS day, {FILLED.format('inn')} FROM msp_snapshot_rows s JOIN instants i ON i.row_id = s.row_id AND table_name = 'msp_snapshot_rows' WHERE utc_epoch IS NOT NULL))"""

P2 = f"WITH {INSTANTS} SELECT table_name, row_id, utc_epoch FROM instants WHERE utc_epoch IS NOT NULL"

P3 = f"""WITH {REGISTER},
best AS (SELECT day, f AS inn, category, category_code FROM (SELECT *, row_number() OVER (PARTITION BY day, f ORDER BY received_at DESC, row_id DESC) AS pos FROM reg WHERE {VALID}) WHERE pos = 1),
cls AS (SELECT day, inn, CASE substr(translate(lower(trim(coalesce(category, CASE category_code WHEN '1' THEN 'микро' WHEN '2' THEN 'малое' WHEN '3' THEN 'среднее' END))), 'aceopx', 'асеорх'), 1, 2) WHEN 'ми' THEN 1 WHEN 'ма' THEN 2 WHEN 'ср' THEN 3 END AS c FROM best),
days AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM reg)),
cur AS (SELECT d.day, x.inn, x.c FROM cls x JOIN days d ON d.day = x.day WHERE before IS NOT NULL), was AS (SELECT d.day, x.inn, x.c FROM cls x JOIN days d ON d.before = x.day)
SELECT inn, strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS snapshot_date, change_kind FROM (SELECT coalesce(a.inn, b.inn) AS inn, coalesce(a.day, b.day) AS day, CASE WHEN b.inn IS NULL THEN 'added' WHEN a.inn IS NULL THEN 'removed' WHEN a.c <> b.c THEN 'changed' END AS change_kind FROM cur a FULL JOIN was b ON a.day = b.day AND a.inn = b.inn) WHERE change_kind IS NOT NULL"""

P4 = f"""WITH {REGISTER},
firsts AS (SELECT day, min(epoch_us(received_at)) AS t FROM reg GROUP BY 1),
ev AS (SELECT * FROM (SELECT k.row_id, utc_epoch * 1000000 AS t, {FILLED.format('supplier_inn')} FROM contracts_msp_enriched k JOIN instants i ON i.row_id = k.row_id AND table_name = 'contracts_msp_enriched' WHERE utc_epoch IS NOT NULL) WHERE {VALID}),
forced AS (SELECT e.row_id, e.t, e.f, max(day) AS day FROM ev e JOIN firsts ON firsts.t <= e.t GROUP BY 1, 2, 3)
SELECT row_id, msp_row_id FROM (SELECT e.row_id, r.row_id AS msp_row_id, row_number() OVER (PARTITION BY e.row_id ORDER BY received_at DESC, r.row_id DESC) AS pos FROM forced e JOIN reg r ON r.f = e.f AND r.day = e.day AND epoch_us(received_at) <= e.t) WHERE pos = 1"""

FIELD = """(?:"(?:[^"]|"")*"|[^;"]*)"""
P6 = f"""WITH q AS (SELECT line_id, coalesce(line, '') AS line, NOT regexp_full_match(coalesce(line, ''), '(?s){FIELD}(;{FIELD})*') AS quoting FROM contract_lines_raw),
c AS (SELECT line_id, quoting, regexp_extract_all(';' || line, '(?s);({FIELD})', 1) AS v, line FROM q),
n AS (SELECT line_id, quoting, len(v) <> 11 AS count_bad, v[10] AS inn, v[5] AS amount, v[3] AS d FROM c),
u AS (SELECT line_id, quoting, count_bad, {', '.join(f'''CASE WHEN {x} LIKE '"%' THEN replace({x}[2:-2], '""', '"') ELSE {x} END AS {x}''' for x in ('inn', 'amount', 'd'))} FROM n),
w AS (SELECT *, replace(replace(inn, ' ', ''), chr(160), '') AS f, trim(replace(amount, chr(160), ' ')) AS a, trim(replace(d, chr(160), ' ')) AS t FROM u)
SELECT line_id, reason FROM (
 SELECT line_id, 'quoting' AS reason FROM w WHERE quoting UNION ALL SELECT line_id, 'column_count' FROM w WHERE NOT quoting AND count_bad
 UNION ALL SELECT line_id, 'supplier_inn' FROM w WHERE NOT quoting AND NOT count_bad AND inn <> '' AND NOT {VALID}
 UNION ALL SELECT line_id, 'amount' FROM w WHERE NOT quoting AND NOT count_bad AND amount <> '' AND NOT regexp_full_match(a, '([0-9]+|[0-9]{{1,3}}( [0-9]{{3}})+)([.,][0-9]{{1,2}})?')
 UNION ALL SELECT line_id, 'sign_date' FROM w WHERE NOT quoting AND NOT count_bad AND coalesce(CASE WHEN regexp_full_match(t, '\\d{{4}}-\\d\\d-\\d\\d') THEN TRY_CAST(t AS DATE) WHEN regexp_full_match(t, '\\d\\d\\.\\d\\d\\.\\d{{4}}') THEN TRY_CAST(substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2) AS DATE) END IS NULL, true))"""



def _items(x: str) -> str:
    """A JSON member as a list: itself if it is one, else its only element; nothing for null."""
    return f"(CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [CAST({x} AS JSON)] END)"


def _value(x: str, *members: str) -> str:
    inner = ", ".join(f"""{x} ->> '$."{m}"'""" for m in members)
    return f"CASE json_type({x}) WHEN 'OBJECT' THEN coalesce({inner}) WHEN 'NULL' THEN NULL ELSE {x} ->> '$' END"


def _both(x: str, xml: str, plain: str) -> str:
    return f"""coalesce({x} -> '$.{'.'.join(f'"{m}"' for m in xml.split('.'))}', {x} -> '$.{plain}')"""


def _unnested(name: str, source: str, keys: str, expression: str) -> str:
    return f"{name} AS (SELECT {keys}, unnest(l) AS x, generate_subscripts(l, 1) AS no FROM (SELECT {keys}, {_items('m')} AS l FROM (SELECT {keys}, {expression} AS m FROM {source})))"


P1 = f"""WITH j AS (SELECT raw_id, TRY_CAST(CASE WHEN starts_with(payload, chr(65279)) THEN substr(payload, 2) ELSE payload END AS JSON) AS j FROM registry_docs),
{_unnested("docs", "j", "raw_id", _both("j", "Файл.Документ", "records"))},
d AS (SELECT raw_id, no AS doc_no, coalesce(o -> '$.normalized', o -> '$."нормализовано"', o) AS o FROM (SELECT raw_id, no, CASE WHEN json_type(x) = 'VARCHAR' THEN TRY_CAST(x ->> '$' AS JSON) ELSE x END AS o FROM docs)),
{_unnested("okved", "d", "raw_id, doc_no", _both("o", "СвОКВЭД.СвОКВЭДДоп", "okved_extra"))},
{_unnested("product", "d", "raw_id, doc_no", _both("o", "СвПрод", "products"))},
{_unnested("lic", "d", "raw_id, doc_no", _both("o", "СвЛиценз", "licenses"))},
{_unnested("act", "(SELECT raw_id, doc_no, no AS parent_no, x AS o FROM lic)", "raw_id, doc_no, parent_no", _both("o", "НаимЛицВД", "activities"))},
found AS (
 {" UNION ALL ".join(f"SELECT raw_id, doc_no, '{c}' AS child, 0 AS parent_no, 1 AS child_no, o ->> '$.{p}' AS value FROM d" for c, p in (("inn", '"ОргВклМСП"."ИННЮЛ"'), ("inn", '"ИПВклМСП"."ИННФЛ"'), ("inn", "inn"), ("district", '"СведМН"."Район"."Наим"'), ("district", "district"), ("okved_main", '"СвОКВЭД"."СвОКВЭДОсн"."КодОКВЭД"'), ("okved_main", "okved_main")))}
 UNION ALL SELECT raw_id, doc_no, 'okved_extra', 0, no, {_value("x", "КодОКВЭД", "code")} FROM okved
 UNION ALL SELECT raw_id, doc_no, 'product', 0, no, {_value("x", "КодПрод", "code")} FROM product
 UNION ALL SELECT raw_id, doc_no, 'license', 0, no, coalesce(x ->> '$."НомЛиценз"', x ->> '$.number') FROM lic
 UNION ALL SELECT raw_id, doc_no, 'license_activity', parent_no, no, {_value("x", "Текст", "name")} FROM act)
SELECT raw_id, CAST(doc_no AS INT) AS doc_no, child, CAST(parent_no AS INT) AS parent_no, CAST(child_no AS INT) AS child_no, trim(value) AS value FROM found WHERE trim(value) <> ''"""

P2_UNREAD = f"WITH {INSTANTS} SELECT source, r.raw, count(*) AS n FROM instants i JOIN raw r USING (table_name, row_id) WHERE utc_epoch IS NULL AND trim(r.raw) <> '' GROUP BY ALL"

ORACLE = {"p1_found": P1, "p2_found": P2, "p2_unread": P2_UNREAD, "p3_found": P3, "p4_found": P4, "p6_found": P6}
