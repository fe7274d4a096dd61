"""The same results in plain SQL over the same tables, for checking."""

from __future__ import annotations

from curbside.functions import lookups
from curbside.plans import bindings as b


def _case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def _pick(index: str, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({index} AS INT) + 1]"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


def _total(column: str, digits: int = 2) -> str:
    return f"CAST(ROUND(SUM(CAST({column} AS DECIMAL(18,6))), {digits}) AS DOUBLE)"


def _mean(column: str) -> str:
    return f"(CAST(SUM(CAST({column} AS DECIMAL(18,6))) AS DOUBLE) / COUNT({column}))"


def _up(x: str, digits: int = 0) -> str:
    return f"FLOOR(({x}) * {10**digits} + 0.5) / {10**digits}"


def _away(x: str, digits: int) -> str:
    return f"SIGN({x}) * FLOOR(ABS({x}) * {10**digits} + 0.5) / {10**digits}"


def _even(x: str, digits: int) -> str:
    return f"CAST(ROUND_EVEN(({x}) * {10**digits}, 0) AS DOUBLE) / {10**digits}"


def _bucket(key: str, buckets: int, seed: int) -> str:
    return (
        f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8))::BIGINT "
        f"% {buckets} AS INT)"
    )


_BRAND = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)"
_K = "json_extract_string(props, '$.k')"

COLLECTIONS = f"""collections AS (
  SELECT l_orderkey, l_partkey,
         {_case("o_orderpriority", b.AREA_OF_PRIORITY)} AS area,
         {_case("p_type", b.TYPE_OF_PART)} AS waste_type,
         {_pick(_BRAND + " % 6", b.MATERIAL_OF_BRAND)} AS material_type,
         l_quantity AS weight_kg, l_extendedprice AS volume_liters,
         l_discount * 1000 AS moisture_pct,
         CAST(l_returnflag <> 'R' AS INT) AS recyclable,
         CAST(l_shipdate AS DATE) AS collection_date,
         dayname(l_shipdate) AS day_of_week,
         CAST(month(l_shipdate) AS INT) AS month
  FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey)"""

REPORTS = f"""reports AS (
  SELECT event_id AS id,
         CASE WHEN user_id % 10 <> 0 THEN 'citizen ' || user_id END AS reporter_name,
         CASE WHEN user_id % 7 <> 0 THEN {_pick("user_id % 5", lookups.AREAS)} END AS location,
         CASE WHEN user_id % 9 <> 0 THEN {_pick("user_id % 6", b.ALL_TYPES)} END AS waste_type,
         CASE WHEN event_type <> 'view' THEN props ELSE '' END AS description,
         CASE WHEN event_type = 'purchase' THEN event_id || '.jpg' END AS image_name,
         {_case("event_type", b.STATUS_OF_EVENT)} AS status,
         ts AS created_at
  FROM events)"""

CLEAN_REPORTS = f"""{REPORTS}, cleaned AS (
  SELECT id, COALESCE(reporter_name, 'Anonymous') AS reporter_name,
         COALESCE(location, '') AS location,
         COALESCE(waste_type, 'Unknown') AS waste_type,
         COALESCE(description, '') AS description,
         strftime(created_at, '%Y%m%d_%H%M%S') || '_' || NULLIF(image_name, '') AS image_path,
         'pending' AS status,
         created_at
  FROM reports)"""

REQUESTS = f"""requests AS (
  SELECT event_id AS id,
         CASE WHEN user_id % 10 <> 0 THEN CAST(value AS VARCHAR) END AS weight_kg,
         CASE event_type WHEN 'error' THEN props WHEN 'view' THEN NULL ELSE {_K} END AS moisture_pct,
         CASE WHEN user_id % 7 <> 0 THEN CAST(user_id % 2 AS VARCHAR) END AS recyclable,
         CASE WHEN user_id % 9 <> 0 THEN {_pick("user_id % 6", b.MATERIAL_OF_BRAND)} END AS material_type
  FROM events), cleaned AS (
  SELECT id,
         CASE WHEN weight_kg IS NULL THEN 2.0::DOUBLE ELSE TRY_CAST(weight_kg AS DOUBLE) END AS weight_kg,
         CASE WHEN moisture_pct IS NULL THEN 20.0::DOUBLE ELSE TRY_CAST(moisture_pct AS DOUBLE) END AS moisture_pct,
         CASE WHEN recyclable IS NULL THEN 1 ELSE TRY_CAST(recyclable AS INT) END AS recyclable,
         COALESCE(material_type, 'synthetic_polymer') AS material_type,
         CAST((weight_kg IS NOT NULL AND TRY_CAST(weight_kg AS DOUBLE) IS NULL)
           OR (moisture_pct IS NOT NULL AND TRY_CAST(moisture_pct AS DOUBLE) IS NULL)
           OR (recyclable IS NOT NULL AND TRY_CAST(recyclable AS INT) IS NULL) AS INT) AS cast_failed
  FROM requests)"""

RECORDS = f"""records AS (
  SELECT event_id + 1 AS id, {_pick("user_id % 5", lookups.AREAS)} AS area,
         {_pick("user_id % 6", b.ALL_TYPES)} AS waste_type,
         value AS weight_kg, CAST({_K} AS DOUBLE) AS moisture_pct,
         CAST(event_type <> 'error' AS INT) AS recyclable,
         {_pick("user_id % 6", b.MATERIAL_OF_BRAND)} AS material_type,
         dayname(ts) AS day_of_week, CAST(month(ts) AS INT) AS month,
         value * 2.5 AS volume_liters
  FROM events)"""

ADVICE = f"advice(waste_type, action, color, tip) AS (VALUES {_values(lookups.ADVICE)})"

_KIND = (
    "CASE WHEN material_type IN ("
    + ", ".join(f"'{m}'" for m in lookups.MATERIALS)
    + ") THEN material_type ELSE 'synthetic_polymer' END"
)


def _rule(part: int) -> str:
    """Label (0) or confidence (1) of the first rule that holds."""

    def out(rule: str) -> str:
        value = lookups.RULE_RESULTS[rule][part]
        return f"'{value}'" if part == 0 else f"{value}::DOUBLE"

    kinds = " ".join(
        f"WHEN {_KIND} = '{m}' THEN {out(m)}" for m in ("synthetic_polymer", "ferrous", "cellulose")
    )
    return f"CASE WHEN moisture_pct > 50 THEN {out('wet')} {kinds} ELSE {out('other')} END"


def _advised(source: str, label: str) -> str:
    """``source`` left joined with the advice, unknown labels getting the fallback."""
    action, color, tip = dict((r[0], r[1:]) for r in lookups.ADVICE)[lookups.FALLBACK_ADVICE]
    return (
        f"SELECT s.*, COALESCE(a.action, '{action}') AS recommendation, "
        f"COALESCE(a.color, '{color}') AS color, COALESCE(a.tip, '{tip}') AS segregation_tip "
        f"FROM {source} s LEFT JOIN advice a ON a.waste_type = s.{label}"
    )


AREA_TOTALS = f"""area_totals AS (
  SELECT area, {_total("weight_kg")} AS total_kg, {_total("volume_liters")} AS total_volume,
         COUNT(*) AS collections FROM collections GROUP BY area)"""
TYPE_TOTALS = f"""type_totals AS (
  SELECT waste_type, {_total("weight_kg")} AS total_kg, {_total("volume_liters")} AS total_volume
  FROM collections GROUP BY waste_type)"""
STATS = f"""stats AS (
  SELECT {_total("weight_kg")} AS total_waste_kg, {_total("volume_liters")} AS total_volume,
         {_away(_mean("moisture_pct"), 1)} AS avg_moisture,
         CAST(SUM(CASE WHEN recyclable = 1 THEN 1 ELSE 0 END) AS BIGINT) AS recyclable_count,
         COUNT(*) AS total_records FROM collections)"""
SCHEDULE = f"""schedule AS (
  SELECT run_order, area, {_pick("(run_order - 1) % 5", lookups.TIME_SLOTS)} AS time,
         CASE WHEN total_volume > high THEN 'High' WHEN total_volume > medium THEN 'Medium'
              ELSE 'Low' END AS priority,
         total_volume AS estimated_volume
  FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY total_volume DESC, area) AS run_order
        FROM area_totals)
  CROSS JOIN limits)"""
MEAN_LIMITS = f"""limits AS (
  SELECT {_mean("total_volume")} AS high, {_mean("total_volume")} * 0.99 AS medium FROM area_totals)"""

DAILY = f"""daily AS (
  SELECT area, collection_date, {_total("volume_liters", 6)} AS total_volume
  FROM collections GROUP BY area, collection_date)"""
BASE = f"base AS (SELECT area, {_mean('total_volume')} AS base_volume FROM daily GROUP BY area)"
FACTORS = f"""per_day AS (
  SELECT collection_date, {_total("total_volume", 6)} AS v FROM daily GROUP BY collection_date),
factors AS (
  SELECT dayname(collection_date) AS day_of_week,
         {_mean("v")} / (SELECT {_mean("v")} FROM per_day) AS multiplier
  FROM per_day GROUP BY dayname(collection_date))"""
GRID = """grid AS (
  SELECT area, CAST(day_no AS INT) AS day_no, first_day + CAST(day_no AS INT) AS prediction_date
  FROM (SELECT DISTINCT area FROM daily)
  CROSS JOIN (SELECT MAX(collection_date) + 1 AS first_day FROM daily)
  CROSS JOIN range(7) AS r(day_no))"""
FORECAST = f"""{COLLECTIONS}, {DAILY}, {BASE}, {FACTORS}, {GRID}, forecast AS (
  SELECT area, day_no, prediction_date, dayname(prediction_date) AS day_of_week,
         {_even("base_volume * COALESCE(multiplier, 1.0)", 1)} AS predicted_volume
  FROM grid LEFT JOIN base USING (area)
  LEFT JOIN factors ON factors.day_of_week = dayname(prediction_date))"""
FIRST_WINS = f"""WITH {FORECAST}, merged AS (
  SELECT area, prediction_date, {_even("base_volume", 1)} AS predicted_volume
  FROM grid JOIN base USING (area) WHERE day_no < 3
  UNION ALL
  SELECT area, prediction_date, predicted_volume FROM forecast WHERE day_no >= 3)
SELECT area, CAST(prediction_date AS VARCHAR) AS prediction_date, predicted_volume,
       0.87::DOUBLE AS confidence FROM merged"""

RULED = f"""{COLLECTIONS}, ruled AS (
  SELECT *, {_rule(0)} AS predicted_type, {_rule(1)} AS confidence FROM collections)"""


def _confusion(source: str, label: str, prediction: str, classes: list[str]) -> str:
    names = ", ".join(f"('{c}')" for c in classes)
    return f"""classes(name) AS (VALUES {names}), confusion AS (
  SELECT a.name AS label, p.name AS prediction, COUNT(s.hit) AS n
  FROM classes a CROSS JOIN classes p
  LEFT JOIN (SELECT {label} AS l, {prediction} AS q, 1 AS hit FROM {source}) s
    ON s.l = a.name AND s.q = p.name
  GROUP BY a.name, p.name)"""


_CONFUSION_OUT = """SELECT label, prediction, n,
  CASE WHEN SUM(n) OVER (PARTITION BY label) > 0
       THEN n / CAST(SUM(n) OVER (PARTITION BY label) AS DOUBLE) ELSE 0.0 END AS row_share
FROM confusion"""

_PER_CLASS = """sides AS (
  SELECT c.name,
         (SELECT CAST(SUM(n) AS BIGINT) FROM confusion WHERE label = c.name) AS support,
         (SELECT CAST(SUM(n) AS BIGINT) FROM confusion WHERE prediction = c.name) AS predicted,
         (SELECT CAST(SUM(n) AS BIGINT) FROM confusion WHERE label = c.name AND prediction = c.name) AS hits
  FROM classes c), rates AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0::DOUBLE END AS p,
         CASE WHEN support > 0 THEN hits / support ELSE 0.0::DOUBLE END AS r FROM sides),
per_class AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM rates),
report AS (
  SELECT name, p AS precision, r AS recall, f AS f1, support FROM per_class
  UNION ALL SELECT 'accuracy', SUM(hits) / SUM(support), SUM(hits) / SUM(support),
                   SUM(hits) / SUM(support), CAST(SUM(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'macro avg', AVG(p), AVG(r), AVG(f), CAST(SUM(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'weighted avg', SUM(p * support) / SUM(support), SUM(r * support) / SUM(support),
                   SUM(f * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM per_class)"""

_MEAN_PREDICTED = f"""{COLLECTIONS}, weekday_means AS (
  SELECT day_of_week, {_even(_mean("volume_liters"), 2)} AS predicted
  FROM collections GROUP BY day_of_week), scored AS (
  SELECT volume_liters, predicted FROM collections JOIN weekday_means USING (day_of_week))"""

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_REPORT_TIME = _TIME.format("created_at")

_NUMERIC = ["weight_kg", "volume_liters", "moisture_pct", "recyclable", "month"]
_PAIRS = [(a, c) for i, a in enumerate(_NUMERIC) for c in _NUMERIC[i + 1 :]]


def _describe_one(c: str) -> str:
    quartiles = ", ".join(
        f"{_away(f'quantile_cont({c}, {p})', 4)} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75)
    )
    return (
        f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, {_away(_mean(c), 4)} AS mean, "
        f"{_away(f'stddev_samp({c})', 4)} AS std, MIN({c}) AS min, {quartiles}, MAX({c}) AS max "
        "FROM collections"
    )


_REPORT_TYPES = {
    "id": "bigint", "reporter_name": "string", "location": "string", "waste_type": "string",
    "description": "string", "image_name": "string", "status": "string", "created_at": "timestamp",
}


def _json_item(fields: list[tuple[str, str]]) -> str:
    """A JSON object, put together as text."""
    parts = []
    for name, kind in fields:
        if kind == "text":
            parts.append(f"'\"{name}\":\"' || {name} || '\"'")
        elif kind == "amount":
            parts.append(f"'\"{name}\":' || CAST(CAST({name} AS DECIMAL(28,2)) AS VARCHAR)")
        else:
            parts.append(f"'\"{name}\":' || CAST({name} AS VARCHAR)")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _json_rows(source: str, order: str, fields: list[tuple[str, str]]) -> str:
    """A JSON array of objects, put together as text."""
    return f"(SELECT '[' || string_agg({_json_item(fields)}, ',' ORDER BY {order}) || ']' FROM {source})"


_AMOUNTS = [("total_kg", "amount"), ("total_volume", "amount")]
_SECTIONS = [
    ("waste_by_type", "type_totals", "total_kg DESC, waste_type", [("waste_type", "text"), *_AMOUNTS]),
    (
        "waste_by_area", "area_totals", "total_kg DESC, area",
        [("area", "text"), *_AMOUNTS, ("collections", "count")],
    ),
    ("reports_summary", "statuses", "status", [("status", "text"), ("count", "count")]),
    (
        "collection_schedule", "schedule", "run_order",
        [("area", "text"), ("time", "text"), ("priority", "text"), ("estimated_volume", "amount")],
    ),
]
SNAPSHOT = f"""WITH {COLLECTIONS}, {REPORTS}, {AREA_TOTALS}, {TYPE_TOTALS}, {STATS},
limits AS (SELECT 400.0 AS high, 200.0 AS medium), {SCHEDULE},
statuses AS (SELECT status, COUNT(*) AS count FROM reports GROUP BY status)
SELECT '{{"waste_by_type":' || {_json_rows("type_totals", "total_kg DESC, waste_type", [("waste_type", "text"), *_AMOUNTS])}
  || ',"waste_by_area":' || {_json_rows("area_totals", "total_kg DESC, area", [("area", "text"), *_AMOUNTS, ("collections", "count")])}
  || ',"reports_summary":' || {_json_rows("statuses", "status", [("status", "text"), ("count", "count")])}
  || ',"stats":{{"total_waste_kg":' || CAST(CAST(total_waste_kg AS DECIMAL(28,2)) AS VARCHAR)
  || ',"total_volume":' || CAST(CAST(total_volume AS DECIMAL(28,2)) AS VARCHAR)
  || ',"avg_moisture":' || CAST(CAST(avg_moisture AS DECIMAL(28,1)) AS VARCHAR)
  || ',"recyclable_count":' || recyclable_count || ',"total_records":' || total_records
  || '}},"total_reports":' || (SELECT COUNT(*) FROM reports)
  || ',"collection_schedule":' || {_json_rows("schedule", "run_order", [("area", "text"), ("time", "text"), ("priority", "text"), ("estimated_volume", "amount")])}
  || '}}' AS snapshot
FROM stats"""

_DECLARED = sorted(lookups.WASTE_TYPES)


def _kilograms(condition: str) -> str:
    return (
        f"COALESCE(CAST(ROUND(SUM(CAST(weight_kg AS DECIMAL(18,6))) FILTER (WHERE {condition}), 2) "
        "AS DOUBLE), 0.0)"
    )


def _histogram(column: str) -> str:
    return f"""bounds AS (
  SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM collections), counted AS (
  SELECT LEAST(CAST(FLOOR(({column} - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, COUNT(*) AS n
  FROM collections CROSS JOIN bounds GROUP BY 1), bins AS (
  SELECT r.bin, lo + r.bin * ((hi - lo) / 20) AS bin_start, lo + (r.bin + 1) * ((hi - lo) / 20) AS bin_end,
         COALESCE(n, 0) AS n
  FROM range(20) AS r(bin) CROSS JOIN bounds LEFT JOIN counted ON counted.bin = r.bin)"""


def _histogram_with_mean(column: str) -> str:
    return f"""WITH {COLLECTIONS}, {_histogram(column)}
SELECT *, (SELECT {_even(_mean(column), 2)} FROM collections) AS mean FROM bins"""


#: Exact split of ``records`` (id, waste_type) by class.
SPLIT = """ranked AS (
  SELECT id, waste_type, ROW_NUMBER() OVER (PARTITION BY waste_type ORDER BY md5(id || '|42'), id) AS rank
  FROM records), sizes AS (SELECT waste_type, COUNT(*) AS size FROM records GROUP BY waste_type),
quotas AS (
  SELECT waste_type, size * 20 // 100 AS whole,
         CEIL(SUM(size) OVER () * 20 / 100) - SUM(size * 20 // 100) OVER () AS missing,
         ROW_NUMBER() OVER (ORDER BY size * 20 % 100 DESC, waste_type) AS place FROM sizes),
parted AS (
  SELECT id, waste_type,
         CASE WHEN rank <= whole + CASE WHEN place <= missing THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS split
  FROM ranked JOIN quotas USING (waste_type))"""

_LABELLED_ORDER = "digest, weight_kg, moisture_pct, recyclable, material_type"
#: Test rows per class of all labelled collections.
SUPPORT = f"""{COLLECTIONS}, labelled AS (
  SELECT *, md5(l_orderkey || '-' || l_partkey || '|42') AS digest FROM collections
  WHERE waste_type IS NOT NULL),
records AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {_LABELLED_ORDER}) AS id FROM labelled),
{SPLIT}, classes(label) AS (VALUES {", ".join(f"('{t}')" for t in b.ALL_TYPES)}),
support AS (
  SELECT label, COUNT(id) AS support
  FROM classes LEFT JOIN parted ON parted.waste_type = label AND split = 'test' GROUP BY label)"""

_KEY = "(l_orderkey || '-' || l_partkey)"
TESTED = f"""{COLLECTIONS}, tested AS (
  SELECT {_KEY} AS key, volume_liters FROM collections
  WHERE volume_liters IS NOT NULL AND {_bucket(_KEY, 100, 42)} < 20)"""

ORACLE_SQL = {
    "waste_by_area": f"""WITH {COLLECTIONS}, {AREA_TOTALS}
SELECT *, collections * 10 AS collections_scaled FROM area_totals ORDER BY total_kg DESC, area""",
    "waste_by_type": f"""WITH {COLLECTIONS}, {TYPE_TOTALS}
SELECT * FROM type_totals ORDER BY total_kg DESC, waste_type""",
    "reports_by_status": f"""WITH {REPORTS}
SELECT status, COUNT(*) AS count FROM reports GROUP BY status ORDER BY status""",
    "kpi_stats": f"WITH {COLLECTIONS}, {STATS} SELECT * FROM stats",
    "kpi_cards": f"""WITH {COLLECTIONS}, {STATS}
SELECT {_up("total_waste_kg / 1000", 1)} AS total_waste_tonnes,
       {_up("total_volume")} AS total_volume_liters,
       CASE WHEN total_records > 0 THEN {_up("recyclable_count / total_records * 100")}
            ELSE 0.0 END AS recyclable_pct,
       (SELECT COUNT(*) FROM events) AS total_reports
FROM stats""",
    "recyclable_split": f"""WITH {COLLECTIONS}
SELECT CASE WHEN recyclable = 1 THEN 'Recyclable' ELSE 'Non-Recyclable' END AS label,
       COUNT(*) AS records FROM collections GROUP BY ALL""",
    "value_counts": f"""WITH {REPORTS}, counts AS (
  SELECT waste_type, COUNT(*) AS n FROM reports WHERE waste_type IS NOT NULL GROUP BY waste_type)
SELECT waste_type, n, {_up("n / (SELECT SUM(n) FROM counts) * 100", 1)} AS share_pct
FROM counts ORDER BY n DESC, waste_type""",
    "area_type_pivot": f"""WITH {COLLECTIONS}
SELECT area, {", ".join(f'{_kilograms(f"waste_type = '{t}'")} AS "{t}"' for t in _DECLARED)},
       {_kilograms("waste_type IS NULL OR waste_type NOT IN (" + ", ".join(f"'{t}'" for t in _DECLARED) + ")")} AS other
FROM collections GROUP BY area ORDER BY area""",
    "area_type_matrix": f"""WITH {COLLECTIONS}
SELECT area, waste_type, {_total("weight_kg")} AS total_kg FROM collections GROUP BY area, waste_type""",
    "heatmap_estimate": f"""WITH {COLLECTIONS}, {AREA_TOTALS}, {TYPE_TOTALS}, cells AS (
  SELECT a.area, t.waste_type, {_up("a.total_kg * t.total_kg / 1000 * 0.1::DOUBLE", 1)} AS estimate
  FROM area_totals a CROSS JOIN type_totals t)
SELECT *, estimate / (SELECT MAX(estimate) FROM cells) AS intensity FROM cells""",
    "group_total": f"""WITH {COLLECTIONS}, totals AS (
  SELECT area, day_of_week, {_total("volume_liters")} AS group_total
  FROM collections GROUP BY area, day_of_week)
SELECT l_orderkey, l_partkey, area, day_of_week, volume_liters, group_total
FROM collections JOIN totals USING (area, day_of_week)""",
    "dashboard_snapshot": SNAPSHOT,
    "dashboard_lines": f"""WITH {COLLECTIONS}, {REPORTS}, {AREA_TOTALS}, {TYPE_TOTALS},
limits AS (SELECT 400.0 AS high, 200.0 AS medium), {SCHEDULE},
statuses AS (SELECT status, COUNT(*) AS count FROM reports GROUP BY status)
""" + " UNION ALL ".join(
        f"SELECT '{name}' AS section, ROW_NUMBER() OVER (ORDER BY {order}) AS position, "
        f"{_json_item(fields)} AS item FROM {source}"
        for name, source, order, fields in _SECTIONS
    ),
    "collection_schedule": f"""WITH {COLLECTIONS}, {AREA_TOTALS}, {MEAN_LIMITS}, {SCHEDULE}
SELECT * FROM schedule ORDER BY run_order""",
    "quick_schedule": f"""WITH {COLLECTIONS}, {AREA_TOTALS}, {MEAN_LIMITS}, {SCHEDULE}
SELECT * FROM schedule WHERE run_order <= 3 ORDER BY run_order""",
    "zone_layer": f"""WITH {COLLECTIONS}, {DAILY}, {BASE},
zones(area, lat, lng) AS (VALUES {_values(lookups.ZONES)}),
styles(priority, next_pickup, color) AS (VALUES {_values(lookups.PRIORITY_STYLE)}),
ranked AS (
  SELECT area, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, base_volume AS volume,
         300 + base_volume * 10 AS radius, (300 + base_volume * 10) * 1.5::DOUBLE AS halo_radius,
         CASE WHEN base_volume > (SELECT MAX(base_volume) FROM base) * 0.999::DOUBLE THEN 'High'
              WHEN base_volume > (SELECT MAX(base_volume) FROM base) * 0.99::DOUBLE THEN 'Medium'
              ELSE 'Low' END AS priority
  FROM base LEFT JOIN zones USING (area))
SELECT ranked.*, next_pickup, color FROM ranked JOIN styles USING (priority)""",
    "clean_reports": f"""WITH {CLEAN_REPORTS}
SELECT * EXCLUDE (created_at), {_REPORT_TIME} AS created_at FROM cleaned""",
    "latest_reports": f"""WITH {REPORTS}
SELECT id, reporter_name, location, waste_type, description, status, {_REPORT_TIME} AS created_at
FROM reports ORDER BY reports.created_at DESC, id DESC LIMIT 50""",
    "reports_snapshot": f"""WITH {REPORTS}, latest AS (
  SELECT id, reporter_name, location, waste_type, description, status,
         strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, created_at AS sent
  FROM reports ORDER BY sent DESC, id DESC LIMIT 50)
SELECT '{{"reports":[' || string_agg(to_json(struct_pack(
         id := id, reporter_name := reporter_name, location := location, waste_type := waste_type,
         description := description, status := status, created_at := created_at))::VARCHAR,
         ',' ORDER BY sent DESC, id DESC) || '],"count":' || COUNT(*) || '}}' AS snapshot FROM latest""",
    "report_display": f"""WITH {CLEAN_REPORTS}
SELECT c.id, c.reporter_name, c.location, lower(c.waste_type) AS type_badge,
       COALESCE(NULLIF(c.description, ''), '—') AS description_text,
       upper(substr(r.status, 1, 1)) || substr(r.status, 2) AS status_label,
       regexp_replace(r.status, '^([^_]*)_', '\\1 ') AS status_text,
       strftime(c.created_at, '%d %b %y, %I:%M ') || lower(strftime(c.created_at, '%p')) AS created_text
FROM cleaned c JOIN reports r ON r.id = c.id""",
    "not_null_violations": f"""WITH {REPORTS}
SELECT 'reporter_name' AS "column", COUNT(*) FILTER (WHERE reporter_name IS NULL) AS nulls FROM reports
UNION ALL SELECT 'location', COUNT(*) FILTER (WHERE location IS NULL) FROM reports
UNION ALL SELECT 'waste_type', COUNT(*) FILTER (WHERE waste_type IS NULL) FROM reports""",
    "quarantined_reports": f"""WITH {REPORTS}
SELECT id, reporter_name, location, waste_type FROM reports
WHERE reporter_name IS NULL OR location IS NULL OR waste_type IS NULL""",
    "unique_violations": """SELECT sha256(text) AS digest, COUNT(*) AS copies FROM documents
WHERE text IS NOT NULL GROUP BY text HAVING COUNT(*) > 1""",
    "keep_first": """SELECT p_name, p_partkey, p_brand FROM part
QUALIFY ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""",
    "column_defaults": f"""WITH {REPORTS}
SELECT id, COALESCE(reporter_name, 'Anonymous') AS reporter_name, COALESCE(location, '') AS location
FROM reports""",
    "surrogate_ids": """SELECT ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey
FROM orders""",
    "assign_dates": f"""WITH {RECORDS}
SELECT id, area, CAST(DATE '2024-01-31' - CAST(id - 1 AS INT) AS VARCHAR) AS collection_date
FROM records""",
    "csv_scan": f"WITH {RECORDS} SELECT * FROM records",
    "head_rows": f"WITH {RECORDS} SELECT * FROM records ORDER BY id LIMIT 10",
    "load_if_empty": f"WITH {RECORDS} SELECT id, area, weight_kg FROM records",
    "append_reports": f"""WITH {CLEAN_REPORTS}
SELECT id, reporter_name, location, waste_type, status FROM cleaned""",
    "column_profile": f"WITH {REPORTS} "
    + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{t}' AS dtype, COUNT({c}) AS non_null FROM reports"
        for i, (c, t) in enumerate(_REPORT_TYPES.items())
    ),
    "describe": f"WITH {COLLECTIONS} "
    + " UNION ALL ".join(_describe_one(c) for c in ("weight_kg", "moisture_pct", "volume_liters")),
    "histogram": f"WITH {COLLECTIONS}, {_histogram('volume_liters')} SELECT * FROM bins",
    "histogram_weight": _histogram_with_mean("weight_kg"),
    "histogram_moisture": _histogram_with_mean("moisture_pct"),
    "correlation_pairs": f"WITH {COLLECTIONS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS row_column, '{a}' AS col_column, {_away(f'corr({c}, {a})', 4)} AS r FROM collections"
        for a, c in _PAIRS
    ),
    "clean_requests": f"WITH {REQUESTS} SELECT * FROM cleaned",
    "rule_classify": f"""WITH {RULED}
SELECT l_orderkey, l_partkey, moisture_pct, material_type, predicted_type, confidence FROM ruled""",
    "recommend": f"""WITH {RECORDS}, {ADVICE}, bins(waste_type, bin_color) AS (VALUES {_values(lookups.BINS)}),
slim AS (SELECT id, waste_type FROM records), advised AS ({_advised("slim", "waste_type")})
SELECT advised.*, bin_color FROM advised LEFT JOIN bins USING (waste_type)""",
    "classify_requests": f"""WITH {REQUESTS}, {ADVICE}, ruled AS (
  SELECT id, {_rule(0)} AS predicted_type, {_rule(1)} AS confidence FROM cleaned WHERE cast_failed = 0)
{_advised("ruled", "predicted_type")}""",
    "quarantined_requests": f"""WITH {REQUESTS}
SELECT id, material_type FROM cleaned WHERE cast_failed = 1""",
    "encode_category": f"""WITH {RECORDS}, codes(material_type, code) AS (
  VALUES {_values([(m, i) for i, m in enumerate(lookups.MATERIALS)])})
SELECT id, material_type, COALESCE(CAST(code AS BIGINT), 4) AS material_code
FROM records LEFT JOIN codes USING (material_type)""",
    "label_encode": """SELECT p_partkey, p_brand, DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS brand_code
FROM part""",
    "hash_split": f"""WITH {RECORDS}
SELECT id, waste_type, CASE WHEN {_bucket("id", 100, 42)} < 20 THEN 'test' ELSE 'train' END AS split
FROM records""",
    "assign_folds": f"WITH {RECORDS} SELECT id, waste_type, {_bucket('id', 5, 42)} AS fold FROM records",
    "stratified_split": f"WITH {RECORDS}, {SPLIT} SELECT * FROM parted",
    "stratified_folds": f"""WITH {RECORDS}
SELECT id, waste_type, CAST((ROW_NUMBER() OVER (
         PARTITION BY waste_type ORDER BY md5(id || '|42'), id) - 1) % 5 AS INT) AS fold FROM records""",
    "rule_accuracy": f"""WITH {RULED}
SELECT COUNT(*) AS n, AVG(CAST(waste_type = predicted_type AS DOUBLE)) AS accuracy FROM ruled""",
    "confusion_matrix": f"""WITH {RULED}, {_confusion("ruled", "waste_type", "predicted_type", b.ALL_TYPES)}
{_CONFUSION_OUT}""",
    "classification_report": f"""WITH {RULED}, {_confusion("ruled", "waste_type", "predicted_type", b.ALL_TYPES)},
{_PER_CLASS}
SELECT name, {", ".join(f"{_away(m, 4)} AS {m}" for m in ("precision", "recall", "f1"))}, support FROM report""",
    "label_confusion": f"""WITH {_confusion("labels", "CAST(quality AS VARCHAR)", "CAST(toxic AS VARCHAR)", ["0", "1"])}
{_CONFUSION_OUT}""",
    "regression_metrics": f"""WITH {_MEAN_PREDICTED}
SELECT COUNT(*) AS n, {_away("sqrt(avg((volume_liters - predicted) * (volume_liters - predicted)))", 4)} AS rmse,
       {_away("1 - avg((volume_liters - predicted) * (volume_liters - predicted)) / var_pop(volume_liters)", 4)} AS r2
FROM scored""",
    "residual_stats": f"""WITH {_MEAN_PREDICTED}
SELECT COUNT(*) AS n, {_away(_mean("volume_liters - predicted"), 4)} AS mean,
       {_away("stddev_pop(volume_liters - predicted)", 4)} AS std FROM scored""",
    "prediction_errors": f"""WITH {RECORDS}
SELECT id, volume_liters AS actual, weight_kg * 3 AS predicted, ABS(volume_liters - weight_kg * 3) AS abs_error
FROM records ORDER BY id LIMIT 10""",
    "forecast_grid": f"""WITH {COLLECTIONS}, {DAILY}, {GRID}
SELECT area, day_no, CAST(prediction_date AS VARCHAR) AS prediction_date,
       dayname(prediction_date) AS day_of_week, CAST(month(prediction_date) AS INT) AS month,
       strftime(prediction_date, '%b %d') AS label,
       CAST(dayofweek(prediction_date) IN (0, 6) AS INT) AS is_weekend FROM grid""",
    "forecast_fallback": f"""WITH {FORECAST}
SELECT area, CAST(prediction_date AS VARCHAR) AS prediction_date, day_of_week, predicted_volume FROM forecast""",
    "forecast_kpis": f"""WITH {FORECAST}, days AS (
  SELECT day_no, prediction_date, {_total("predicted_volume", 1)} AS total FROM forecast GROUP BY ALL),
peak AS (SELECT * FROM days ORDER BY total DESC, day_no LIMIT 1)
SELECT (SELECT {_up("total")} FROM days WHERE day_no = 0) AS day1_total,
       CAST(prediction_date AS VARCHAR) AS peak_date, dayname(prediction_date) AS peak_day,
       {_up("total")} AS peak_total FROM peak""",
    "forecast_capacity": f"""WITH {FORECAST}, used AS (
  SELECT area, CAST(prediction_date AS VARCHAR) AS prediction_date,
         LEAST(100.0::DOUBLE, predicted_volume / ((SELECT MAX(predicted_volume) FROM forecast) * 1.4::DOUBLE) * 100)
           AS capacity_pct FROM forecast)
SELECT *, CASE WHEN capacity_pct > 70 THEN 'high' WHEN capacity_pct > 45 THEN 'mid' ELSE 'low' END AS band
FROM used""",
    "forecast_snapshot": f"""WITH {FORECAST}, per_area AS (
  SELECT area, '"' || area || '":[' || string_agg(CAST(CAST(predicted_volume AS DECIMAL(28,1)) AS VARCHAR),
         ',' ORDER BY day_no) || ']' AS volumes FROM forecast GROUP BY area)
SELECT '{{"dates":[' || (SELECT string_agg('"' || CAST(d AS VARCHAR) || '"', ',' ORDER BY d)
                        FROM (SELECT DISTINCT prediction_date AS d FROM forecast))
  || '],"predictions":{{' || string_agg(volumes, ',' ORDER BY area)
  || '}},"areas":[' || string_agg('"' || area || '"', ',' ORDER BY area) || ']}}' AS snapshot
FROM per_area""",
    "forecast_lines": f"""WITH {FORECAST}, per_area AS (
  SELECT area, string_agg(CAST(CAST(predicted_volume AS DECIMAL(28,1)) AS VARCHAR), ',' ORDER BY day_no) AS volumes
  FROM forecast GROUP BY area)
SELECT 'dates' AS section, ROW_NUMBER() OVER (ORDER BY d) AS position, '{{"date":"' || CAST(d AS VARCHAR) || '"}}' AS item
FROM (SELECT DISTINCT prediction_date AS d FROM forecast)
UNION ALL SELECT 'predictions', ROW_NUMBER() OVER (ORDER BY area),
       '{{"area":"' || area || '","volumes":[' || volumes || ']}}' FROM per_area""",
    "nested_forecast_lines": f"""WITH {FORECAST}, per_area AS (
  SELECT area, string_agg('{{"date":"' || CAST(prediction_date AS VARCHAR) || '","predicted_volume":'
         || CAST(CAST(predicted_volume AS DECIMAL(28,1)) AS VARCHAR) || '}}', ',' ORDER BY day_no) AS days
  FROM forecast GROUP BY area)
SELECT 'forecast' AS section, ROW_NUMBER() OVER (ORDER BY area) AS position,
       '{{"area":"' || area || '","days":[' || days || ']}}' AS item FROM per_area""",
    "nested_forecast": f"""WITH {FORECAST}
SELECT area, CAST(COUNT(*) AS INT) AS days, MAX(predicted_volume) FILTER (WHERE day_no = 0) AS first_volume,
       CAST(MAX(prediction_date) AS VARCHAR) AS last_date FROM forecast GROUP BY area""",
    "insert_if_absent": FIRST_WINS,
    "stream_report_intake": f"""WITH {CLEAN_REPORTS}
SELECT * EXCLUDE (created_at), {_REPORT_TIME} AS created_at FROM cleaned""",
    "stream_daily_counts": f"""WITH {REPORTS}
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, status, COUNT(*) AS n FROM reports
GROUP BY 1, 2""",
    "stream_status_counts": f"WITH {REPORTS} SELECT status, COUNT(*) AS n FROM reports GROUP BY status",
    "stream_scoring": f"""WITH {REQUESTS}, {ADVICE}, ruled AS (
  SELECT id, cast_failed, {_rule(0)} AS predicted_type, {_rule(1)} AS confidence FROM cleaned),
advised AS ({_advised("ruled", "predicted_type")})
SELECT id, CASE WHEN cast_failed = 1 THEN 'quarantined' ELSE 'scored' END AS outcome,
       {", ".join(f"CASE WHEN cast_failed = 0 THEN {c} END AS {c}" for c in
                  ("predicted_type", "confidence", "recommendation", "color", "segregation_tip"))}
FROM advised""",
    "stream_insert_if_absent": FIRST_WINS,
    "stream_model_scoring_rows": f"""WITH {REQUESTS}
SELECT id, CASE WHEN cast_failed = 1 THEN 'quarantined' ELSE 'scored' END AS outcome,
       CASE WHEN cast_failed = 0 THEN TRUE END AS typed FROM cleaned""",
    "rf_classify_support": f"WITH {SUPPORT} SELECT * FROM support",
    "score_batch_ids": f"WITH {REQUESTS} SELECT id, TRUE AS valid FROM cleaned WHERE cast_failed = 0",
    "feature_importance_sum": "SELECT CAST(4 AS BIGINT) AS features, 1.0::DOUBLE AS total",
    "model_comparison_rows": """SELECT model, TRUE AS valid
FROM (VALUES ('Random Forest'), ('Decision Tree'), ('Logistic Regression')) AS m(model)""",
    "best_model_support": f"""WITH {SUPPORT} SELECT label AS name, support FROM support
UNION ALL SELECT name, (SELECT CAST(SUM(support) AS BIGINT) FROM support)
FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) AS m(name)""",
    "volume_model_support": f"WITH {TESTED} SELECT COUNT(*) AS n FROM tested",
    "volume_model_samples": f"""WITH {TESTED}
SELECT key, volume_liters AS actual FROM tested ORDER BY key, volume_liters LIMIT 10""",
    "volume_residual_rows": f"WITH {TESTED} SELECT CAST(20 AS BIGINT) AS bins, COUNT(*) AS n FROM tested",
    "rf_forecast_keys": f"""WITH {COLLECTIONS}, {DAILY}, {BASE}, {GRID}
SELECT area, CAST(prediction_date AS VARCHAR) AS prediction_date, TRUE AS valid,
       CAST(NULL AS DOUBLE) AS fallback_volume FROM grid
UNION ALL SELECT NULL, CAST(prediction_date AS VARCHAR), TRUE,
       (SELECT {_even("AVG(base_volume)", 1)} FROM base)
FROM (SELECT DISTINCT prediction_date FROM grid)""",
    "forecast_without_model": f"""WITH {FORECAST}
SELECT area, CAST(prediction_date AS VARCHAR) AS prediction_date, predicted_volume FROM forecast""",
}
