"""The same results as plans.preparation in plain SQL, for the check against another engine."""

_VER = "coalesce(try_cast(regexp_extract(version_id, '([0-9]+)', 1) AS BIGINT), -1)"

#: The offset of a zone from UTC in seconds at a UTC or a local instant; the zones of the source table only, US rules since 2007.
_SYSTEMS = """
zones AS (SELECT source_system, date_order, tz_name, CASE tz_name WHEN 'America/New_York' THEN -5 WHEN 'America/Chicago' THEN -6
  WHEN 'America/Denver' THEN -7 WHEN 'America/Phoenix' THEN -7 WHEN 'UTC' THEN 0 END AS std,
  tz_name IN ('America/New_York', 'America/Chicago', 'America/Denver') AS dst FROM source_systems)"""

_W = r"'^[\s ]+|[\s ]+$'".replace(r" ", " ")
_ZN = r"(?:\s*([+-][0-9]{2}(?::?[0-9]{2})?|[A-Za-z]{1,5}))?(?:\[[^\]]*\])?"
_CL = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?:\s*([AaPp])[Mm])?"


def _rx(pattern: str, names: str) -> str:
    return f"regexp_extract(s, '{pattern}', [{', '.join(repr(n) for n in names.split())}])"


def _stamps(rows: str) -> str:
    """CTEs that end in `instants`: the columns of `rows` (which has stamp and source_system) and utc."""
    iso = rf"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:[Tt ]{_CL}{_ZN})?$"
    basic = rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T?([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})([.][0-9]+)?()?{_ZN}$"
    dmy = rf"^(?:[A-Za-z]{{3}}, )?([0-9]{{1,2}})[- ]([A-Za-z]{{3}})[- ]([0-9]{{4}}|[0-9]{{2}}) {_CL}{_ZN}$"
    mdy = rf"^([A-Za-z]{{3}}) ([0-9]{{1,2}}), ([0-9]{{4}}) {_CL}{_ZN}$"
    num = rf"^([0-9]{{1,2}})[/.-]([0-9]{{1,2}})[/.-]([0-9]{{4}}|[0-9]{{2}}) {_CL}{_ZN}$"
    tail = "h mi sec fr ap z"
    return rf"""{_SYSTEMS},
raw AS ({rows}),
cut AS (SELECT r.*, regexp_replace(stamp, {_W}, '', 'g') AS s, date_order, std, dst FROM raw r LEFT JOIN zones z USING (source_system)),
p AS (SELECT *, CASE
  WHEN regexp_matches(s, '^[0-9]{{10}}$|^[0-9]{{13}}$|^[0-9]{{16}}$') THEN NULL
  WHEN regexp_matches(s, '{iso}') THEN {_rx(iso, 'y mo d ' + tail)}
  WHEN regexp_matches(s, '{basic}') THEN {_rx(basic, 'y mo d ' + tail)}
  WHEN regexp_matches(s, '{dmy}') THEN {_rx(dmy, 'd mo y ' + tail)}
  WHEN regexp_matches(s, '{mdy}') THEN {_rx(mdy, 'mo d y ' + tail)}
  WHEN regexp_matches(s, '{num}') AND date_order = 'DMY' THEN {_rx(num, 'd mo y ' + tail)}
  WHEN regexp_matches(s, '{num}') THEN {_rx(num, 'mo d y ' + tail)} END AS f FROM cut),
n AS (SELECT *, CASE WHEN length(f.y) = 2 THEN 2000 ELSE 0 END + f.y::INT AS yy,
  CASE WHEN regexp_matches(f.mo, '^[0-9]+$') THEN f.mo::INT ELSE (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(f.mo)) + 2) // 3 END AS mm, f.d::INT AS dd,
  CASE WHEN f.ap = '' THEN coalesce(try_cast(f.h AS INT), 0) ELSE f.h::INT % 12 + CASE WHEN lower(f.ap) = 'p' THEN 12 ELSE 0 END END AS hh,
  coalesce(try_cast(f.mi AS INT), 0) AS mn, coalesce(try_cast(f.sec AS INT), 0) AS ss,
  coalesce(try_cast(substr(rpad(ltrim(f.fr, '.'), 6, '0'), 1, 6) AS BIGINT), 0) AS us, upper(f.z) AS z FROM p),
l AS (SELECT *, epoch_us(try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', yy, mm, dd) AS TIMESTAMP)) + (hh * 3600 + mn * 60 + ss) * 1000000::BIGINT + us AS loc,
  epoch_us(make_timestamp(yy, 3, 1, 2, 0, 0)) + ((7 - dayofweek(make_date(yy, 3, 1))) % 7 + 7) * 86400000000 AS d0,
  epoch_us(make_timestamp(yy, 11, 1, 2, 0, 0)) + ((7 - dayofweek(make_date(yy, 11, 1))) % 7) * 86400000000 AS d1 FROM n WHERE hh < 24 AND mn < 60 AND ss < 60 OR f IS NULL),
instants AS (SELECT *, CASE
  WHEN f IS NULL THEN CASE length(s) WHEN 10 THEN s::BIGINT * 1000000 WHEN 13 THEN s::BIGINT * 1000 WHEN 16 THEN s::BIGINT END
  WHEN regexp_matches(z, '^[+-]') THEN loc - CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (substr(z, 2, 2)::INT * 3600 + coalesce(try_cast(substr(replace(z, ':', ''), 4, 2) AS INT), 0) * 60) * 1000000::BIGINT
  WHEN z <> '' THEN loc - CASE z WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'EST' THEN -5 WHEN 'EDT' THEN -4 WHEN 'CST' THEN -6 WHEN 'CDT' THEN -5
    WHEN 'MST' THEN -7 WHEN 'MDT' THEN -6 WHEN 'PST' THEN -8 WHEN 'PDT' THEN -7 END * 3600000000::BIGINT
  WHEN dst AND loc >= d0 + 3600000000 AND loc < d1 THEN loc - (std + 1) * 3600000000::BIGINT
  ELSE loc - std * 3600000000::BIGINT END AS utc FROM l WHERE f IS NOT NULL OR regexp_matches(s, '^[0-9]{{10}}$|^[0-9]{{13}}$|^[0-9]{{16}}$'))"""


_CONTRACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_ALL = " UNION ALL ".join(
    f"SELECT '{t}' AS source_table, {k} AS row_key, '{f}' AS field_name, {f} AS stamp, source_system FROM {t} WHERE NOT regexp_matches({f}, '{_CONTRACT}')"
    for t, k, f in (("bills", "record_id", "submitted_at"), ("billing_events", "event_id", "event_at"), ("observation_windows", "window_id", "coverage_start"))
)
_EVENTS = "SELECT event_id, event_at AS stamp, source_system, epoch_us(available_at) AS known FROM billing_events"
_LOG = f"{_stamps(_EVENTS)}, ev AS (SELECT event_id, min(utc) AS t, min(known) AS k FROM instants GROUP BY 1)"
_DAY = "86400000000"
_LATE = f"k - (t // {_DAY} + 1) * {_DAY}"

_REJECT_RAW = r"""
raw AS (SELECT line_id, feed, regexp_replace(coalesce(raw, ''), '\r\z', '') AS r FROM raw_lines WHERE feed IN ('bills', 'events', 'allocations')),
fields AS (SELECT *, regexp_full_match(r, '(?:"(?:[^"]|"")*"|[^",\r\n]*)(?:,(?:"(?:[^"]|"")*"|[^",\r\n]*))*') AS ok,
  list_transform(regexp_extract_all(',' || r, ',("(?:[^"]|"")*"|[^",\r\n]*)', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM raw),
judged AS (SELECT *, CASE feed WHEN 'bills' THEN 13 WHEN 'events' THEN 12 ELSE 7 END AS n FROM fields),
bad AS (
  SELECT line_id, 'quoting' AS reason FROM judged WHERE NOT ok
  UNION ALL SELECT line_id, 'column_count' FROM judged WHERE ok AND len(v) <> n
  UNION ALL SELECT line_id, 'bad_amount' FROM judged WHERE ok AND len(v) = n AND feed <> 'events' AND NOT (regexp_full_match(v[CASE feed WHEN 'bills' THEN 9 ELSE 4 END], '[0-9]{1,18}') AND regexp_matches(v[CASE feed WHEN 'bills' THEN 9 ELSE 4 END], '[1-9]'))
  UNION ALL SELECT line_id, 'bad_currency' FROM judged WHERE ok AND len(v) = n AND feed = 'bills' AND v[10] <> 'USD'
  UNION ALL SELECT line_id, 'bad_flag' FROM judged WHERE ok AND len(v) = n AND feed = 'events' AND v[11] NOT IN ('true', 'false', 'True', 'False'))"""


def _not_amount(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_full_match({c}, '[0-9]{{1,18}}') OR NOT regexp_matches({c}, '[1-9]'))"


_TREE = r"""b AS (SELECT record_id AS id, min(nullif(regexp_replace(previous_record_id, '^\s+|\s+$', '', 'g'), '')) AS p FROM bills WHERE record_id <> '' GROUP BY 1),
t AS (SELECT id, id AS root, 0 AS depth, id AS path FROM b WHERE p IS NULL OR p NOT IN (SELECT id FROM b)
  UNION ALL SELECT b.id, t.root, t.depth + 1, t.path || '/' || b.id FROM t JOIN b ON b.p = t.id)"""

SQL = {
    "p1_found": f"WITH {_stamps(_ALL)} SELECT DISTINCT source_table, row_key, field_name, utc AS utc_micros FROM instants WHERE utc IS NOT NULL",
    "p2_found": f"""WITH {_LOG}, log AS (SELECT 'event' AS record_kind, event_id AS row_key, t, k FROM ev
      UNION ALL SELECT 'allocation', allocation_id, t, epoch_us(available_at) FROM allocations a JOIN ev ON a.payment_event_id = ev.event_id)
      SELECT DISTINCT record_kind, row_key, CASE WHEN {_LATE} <= 30 * {_DAY} THEN 'late' ELSE 'too_late' END AS late_kind FROM log WHERE {_LATE} > 2 * {_DAY}""",
    "p2_daily": f"""WITH {_LOG} SELECT strftime(make_timestamp(t // {_DAY} * {_DAY}), '%Y-%m-%d') AS day, count(*) FILTER ({_LATE} <= 2 * {_DAY}) AS n_on_time,
      count(*) FILTER ({_LATE} > 2 * {_DAY} AND {_LATE} <= 30 * {_DAY}) AS n_late, count(*) FILTER ({_LATE} > 30 * {_DAY}) AS n_too_late
      FROM ev WHERE t IS NOT NULL AND k IS NOT NULL GROUP BY 1""",
    "p2_views": f"""WITH {_LOG.replace('min(known) AS k', 'min(known) AS k, max(amount) AS amount').replace('AS known FROM', 'AS known, amount_minor AS amount FROM')},
      log AS (SELECT 'event' AS record_kind, t, k, amount FROM ev UNION ALL SELECT 'allocation', t, k, amount FROM (SELECT DISTINCT allocation_id, payment_event_id, epoch_us(available_at) AS k, CASE WHEN regexp_full_match(allocated_amount_minor, '[0-9]{{1,18}}') THEN allocated_amount_minor::BIGINT END AS amount FROM allocations) JOIN (SELECT event_id AS payment_event_id, t FROM ev) USING (payment_event_id)),
      x AS (SELECT *, {_LATE} AS lag FROM log WHERE t IS NOT NULL AND k IS NOT NULL)
      SELECT record_kind, strftime(make_timestamp(t // {_DAY} * {_DAY}), '%Y-%m-%d') AS day, count(*) FILTER (lag <= 2 * {_DAY}) AS n_first, (sum(amount) FILTER (lag <= 2 * {_DAY}))::DECIMAL(38, 0) AS amount_first, count(*) FILTER (lag <= 30 * {_DAY}) AS n,
        (sum(amount) FILTER (lag <= 30 * {_DAY}))::DECIMAL(38, 0) AS amount, true AS is_frozen, count(*) FILTER (lag > 30 * {_DAY}) AS n_too_late, (sum(amount) FILTER (lag > 30 * {_DAY}))::DECIMAL(38, 0) AS amount_too_late FROM x GROUP BY 1, 2""",
    "p3_found": f"""WITH {_REJECT_RAW} SELECT 'raw_lines' AS source_table, line_id::VARCHAR AS row_key, reason FROM bad
      UNION SELECT 'raw_lines', line_id::VARCHAR, 'unknown_feed' FROM raw_lines WHERE feed IS NULL OR feed NOT IN ('bills', 'events', 'allocations')
      UNION SELECT 'bills', record_id, 'bad_amount' FROM bills WHERE {_not_amount('billed_amount_minor')}
      UNION SELECT 'bills', record_id, 'bad_currency' FROM bills WHERE currency IS NULL OR currency <> 'USD'
      UNION SELECT 'billing_events', delivery_id::VARCHAR, 'bad_flag' FROM billing_events WHERE terminal_flag IS NULL OR terminal_flag NOT IN ('true', 'false', 'True', 'False')
      UNION SELECT 'allocations', allocation_id, 'bad_amount' FROM allocations WHERE {_not_amount('allocated_amount_minor')}""",
    "p4_found": f"""WITH RECURSIVE {_TREE} SELECT b.id AS record_id, coalesce(t.root, '') AS root_record_id, coalesce(t.depth, -1) AS depth
      FROM b LEFT JOIN t USING (id) WHERE b.p IN (SELECT id FROM b)""",
    "p4_descendants": f"""WITH RECURSIVE {_TREE}, n AS (SELECT a.id, count(*) AS n FROM t JOIN t a ON t.root = a.root AND t.depth > a.depth AND starts_with(t.path, a.path || '/') GROUP BY 1)
      SELECT b.id AS record_id, coalesce(t.path, '') AS path, coalesce(t.depth, -1) AS depth, coalesce(n.n, 0) AS n_descendants FROM b LEFT JOIN t USING (id) LEFT JOIN n USING (id)""",
    "p6_found": f"""WITH v AS (SELECT DISTINCT org_token, source_system, bill_id, record_id, epoch_us(available_at) AS at, {_VER} AS n, payer_token AS payer,
        CASE WHEN regexp_full_match(billed_amount_minor, '[0-9]{{1,18}}') THEN billed_amount_minor::BIGINT END AS amount FROM bills),
      e AS (SELECT DISTINCT event_id, bill_record_id, epoch_us(available_at) AS at FROM billing_events),
      top AS (SELECT org_token, source_system, bill_id, arg_min(record_id, (-n, record_id)) AS top_id FROM v GROUP BY ALL),
      ek AS (SELECT e.event_id, b.org_token, b.source_system, b.bill_id, e.at, top.top_id FROM e JOIN v b ON b.record_id = e.bill_record_id JOIN top USING (org_token, source_system, bill_id)),
      es AS (SELECT event_id, top_id, coalesce(arg_min(v.record_id, (-v.n, v.record_id)), '') AS seen FROM ek LEFT JOIN v ON v.org_token = ek.org_token AND v.source_system = ek.source_system AND v.bill_id = ek.bill_id AND v.at <= ek.at GROUP BY ALL),
      s AS (SELECT snapshot_id, s.org_token, s.source_system, s.bill_id, t, max_input_available_at AS m, payer_token, billed_amount_minor, arg_min(v, (-v.n, v.record_id)) AS k
        FROM snapshots s LEFT JOIN v ON v.org_token = s.org_token AND v.source_system = s.source_system AND v.bill_id = s.bill_id AND v.at <= epoch_us(s.t) GROUP BY ALL)
      SELECT DISTINCT 'event' AS record_kind, event_id AS row_key, seen AS record_id FROM es WHERE seen <> top_id
      UNION SELECT 'snapshot', snapshot_id, coalesce(k.record_id, '') FROM s WHERE m > t OR payer_token IS DISTINCT FROM k.payer OR billed_amount_minor IS DISTINCT FROM k.amount""",
    "p7_kept": """WITH x AS (SELECT event_id, delivery_id, batch_id IS NOT DISTINCT FROM (SELECT arg_max(batch_id, delivery_id) FROM billing_events) AS is_new FROM billing_events)
      SELECT delivery_id FROM x WHERE coalesce(event_id, '') = '' OR NOT EXISTS (SELECT 1 FROM x y WHERE y.event_id = x.event_id AND (y.is_new, y.delivery_id) < (x.is_new, x.delivery_id))""",
    "p7_found": "SELECT delivery_id FROM billing_events a WHERE event_id <> '' AND EXISTS (SELECT 1 FROM billing_events b WHERE b.event_id = a.event_id AND b.delivery_id < a.delivery_id)",
}
