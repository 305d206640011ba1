"""The results of plans.reconstruction in plain SQL, for the check against another engine."""

_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})"


def _us(c: str) -> str:
    return rf"CASE WHEN regexp_full_match(trim({c}), '{_PATTERN}') THEN epoch_us(try_cast(regexp_replace(trim({c}), '([.][0-9]{{6}})[0-9]+', '\1') AS TIMESTAMPTZ)) END"


def _long(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN try_cast(trim({c}) AS BIGINT) END"


_AS_OF = 1_704_067_200_000_000
_NB = f"nb0 AS (SELECT *, {_us('submitted_at')} AS submitted_us, epoch_us(available_at) AS available_us, {_long('billed_amount_minor')} AS amount FROM bills), nb AS (SELECT *, coalesce(submitted_us IS NOT NULL AND available_us IS NOT NULL AND amount > 0 AND currency = 'USD', false) AS is_valid FROM nb0)"
_NE0 = f"SELECT *, {_us('event_at')} AS event_us, epoch_us(available_at) AS available_us, amount_minor AS amount FROM"
_VALID_E = "coalesce(event_us IS NOT NULL AND available_us IS NOT NULL AND coalesce(amount, 0) >= 0, false)"
_ONCE = "(SELECT * FROM billing_events WHERE coalesce(event_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) = 1 UNION ALL SELECT * FROM billing_events WHERE coalesce(event_id, '') = '')"
_E = f"e AS (SELECT * FROM ({_NE0} {_ONCE}) WHERE {_VALID_E})"
_DEDUP = "QUALIFY first_value(event_id) OVER (PARTITION BY org_token, source_system, bill_record_id, event_type, event_us, amount, currency ORDER BY available_us, event_id) = event_id"
_P = f"e AS (SELECT * FROM ({_NE0} {_ONCE}) WHERE {_VALID_E} {_DEDUP})"
_NA = f"SELECT *, epoch_us(available_at) AS available_us, {_long('allocated_amount_minor')} AS amount FROM"
_VALID_A = "coalesce(available_us IS NOT NULL AND amount > 0 AND currency = 'USD', false)"
_A = f"a AS (SELECT * FROM ({_NA} (SELECT DISTINCT * FROM allocations)) WHERE {_VALID_A})"
_NW = f"SELECT *, {_us('coverage_start')} AS start_us, epoch_us(coverage_end) AS end_us, epoch_us(extracted_at) AS extracted_us FROM"
_VALID_W = "coalesce(end_us >= start_us AND extracted_us IS NOT NULL, false)"
_W = f"w AS (SELECT * FROM ({_NW} (SELECT DISTINCT * FROM observation_windows)) WHERE {_VALID_W})"
_COV = "cov AS (SELECT org_token, arg_max(end_us, (extracted_us, window_id, end_us)) AS coverage_end_us FROM w WHERE coverage_status = 'complete' GROUP BY 1)"
_CONTENT = ("previous_record_id", "payer_token", "service_token", "amount", "currency", "submitted_us", "available_us")
_KEY = "org_token, source_system, bill_id, version_id"
_FIRST = f"OVER (PARTITION BY {_KEY} ORDER BY available_us NULLS FIRST, record_id NULLS FIRST, source_ref NULLS FIRST)"
_B = (
    f"jb AS (SELECT *, row_number() {_FIRST} AS rn, first_value(record_id) {_FIRST} AS first_id, "
    + " AND ".join(f"{c} IS NOT DISTINCT FROM first_value({c}) {_FIRST}" for c in _CONTENT)
    + " AS same FROM nb WHERE is_valid), b AS (SELECT * FROM jb WHERE rn = 1 OR NOT same)"
)
_BASE = f"{_NB}, {_B}"
_PREV = r"regexp_replace(previous_record_id, '^[\s]+|[\s]+$', '', 'g')"
_NUM = "try_cast(regexp_extract(version_id, '^[vV]?([0-9]{1,18})$', 1) AS BIGINT)"
_BILL = "org_token, source_system, bill_id"
_G2 = f"g2 AS (SELECT *, count(*) OVER (PARTITION BY {_BILL}) AS size, max(c) OVER (PARTITION BY {_BILL}) > 1 AS amb FROM (SELECT *, count(*) OVER (PARTITION BY {_KEY}) AS c FROM b))"
_R1 = f"r1 AS (SELECT DISTINCT {_PREV} AS left_id, record_id AS right_id FROM b WHERE {_PREV} <> '')"
_R2 = f"{_G2}, r2 AS (SELECT record_id AS left_id, lead(record_id) OVER (PARTITION BY {_BILL} ORDER BY {_NUM} NULLS LAST, version_id) AS right_id FROM g2 WHERE size > 1 AND NOT amb)"
_R3 = """r3 AS (SELECT x.record_id AS left_id, y.record_id AS right_id FROM b x JOIN b y ON x.org_token = y.org_token AND x.source_system = y.source_system AND x.payer_token = y.payer_token AND x.service_token = y.service_token
  WHERE x.payer_token <> '' AND x.service_token <> '' AND abs(x.amount - y.amount) * 100 <= 8 * greatest(x.amount, y.amount) AND abs(x.submitted_us - y.submitted_us) <= 604800000000
  AND (x.available_us, x.record_id, coalesce(x.source_ref, '')) < (y.available_us, y.record_id, coalesce(y.source_ref, '')))"""
_DEG = "deg AS (SELECT id, count(*) AS n FROM (SELECT left_id AS id FROM r3 UNION ALL SELECT right_id FROM r3) GROUP BY 1), u3 AS (SELECT r3.* FROM r3 JOIN deg l ON l.id = left_id JOIN deg r ON r.id = right_id WHERE l.n = 1 AND r.n = 1)"
_PROPOSED = """p AS (SELECT left_id, right_id, arg_min(rule, n) AS rule FROM (SELECT left_id, right_id, 'R1_native_previous_id' AS rule, 0 AS n FROM r1
  UNION ALL SELECT left_id, right_id, 'R2_same_bill_id_versions', 1 FROM r2 WHERE right_id IS NOT NULL UNION ALL SELECT left_id, right_id, 'R3_amount_date_window', 2 FROM u3) GROUP BY 1, 2)"""
_VERDICTS = f"""k AS (SELECT record_id, arg_min(org_token, (available_us, org_token, submitted_us)) AS org, arg_min(submitted_us, (available_us, org_token, submitted_us)) AS sub FROM b GROUP BY 1),
par AS (SELECT record_id AS node, min({_PREV}) AS parent FROM b WHERE {_PREV} <> '' GROUP BY 1), park AS (SELECT * FROM par WHERE parent IN (SELECT record_id FROM k)),
anc AS (SELECT node, parent AS up FROM park UNION SELECT anc.node, park.parent FROM anc JOIN park ON park.node = anc.up),
v AS (SELECT left_id, right_id, rule, CASE WHEN l.record_id IS NULL OR r.record_id IS NULL THEN 'DANGLING_REFERENCE' WHEN l.org IS DISTINCT FROM r.org THEN 'CROSS_ORG_REFERENCE'
  WHEN left_id = right_id OR EXISTS (SELECT 1 FROM anc WHERE anc.node = left_id AND anc.up = right_id) THEN 'CYCLE_REFERENCE' ELSE 'accepted' END AS verdict,
  coalesce(rule <> 'R3_amount_date_window' AND l.sub > r.sub, false) AS is_late_parent FROM p LEFT JOIN k l ON l.record_id = left_id LEFT JOIN k r ON r.record_id = right_id)"""
_LINKS = f"WITH RECURSIVE {_BASE}, {_R1}, {_R2}, {_R3}, {_DEG}, {_PROPOSED}, {_VERDICTS}"
_ROOTS = """pl AS (SELECT right_id AS node, arg_max(left_id, (rule, left_id)) AS parent FROM v WHERE verdict = 'accepted' GROUP BY 1), ids AS (SELECT DISTINCT record_id AS id FROM b),
pk AS (SELECT * FROM pl WHERE node IN (SELECT id FROM ids) AND parent IN (SELECT id FROM ids)),
cl AS (SELECT node, parent AS up FROM pk UNION SELECT cl.node, pk.parent FROM cl JOIN pk ON pk.node = cl.up),
op AS (SELECT * FROM pk WHERE node NOT IN (SELECT node FROM cl WHERE node = up)),
rt AS (SELECT id, id AS root FROM ids WHERE id NOT IN (SELECT node FROM op) UNION ALL SELECT op.node, rt.root FROM rt JOIN op ON op.parent = rt.id)"""
_OWNER = "own AS (SELECT record_id, min(concat_ws('|', org_token, source_system, bill_id)) AS owner FROM bills GROUP BY 1)"
_PAY = "pay AS (SELECT event_id, min(coalesce(bill_record_id, '')) AS own_record, arg_min(amount, (coalesce(bill_record_id, ''), amount)) AS amount FROM e WHERE event_type = 'PAYMENT_POSTED' AND amount > 0 AND coalesce(currency, '') IN ('', 'USD') GROUP BY 1)"
_OVER = "ov AS (SELECT pay.event_id, any_value(pay.amount) AS amount, sum(a.amount)::BIGINT AS allocated FROM pay JOIN a ON a.payment_event_id = pay.event_id GROUP BY 1 HAVING sum(a.amount) > any_value(pay.amount))"
_PARTS = """free AS (SELECT * FROM pay WHERE event_id NOT IN (SELECT event_id FROM ov)),
al AS (SELECT payment_event_id AS event_id, coalesce(own.owner, 'UNLINKED') AS owner, sum(a.amount)::BIGINT AS amount FROM a JOIN free ON free.event_id = payment_event_id LEFT JOIN own ON own.record_id = trim(a.bill_record_id) WHERE trim(coalesce(a.bill_record_id, '')) <> '' GROUP BY 1, 2),
tot AS (SELECT event_id, sum(amount)::BIGINT AS given, count(*) AS n, min(owner) AS sole FROM al GROUP BY 1),
rest AS (SELECT free.event_id, CASE WHEN own_record <> '' THEN coalesce(own.owner, 'UNLINKED') WHEN n = 1 THEN sole ELSE 'UNLINKED' END AS owner, amount - coalesce(given, 0) AS amount FROM free LEFT JOIN tot USING (event_id) LEFT JOIN own ON own.record_id = own_record),
parts AS (SELECT event_id, owner, amount, 0 AS unallocated FROM al UNION ALL SELECT event_id, owner, amount, amount FROM rest WHERE amount > 0)"""
_OWNED = "own AS (SELECT id AS record_id, root AS owner FROM rt)"
#: Reversals divided over the parts of their payment, one after another: floored shares, the last part the rest, the excess to others in turn.
_BACK = """pp AS (SELECT event_id, owner, sum(amount)::BIGINT AS amount, min(seen) AS seen FROM (SELECT event_id, owner, amount, NULL AS seen FROM rest WHERE amount > 0
  UNION ALL SELECT payment_event_id, coalesce(own.owner, 'UNLINKED'), a.amount, (a.available_us, a.allocation_id) FROM a JOIN free ON free.event_id = payment_event_id LEFT JOIN own ON own.record_id = trim(a.bill_record_id) WHERE trim(coalesce(a.bill_record_id, '')) <> '') GROUP BY 1, 2),
hp AS (SELECT event_id, list(owner ORDER BY seen NULLS LAST, owner) AS owners, list(amount ORDER BY seen NULLS LAST, owner) AS gross FROM pp GROUP BY 1),
rv AS (SELECT e.event_id AS reversal_id, trim(reverses_event_id) AS event_id, coalesce(amount, 0) AS amount, available_us FROM e WHERE event_type = 'PAYMENT_REVERSED' AND coalesce(currency, '') IN ('', 'USD') AND trim(coalesce(reverses_event_id, '')) <> ''),
rc AS (SELECT reversal_id, event_id, rv.amount, available_us, pay.amount AS whole, sum(rv.amount) OVER (PARTITION BY event_id ORDER BY available_us, reversal_id ROWS UNBOUNDED PRECEDING) AS total FROM rv JOIN pay USING (event_id)),
tk AS (SELECT event_id, taken, row_number() OVER (PARTITION BY event_id ORDER BY available_us, reversal_id, taken) AS k FROM (SELECT *, (least(total, whole) - least(total - amount, whole))::BIGINT AS taken FROM rc) WHERE taken > 0),
bk AS (SELECT event_id, 0::BIGINT AS k, owners, gross, gross AS held FROM hp
  UNION ALL SELECT event_id, k, owners, gross, list_transform(range(1, len(gross) + 1), lambda i: room[i] - greatest(0, least(room[i], over - coalesce(list_sum(room[1:i-1]), 0)))::BIGINT) FROM
  (SELECT *, (taken - list_sum(got))::BIGINT AS over, list_transform(range(1, len(gross) + 1), lambda i: held[i] - got[i]) AS room FROM
  (SELECT *, list_transform(range(1, len(gross) + 1), lambda i: least(held[i], CASE WHEN i = len(gross) THEN taken - coalesce(list_sum(fl[1:i-1]), 0) ELSE fl[i] END)::BIGINT) AS got FROM
  (SELECT bk.event_id, bk.k + 1 AS k, owners, gross, held, taken, list_transform(gross, lambda g: (taken::HUGEINT * g // list_sum(gross)::HUGEINT)::BIGINT) AS fl FROM bk JOIN tk ON tk.event_id = bk.event_id AND tk.k = bk.k + 1)))),
lb AS (SELECT owners, gross, held FROM bk QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k DESC) = 1),
bo AS (SELECT unnest(owners) AS owner, unnest(gross) - unnest(held) AS r FROM lb),
am AS (SELECT owner, gross, coalesce(r, 0)::BIGINT AS reversed, gross - coalesce(r, 0)::BIGINT AS net, unallocated FROM (SELECT owner, sum(amount)::BIGINT AS gross, sum(unallocated)::BIGINT AS unallocated FROM parts GROUP BY 1) LEFT JOIN (SELECT owner, sum(r) AS r FROM bo GROUP BY 1) USING (owner))"""
_TIMED = """g AS (SELECT payment_event_id AS event_id, owner, min(available_us) AS given FROM a JOIN own ON own.record_id = a.bill_record_id GROUP BY 1, 2),
tm0 AS (SELECT e.event_id, e.event_type, e.amount, e.available_us, own.owner FROM e JOIN own ON own.record_id = e.bill_record_id
  UNION ALL SELECT e.event_id, e.event_type, e.amount, e.available_us, g.owner FROM e JOIN g USING (event_id) WHERE e.bill_record_id IS NULL OR e.bill_record_id NOT IN (SELECT record_id FROM own)),
tm AS (SELECT owner, event_id, event_type, amount, CASE WHEN event_type = 'PAYMENT_POSTED' THEN greatest(available_us, coalesce(given, available_us)) ELSE available_us END AS at_us FROM tm0 LEFT JOIN g USING (event_id, owner))"""
_CAT = "CASE WHEN payer IN ('AET', 'UHC', 'HUM', 'BCB', 'CIG') THEN 'commercial' WHEN payer IN ('MCR', 'MCD') THEN 'government' WHEN payer = 'SELF' THEN 'self' ELSE 'unknown' END"
_D = 86_400_000_000
_KINDS = {"n_corrected": "CORRECTED", "n_voids": "VOID_VERSION", "n_payments": "PAYMENT_POSTED", "n_unknown": "UNKNOWN", "n_status": "STATUS_UPDATED", "n_closes": "CLOSED_NO_PAYMENT", "n_reopens": "REOPENED"}
_PAYS = "(event_type = 'PAYMENT_POSTED' AND coalesce(amount, 0) > 0)"
_OUT = f"({_PAYS} OR event_type = 'CLOSED_NO_PAYMENT')"
_SNAP = (
    f"""ow AS (SELECT concat_ws('|', org_token, source_system, bill_id) AS owner, any_value(org_token) AS org_token, min(nullif(payer_token, '')) AS payer, count(DISTINCT record_id) AS n_versions FROM bills GROUP BY 1),
f AS (SELECT owner, min(at_us) + {7 * _D} AS t_us FROM tm WHERE event_type = 'SUBMITTED' GROUP BY 1),
s0 AS (SELECT owner, t_us, max(at_us) FILTER (at_us <= t_us) AS max_input_us, count(*) FILTER (at_us <= t_us AND {_OUT}) AS decided,
  min((at_us, CASE WHEN {_PAYS} THEN 0 ELSE 1 END, event_id)) FILTER (at_us > t_us AND at_us < t_us + {30 * _D} AND {_OUT}) AS first, """
    + ", ".join(f"count(*) FILTER (at_us <= t_us AND event_type = '{k}') AS {n}" for n, k in _KINDS.items())
    + f""" FROM tm JOIN f USING (owner) GROUP BY 1, 2),
s AS (SELECT owner, t_us, max_input_us, {', '.join(_KINDS)}, {_CAT} AS payer_category, n_versions,
  CASE WHEN first[2] = 0 THEN 'payment' WHEN first[2] = 1 THEN 'close_no_payment' WHEN coverage_end_us >= t_us + {30 * _D} THEN 'still_open' ELSE 'censored' END AS outcome,
  CASE WHEN first IS NOT NULL THEN least(greatest((first[1] - t_us) // {5 * _D}, 0), 5)::INT END AS outcome_interval FROM s0 JOIN ow USING (owner) LEFT JOIN cov USING (org_token) WHERE decided = 0)"""
)
_SNAPS = f"WITH {_E}, {_A}, {_W}, {_COV}, {_OWNER}, {_TIMED}, {_SNAP}"
_IV = "iv AS (SELECT s.*, unnest(range(coalesce(outcome_interval, 5) + 1))::INT AS interval FROM s WHERE outcome <> 'censored'), ivl AS (SELECT *, CASE WHEN interval = outcome_interval THEN outcome ELSE 'none' END AS label FROM iv)"
_SPLIT = "rk AS (SELECT owner, row_number() OVER (ORDER BY t_us, owner) - 1 AS r, count(*) OVER () AS n FROM s), sp AS (SELECT owner, CASE WHEN r < floor(n * 0.6::DOUBLE) THEN 'train' WHEN r < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'middle' ELSE 'test' END AS part FROM rk)"
_TRUTH = "tr AS (SELECT DISTINCT * FROM (SELECT record_id AS left_id, lead(record_id) OVER (PARTITION BY org_token, bill_id ORDER BY coalesce(" + _NUM + ", 0), record_id) AS right_id FROM b) WHERE right_id IS NOT NULL)"


def _agree(proposed: str) -> str:
    return f"""pr AS (SELECT DISTINCT left_id, right_id FROM ({proposed}) WHERE right_id IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM pr) AS n_proposed, (SELECT count(*) FROM tr) AS n_truth, (SELECT count(*) FROM pr JOIN tr USING (left_id, right_id)) AS n_hit)
SELECT *, CASE WHEN n_proposed > 0 THEN n_hit * 1000000 // n_proposed END AS precision_millionths, CASE WHEN n_truth > 0 THEN n_hit * 1000000 // n_truth END AS recall_millionths FROM c"""


_ID = "coalesce(NOT regexp_full_match({c}, '[A-Za-z0-9._-]{{1,128}}'), true)"


def _found(checked: str, table: str, rules: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{checked}' AS checked, '{f}' AS field, '{p}' AS problem, '{s}' AS severity, count(*) AS n FROM {table} WHERE {c} HAVING count(*) > 0" for f, p, s, c in rules)


def _bad_id(c: str) -> tuple[str, str, str, str]:
    return c, "bad identifier", "ERROR", _ID.format(c=c)


def _bad_time(c: str) -> tuple[str, str, str, str]:
    return c, "not ISO-8601 with offset", "ERROR", f"coalesce(NOT regexp_full_match({c}, '{_PATTERN}'), true)"


def _bad_stamp(c: str) -> tuple[str, str, str, str]:
    return c, "not ISO-8601 with offset", "ERROR", f"{c} IS NULL"


def _few(c: str, least: int) -> tuple[str, str, str, str]:
    return c, f"not a whole number of at least {least}", "ERROR", f"coalesce(({_long(c)}) < {least}, true)"


_ORG = ("org_token", "unknown organisation", "ERROR", "coalesce(org_token NOT IN ('CPL', 'TRI', 'NDX'), true)")
_USD = ("currency", "not USD", "ERROR", "coalesce(currency <> 'USD', true)")
_TYPES = "'SUBMITTED', 'CORRECTED', 'PAYMENT_POSTED', 'PAYMENT_REVERSED', 'VOID_VERSION', 'CLOSED_NO_PAYMENT', 'REOPENED', 'ADJUSTMENT', 'STATUS_UPDATED', 'UNKNOWN'"
_FINDINGS = " UNION ALL ".join((
    _found("bills", "nb0", [_bad_id("record_id"), _ORG, _bad_id("bill_id"), _bad_id("version_id"), ("payer_token", "unknown payer", "ERROR", "coalesce(payer_token, '') NOT IN ('AET', 'UHC', 'HUM', 'BCB', 'CIG', 'MCR', 'MCD', 'SELF', '')"),
        _few("billed_amount_minor", 1), _USD, _bad_time("submitted_at"), _bad_stamp("available_at"), ("available_at", "known before it was submitted", "WARNING", "available_us < submitted_us")]),
    _found("events", "billing_events", [_bad_id("event_id"), _ORG, ("event_type", "unknown type", "ERROR", f"coalesce(event_type NOT IN ({_TYPES}), true)"), ("event_type", "unmapped code", "WARNING", "event_type = 'UNKNOWN'"), _bad_time("event_at"), _bad_stamp("available_at"),
        ("amount_minor", "not a whole number of at least 0", "ERROR", "amount_minor < 0"), ("currency", "amount without currency", "ERROR", "amount_minor IS NOT NULL AND coalesce(currency, '') = ''"),
        ("reverses_event_id", "bad identifier", "ERROR", "coalesce(reverses_event_id, '') <> '' AND NOT regexp_full_match(reverses_event_id, '[A-Za-z0-9._-]{1,128}')"), ("terminal_flag", "not a boolean", "ERROR", "coalesce(terminal_flag NOT IN ('true', 'false', 'True', 'False'), true)")]),
    _found("allocations", "allocations", [_bad_id("allocation_id"), _bad_id("payment_event_id"), _bad_id("bill_record_id"), _few("allocated_amount_minor", 1), _USD, _bad_stamp("available_at")]),
    _found("windows", f"({_NW} observation_windows)", [_bad_id("window_id"), _ORG, _bad_time("coverage_start"), _bad_stamp("coverage_end"), _bad_stamp("extracted_at"), ("coverage_end", "ends before it starts", "ERROR", "coalesce(end_us < start_us, true)"),
        ("coverage_status", "unknown status", "ERROR", "coalesce(coverage_status NOT IN ('complete', 'partial', 'unknown'), true)")]),
))

_LINEAGES = f"""{_LINKS}, {_ROOTS}, {_E}, {_W}, {_COV},
m AS (SELECT b.*, root FROM b JOIN rt ON rt.id = b.record_id),
li AS (SELECT root AS root_id, array_to_string(list(DISTINCT record_id ORDER BY record_id), '|') AS record_ids, min(org_token) AS org_token, min(nullif(payer_token, '')) AS payer, arg_max(amount, (submitted_us, -available_us, amount)) AS amount FROM m GROUP BY 1),
cz AS (SELECT DISTINCT root FROM e JOIN rt ON rt.id = e.bill_record_id WHERE event_type = 'CLOSED_NO_PAYMENT'),
ls AS (SELECT 'run-' || substr(root_id, 1, 8) || '-' || root_id AS lineage_id, root_id, record_ids, org_token, CASE WHEN root_id IN (SELECT root FROM cz) THEN 'CLOSED_NO_PAYMENT' ELSE 'OPEN' END AS status, {_CAT} AS payer_category, amount,
  CASE WHEN coverage_end_us IS NOT NULL THEN 'complete' ELSE 'unknown' END AS coverage_status, coverage_end_us FROM li LEFT JOIN cov USING (org_token))"""
_MONEY = f"{_LINKS}, {_ROOTS}, {_P}, {_A}, {_OWNED}, {_PAY}, {_OVER}, {_PARTS}, {_BACK}"
_LINK_NOTES = """lc AS (SELECT CASE WHEN same THEN 'DUPLICATE_IMPORT' ELSE 'CONFLICTING_DUPLICATE_KEY' END AS kind, concat_ws('|', first_id, record_id) AS record_ids FROM jb WHERE rn > 1
  UNION SELECT verdict, left_id || '|' || right_id FROM v WHERE verdict IN ('CROSS_ORG_REFERENCE', 'CYCLE_REFERENCE')
  UNION SELECT 'TIME_ORDER_VIOLATION', left_id || '|' || right_id FROM v WHERE verdict = 'accepted' AND is_late_parent
  UNION SELECT 'MULTIPLE_SUCCESSOR', left_id FROM v WHERE verdict = 'accepted' GROUP BY left_id HAVING count(*) > 1)"""
_REVIEWS = """rq AS (SELECT 'CONFLICTING_DUPLICATE_KEY' AS kind, concat_ws('|', first_id, record_id) AS record_ids FROM jb WHERE rn > 1 AND NOT same
  UNION SELECT verdict, left_id || '|' || right_id FROM v WHERE verdict = 'DANGLING_REFERENCE'
  UNION SELECT 'AMBIGUOUS_VERSION_SET', record_id FROM g2 WHERE amb AND size > 1
  UNION SELECT 'MULTI_CANDIDATE_AMBIGUITY', left_id || '|' || right_id FROM r3 WHERE (left_id, right_id) NOT IN (SELECT (left_id, right_id) FROM u3))"""
_TOUCH = "(SELECT root, count(DISTINCT note) AS n FROM (SELECT kind || ':' || record_ids AS note, unnest(string_split(record_ids, '|')) AS id FROM {t}) JOIN rt USING (id) GROUP BY 1)"

SQL = {
    "normalize_bills": f"WITH {_NB} SELECT record_id, submitted_us, amount, is_valid FROM nb",
    "normalize_events": f"SELECT delivery_id, event_us, amount, {_VALID_E} AS is_valid FROM ({_NE0} billing_events)",
    "normalize_allocations": f"SELECT allocation_id, amount, {_VALID_A} AS is_valid FROM ({_NA} allocations)",
    "normalize_windows": f"SELECT window_id, start_us, end_us, {_VALID_W} AS is_valid FROM ({_NW} observation_windows)",
    "validation_findings": f"WITH {_NB} {_FINDINGS}",
    "extra_payers": "SELECT DISTINCT payer_token AS token FROM bills WHERE payer_token NOT IN ('', 'AET', 'UHC')",
    "asof_counts": f"WITH {_NB} SELECT 'bills' AS counted, count(*) AS n FROM nb WHERE is_valid AND available_us <= {_AS_OF} UNION ALL SELECT 'events', count(*) FROM ({_NE0} billing_events) WHERE {_VALID_E} AND available_us <= {_AS_OF} UNION ALL SELECT 'allocations', count(*) FROM ({_NA} allocations) WHERE {_VALID_A} AND available_us <= {_AS_OF}",
    "duplicate_bills": f"WITH {_BASE} SELECT record_id, first_id, CASE WHEN same THEN 'DUPLICATE_IMPORT' ELSE 'CONFLICTING_DUPLICATE_KEY' END AS verdict FROM jb WHERE rn > 1",
    "duplicate_events": f"WITH {_E}, j AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY org_token, source_system, bill_record_id, event_type, event_us, amount, currency ORDER BY available_us, event_id) AS first_id FROM e) SELECT * FROM j WHERE event_id <> first_id",
    "r1_links": f"WITH {_BASE}, {_R1} SELECT * FROM r1",
    "r2_links": f"WITH {_BASE}, {_R2} SELECT * FROM r2 WHERE right_id IS NOT NULL",
    "r2_ambiguous": f"WITH {_BASE}, {_G2} SELECT record_id FROM g2 WHERE amb AND size > 1",
    "r3_candidates": f"WITH {_BASE}, {_R3} SELECT * FROM r3",
    "r3_unique": f"WITH {_BASE}, {_R3}, {_DEG} SELECT * FROM u3",
    "link_verdicts": f"{_LINKS} SELECT * FROM v",
    "several_successors": f"{_LINKS} SELECT left_id, count(*) AS n_successors FROM v WHERE verdict = 'accepted' GROUP BY 1 HAVING count(*) > 1",
    "lineage_roots": f"{_LINKS}, {_ROOTS} SELECT id AS record_id, root AS root_id FROM rt",
    "lineage_summary": f"{_LINEAGES} SELECT * FROM ls",
    "lineage_bridge": f"{_LINEAGES} SELECT DISTINCT lineage_id, m.record_id FROM ls JOIN m ON m.root = ls.root_id",
    "lineage_amounts": f"{_MONEY} SELECT owner, coalesce(gross, 0) AS gross, coalesce(reversed, 0) AS reversed, coalesce(net, 0) AS net, coalesce(unallocated, 0) AS unallocated FROM am FULL JOIN (SELECT DISTINCT root AS owner FROM rt) USING (owner)",
    "lineage_status": f"""{_MONEY}, cz AS (SELECT DISTINCT root FROM ({_NE0} {_ONCE}) x JOIN rt ON rt.id = x.bill_record_id WHERE {_VALID_E} AND event_type = 'CLOSED_NO_PAYMENT'), st AS (SELECT DISTINCT root AS root_id, root IN (SELECT root FROM cz) AS closed FROM rt)
      SELECT root_id, CASE WHEN coalesce(gross, 0) > 0 THEN CASE WHEN closed THEN 'REOPENED_OR_POST_CLOSE_PAYMENT' ELSE 'PAYMENT_OBSERVED' END WHEN closed THEN 'CLOSED_NO_PAYMENT' ELSE 'OPEN' END AS status FROM st LEFT JOIN am ON am.owner = root_id""",
    "conflicts": f"""{_LINKS}, {_LINK_NOTES}, {_P}, {_A}, {_PAY}, {_OVER} SELECT kind AS conflict_type, record_ids FROM lc
      UNION SELECT 'NON_USD_EVENT', event_id FROM e WHERE coalesce(currency, '') NOT IN ('', 'USD') UNION SELECT 'NON_USD_ALLOCATION', allocation_id FROM a WHERE coalesce(currency, '') <> 'USD' UNION SELECT 'OVER_ALLOCATION', event_id FROM ov
      UNION SELECT 'UNRESOLVED_REVERSAL', event_id FROM e WHERE event_type = 'PAYMENT_REVERSED' AND coalesce(currency, '') IN ('', 'USD') AND trim(coalesce(reverses_event_id, '')) = ''""",
    "review_queue": f"{_LINKS}, {_REVIEWS} SELECT kind AS review_type, record_ids FROM rq",
    "lineage_notes": f"{_LINKS}, {_ROOTS}, {_LINK_NOTES}, {_REVIEWS} SELECT root AS root_id, coalesce(x.n, 0) AS n_conflicts, coalesce(y.n, 0) AS n_reviews FROM {_TOUCH.format(t='lc')} x FULL JOIN {_TOUCH.format(t='rq')} y USING (root)",
    "amounts_by_bill": f"WITH RECURSIVE {_P}, {_A}, {_OWNER}, {_PAY}, {_OVER}, {_PARTS}, {_BACK} SELECT * FROM am",
    "coverage": f"WITH {_W}, {_COV} SELECT * FROM cov",
    "over_allocation": f"WITH {_P}, {_A}, {_PAY}, {_OVER} SELECT * FROM ov",
    "posted_by_bill": f"WITH {_P}, {_A}, {_OWNER}, {_PAY}, {_OVER}, {_PARTS} SELECT owner, sum(amount)::BIGINT AS gross, sum(unallocated)::BIGINT AS unallocated FROM parts GROUP BY 1",
    "reversal_cap": f"""WITH {_P}, {_PAY}, r AS (SELECT e.event_id AS reversal_id, trim(reverses_event_id) AS event_id, coalesce(amount, 0) AS amount, available_us FROM e WHERE event_type = 'PAYMENT_REVERSED' AND coalesce(currency, '') IN ('', 'USD') AND trim(coalesce(reverses_event_id, '')) <> ''),
      c AS (SELECT reversal_id, event_id, r.amount, pay.amount AS whole, sum(r.amount) OVER (PARTITION BY event_id ORDER BY available_us, reversal_id ROWS UNBOUNDED PRECEDING) AS total FROM r JOIN pay USING (event_id))
      SELECT reversal_id, event_id, (least(total, whole) - least(total - amount, whole))::BIGINT AS taken FROM c""",
    "unresolved_reversals": f"WITH {_P} SELECT DISTINCT event_id FROM e WHERE event_type = 'PAYMENT_REVERSED' AND coalesce(currency, '') IN ('', 'USD') AND trim(coalesce(reverses_event_id, '')) = ''",
    "effective_times": f"WITH {_E}, {_A}, {_OWNER}, {_TIMED} SELECT owner, event_id, at_us FROM tm",
    "landmark_snapshots": f"{_SNAPS} SELECT * FROM s",
    "outcome_histogram": f"{_SNAPS} SELECT outcome, count(*) AS n FROM s GROUP BY 1",
    "interval_rows": f"{_SNAPS}, {_IV} SELECT owner, interval, label FROM ivl",
    "temporal_split": f"{_SNAPS}, {_SPLIT} SELECT owner, part FROM sp",
    "b0_rates": f"{_SNAPS}, {_IV}, {_SPLIT} SELECT payer_category, 'under_15' AS age, count(*) AS support, count(*) FILTER (label = 'payment') AS n_payment, count(*) FILTER (label = 'close_no_payment') AS n_close FROM ivl JOIN sp USING (owner) WHERE part = 'train' GROUP BY 1",
    "b0_scores": f"""{_SNAPS}, {_IV}, {_SPLIT}, x AS (SELECT * FROM ivl JOIN sp USING (owner)),
      r AS (SELECT payer_category, count(*) AS n, count(*) FILTER (label = 'payment') / count(*) AS p1, count(*) FILTER (label = 'close_no_payment') / count(*) AS p2 FROM x WHERE part = 'train' GROUP BY 1 HAVING count(*) >= 5),
      y AS (SELECT label, p1, p2, 1 - p1 - p2 AS p0 FROM x LEFT JOIN r USING (payer_category) WHERE part = 'test')
      SELECT count(p1) AS n, count(*) - count(p1) AS n_abstained, floor(avg(-ln(greatest(CASE label WHEN 'payment' THEN p1 WHEN 'close_no_payment' THEN p2 ELSE p0 END, 1e-12))) * 1000000 + 0.5)::BIGINT AS log_loss_millionths,
        floor(avg((p1 - (label = 'payment')::INT) ** 2 + (p2 - (label = 'close_no_payment')::INT) ** 2 + (p0 - (label = 'none')::INT) ** 2) * 1000000 + 0.5)::BIGINT AS brier_millionths FROM y""",
    "linkage_agreement": f"WITH {_BASE}, {_R1}, {_R2}, {_TRUTH}, {_agree('SELECT * FROM r1 UNION ALL SELECT * FROM r2')}",
    "a0_agreement": f"WITH {_BASE}, {_TRUTH}, {_agree('SELECT record_id AS left_id, lead(record_id) OVER (PARTITION BY org_token ORDER BY submitted_us, record_id) AS right_id FROM b')}",
    "exact_id_agreement": f"WITH {_BASE}, {_R1}, {_TRUTH}, {_agree('SELECT * FROM r1')}",
    "bi_measures": """WITH x AS (SELECT org_token, count(*) AS n_rows, count(DISTINCT record_id) AS n_records, sum(CASE WHEN regexp_full_match(billed_amount_minor, '[0-9]{1,18}') THEN billed_amount_minor::BIGINT WHEN billed_amount_minor IS NOT NULL THEN 0 END)::BIGINT AS billed FROM bills GROUP BY 1),
      y AS (SELECT o AS org_token, count(*) AS n_links, count(*) FILTER (lower(trim(decision)) = 'review') AS n_review FROM links JOIN (SELECT record_id, min(org_token) AS o FROM bills GROUP BY 1) ON record_id = left_record_id GROUP BY 1)
      SELECT x.*, n_links, n_review, n_review * 1000000 // n_links AS review_per_million FROM x LEFT JOIN y USING (org_token)""",
}
