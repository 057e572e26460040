"""Store, extraction and vote queries that both engines run as SQL. Each is a function of the dialect."""

from __future__ import annotations

from credenza.plans.dialect import Spark
from credenza.plans.standins import STANDINS

BASE = {"orders", "customer", "lineitem", "events", "documents", "labels", "embeddings", "pages", "conversations", "benchmark", "nation", "region", "part", "supplier"}


def t(name: str) -> str:
    return f"({STANDINS[name]})"


def audit_timeline(d: Spark) -> str:
    """Screening events and successful logins of active users in one timeline, newest first."""
    return f"""SELECT s.log_id, s.event_at, s.source, s.status, u.full_name FROM (
        SELECT id AS log_id, created_at AS event_at, owner, 'AUDIT' AS source, CASE WHEN risk_score >= 50 THEN 'REJECTED' ELSE 'STORED' END AS status FROM {t("docs")} d
        UNION ALL SELECT id AS log_id, event_at, user_id AS owner, 'AUTH' AS source, 'SUCCESS' AS status FROM {t("logins")} l WHERE success) s
        JOIN {t("users")} u ON u.unique_id = s.owner ORDER BY s.event_at DESC, s.log_id DESC, s.source"""


def account_history_summary(d: Spark) -> str:
    return f"""SELECT u.unique_id, coalesce(nullif(x.n_numbers, 0), x.n_rows, 0) AS n_documents, coalesce(l.n_logins, 0) AS n_logins, l.last_login
        FROM {t("users")} u LEFT JOIN (SELECT owner, count(DISTINCT number_key) AS n_numbers, count(*) AS n_rows FROM {t("docs")} d GROUP BY owner) x ON x.owner = u.unique_id
        LEFT JOIN (SELECT user_id, count(*) AS n_logins, max(event_at) AS last_login FROM {t("logins")} g WHERE success GROUP BY user_id) l ON l.user_id = u.unique_id"""


def doc_search(d: Spark) -> str:
    q = "'urg1'"
    hit = " OR ".join(f"contains(lower(coalesce({c}, '')), {q})" for c in ("full_name", "id_type", "document_number", "number_key"))
    return f"SELECT id, owner, id_type, number_key, full_name FROM {t('docs')} d WHERE {hit} ORDER BY id DESC LIMIT 30"


def key_lookup(d: Spark) -> str:
    return f"SELECT unique_id, full_name, lower(trim(email)) AS email, status FROM {t('users')} u WHERE unique_id IN (7, 42, 100) AND email_verified"


def number_lookup(d: Spark) -> str:
    return f"SELECT id, owner, id_type, number_key FROM {t('docs')} d WHERE id_type = 'PASSPORT' AND number_key LIKE 'HIG%'"


def login_throttle(d: Spark) -> str:
    """Failures in the trailing window at each failed login; a demonstration span, as events are sparse per user."""
    return f"""SELECT id, user_id, event_at, n_15m, n_3d, n_3d >= 5 AS throttled FROM (SELECT id, user_id, event_at,
        count(*) OVER (PARTITION BY user_id ORDER BY event_at RANGE BETWEEN {d.minutes(15)} PRECEDING AND CURRENT ROW) AS n_15m,
        count(*) OVER (PARTITION BY user_id ORDER BY event_at RANGE BETWEEN {d.minutes(4320)} PRECEDING AND CURRENT ROW) AS n_3d
        FROM {t("logins")} l WHERE NOT success) w"""


def recent_failures(d: Spark) -> str:
    return f"SELECT user_id, count_if(NOT success) AS failures FROM {t('logins')} l WHERE event_at >= (SELECT max(event_at) FROM {t('logins')} m) - {d.minutes(4320)} GROUP BY user_id"


def latest_otp(d: Spark) -> str:
    return f"SELECT email, purpose, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY email, purpose ORDER BY id DESC) AS n FROM {t('codes')} c WHERE used_at IS NULL) x WHERE n = 1"


def otp_validity(d: Spark) -> str:
    return f"SELECT id, created_at + {d.minutes(10)} AS expires_at, created_at + {d.minutes(10)} >= TIMESTAMP '2024-01-15 00:00:00' AND used_at IS NULL AS usable FROM {t('codes')} c"


def user_documents(d: Spark) -> str:
    return f"SELECT id AS document_id, owner AS unique_id, id_type, full_name, coalesce(reverification_count, 0) AS reverification_count, CAST(risk_score AS STRING) AS risk_text FROM {t('docs')} d"


def captures(d: Spark) -> str:
    return f"SELECT id, unique_id, captured_at FROM (SELECT event_id AS id, user_id AS unique_id, ts AS captured_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click') x WHERE n <= 20"


def auth_user(d: Spark) -> str:
    return f"SELECT unique_id, full_name, lower(trim(email)) AS email, status, 'user' AS role FROM {t('users')} u"


def audit_details(d: Spark) -> str:
    return f"SELECT e.event_id AS log_id, {d.json('e.props', 'k')} AS k, coalesce({d.json('e.props', 'missing')}, {d.json('e.props', 'k')}, '') AS either, u.full_name FROM events e LEFT JOIN {t('users')} u ON u.unique_id = e.user_id"


def key_humanised(d: Spark) -> str:
    key = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'finalStatus' WHEN 1 THEN 'risk_score' WHEN 2 THEN 'documentNumber_masked' ELSE event_type END"
    inner = f"regexp_replace({key}, '([a-z0-9])([A-Z])', '$1 $2')" if d.name == "spark" else f"regexp_replace({key}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"SELECT event_id, replace({inner}, '_', ' ') AS label FROM events"


def alias_copy(d: Spark) -> str:
    return f"""SELECT id, coalesce(document_number, pan_number) AS document_number, coalesce(father_name, CASE WHEN id_type IN ('PAN', 'AADHAAR') THEN relation_name END) AS father_name FROM (
        SELECT id, id_type, CASE WHEN id % 3 = 0 THEN number_key END AS document_number, CASE WHEN id_type = 'PAN' THEN number_key END AS pan_number,
        CASE WHEN id % 5 = 0 THEN full_name END AS father_name, 'Relation ' || CAST(id % 11 AS STRING) AS relation_name FROM {t("docs")} d) x"""


FIELDS = "(SELECT 'PAN' AS family, 'name' AS field UNION ALL SELECT 'PAN', 'document_number' UNION ALL SELECT 'PASSPORT', 'name' UNION ALL SELECT 'PASSPORT', 'document_number' UNION ALL SELECT 'PASSPORT', 'nationality' UNION ALL SELECT 'COLLEGE_ID', 'name' UNION ALL SELECT 'COLLEGE_ID', 'course')"
LONG = "(SELECT id, id_type, 'name' AS field, full_name AS value, CAST(risk_score AS DOUBLE) AS conf FROM {docs} a UNION ALL SELECT id, id_type, 'document_number', number_key, CAST(risk_score * 7 % 100 AS DOUBLE) FROM {docs} b UNION ALL SELECT id, id_type, 'gender', CASE WHEN id % 2 = 0 THEN 'FEMALE' END, 50e0 FROM {docs} c)"


def fields_long() -> str:
    return LONG.replace("{docs}", t("docs"))


def field_allow_list(d: Spark) -> str:
    return f"SELECT v.id, v.field, v.value FROM {fields_long()} v LEFT SEMI JOIN {FIELDS} f ON v.id_type = f.family AND v.field = f.field WHERE v.value IS NOT NULL" if d.name == "spark" else f"SELECT v.id, v.field, v.value FROM {fields_long()} v SEMI JOIN {FIELDS} f ON v.id_type = f.family AND v.field = f.field WHERE v.value IS NOT NULL"


def missing_fields(d: Spark) -> str:
    return f"SELECT x.id, f.field FROM {t('docs')} x JOIN {FIELDS} f ON x.id_type = f.family WHERE NOT EXISTS (SELECT 1 FROM {fields_long()} v WHERE v.id = x.id AND v.field = f.field AND v.value IS NOT NULL)"


def merge_first_wins(d: Spark) -> str:
    return f"SELECT id, field, {d.argmin('value', 'priority')} AS first_value, {d.argmax('value', 'priority')} AS last_value FROM (SELECT id, field, value, 1 AS priority FROM {fields_long()} v WHERE conf >= 40 AND value IS NOT NULL UNION ALL SELECT id, field, lower(value), 2 FROM {fields_long()} w WHERE value IS NOT NULL) x GROUP BY id, field"


def module_completion(d: Spark) -> str:
    return f"""SELECT doc_id, module, status FROM (SELECT doc_id, status AS module, max(severity) AS status FROM {t("signals")} s GROUP BY doc_id, status) m WHERE status <> 'LOW'
        UNION ALL SELECT DISTINCT s.doc_id, x.module, 'UNAVAILABLE' FROM {t("signals")} s CROSS JOIN (SELECT 'FAIL' AS module UNION ALL SELECT 'OCR') x
        WHERE NOT EXISTS (SELECT 1 FROM {t("signals")} z WHERE z.doc_id = s.doc_id AND z.status = x.module)"""


def comparison_source(d: Spark) -> str:
    return f"SELECT doc_id, seq, status, 'reference' AS source FROM {t('signals')} s WHERE doc_id % 2 = 0 AND status IN ('FAIL') UNION ALL SELECT doc_id, seq, severity, 'identity' FROM {t('signals')} z WHERE doc_id % 2 = 1 AND severity NOT IN ('LOW')"


def duplicate_decision(d: Spark) -> str:
    return f"""SELECT n.id, CASE WHEN o.first_id IS NULL OR o.first_id = n.id THEN 'NEW' WHEN o.first_owner <> n.owner THEN 'CONFLICT_OTHER_OWNER' WHEN coalesce(n.reverification_count, 0) >= 2 THEN 'REVERIFY_LIMIT' ELSE 'REVERIFY' END AS decision
        FROM {t("docs")} n LEFT JOIN (SELECT number_key, min(id) AS first_id, {d.argmin("owner", "id")} AS first_owner FROM {t("docs")} d GROUP BY number_key) o ON o.number_key = n.number_key"""


def same_name_document(d: Spark) -> str:
    return f"SELECT owner, id_type, name_key, id FROM (SELECT owner, id_type, upper({d.sub('full_name', '[^A-Za-z0-9]', '')}) AS name_key, id, row_number() OVER (PARTITION BY owner, id_type, upper({d.sub('full_name', '[^A-Za-z0-9]', '')}) ORDER BY id DESC) AS n FROM {t('docs')} d) x WHERE n = 1"


def password_policy(d: Spark) -> str:
    p = "substr(p_name || '@A1', 1, CAST(6 + p_partkey % 6 AS INT))"
    return f"SELECT p_partkey, length(p) BETWEEN 8 AND 10 AND {d.match('p', '^[A-Za-z0-9@]+$')} AND {d.match('p', '[A-Z]')} AND {d.match('p', '[a-z]')} AND {d.match('p', '[0-9]')} AND contains(p, '@') AS ok FROM (SELECT p_partkey, replace({p}, ' ', '@A1') AS p FROM part) x"


def account_shape(d: Spark) -> str:
    a = "CASE WHEN unique_id % 3 = 0 THEN lower(trim(email)) WHEN unique_id % 3 = 1 THEN lpad(CAST(unique_id AS STRING), 10, '1') ELSE CAST(unique_id AS STRING) END"
    return f"SELECT unique_id, {d.match(a, '^([0-9]{10}|[^@ ]+@[^@ ]+[.][^@ ]+)$')} AS ok FROM {t('users')} u"


def line_concat(d: Spark) -> str:
    return f"SELECT doc_id, CAST(l_suppkey % 3 AS BIGINT) AS block, {d.listed('CAST(l_partkey AS STRING)', 'seq', ' ')} AS text, count(*) AS n FROM {t('signals')} s GROUP BY doc_id, CAST(l_suppkey % 3 AS BIGINT)"


def token_dedup(d: Spark) -> str:
    key = f"text, CAST({d.half_even('x / 24e0')} AS BIGINT), CAST({d.half_even('y / 24e0')} AS BIGINT)"
    return f"SELECT doc_id, box_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY conf DESC, box_id) AS n FROM {t('boxes')} b) z WHERE n = 1"


def label_lookahead(d: Spark) -> str:
    """Label lines (short ones) to the next line that is not blank among four, unless that is another label."""
    ahead = ", ".join(f"nullif(trim(lead(line, {i}) OVER w), '')" for i in range(1, 5))
    return f"""SELECT doc_id, pos, value FROM (SELECT doc_id, pos, line, coalesce({ahead}) AS value FROM {d.lines("documents", "doc_id")} l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) x
        WHERE length(trim(line)) BETWEEN 1 AND 39 AND length(value) >= 40"""


def address_block(d: Spark) -> str:
    """The lines of a text up to the first short one after its first, joined."""
    lines = d.lines("documents", "doc_id")
    return f"""SELECT doc_id, {d.listed("line", "pos", ", ")} AS block, count(*) AS n_lines FROM (SELECT *, max(CASE WHEN length(line) < 30 AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stopped FROM {lines} l) x
        WHERE stopped = 0 AND pos < 6 GROUP BY doc_id"""


def line_table(d: Spark) -> str:
    return f"SELECT doc_id, pos, trim({d.sub('line', '[ \t]+', ' ')}) AS line FROM {d.lines('documents', 'doc_id')} l WHERE trim(line) <> ''"


def neighbour_lines(d: Spark) -> str:
    return f"SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations"


def label_value_spatial(d: Spark) -> str:
    return f"""SELECT doc_id, label, value FROM (SELECT a.doc_id, a.box_id AS label, b.box_id AS value, row_number() OVER (PARTITION BY a.doc_id, a.box_id ORDER BY b.x, b.y, b.box_id) AS n
        FROM {t("boxes")} a JOIN {t("boxes")} b ON a.doc_id = b.doc_id AND a.box_id <> b.box_id AND b.x > a.x + a.w + 35 AND abs(b.y + b.h / 2e0 - a.y - a.h / 2e0) <= greatest(18e0, 0.95e0 * a.h) AND b.x <= 0.94e0 * 420) z WHERE n <= 8"""


INTER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def box_overlap(d: Spark) -> str:
    return f"SELECT a.doc_id, a.box_id AS first_box, b.box_id AS second_box, {INTER} / CAST(greatest(1, a.w * a.h + b.w * b.h - {INTER}) AS DOUBLE) AS iou FROM {t('boxes')} a JOIN {t('boxes')} b ON a.doc_id = b.doc_id AND a.box_id < b.box_id WHERE {INTER} > 0"


def text_coverage(d: Spark) -> str:
    return f"SELECT a.doc_id, a.box_id, CAST(sum({INTER}) AS BIGINT) AS covered, count_if(length(b.text) >= 4) AS digit_tokens FROM {t('boxes')} a JOIN {t('boxes')} b ON a.doc_id = b.doc_id AND a.box_id <> b.box_id AND {INTER} > 0 GROUP BY a.doc_id, a.box_id"


def adjacent_boxes(d: Spark) -> str:
    # Nulls come last in DuckDB's order.
    order = "y NULLS LAST, x NULLS LAST, box_id NULLS LAST" if d.name == "spark" else "y, x, box_id"
    return f"""SELECT doc_id, n_overlaps, n_overlaps >= 4 AS issue FROM (SELECT doc_id, count_if(coalesce(y < last_y + last_h AND x < last_x + last_w, false)) AS n_overlaps FROM (SELECT *, lag(x) OVER w AS last_x, lag(y) OVER w AS last_y, lag(w) OVER w AS last_w, lag(h) OVER w AS last_h
        FROM {t("boxes")} b WINDOW w AS (PARTITION BY doc_id ORDER BY {order})) z GROUP BY doc_id) q"""


def knn_ratio_test(d: Spark) -> str:
    """For the vectors whose id is divisible by 100, the two nearest of all others; kept if the first is clearly nearer."""
    dist = d.sum_product("a.embedding", "b.embedding")
    return f"""SELECT q AS vec_id, max(CASE WHEN n = 1 THEN other END) AS nearest, max(CASE WHEN n = 1 THEN c END) > max(CASE WHEN n = 2 THEN c END) * 1.02e0 AS kept FROM (
        SELECT a.vec_id AS q, b.vec_id AS other, {dist} AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist} DESC, b.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) x WHERE n <= 2 GROUP BY q"""


def consensus_exact(d: Spark) -> str:
    return f"SELECT doc_id, value, n, best_conf, n >= 2 AS quorum FROM (SELECT doc_id, CAST(l_suppkey % 3 AS BIGINT) AS value, count(*) AS n, max(conf) AS best_conf, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, max(conf) DESC, min(seq), CAST(l_suppkey % 3 AS BIGINT)) AS k FROM {t('signals')} s GROUP BY doc_id, CAST(l_suppkey % 3 AS BIGINT)) x WHERE k = 1"


def page_consensus(d: Spark) -> str:
    return f"SELECT doc_id, severity, {d.listed('CAST(page AS STRING)', 'page', ',')} AS pages FROM (SELECT DISTINCT doc_id, severity, CAST(seq % 3 AS BIGINT) AS page FROM {t('signals')} s) x GROUP BY doc_id, severity"


def robust_stats(d: Spark) -> str:
    return f"""SELECT l_suppkey, m, 1.4826e0 * {d.percentile("abs(v - m)", 0.5)} AS mad, count_if(abs(v - m) > 3.5e0 * greatest(1.4826e0 * k, 1e-6)) AS outliers, max(abs(v - m)) AS worst FROM (
        SELECT l_suppkey, v, m, {d.percentile("abs(v - m)", 0.5)} OVER (PARTITION BY l_suppkey) AS k FROM (SELECT l_suppkey, l_quantity AS v, {d.percentile("l_quantity", 0.5)} OVER (PARTITION BY l_suppkey) AS m FROM lineitem) a) b GROUP BY l_suppkey, m, k"""


def variation(d: Spark) -> str:
    return "SELECT l_suppkey, CASE WHEN count(*) >= 4 THEN stddev_pop(l_quantity) / greatest(abs(avg(l_quantity)), 0.1e0) ELSE 0e0 END AS cv FROM lineitem GROUP BY l_suppkey"


def block_peak(d: Spark) -> str:
    return f"""SELECT l_suppkey, CAST(floor(CASE WHEN max(abs(v - m)) > 3 * 1.4826e0 * {d.percentile("abs(v - m)", 0.5)} THEN max(v) ELSE {d.percentile("v", 0.95)} END) AS BIGINT) AS peak FROM (SELECT l_suppkey, l_extendedprice AS v, {d.percentile("l_extendedprice", 0.5)} OVER (PARTITION BY l_suppkey) AS m FROM lineitem) a GROUP BY l_suppkey, m"""


def gap_variation(d: Spark) -> str:
    return f"SELECT doc_id, count(*) AS gaps, stddev_pop(gap) / greatest(abs(avg(gap)), 0.1e0) AS cv FROM (SELECT doc_id, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, box_id) AS gap FROM {t('boxes')} b) g WHERE gap > 2 GROUP BY doc_id"


def frame_motion(d: Spark) -> str:
    return f"""SELECT user_id, count(*) AS samples, avg(diff) AS motion, count_if(diff > 20) AS active, max(diff) AS peak FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS diff, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n < 10 AND diff IS NOT NULL GROUP BY user_id"""


def moving_average(d: Spark) -> str:
    return "SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS motion FROM events"


def security_rollup(d: Spark) -> str:
    return f"SELECT doc_id, {d.half_even('100e0 * passed / n', 1)} AS score, CASE WHEN passed = n THEN 'PASS' WHEN passed >= greatest(2, CAST(floor(n / 2e0) AS BIGINT)) THEN 'REVIEW' ELSE 'HIGH' END AS status FROM (SELECT doc_id, count(*) AS n, count_if(status = 'PASS') AS passed FROM {t('signals')} s GROUP BY doc_id) x"


def ocr_confidence(d: Spark) -> str:
    return f"SELECT doc_id, coalesce(avg(CASE WHEN conf >= 20 THEN conf END), 0e0) AS mean_conf, min(conf) AS low, max(conf) AS high FROM {t('signals')} s GROUP BY doc_id"


def highest_severity(d: Spark) -> str:
    return f"SELECT doc_id, CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count_if(status = 'FAIL') AS n_fail, count_if(severity = 'HIGH' AND status = 'FAIL') AS n_high_fail FROM {t('signals')} s GROUP BY doc_id"


def effective_confidence(d: Spark) -> str:
    """Weighted mean over required fields, at least two of them, not below the raw value."""
    return f"""SELECT doc_id, least(100e0, greatest(0e0, CASE WHEN n >= 2 THEN greatest(raw, total / weight) ELSE raw END)) AS conf FROM (SELECT doc_id, max(CASE WHEN seq = 1 THEN conf ELSE 0 END) AS raw, count_if(conf > 20) AS n,
        sum(CASE WHEN conf > 20 THEN conf * CASE WHEN seq >= 5 THEN 0.5e0 ELSE 1e0 END ELSE 0e0 END) AS total, greatest(0.5e0, sum(CASE WHEN conf > 20 THEN CASE WHEN seq >= 5 THEN 0.5e0 ELSE 1e0 END ELSE 0e0 END)) AS weight FROM {t("signals")} s GROUP BY doc_id) x"""


def longest_pick(d: Spark) -> str:
    return f"SELECT doc_id, {d.argmax('line', 'length(line)', '-pos')} AS line FROM {d.lines('documents', 'doc_id')} l GROUP BY doc_id"


def manifest_rollup(d: Spark) -> str:
    return f"SELECT user_id, count_if(event_type = 'purchase') AS active, {d.argmin('event_type', 'ts', 'event_id')} AS first_kind, {d.listed('event_type', 'ts', '>')} AS history FROM (SELECT DISTINCT user_id, event_type, min(ts) AS ts, min(event_id) AS event_id FROM events GROUP BY user_id, event_type) x GROUP BY user_id"


def capped_signals(d: Spark) -> str:
    return f"SELECT doc_id, seq, severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, seq) AS n FROM {t('signals')} s) x WHERE n <= 3"


def largest_regions(d: Spark) -> str:
    return f"SELECT doc_id, box_id, area FROM (SELECT doc_id, box_id, w * h AS area, row_number() OVER (PARTITION BY doc_id ORDER BY w * h DESC, box_id) AS n FROM {t('boxes')} b) x WHERE n <= 20 AND area >= 180"


def overlap_coefficient(d: Spark) -> str:
    a, b = d.distinct(d.words("lower(p_name)")), d.distinct(d.words("lower(p_type || ' ' || p_brand || ' ' || substr(p_name, 1, 12))"))
    return f"SELECT p_partkey, {d.common('a', 'b')} / CAST(greatest(1, least({d.size('a')}, {d.size('b')})) AS DOUBLE) >= 0.55e0 AS same FROM (SELECT p_partkey, {a} AS a, {b} AS b FROM part) x"


def key_union(d: Spark) -> str:
    return f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_reference, coalesce(b.n, 0) AS n_suspect FROM (SELECT id_type AS k, count(*) AS n FROM {t('docs')} d WHERE id % 2 = 0 GROUP BY id_type) a FULL OUTER JOIN (SELECT id_type AS k, count(*) AS n FROM {t('docs')} d WHERE id % 3 = 0 GROUP BY id_type) b ON a.k = b.k"


def mandatory_fields(d: Spark) -> str:
    pats = {"year": "(19|20)[0-9][0-9]", "email": "[a-z0-9.]+@[a-z0-9.]+", "phone": "[0-9]{3}[- .][0-9]{4}", "card": "[0-9]{12,16}", "amount": "[$] ?[0-9]+", "code": "[A-Z]{2}[0-9]{3,}"}
    return "SELECT doc_id, " + ", ".join(f"{d.match('text', p)} AS has_{k}" for k, p in pats.items()) + " FROM documents"


def sha_fingerprint(d: Spark) -> str:
    return f"SELECT doc_id, {d.sha256('text')} AS sha, substr({d.sha256('lang')}, 1, 16) AS fingerprint FROM documents"


def json_bodies(d: Spark) -> str:
    bad = "CASE WHEN event_id % 50 = 0 THEN '{bad' ELSE props END"
    value = f"get_json_object({bad}, '$.k')" if d.name == "spark" else f"CASE WHEN json_valid({bad}) THEN json_extract_string({bad}, '$.k') END"
    return f"SELECT event_id, {value} AS k FROM events"


def family_alias(d: Spark) -> str:
    aliases = "(SELECT 'URGENT' AS raw, 'PAN' AS canonical UNION ALL SELECT 'HIGH', 'AADHAAR' UNION ALL SELECT 'NOT_SPECIFIED', 'VISA')"
    return f"SELECT o.o_orderkey, coalesce(a.canonical, o.raw) AS family FROM (SELECT o_orderkey, {d.sub('upper(substr(o_orderpriority, 3, 20))', '[ -]+', '_')} AS raw FROM orders) o LEFT JOIN {aliases} a ON a.raw = o.raw"


def forensics_level(d: Spark) -> str:
    return f"SELECT doc_id, CASE WHEN n_high >= 3 OR (n_medium >= 2 AND ocr_conf > 55) THEN 'HIGH' WHEN n_high >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM {t('evidence')} e"


def exif_level(d: Spark) -> str:
    return f"SELECT doc_id, CASE WHEN n_editing_markers >= 3 THEN 'HIGH' WHEN software IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS level FROM {t('features')} f"


def reference_score(d: Spark) -> str:
    field = d.half_even("100e0 * n_high / n", 1)
    return f"SELECT doc_id, field_score, score, CASE WHEN score >= 55 THEN 'HIGH' WHEN score >= 18 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT doc_id, field_score, least(100e0, {d.half_even('greatest(0.68e0 * field_score, visual)')}) AS score FROM (SELECT doc_id, {field} AS field_score, CAST(units % 40 AS DOUBLE) AS visual FROM {t('evidence')} e) x) y"


def candidate_pick(d: Spark) -> str:
    score = "CASE severity WHEN 'HIGH' THEN 96e0 WHEN 'MEDIUM' THEN 84e0 ELSE 78e0 END * (0.78e0 + 0.22e0 * conf / 100)"
    return f"SELECT doc_id, seq, score FROM (SELECT doc_id, seq, least(99e0, {score}) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY least(99e0, {score}) DESC, length(CAST(l_partkey AS STRING)) DESC, seq) AS n FROM {t('signals')} s) x WHERE n = 1"


def face_gate(d: Spark) -> str:
    s = "0.20e0 * value + 0.15e0 * (value * 1.1e0) + 0.03e0 * (event_id % 100) + 0.50e0 * value + 0.12e0 * (event_id * 7 % 100)"
    return f"SELECT event_id, {s} AS score, {s} >= 62 AND event_id % 5 > 1 AND event_id % 7 > 0 AS matched FROM events"


def consistency(d: Spark) -> str:
    """Date order, identifier shape and year agreement to counted failures and reviews."""
    return f"""SELECT id, n_fail, n_review, least(100, 35 * n_fail + 10 * n_review) AS score, CASE WHEN 35 * n_fail + 10 * n_review >= 50 THEN 'HIGH' WHEN 35 * n_fail + 10 * n_review >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (
        SELECT id, CAST(dob >= issued AS INT) + CAST(until <= issued AS INT) + CASE WHEN id_type = 'PAN' AND NOT {d.match("number_key", "^[A-Z]{5}[0-9]{4}[A-Z]$")} THEN 1 ELSE 0 END AS n_fail,
        CASE WHEN NOT {d.match("full_name", "[0-9]{2}")} THEN 1 ELSE 0 END + CASE WHEN id_type = 'PASSPORT' AND NOT {d.match("number_key", "^[A-Z][A-Z0-9]{7,8}$")} THEN 1 ELSE 0 END AS n_review FROM (
        SELECT id, id_type, number_key, full_name, CAST(created_at AS DATE) AS issued, {d.to_date("CAST(1990 + id % 9 AS STRING) || '-03-0' || CAST(1 + id % 9 AS STRING)")} AS dob, {d.to_date("CAST(1991 + id % 8 AS STRING) || '-06-0' || CAST(1 + id % 9 AS STRING)")} AS until FROM {t("docs")} d) a) b"""


def schema_checks(d: Spark) -> str:
    return f"""SELECT id, CASE WHEN number_key IS NULL OR id % 13 = 0 THEN 'MISSING' WHEN id_type IN ('PAN', 'AADHAAR', 'COLLEGE_ID') AND NOT {d.match("number_key", "^[A-Z]{3}[0-9]{2,3}[0-9]$")} THEN 'FORMAT_REVIEW' ELSE 'PASS' END AS number_status,
        CASE WHEN id_type = 'AADHAAR' AND risk_score < 70 THEN 'REVIEW' WHEN id_type IN ('AADHAAR', 'PAN') THEN 'FAIL' ELSE 'NONE' END AS identifier_status FROM {t("docs")} d"""


def indicators(d: Spark) -> str:
    features = t("features").replace("CAST(l_extendedprice AS BIGINT)", d.whole("l_extendedprice"))
    return f"""SELECT doc_id, CAST(file_size < 10240 AS INT) + CAST(width < 600 OR height < 400 AS INT) + CAST(software IS NOT NULL AS INT) AS n_indicators,
        CASE WHEN width < 600 OR height < 400 OR software IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS highest_severity FROM {features} f"""


def shared() -> dict:
    """Every function of a dialect in this module."""
    return {name: fn for name, fn in globals().items() if callable(fn) and getattr(fn, "__annotations__", {}).get("d") in ("Spark", Spark)}


def keyword_template(d: Spark) -> str:
    """At least two of a family's three words in the text."""
    hits = " + ".join(f"CAST(contains(upper(text), '{k}') AS INT)" for k in ("TH", "ING", "DER"))
    return f"SELECT doc_id, {hits} AS hits, CASE WHEN {hits} >= least(2, 3) THEN 'PASS' ELSE 'REVIEW' END AS status FROM documents"


def encoded_payload(d: Spark) -> str:
    """A decoded payload against the extracted identifier."""
    return "SELECT event_id, CASE WHEN props IS NULL THEN 'UNAVAILABLE' WHEN contains(upper(props), upper(event_type)) THEN 'MATCH' WHEN event_id % 3 = 0 THEN 'MISMATCH' ELSE 'REVIEW' END AS status FROM events"


def identity_issues(d: Spark) -> str:
    return f"SELECT id, field, value IS NULL AS nothing_extracted FROM {fields_long()} v WHERE field <> 'address' AND (value IS NULL OR conf < 30)"


def verification_append(d: Spark) -> str:
    return f"SELECT id, owner AS subject_id, id_type, number_key AS id_number, CAST(risk_score AS STRING) AS risk_score, CASE WHEN risk_score < 25 THEN 'VERIFIED' WHEN risk_score < 50 THEN 'PENDING_REVIEW' ELSE 'REJECTED' END AS final_status, 'history' AS source FROM {t('docs')} d WHERE id % 2 = 0 UNION ALL SELECT id, owner, id_type, number_key, CAST(risk_score AS STRING), 'PENDING_REVIEW', 'upload' FROM {t('docs')} e WHERE id % 2 = 1"


def capture_append(d: Spark) -> str:
    return "SELECT event_id AS id, user_id AS unique_id, 'capture_' || CAST(event_id AS STRING) || '.jpg' AS stored_filename, CAST(floor(value * 1000) AS BIGINT) AS file_size, value AS motion_score, CAST(event_id % 12 AS INT) AS motion_samples FROM events WHERE event_type = 'click'"


def year_range(d: Spark) -> str:
    """Validity ranges in text against a given year (1996)."""
    x = "CAST(1990 + o_orderkey % 9 AS STRING) || ' - ' || CAST(1991 + o_orderkey % 7 AS STRING)"
    return f"SELECT o_orderkey, CASE WHEN b < a THEN 'FAIL' WHEN b < 1996 THEN 'REVIEW' ELSE 'PASS' END AS status FROM (SELECT o_orderkey, CAST({d.group(x, '([0-9]{4}) *- *([0-9]{4})', 1)} AS INT) AS a, CAST({d.group(x, '([0-9]{4}) *- *([0-9]{4})', 2)} AS INT) AS b FROM orders) z"


def licence_year(d: Spark) -> str:
    n = "'MH12' || CAST(1992 + o_orderkey % 7 AS STRING) || lpad(CAST(o_orderkey % 10000 AS STRING), 5, '0')"
    return f"SELECT o_orderkey, CASE WHEN NOT {d.match(n, '^[A-Z]{2}[0-9]{2}(19|20)[0-9]{2}[0-9]{4,8}$')} THEN 'FAIL' WHEN CAST(substr({n}, 5, 4) AS INT) <> year(o_orderdate) THEN 'REVIEW' ELSE 'PASS' END AS status FROM orders"


def labelled_number(d: Spark) -> str:
    """A labelled number, else any long run of digits, else none."""
    return f"SELECT page_id, coalesce(nullif({d.group('html', '(no|number|id)[ .:=]+([A-Z0-9]{4,})', 2)}, ''), nullif({d.group('html', '([0-9]{5,})', 1)}, '')) AS number FROM pages"


def address_clean(d: Spark) -> str:
    return f"SELECT doc_id, {d.sub(d.sub('text', '[^A-Za-z0-9 ,]+', ', '), ' *, *', ', ')} AS address, {d.match('text', '(^|[^0-9])[0-9]{6}([^0-9]|$)')} AS has_pin FROM documents"


def saturating_scores(d: Spark) -> str:
    return f"SELECT l_orderkey, l_linenumber, {d.half_even('100e0 * (1e0 - exp(-l_quantity / 25e0))', 3)} AS saturated, {d.half_even('sqrt(l_quantity) + ln(1e0 + l_quantity)', 3)} AS edge FROM lineitem"


def timeline_user_json(d: Spark) -> str:
    user = "to_json(named_struct('name', u.full_name, 'status', u.status))" if d.name == "spark" else "CAST(to_json({'name': u.full_name, 'status': u.status}) AS VARCHAR)"
    return f"SELECT x.id, {user} AS user_json FROM {t('docs')} x JOIN {t('users')} u ON u.unique_id = x.owner"
