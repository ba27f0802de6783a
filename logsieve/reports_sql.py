"""The reports of ``reports.py`` in plain SQL, for checking results in another engine."""

from __future__ import annotations

from . import fixed_values as fv
from .forest_sql import forest_parts
from .sources.access_log import ACCESS_LOG_SQL

THRESHOLD = fv.BASELINE_THRESHOLD


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(key: str, salt: int, n: str | int) -> str:
    return f"((({key} % 1000003) * {7919 + 97 * salt} + {40503 * salt}) % 1000003) % {n}"


def replaced(expr: str, pattern: str, mask: str) -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, '{mask}', 'g')"


def path_template(expr: str) -> str:
    clean = f"split_part({expr}, '?', 1)"
    return replaced(replaced(clean, fv.PATH_HEX_TOKEN, "<HEX>"), fv.NUMBER_TOKEN, "<NUM>")


def message_template(expr: str) -> str:
    for pattern, mask in (
        (fv.IP_TOKEN, "<IP>"),
        (fv.UUID_TOKEN, "<UUID>"),
        (fv.HEX_TOKEN, "<HEX>"),
        (fv.NUMBER_TOKEN, "<NUM>"),
    ):
        expr = replaced(expr, pattern, mask)
    return expr


def bucket(expr: str) -> str:
    half = "(('0x' || substr(md5({0}), {1}, 16))::UBIGINT % 1000)"
    mixed = f"({half.format(expr, 1)} * 616 + {half.format(expr, 17)}) % 1000"
    return f"CASE WHEN coalesce({expr}, '') = '' THEN 0.0::DOUBLE ELSE ({mixed})::DOUBLE / 1000 END"


def level(status: str) -> str:
    return (
        f"CASE WHEN {status} >= 500 THEN 'ERROR' WHEN {status} >= 400 THEN 'WARNING' "
        f"WHEN {status} >= 300 THEN 'NOTICE' ELSE 'INFO' END"
    )


def steps(value: str, bounds: list[float]) -> str:
    cases = " ".join(f"WHEN {value} <= {bound} THEN {bound}::DOUBLE" for bound in bounds)
    return f"CASE {cases} ELSE 'inf'::DOUBLE END"


def search(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {quoted(pattern)}, 'i')"


CLEAN_AGENT = "coalesce(user_agent, '')"
SCANNER = search(CLEAN_AGENT, fv.SCANNER_AGENT)
RULES = [
    ("path_traversal", "T1190", 0.90, search("path", fv.PATH_TRAVERSAL)),
    ("sql_injection", "T1190", 0.95, search("path", fv.SQL_INJECTION)),
    ("xss", "T1203", 0.80, f"({search('path', fv.XSS)} OR {search(CLEAN_AGENT, fv.XSS)})"),
    ("command_injection", "T1059.004", 0.90, search("path", fv.COMMAND_INJECTION)),
    ("webshell", "T1505.003", 0.85, search("path", fv.WEBSHELL)),
    ("ssrf", "T1190", 0.85, search("path", fv.SSRF)),
    ("log4shell", "T1190", 0.95, f"({search('path', fv.LOG4SHELL)} OR {search(CLEAN_AGENT, fv.LOG4SHELL)})"),
    ("sensitive_path", "T1592", 0.70, search("path", fv.SENSITIVE_PATH)),
    ("scanner_path", "T1595.002", 0.75, search("path", fv.SCANNER_PATH)),
    ("scanner_agent", "T1595.002", 0.80, SCANNER),
    ("bot_agent", "T1595", 0.50, f"({search(CLEAN_AGENT, fv.GENERIC_BOT_AGENT)} AND NOT {SCANNER})"),
    (
        "write_method_error",
        "T1190",
        0.60,
        "(upper(method) IN ('PUT','DELETE','TRACE','CONNECT','PATCH') AND status >= 400)",
    ),
    ("auth_failure", "T1110", 0.40, "(status IN (401, 403))"),
    ("server_error", "T1499", 0.30, "(status >= 500)"),
]
RULE_LIST = ", ".join(
    f"{{'rule_no': {at + 1}, 'rule': '{rule}', 'technique_id': '{technique}', "
    f"'confidence': {confidence}::DOUBLE, 'hit': {condition}}}"
    for at, (rule, technique, confidence, condition) in enumerate(RULES)
)
CATALOG = "(VALUES " + ", ".join(
    f"({quoted(t)}, {quoted(n)}, {quoted(c)})" for t, n, c in fv.TECHNIQUE_CATALOG
) + ") AS catalog(technique_id, name, tactic)"
PLAIN_NAMES = "['remote_addr','ident','remote_user','time_local','request','status','bytes_sent','referrer','user_agent','request_time']"
PLAIN_RE2 = (
    r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+) "([^"]*)" "([^"]*)"(?: ([\d.]+))?$'
)
REQUEST_RE2 = "^" + fv.REQUEST_LINE

# Named sub-queries; ``query`` prefixes a statement with those it needs.
PARTS = {
    "log": ("", ACCESS_LOG_SQL),
    "ev": (
        "log",
        f"SELECT *, concat_ws(' ', nullif(method, ''), nullif(path, ''), protocol) AS message, "
        f"{level('status')} AS level FROM log",
    ),
    "tpl": (
        "ev",
        "SELECT *, upper(method) || '|' || (status // 100)::VARCHAR || '|' || "
        f"CASE WHEN {path_template('path')} <> '' THEN {path_template('path')} "
        f"ELSE {message_template('message')} END AS template FROM ev",
    ),
    "cnt": ("tpl", "SELECT template, count(*) AS cnt FROM tpl GROUP BY 1"),
    "sc": (
        "cnt",
        "SELECT t.*, 1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM cnt) AS score "
        "FROM tpl t JOIN cnt c USING (template)",
    ),
    "res": ("sc", f"SELECT *, score >= {THRESHOLD}::DOUBLE AS is_anomaly FROM sc"),
    "hits": (
        "ev",
        f"SELECT event_id, u.rule_no, u.rule, u.technique_id, u.confidence FROM "
        f"(SELECT event_id, unnest([{RULE_LIST}]) AS u FROM ev) WHERE u.hit",
    ),
    "tech": (
        "hits",
        "SELECT event_id, technique_id, max(confidence) AS confidence, min(rule_no) AS first "
        "FROM hits GROUP BY 1, 2",
    ),
    "ranked": (
        "tech",
        "SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, first) - 1)::INTEGER "
        f"AS position, technique_id, name, tactic, confidence FROM tech JOIN {CATALOG} USING (technique_id)",
    ),
    "found": (
        "res ranked",
        "SELECT r.event_id, r.event_ts, t.technique_id, t.tactic FROM res r JOIN ranked t USING (event_id) WHERE r.is_anomaly",
    ),
    "tcnt": ("found", "SELECT technique_id, tactic, count(*) AS cnt FROM found GROUP BY 1, 2"),
    "plain": (
        "ev",
        "SELECT event_id, host AS file, printf('%s - %s [%s] \"%s\" %d %d \"%s\" \"%s\" %.3f', remote_addr, "
        "coalesce(nullif(remote_user, ''), '-'), strftime(event_ts, '%d/%b/%Y:%H:%M:%S') || ' +0000', message, status, "
        "bytes_sent, coalesce(nullif(referrer, ''), '-'), coalesce(nullif(user_agent, ''), '-'), request_time) AS value FROM ev",
    ),
    "broken": (
        "plain",
        "SELECT event_id, file, CASE WHEN event_id % 97 = 0 THEN substr(value, 1, 10) ELSE value END AS value FROM plain",
    ),
    "pieces": (
        "plain",
        f"SELECT event_id, regexp_extract(value, {quoted(PLAIN_RE2)}, {PLAIN_NAMES}) AS m FROM plain",
    ),
    "parsed": (
        "pieces",
        "SELECT event_id, nullif(m.remote_addr, '-') AS remote_addr, nullif(m.remote_user, '-') AS remote_user, "
        f"nullif(regexp_extract(m.request, {quoted(REQUEST_RE2)}, 1), '') AS method, "
        f"nullif(regexp_extract(m.request, {quoted(REQUEST_RE2)}, 2), '') AS path, "
        f"nullif(regexp_extract(m.request, {quoted(REQUEST_RE2)}, 3), '') AS protocol, m.request AS message, "
        "strptime(left(m.time_local, 20), '%d/%b/%Y:%H:%M:%S') AS event_ts, m.status::INTEGER AS status, "
        "m.bytes_sent::BIGINT AS bytes_sent, nullif(trim(m.referrer), '-') AS referrer, "
        "nullif(trim(m.user_agent), '-') AS user_agent, m.request_time::DOUBLE AS request_time FROM pieces",
    ),
    "lab": (
        "sc",
        "SELECT score, sum(CASE WHEN label <> 'clean' THEN 1 ELSE 0 END)::BIGINT AS pos, "
        "sum(CASE WHEN label = 'clean' THEN 1 ELSE 0 END)::BIGINT AS neg FROM sc GROUP BY 1",
    ),
    "grid": (
        "lab",
        "SELECT k * 0.01::DOUBLE AS threshold, "
        "coalesce(sum(pos) FILTER (score >= k * 0.01::DOUBLE), 0)::BIGINT AS tp, "
        "coalesce(sum(neg) FILTER (score >= k * 0.01::DOUBLE), 0)::BIGINT AS fp, "
        "coalesce(sum(pos) FILTER (score < k * 0.01::DOUBLE), 0)::BIGINT AS fn, "
        "coalesce(sum(neg) FILTER (score < k * 0.01::DOUBLE), 0)::BIGINT AS tn "
        "FROM range(101) g(k), lab GROUP BY k",
    ),
    "cut": (
        "lab",
        f"SELECT coalesce(sum(pos) FILTER (score >= {THRESHOLD}), 0)::BIGINT AS tp, "
        f"coalesce(sum(neg) FILTER (score >= {THRESHOLD}), 0)::BIGINT AS fp, "
        f"coalesce(sum(pos) FILTER (score < {THRESHOLD}), 0)::BIGINT AS fn, "
        f"coalesce(sum(neg) FILTER (score < {THRESHOLD}), 0)::BIGINT AS tn FROM lab",
    ),
    "sweep": (
        "grid",
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 "
        "FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0::DOUBLE END AS precision, "
        "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0::DOUBLE END AS recall, "
        "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0::DOUBLE END AS fpr, "
        "(tp + tn) / (tp + fp + fn + tn) AS accuracy FROM grid)",
    ),
    "roc": (
        "lab",
        "SELECT score AS threshold, sum(neg) OVER w / sum(neg) OVER () AS fpr, sum(pos) OVER w / sum(pos) OVER () AS tpr "
        "FROM lab WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) "
        "UNION ALL SELECT 'inf'::DOUBLE, 0::DOUBLE, 0::DOUBLE",
    ),
    "batch": (
        "res",
        f"SELECT event_id // {fv.INGEST_BATCH_SIZE} AS batch_id, count(*) AS events, count_if(is_anomaly)::BIGINT AS anomalies, "
        "count_if(is_anomaly) / count(*)::DOUBLE AS anomaly_rate FROM res GROUP BY 1",
    ),
    "bounds": ("", "SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in fv.SCORE_BOUNDS) + ", 'inf'::DOUBLE]) AS le"),
    "hist": (
        "res bounds",
        "SELECT le, count(*) FILTER (score <= le) AS cumulative FROM bounds, res GROUP BY le",
    ),
    "secs": ("res", "SELECT *, (epoch_us(event_ts) // 15000000) * 15 AS bucket FROM res"),
    "tmpl": (
        "ev",
        "SELECT *, (row_number() OVER (ORDER BY mix, event_id) - 1)::INTEGER AS template_no FROM "
        f"(SELECT *, {pick('event_id', 11, 1000003)} AS mix FROM ev) "
        f"ORDER BY mix, event_id LIMIT {fv.TEMPLATE_SAMPLE}",
    ),
    "payload": (
        "",
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"({at}, {quoted(name)}, {number}, {quoted(url)}, {len(urls)})"
            for at, (name, urls) in enumerate(fv.ATTACK_PAYLOADS.items())
            for number, url in enumerate(urls)
        )
        + ") AS payload(category_no, category, url_no, url, urls)",
    ),
    "choice": (
        "",
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"({at}, {fv.ATTACK_CHOICES[name][0]}, {fv.ATTACK_CHOICES[name][1]}, {len(urls)})"
            for at, (name, urls) in enumerate(fv.ATTACK_PAYLOADS.items())
        )
        + ") AS choice(category_no, percent, statuses, urls)",
    ),
    "slot": (
        "ev choice tmpl",
        f"SELECT event_id, category_no, percent, statuses, {pick('event_id', 2, 'urls')} AS url_no, "
        f"{pick('event_id', 3, '(SELECT count(*) FROM tmpl)')} AS template_no, "
        f"statuses[({pick('event_id', 4, 'len(statuses)')}) + 1] AS status, "
        f"CASE WHEN {pick('event_id', 6, 100)} < percent THEN "
        f"({[a for a in fv.SCANNER_AGENTS]!r})[({pick('event_id', 5, len(fv.SCANNER_AGENTS))}) + 1] END AS agent "
        f"FROM (SELECT event_id, {pick('event_id', 1, len(fv.ATTACK_PAYLOADS))} AS category_no FROM ev) JOIN choice USING (category_no)",
    ),
    "attack": (
        "slot payload tmpl",
        "SELECT s.event_id, 'attack:' || p.category AS label, t.method, p.url AS path, s.status, "
        f"coalesce(s.agent, t.user_agent) AS user_agent, {pick('s.event_id', 8, 1000003)} AS mix_order FROM slot s "
        "JOIN payload p ON p.category_no = s.category_no AND p.url_no = s.url_no JOIN tmpl t ON t.template_no = s.template_no",
    ),
}


def needed(names: str) -> list[str]:
    """The named parts with everything they build on, in order."""
    order: list[str] = []
    for name in names.split():
        for part in (*needed(PARTS[name][0]), name):
            if part not in order:
                order.append(part)
    return order


def query(parts: str, select: str) -> str:
    body = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in needed(parts))
    return f"WITH {body}\n{select}"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) AS {name}"


def quantiles(buckets: str, by: str = "") -> str:
    """Interpolated dashboard quantiles of a (by, le, cumulative) relation."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}, quantile" if by else "GROUP BY quantile"
    value = (
        "CASE WHEN le = 'inf'::DOUBLE THEN lo WHEN cumulative > below "
        "THEN lo + (le - lo) * ((quantile * total - below) / (cumulative - below)) ELSE lo END"
    )
    inner = (
        f"SELECT *, coalesce(lag(cumulative) OVER ({part} ORDER BY le), 0) AS below, "
        f"coalesce(lag(le) OVER ({part} ORDER BY le), 0) AS lo, max(cumulative) OVER ({part}) AS total FROM {buckets}"
    )
    asked = f"SELECT *, unnest({fv.DASHBOARD_QUANTILES}::DOUBLE[]) AS quantile FROM ({inner})"
    return (
        f"SELECT {lead}quantile, round(arg_min({value}, le), 6) AS value FROM ({asked}) "
        f"WHERE cumulative >= quantile * total {group}"
    )


def sliding(source: str, cols: str, by: str = "") -> str:
    group = f", {by}" if by else ""
    return (
        f"SELECT bucket - o AS window_start{group}, {cols} FROM {source}, "
        f"(SELECT unnest(range(0, 300, 15)) AS o) GROUP BY bucket - o{group}"
    )


def severity(metric: str, value: str) -> str:
    base, levels = fv.SEVERITY_STEPS[metric]
    cases = " ".join(f"WHEN {value} >= {bound} THEN '{name}'" for name, bound in levels)
    return f"CASE {cases} ELSE '{base}' END"


PARSED_COLUMNS = (
    "event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS at, hour(event_ts)::INTEGER AS local_hour, '+00:00' AS utc_offset, "
)
TOP20 = "ORDER BY cnt DESC, technique_id LIMIT 20"
DISTRIBUTION = ", ".join(
    [
        "count(*) AS n", r("avg(score)", "mean"), r("stddev_pop(score)", "std"), r("min(score)", "min"),
        r("quantile_cont(score, 0.5)", "p50"), r("quantile_cont(score, 0.95)", "p95"),
        r("quantile_cont(score, 0.99)", "p99"), r("max(score)", "max"),
    ]
)
RATIOS = (
    r("tp / (tp + fp)", "precision") + ", " + r("tp / (tp + fn)", "recall") + ", " + r("fp / (fp + tn)", "fpr")
    + ", " + r("(tp + tn) / (tp + fp + fn + tn)", "accuracy") + ", " + r("2 * tp / (2 * tp + fp + fn)", "f1")
)

FEATURES = {
    "status_code": "coalesce(status, 0)",
    "status_class": "coalesce(status, 0) // 100",
    "method_code": "CASE upper(method) " + " ".join(f"WHEN '{m}' THEN {c}" for m, c in fv.METHOD_CODES.items()) + " ELSE -1 END",
    "path_length": "length(path)",
    "path_depth": "length(path) - length(replace(path, '/', ''))",
    "path_tokens": "len(list_filter(string_split(path, '/'), lambda x: x <> ''))",
    "has_query": "CASE WHEN contains(path, '?') THEN 1 ELSE 0 END",
    "is_static": "CASE WHEN regexp_matches(split_part(path, '?', 1), '\\.(css|js|png|jpg|jpeg|gif|ico|svg|woff|woff2)$', 'i') THEN 1 ELSE 0 END",
    "bytes_log1p": "ln(1 + coalesce(bytes_sent, 0)::DOUBLE)",
    "request_time_log1p": "ln(1 + coalesce(request_time, 0)::DOUBLE)",
    "referrer_hash": bucket("regexp_extract(referrer, '^[a-zA-Z]+://([^/?#]*)', 1)"),
    "user_agent_hash": bucket("user_agent"),
    "ip_hash": bucket("remote_addr"),
    "hour": "hour(event_ts)",
    "hour_sin": "sin(2 * pi() * hour(event_ts) / 24)",
    "hour_cos": "cos(2 * pi() * hour(event_ts) / 24)",
    "weekday": "isodow(event_ts) - 1",
    "is_weekend": "CASE WHEN isodow(event_ts) >= 6 THEN 1 ELSE 0 END",
    "has_user": "CASE WHEN coalesce(remote_user, '') <> '' THEN 1 ELSE 0 END",
    "user_length": "length(coalesce(remote_user, ''))",
    "message_length": "length(message)",
    "suspicious_path": f"CASE WHEN {search('path', fv.SUSPICIOUS_PATH)} THEN 1 ELSE 0 END",
    "sql_keyword": f"CASE WHEN {search('path', fv.SQL_KEYWORD)} THEN 1 ELSE 0 END",
    "bot_ua": f"CASE WHEN {search(CLEAN_AGENT, fv.BOT_AGENT)} THEN 1 ELSE 0 END",
    "path_template_hash": bucket(path_template("path")),
    "request_length_log1p": "0",
}


def feature_query(*names: str) -> str:
    columns = ", ".join(r(FEATURES[name], name) for name in names)
    return query("ev", f"SELECT event_id, {columns} FROM ev")


def feature_values() -> str:
    """(position, feature, value) of every event."""
    pairs = ", ".join(
        f"{{'position': {at}, 'feature': '{name}', 'value': ({FEATURES[name]})::DOUBLE}}"
        for at, name in enumerate(fv.FEATURE_NAMES)
    )
    return f"SELECT event_id, unnest([{pairs}], recursive := true) FROM ev"


TOP_TECHNIQUES = f"SELECT technique_id, tactic, cnt FROM tcnt {TOP20}"
# The rate of the newest batch, and the durations of all batches.
NEWEST = "(SELECT anomaly_rate AS rate FROM batch ORDER BY batch_id DESC LIMIT 1)"
DURATIONS = f"(SELECT round(sum(request_time) / 100, 6) AS s FROM log GROUP BY event_id // {fv.INGEST_BATCH_SIZE})"
TOTALS = "(SELECT count(*) AS events, count_if(is_anomaly) AS anomalies FROM res)"

ORACLES: dict[str, str] = {
    "technique_counts_top20": query("tcnt", TOP_TECHNIQUES),
    "parse_plain": query(
        "parsed",
        f"SELECT {PARSED_COLUMNS} NULL::VARCHAR AS host, remote_addr, remote_user, method, path, protocol, referrer, user_agent, "
        f"message, {level('status')} AS level, 'nginx' AS service, status, bytes_sent, {r('request_time', 'request_time')} FROM parsed",
    ),
    "parse_plain_strict": query(
        "parsed", f"SELECT {level('status')} AS level, method, count(*) AS cnt FROM parsed GROUP BY 1, 2"
    ),
    "parse_jsonl": query(
        "ev",
        f"SELECT {PARSED_COLUMNS} host, remote_addr, remote_user_or_null AS remote_user, method, nullif(path, '') AS path, protocol, "
        f"CASE WHEN odd THEN NULL ELSE referrer END AS referrer, user_agent, message, level, NULL::VARCHAR AS service, status, "
        "CASE WHEN odd THEN bytes_sent ELSE nullif(bytes_sent, 0) END AS bytes_sent, "
        f"{r('CASE WHEN odd THEN request_time ELSE nullif(request_time, 0) END', 'request_time')} "
        "FROM (SELECT *, event_id % 2 = 1 AS odd, CASE WHEN event_id % 2 = 0 THEN remote_user END AS remote_user_or_null FROM ev)",
    ),
    "parse_jsonl_mapped": query(
        "ev",
        "SELECT event_id, strftime(event_ts - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS at, hour(event_ts)::INTEGER AS local_hour, "
        "'+03:00' AS utc_offset, NULL::VARCHAR AS host, remote_addr, NULL::VARCHAR AS remote_user, "
        f"nullif(regexp_extract(request, {quoted(REQUEST_RE2)}, 1), '') AS method, "
        f"nullif(regexp_extract(request, {quoted(REQUEST_RE2)}, 2), '') AS path, "
        f"nullif(regexp_extract(request, {quoted(REQUEST_RE2)}, 3), '') AS protocol, NULL::VARCHAR AS referrer, "
        "NULL::VARCHAR AS user_agent, request AS message, level, 'nginx' AS service, status, "
        "nullif(bytes_sent, 0) AS bytes_sent, NULL::DOUBLE AS request_time "
        "FROM (SELECT *, method || ' ' || path || ' ' || protocol AS request FROM ev)",
    ),
    "reject_reasons": query(
        "broken",
        "SELECT event_id, file, trim(value) AS value, 'no pattern matches' AS reject_reason FROM broken WHERE event_id % 97 = 0",
    ),
    "line_counts": query("broken", "SELECT file, count(*) AS lines FROM broken GROUP BY 1"),
    "line_batch_sizes": query(
        "plain", f"SELECT event_id // {fv.INGEST_BATCH_SIZE} AS batch_id, count(*) AS lines FROM plain GROUP BY 1"
    ),
    "request_line_split": query(
        "ev",
        "SELECT event_id, "
        + ", ".join(
            f"nullif(regexp_extract(message, {quoted(REQUEST_RE2)}, {at}), '') AS {name}"
            for at, name in ((1, "method"), (2, "path"), (3, "protocol"))
        )
        + " FROM ev",
    ),
    "level_counts": query("ev", "SELECT level, count(*) AS cnt FROM ev GROUP BY 1"),
    "event_sources": query("ev", "SELECT coalesce(nullif(host, ''), 'unknown') AS source, count(*) AS cnt FROM ev GROUP BY 1"),
    "path_templates": query("log", f"SELECT {path_template('path')} AS template, count(*) AS cnt FROM log GROUP BY 1"),
    "message_templates": query(
        "log",
        "SELECT "
        + message_template(
            "(remote_addr || ' ' || path || ' 0x' || lower(to_hex(event_id)) || ' id=550e8400-e29b-41d4-a716-' || "
            "lpad(lower(to_hex(event_id)), 12, '0') || ' took ' || bytes_sent::VARCHAR)"
        )
        + " AS template, count(*) AS cnt FROM log GROUP BY 1",
    ),
    "path_extension_counts": query(
        "log",
        "SELECT CASE WHEN contains(c, '.') THEN '.' || lower(list_last(string_split(c, '.'))) ELSE '' END AS extension, "
        "count(*) AS cnt FROM (SELECT split_part(path, '?', 1) AS c FROM log) GROUP BY 1",
    ),
    "referrer_domains": query(
        "log",
        "SELECT coalesce(regexp_extract(referrer, '^[a-zA-Z]+://([^/?#]*)', 1), '') AS domain, count(*) AS cnt FROM log GROUP BY 1",
    ),
    "hash_buckets": query(
        "log",
        f"SELECT event_id, {r(bucket('remote_addr'), 'ip_bucket')}, {r(bucket('user_agent'), 'agent_bucket')}, "
        f"{r(bucket('path'), 'path_bucket')} FROM log",
    ),
    "features_request": feature_query(
        "status_code", "status_class", "method_code", "path_length", "path_depth", "path_tokens",
        "bytes_log1p", "request_time_log1p", "request_length_log1p",
    ),
    "features_time": feature_query("hour", "hour_sin", "hour_cos", "weekday", "is_weekend"),
    "features_text": feature_query(
        "referrer_hash", "user_agent_hash", "ip_hash", "path_template_hash", "user_length", "message_length"
    ),
    "features_flags": feature_query("has_query", "is_static", "has_user", "suspicious_path", "sql_keyword", "bot_ua"),
    "feature_scaler": query(
        "ev",
        "SELECT position::INTEGER AS position, feature, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, "
        "CASE WHEN stddev_pop(value) > 0 THEN round(stddev_pop(value), 5) ELSE 1 END AS scale "
        f"FROM ({feature_values()}) GROUP BY 1, 2",
    ),
    "scaled_features": query(
        "ev",
        "SELECT event_id, "
        + ", ".join(
            f"round((({FEATURES[n]})::DOUBLE - avg({FEATURES[n]}) OVER ()) / "
            f"CASE WHEN stddev_pop({FEATURES[n]}) OVER () > 0 THEN stddev_pop({FEATURES[n]}) OVER () ELSE 1 END, 4) AS {n}"
            for n in ("status_code", "path_length", "bytes_log1p", "hour", "request_length_log1p")
        )
        + " FROM ev",
    ),
    "baseline_model": query("cnt", "SELECT template, cnt FROM cnt"),
    "baseline_model_stats": query(
        "cnt", "SELECT sum(cnt)::BIGINT AS total, max(cnt) AS max_count, count(*) AS templates FROM cnt"
    ),
    "baseline_scores": query("sc", f"SELECT event_id, {r('score', 'anomaly_score')} FROM sc"),
    "baseline_scores_on_clean": query(
        "tpl",
        "SELECT t.event_id, round(1::DOUBLE - coalesce(c.cnt, 0)::DOUBLE / m.top, 6) AS anomaly_score FROM tpl t "
        "LEFT JOIN (SELECT template, count(*) AS cnt FROM tpl WHERE label = 'clean' GROUP BY 1) c USING (template), "
        "(SELECT max(cnt) AS top FROM (SELECT count(*) AS cnt FROM tpl WHERE label = 'clean' GROUP BY template)) m",
    ),
    "unseen_template_counts": query(
        "cnt",
        "SELECT template, cnt FROM cnt WHERE template NOT IN (SELECT template FROM tpl WHERE label = 'clean')",
    ),
    "score_stats": query(
        "sc",
        f"SELECT {r('avg(score)', 'score_mean')}, {r('stddev_pop(score)', 'score_std')}, "
        f"{r('quantile_cont(score, 0.90)', 'score_p90')}, {r('quantile_cont(score, 0.95)', 'score_p95')}, "
        f"{r('quantile_cont(score, 0.99)', 'score_p99')}, {r('quantile_cont(score, 0.95)', 'threshold')}, "
        "0.95::DOUBLE AS threshold_quantile, count(*) AS training_samples FROM sc",
    ),
    "baseline_anomalies": query(
        "sc",
        f"SELECT event_id, {r('score', 'anomaly_score')}, 'baseline' AS model_version FROM sc "
        "WHERE score >= (SELECT quantile_cont(score, 0.95) FROM sc)",
    ),
    "rule_hits": query("hits", "SELECT event_id, rule_no, rule, technique_id, confidence FROM hits"),
    "technique_ranked": query("ranked", "SELECT event_id, position, technique_id, name, tactic, confidence FROM ranked"),
    "technique_catalog_join": query(
        "hits", f"SELECT technique_id, name, tactic, rule, count(*) AS cnt FROM hits JOIN {CATALOG} USING (technique_id) GROUP BY 1, 2, 3, 4"
    ),
    "anomaly_table": query(
        "res ranked",
        "SELECT r.event_id, replace(strftime(event_ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || "
        "CASE WHEN epoch_us(event_ts) % 1000000 = 0 THEN '' ELSE strftime(event_ts, '.%f') END || '+00:00' AS timestamp, "
        "level, message, host, NULL::VARCHAR AS service, remote_addr, method, path, status, bytes_sent, "
        f"{r('score', 'anomaly_score')}, 'baseline' AS model_version, technique_ids FROM res r LEFT JOIN "
        "(SELECT event_id, string_agg(technique_id, ',' ORDER BY position) AS technique_ids FROM ranked GROUP BY 1) t USING (event_id) WHERE is_anomaly",
    ),
    "recent_anomaly_list": query(
        "res",
        "SELECT event_id, replace(strftime(event_ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || "
        "CASE WHEN epoch_us(event_ts) % 1000000 = 0 THEN '' ELSE strftime(event_ts, '.%f') END || '+00:00' AS timestamp, path, "
        f"{r('score', 'anomaly_score')} FROM (SELECT * FROM res WHERE is_anomaly ORDER BY event_ts DESC, event_id DESC LIMIT 1000) "
        "WHERE score >= 0.9 ORDER BY event_ts DESC, event_id DESC LIMIT 50",
    ),
    "running_summary": query(
        "res",
        "SELECT count(*) AS total_events, count_if(is_anomaly)::BIGINT AS anomalies, "
        f"{r('count_if(is_anomaly) / count(*)::DOUBLE', 'anomaly_rate')}, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') AS last_ingest FROM res",
    ),
    "ingest_summary": query(
        "res", "SELECT count(*) AS received, count_if(is_anomaly)::BIGINT AS anomalies, 'baseline' AS model_version FROM res"
    ),
    "last_ingest_time": "SELECT epoch_us(max(ts)) // 1000000 AS last_ingest_unix FROM events",
    "event_counters": query(
        "res",
        "SELECT 'dev' AS environment, count(*) AS events, count_if(is_anomaly)::BIGINT AS anomalies, "
        f"{r('count_if(is_anomaly) / count(*)::DOUBLE', 'anomaly_rate')} FROM res",
    ),
    "batch_anomaly_rates": query("batch", f"SELECT batch_id, events, anomalies, {r('anomaly_rate', 'anomaly_rate')} FROM batch"),
    "latest_batch_rate": query(
        "batch", f"SELECT batch_id, {r('anomaly_rate', 'anomaly_rate')} FROM batch ORDER BY batch_id DESC LIMIT 1"
    ),
    "status_classes": query(
        "log", "SELECT (status // 100)::VARCHAR || 'xx' AS status_class, count(*) AS cnt FROM log GROUP BY 1"
    ),
    "technique_total": query("tcnt", "SELECT coalesce(sum(cnt), 0)::BIGINT AS detections FROM tcnt"),
    "tactic_share": query(
        "tcnt",
        "SELECT tactic, sum(cnt)::BIGINT AS cnt, round(sum(cnt) * 100.0::DOUBLE / sum(sum(cnt)) OVER (), 6) AS percent FROM tcnt GROUP BY 1",
    ),
    "score_histogram": query("hist", "SELECT le, cumulative FROM hist"),
    "score_sum_count": query("res", f"SELECT {r('sum(score)', 'score_sum', 3)}, count(*) AS score_count FROM res"),
    "histogram_quantiles": query("hist", quantiles("hist")),
    "duration_histogram": query(
        "log",
        "SELECT le, count(*) FILTER (s <= le) AS cumulative FROM "
        f"(SELECT unnest({fv.DURATION_BOUNDS}::DOUBLE[] || ['inf'::DOUBLE]) AS le), "
        f"(SELECT round(sum(request_time) / 100, 6) AS s FROM log GROUP BY event_id // {fv.INGEST_BATCH_SIZE}) GROUP BY le",
    ),
    "metric_severity": query(
        "res tcnt hist batch",
        f"SELECT 'events_total' AS metric, '' AS label, events::DOUBLE AS value, {severity('events_total', 'events')} AS severity FROM {TOTALS} "
        f"UNION ALL SELECT 'anomalies_total', '', anomalies::DOUBLE, {severity('anomalies_total', 'anomalies')} FROM {TOTALS} "
        f"UNION ALL SELECT 'anomaly_rate', '', round(rate, 6), {severity('anomaly_rate', 'rate')} FROM {NEWEST} "
        f"UNION ALL SELECT 'technique_count', technique_id, cnt::DOUBLE, {severity('technique_count', 'cnt')} FROM tcnt "
        f"UNION ALL SELECT 'score_quantile', printf('%.2f', quantile), value, {severity('score_quantile', 'value')} FROM ({quantiles('hist')})",
    ),
    "metric_series": query(
        "log res tcnt hist batch",
        "SELECT 'log_events_total' AS metric, NULL::VARCHAR AS status_class, NULL::VARCHAR AS technique_id, NULL::VARCHAR AS tactic, "
        f"NULL::DOUBLE AS le, events::DOUBLE AS value FROM {TOTALS} "
        f"UNION ALL SELECT 'log_anomalies_total', NULL, NULL, NULL, NULL, anomalies::DOUBLE FROM {TOTALS} "
        f"UNION ALL SELECT 'log_anomaly_rate', NULL, NULL, NULL, NULL, round(rate, 3) FROM {NEWEST} "
        "UNION ALL SELECT 'log_last_ingest_timestamp', NULL, NULL, NULL, NULL, max(epoch_us(event_ts) // 1000000)::DOUBLE FROM res "
        "UNION ALL SELECT 'log_http_status_total', (status // 100)::VARCHAR || 'xx', NULL, NULL, NULL, count(*)::DOUBLE FROM res GROUP BY 2 "
        "UNION ALL SELECT 'log_mitre_technique_total', NULL, technique_id, tactic, NULL, cnt::DOUBLE FROM tcnt "
        "UNION ALL SELECT 'log_anomaly_score_bucket', NULL, NULL, NULL, le, cumulative::DOUBLE FROM hist "
        "UNION ALL SELECT 'log_anomaly_score_sum', NULL, NULL, NULL, NULL, round(sum(score), 3) FROM res "
        "UNION ALL SELECT 'log_anomaly_score_count', NULL, NULL, NULL, NULL, count(*)::DOUBLE FROM res "
        "UNION ALL SELECT 'log_ingest_duration_seconds_bucket', NULL, NULL, NULL, le, (count(*) FILTER (s <= le))::DOUBLE FROM "
        f"(SELECT unnest({fv.DURATION_BOUNDS}::DOUBLE[] || ['inf'::DOUBLE]) AS le), {DURATIONS} GROUP BY le "
        f"UNION ALL SELECT 'log_ingest_duration_seconds_sum', NULL, NULL, NULL, NULL, round(sum(s), 3) FROM {DURATIONS} "
        f"UNION ALL SELECT 'log_ingest_duration_seconds_count', NULL, NULL, NULL, NULL, count(s)::DOUBLE FROM {DURATIONS}",
    ),
    "event_rate_5m": query(
        "secs",
        sliding(
            "secs",
            "round(count(*) / 300.0::DOUBLE, 6) AS events_rate, round(count_if(NOT is_anomaly) / 300.0::DOUBLE, 6) AS normal_rate, "
            "round(count_if(is_anomaly) / 300.0::DOUBLE, 6) AS anomalies_rate",
        ),
    ),
    "status_rate_5m": query(
        "secs",
        sliding(
            "(SELECT bucket, (status // 100)::VARCHAR || 'xx' AS status_class FROM secs)",
            "round(count(*) / 300.0::DOUBLE, 6) AS cnt_rate",
            "status_class",
        ),
    ),
    "technique_rate_5m": query(
        "found",
        sliding(
            "(SELECT (epoch_us(event_ts) // 15000000) * 15 AS bucket, technique_id, tactic FROM found)",
            "round(count(*) / 300.0::DOUBLE, 6) AS cnt_rate",
            "technique_id, tactic",
        ),
    ),
    "score_quantiles_by_hour": query(
        "res bounds",
        quantiles(
            "(SELECT (epoch_us(event_ts) // 3600000000) * 3600 AS hour_start, le, count(*) FILTER (score <= le) AS cumulative "
            "FROM bounds, res GROUP BY 1, 2)",
            "hour_start",
        ),
    ),
    "label_totals": query(
        "lab",
        "SELECT sum(pos + neg)::BIGINT AS n_total, sum(neg)::BIGINT AS n_clean, sum(pos)::BIGINT AS n_attack FROM lab",
    ),
    "category_counts": query(
        "log", "SELECT substr(label, 8) AS category, count(*) AS total FROM log WHERE starts_with(label, 'attack:') GROUP BY 1"
    ),
    "confusion_at_threshold": query("cut", f"SELECT tp, fp, fn, tn, {RATIOS} FROM cut"),
    "score_by_class": query(
        "sc",
        f"SELECT CASE WHEN label = 'clean' THEN 'clean' ELSE 'attack' END AS class, {DISTRIBUTION} FROM sc GROUP BY 1",
    ),
    "roc_auc": query(
        "sc",
        "SELECT round((sum(rk) FILTER (pos = 1) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM "
        "(SELECT pos, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::DOUBLE AS rk, "
        "(sum(pos) OVER ())::DOUBLE AS p, (count(*) OVER ())::DOUBLE AS n FROM "
        "(SELECT score, CASE WHEN label = 'clean' THEN 0 ELSE 1 END AS pos FROM sc)) GROUP BY p, n",
    ),
    "roc_curve": query("roc", "SELECT round(threshold, 9) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc"),
    "youden_threshold": query(
        "roc",
        f"SELECT {r('threshold', 'threshold')}, {r('fpr', 'fpr')}, {r('tpr', 'tpr')}, {r('tpr - fpr', 'j')} FROM roc "
        "ORDER BY tpr - fpr DESC, roc.threshold DESC LIMIT 1",
    ),
    "f1_sweep": query(
        "sweep",
        f"SELECT {r('threshold', 'threshold')}, tp, fp, fn, tn, {r('precision', 'precision')}, {r('recall', 'recall')}, "
        f"{r('fpr', 'fpr')}, {r('accuracy', 'accuracy')}, {r('f1', 'f1')} FROM sweep",
    ),
    "best_f1_threshold": query(
        "sweep",
        f"SELECT round(CASE WHEN f1 > 0 THEN threshold ELSE {THRESHOLD} END, 6) AS threshold, {r('f1', 'f1')} "
        "FROM (SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1)",
    ),
    "sweep_report": query(
        "sweep",
        f"SELECT {r('threshold', 'threshold')}, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, {r('fpr', 'fpr')}, "
        f"CASE WHEN abs(s.threshold - 0.97) < 0.005 THEN 'BEST F1' WHEN abs(s.threshold - {THRESHOLD}) < 0.005 THEN 'TRAIN' ELSE '' END AS marker "
        f"FROM sweep s WHERE s.threshold % 0.05::DOUBLE < 0.005 OR abs(s.threshold - 0.97) < 0.005 OR abs(s.threshold - {THRESHOLD}) < 0.005",
    ),
    "category_recall": query(
        "sc",
        f"SELECT substr(label, 8) AS category, count(*) AS total, count_if(score >= {THRESHOLD})::BIGINT AS detected_best, "
        f"count_if(score >= 0.97)::BIGINT AS detected_youden, {r(f'count_if(score >= {THRESHOLD}) * 100.0 / count(*)', 'recall_best')}, "
        f"{r('count_if(score >= 0.97) * 100.0 / count(*)', 'recall_youden')} FROM sc WHERE label <> 'clean' GROUP BY 1",
    ),
    "anomaly_share": query(
        "res",
        f"SELECT count_if(is_anomaly)::BIGINT AS anomalies, {r('count_if(is_anomaly) * 100.0 / count(*)', 'percent')} FROM res",
    ),
    "score_ranks": query(
        "sc",
        "SELECT round(score, 9) AS anomaly_score, n, (sum(n) OVER (ORDER BY score) - n)::BIGINT AS n_before, "
        "(sum(n) OVER ())::BIGINT AS n_total FROM (SELECT score, count(*) AS n FROM sc GROUP BY 1)",
    ),
    "template_sample": query("tmpl", "SELECT event_id, path, template_no FROM tmpl"),
    "labelled_mix": query(
        "ev attack",
        f"SELECT event_id, 'clean' AS label, method, path, status, user_agent, {pick('event_id', 7, 1000003)} AS mix_order FROM ev "
        "UNION ALL SELECT event_id, label, method, path, status, user_agent, mix_order FROM attack",
    ),
    "attack_categories": query("attack", "SELECT label, status, count(*) AS cnt FROM attack GROUP BY 1, 2"),
    "labelled_scan": query("ev", "SELECT label, level, count(*) AS cnt FROM ev GROUP BY 1, 2"),
    "plain_export": query("plain", "SELECT event_id, value FROM plain"),
    "jsonl_export": query(
        "ev",
        "SELECT event_id, replace(strftime(event_ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || "
        "CASE WHEN epoch_us(event_ts) % 1000000 = 0 THEN '' ELSE strftime(event_ts, '.%f') END || '+00:00' AS timestamp, "
        "host, remote_addr, remote_user, path, status::VARCHAR AS status, message, level, "
        f"{r('request_time', 'request_time')}, 18 AS keys FROM ev",
    ),
    "iforest_sample_sizes": "SELECT unnest(range(200))::INTEGER AS tree, least(count(*), 256)::INTEGER AS size FROM events",
    "stream_rate": query("secs", sliding("secs", "round(count(*) / 300.0::DOUBLE, 6) AS cnt_rate")),
    "stream_status_counters": query(
        "log", "SELECT (status // 100)::VARCHAR || 'xx' AS status_class, count(*) AS cnt FROM log GROUP BY 1"
    ),
    "stream_score_quantiles": query(
        "res bounds",
        quantiles(
            "(SELECT (epoch_us(event_ts) // 300000000) * 300 AS window_start, le, count(*) FILTER (score <= le) AS cumulative "
            "FROM bounds, res GROUP BY 1, 2)",
            "window_start",
        ),
    ),
}

# Reports on re-parsed plain lines repeat the model on the parsed columns.
PARTS["ptpl"] = (
    "parsed",
    "SELECT *, upper(coalesce(method, 'UNKNOWN')) || '|' || (status // 100)::VARCHAR || '|' || "
    f"CASE WHEN {path_template('path')} <> '' THEN {path_template('path')} ELSE {message_template('message')} END AS template FROM parsed",
)
PARTS["pcnt"] = ("ptpl", "SELECT template, count(*) AS cnt FROM ptpl GROUP BY 1")
PARTS["pres"] = (
    "pcnt",
    f"SELECT t.*, 1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM pcnt) >= {THRESHOLD} AS is_anomaly FROM ptpl t JOIN pcnt c USING (template)",
)
PARTS["phits"] = (
    "pres",
    "SELECT DISTINCT event_id, u.technique_id FROM "
    f"(SELECT event_id, unnest([{RULE_LIST.replace('(path,', chr(40) + 'coalesce(path, ' + quoted('') + '),')}]) AS u FROM pres WHERE is_anomaly) WHERE u.hit",
)
PARTS["good"] = ("ptpl", "SELECT * FROM ptpl WHERE event_id % 97 <> 0")
PARTS["gcnt"] = ("good", "SELECT template, count(*) AS cnt FROM good GROUP BY 1")
ORACLES["lines_to_top_techniques"] = query(
    "phits",
    f"SELECT technique_id, tactic, count(*) AS cnt FROM phits JOIN {CATALOG} USING (technique_id) GROUP BY 1, 2 {TOP20}",
)
ORACLES["parse_rejects_by_file"] = query(
    "broken gcnt",
    "SELECT coalesce(b.file, 'total') AS file, count(g.event_id) AS received, "
    f"count_if(1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM gcnt) >= {THRESHOLD})::BIGINT AS anomalies, "
    "count(*) - count(g.event_id) AS skipped_lines FROM broken b LEFT JOIN good g USING (event_id) "
    "LEFT JOIN gcnt c USING (template) GROUP BY ROLLUP (b.file)",
)
ORACLES["stream_ingest"] = query(
    "pres",
    "SELECT count(*) AS received, count_if(is_anomaly)::BIGINT AS anomalies, 0::BIGINT AS skipped, "
    "count_if(is_anomaly)::BIGINT AS stored FROM pres",
)
PARTS["feat"] = ("ev", "SELECT event_id, label, " + ", ".join(f"({FEATURES[name]})::DOUBLE AS {name}" for name in fv.FEATURE_NAMES) + " FROM ev")


def forest_query(select: str, **options: int) -> str:
    """A statement over the forest's sub-queries."""
    log = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name][1]})" for name in needed("feat"))
    return f"WITH {log},\n" + ",\n".join(forest_parts(**options)) + f"\n{select}"


LEVEL = 1.0 - fv.FOREST_CONTAMINATION
ORACLES["iforest_nodes"] = forest_query(
    f"SELECT tree::INTEGER AS tree, node::INTEGER AS node, feature::INTEGER AS feature, {r('threshold', 'threshold')}, size::INTEGER AS size, "
    f"{r('path_length', 'path_length')} FROM nodes", trees=20)
ORACLES["iforest_scores"] = forest_query(f"SELECT event_id, {r('score', 'anomaly_score')} FROM scored")
ORACLES["iforest_training"] = forest_query(
    f"SELECT {r('avg(score)', 'score_mean')}, {r('stddev_pop(score)', 'score_std')}, "
    f"{r('quantile_cont(score, 0.90)', 'score_p90')}, {r('quantile_cont(score, 0.95)', 'score_p95')}, "
    f"{r('quantile_cont(score, 0.99)', 'score_p99')}, {r(f'quantile_cont(score, {LEVEL})', 'threshold')}, "
    f"{LEVEL}::DOUBLE AS threshold_quantile, count(*) AS training_samples FROM scored")
ORACLES["iforest_auc"] = forest_query(
    "SELECT round((sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auc FROM ("
    "SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ("
    "SELECT score, count_if(label <> 'clean') AS pos, count_if(label = 'clean') AS neg FROM scored JOIN feat USING (event_id) GROUP BY 1))")
ORACLES["iforest_registered"] = forest_query(
    f"SELECT count(*) AS received, count_if(score >= t)::BIGINT AS anomalies, 'iforest' AS model_version, {r('any_value(t)', 'threshold')}, "
    f"{r('avg(score)', 'score_mean')}, count(*) AS training_samples FROM scored, (SELECT quantile_cont(score, {LEVEL}) AS t FROM scored)", trees=20)
ORACLES["stream_recent"] = query(
    "pres",
    "SELECT replace(strftime(event_ts, '%Y-%m-%d %H:%M:%S'), ' ', 'T') || '+00:00' AS timestamp, path, "
    f"{r('score', 'anomaly_score')} FROM (SELECT * FROM (SELECT t.*, 1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM pcnt) AS score "
    f"FROM pres t JOIN pcnt c USING (template) WHERE is_anomaly) ORDER BY event_ts DESC, path DESC, score DESC LIMIT {fv.MAX_STORED_ANOMALIES}) "
    "WHERE score >= 0.9 ORDER BY event_ts DESC, path DESC, score DESC LIMIT 50",
)
ORACLES["stream_summary"] = query(
    "pres",
    "SELECT count(*) AS total_events, count_if(is_anomaly)::BIGINT AS anomalies, "
    f"{r('count_if(is_anomaly) / count(*)::DOUBLE', 'anomaly_rate')}, 1::BIGINT AS empty_batches, "
    "count_if(event_id % 97 = 0)::BIGINT AS skipped, true AS time_of_last_event_batch FROM pres",
)
ORACLES["file_batches"] = query(
    "plain",
    "SELECT host, batch_id, count(*) AS lines, arg_min(value, n) AS first_line, arg_max(value, n) AS last_line FROM ("
    f"SELECT file AS host, value, n, n // {fv.INGEST_BATCH_SIZE} AS batch_id FROM ("
    "SELECT *, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS n FROM plain)) GROUP BY 1, 2",
)
ORACLES["training_scan"] = query(
    "broken",
    "SELECT unnest(['baseline', 'isolation_forest']) AS model_type, training_samples, skipped_lines FROM (SELECT "
    "count_if(event_id % 97 <> 0)::BIGINT AS training_samples, count_if(event_id % 97 = 0)::BIGINT AS skipped_lines FROM broken)",
)
ORACLES["labelled_set_files"] = query(
    "ev attack",
    "SELECT set_file, label, status, count(*) AS cnt FROM ("
    "SELECT unnest(['clean', 'mixed']) AS set_file, 'clean' AS label, status FROM ev "
    "UNION ALL SELECT unnest(['attacks', 'mixed']), label, status FROM attack) GROUP BY ALL",
)
ORACLES["duration_quantiles_5m"] = query(
    "log",
    quantiles(
        "(SELECT window_start, le, count(*) FILTER (s <= le) AS cumulative FROM "
        f"(SELECT unnest({fv.DURATION_BOUNDS}::DOUBLE[] || ['inf'::DOUBLE]) AS le), "
        "(SELECT (epoch_us(taken) // 15000000) * 15 - o AS window_start, s FROM "
        f"(SELECT max(event_ts) AS taken, round(sum(request_time) / 100, 6) AS s FROM log GROUP BY event_id // {fv.INGEST_BATCH_SIZE}), "
        "(SELECT unnest(range(0, 300, 15)) AS o)) GROUP BY 1, 2)",
        "window_start",
    ),
)
ORACLES["strict_file_scan"] = query("log", "SELECT method, status, count(*) AS cnt FROM log GROUP BY 1, 2")
ORACLES["file_line_counts"] = query("broken", "SELECT count(*) AS lines FROM broken")
ORACLES["multi_file_ingest"] = query(
    "broken gcnt",
    "SELECT count(g.event_id) AS received, count_if(score >= threshold)::BIGINT AS anomalies, "
    "count(*) - count(g.event_id) AS skipped_lines, count_if(score >= threshold)::BIGINT AS stored "
    "FROM broken b LEFT JOIN (SELECT event_id, 1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM gcnt) AS score "
    "FROM good JOIN gcnt c USING (template)) g USING (event_id), "
    "(SELECT quantile_cont(1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM gcnt), 0.95) AS threshold FROM good JOIN gcnt c USING (template))",
)
ORACLES["posted_ingest"] = query(
    "ptpl pcnt",
    "SELECT count(*) AS received, count_if(score >= threshold)::BIGINT AS anomalies, true AS registered_version, "
    "count_if(score >= threshold)::BIGINT AS stored FROM (SELECT *, quantile_cont(score, 0.95) OVER () AS threshold FROM ("
    "SELECT 1::DOUBLE - c.cnt::DOUBLE / (SELECT max(cnt) FROM pcnt) AS score FROM ptpl JOIN pcnt c USING (template)))",
)


def ratios_at(threshold: str) -> str:
    """Confusion counts and ratios at a threshold given by a sub-query."""
    sides = ", ".join(
        f"coalesce(sum({side}) FILTER (score {sign} {threshold}), 0)::DOUBLE AS {name}"
        for name, side, sign in (("tp", "pos", ">="), ("fp", "neg", ">="), ("fn", "pos", "<"), ("tn", "neg", "<"))
    )
    return (
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ("
        "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, "
        f"CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (SELECT {sides} FROM lab))"
    )


def tall(section: str, measures: str, source: str, item: str = "''") -> str:
    """Rows of a table as (section, item, measure, value)."""
    pairs = ", ".join(f"{{'measure': '{name}', 'value': ({name})::DOUBLE}}" for name in measures.split())
    return (
        f"SELECT '{section}' AS section, item, u.measure, round(u.value, 6) AS value FROM ("
        f"SELECT {item} AS item, unnest([{pairs}]) AS u FROM ({source}))"
    )


PARTS["train"] = ("sc", "SELECT quantile_cont(score, 0.95) AS threshold FROM sc")
PARTS["best"] = (
    "sweep train",
    "SELECT CASE WHEN f1 > 0 THEN s.threshold ELSE t.threshold END AS threshold, f1 FROM "
    "(SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1) s, train t",
)
PARTS["youden"] = (
    "roc", "SELECT threshold, fpr, tpr, tpr - fpr AS j FROM roc ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1",
)
CONFUSION = "tp fp fn tn precision recall fpr accuracy f1"
SWEEP_ITEM = "concat_ws(' ', printf('%.2f', threshold), nullif(marker, ''))"
ORACLES["validation_report"] = query(
    "best youden",
    " UNION ALL ".join([
        tall("totals", "n_total n_clean n_attack", "SELECT sum(pos + neg) AS n_total, sum(neg) AS n_clean, sum(pos) AS n_attack FROM lab"),
        tall("categories", "total", "SELECT substr(label, 8) AS category, count(*) AS total FROM sc WHERE starts_with(label, 'attack:') GROUP BY 1", "category"),
        tall("distribution", "n mean std min p50 p95 p99 max",
             f"SELECT CASE WHEN label = 'clean' THEN 'clean' ELSE 'attack' END AS class, {DISTRIBUTION} FROM sc GROUP BY 1", "class"),
        tall("at_train_threshold", CONFUSION, ratios_at("(SELECT threshold FROM train)")),
        tall("auc", "auc", "SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM ("
             "SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM lab)"),
        tall("sweep", "threshold tp fp fn tn precision recall fpr accuracy f1",
             "SELECT * FROM (SELECT s.*, CASE WHEN abs(s.threshold - b.threshold) < 0.005 THEN 'BEST F1' "
             "WHEN abs(s.threshold - t.threshold) < 0.005 THEN 'TRAIN' ELSE '' END AS marker FROM sweep s, best b, train t) "
             "WHERE marker <> '' OR threshold % 0.05::DOUBLE < 0.005", SWEEP_ITEM),
        tall("best_f1", "threshold f1", "SELECT * FROM best"),
        tall("youden", "threshold fpr tpr j", "SELECT * FROM youden"),
        tall("at_best_f1", CONFUSION, ratios_at("(SELECT threshold FROM best)")),
        tall("at_youden", CONFUSION, ratios_at("(SELECT threshold FROM youden)")),
        tall("category_recall", "total detected_best detected_youden recall_best recall_youden",
             "SELECT *, detected_best * 100.0 / total AS recall_best, detected_youden * 100.0 / total AS recall_youden FROM ("
             "SELECT substr(label, 8) AS category, count(*)::DOUBLE AS total, count_if(score >= (SELECT threshold FROM best))::DOUBLE AS detected_best, "
             "count_if(score >= (SELECT threshold FROM youden))::DOUBLE AS detected_youden FROM sc WHERE starts_with(label, 'attack:') GROUP BY 1)", "category"),
    ]),
)
