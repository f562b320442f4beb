r"""Line patterns of the log rules. Results depend on every character; find semantics, first match.

Both ``java.util.regex`` and RE2 read them alike.
"""

ISO = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?)"
SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
WARN = r"(?i)\bWARN(?:ING)?\b"
METHOD_PATH = r"(?i)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/[\w/{}.\-:]*)"
STATUS_LABELLED = r'(?i)(?:status|http_status|response|code)[=:\s"]+(\d{3})\b'
STATUS_HTTP = r'(?i)HTTP/\d\.\d"?\s+(\d{3})\b'
LATENCY_LABELLED = r"(?i)(?:duration|latency|took|elapsed|responsetime|response_time|time)[=:\s]+(\d+)\s?ms"
LATENCY_BARE = r"(?i)\b(\d+)\s?ms\b"
QUERY = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b|\bexecuting query\b|\bhibernate:\b"
DEADLOCK = r"(?i)deadlock"
TIMEOUT = r"(?i)(?:query|statement|lock)\s*timeout|timeout.*(?:query|statement|sql)|SQLTimeoutException"
POOL = r"(?i)connection\s*pool|HikariPool|pool.*exhaust|unable to acquire.*connection|connection is not available"
FAILURE = r"(?i)SQLException|SQLState|constraint violation|could not (?:execute|extract|prepare)|ORA-\d+|duplicate key"
SLOW = r"(?i)slow query|slow sql"
QUERY_LATENCY = r"(?i)(?:query|sql|statement|db)[^\n]{0,40}?(\d+)\s?ms"
ERROR_LEVEL = r"(?i)\b(ERROR|FATAL|SEVERE)\b"
FATAL_LEVEL = r"(?i)\b(FATAL|SEVERE)\b"
EXCEPTION = r"\b([\w.$]+(?:Exception|Error|Throwable))\b"
FRAME = r"^\s*at\s+([\w.$]+\.[\w$<>]+)\s*\("
UNAUTHORIZED = r"(?i)\b401\b|unauthorized"
FORBIDDEN = r"(?i)\b403\b|forbidden|access denied"
AUTH_FAIL = r"(?i)authentication failed|auth(?:entication)? failure|bad credentials|invalid (?:password|credentials)|login failed"
TOKEN_EXPIRED = r"(?i)token (?:has )?expired|expired (?:jwt|token)|jwt expired|ExpiredJwtException"
GC_PAUSE = r"(?i)(?:gc|garbage collect)[^\n]{0,60}?(\d+(?:\.\d+)?)\s?ms|pause[^\n]{0,20}?(\d+(?:\.\d+)?)\s?ms"
OOM = r"(?i)OutOfMemoryError|out of memory|OOMKilled|heap space|GC overhead limit"
MEMORY_WARN = r"(?i)memory (?:usage )?(?:high|warning|pressure)|low (?:free )?memory|heap (?:usage )?(?:high|above)"
THREAD_POOL = r"(?i)thread[\s_-]?pool.*(?:satur|exhaust|full|reject)|task rejected|rejectedexecution|queue (?:is )?full|no available threads"
STARTUP = r"(?i)started \w+ in \d|starting \w+Application|tomcat started|jvm running|application startup|springapplication"
SHUTDOWN = r"(?i)shutting down|shutdown initiated|graceful shutdown|stopping \w+Application|jvm shutting down"
DEPLOY = r"(?i)deploy(?:ing|ed|ment)|new version|rolling out|release \d"
CONFIG_RELOAD = r"(?i)config(?:uration)? (?:reload|refresh|chang)|refreshing (?:context|configuration)|reloaded properties"
HEALTH_FAIL = r"(?i)health[\s_-]?check (?:failed|down)|liveness (?:probe )?failed|readiness (?:probe )?failed|status\s*[=:]\s*DOWN"
REQUEST = r"(?i)\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/|\bHTTP/\d\.\d\b|incoming request|request received"
RECORD_START = r"^\s*(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
