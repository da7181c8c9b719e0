"""Fixed values.

Everything in this module is a fixed value: word lists, lookup tables, patterns,
thresholds and texts that have to be exactly these for results to be right.
"""

# --- log line patterns -------------------------------------------------------
DEFAULT_PATTERNS = (
    r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (?P<level>ERROR|WARN|INFO|DEBUG) (?P<message>.+)",
    r"(?P<timestamp>\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (?P<level>\w+) (?P<message>.+)",
)

ACCESS_LOG_PATTERN = (
    r"^(?P<ip_address>\S+) \S+ \S+ \[(?P<timestamp>[^\]]+)\] "
    r'"(?P<http_method>\S+) (?P<url>\S+) (?P<protocol>\S+)" '
    r"(?P<status>\d+) (?P<size>\d+|-) "
    r'"(?P<referrer>[^"]*)" "(?P<user_agent>[^"]*)"'
)

STANDARD_FIELDS = ("timestamp", "level", "message", "line_number")
LEVEL_NO_GROUP = "UNKNOWN"
LEVEL_NO_MATCH = "UNPARSED"

# --- severity maps: (values, upper-case first?, default) ---------------------
SEVERITY_MAPS = {
    "core": (
        {"CRITICAL": 5, "ERROR": 4, "WARN": 3, "WARNING": 3, "INFO": 2, "DEBUG": 1},
        True,
        0,
    ),
    "extended": (
        {
            "CRITICAL": 5, "FATAL": 5, "ERROR": 4, "WARN": 3, "WARNING": 3,
            "INFO": 2, "DEBUG": 1, "TRACE": 1,
        },
        True,
        0,
    ),
    "five_level": (
        {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4},
        False,
        1,
    ),
    "four_level": ({"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}, False, 1),
    "csv": ({"DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4}, False, None),
}

# --- message patterns --------------------------------------------------------
FLAG_PATTERNS = {
    "has_numbers": r"\d",
    "has_special_chars": r'[!@#$%^&*()_+\-=\[\]{};:"\\|,.<>\?]',
    "has_ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "has_url": r"http[s]?://",
    "has_email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
}

VALIDITY_PATTERNS = {
    "timestamp": r"^\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}:\d{2}$",
    "log_level": r"^(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "alphanumeric": r"^[a-zA-Z0-9_\-\s]*$",
}

# Applied to the lower-cased message in this order.
TEMPLATE_STEPS = (
    (r"\d{4}-\d{2}-\d{2}", "<DATE>"),
    (r"\d{2}:\d{2}:\d{2}", "<TIME>"),
    (r"\d+\.\d+\.\d+\.\d+", "<IP>"),
    (r"\b\d+\b", "<NUMBER>"),
    (r"[^\w\s<>]", " "),
    (r"\s+", " "),
)

# First list with a keyword in the lower-cased message wins.
EVENT_TYPE_KEYWORDS = (
    ("ERROR_TYPE", ("error", "exception", "fail")),
    ("WARN_TYPE", ("warning", "warn")),
    ("START_TYPE", ("start", "begin", "init")),
    ("END_TYPE", ("end", "finish", "complete")),
)
EVENT_TYPE_DEFAULT = "INFO_TYPE"

ERROR_KEYWORDS = (
    "error", "fail", "exception", "critical", "timeout",
    "invalid", "denied", "refused", "abort", "crash",
)
LABEL_KEYWORDS = ("exception", "critical", "timeout", "crash", "fail")
AUTH_KEYWORDS = ("auth", "login", "fail")
SECURITY_KEYWORDS = ("security", "auth", "access")

MAX_MESSAGE_LENGTH = 10_000
TRUNCATION_MARK = "...[TRUNCATED]"
MAX_FILE_BYTES = 100 * 1024 * 1024
ALLOWED_EXTENSIONS = ("log", "txt")

DAY_NAMES = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
)

# --- alert and report texts --------------------------------------------------
ALERT_TAG_KEYWORDS = (
    ("database", ("database",)),
    ("network", ("network",)),
    ("authentication", ("auth", "login")),
    ("performance", ("performance",)),
)
ALERT_ACTIONS = {
    "CRITICAL": ("Investigate immediately", "Check system status", "Review recent changes"),
    "WARNING": ("Monitor for patterns", "Schedule investigation", "Review logs around this time"),
    "INFO": ("Log for future analysis", "Check if part of known pattern"),
}
RISK_DESCRIPTIONS = {
    "HIGH": "Significant number of anomalies detected. Immediate investigation recommended.",
    "MEDIUM": "Moderate anomaly levels detected. Regular monitoring advised.",
    "LOW": "Low anomaly levels indicate normal system operation.",
}
SUMMARY_ADVICE = {
    "HIGH": (
        "HIGH PRIORITY: Investigate system stability - anomaly rate exceeds 10%",
        "Review error handling and monitoring systems",
        "Consider implementing automated alerting",
    ),
    "MEDIUM": (
        "MEDIUM PRIORITY: Monitor system trends",
        "Review top anomalies for patterns",
    ),
    "LOW": ("LOW PRIORITY: System appears stable", "Continue routine monitoring"),
}
ERROR_RATE_ADVICE = "Review ERROR level logs for recurring issues"
EXECUTIVE_ADVICE = {
    "HIGH": (
        "Immediate investigation of detected anomalies",
        "Consider implementing additional monitoring",
        "Review system capacity and performance",
    ),
    "MEDIUM": (
        "Regular monitoring of system logs",
        "Schedule detailed analysis of anomaly patterns",
        "Update alerting thresholds as needed",
    ),
    "LOW": (
        "Continue regular monitoring",
        "Maintain current alerting configuration",
        "Periodic review of detection parameters",
    ),
}
EXECUTIVE_ADVICE_ALWAYS = "Consider implementing automated response procedures"
FINDING_MONITORING = "Investigate root cause and implement additional controls"
FINDING_ERRORS = "Review error handling procedures and implement preventive measures"
COMPLIANCE_ADVICE = (
    "Implement continuous monitoring of log anomalies",
    "Establish baseline patterns for normal system behavior",
    "Regular review and update of detection thresholds",
    "Document incident response procedures",
    "Conduct periodic security assessments",
)
TIME_ADVICE_SEASONAL = "Consider time-based alerting thresholds due to strong daily patterns"
TIME_ADVICE_GROWTH = "Log volume is increasing - consider capacity planning"
TIME_ADVICE_ALWAYS = "Establish baseline patterns for more accurate anomaly detection"

SLA_TARGETS = {"availability": 99.9, "response_time_p95": 5.0, "error_rate": 0.1}
METRIC_THRESHOLDS = {"memory": (80.0, 90.0), "cpu": (85.0, 95.0), "disk": (85.0, 95.0)}
THROUGHPUT_RATINGS = (
    (100_000, "excellent"), (50_000, "very_good"), (10_000, "good"), (1_000, "fair"),
)

# Names of growth classes, by how time rises with size.
GROWTH_CLASSES = {
    "linear": "O(n) - Linear",
    "linearithmic": "O(n log n) - Linearithmic",
    "quadratic": "O(n²) - Quadratic",
    "more": "O(n³+) - Polynomial or worse",
}

# Titles of alerts and warnings of the notification.
TITLE_ERROR = "Error Detected in {level} Log"
TITLE_EXCEPTION = "Exception Detected"
TITLE_FAILURE = "Failure Detected"
TITLE_OTHER = "Anomalous {level} Log Detected"
WARNING_HIGH = "HIGH ANOMALY RATE DETECTED - Immediate investigation recommended"
WARNING_ELEVATED = "ELEVATED ANOMALY RATE - Monitor closely"

# Sentences of the time findings and of the compliance findings.
TIME_PEAK_HOUR = "Peak activity occurs at {}:00 hours"
TIME_PEAK_DAY = "Highest log volume on {}"
TIME_TREND = "Overall trend: {}"
TIME_HOURLY = "Strong hourly seasonality detected"
TIME_WEEKLY = "Weekly pattern identified"
TIME_ADVICE_HOUR = "Monitor system closely around {}:00 hours"
FINDING_RATE = "High anomaly rate detected: %.2f%%"
FINDING_ERROR_RATE = "High error rate detected: %d errors in %d logs"
