"""Values the rules depend on.

Everything in this file is a fixed value: names, orders, limits, patterns and
wording that results are compared against. No logic lives here.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- severities -----------------------------------------------------------
# Secrets say "medium", vulnerabilities say "moderate".
SECRET_SEVERITIES = ["critical", "high", "medium", "low"]
VULN_SEVERITIES = ["critical", "high", "moderate", "low"]
SEVERITY_RANK = {"low": 1, "medium": 2, "moderate": 2, "high": 3, "critical": 4}
LOG_LEVEL_RANK = {"debug": 0, "info": 1, "warn": 2, "error": 3, "silent": 4}


# --- secret patterns ------------------------------------------------------
@dataclass(frozen=True)
class SecretPattern:
    """One named pattern; ``regex`` is in the Java dialect."""

    name: str
    regex: str
    severity: str
    description: str = ""
    entropy: float | None = None


# The built-in pattern pack.
DEFAULT_PATTERNS = [
    SecretPattern("AWS Access Key", r"AKIA[0-9A-Z]{16}", "critical",
                  "Cloud access key id", 2.5),
    SecretPattern("GitHub Token", r"gh[pousr]_[A-Za-z0-9]{36}", "high",
                  "Source host token", 2.5),
    SecretPattern("Stripe Secret Key", r"sk_live_[0-9a-zA-Z]{24,}", "high",
                  "Payment live key", 2.5),
    SecretPattern("Generic Secret Assignment",
                  r"""(?i)(?:token|secret|api[_-]?key|password)\s*[:=]\s*["'][^"'\s]{8,}["']""",
                  "medium", "Quoted value assigned to a secret-like name", 2.5),
]

# The high-entropy detector.
TOKEN_REGEX = r"[A-Za-z0-9+/_=-]{20,}"
TOKEN_PATTERN_NAME = "High Entropy String"
TOKEN_SEVERITY = "low"
ENTROPY_THRESHOLD = 3.5

# Characters of a line that a finding shows: so many before the hit, and so many from its start on.
CONTEXT_BEFORE, CONTEXT_AFTER = 200, 400

DEFAULT_INCLUDE = ["**/*"]
DEFAULT_EXCLUDE = ["node_modules/**"]

# --- commits and versions -------------------------------------------------
# Patterns.
COMMIT_REGEX = r"^(\w+)(?:\(([^)]+)\))?(!)?:\s*(.+)$"
COMMIT_PREFIX_REGEX = r"^[^:]+:\s*"
BREAKING_MARK = "BREAKING CHANGE"
DEFAULT_COMMIT_TYPE = "chore"
VERSION_REGEX = r"^\d+\.\d+\.\d+(-[a-zA-Z0-9.-]+)?(\+[a-zA-Z0-9.-]+)?$"
SOURCE_SUFFIXES = [".ts", ".js"]

# Bump names by strength, and the sentence put before a reason.
BUMP_BY_RANK = {0: "none", 1: "patch", 2: "minor", 3: "major"}
REASON_PREFIX = {
    "breaking": "Breaking change: ",
    "features": "New feature: ",
    "fixes": "Bug fix: ",
}
CHANGELOG_SECTIONS = ["breaking", "features", "fixes", "docs", "chore"]
CHANGELOG_TITLES = {
    "breaking": "### ⚠️ Breaking Changes",
    "features": "### ✨ Features",
    "fixes": "### 🐛 Fixes",
    "docs": "### 📚 Documentation",
    "chore": "### 🔧 Chores",
}

# Confidence points.
CONFIDENCE_BASE = 50
CONFIDENCE_BREAKING = 20
CONFIDENCE_FEATURES = 15
CONFIDENCE_FIXES = 10
CONFIDENCE_NO_REASON = -30

# --- licences -------------------------------------------------------------
# Project licence -> licences it may depend on.
LICENSE_COMPATIBILITY = {
    "MIT": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"],
    "Apache-2.0": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"],
    "GPL-2.0": ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"],
    "GPL-3.0": ["GPL-3.0", "LGPL-3.0"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL-3.0", "MIT", "Apache-2.0"],
    "LGPL-3.0": ["LGPL-3.0", "MIT", "Apache-2.0"],
    "BSD-2-Clause": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"],
    "BSD-3-Clause": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"],
    "ISC": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"],
    "Unlicense": ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"],
}

# Spelling -> SPDX id, where the two differ.
LICENSE_ALIASES = {
    "Apache 2.0": "Apache-2.0",
    "Apache License 2.0": "Apache-2.0",
    "GPLv2": "GPL-2.0",
    "GPLv3": "GPL-3.0",
    "BSD": "BSD-3-Clause",
}
UNKNOWN_LICENSES = ["UNKNOWN", "undefined"]

# Lists of the registry licence audit.
AUDIT_ALLOWED_LICENSES = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0",
    "Unlicense", "WTFPL", "Zlib", "0BSD", "CC-BY-4.0", "CC-BY-SA-4.0",
]
AUDIT_RESTRICTED_LICENSES = [
    "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
    "AGPL-1.0", "AGPL-3.0", "MPL-1.0", "MPL-1.1", "MPL-2.0",
]

# --- vulnerability audit --------------------------------------------------
# Raw severity -> level; anything else is "moderate".
SEVERITY_ALIASES = {
    "critical": "critical",
    "high": "high",
    "moderate": "moderate",
    "medium": "moderate",
    "low": "low",
    "info": "low",
}
SCORE_WEIGHTS = {"critical": 20, "high": 10, "moderate": 5, "low": 1}
SCORE_BANDS = [(90, "🟢"), (70, "🟡"), (50, "🟠")]
SCORE_BAND_FLOOR = "🔴"
NO_DESCRIPTION = "No description available"
AUDIT_CACHE_SECONDS = 3600

# Recommendation wording.
VULN_SENTENCES = {
    "critical": "🚨 CRITICAL: Update packages with critical vulnerabilities immediately",
    "high": "🔴 HIGH: Update packages with high severity vulnerabilities as soon as possible",
    "moderate": "🟠 MEDIUM: Consider updating packages with medium severity vulnerabilities",
    "fixable": "📦 Update these packages to fix vulnerabilities: ",
    "unfixable": "⚠️ Monitor these packages for security updates: ",
    "clean": "✅ No vulnerabilities found - keep dependencies updated regularly",
}
LICENSE_SENTENCES = {
    "incompatible": " packages have incompatible licenses",
    "unknown": " packages have unknown or missing license information",
    "blocked": "🔴 Replace packages with blocked licenses: ",
    "investigate": "🔍 Investigate packages with unknown licenses: ",
    "clean": "✅ All package licenses are compatible with your project",
}
LICENSE_AUDIT_SENTENCES = {
    "incompatible": "⚠️ Found {} packages with incompatible licenses",
    "review": "Review and replace incompatible dependencies",
    "unknown": "❓ Found {} packages with unknown licenses",
    "verify": "Manually verify license compatibility",
    "clean": "✅ All dependencies have compatible licenses",
}
LICENSE_UNAVAILABLE = "License information not available"
LICENSE_MISSING = "License information is missing or unknown"

# --- monitoring -----------------------------------------------------------
# Alert thresholds, in the unit of the metric.
ALERT_THRESHOLDS = {"cpu": 80.0, "memory": 80.0, "disk": 80.0, "responseTime": 1000.0}
ALERT_CRITICAL_FACTOR = 1.5
METRIC_INTERVAL = "30 seconds"
METRIC_RETENTION_DAYS = 30
METRIC_CAPACITY = 10_000
HEAP_WARNING_BYTES = 500 * 1024 * 1024
HEAP_CRITICAL_BYTES = 1024 * 1024 * 1024
PERFORMANCE_START = {
    "response_time": 0.0,
    "throughput": 0.0,
    "error_rate": 0.0,
    "availability": 100.0,
}

# --- deployments ----------------------------------------------------------
# The default environments and strategies.
ENVIRONMENTS = [
    ("development", "development", "recreate", True, []),
    ("staging", "staging", "blue-green", False, ["dev-lead"]),
    ("production", "production", "canary", False, ["dev-lead", "ops-lead"]),
]
STRATEGIES = ["recreate", "rolling", "blue-green", "canary"]

# --- test runs ------------------------------------------------------------
# Default frameworks and environments.
TEST_FRAMEWORKS = ["jest", "cypress"]
TEST_ENVIRONMENTS = ["local", "docker"]

# --- trackers -------------------------------------------------------------
# Priorities and labels per tracker.
TRACKER_TOP_PRIORITY = {"linear": "Urgent", "jira": "Highest"}
PRIORITY_RANK = {"Highest": 4, "Urgent": 4, "High": 3, "Medium": 2, "Low": 1}
ISSUE_LABELS = {
    "security": ["security", "vulnerability"],
    "dependency": ["dependency", "audit"],
    "license": ["license", "compliance"],
}
TOOL_NAME = "release-guard"

# --- gates ----------------------------------------------------------------
# Warning limits and risk cut-offs.
MAX_PACKAGE_BYTES = 10 * 1024 * 1024
MAX_DIRECT_DEPENDENCIES = 100
RISK_CUTOFFS = [(6, "critical"), (4, "high"), (2, "medium")]
EVENT_ICONS = {"publish": "📦", "scan": "🔐", "unpublish": "⛔"}
EVENT_ICON_DEFAULT = "ℹ️"
