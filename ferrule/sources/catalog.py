"""The rule catalog: kind, class, effort, hint and published sources of each rule."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules that scan results refer to, in order of their ids.
# id, kind, classification, least and most hours, basis, hint
RULES = [
    ("VBS-100", "scriptFile", "review", 0.25, 1.0, "fixed", "notCheckable"),
    ("VBS-101", "scriptFile", "breaks", 1.0, 4.0, "scriptSize", "rewriteScript"),
    ("VBS-102", "scriptFile", "breaks", 1.0, 4.0, "scriptSize", "rewriteScript"),
    ("VBS-103", "scriptFile", "breaks", 1.0, 4.0, "scriptSize", "rewriteScript"),
    ("VBS-104", "scriptFile", "breaks", 2.0, 8.0, "scriptSize", "scriptComponent"),
    ("VBS-105", "scriptFile", "breaks", 4.0, 16.0, "scriptSize", "htmlApplication"),
    ("VBS-200", "scriptInvocation", "review", 0.25, 1.0, "fixed", "notCheckable"),
    ("VBS-201", "scriptInvocation", "breaks", 0.25, 1.0, "entry", "callingScript"),
    ("VBS-202", "scriptInvocation", "review", 0.25, 1.0, "fixed", "unknownLanguage"),
    ("VBS-211", "shortcut", "breaks", 0.1, 0.5, "entry", "shortcut"),
    ("VBS-212", "shortcut", "review", 0.1, 0.5, "fixed", "unknownLanguage"),
    ("VBS-300", "scheduledTask", "review", 0.25, 1.0, "fixed", "notCheckable"),
    ("VBS-301", "scheduledTask", "breaks", 0.5, 2.0, "entry", "scheduledTask"),
    ("VBS-302", "scheduledTask", "review", 0.25, 1.0, "fixed", "unknownLanguage"),
    ("VBS-311", "autostart", "breaks", 0.25, 1.0, "entry", "autostart"),
    ("VBS-312", "autostart", "review", 0.25, 1.0, "fixed", "unknownLanguage"),
    ("VBS-321", "service", "breaks", 1.0, 4.0, "entry", "service"),
    ("VBS-322", "service", "review", 0.5, 2.0, "fixed", "unknownLanguage"),
    ("VBS-331", "wmiSubscription", "breaks", 1.0, 4.0, "entry", "wmiSubscription"),
    ("VBS-332", "wmiSubscription", "review", 0.5, 2.0, "fixed", "unknownLanguage"),
    ("VBS-341", "logonScript", "breaks", 1.0, 4.0, "entry", "logonScript"),
    ("VBS-342", "logonScript", "review", 0.5, 2.0, "fixed", "unknownLanguage"),
    ("VBS-400", "msiCustomAction", "review", 0.5, 2.0, "fixed", "notCheckable"),
    ("VBS-401", "msiCustomAction", "breaks", 2.0, 8.0, "fixed", "installerPackage"),
    ("VBS-402", "msiCustomAction", "review", 0.5, 2.0, "fixed", "installerPackage"),
    ("VBS-500", "eventLogUsage", "review", 0.25, 1.0, "fixed", "notCheckable"),
    ("VBS-501", "eventLogUsage", "breaks", 0.5, 2.0, "fixed", "loggedUse"),
    ("VBS-502", "eventLogUsage", "breaks", 0.5, 2.0, "fixed", "loggedUse"),
    ("VBS-503", "eventLogUsage", "review", 0.5, 2.0, "fixed", "engineLoaded"),
    ("VBS-600", "officeMacro", "review", 0.25, 1.0, "fixed", "notCheckable"),
    ("VBS-601", "officeMacro", "breaks", 0.5, 2.0, "fixed", "regExp"),
    ("VBS-611", "officeMacro", "breaks", 1.0, 4.0, "fixed", "scriptControl"),
    ("VBS-612", "officeMacro", "review", 0.5, 2.0, "fixed", "scriptControl"),
    ("VBS-621", "officeMacro", "breaks", 0.5, 2.0, "entry", "macroStartsScript"),
    ("VBS-622", "officeMacro", "review", 0.25, 1.0, "fixed", "unknownLanguage"),
    ("VBS-632", "officeMacro", "review", 0.25, 2.0, "fixed", "wshObjects"),
    ("VBS-901", "hardcodedCredential", "review", 0.5, 2.0, "fixed", "credentials"),
]
# Published sources of the rules (id, publisher, title, address, checked on), and which of them each rule rests on.
SOURCES = [
    ("ms-deprecated-features", "Microsoft", "Deprecated features for Windows client", "https://learn.microsoft.com/en-us/windows/whats-new/deprecated-features", "2026-09-26"),
    ("ms-vbscript-timeline", "Microsoft", "VBScript deprecation: Timelines and next steps (Windows IT Pro Blog)", "https://techcommunity.microsoft.com/blog/windows-itpro-blog/vbscript-deprecation-timelines-and-next-steps/4148301", "2026-09-26"),
    ("ms-vbscript-detection", "Microsoft", "VBScript deprecation: Detection strategies for Windows (Windows IT Pro Blog)", "https://techcommunity.microsoft.com/blog/windows-itpro-blog/vbscript-deprecation-detection-strategies-for-windows/4414325", "2026-09-26"),
    ("ms-vbscript-status-2026-09", "Microsoft", "Windows Insiders – State of VBScript deprecation – September 2026 (Microsoft Community Hub)", "https://techcommunity.microsoft.com/discussions/windowsserverinsiders/blog-windows-insiders---state-of-vbscript-deprecation---september-2026/4525768", "2026-09-26"),
    ("ms-wscript-command", "Microsoft", "wscript (Windows commands)", "https://learn.microsoft.com/en-us/windows-server/administration/windows-commands/wscript", "2026-09-26"),
    ("ms-wsh-script-element", "Microsoft", "<script> Element (Windows Script Host)", "https://learn.microsoft.com/en-us/previous-versions/windows/internet-explorer/ie-developer/windows-scripting/dzfdccyf(v=vs.84)", "2026-09-26"),
    ("ms-script-encoder", "Microsoft", "Script Encoder Syntax", "https://learn.microsoft.com/en-us/previous-versions/windows/internet-explorer/ie-developer/windows-scripting/xw61tsx7(v=vs.84)", "2026-09-26"),
    ("ms-hta", "Microsoft", "Introduction to HTML Applications (HTAs)", "https://learn.microsoft.com/en-us/previous-versions/ms536496(v=vs.85)", "2026-09-26"),
    ("ms-task-exec", "Microsoft", "Exec (actionGroup) Element – Task Scheduler Schema", "https://learn.microsoft.com/en-us/windows/win32/taskschd/taskschedulerschema-exec-actiongroup-element", "2026-09-26"),
    ("ms-run-keys", "Microsoft", "Run and RunOnce Registry Keys", "https://learn.microsoft.com/en-us/windows/win32/setupapi/run-and-runonce-registry-keys", "2026-09-26"),
    ("ms-wmi-activescript", "Microsoft", "ActiveScriptEventConsumer class", "https://learn.microsoft.com/en-us/windows/win32/wmisdk/activescripteventconsumer", "2026-09-26"),
    ("ms-gpscr-scripts-ini", "Microsoft", "[MS-GPSCR]: Scripts.ini Syntax", "https://learn.microsoft.com/en-us/openspecs/windows_protocols/ms-gpscr/ff1fd13e-1e18-4160-9b50-0263e108e5e1", "2026-09-26"),
    ("ms-msi-ca-types", "Microsoft", "Summary List of All Custom Action Types (Windows Installer)", "https://learn.microsoft.com/en-us/windows/win32/msi/summary-list-of-all-custom-action-types", "2026-09-26"),
    ("ms-msi-ca-type-6", "Microsoft", "Custom Action Type 6 (Windows Installer)", "https://learn.microsoft.com/en-us/windows/win32/msi/custom-action-type-6", "2026-09-26"),
    ("ms-msi-ca-return", "Microsoft", "Custom Action Return Processing Options (Windows Installer)", "https://learn.microsoft.com/en-us/windows/win32/msi/custom-action-return-processing-options", "2026-09-26"),
    ("ms-sysmon", "Microsoft", "Sysmon (Sysinternals)", "https://learn.microsoft.com/en-us/sysinternals/downloads/sysmon", "2026-09-26"),
    ("ms-vba-vbscript", "Microsoft", "Prepare your VBA projects for VBScript deprecation in Windows (Microsoft 365 Developer Blog)", "https://devblogs.microsoft.com/microsoft365dev/how-to-prepare-vba-projects-for-vbscript-deprecation/", "2026-09-26"),
    ("ms-script-control", "Microsoft", "Adding a ScriptControl (Visual Basic 6.0 documentation)", "https://learn.microsoft.com/en-us/previous-versions/visualstudio/visual-studio-6.0/aa227400(v=vs.60)", "2026-09-26"),
    ("ms-execscript", "Microsoft", "execScript method (Internet Explorer platform APIs)", "https://learn.microsoft.com/en-us/previous-versions/windows/internet-explorer/ie-developer/platform-apis/aa741364(v=vs.85)", "2026-09-26"),
    ("ms-ovba", "Microsoft", "[MS-OVBA]: Office VBA File Format Structure", "https://learn.microsoft.com/en-us/openspecs/office_file_formats/ms-ovba/575462ba-bf67-4190-9fac-c275523c75fc", "2026-09-26"),
    ("ms-offcrypto", "Microsoft", "[MS-OFFCRYPTO]: Office Document Cryptography Structure", "https://learn.microsoft.com/en-us/openspecs/office_file_formats/ms-offcrypto/3c34d72a-1a61-4b52-a893-196f9157f083", "2026-09-26"),
    ("mitre-cwe-798", "MITRE", "CWE-798: Use of Hard-coded Credentials", "https://cwe.mitre.org/data/definitions/798.html", "2026-09-26"),
]
# when a source was published, of those that tell
PUBLISHED = {"ms-vbscript-timeline": "2024-05-22", "ms-vba-vbscript": "2025-09-10"}
RULE_SOURCES = {
    "VBS-100": ("ms-vbscript-timeline",),
    "VBS-101": ("ms-deprecated-features", "ms-vbscript-timeline",),
    "VBS-102": ("ms-deprecated-features", "ms-vbscript-timeline", "ms-script-encoder",),
    "VBS-103": ("ms-deprecated-features", "ms-vbscript-timeline", "ms-wsh-script-element",),
    "VBS-104": ("ms-deprecated-features", "ms-vbscript-timeline", "ms-wsh-script-element",),
    "VBS-105": ("ms-deprecated-features", "ms-vbscript-timeline", "ms-hta",),
    "VBS-200": ("ms-vbscript-timeline",),
    "VBS-201": ("ms-deprecated-features", "ms-vbscript-timeline", "ms-wscript-command",),
    "VBS-202": ("ms-wsh-script-element", "ms-hta",),
    "VBS-211": ("ms-deprecated-features", "ms-vbscript-timeline", "ms-wscript-command",),
    "VBS-212": ("ms-wsh-script-element", "ms-hta",),
    "VBS-300": ("ms-vbscript-timeline",),
    "VBS-301": ("ms-vbscript-detection", "ms-task-exec", "ms-vbscript-timeline",),
    "VBS-302": ("ms-task-exec", "ms-wsh-script-element",),
    "VBS-311": ("ms-run-keys", "ms-vbscript-timeline",),
    "VBS-312": ("ms-run-keys", "ms-wsh-script-element",),
    "VBS-321": ("ms-vbscript-detection", "ms-vbscript-timeline",),
    "VBS-322": ("ms-wsh-script-element",),
    "VBS-331": ("ms-wmi-activescript", "ms-vbscript-timeline",),
    "VBS-332": ("ms-wmi-activescript", "ms-wsh-script-element",),
    "VBS-341": ("ms-gpscr-scripts-ini", "ms-vbscript-detection", "ms-vbscript-timeline",),
    "VBS-342": ("ms-gpscr-scripts-ini", "ms-wsh-script-element",),
    "VBS-400": ("ms-vbscript-detection",),
    "VBS-401": ("ms-vbscript-detection", "ms-msi-ca-types", "ms-msi-ca-type-6",),
    "VBS-402": ("ms-msi-ca-return", "ms-msi-ca-types",),
    "VBS-500": ("ms-vbscript-detection",),
    "VBS-501": ("ms-vbscript-status-2026-09", "ms-vbscript-timeline",),
    "VBS-502": ("ms-vbscript-detection", "ms-sysmon",),
    "VBS-503": ("ms-vbscript-detection", "ms-sysmon",),
    "VBS-600": ("ms-vba-vbscript", "ms-offcrypto", "ms-ovba",),
    "VBS-601": ("ms-vba-vbscript", "ms-vbscript-timeline",),
    "VBS-611": ("ms-script-control", "ms-execscript", "ms-deprecated-features", "ms-vbscript-timeline",),
    "VBS-612": ("ms-script-control", "ms-execscript",),
    "VBS-621": ("ms-vba-vbscript", "ms-wscript-command", "ms-vbscript-timeline",),
    "VBS-622": ("ms-wsh-script-element", "ms-hta",),
    "VBS-632": ("ms-vba-vbscript", "ms-vbscript-timeline",),
    "VBS-901": ("mitre-cwe-798",),
}
# Kinds in the order of reports, activations from the weakest, other closed vocabularies.
# Modules with their id, the source of their system part, the rules that they report,
# the rule for what they can't check, and whether a whole result needs administrator rights.
MODULES = [
    ("script-file", None, ("VBS-101", "VBS-102", "VBS-103", "VBS-104", "VBS-105", "VBS-901"), "VBS-100", False),
    ("script-invocation", None, ("VBS-201", "VBS-202", "VBS-901"), "VBS-200", False),
    ("shortcut", None, ("VBS-211", "VBS-212", "VBS-901"), "VBS-200", False),
    ("scheduled-task", "tasks.scheduled", ("VBS-301", "VBS-302", "VBS-901"), "VBS-300", True),
    ("autostart", "autostart.entries", ("VBS-311", "VBS-312", "VBS-901"), "VBS-300", True),
    ("service", "services.configuration", ("VBS-321", "VBS-322", "VBS-901"), "VBS-300", False),
    ("wmi-subscription", "wmi.subscriptions", ("VBS-331", "VBS-332", "VBS-901"), "VBS-300", True),
    ("logon-script", "policies.scripts", ("VBS-341", "VBS-342", "VBS-901"), "VBS-300", False),
    ("event-log-deprecation-alert", "eventLog.vbscriptDeprecation", ("VBS-501",), "VBS-500", False),
    ("event-log-sysmon", "eventLog.sysmon", ("VBS-502", "VBS-503", "VBS-901"), "VBS-500", True),
    ("msi-custom-action", "installer.packages", ("VBS-401", "VBS-402", "VBS-901"), "VBS-400", True),
    ("office-macro", None, ("VBS-601", "VBS-611", "VBS-612", "VBS-621", "VBS-622", "VBS-632", "VBS-901"), "VBS-600", False),
]

KINDS = (
    "scriptFile", "scriptInvocation", "shortcut", "scheduledTask", "autostart", "service",
    "wmiSubscription", "logonScript", "msiCustomAction", "eventLogUsage", "officeMacro", "hardcodedCredential",
)
ACTIVATION_RANK = {"dormant": 1, "installer": 2, "manual": 3, "macro": 4, "logged": 5, "automatic": 6}
UNKNOWN_ACTIVATION_RANK = 3
CLASSIFICATIONS = ("breaks", "review")
STATUSES = ("detected", "notCheckable")
REASONS = ("passwordProtected", "accessDenied", "locked", "corrupt", "unsupportedFormat", "tooLarge", "cloudPlaceholder", "encrypted", "networkLocation", "internalError")
LOCATIONS = ("file", "registry", "scheduledTask", "service", "wmi", "eventLog", "msiPackage")
COVERAGE_MODES = ("full", "limited")
SOURCE_STATUSES = ("complete", "partial", "skipped", "unavailable", "failed")
LIMITATIONS = ("notElevated", "systemSourcesSkipped", "fileScopeRestricted", "sourceIncomplete", "unsupportedPlatform")
BASES = ("fixed", "scriptSize", "entry")
#: Of rules that the catalog doesn't have.
UNKNOWN_EFFORT = (0.25, 1.0)

SCHEMA = "rule string, rule_kind string, rule_class string, min_hours double, max_hours double, basis string, hint string, sources array<string>"


def rules(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The catalog as a table of a few dozen rows."""
    return spark.createDataFrame([(*r[:7], list(r[7]) if len(r) > 7 else list(RULE_SOURCES.get(r[0], ()))) for r in (rows or RULES)], SCHEMA)


def rule_sources(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """What is published about each rule: rule, place (from 0), publisher, title, url, checked, published (null where it isn't known)."""
    known = spark.createDataFrame([(*s, PUBLISHED.get(s[0])) for s in SOURCES], "id string, publisher string, title string, url string, checked string, published string")
    each = rules(spark, rows).select("rule", F.posexplode("sources").alias("place", "id"))
    return each.join(F.broadcast(known), "id").select("rule", F.col("place").cast("long").alias("place"), "publisher", "title", "url", "checked", "published")  # two dozen rows


def load(path: str) -> list[tuple]:
    """Rules of a catalog file, checked."""
    return parse(Path(path).read_text(encoding="utf-8"))


def parse(text: str) -> list[tuple]:
    """Rules of a catalog in JSON.  A ValueError tells the first invariant that doesn't hold."""
    data = json.loads(text)
    if data.get("formatVersion") != 1:
        raise ValueError("formatVersion is not 1")
    sources = [s["id"] for s in data["sources"]]
    if len(set(sources)) != len(sources):
        raise ValueError("source ids are not unique")
    out, seen = [], set()
    for r in data["rules"]:
        name, effort = r["id"], r["effort"]
        if len(name) != 7 or not name.startswith("VBS-") or not name[4:].isdigit():
            raise ValueError(f"{name}: not a rule id")
        if name in seen:
            raise ValueError(f"{name}: not unique")
        seen.add(name)
        if r["kind"] not in KINDS or r["classification"] not in CLASSIFICATIONS:
            raise ValueError(f"{name}: unknown kind or classification")
        if not r["sources"] or not set(r["sources"]) <= set(sources):
            raise ValueError(f"{name}: no sources, or unknown ones")
        if not 0 < effort["minHours"] <= effort["maxHours"] or effort.get("basis", "fixed") not in BASES:
            raise ValueError(f"{name}: effort out of range")
        if name.endswith("00") and r["classification"] != "review":
            raise ValueError(f"{name}: what can't be checked is to be reviewed")
        out.append((name, r["kind"], r["classification"], float(effort["minHours"]), float(effort["maxHours"]), effort.get("basis", "fixed"), r["hint"], tuple(r["sources"])))
    if [r[0] for r in out] != sorted(r[0] for r in out):
        raise ValueError("rules are not in order")
    return out


def modules(spark: SparkSession) -> DataFrame:
    """A row a module: module, system_source, rules, fallback_rule, needs_admin."""
    rows = [(name, source, list(own), fallback, admin) for name, source, own, fallback, admin in MODULES]
    return spark.createDataFrame(rows, "module string, system_source string, rules array<string>, fallback_rule string, needs_admin boolean")


def module_rules(spark: SparkSession) -> DataFrame:
    """(rule, module): the modules that report each rule, also for what they can't check."""
    return modules(spark).select("module", F.explode(F.array_union("rules", F.array("fallback_rule"))).alias("rule")).select("rule", "module")
