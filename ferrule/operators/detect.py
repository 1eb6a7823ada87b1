"""Detectors: contents of files and entries of systems -> findings.

A detector is a function of one file or entry that returns findings; each is
registered with the rules it can report.  Files pass through Python in Arrow
batches once, for all detectors of their extension; a detector that fails on a
file leaves one finding that says so, and the others' findings.
"""

from __future__ import annotations

import hashlib
import json
import ntpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import command, markup, masking, paths, script, text
from ..functions.remembered import remembered
from ..runtime import materialize, ship
from ..sources import catalog

SCHEMA = (
    "rule string, kind string, classification string, status string, reason string, activation string, loc_kind string, loc_path string, loc_item string, target string, "
    "file_size long, sha256 string, evidence array<struct<line int, text string, masked boolean>>, details string"
)
RULES = {r[0]: r for r in catalog.RULES}
MOST_SCRIPT, MOST_CONTENT, MOST_TASK, MOST_LINK = 16 << 20, 64 << 20, 4 << 20, 1 << 20
CREDENTIALS, UNREADABLE = "VBS-901", "VBS-300"


@dataclass
class Finding:
    """One finding under way: evidence is masked, counted and shortened as it comes."""

    rule: str
    loc_path: str
    loc_kind: str = "file"
    loc_item: str | None = None
    activation: str = "dormant"
    target: str | None = None
    reason: str | None = None
    kind: str | None = None
    file_size: int | None = None
    sha256: str | None = None
    evidence: list[dict] = field(default_factory=list)
    details: dict = field(default_factory=dict)

    def show(self, line: int | None, value: str) -> Finding:
        masked, kinds = masking.mask_line(text.clean(value))
        if len(self.evidence) < text.EVIDENCE_LINES:
            self.evidence.append({"line": line, "text": text.shorten(masked.strip()), "masked": bool(kinds)})
        else:
            self.details["evidenceOmitted"] = self.details.get("evidenceOmitted", 0) + 1
        return self

    def row(self) -> tuple:
        _, kind, klass, *_ = RULES[self.rule]
        status = "notCheckable" if self.reason else "detected"
        return (self.rule, self.kind or kind, klass, status, self.reason, self.activation, self.loc_kind, self.loc_path, self.loc_item, self.target, self.file_size, self.sha256, self.evidence, json.dumps(self.details, sort_keys=True))


def credentials(code: list[tuple[int | None, str]], **where) -> list[Finding]:
    """One finding for all lines that hold secrets."""
    out, kinds, n = Finding(CREDENTIALS, **where), set(), 0
    for line, value in code:
        _, found = masking.mask_line(value)
        if found:
            kinds.update(found)
            n += len(found)
            out.show(line, value)
    if not n:
        return []
    out.details |= {"secrets": n, "kinds": ",".join(sorted(kinds))}
    return [out]


def file_activation(path: str) -> str:
    """Startup and script folders run by themselves."""
    p = path.replace("/", "\\").lower()
    marks = ("\\start menu\\programs\\startup\\", "\\grouppolicy\\machine\\scripts\\", "\\grouppolicy\\user\\scripts\\", "\\netlogon\\")
    return "automatic" if any(m in p for m in marks) or ("\\sysvol\\" in p and "\\scripts\\" in p) else "dormant"


def file_activation_column(path) -> Column:
    p = F.lower(F.translate(F.col(path) if isinstance(path, str) else path, "/", "\\"))
    known = p.rlike(r"\\start menu\\programs\\startup\\|\\grouppolicy\\(machine|user)\\scripts\\|\\netlogon\\") | (p.contains("\\sysvol\\") & p.contains("\\scripts\\"))
    return F.when(known, "automatic").otherwise("dormant")


@dataclass
class File:
    path: str
    content: bytes
    size: int

    @property
    def extension(self) -> str:
        return text.extension(self.path) or ""

    def where(self) -> dict:
        return {"loc_path": self.path, "activation": file_activation(self.path), "file_size": self.size, "sha256": hashlib.sha256(self.content).hexdigest()}


Detector = Callable[[File], list[Finding]]
DETECTORS: dict[str, list[tuple[Detector, str]]] = {}
NAMED: dict[str, list[tuple[Detector, str]]] = {}
MOST: dict[Detector, int] = {}


def detector(*extensions: str, names: tuple[str, ...] = (), fallback: str, most: int = MOST_CONTENT):
    """Registers a detector for extensions and file names; `fallback` is the rule for what it can't check, such as files of more than `most` bytes."""

    def add(f: Detector) -> Detector:
        MOST[f] = most
        for e in extensions:
            DETECTORS.setdefault(e, []).append((f, fallback))
        for n in names:
            NAMED.setdefault(n, []).append((f, fallback))
        return f

    return add


_SCRIPT_RULES = {"vbs": "VBS-101", "vbe": "VBS-102", "wsf": "VBS-103", "wsc": "VBS-104", "hta": "VBS-105"}


@detector(*_SCRIPT_RULES, fallback="VBS-100", most=MOST_SCRIPT)
def script_files(file: File) -> list[Finding]:
    if text.is_servicing_data(file.content):
        return []
    found = script.analyze(file.extension, text.decode(file.content))
    if not found.vbscript:
        return []
    out = Finding(_SCRIPT_RULES[file.extension], target=found.external, **file.where())
    for line, value in (found.markers + script.evidence(found.lines))[:8]:
        out.show(line, value)
    if found.encoded:
        out.details["encoded"] = True
    if found.blocks:
        out.details["vbscriptBlocks"] = found.blocks
    return [out, *credentials(found.lines, **file.where())]


@detector("bat", "cmd", "ps1", "kix", fallback="VBS-200", most=MOST_SCRIPT)
def invocations(file: File) -> list[Finding]:
    if text.is_servicing_data(file.content):
        return []
    code = script.code_lines(text.decode(file.content), script.LANGUAGES[file.extension])
    used = [(n, line, command.analyze(line)) for n, line in code]
    out = []
    for usage, rule in ((command.VBSCRIPT, "VBS-201"), (command.UNKNOWN, "VBS-202")):
        calls = [(n, line, min((r for r in refs if r.usage == usage), key=lambda r: r.script is None)) for n, line, refs in used if command.strongest(refs) == usage]
        if calls:
            f = Finding(rule, target=calls[0][2].script, **file.where())
            f.details = {"via": calls[0][2].via, "calls": len(calls)}
            for n, line, _ in calls:
                f.show(n, line)
            out.append(f)
    return out + (credentials(code, **file.where()) if out else [])


def read_ini(content: str) -> list[tuple[str, int, str, str]]:
    """(section, index, command line, parameters) of a Group Policy script list."""
    out: dict[tuple[str, int], dict] = {}
    section = ""
    for line in text.lines(content):
        line = line.strip().lstrip("﻿")
        if m := re.fullmatch(r"\[(.+)\]", line):
            section = m[1].strip()
        elif m := re.match(r"(\d+)(CmdLine|Parameters)\s*=\s*(.*)$", line, re.I):
            out.setdefault((section, int(m[1])), {})[m[2].lower()] = m[3].strip()
    return [(s, i, v["cmdline"], v.get("parameters", "")) for (s, i), v in sorted(out.items()) if v.get("cmdline")]


@detector(names=("scripts.ini", "psscripts.ini"), fallback="VBS-341", most=MOST_SCRIPT)
def policy_scripts(file: File) -> list[Finding]:
    out = []
    for section, index, program, parameters in read_ini(text.decode(file.content)):
        where = {"loc_path": file.path, "loc_item": f"{section} {index}", "activation": "automatic", "file_size": file.size, "sha256": hashlib.sha256(file.content).hexdigest()}
        out += report_command(f"{program} {parameters}".strip(), command.analyze_parts(program, parameters), ("VBS-341", "VBS-342"), where)
    return out


@dataclass
class Called:
    """What follow_calls() found behind a command."""

    path: str
    usage: str | None = None
    script: str | None = None
    via: str | None = None
    number: int | None = None
    line: str | None = None
    reason: str | None = None


def report_command(line: str, uses: list[command.Reference], rules: tuple[str, str], where: dict, details: dict | None = None, called: Called | None = None) -> list[Finding]:
    """A finding for the strongest use of a command, or of the script that it calls, and one for secrets in it.

    A command of no use whose called script can't be read is not checkable.
    """
    own = command.strongest(uses)
    within = called.usage if called else None
    usage = command.VBSCRIPT if command.VBSCRIPT in (own, within) else own or within
    if usage is None:
        if called and called.reason:
            return [Finding(UNREADABLE, kind=RULES[rules[0]][1], reason=called.reason, target=called.path, details=dict(details or {}), **where).show(None, line)]
        return []
    f = Finding(rules[0] if usage == command.VBSCRIPT else rules[1], **where)
    f.show(None, line)
    if own == usage:
        best = min((r for r in uses if r.usage == usage), key=lambda r: r.script is None)
        f.target, f.details = best.script, {"via": best.via}
    else:
        f.target, f.details = called.path, {"via": "script", "calledScriptStarts": called.script or called.via}
        f.show(None, f"{text.base_name(called.path)}:{called.number}: {called.line}")
    f.details |= details or {}
    return [f, *credentials([(None, line)], **where)]


@dataclass
class Task:
    enabled: bool = True
    triggers: list[str] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)


def parse_task(content: str) -> Task | None:
    """A task definition; None if it isn't one."""
    tags = markup.tags(content)
    if not any(t.named("Task") and not t.closing for t in tags):
        return None
    task, within, action = Task(), set(), None
    for i, tag in enumerate(tags):
        name = tag.local
        if name in ("Triggers", "Settings"):
            (within.discard if tag.closing else within.add)(name)
        elif name == "Exec":
            if tag.closing and action is not None:
                task.actions.append(action)
            action = None if tag.closing else {"Command": "", "Arguments": "", "WorkingDirectory": None}
        elif tag.closing:
            continue
        elif name in ("Command", "Arguments", "WorkingDirectory") and action is not None:
            action[name] = markup.text_after(content, tags, i) or ("" if name != "WorkingDirectory" else None)
        elif name == "Enabled" and "Settings" in within and "Triggers" not in within:
            task.enabled = markup.text_after(content, tags, i).lower() != "false"
        elif "Triggers" in within and name.endswith("Trigger"):
            kind = name.removesuffix("Trigger").lower()
            if kind not in task.triggers:
                task.triggers.append(kind)
    return task


@remembered
def _parsed(content: bytes) -> Task | None:
    return parse_task(text.decode(content))


def inspect_task(path: str, content: bytes) -> list[tuple]:
    """Actions of a task: item, activation, line as shown and as analysed, folder, details, reason."""
    task = _parsed(content)
    if task is None:
        return [(path, None, "dormant", None, None, None, None, "corrupt")]
    out = []
    for n, a in enumerate(task.actions, 1):
        line = f"{a['Command']} {a['Arguments']}" if a["Arguments"] else a["Command"]
        program = a["Command"].strip().strip('"')
        details = {"enabled": task.enabled} | ({"triggers": ",".join(task.triggers)} if task.triggers else {})
        item = f"action {n}" if len(task.actions) > 1 else None
        out.append((path, item, "automatic" if task.enabled else "dormant", line, f'"{program}" {a["Arguments"]}' if " " in program else line, a["WorkingDirectory"], json.dumps(details), None))
    return out


def _safely(inspect, path: str, content: bytes) -> list[tuple]:
    """One definition must not stop the others."""
    try:
        return inspect(path, content)
    except Exception:
        return [(path, None, "dormant", None, None, None, None, "internalError")]


def _rows(batch: pd.DataFrame, inspect) -> pd.DataFrame:
    rows = [(*key, *f.row()) for key, f in inspect(batch)]
    return pd.DataFrame(rows, columns=["load_idx", "source", *[c.split()[0] for c in re.split(r", (?![^<]*>)", SCHEMA)]])


def _inspect_files(batch: pd.DataFrame):
    for load_idx, path, content, size, problem in zip(batch["load_idx"], batch["path"], batch["content"], batch["size"], batch["problem"], strict=True):
        name = text.base_name(path).lower()
        chosen = DETECTORS.get(text.extension(path) or "", []) + NAMED.get(name, [])
        for f, fallback in chosen:
            key = (load_idx, f.__name__)
            try:
                if why := problem or ("tooLarge" if size > MOST.get(f, MOST_CONTENT) else None):
                    found = [Finding(fallback, loc_path=path, reason=why, file_size=size)]
                else:
                    found = f(File(path, bytes(content), int(size)))
            except Exception:  # one file must not stop the others
                found = [Finding(fallback, loc_path=path, reason="internalError", file_size=size)]
            for x in found:
                yield key, x


def detect_files(files: DataFrame, cache: str | None = None) -> DataFrame:
    r"""Findings of files: load_idx, path, content binary, size long, problem string (why it can't be read, else null).

    Only files that a detector knows reach Python.  A rule that doesn't exist
    for what can't be checked takes the kind of its fallback.  Packages in the
    folder `cache` (C:\Windows\Installer) are left to system.installed_packages().
    """
    from . import binary_detectors  # noqa: F401  (registers its detectors)

    ship(files.sparkSession)
    known = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1).isin(*DETECTORS) | F.regexp_extract(F.lower("path"), r"([^\\/]+)$", 1).isin(*NAMED)
    large = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("size") > MOST_CONTENT, F.lit("tooLarge"))
    if cache is not None:
        folder = F.regexp_extract(paths.normalize("path"), r"^(.*)\\[^\\]*\.msi$", 1)
        known &= ~F.coalesce(folder == paths.normalize(F.lit(cache)), F.lit(False))
    some = files.where(known).select("load_idx", "path", F.when(large.isNull(), F.col("content")).alias("content"), "size", large.alias("problem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from . import binary_detectors  # noqa: F401

        for batch in batches:
            yield _rows(batch, _inspect_files)

    return some.mapInPandas(run, f"load_idx long, source string, {SCHEMA}")


def detect_tasks(files: DataFrame, scripts: DataFrame | None = None, variables: DataFrame | None = None) -> DataFrame:
    """Findings of task definitions: load_idx, path (of the task), content, problem.

    Definitions are read whole; one of more than 4 MiB is reported as not checkable (tooLarge).
    With `scripts`, calls are followed as in detect_commands().
    """

    def actions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for load_idx, path, content, problem in batch.itertuples(index=False):
                found = [(path, None, "dormant", None, None, None, None, problem)] if problem else _safely(inspect_task, path, bytes(content))
                rows += [(load_idx, *x) for x in found]
            yield pd.DataFrame(rows, columns=["load_idx", "loc_path", "loc_item", "activation", "line", "analysed", "folder", "details", "reason"])

    ship(files.sparkSession)
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.length("content") > MOST_TASK, F.lit("tooLarge"))
    some = files.select("load_idx", "path", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))
    found = some.mapInPandas(actions, "load_idx long, loc_path string, loc_item string, activation string, line string, analysed string, folder string, details string, reason string")
    if scripts is not None:
        found = materialize(found, "actions")  # read twice from here on, parsed once
    rules = {"loc_kind": F.lit("scheduledTask"), "breaks": F.lit("VBS-301"), "review": F.lit("VBS-302"), "source": F.lit("tasks")}
    return _report(found.withColumns(rules), scripts, variables)


def commands(entries: DataFrame, breaks: str, review: str, source: str) -> DataFrame:
    """Command lines with the rules that they can break, as detect_lines() takes them."""
    folder = F.col("folder") if "folder" in entries.columns else F.lit(None).cast("string")
    rules = [F.lit(breaks).alias("breaks"), F.lit(review).alias("review"), F.lit(source).alias("source")]
    return entries.where("line is not null").select("load_idx", "loc_kind", "loc_path", "loc_item", "activation", "line", folder.alias("folder"), "details", *rules)


def detect_lines(lines: DataFrame, files: DataFrame | None = None, variables: DataFrame | None = None) -> DataFrame:
    """Findings of commands(), of one or more sources."""
    return _report(lines.withColumns({"analysed": F.col("line"), "details": F.to_json("details"), "reason": F.lit(None).cast("string")}), files, variables)


def detect_commands(entries: DataFrame, breaks: str, review: str, source: str, files: DataFrame | None = None, variables: DataFrame | None = None) -> DataFrame:
    """Findings of command lines: load_idx, loc_kind, loc_path, loc_item, activation, line, details map<string,string>.

    With `files` (load_idx, path, content, problem), commands are followed into
    the scripts that they call, as follow_calls() says; `folder` of an entry is
    where it starts, `variables` (load_idx, variables map<string,string>) are
    its machine's.
    """
    return detect_lines(commands(entries, breaks, review, source), files, variables)


def _report(entries: DataFrame, files: DataFrame | None, variables: DataFrame | None) -> DataFrame:
    called = "called string, usage string, script string, via string, number int, text string, called_reason string"

    def inspect(batch: pd.DataFrame):
        for r in batch.itertuples(index=False):
            where = {"loc_path": r.loc_path, "loc_kind": r.loc_kind, "loc_item": r.loc_item, "activation": r.activation}
            key = (r.load_idx, r.source)
            if r.reason:
                yield key, Finding(UNREADABLE, kind=RULES[r.breaks][1], reason=r.reason, **where)
                continue
            behind = Called(r.called, r.usage, r.script, r.via, None if pd.isna(r.number) else int(r.number), r.text, r.called_reason) if r.called else None
            try:
                found = report_command(r.line, command.analyze(r.analysed), (r.breaks, r.review), where, json.loads(r.details or "{}"), behind)
            except Exception:  # one entry must not stop the others
                found = [Finding(UNREADABLE, kind=RULES[r.breaks][1], reason="internalError", **where)]
            for x in found:
                yield key, x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, inspect)

    ship(entries.sparkSession)
    columns = entries.select("load_idx", "source", "breaks", "review", "loc_kind", "loc_path", "loc_item", "activation", "line", "analysed", "folder", "details", "reason")
    if files is None:
        columns = columns.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in called.split(", ")})
    else:
        columns = columns.withColumn("folder", F.coalesce("folder", F.lit("")))
        each = columns.where("analysed is not null").select("load_idx", F.col("analysed").alias("line"), "folder").distinct()
        found = follow_calls(each, files, variables, key=("line", "folder")).withColumnsRenamed({"line": "analysed", "reason": "called_reason"})
        columns = columns.join(found, ["load_idx", "analysed", "folder"], "left")
    return columns.mapInPandas(run, f"load_idx long, source string, {SCHEMA}")


def is_network(path: str) -> bool:
    r"""A path of a server and a share."""
    path = re.sub(r"^\\\\\?\\UNC\\", r"\\\\", path)
    return path[:2] in ("\\\\", "//") and path[2:4] not in ("?\\", ".\\") and len([x for x in re.split(r"[\\/]", path[2:]) if x]) >= 2


def resolve(written: str, folder: str | None, variables: dict[str, str]) -> str | None:
    """A path of a command as a whole path; None where a variable or the folder isn't known."""
    path = text.expand(written.strip().strip('"'), variables)
    if "%" in path:
        return None
    if is_network(path) or re.match(r"(?:\\\\\?\\)?[A-Za-z]:[\\/]", path):
        return path
    base = text.expand((folder or "").strip().strip('"'), variables)
    whole = re.match(r"[A-Za-z]:[\\/]", base) or is_network(base)
    return ntpath.join(base, path) if whole and "%" not in base else None


def follow_calls(entries: DataFrame, files: DataFrame, variables: DataFrame | None = None, key: tuple[str, ...] = ("entry",)) -> DataFrame:
    """What the batch, PowerShell and KiXtart files that commands name start, one level down.

    `entries`: load_idx, entry long, line and perhaps folder, where they start;
    `files`: load_idx, path, content, problem; `variables`: load_idx, variables
    map<string,string>.  Returns load_idx, entry, called (path), usage, script,
    via, number and text of the line, for entries that don't run the engine
    themselves: the first of all files named that runs it, else the first with a
    script of unknown language; reason where it couldn't be read.

    Files on a network are never read (networkLocation); one without a row in
    `files` counts as gone.  Paths that keep a variable, or are relative without
    a folder, aren't followed.  `key` are the columns that name an entry.
    """

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for load_idx, line, folder, known, *own in batch.itertuples(index=False):
                if command.strongest(command.analyze(line)) != command.VBSCRIPT:
                    for n, written in enumerate(command.called_scripts(line)):
                        if path := resolve(written, folder, dict(known or {})):
                            rows.append((load_idx, *own, n, path, ntpath.normpath(path), "networkLocation" if is_network(path) else None))
            yield pd.DataFrame(rows, columns=["load_idx", *key, "n", "called", "place", "remote"])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for load_idx, path, content, problem in batch.itertuples(index=False):
                found = Called(path, reason=problem) if problem else _inside(path, bytes(content))
                if found.usage or problem:
                    rows.append((load_idx, path, found.usage, found.script, found.via, found.number, found.line, problem))
            yield pd.DataFrame(rows, columns=["load_idx", "file", "usage", "script", "via", "number", "text", "reason"])

    ship(entries.sparkSession)
    if variables is not None:
        entries = entries.join(variables.select("load_idx", "variables"), "load_idx", "left")
    known = F.col("variables") if variables is not None else F.lit(None).cast("map<string,string>")
    folder = F.col("folder") if "folder" in entries.columns else F.lit(None).cast("string")
    own = [F.col(k).alias(f"key_{k}") for k in key]
    kinds = ", ".join(f"{k} {entries.schema[k].dataType.simpleString()}" for k in key)
    calls = entries.where("line is not null").select("load_idx", F.col("line").alias("_text"), folder.alias("_folder"), known.alias("_known"), *own).mapInPandas(named, f"load_idx long, {kinds}, n int, called string, place string, remote string")
    script_file = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1).isin(*command.CALLEES)
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.length("content") > MOST_SCRIPT, F.lit("tooLarge"))
    some = files.where(script_file).select("load_idx", "path", F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))
    uses = some.mapInPandas(inside, "load_idx long, file string, usage string, script string, via string, number int, text string, reason string")
    joined = calls.where("remote is null").withColumn("_path", paths.normalize("place")).join(uses.withColumn("_path", paths.normalize("file")), ["load_idx", "_path"])
    columns = ["load_idx", *key, "n", "called", "usage", "script", "via", "number", "text", "reason"]
    none = {"usage": "string", "script": "string", "via": "string", "number": "int", "text": "string"}
    remote = calls.where("remote is not null").withColumns({k: F.lit(None).cast(v) for k, v in none.items()}).withColumn("reason", F.col("remote"))
    rank = F.when(F.col("usage") == command.VBSCRIPT, 0).when(F.col("usage").isNotNull(), 1).otherwise(2)
    each = joined.select(*columns).union(remote.select(*columns))
    first = each.groupBy("load_idx", *key).agg(F.min(F.struct(rank.alias("rank"), "n", "called", "usage", "script", "via", "number", "text", "reason")).alias("f"))
    return first.select("load_idx", *key, *[f"f.{c}" for c in ("called", "usage", "script", "via", "number", "text", "reason")])


STARTUP = r"\\start menu\\programs\\startup\\[^\\]+$"
START = {"autostartType": "startupFolder"}
AUTOSTART = ("VBS-311", "VBS-312")


@remembered
def _inside(path: str, content: bytes) -> Called:
    """The strongest use in a batch, PowerShell or KiXtart file, the first of equal ones."""
    code = script.code_lines(text.decode(content), script.LANGUAGES.get(text.extension(path) or "", script.BATCH))
    uses = ((r.usage != command.VBSCRIPT, n, line.strip(), r) for n, line in code for r in command.analyze(line))
    best = min(uses, key=lambda x: x[:2], default=None)
    return Called(path) if best is None else Called(path, best[3].usage, best[3].script, best[3].via, best[1], best[2])


def _started(path: str, content: bytes, problem: str | None, size: int) -> list[Finding]:
    """What a script in a startup folder gives as an entry of its own."""
    where = {"loc_path": path, "activation": "automatic"}
    extension = text.extension(path)
    direct = [command.Reference(command.VBSCRIPT, path, "direct")]
    if extension in ("vbs", "vbe"):
        return report_command(path, direct, AUTOSTART, where, START)
    problem = problem or ("tooLarge" if size > MOST_SCRIPT else None)
    if extension in ("wsf", "wsc", "hta"):
        if problem:
            return [Finding(UNREADABLE, kind=RULES[AUTOSTART[0]][1], reason=problem, details=dict(START), **where)]
        return report_command(path, direct, AUTOSTART, where, START) if script.analyze(extension, text.decode(content)).vbscript else []
    return report_command(path, [], AUTOSTART, where, START, Called(path, reason=problem) if problem else _inside(path, content))


def detect_startup(files: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Findings of what lies in startup folders, as entries that start by themselves: load_idx, path, content, size, problem.

    Links are followed to the commands that they hold, and these into the
    scripts that they call, which `files` has too.
    """

    def scripts(batch: pd.DataFrame):
        for load_idx, path, content, size, problem in batch.itertuples(index=False):
            try:
                found = _started(path, b"" if content is None else bytes(content), problem, int(size))
            except Exception:  # one file must not stop the others
                found = [Finding(UNREADABLE, kind=RULES[AUTOSTART[0]][1], reason="internalError", loc_path=path, activation="automatic")]
            for x in found:
                yield (load_idx, "autostart"), x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, scripts)

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..sources.formats import shell_link

        for batch in batches:
            rows = []
            for load_idx, path, content, size, problem in batch.itertuples(index=False):
                target = arguments = folder = None
                problem = problem or ("tooLarge" if size > MOST_LINK else None)
                if not problem:
                    try:
                        link = shell_link.parse(bytes(content))
                        target, arguments, folder = link.target or "", link.arguments or "", link.folder
                    except Exception as e:
                        problem = "corrupt" if isinstance(e, shell_link.DamagedFile) else "internalError"
                line = None if problem else f"{target} {arguments}".strip()
                rows.append((load_idx, path, line, None if problem else f'"{target.strip(chr(34))}" {arguments}', folder, problem))
            yield pd.DataFrame(rows, columns=["load_idx", "loc_path", "line", "analysed", "folder", "reason"])

    ship(files.sparkSession)
    kind = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    some = files.where(F.lower(F.translate("path", "/", "\\")).rlike(STARTUP)).select("load_idx", "path", "content", "size", "problem")
    direct = some.where(kind.isin("vbs", "vbe", "wsf", "wsc", "hta", "bat", "cmd", "ps1", "kix")).mapInPandas(run, f"load_idx long, source string, {SCHEMA}")
    entries = some.where(kind == "lnk").mapInPandas(links, "load_idx long, loc_path string, line string, analysed string, folder string, reason string")
    fixed = {"loc_kind": "file", "activation": "automatic", "breaks": AUTOSTART[0], "review": AUTOSTART[1], "source": "autostart", "details": json.dumps(START)}
    entries = entries.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"loc_item": F.lit(None).cast("string")})
    return direct.union(_report(entries, files, variables))


def detect_packages(products: DataFrame, files: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Findings of installed products' packages: load_idx, packed (product code), path, details (JSON); files and variables as in detect_commands()."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(x[0], *x[2:], text.expand(x[3], dict(x[1] or {}))) for x in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["load_idx", "packed", "written", "details", "place"])

    def inspect(batch: pd.DataFrame):
        from .binary_detectors import installed_package

        for r in batch.itertuples(index=False):
            content = bytes(r.content) if r.content is not None else b""
            for x in installed_package(text.unpack_guid(r.packed) or r.packed, content, r.problem, json.loads(r.details)):
                yield (r.load_idx, "installer"), x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, inspect)

    ship(files.sparkSession)
    if variables is not None:
        products = products.join(variables.select("load_idx", "variables"), "load_idx", "left")
    known = F.col("variables") if variables is not None else F.lit(None).cast("map<string,string>")
    named = products.select("load_idx", known.alias("known"), "packed", "path", "details").mapInPandas(places, "load_idx long, packed string, written string, details string, place string")
    problem = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.length("content") > MOST_CONTENT, F.lit("tooLarge"))
    some = files.select("load_idx", paths.normalize("path").alias("_path"), F.when(problem.isNull(), F.col("content")).alias("content"), problem.alias("problem"))
    joined = named.withColumn("_path", paths.normalize("place")).join(some, ["load_idx", "_path"])
    return joined.select("load_idx", "packed", "details", "content", "problem").mapInPandas(run, f"load_idx long, source string, {SCHEMA}")


def detect_consumers(consumers: DataFrame) -> DataFrame:
    """Findings of consumers that hold VBScript: columns of system.subscriptions()."""

    def consumer(r, where: dict) -> list[Finding]:
        f = Finding("VBS-331", target=r.script_file, **where)
        f.details = {"scriptingEngine": r.engine, **dict(r.details or {})}
        if r.script_file:
            f.show(None, f"ScriptFileName = {r.script_file}")
        code = script.code_lines(r.script_text or "", script.VBSCRIPT)
        for line, value in script.evidence(code):
            f.show(line, value)
        return [f, *credentials(code, **where)]

    def inspect(batch: pd.DataFrame):
        for r in batch.itertuples(index=False):
            where = {"loc_path": r.loc_path, "loc_kind": r.loc_kind, "activation": r.activation}
            try:
                found = consumer(r, where)
            except Exception:  # one consumer must not stop the others
                found = [Finding(UNREADABLE, kind=RULES["VBS-331"][1], reason="internalError", **where)]
            for x in found:
                yield (r.load_idx, "wmi"), x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, inspect)

    ship(consumers.sparkSession)
    columns = consumers.select("load_idx", "loc_kind", "loc_path", "activation", "engine", "script_text", "script_file", "details")
    return columns.mapInPandas(run, f"load_idx long, source string, {SCHEMA}")


def source_status(columns: dict[str, str] | None = None) -> Column:
    """Of a module's report: failed, declared, errors, rights, complete, in this order."""
    c = {x: F.col((columns or {}).get(x, x)) for x in ("panicked", "declared", "errors", "needs_admin", "elevated")}
    return F.when(c["panicked"], "failed").when(c["declared"].isNotNull(), c["declared"]).when(c["errors"] > 0, "partial").when(c["needs_admin"] & ~c["elevated"], "partial").otherwise("complete")


def limitations() -> Column:
    """Codes of a scan: columns supported, elevated, system_sources, restricted (booleans) and statuses (map source -> status)."""
    partial = F.exists(F.map_entries("statuses"), lambda e: (e["value"] == "failed") | ((e["value"] == "partial") & ~e["key"].startswith("files.")))
    codes = [
        F.when(~F.col("supported"), "unsupportedPlatform").when(~F.col("elevated"), "notElevated"),
        F.when(~F.col("system_sources"), "systemSourcesSkipped"),
        F.when(F.col("restricted"), "fileScopeRestricted"),
        F.when(partial, "sourceIncomplete"),
    ]
    return F.array_compact(F.array(*codes))
