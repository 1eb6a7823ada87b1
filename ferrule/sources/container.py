"""Result containers: ZIP archives with a media type and one scan in JSON.

Reading is strict where the format is closed (required fields, types, limits,
unique finding ids) and tolerant where it may grow (unknown values and unknown
fields).  A file is read whole or rejected whole, with a code.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import details, masking, text
from ..functions.remembered import remembered
from ..operators import assessment
from ..runtime import materialize, numbered, ship
from . import catalog, listing

# Names in the archive, limits, the current schema.
MIMETYPE, RESULT = "mimetype", "result.json"
MOST_ENTRIES, MOST_MIMETYPE, MOST_RESULT = 16, 256, 256 * 1024 * 1024
MOST_FINDINGS, MOST_SOURCES = 500_000, 10_000
PART = 32 << 20  # bytes of containers that a task reads
ROWS = 1_000  # rows that a task holds before it hands them on; Python's memory is slower the more there are
SCHEMA_VERSION = 1
#: Any vendor's scan results; a reader can be given a narrower pattern.
MEDIA_TYPE = r"application/vnd\.[a-z0-9.-]+\.result\+zip"
WRITTEN_TYPE = "application/vnd.ferrule.result+zip"


class FormatError(Exception):
    """code: notAResultFile, wrongFormat, newerSchema, limitExceeded, invalid."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


# The shape of a scan: "?" marks what may be missing or null, "[]" a list that may be missing.
SHAPE = {
    "format": str, "schemaVersion": int, "scanId": "uuid", "startedAt": "time", "finishedAt": "time",
    "generator": {"product": str, "component": str, "version": str, "rulesAsOf": str, "platform": str},
    "machine": {
        "hostname": str, "fqdn?": str, "domain?": str, "machineId?": str,
        "os": {"family": str, "name?": str, "version?": str, "build?": int, "displayVersion?": str, "edition?": str, "productType?": str, "architecture?": str},
    },
    "scope": {"localDrives": bool, "paths[]": str, "networkPaths[]": str, "systemSources": bool},
    "coverage": {
        "mode": str, "elevated": bool, "limitations[]": {"code": str, "detail?": str},
        "sources[]": {
            "source": str, "status": str, "reason?": str, "roots[]": str, "entries?": int, "inspected?": int, "errors?": int, "skipped?": int,
            "errorSamples[]": str, "durationMs?": int, "timeRange?": {"from": "time", "to": "time"},
        },
    },
    "findings[]": {
        "id": str, "rule": str, "kind": str, "classification": str, "status": str, "reason?": str, "activation": str,
        "location": {"type": str, "path": str, "item?": str}, "target?": str,
        "file?": {"size": int, "modifiedAt?": "time", "sha256?": str, "network?": bool},
        "evidence[]": {"line?": int, "text": str, "masked?": bool},
        "details?": dict,
    },
}

#: What a container holds, as rows: one of part `scan`, and one for each finding, source and limitation.
SCHEMA = """file string, part string, pos bigint, error string, error_detail string, unknown_values int,
format string, schemaVersion int, scanId string, startedAt timestamp, finishedAt timestamp,
generator struct<product string, component string, version string, rulesAsOf string, platform string>,
machine struct<hostname string, fqdn string, domain string, machineId string, os struct<family string, name string, version string, build bigint, displayVersion string, edition string, productType string, architecture string>>,
scope struct<localDrives boolean, paths array<string>, networkPaths array<string>, systemSources boolean>,
coverage struct<mode string, elevated boolean>, n_findings bigint,
finding struct<id string, rule string, kind string, classification string, status string, reason string, activation string,
  location struct<type string, path string, item string>, target string, file struct<size bigint, modifiedAt timestamp, sha256 string, network boolean>,
  evidence array<struct<line int, text string, masked boolean>>, details string>,
source struct<source string, status string, reason string, roots array<string>, entries bigint, inspected bigint, errors bigint, skipped bigint, errorSamples array<string>, durationMs bigint, timeRange struct<`from` timestamp, `to` timestamp>>,
limitation struct<code string, detail string>"""
PARTS = ("scan", "finding", "source", "limitation")


@remembered
def parse_time(value: str) -> datetime:
    if not re.fullmatch(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)", value):
        raise ValueError(value)
    return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", value))


_RULE = re.compile(r"VBS-[0-9]{3}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}")


def _check(value, shape, where: str) -> None:
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            raise FormatError("invalid", f"{where}: not an object")
        for name, inner in shape.items():
            bare = name.rstrip("?[]")
            here = f"{where}.{bare}" if where else bare
            if name.endswith("[]"):
                items = value.get(bare, [])
                if not isinstance(items, list):
                    raise FormatError("invalid", f"{here}: not a list")
                for i, item in enumerate(items):
                    _check(item, inner, f"{here}[{i}]")
            elif bare not in value or value[bare] is None:
                if not name.endswith("?") or (bare in value and inner in (int, bool, dict)):
                    raise FormatError("invalid", f"{here} is missing")
            else:
                _check(value[bare], inner, here)
    elif shape == "time":
        try:
            parse_time(value)
        except (TypeError, ValueError):
            raise FormatError("invalid", f"{where}: not a time") from None
    elif shape == "uuid":
        if not isinstance(value, str) or not _UUID.fullmatch(value):
            raise FormatError("invalid", f"{where}: not an id")
    elif shape is int:
        if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value < 1 << 63:
            raise FormatError("invalid", f"{where}: not a number from 0")
    elif not isinstance(value, shape):
        raise FormatError("invalid", f"{where}: not a {shape.__name__}")


def _fitting(shape) -> Callable[[object], bool]:
    """_check() of a shape as one test, which doesn't say where something is wrong."""
    if isinstance(shape, dict):
        fields = [(n.rstrip("?[]"), n.endswith("[]"), n.endswith("?"), n.endswith("?") and inner not in (int, bool, dict), _fitting(inner)) for n, inner in shape.items()]

        def fits(value) -> bool:
            if not isinstance(value, dict):
                return False
            for name, many, optional, empty, inner in fields:
                if name not in value:
                    if not (many or optional):
                        return False
                elif many:
                    items = value[name]
                    if not isinstance(items, list) or not all(map(inner, items)):
                        return False
                elif (one := value[name]) is None:
                    if not empty:
                        return False
                elif not inner(one):
                    return False
            return True

        return fits
    if shape == "time":
        return _is_time
    if shape == "uuid":
        return lambda value: isinstance(value, str) and _UUID.fullmatch(value) is not None
    if shape is int:
        return lambda value: isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 63
    return lambda value: isinstance(value, shape)


def _is_time(value) -> bool:
    try:
        parse_time(value)
    except (TypeError, ValueError):
        return False
    return True


_fits = _fitting(SHAPE)


def check(scan: object) -> None:
    """Types and required fields of a scan."""
    if not _fits(scan):
        _check(scan, SHAPE, "")


def check_structure(scan: dict) -> None:
    """What has to hold between the fields of a scan."""
    findings, sources = scan.get("findings", []), scan["coverage"].get("sources", [])
    if len(findings) > MOST_FINDINGS or len(sources) > MOST_SOURCES:
        raise FormatError("limitExceeded", "findings or sources")
    if not scan["machine"]["hostname"].strip():
        raise FormatError("invalid", "machine.hostname is empty")
    if parse_time(scan["finishedAt"]) < parse_time(scan["startedAt"]):
        raise FormatError("invalid", "finishedAt lies before startedAt")
    seen: set[str] = set()
    for f in findings:
        name = f["id"]
        if not 0 < len(name.encode()) <= 32 or name in seen:
            raise FormatError("invalid", f"finding id {name!r} is empty, long or repeated")
        seen.add(name)
        if not _RULE.fullmatch(f["rule"]):
            raise FormatError("invalid", f"finding {name}: rule {f['rule']!r}")
        if (f["status"] == "notCheckable") != (f.get("reason") is not None):
            raise FormatError("invalid", f"finding {name}: a reason belongs to what can't be checked, and only to that")
        more, evidence = f.get("details") or {}, f.get("evidence", [])
        for value in more.values():
            if not isinstance(value, (str, bool, int)):
                raise FormatError("invalid", f"finding {name}: details")
        texts = [f["location"]["path"], f["location"].get("item") or "", f.get("target") or "", *more, *[v for v in more.values() if isinstance(v, str)]]
        if any(len(t) > text.TEXT_CHARS for t in texts) or len(more) > text.DETAILS:
            raise FormatError("limitExceeded", f"finding {name}: texts or details")
        if len(evidence) > text.EVIDENCE_LINES_READ or any(len(e["text"]) > text.EVIDENCE_CHARS_READ for e in evidence):
            raise FormatError("limitExceeded", f"finding {name}: evidence")


def unknown_values(scan: dict) -> int:
    """How many values a later format has added."""
    coverage, product = scan["coverage"], scan["machine"]["os"].get("productType")
    pairs = [(coverage["mode"], catalog.COVERAGE_MODES), (product, (None, "workstation", "server", "domainController"))]
    pairs += [(x["code"], catalog.LIMITATIONS) for x in coverage.get("limitations", [])] + [(x["status"], catalog.SOURCE_STATUSES) for x in coverage.get("sources", [])]
    for f in scan.get("findings", []):
        pairs += [
            (f["kind"], catalog.KINDS), (f["classification"], catalog.CLASSIFICATIONS), (f["status"], catalog.STATUSES), (f.get("reason"), (None, *catalog.REASONS)),
            (f["activation"], catalog.ACTIVATION_RANK), (f["location"]["type"], catalog.LOCATIONS),
        ]
    return sum(value not in known for value, known in pairs)


def upgrade(scan: object) -> dict:
    """To the current schema.  There is one so far."""
    if not isinstance(scan, dict) or not isinstance(scan.get("schemaVersion"), int) or isinstance(scan.get("schemaVersion"), bool) or scan["schemaVersion"] < 1:
        raise FormatError("invalid", "schemaVersion")
    if scan["schemaVersion"] > SCHEMA_VERSION:
        raise FormatError("newerSchema", str(scan["schemaVersion"]))
    return scan


# A container is small: zipfile takes ten times as long to open one as its contents do to be read.
_HEADER, _LISTED, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
SMALL = 1 << 20


def pack(*entries: tuple[str, str, int]) -> bytes:
    """An archive of entries (name, text, method), as zipfile writes it."""
    entries = [(name.encode("ascii"), content.encode(), method) for name, content, method in entries]
    if sum(len(content) for _, content, _ in entries) > SMALL:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, content, method in entries:
                archive.writestr(zipfile.ZipInfo(name.decode("ascii")), content, method)
        return out.getvalue()
    out, listed = bytearray(), bytearray()
    for name, content, method in entries:
        data = content
        if method == zipfile.ZIP_DEFLATED:
            deflate = zlib.compressobj(wbits=-15)
            data = deflate.compress(content) + deflate.flush()
        about = (0, method, 0, 33, zlib.crc32(content), len(data), len(content), len(name), 0)  # of 1 January 1980
        listed += _LISTED.pack(b"PK\1\2", 3 << 8 | 20, 20, *about, 0, 0, 0, 0o600 << 16, len(out)) + name
        out += _HEADER.pack(b"PK\3\4", 20, *about) + name + data
    return bytes(out + listed + _END.pack(b"PK\5\6", 0, 0, len(entries), len(entries), len(listed), len(out), 0))


def _unpacked(content: bytes) -> dict[str, bytes] | None:
    """The entries of a small archive of the plainest form, all checked; None for any other, which is left to zipfile.

    Plain are entries of different ASCII names, one behind another, stored or
    deflated, without flags, extra fields, comments and anything around them.
    """
    try:
        sign, disk, first, here, n, size, at, more = _END.unpack_from(content, max(len(content) - 22, 0))
        if sign != b"PK\5\6" or disk or first or here != n or n > MOST_ENTRIES or more or at + size != len(content) - 22 or content[-42:-38] == b"PK\6\7":
            return None
        found, end, place = {}, 0, at
        for _ in range(n):
            sign, _, version, flags, method, _, _, crc, packed, whole, chars, extra, more, disk, _, _, begin = _LISTED.unpack_from(content, place)
            name = content[place + 46 : place + 46 + chars]
            place += 46 + chars
            if sign != b"PK\1\2" or version > 20 or flags or extra or more or disk or begin < end or not name.isascii() or b"\0" in name or whole > SMALL or place > len(content) - 22:
                return None
            local = _HEADER.unpack_from(content, begin)
            data = begin + 30 + chars + local[10]
            end = data + packed
            if local[0] != b"PK\3\4" or local[2] or local[9] != chars or content[begin + 30 : begin + 30 + chars] != name or end > at:
                return None
            value = content[data:end]
            if method == zipfile.ZIP_DEFLATED:
                inflate = zlib.decompressobj(-15)
                value = inflate.decompress(value, whole + 1)
                if not inflate.eof or inflate.unused_data:
                    return None
            elif method != zipfile.ZIP_STORED:
                return None
            if len(value) != whole or zlib.crc32(value) != crc:
                return None
            found[name.decode("ascii")] = value
        return found if len(found) == n and place == len(content) - 22 else None
    except (struct.error, zlib.error):
        return None


def _entry(archive: zipfile.ZipFile, name: str, most: int) -> bytes | None:
    try:
        with archive.open(name) as f:
            data = f.read(most + 1)  # what it really holds, whatever it declares
    except KeyError:
        return None
    if len(data) > most:
        raise FormatError("limitExceeded", name)
    return data


def _media_type(kind: bytes | None, media_type: str) -> None:
    if kind is None:
        raise FormatError("notAResultFile")
    kind = kind.decode("utf-8", "replace").strip()
    if not re.fullmatch(media_type, kind):
        raise FormatError("wrongFormat", kind)


def read(content: bytes, media_type: str = MEDIA_TYPE) -> dict:
    """The scan in a container; a FormatError if it isn't one."""
    found = _unpacked(content)
    if found is not None and len(found.get(MIMETYPE, b"")) <= MOST_MIMETYPE:
        _media_type(found.get(MIMETYPE), media_type)
        data = found.get(RESULT)
    else:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                if len(archive.infolist()) > MOST_ENTRIES:
                    raise FormatError("limitExceeded", "entries")
                _media_type(_entry(archive, MIMETYPE, MOST_MIMETYPE), media_type)
                data = _entry(archive, RESULT, MOST_RESULT)
        except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, EOFError, RuntimeError, OSError):
            raise FormatError("notAResultFile") from None
    if data is None:
        raise FormatError("invalid", f"{RESULT} is missing")
    try:
        scan = json.loads(data)
    except (ValueError, RecursionError):
        raise FormatError("invalid", "not JSON") from None
    scan = upgrade(scan)
    check(scan)
    if not re.fullmatch(media_type, scan["format"]):
        raise FormatError("wrongFormat", scan["format"])
    check_structure(scan)
    return scan


def sanitize(scan: dict) -> tuple[dict, int]:
    """As it may be written: few, short and masked lines of evidence.  And how many lines hid a secret until now."""
    late, findings = 0, []
    for f in scan.get("findings", []):
        lines = []
        for e in f.get("evidence", [])[: text.EVIDENCE_LINES]:
            masked, kinds = masking.mask_line(text.clean(e["text"]))
            late += bool(kinds)
            lines.append(e | {"text": text.shorten(masked)} | ({"masked": True} if kinds else {}))
        findings.append(f | {"evidence": lines})
    sources = [s | {"errorSamples": s["errorSamples"][: text.ERROR_SAMPLES]} if "errorSamples" in s else s for s in scan["coverage"].get("sources", [])]
    return scan | {"findings": findings, "coverage": scan["coverage"] | {"sources": sources}}, late


def to_bytes(scan: dict, media_type: str = WRITTEN_TYPE) -> bytes:
    """A container of the scan, after sanitize() and all checks."""
    scan = sanitize(scan | {"format": media_type})[0]
    check(scan)
    check_structure(scan)
    return pack((MIMETYPE, media_type, zipfile.ZIP_STORED), (RESULT, json.dumps(scan, ensure_ascii=False, indent=2), zipfile.ZIP_DEFLATED))


def _times(value: dict, *names: str) -> dict:
    return value | {n: parse_time(value[n]) for n in names if value.get(n) is not None}


def rows_of(path: str, content: bytes, media_type: str = MEDIA_TYPE) -> Iterator[dict]:
    """A container's rows: the scan's first, then those of its lists.  One that is rejected is a row with an error."""
    try:
        scan = read(content, media_type)
    except FormatError as e:
        yield {"file": path, "part": "scan", "error": e.code, "error_detail": e.detail}
        return
    coverage, found = scan["coverage"], scan.get("findings", [])
    yield _times(scan, "startedAt", "finishedAt") | {"file": path, "part": "scan", "unknown_values": unknown_values(scan), "n_findings": len(found)}
    for i, f in enumerate(found):
        file = f.get("file")
        more = json.dumps(f["details"], ensure_ascii=False, sort_keys=True) if f.get("details") else "{}"
        yield {"file": path, "part": "finding", "pos": i, "finding": f | {"file": file and _times(file, "modifiedAt"), "details": more}}
    for i, x in enumerate(coverage.get("sources", [])):
        yield {"file": path, "part": "source", "pos": i, "source": x | {"timeRange": x.get("timeRange") and _times(x["timeRange"], "from", "to")}}
    for i, x in enumerate(coverage.get("limitations", [])):
        yield {"file": path, "part": "limitation", "pos": i, "limitation": x}


def batches_of(found: Iterator[tuple[str, str | None, bytes | None]], schema: pa.Schema, media_type: str) -> Iterator[pa.RecordBatch]:
    """Containers (path, problem, content) to Arrow batches of their rows; a batch has at most ROWS rows."""
    rows = []
    for path, problem, content in found:
        for row in [{"file": path, "part": "scan", "error": "unreadable", "error_detail": problem}] if problem else rows_of(path, content, media_type):
            rows.append(row)
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_files(spark: SparkSession, paths: list[str] | str, extension: str | None = None, media_type: str = MEDIA_TYPE) -> DataFrame:
    """The rows of containers: files as they are given, and files of the extension (any case; all without one) in folders below.

    Folders are listed in tasks, links to folders aren't followed, and each
    container is opened once a reading of the result, by a data source whose
    partitions are planned by bytes.  What can't be listed or opened is a row
    with the error `unreadable`; names that begin with a dot or an underscore
    count like others.  All executors have to share the paths.
    """
    from .container_source import load

    found = listing.tree(spark, paths, {extension} if extension else None, file_links=True)
    return load(spark, listing.planned(listing.files(found), bytes_each=PART), media_type)


def read_contents(files: DataFrame, media_type: str = MEDIA_TYPE) -> DataFrame:
    """The same of containers in a table: file, content."""
    ship(files.sparkSession)
    kinds = files.sparkSession.createDataFrame([], SCHEMA).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((path.as_py(), None, content.as_py() or b"") for batch in batches for path, content in zip(*batch.columns, strict=True))
        return batches_of(each, to_arrow_schema(kinds), media_type)

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def imported(rows: DataFrame, machine_limit: int | None = None, loaded: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The scans of read_files' rows, a row a file, with `outcome`: error, alreadyLoaded, duplicate, overLimit or accepted.

    In order of files: a scan that was seen before is a duplicate; beyond the
    limit, scans of further machines are over it.  A scan belongs to one machine.
    `loaded` (file) are files of an earlier import: they are not taken again.
    `known` (scan_id, _m0, _m1, _m2) are scans and machines that were accepted
    before: they count for duplicates and for the limit.  rows are read more
    than once: pass a written table.
    """
    if "part" in rows.columns:
        rows = rows.where("part = 'scan'").drop("part", "pos", "finding", "source", "limitation")
    if loaded is not None:
        again = loaded.select("file").distinct().withColumn("_again", F.lit(True))
        rows = rows.join(many(again), "file", "left")
        kept = imported(rows.where("_again is null").drop("_again"), machine_limit, None, known)
        return kept.unionByName(rows.where("_again").drop("_again").withColumn("outcome", F.lit("alreadyLoaded")))
    good = rows.where("error is null").select("file", F.col("scanId").alias("_scan"), *[c.alias(m) for c, m in zip(_machine(), MACHINE, strict=True)])
    if known is not None:
        good = good.join(many(known.select(F.col("scan_id").alias("_scan")).distinct()), "_scan", "left_anti")
    first = good.groupBy("_scan").agg(F.min("file").alias("_first"), *[F.min(m).alias(m) for m in MACHINE])
    if machine_limit is not None:
        new, left = first.groupBy(*MACHINE).agg(F.min("_first").alias("_seen")), machine_limit
        had = None
        if known is not None:
            had = known.select(*MACHINE).distinct()
            new, left = new.join(many(had), MACHINE, "left_anti"), max(machine_limit - had.count(), 0)
        inside = new.orderBy("_seen").limit(left).drop("_seen")
        first = first.join(many((inside if had is None else inside.union(had)).withColumn("_inside", F.lit(True))), MACHINE, "left")
    else:
        first = first.withColumn("_inside", F.lit(True))
    read = rows.where("error is null")  # others have no scan, and would meet in one task
    out = read.join(many(first.select("_scan", "_first", "_inside")), read["scanId"] == F.col("_scan"), "left")
    outcome = F.when(F.col("_scan").isNull(), "duplicate").when(F.col("_inside").isNull(), "overLimit")
    out = out.withColumn("outcome", outcome.when(F.col("file") != F.col("_first"), "duplicate").otherwise("accepted")).drop("_scan", "_first", "_inside")
    return out.unionByName(rows.where("error is not null").withColumn("outcome", F.lit("error")))


def many(side: DataFrame) -> DataFrame:
    """A side of a join that has a row for each file or machine.

    Rows of containers are wide, and their few columns read here are taken for
    a small share of a well compressed file: Spark's estimate would have
    millions of names broadcast, through the driver.
    """
    return side.hint("merge")


#: A machine's key in import tables.
MACHINE = ["_m0", "_m1", "_m2"]


def _machine():
    return [F.lower("machine.hostname"), F.lower(F.coalesce("machine.domain", F.lit(""))), F.lower(F.coalesce("machine.machineId", F.lit("")))]


def load_order(rows: DataFrame) -> DataFrame:
    """Accepted rows with load_idx from 0."""
    accepted = rows.where("outcome = 'accepted'")
    # a file has one row, so names alone are sorted, not scans
    names = accepted.select("file", F.lower("machine.hostname").alias("_host"))
    order = numbered(names, [F.col("_host"), F.col("file")], "load_idx").select("file", (F.col("load_idx") - 1).alias("load_idx"))
    return accepted.join(many(order), "file")


def tables(loaded: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The tables that the assessment takes, of load_order()'s scans and read_files' rows: scans, findings, sources, limitations."""
    scans = loaded.select(
        "load_idx", "file", F.col("scanId").alias("scan_id"), "machine.hostname", "machine.domain", F.col("machine.machineId").alias("machine_id"),
        F.col("startedAt").alias("started_at"), F.col("finishedAt").alias("finished_at"), F.col("coverage.mode").alias("coverage_mode"),
    )
    order = loaded.select("file", "load_idx")

    def part(name: str, *columns) -> DataFrame:
        # a file may hold a large share of all findings: AQE splits them
        return rows.where(F.col("part") == name).select("file", *columns).join(many(order), "file").drop("file")

    f = "finding"
    findings = part(
        f, "pos", F.col(f"{f}.id").alias("finding_id"), f"{f}.rule", f"{f}.kind", f"{f}.classification", f"{f}.status", f"{f}.reason", f"{f}.activation",
        F.col(f"{f}.location.type").alias("loc_kind"), F.col(f"{f}.location.path").alias("loc_path"), F.col(f"{f}.location.item").alias("loc_item"), f"{f}.target",
        F.col(f"{f}.file.size").alias("file_size"), F.col(f"{f}.file.sha256").alias("sha256"), F.col(f"{f}.evidence").alias("evidence"), details.parsed(f"{f}.details").alias("details"),
    )
    sources = part(
        "source", "source.source", "source.status", "source.reason", *[F.coalesce(f"source.{c}", F.lit(0)).alias(c) for c in ("entries", "inspected", "errors", "skipped")],
        F.col("source.timeRange.from").alias("time_from"), F.col("source.timeRange.to").alias("time_to"), F.col("source.errorSamples").alias("error_samples"),
    )
    return {"scans": scans, "findings": findings, "sources": sources, "limitations": part("limitation", "limitation.code", "limitation.detail")}


def assess_files(spark: SparkSession, paths: list[str] | str, extension: str | None = None, machine_limit: int | None = None) -> assessment.Assessment:
    """From files to an assessment.  Files are opened and parsed once; what follows reads the columns that it needs."""
    rows = materialize(read_files(spark, paths, extension), "scans")
    got = tables(load_order(imported(rows, machine_limit)), rows)
    return assessment.assess(got["scans"], got["findings"], machine_limit=machine_limit)


def written(rows: DataFrame, folder: str, extension: str = "zip") -> DataFrame:
    """Writes each row's `scan` (JSON) as a container into a folder that the executors share; never over an existing file.

    Returns file and error of each row.  Names are <host>_<yyyymmdd-hhmmss>Z.<extension>,
    in UTC.  A file appears whole or not at all; one that is there already with
    the same content, such as of a task that ran before, is no error.
    container_source.save() writes all or none.
    """

    from .container_source import name_of

    def put(name: str, data: bytes) -> None:
        part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
        try:
            with open(part, "xb") as f:
                f.write(data)
            os.link(part, os.path.join(folder, name))
        except FileExistsError:
            with open(os.path.join(folder, name), "rb") as f:
                if f.read() != data:
                    raise
        finally:
            if os.path.exists(part):
                os.remove(part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value in batch["scan"]:
                name = None
                try:
                    scan = json.loads(value)
                    name = name_of(scan, extension)
                    data = to_bytes(scan)
                    put(name, data)
                    out.append((name, None))
                except (FormatError, OSError, ValueError, KeyError) as e:
                    out.append((name, type(e).__name__))
            yield pd.DataFrame(out, columns=["file", "error"])

    ship(rows.sparkSession)
    return rows.select("scan").mapInPandas(run, "file string, error string")
