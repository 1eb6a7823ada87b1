"""Installer packages: tables in a compound file, and the custom actions that run VBScript."""

from __future__ import annotations

from dataclasses import dataclass, field

from ...functions import text
from .compound import CompoundFile, Entry
from .raw import DamagedFile, u16

# Custom action types, their sources and options, and the tables that schedule them.
KIND, INSTALL, VBSCRIPT = 0x07, 0x07, 0x06
SOURCE, CONTINUE = 0x30, 0x40
SOURCES = {0x00: "binary", 0x10: "installedFile", 0x20: "inline", 0x30: "property"}
PREFIX = {"binary": "Binary.", "installedFile": "File.", "property": "Property."}
SEQUENCES = ("InstallExecuteSequence", "InstallUISequence", "AdminExecuteSequence", "AdminUISequence", "AdvtExecuteSequence")
DEEPEST = 2
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"


@dataclass
class Action:
    name: str
    number: int
    source: str
    reference: str | None
    function: str | None
    script: str | None
    scheduled: bool
    condition: str | None

    @property
    def goes_on(self) -> bool:
        return bool(self.number & CONTINUE)

    @property
    def target(self) -> str | None:
        return PREFIX[self.source] + self.reference if self.source in PREFIX and self.reference else None


@dataclass
class Package:
    product: str | None = None
    version: str | None = None
    code: str | None = None
    actions: list[Action] = field(default_factory=list)


def stream_name(name: str) -> tuple[str, bool]:
    """Names pack two characters in one; those of tables start with a mark."""
    table = name.startswith("䡀")
    out = []
    for c in name[1:] if table else name:
        n = ord(c)
        if 0x3800 <= n < 0x4800:
            out += [_DIGITS[(n - 0x3800) & 63], _DIGITS[((n - 0x3800) >> 6) & 63]]
        elif 0x4800 <= n < 0x4840:
            out.append(_DIGITS[n - 0x4800])
        else:
            out.append(c)
    return "".join(out), table


class _Database:
    def __init__(self, file: CompoundFile, storage: Entry):
        self.file, self.tables, self.streams, self.storages = file, {}, {}, {}
        for entry in storage.children:
            name, table = stream_name(entry.name)
            (self.storages if entry.is_storage else self.tables if table else self.streams)[name] = entry
        if "_StringPool" not in self.tables:
            raise DamagedFile("no string pool")
        self._strings(file.read(self.tables["_StringPool"]), self._bytes("_StringData"))
        if "_Columns" not in self.tables:
            raise DamagedFile("no column catalog")
        kinds: dict[str, list[tuple[int, str, str]]] = {}
        catalog = [("Table", "s"), ("Number", "h"), ("Name", "s"), ("Type", "h")]
        for row in self._rows(catalog, self._bytes("_Columns")):
            if None not in row.values():
                bits = row["Type"] & 0xFFFF
                kind = ("b" if bits & ~0x1000 == 0x900 else "s") if bits & 0x800 else "h" if bits & 0xFF <= 2 else "i"
                kinds.setdefault(row["Table"], []).append((row["Number"], row["Name"], kind))
        self.columns = {t: [(n, k) for _, n, k in sorted(c)] for t, c in kinds.items()}

    def _bytes(self, table: str) -> bytes:
        return self.file.read(self.tables[table]) if table in self.tables else b""

    def _strings(self, pool: bytes, data: bytes) -> None:
        """A code page, then length and uses of each string; a long one has its length in the next pair."""
        header = int.from_bytes(pool[:4], "little")
        self.wide = 3 if header >> 31 else 2
        page = header & 0x7FFFFFFF
        encoding = {0: None, 65001: "utf-8", 932: "cp932", 936: "gbk", 949: "cp949", 950: "big5"}.get(page, f"cp{page}")
        self.strings: list[str | None] = [None]
        at, i = 0, 4
        while i + 4 <= len(pool):
            size, uses = u16(pool, i), u16(pool, i + 2)
            i += 4
            if size == 0 and uses:
                if i + 4 > len(pool):
                    break
                size = u16(pool, i) | u16(pool, i + 2) << 16
                i += 4
            if at + size > len(data):
                raise DamagedFile("string data")
            raw = data[at : at + size]
            at += size
            try:
                value = raw.decode(encoding) if encoding else text.decode(raw)
            except (LookupError, UnicodeDecodeError):
                value = text.decode(raw)
            self.strings.append(value if size else None)

    def _rows(self, columns: list[tuple[str, str]], data: bytes) -> list[dict]:
        """Values are stored column by column; numbers with their sign bit turned."""
        size = {"s": self.wide, "h": 2, "i": 4, "b": 2}
        n = len(data) // max(sum(size[k] for _, k in columns), 1)
        rows: list[dict] = [{} for _ in range(n)]
        at = 0
        for name, kind in columns:
            width = size[kind]
            for row in rows:
                stored = int.from_bytes(data[at : at + width], "little")
                at += width
                if kind == "b" or stored == 0:
                    row[name] = None
                elif kind == "s":
                    row[name] = self.strings[stored] if stored < len(self.strings) else None
                else:
                    row[name] = stored - (1 << (8 * width - 1))
        return rows

    def table(self, name: str) -> list[dict]:
        return self._rows(self.columns[name], self._bytes(name)) if name in self.columns else []


def _text(row: dict, column: str) -> str | None:
    value = next((v for k, v in row.items() if k.lower() == column.lower()), None)
    return None if value is None else str(value)


def analyze(data: bytes) -> Package:
    """VBScript actions of a package and of packages stored in it."""
    file = CompoundFile(data)
    package = Package()
    _collect(file, file.root, "", 0, package)
    return package


def _collect(file: CompoundFile, storage: Entry, prefix: str, depth: int, package: Package) -> None:
    db = _Database(file, storage)
    properties = {_text(r, "Property"): _text(r, "Value") for r in db.table("Property")}
    if depth == 0:
        package.product, package.version, package.code = (properties.get(k) for k in ("ProductName", "ProductVersion", "ProductCode"))
    scheduled, conditions = set(), {}
    for name in SEQUENCES:
        for r in db.table(name):
            if action := _text(r, "Action"):
                scheduled.add(action)
                if condition := _text(r, "Condition"):
                    conditions.setdefault(action, condition)
    scheduled |= {_text(r, "Argument") for r in db.table("ControlEvent") if (_text(r, "Event") or "").lower() == "doaction"}
    for r in db.table("CustomAction"):
        name, number, reference, target = _text(r, "Action") or "", r.get("Type"), _text(r, "Source"), _text(r, "Target")
        if not isinstance(number, int):
            continue
        if number & KIND == VBSCRIPT:
            source = SOURCES[number & SOURCE]
            script = None
            if source == "binary" and f"Binary.{reference}" in db.streams:
                script = text.decode(file.read(db.streams[f"Binary.{reference}"]))
            elif source == "inline":
                script = target
            elif source == "property":
                script = properties.get(reference)
            package.actions.append(Action(prefix + name, number, source, reference, None if source == "inline" else target, script, name in scheduled, conditions.get(name)))
        elif number & KIND == INSTALL and number & SOURCE == 0 and depth < DEEPEST and reference in db.storages:
            _collect(file, db.storages[reference], f"{prefix}{reference}/", depth + 1, package)
