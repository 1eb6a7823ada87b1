"""VBA projects, after the published MS-OVBA specification: directory, module sources, protection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .compound import CompoundFile, Entry
from .raw import DamagedFile, u16, u32, wide

MOST_SOURCE = 32 << 20
REGISTERED, CONTROL, PROJECT = "registered", "control", "project"


@dataclass
class Reference:
    name: str
    kind: str
    library: str

    def _part(self, i: int) -> str | None:
        parts = self.library.split("#")
        return parts[i].strip() or None if len(parts) > i else None

    @property
    def path(self) -> str | None:
        return self._part(3)

    @property
    def description(self) -> str | None:
        return self._part(4)

    @property
    def guid(self) -> str | None:
        m = re.search(r"\{([^}]*)\}", self.library)
        return m[1].upper() if m else None


@dataclass
class Module:
    name: str = ""
    stream: str = ""
    offset: int = 0
    procedural: bool = False
    source: str | None = None
    problem: str | None = None


@dataclass
class Project:
    name: str | None = None
    code_page: int = 1252
    references: list[Reference] = field(default_factory=list)
    modules: list[Module] = field(default_factory=list)
    locked: bool = False


def decompress(data: bytes, most: int = MOST_SOURCE) -> bytes:
    """Chunks of at most 4096 bytes: literals, and copies of what the chunk already holds."""
    if data[:1] != b"\x01":
        raise DamagedFile("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        header = u16(data, at)
        if header >> 12 & 7 != 3:
            if len(out):
                break  # trailing bytes
            raise DamagedFile("chunk signature")
        end = min(at + (header & 0xFFF) + 3, len(data))
        at += 2
        begin = len(out)
        if not header & 0x8000:
            out += data[at : at + 4096]
            at += 4096
            continue
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token = u16(data, at)
                if token is None:
                    raise DamagedFile("copy token")
                at += 2
                width = max((len(out) - begin - 1).bit_length(), 4)
                back, size = (token >> 16 - width) + 1, (token & 0xFFFF >> width) + 3
                if back > len(out) - begin:
                    raise DamagedFile("copy before the chunk")
                for _ in range(size):
                    out.append(out[-back])
        if len(out) > most:
            raise DamagedFile("too large")
    return bytes(out)


def _text(data: bytes, page: int) -> str:
    for name in (f"cp{page}" if page != 65001 else "utf-8", "windows-1252"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def _sized(data: bytes, page: int) -> str:
    n = u32(data, 0) or 0
    return _text(data[4 : 4 + n], page)


def read_directory(data: bytes) -> Project:
    """Records of an id, a size and data."""
    project, at = Project(), 0
    reference, module, ended = None, None, False
    while at + 6 <= len(data):
        kind, size = u16(data, at), u32(data, at + 2)
        size = 6 if kind == 0x09 else size  # the version's size field is reserved
        body = data[at + 6 : at + 6 + size]
        if len(body) < size:
            raise DamagedFile(f"directory record {kind:#x}")
        at += 6 + size
        page = project.code_page
        match kind:
            case 0x03:
                project.code_page = u16(body, 0) or page
            case 0x04:
                project.name = _text(body, page)
            case 0x16:
                reference = _text(body, page)
            case 0x3E:
                reference = wide(body)
            case 0x0D | 0x0E | 0x2F:
                project.references.append(Reference(reference or "", {0x0D: REGISTERED, 0x0E: PROJECT, 0x2F: CONTROL}[kind], _sized(body, page)))
                reference = None
            case 0x30 if project.references and project.references[-1].kind == CONTROL:
                last = project.references[-1]
                last.library = _sized(body, page) or last.library
                last.name = last.name or reference or ""
                reference = None
            case 0x19:
                module = Module(_text(body, page))
                project.modules.append(module)
            case 0x2B:
                module = None
            case 0x10:
                ended = True
                break
            case _ if module is not None:
                match kind:
                    case 0x47:
                        module.name = wide(body) or module.name
                    case 0x1A:
                        module.stream = _text(body, page)
                    case 0x32:
                        module.stream = wide(body) or module.stream
                    case 0x31:
                        module.offset = u32(body, 0) or 0
                    case 0x21:
                        module.procedural = True
    if not ended and not project.modules and project.name is None:
        raise DamagedFile("not a directory stream")
    return project


def unlock(value: str) -> bytes | None:
    """The data of a protection field; None if it was tampered with."""
    try:
        raw = bytes.fromhex(value)
    except ValueError:
        return None
    if len(raw) < 3:
        return None
    seed, version, key = raw[0], raw[1] ^ raw[0], raw[2] ^ raw[0]
    if version != 2:
        return None
    clear, last, older, out = key, raw[2], raw[1], bytearray()
    for c in raw[3:]:
        clear = c ^ (older + clear & 0xFF)
        older, last = last, c
        out.append(clear)
    ignored = (seed & 6) >> 1
    size = int.from_bytes(out[ignored : ignored + 4], "little")
    body = bytes(out[ignored + 4 :])
    return body if len(body) == size else None


def _locked(project_text: str) -> bool:
    """Marked as protected by its user, with a password, or hidden; or not readable."""
    fields = dict(re.findall(r'^(CMG|DPB|GC)="([^"]*)"', project_text, re.M))
    for name, value in fields.items():
        data = unlock(value)
        if data is None or name == "CMG" and data[:1] and data[0] & 1 or name == "DPB" and data not in (b"\x00", b"") or name == "GC" and data[:1] == b"\x00":
            return True
    return False


def storages(file: CompoundFile) -> list[tuple[str, Entry]]:
    """Storages that hold a project: (path, storage)."""
    out = [("", file.root)] if file.find("VBA/dir") else []
    return out + [(path, e) for path, e in file.walk() if e.is_storage and file.find("VBA/dir", e)]


def read_project(file: CompoundFile, storage: Entry) -> Project:
    project = read_directory(decompress(file.read(file.find("VBA/dir", storage))))
    for module in project.modules:
        entry = file.find(f"VBA/{module.stream or module.name}", storage)
        try:
            if entry is None:
                raise DamagedFile("no module stream")
            raw = file.read(entry)
            module.source = _text(_source(raw, module.offset), project.code_page)
        except DamagedFile as e:
            module.problem = str(e)
    if entry := file.find("PROJECT", storage):
        project.locked = _locked(_text(file.read(entry), project.code_page).replace("\r", ""))
    return project


def _source(raw: bytes, offset: int) -> bytes:
    """At the offset that the directory names; else at the last place that reads as source."""
    try:
        return decompress(raw[offset:])
    except DamagedFile:
        at = len(raw)
        while (at := raw.rfind(b"\x01", 0, at)) >= 0:
            try:
                found = decompress(raw[at:])
            except DamagedFile:
                continue
            if found[:9].lower() == b"attribute":
                return found
        raise
