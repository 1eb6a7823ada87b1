"""Office documents: where their VBA projects are, and what keeps them from being read."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, field

from .compound import SIGNATURE, CompoundFile
from .raw import DamagedFile, u16
from .vba_project import Project, read_project, storages

PASSWORD, RIGHTS, CORRUPT, UNSUPPORTED, TOO_LARGE = "passwordProtected", "encrypted", "corrupt", "unsupportedFormat", "tooLarge"
DEEPEST, MOST_PROJECTS, MOST_PART = 2, 32, 64 << 20
MORE_PROJECTS = (TOO_LARGE, f"more than {MOST_PROJECTS} projects")
FILE_PASS = 0x2F


@dataclass
class Found:
    """A project, or why it can't be read; `embedded` names the object in the document that holds it."""

    storage: str
    project: Project | None = None
    problem: str | None = None
    embedded: str | None = None


@dataclass
class Document:
    container: str
    projects: list[Found] = field(default_factory=list)
    obstacles: list[tuple[str, str]] = field(default_factory=list)
    encrypted: bool = False


def analyze(data: bytes, name: str = "", depth: int = 0, embedded: str | None = None) -> Document:
    if data[:8] == SIGNATURE:
        return _binary(data, embedded)
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return _open_xml(data, depth, embedded)
    if data[4:19] in (b"Standard Jet DB", b"Standard ACE DB"):
        return Document("access", obstacles=[(UNSUPPORTED, "database projects aren't read")])
    if data[:2] in (b"\x09\x00", b"\x09\x02", b"\x09\x04", b"\x09\x08"):
        return Document("other")  # sheets of formats before projects
    if data.lstrip()[:1] in (b"<", b"{") or not data or data[:10].lower() == b"mime-versi":
        return Document("other")
    return Document("other", obstacles=[(CORRUPT, "unknown format")])


def _binary(data: bytes, embedded: str | None) -> Document:
    document = Document("compound")
    try:
        file = CompoundFile(data)
    except DamagedFile as e:
        document.obstacles.append((CORRUPT, str(e)))
        return document
    if file.find("EncryptedPackage"):
        rights = any("drm" in path.lower() for path, _ in file.walk())
        document.obstacles.append((RIGHTS if rights else PASSWORD, "encrypted package"))
        return document
    document.encrypted = _is_encrypted(file)
    found = storages(file)
    if len(found) > MOST_PROJECTS:
        document.obstacles.append(MORE_PROJECTS)
    for path, storage in found[:MOST_PROJECTS]:
        try:
            document.projects.append(Found(path or "VBA", read_project(file, storage), embedded=embedded))
        except DamagedFile as e:
            document.projects.append(Found(path or "VBA", problem=str(e), embedded=embedded))
    return document


def _is_encrypted(file: CompoundFile) -> bool:
    """The flag of a document's header, or the record that a workbook's stream has."""
    if (entry := file.find("WordDocument")) and (flags := u16(file.read(entry), 0x0A)):
        return bool(flags & 0x0100)
    entry = file.find("Workbook") or file.find("Book")
    raw, at = (file.read(entry), 0) if entry else (b"", 0)
    while at + 4 <= min(len(raw), 4096):
        if u16(raw, at) == FILE_PASS:
            return True
        at += 4 + u16(raw, at + 2)
    return False


def _open_xml(data: bytes, depth: int, embedded: str | None) -> Document:
    document = Document("openXml")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                low = info.filename.lower()
                own, inner = low.endswith("vbaproject.bin"), "/embeddings/" in low
                if not own and not (inner and depth < DEEPEST):
                    continue
                if info.file_size > MOST_PART:
                    document.obstacles.append((TOO_LARGE, info.filename))
                    continue
                part = archive.read(info)
                if own:
                    found = _binary(part, embedded)
                    for p in found.projects:
                        p.storage = info.filename
                else:
                    found = analyze(part, info.filename, depth + 1, info.filename)
                    found.obstacles = [o for o in found.obstacles if o[0] in (PASSWORD, RIGHTS) or o == MORE_PROJECTS]
                room = MOST_PROJECTS - len(document.projects)
                document.projects += found.projects[:room]
                document.obstacles += found.obstacles
                if len(found.projects) > room and MORE_PROJECTS not in document.obstacles:
                    document.obstacles.append(MORE_PROJECTS)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError) as e:
        document.obstacles.append((CORRUPT, type(e).__name__))
    return document
