"""Lines of scripts: which are code, which make good evidence, and encoded scripts."""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass

from . import markup
from .text import EVIDENCE_LINES, lines

BATCH, POWERSHELL, KIXTART, VBSCRIPT = "batch", "powershell", "kixtart", "vbscript"
LANGUAGES = {"bat": BATCH, "cmd": BATCH, "ps1": POWERSHELL, "kix": KIXTART}
# Words of lines that show what a script does.
SIGNALS = ("createobject", "getobject", "wscript.", ".run ", ".run(", ".exec", "executeglobal", "shellexecute", ".regwrite", "mapnetworkdrive")

_NOT_CODE = {
    BATCH: re.compile(r"@*\s*(?:rem(?:[ \t]|$)|::|echo(?:[ .\t]|$))", re.I),
    KIXTART: re.compile(r";"),
    VBSCRIPT: re.compile(r"'|rem(?: |$)", re.I),
    POWERSHELL: re.compile(r"#"),
}


def code_lines(text: str, language: str) -> list[tuple[int, str]]:
    """Numbered lines without blank ones, comments and what a batch file only prints."""
    out, inside = [], False
    for number, line in enumerate(lines(text), 1):
        bare = line.strip()
        if language == POWERSHELL and (inside or bare.startswith("<#")):
            inside = "#>" not in bare
        elif bare and not _NOT_CODE[language].match(bare):
            out.append((number, line))
    return out


def evidence(code: list[tuple[int, str]], most: int = EVIDENCE_LINES) -> list[tuple[int, str]]:
    """Telling lines first, then the first ones; in the order of the source."""
    telling = [x for x in code if any(s in x[1].lower() for s in SIGNALS)][:most]
    rest = [x for x in code if x not in telling][: most - len(telling)]
    return sorted(telling + rest)


@dataclass(frozen=True)
class EncoderTables:
    """What the public script encoder substitutes: three characters for each code, and which of the three comes when."""

    plain: tuple[str, str, str]
    order: tuple[int, ...]


_ENCODED = re.compile(r"#@~\^([A-Za-z0-9+/=]{8})(.*?)([A-Za-z0-9+/=]{8})\^#~@", re.S)
_ESCAPES = {"@&": "\n", "@#": "\r", "@*": ">", "@!": "<", "@$": "@"}


def decode_encoded(text: str, tables: EncoderTables | None) -> str | None:
    """Text with its encoded parts in plain; None if there are none, or no tables to decode them with."""
    if tables is None or not _ENCODED.search(text):
        return None

    def plain(m: re.Match) -> str:
        out, i, n, body = [], 0, 0, m[2]
        while i < len(body):
            c = body[i]
            if c == "@" and body[i : i + 2] in _ESCAPES:
                out.append(_ESCAPES[body[i : i + 2]])
                i += 1
                n += 1
            elif ord(c) < 128:
                row = tables.plain[tables.order[n % len(tables.order)]]
                out.append(row[ord(c)] if ord(c) < len(row) and (ord(c) > 31 or c == "\t") else c)
                n += 1
            else:
                out.append(c)
            i += 1
        return "".join(out)

    return _ENCODED.sub(plain, text)


def is_encoded(text: str) -> bool:
    m = _ENCODED.search(text)
    try:
        return bool(m) and len(base64.b64decode(m[1])) >= 4
    except binascii.Error:
        return False


@dataclass
class Found:
    """VBScript in a file."""

    vbscript: bool = False
    lines: list[tuple[int, str]] | None = None
    markers: list[tuple[int, str]] | None = None
    encoded: bool = False
    blocks: int = 0
    external: str | None = None


def analyze(extension: str, text: str, tables: EncoderTables | None = None) -> Found:
    """Scripts are VBScript by their extension; documents by their script elements, handlers and links."""
    if extension in ("vbs", "vbe"):
        plain = decode_encoded(text, tables) if extension == "vbe" else None
        return Found(True, code_lines(text if plain is None else plain, VBSCRIPT), [], extension == "vbe" and is_encoded(text))
    found = Found(lines=[], markers=[])
    for block in markup.script_blocks(text):
        if not block.is_vbscript:
            continue
        found.vbscript, found.blocks = True, found.blocks + 1
        at = markup.line_of(text, block.start)
        found.markers.append((at, f'<script language="{block.language or ""}">'))
        found.external = found.external if found.external is not None else block.source
        raw = text[block.start : block.end]
        plain = decode_encoded(raw, tables)
        found.encoded |= is_encoded(raw) or "encode" in (block.language or "").lower()
        code = code_lines(raw if plain is None else plain, VBSCRIPT)
        found.lines += [(at - 1 + n, x) for n, x in code if not x.strip().startswith(("<![CDATA[", "]]>")) and x.strip() not in ("<!--", "-->")]
    if extension == "hta":
        for tag in markup.tags(text):
            if tag.closing or tag.named("script"):
                continue
            declared = "vbscript" in (tag.get("language") or "").lower()
            if declared or any(v.lstrip().lower().startswith("vbscript:") for _, v in tag.attributes):
                found.vbscript = True
                found.markers.append((markup.line_of(text, tag.start), text[tag.start : tag.end].strip()))
    found.markers = sorted(set(found.markers))[:3]
    return found
