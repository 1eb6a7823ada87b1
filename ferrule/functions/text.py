"""Bytes to text to lines, names and excerpts.  Plain functions that detectors share, and their column forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of what is written and read.
EVIDENCE_LINES, EVIDENCE_CHARS = 5, 240
EVIDENCE_LINES_READ, EVIDENCE_CHARS_READ = 50, 4096
TEXT_CHARS, DETAILS, ERROR_SAMPLES = 32_768, 64, 20
CELL_BYTES = 32_000

LINE_END = r"\r\n|\n|\r"


def decode(content: bytes) -> str:
    """By byte-order mark, else UTF-16 where half the bytes say so, else UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    sample = content[:4096]
    if len(sample) >= 8:
        low, high = sample[0::2], sample[1::2]
        if high.count(0) * 10 >= len(high) * 7 and low.count(0) * 10 <= len(low):
            return content.decode("utf-16-le", "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(_WINDOWS[b] for b in content)


# bytes that Windows-1252 leaves open stand for the control characters of the same number
_WINDOWS = [bytes([b]).decode("windows-1252", "ignore") or chr(b) for b in range(256)]


def lines(text: str) -> list[str]:
    """Lines by CRLF, LF or CR.  A last empty line doesn't count, but an empty text is one line."""
    out = re.split(LINE_END, text)
    if len(out) > 1 and not out[-1]:
        out.pop()
    return out


def line_number(text: str, at: int) -> int:
    """The line, from 1, that holds the character at `at`."""
    return len(re.findall(LINE_END, text[:at])) + 1


def base_name(path: str) -> str:
    return re.split(r"[\\/]", path.strip().strip("\"'"))[-1]


def extension(path: str) -> str | None:
    """The lower-case extension of a name as it is written in a command; None unless it is letters and digits."""
    _, dot, ext = base_name(path).rpartition(".")
    return ext.lower() if dot and ext and ext.isascii() and ext.isalnum() else None


def shorten(text: str, chars: int = EVIDENCE_CHARS) -> str:
    return text if len(text) <= chars else text[: chars - 1] + "…"


def clean(text: str) -> str:
    """Control characters, but for tabs, as spaces."""
    return "".join(" " if c != "\t" and (ord(c) < 32 or 127 <= ord(c) < 160) else c for c in text)


def cell(text: str, most: int = CELL_BYTES) -> str:
    """At most so many bytes, cut between characters."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode("utf-8", "ignore") + "…"


def cell_column(text, most: int = CELL_BYTES) -> Column:
    """cell() of a column."""
    c = F.col(text) if isinstance(text, str) else text
    raw, keep = F.encode(c, "UTF-8"), most - 3
    # a character has up to three bytes after its first, which begin with the bits 10
    within = lambda n: F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]")
    end = F.when(~within(keep), keep).when(~within(keep - 1), keep - 1).when(~within(keep - 2), keep - 2).otherwise(keep - 3)
    cut = F.concat(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"), F.lit("…"))
    return F.when(F.octet_length(c) > most, cut).otherwise(c)


def lines_column(text) -> Column:
    """Lines as an array, as lines() splits them."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, LINE_END, -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def shorten_column(text, chars: int = EVIDENCE_CHARS) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars - 1), F.lit("…"))).otherwise(c)


def clean_column(text) -> Column:
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\x00-\x08\x0A-\x1F\x7F-\x9F]", " ")


def is_servicing_data(content: bytes) -> bool:
    """Compressed or delta files of the update store, whatever they are called."""
    if len(content) >= 4 and content[:2] == b"DC" and content[3] == 1:
        return True
    for at in (0, 4):
        if content[at : at + 4] in (b"PA30", b"PA31") and any(b < 9 for b in content[at + 4 : at + 12]):
            return True
    return False


def is_servicing_column(content) -> Column:
    """The same over a binary column."""
    head = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 16))
    low = "(?:[0-9A-F]{2}){0,7}?0[0-8]"
    return head.rlike("^4443..01") | head.rlike(f"^5041333[01]{low}") | head.rlike(f"^(?:..){{4}}5041333[01]{low}")


_VARIABLE = re.compile(r"%([^%\s]+)%")


def expand(text: str, variables: dict[str, str]) -> str:
    """%NAME% by its value, whatever its case; unknown names and those with blanks stay."""
    known = {k.lower(): v for k, v in variables.items()}
    return _VARIABLE.sub(lambda m: known.get(m[1].lower(), m[0]), text)


def unpack_guid(packed: str) -> str | None:
    """{8-4-4-4-12} from the 32 digits under which installers register products."""
    if not re.fullmatch(r"[0-9A-Fa-f]{32}", packed):
        return None
    parts = [packed[0:8][::-1], packed[8:12][::-1], packed[12:16][::-1]]
    pairs = "".join(packed[i + 1] + packed[i] for i in range(16, 32, 2))
    return "{" + "-".join([*parts, pairs[:4], pairs[4:]]).upper() + "}"


def service_path(path: str) -> str:
    r"""\??\ and \SystemRoot\ at the start of a service's path."""
    if path.startswith("\\??\\"):
        return path[4:]
    if path.lower().startswith("\\systemroot\\"):
        return "%SystemRoot%" + path[11:]
    return "%SystemRoot%\\" + path if path.lower().startswith("system32\\") else path
