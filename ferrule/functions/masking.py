"""Secrets in evidence, replaced by a mask.

Masking a masked line changes nothing: a mask is no secret.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .remembered import remembered

MASK = "********"
PASSWORD, CONNECTION, URL = "password", "connectionString", "urlCredentials"

_NAME = r"(?:pass(?:word|wd|wort|phrase)?|pwd|passwd|kennwort|secret|api[_-]?key|token)"
_STOP = r"(?!\*{8})"
# most specific first: what one has masked the next leaves alone
PATTERNS: list[tuple[str, re.Pattern]] = [
    (URL, re.compile(rf"(?P<before>\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@\"']+:){_STOP}(?P<secret>[^\s/@\"']+)(?P<after>@)")),
    (CONNECTION, re.compile(rf"(?P<before>;\s*(?:pwd|password)\s*=\s*){_STOP}(?P<secret>[^;\"'\s]+)(?P<after>)", re.I)),
    (CONNECTION, re.compile(rf"(?P<before>(?:^|[\"'])\s*(?:pwd|password)\s*=\s*){_STOP}(?P<secret>[^;\"'\s]+)(?P<after>\s*;)", re.I)),
    (PASSWORD, re.compile(rf"(?P<before>\b\w*{_NAME}\w*\s*(?:=|:=)\s*[\"']){_STOP}(?P<secret>[^\"']+)(?P<after>[\"'])", re.I)),
    (PASSWORD, re.compile(rf"(?P<before>[-/]{{1,2}}{_NAME}(?:\s*[:=]\s*|\s+)[\"']?){_STOP}(?P<secret>[^\s\"']+)(?P<after>[\"']?)", re.I)),
    (PASSWORD, re.compile(rf"(?P<before>\bset\s+\"?\w*{_NAME}\w*=){_STOP}(?P<secret>[^\"\r\n&|]+?)(?P<after>\"?\s*(?:$|[&|]))", re.I)),
    (PASSWORD, re.compile(r"(?P<before>\bnet\s+use\s+.*?\s/user:\S+\s+)(?!\*{8}|/)(?P<secret>[^\s/]\S*)(?P<after>)", re.I)),
]


def mask_line(line: str) -> tuple[str, list[str]]:
    """The line with masks, and the kinds of secrets in order of the alphabet."""
    masked, kinds = _masked(line)
    return masked, list(kinds)


@remembered
def _masked(line: str) -> tuple[str, tuple[str, ...]]:
    kinds: set[str] = set()
    for kind, pattern in PATTERNS:
        line, n = pattern.subn(lambda m: m["before"] + MASK + m["after"], line)
        if n:
            kinds.add(kind)
    return line, tuple(sorted(kinds))


def mask_column(text) -> Column:
    """The line with masks, as an expression."""
    c = F.col(text) if isinstance(text, str) else text
    for _, pattern in PATTERNS:
        flags = "(?i)" if pattern.flags & re.I else ""
        java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern.pattern)
        c = F.regexp_replace(c, flags + java, r"${before}\*\*\*\*\*\*\*\*${after}".replace("\\*", "*"))
    return c
