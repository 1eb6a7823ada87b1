"""A lenient scanner for XML and HTML text.  Broken markup yields fewer tags, never an error."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import line_number

_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>?", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9_:.\-]*)")
_PART = re.compile(r"\s*(?:(?P<end>/?>)|(?P<key>[^\s=>/]+)(?:\s*=\s*(?:\"(?P<d>[^\"]*)(?:\"|\Z)|'(?P<s>[^']*)(?:'|\Z)|(?P<u>[^\s>\"'][^\s>]*)|(?=>)))?|(?P<stray>[=/]))")
_ENTITY = re.compile(r"&(amp|lt|gt|quot|apos|#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8});")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


@dataclass
class Tag:
    name: str
    start: int
    end: int
    closing: bool = False
    empty: bool = False
    attributes: list[tuple[str, str]] = field(default_factory=list)

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    def named(self, name: str) -> bool:
        """Whatever the case, with or without a prefix."""
        return name.lower() in (self.local.lower(), self.name.lower())

    def get(self, key: str) -> str | None:
        return next((v for k, v in self.attributes if k.lower() == key.lower()), None)


def unescape(text: str) -> str:
    """The five entities of XML and numeric references."""

    def one(m: re.Match) -> str:
        if m[1] in _NAMED:
            return _NAMED[m[1]]
        code = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def tags(text: str) -> list[Tag]:
    """Tags in order.  What scripts and styles hold is code, not markup."""
    out: list[Tag] = []
    at = text.find("<")
    while at >= 0:
        if skipped := _SKIPPED.match(text, at):
            at = text.find("<", skipped.end())
            continue
        tag = _tag(text, at)
        if tag is None:
            at = text.find("<", at + 1)
            continue
        out.append(tag)
        to = tag.end
        if not tag.closing and not tag.empty and tag.local.lower() in ("script", "style"):
            close = re.compile("</" + re.escape(tag.name), re.I).search(text, to)
            to = close.start() if close else len(text)
        at = text.find("<", to)
    return out


def _tag(text: str, at: int) -> Tag | None:
    head = _NAME.match(text, at)
    if not head:
        return None
    tag, to = Tag(head[2], at, 0, bool(head[1])), head.end()
    while part := _PART.match(text, to):
        to = part.end()
        if part["end"]:
            tag.end, tag.empty = to, part["end"] == "/>"
            return tag
        if part["key"]:
            value = next((v for v in (part["d"], part["s"], part["u"]) if v is not None), "")
            tag.attributes.append((part["key"], unescape(value)))
    return None


def text_after(text: str, tags_: list[Tag], i: int) -> str:
    """What stands between tag i and the next one."""
    end = tags_[i + 1].start if i + 1 < len(tags_) else len(text)
    raw = text[tags_[i].end : end].strip()
    if raw.startswith("<![CDATA[") and raw.endswith("]]>"):
        raw = raw[9:-3]
    return unescape(raw)


@dataclass
class Block:
    """A script element: its language and source as declared, and where its code is."""

    language: str | None
    source: str | None
    start: int
    end: int

    @property
    def is_vbscript(self) -> bool:
        return "vbscript" in (self.language or "").lower()


def script_blocks(text: str) -> list[Block]:
    all_tags, out = tags(text), []
    for i, tag in enumerate(all_tags):
        if tag.closing or not tag.named("script"):
            continue
        end = len(text)
        if tag.empty:
            end = tag.end
        elif i + 1 < len(all_tags) and all_tags[i + 1].closing and all_tags[i + 1].named("script"):
            end = all_tags[i + 1].start
        language = tag.get("language")
        out.append(Block(language if language is not None else tag.get("type"), tag.get("src"), tag.end, end))
    return out


def line_of(text: str, at: int) -> int:
    return line_number(text, at)
