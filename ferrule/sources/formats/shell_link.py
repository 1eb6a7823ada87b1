"""Shell links, after the published MS-SHLLINK specification."""

from __future__ import annotations

from dataclasses import dataclass

from ...functions import text
from .raw import DamagedFile, narrow_to_nul, need, u16, u32, wide, wide_to_nul

HEADER, CLASS = 0x4C, bytes.fromhex("0114020000000000c000000000000046")
LIST, INFO, UNICODE, ENVIRONMENT = 0x01, 0x02, 0x80, 0xA0000001
STRINGS = (("description", 0x04), ("relative", 0x08), ("folder", 0x10), ("arguments", 0x20), ("icon", 0x40))


@dataclass
class Link:
    target: str | None
    arguments: str | None
    folder: str | None
    description: str | None


def parse(data: bytes) -> Link:
    """The target comes from the first place that has one: link info, environment block, item list, relative path."""
    if u32(data, 0) != HEADER or data[4:20] != CLASS or len(data) < HEADER:
        raise DamagedFile("not a shell link")
    flags, at = u32(data, 0x14), HEADER
    from_list = from_info = from_environment = None
    if flags & LIST:
        size = need(u16(data, at), "item list")
        from_list = _item_path(_slice(data, at + 2, size, "item list"))
        at += 2 + size
    if flags & INFO:
        size = need(u32(data, at), "link info")
        from_info = _info_path(_slice(data, at, size, "link info"))
        at += max(size, 4)
    strings: dict[str, str] = {}
    for name, flag in STRINGS:
        if flags & flag:
            n = need(u16(data, at), "strings") * (2 if flags & UNICODE else 1)
            raw = _slice(data, at + 2, n, "strings")
            strings[name] = wide(raw) if flags & UNICODE else text.decode(raw)
            at += 2 + n
    while (size := u32(data, at)) and size >= 8 and at + size <= len(data):
        block = data[at : at + size]
        if u32(block, 4) == ENVIRONMENT and size >= 0x314:
            from_environment = wide_to_nul(block[0x10C:0x314]) or narrow_to_nul(block[8:0x10C]) or None
        at += size
    first = next((t for t in (from_info, from_environment, from_list, strings.get("relative")) if t is not None), None)
    shown = lambda s: s if s and s.strip() else None
    return Link(shown(first), shown(strings.get("arguments")), shown(strings.get("folder")), shown(strings.get("description")))


def _slice(data: bytes, at: int, size: int, what: str) -> bytes:
    if at + size > len(data):
        raise DamagedFile(what)
    return data[at : at + size]


def _join(base: str, rest: str) -> str:
    return base if not rest else base + rest if base.endswith("\\") else f"{base}\\{rest}"


def _info_path(info: bytes) -> str | None:
    header, flags = u32(info, 4), u32(info, 8)
    if header is None or flags is None:
        return None
    unicode = header >= 0x24

    def string(wide_at: int | None, narrow_at: int, block: bytes = info) -> str | None:
        for at, read in ((wide_at, wide_to_nul), (narrow_at, narrow_to_nul)):
            place = u32(block, at) if at is not None else None
            if place and place < len(block):
                return read(block[place:])
        return None

    rest = string(0x20 if unicode else None, 0x18) or ""
    if flags & 1 and (base := string(0x1C if unicode else None, 0x10)):
        return _join(base, rest)
    share = u32(info, 0x14)
    if flags & 2 and share and share < len(info):
        block = info[share:]
        name_at = u32(block, 8)
        if name_at and name_at < len(block) and (name := string(0x14 if name_at > 0x14 else None, 8, block)):
            return _join(name, rest)
    return None


def _item_path(items: bytes) -> str | None:
    parts: list[str] = []
    at = 0
    while (size := u16(items, at)) and size >= 2 and at + size <= len(items):
        item = items[at : at + size]
        kind = item[2] if size > 2 else 0
        if kind & 0x70 == 0x20 and size > 5:
            drive = narrow_to_nul(item[3:])
            if drive[1:2] == ":":
                parts = [drive.rstrip("\\")]
        elif kind & 0x70 == 0x30 and (name := _item_name(item, bool(kind & 4))):
            parts.append(name)
        at += size
    return "\\".join(parts) if len(parts) >= 2 and parts[0].endswith(":") else None


def _item_name(item: bytes, unicode: bool) -> str | None:
    short = wide_to_nul(item[14:]) if unicode else narrow_to_nul(item[14:])
    used = len(short.encode("utf-16-le")) + 2 if unicode else item[14:].find(b"\0") + 1 or len(item) - 14
    at = 14 + used
    block = item[at + at % 2 :]
    version = u16(block, 2)
    if u32(block, 4) == 0xBEEF0004 and version is not None and version >= 3:
        place = 0x14 if version <= 6 else {7: 0x26, 8: 0x2A}.get(version, 0x2E)
        long = wide_to_nul(block[place : u16(block, 0)])
        if long and all(ord(c) >= 32 for c in long):
            return long
    return short or None
