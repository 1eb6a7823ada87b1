"""Registry hive files: keys and values below a root, bounds-checked."""

from __future__ import annotations

from collections.abc import Iterator

from .raw import DamagedFile, u16, u32, wide

BASE, SEGMENT, DEEPEST = 4096, 16_344, 64
TEXT, EXPAND, BINARY, NUMBER, MULTI, LONG = 1, 2, 3, 4, 7, 11


class Hive:
    def __init__(self, data: bytes):
        if data[:4] != b"regf" or len(data) < BASE + 32:
            raise DamagedFile("not a registry hive")
        self.data = data
        #: changes that are only in the transaction logs are missing
        self.dirty = u32(data, 4) != u32(data, 8)
        self.root = u32(data, 0x24)
        if self.root is None or self._cell(self.root)[:2] != b"nk":
            raise DamagedFile("no root key")

    def _cell(self, at: int | None) -> bytes:
        start = BASE + at if at is not None else len(self.data)
        size = abs(int.from_bytes(self.data[start : start + 4], "little", signed=True)) - 4 if start + 4 <= len(self.data) else 0
        return self.data[start + 4 : start + 4 + size] if size > 0 and start + 4 + size <= len(self.data) else b""

    def _offsets(self, at: int, depth: int = 0) -> Iterator[int]:
        cell = self._cell(at)
        kind, n = cell[:2], u16(cell, 2) or 0
        step = {b"lf": 8, b"lh": 8, b"li": 4, b"ri": 4}.get(kind)
        if step is None or depth > DEEPEST:
            return
        for i in range(n):
            place = u32(cell, 4 + i * step)
            if place is None:
                return
            if kind == b"ri":
                yield from self._offsets(place, depth + 1)
            else:
                yield place

    def subkeys(self, key: int) -> list[tuple[str, int]]:
        node = self._cell(key)
        if node[:2] != b"nk" or not u32(node, 0x14):
            return []
        named = ((self._name(at), at) for at in self._offsets(u32(node, 0x1C) or 0))
        return [(n, at) for n, at in named if n is not None]

    def _name(self, key: int) -> str | None:
        node = self._cell(key)
        n = u16(node, 0x48)
        if node[:2] != b"nk" or n is None or 0x4C + n > len(node):
            return None
        raw = node[0x4C : 0x4C + n]
        return raw.decode("latin-1") if (u16(node, 2) or 0) & 0x20 else wide(raw)

    def find(self, path: str) -> int | None:
        key = self.root
        for part in filter(None, path.split("\\")):
            key = next((at for name, at in self.subkeys(key) if name.lower() == part.lower()), None)
            if key is None:
                return None
        return key

    def values(self, key: int) -> list[tuple[str, int, object]]:
        """(name, type, value) of a key."""
        node = self._cell(key)
        if node[:2] != b"nk":
            return []
        listed = self._cell(u32(node, 0x28))
        found = (self._value(u32(listed, 4 * i)) for i in range(min(u32(node, 0x24) or 0, len(listed) // 4)))
        return [v for v in found if v is not None]

    def _value(self, at: int | None) -> tuple[str, int, object] | None:
        vk = self._cell(at)
        if vk[:2] != b"vk" or len(vk) < 0x14:
            return None
        n, size, place, kind, flags = u16(vk, 2), u32(vk, 4), u32(vk, 8), u32(vk, 0xC), u16(vk, 0x10)
        raw = vk[0x14 : 0x14 + n]
        if len(raw) < n:
            return None
        name = raw.decode("latin-1") if flags & 1 else wide(raw)
        if size & 0x80000000:
            data = vk[8 : 8 + min(size & 0x7FFFFFFF, 4)]
        else:
            data = self._data(place, size)
            if data is None:
                return None
        return name, kind, _decode(kind, data)

    def _data(self, at: int, size: int) -> bytes | None:
        cell = self._cell(at)
        if size > SEGMENT and cell[:2] == b"db":
            listed = self._cell(u32(cell, 4))
            parts = [self._cell(u32(listed, 4 * i))[:SEGMENT] for i in range(u16(cell, 2) or 0)]
            return b"".join(parts)[:size]
        return cell[:size] if len(cell) >= size else None

    def walk(self, path: str = "", key: int | None = None, depth: int = 0) -> Iterator[tuple[str, str, int, object]]:
        """(key path, name, type, value) of everything below."""
        key = self.root if key is None else key
        for name, kind, value in self.values(key):
            yield path, name, kind, value
        if depth < DEEPEST:
            for name, at in self.subkeys(key):
                yield from self.walk(f"{path}\\{name}" if path else name, at, depth + 1)


def _decode(kind: int, data: bytes):
    if kind in (TEXT, EXPAND):
        return wide(data).partition("\0")[0]
    if kind == MULTI:
        return [p for p in wide(data).split("\0") if p]
    if kind == NUMBER and len(data) >= 4 or kind == LONG and len(data) >= 8:
        return int.from_bytes(data[: 4 if kind == NUMBER else 8], "little")
    return bytes(data) if kind == BINARY else None
