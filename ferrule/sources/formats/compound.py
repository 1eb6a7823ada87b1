"""Compound files (MS-CFB): a small file system of storages and streams in one file."""

from __future__ import annotations

from dataclasses import dataclass, field

from .raw import DamagedFile, u16, u32

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF
STORAGE, STREAM, ROOT = 1, 2, 5
MOST_STREAM = 64 << 20


@dataclass
class Entry:
    name: str
    kind: int
    start: int
    size: int
    left: int
    right: int
    child: int
    children: list[Entry] = field(default_factory=list)

    @property
    def is_storage(self) -> bool:
        return self.kind in (STORAGE, ROOT)


class CompoundFile:
    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise DamagedFile("not a compound file")
        self.data = data
        version, shift, small = u16(data, 0x1A), u16(data, 0x1E), u16(data, 0x20)
        if version not in (3, 4) or shift not in (9, 12) or small > shift:
            raise DamagedFile("compound file header")
        self.sector, self.small = 1 << shift, 1 << small
        self.cutoff = u32(data, 0x38)
        self.fat = self._table(self._fat_sectors())
        self.mini = self._table(self._chain(u32(data, 0x3C), self.fat)) if u32(data, 0x40) else []
        raw = b"".join(self._read(s) for s in self._chain(u32(data, 0x30), self.fat))
        self.entries = [self._entry(raw[i : i + 128], version) for i in range(0, len(raw) - 127, 128)]
        if not self.entries or self.entries[0].kind != ROOT:
            raise DamagedFile("no root storage")
        self.root = self.entries[0]
        self._stream_of_small = self._bytes(self.root.start, self.root.size, big=True) if self.mini else b""
        seen: set[int] = set()
        todo = [self.root]
        while todo:
            entry = todo.pop()
            entry.children = self._siblings(entry.child, seen)
            todo += [c for c in entry.children if c.is_storage]

    def _read(self, sector: int) -> bytes:
        at = (sector + 1) * self.sector
        return self.data[at : at + self.sector]

    def _fat_sectors(self) -> list[int]:
        listed = [u32(self.data, 0x4C + 4 * i) for i in range(109)]
        at, n = u32(self.data, 0x44), u32(self.data, 0x48)
        per = self.sector // 4 - 1
        for _ in range(min(n or 0, len(self.data) // self.sector + 1)):
            if at in (END, FREE):
                break
            block = self._read(at)
            listed += [u32(block, 4 * i) for i in range(per)]
            at = u32(block, 4 * per)
            if at is None:
                break
        return [s for s in listed if s is not None and s < FREE - 5]

    def _table(self, sectors: list[int]) -> list[int]:
        raw = b"".join(self._read(s) for s in sectors)
        return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw) - 3, 4)]

    @staticmethod
    def _chain(at: int, table: list[int]) -> list[int]:
        out: list[int] = []
        seen: set[int] = set()
        while at < len(table) and at not in seen:
            seen.add(at)
            out.append(at)
            at = table[at]
        return out

    def _bytes(self, start: int, size: int, big: bool) -> bytes:
        if size > MOST_STREAM:
            raise DamagedFile("stream too large")
        if big:
            return b"".join(self._read(s) for s in self._chain(start, self.fat))[:size]
        return b"".join(self._stream_of_small[s * self.small : (s + 1) * self.small] for s in self._chain(start, self.mini))[:size]

    @staticmethod
    def _entry(raw: bytes, version: int) -> Entry:
        n = u16(raw, 0x40) or 0
        size = int.from_bytes(raw[0x78 : 0x80 if version == 4 else 0x7C], "little")
        return Entry(raw[: max(min(n, 64) - 2, 0)].decode("utf-16-le", "replace"), raw[0x42], u32(raw, 0x74), size, u32(raw, 0x44), u32(raw, 0x48), u32(raw, 0x4C))

    def _siblings(self, at: int, seen: set[int]) -> list[Entry]:
        out, todo = [], [at]
        while todo:
            at = todo.pop()
            if at >= len(self.entries) or at in seen or at == 0:
                continue
            seen.add(at)
            entry = self.entries[at]
            if entry.kind in (STORAGE, STREAM):
                out.append(entry)
            todo += [entry.left, entry.right]
        return out

    def read(self, entry: Entry) -> bytes:
        return self._bytes(entry.start, entry.size, entry.size >= self.cutoff)

    def find(self, path: str, within: Entry | None = None) -> Entry | None:
        """An entry below a storage, by names with slashes, whatever their case."""
        entry = within or self.root
        for part in filter(None, path.split("/")):
            entry = next((c for c in entry.children if c.name.lower() == part.lower()), None)
            if entry is None:
                return None
        return entry

    def walk(self, within: Entry | None = None, prefix: str = ""):
        """(path, entry) of everything below a storage."""
        for c in (within or self.root).children:
            yield f"{prefix}{c.name}", c
            if c.is_storage:
                yield from self.walk(c, f"{prefix}{c.name}/")
