"""Minimal files of binary formats, made from their specifications."""

from __future__ import annotations

import struct

SECTOR, MINI = 512, 64
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of version 3; names with slashes make storages.  The cutoff for small sectors is 0, so none are used."""
    entries = [["Root Entry", 5, END, 0, FREE, FREE, FREE]]
    index: dict[str, int] = {"": 0}
    children: dict[int, list[int]] = {0: []}
    body: list[bytes] = []
    fat: list[int] = []

    def chain(data: bytes) -> int:
        n = max(-(-len(data) // SECTOR), 1)
        first = len(fat)
        for i in range(n):
            fat.append(first + i + 1 if i + 1 < n else END)
            body.append(data[i * SECTOR : (i + 1) * SECTOR].ljust(SECTOR, b"\0"))
        return first

    def folder(path: str) -> int:
        if path not in index:
            parent = folder(path.rpartition("/")[0])
            index[path] = len(entries)
            children[parent].append(len(entries))
            children[len(entries)] = []
            entries.append([path.rpartition("/")[2], 1, 0, 0, FREE, FREE, FREE])
        return index[path]

    for path, data in streams.items():
        parent = folder(path.rpartition("/")[0])
        children[parent].append(len(entries))
        entries.append([path.rpartition("/")[2], 2, chain(data), len(data), FREE, FREE, FREE])
    for parent, own in children.items():
        for a, b in zip(own, own[1:], strict=False):
            entries[a][5] = b
        if own:
            entries[parent][6] = own[0]
    raw = b"".join(
        struct.pack("<64sHBBIII16sIQQII", name.encode("utf-16-le"), len(name) * 2 + 2, kind, 1, left, right, child, b"", 0, 0, 0, start & 0xFFFFFFFF, size) + b"\0\0\0\0"
        for name, kind, start, size, left, right, child in entries
    )
    directory = chain(raw)
    n_fat = 1
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    first_fat = len(fat)
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * SECTOR, b"\xff")
    header = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, directory, 0, 0, END, 0, END, 0, first_fat)
    listed = [first_fat + i for i in range(n_fat)][1:]
    header += struct.pack(f"<{len(listed)}I", *listed)
    return header.ljust(SECTOR, b"\xff") + b"".join(body) + table


def shell_link(target: str = "", arguments: str = "", folder: str = "") -> bytes:
    flags = 0x80 | (0x02 if target else 0) | (0x10 if folder else 0) | (0x20 if arguments else 0)
    out = struct.pack("<I16sI", 0x4C, bytes.fromhex("0114020000000000c000000000000046"), flags).ljust(0x4C, b"\0")
    if target:
        raw = target.encode("utf-16-le") + b"\0\0"
        out += struct.pack("<IIIIIIIII", 0x24 + len(raw) + 2, 0x24, 1, 0, 0x24 + len(raw), 0, 0x24 + len(raw), 0x24, 0x24 + len(raw)) + raw + b"\0\0"
    for text in (folder, arguments):
        if text:
            out += struct.pack("<H", len(text)) + text.encode("utf-16-le")
    return out


def compress(data: bytes) -> bytes:
    """A compressed container of literals alone."""
    out = b"\x01"
    for at in range(0, len(data), 3600):
        part = data[at : at + 3600]
        body = b"".join(b"\0" + part[i : i + 8] for i in range(0, len(part), 8))
        out += struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    return out


def vba_streams(modules: dict[str, str], references: list[tuple[str, str]] = (), prefix: str = "") -> dict[str, bytes]:
    def record(kind: int, body: bytes) -> bytes:
        return struct.pack("<HI", kind, len(body)) + body

    directory = record(0x03, struct.pack("<H", 1252)) + record(0x04, b"VBAProject") + struct.pack("<HI", 0x09, 4) + b"\0" * 6
    for name, library in references:
        directory += record(0x16, name.encode()) + record(0x0D, struct.pack("<I", len(library)) + library.encode("cp1252") + b"\0" * 6)
    for name in modules:
        directory += record(0x19, name.encode()) + record(0x1A, name.encode()) + record(0x31, struct.pack("<I", 0)) + record(0x21, b"") + record(0x2B, b"")
    directory += record(0x10, b"")
    out = {f"{prefix}VBA/dir": compress(directory)}
    for name, source in modules.items():
        out[f"{prefix}VBA/{name}"] = compress(source.encode("cp1252"))
    return out


def hive(keys: dict[str, dict[str, object]]) -> bytes:
    """A hive file of the keys; values are texts or numbers."""
    cells = bytearray()

    def cell(body: bytes) -> int:
        at = len(cells)
        size = -(-(len(body) + 4) // 8) * 8
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))
        return at

    tree: dict = {}
    for path in keys:
        node = tree
        for part in path.split("\\"):
            node = node.setdefault(part, {})

    def value(name: str, v: object) -> int:
        if isinstance(v, int):
            size, place, kind = 0x80000004, v, 4
        else:
            raw = str(v).encode("utf-16-le") + b"\0\0"
            size, place, kind = len(raw), cell(raw), 1
        return cell(b"vk" + struct.pack("<HIIIHH", len(name), size, place, kind, 1, 0) + name.encode("latin-1"))

    def key(name: str, node: dict, path: str) -> int:
        below = [key(n, c, f"{path}\\{n}" if path else n) for n, c in node.items()]
        listed = cell(b"lf" + struct.pack("<H", len(below)) + b"".join(struct.pack("<II", b, 0) for b in below)) if below else 0xFFFFFFFF
        own = [value(n, v) for n, v in keys.get(path, {}).items()]
        values = cell(b"".join(struct.pack("<I", v) for v in own)) if own else 0xFFFFFFFF
        body = bytearray(0x4C)
        body[0:4] = b"nk" + struct.pack("<H", 0x20)
        struct.pack_into("<I", body, 0x14, len(below))
        struct.pack_into("<I", body, 0x1C, listed)
        struct.pack_into("<II", body, 0x24, len(own), values)
        struct.pack_into("<H", body, 0x48, len(name))
        return cell(bytes(body) + name.encode("latin-1"))

    root = key("ROOT", tree, "")
    return (b"regf" + struct.pack("<II", 1, 1)).ljust(0x24, b"\0") + struct.pack("<I", root) + b"\0" * (4096 - 0x28) + bytes(cells)


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"


def packed_name(name: str, table: bool) -> str:
    out = "䡀" if table else ""
    for i in range(0, len(name), 2):
        pair = name[i : i + 2]
        if len(pair) == 2:
            out += chr(0x3800 + DIGITS.index(pair[0]) + (DIGITS.index(pair[1]) << 6))
        else:
            out += chr(0x4800 + DIGITS.index(pair))
    return out


def package(tables: dict[str, tuple[list[tuple[str, str]], list[dict]]], binaries: dict[str, bytes] = {}) -> bytes:  # noqa: B006
    """An installer package: tables of columns (name, s or h) and rows."""
    strings: list[str] = []

    def ref(s: str) -> int:
        if s not in strings:
            strings.append(s)
        return strings.index(s) + 1

    bits = {"s": 0x0D00 | 72, "h": 0x0502}
    streams = {}

    def stored(columns: list[tuple[str, str]], rows: list[dict]) -> bytes:
        out = b""
        for name, kind in columns:
            for row in rows:
                v = row.get(name)
                out += struct.pack("<H", 0 if v is None else ref(v) if kind == "s" else (v + 0x8000) & 0xFFFF)
        return out

    catalog = [{"Table": t, "Number": i + 1, "Name": n, "Type": bits[k]} for t, (columns, _) in tables.items() for i, (n, k) in enumerate(columns)]
    for t, (columns, rows) in tables.items():
        streams[packed_name(t, True)] = stored(columns, rows)
    streams[packed_name("_Columns", True)] = stored([("Table", "s"), ("Number", "h"), ("Name", "s"), ("Type", "h")], catalog)
    raw = [s.encode("cp1252") for s in strings]
    streams[packed_name("_StringPool", True)] = struct.pack("<I", 1252) + b"".join(struct.pack("<HH", len(r), 1) for r in raw)
    streams[packed_name("_StringData", True)] = b"".join(raw)
    for name, data in binaries.items():
        streams[packed_name(f"Binary.{name}", False)] = data
    return compound(streams)
