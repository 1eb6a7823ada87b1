"""Little-endian fields of byte strings."""

from __future__ import annotations

from ...functions import text


class DamagedFile(Exception):
    """Not the format, or cut off."""


def u16(data: bytes, at: int) -> int | None:
    return int.from_bytes(data[at : at + 2], "little") if 0 <= at and at + 2 <= len(data) else None


def u32(data: bytes, at: int) -> int | None:
    return int.from_bytes(data[at : at + 4], "little") if 0 <= at and at + 4 <= len(data) else None


def wide(data: bytes) -> str:
    return data[: len(data) // 2 * 2].decode("utf-16-le", "replace")


def wide_to_nul(data: bytes) -> str:
    return wide(data).partition("\0")[0]


def narrow_to_nul(data: bytes) -> str:
    return text.decode(data.partition(b"\0")[0])


def need(value, what: str):
    if value is None:
        raise DamagedFile(what)
    return value
