"""A reader of ZIP packages by byte ranges: directories are parsed, stored members located, nothing extracted."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: Signatures of the public ZIP format.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class BadPackage(ValueError):
    """The bytes aren't a ZIP package, or one that this reader can't range-read."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int
    crc: int


class Package:
    """A ZIP package behind ``read_at(offset, length) -> bytes`` and its size."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """(entries, directory size, directory offset), from the ZIP64 record where there is one."""
        tail_at = max(0, self.size - 22 - _FULL16)
        tail = self.read_at(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)  # the signature within a comment
        if at < 0:
            raise BadPackage("no end of central directory")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        place = tail_at + at - 20
        if place >= 0 and (locator := self.read_at(place, 20))[:4] == _LOCATOR:
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = self.read_at(where, 56)
            if record[:4] != _END64:
                raise BadPackage("no ZIP64 end of central directory where its locator points")
            entries, size, offset = struct.unpack_from("<QQQ", record, 32)
        elif _FULL32 in (size, offset) or entries == _FULL16:
            raise BadPackage("no ZIP64 locator")
        return entries, size, offset

    def _directory(self) -> Iterator[Member]:
        entries, size, offset = self._end()
        data = self.read_at(offset, size)
        at = 0
        for _ in range(entries):
            if data[at : at + 4] != _ENTRY:
                raise BadPackage("the central directory breaks off")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", data, at + 16)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, packed, header = self._wide(extra, full, packed, header)
            yield Member(name, method, packed, full, header, crc)
            at += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """The values, those that are full taken in turn from the ZIP64 extra field."""
        at, wide = 0, b""
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                wide = extra[at + 4 : at + 4 + n]
            at += 4 + n
        out, spot = [], 0
        for v in values:
            if v == _FULL32:
                if spot + 8 > len(wide):
                    raise BadPackage("a 64-bit field is missing")
                v = struct.unpack_from("<Q", wide, spot)[0]
                spot += 8
            out.append(v)
        return out

    def data_start(self, name: str) -> int:
        """Where a member's bytes begin: after its local header, whose lengths may differ from the directory's."""
        m = self.members[name]
        head = self.read_at(m.header, 30)
        if head[:4] != _LOCAL:
            raise BadPackage(f"no local header for {name}")
        return m.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, offset: int = 0, length: int | None = None, start: int | None = None) -> bytes:
        """A range of a stored member, as it lies in the package."""
        m = self.members[name]
        if m.method:
            raise BadPackage(f"{name} is compressed, not stored")
        length = m.size - offset if length is None else length
        if offset < 0 or offset + length > m.size:
            raise BadPackage(f"range outside of {name}")
        return self.read_at((self.data_start(name) if start is None else start) + offset, length)
