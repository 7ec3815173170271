"""BGZF: gzip members of at most 64 KiB with their size in the header, as BAM files use them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: Fixed values of the format: start of a member, the empty last member, most bytes of content.
MAGIC = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
CONTENT = 0xFF00


def blocks(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(place in the file, content) of every member. A damaged or cut member raises ValueError."""
    place = f.tell()
    while head := f.read(18):
        if len(head) < 18 or head[:4] != MAGIC[:4] or head[12:16] != MAGIC[12:16]:
            raise ValueError(f"no BGZF member at {place}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        body = f.read(size - 18)
        if len(body) < size - 18:
            raise ValueError(f"the BGZF member at {place} is cut off")
        data = zlib.decompress(body[:-8], -15)
        crc, length = struct.unpack("<II", body[-8:])
        if len(data) != length or zlib.crc32(data) != crc:
            raise ValueError(f"the BGZF member at {place} is damaged")
        yield place, data
        place += size


def member(content: bytes, level: int = 1) -> bytes:
    """One compressed member."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(content) + c.flush()
    return MAGIC + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


class Writer:
    """Compresses what is written; ``tell`` is the virtual place: member's place << 16 | place in it."""

    def __init__(self, f: BinaryIO, level: int = 1) -> None:
        self.f, self.level, self.buffer, self.place = f, level, bytearray(), 0

    def tell(self) -> int:
        return self.place << 16 | len(self.buffer)

    def write(self, data: bytes) -> None:
        if len(self.buffer) + len(data) > CONTENT and self.buffer:
            self.flush()
        self.buffer += data
        while len(self.buffer) >= CONTENT:
            self._put(bytes(self.buffer[:CONTENT]))
            del self.buffer[:CONTENT]

    def _put(self, content: bytes) -> None:
        out = member(content, self.level)
        self.f.write(out)
        self.place += len(out)

    def flush(self) -> None:
        if self.buffer:
            self._put(bytes(self.buffer))
            self.buffer.clear()
