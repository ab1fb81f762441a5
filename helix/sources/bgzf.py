"""Blocked gzip: members of at most 64 KiB that state their own size, so that a file can be read from any of them.

A range of bytes owns the blocks that start in it. Its first block is found by trying each place that looks like a header: the size that it states must lead to another
header, several times or up to the end of the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: Fixed values of the format: how a member with extra fields begins, and the name of the field with its size.
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC"
#: Bytes of a block at most, and headers in a row that make a place a block's.
LARGEST, CHAIN = 1 << 16, 4


def block_size(head: bytes) -> int:
    """Bytes of the block that these begin with; 0 if it isn't one."""
    if len(head) < 18 or head[:4] != MAGIC:
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= end <= len(head):
        n = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == FIELD and n == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return 0


def _head(f: BinaryIO, at: int) -> bytes:
    f.seek(at)
    return f.read(512)


def is_blocked(f: BinaryIO) -> bool:
    return block_size(_head(f, 0)) > 0


def _chained(f: BinaryIO, at: int, size: int) -> bool:
    for _ in range(CHAIN):
        n = block_size(_head(f, at))
        if not n or at + n > size:
            return False
        at += n
        if at == size:
            return True
    return True


def first_block(f: BinaryIO, start: int, size: int) -> int:
    """Where the first block at or after start begins; size if there is none."""
    if start == 0:
        return 0
    at = start
    while at < size:
        f.seek(at)
        window = f.read(LARGEST + len(MAGIC))
        found = window.find(MAGIC)
        while found >= 0:
            if _chained(f, at + found, size):
                return at + found
            found = window.find(MAGIC, found + 1)
        if len(window) <= LARGEST:
            break
        at += LARGEST
    return size


def blocks(f: BinaryIO, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Where each block from the first at or after start begins, and its content, to the end of the file; EOFError where it is cut off."""
    at = first_block(f, start, size)
    while at < size:
        n = block_size(_head(f, at))
        if not n or at + n > size:
            raise EOFError(f"a block at {at} is cut off or isn't one")
        f.seek(at)
        unzip = zlib.decompressobj(31)
        out = unzip.decompress(f.read(n))
        if not unzip.eof:
            raise EOFError(f"the block at {at} is cut off")
        yield at, out
        at += n
