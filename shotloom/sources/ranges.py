"""Byte-range reads of local files, for serving."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Fixed value: bytes a chunk.
CHUNK = 1 << 20


class Unsatisfiable(ValueError):
    """The range cannot be served (status 416)."""


def parse(header: str, size: int) -> tuple[int, int]:
    """First and last byte, both inclusive."""
    found = re.fullmatch(r"bytes=(\d*)-(\d*)", header.strip())
    if found is None:
        raise Unsatisfiable(header)
    a, b = found.groups()
    if b and not a:
        first, last = max(0, size - int(b)), size - 1
    else:
        first, last = int(a or 0), int(b) if b else size - 1
    if first > last or first >= size:
        raise Unsatisfiable(header)
    return first, min(last, size - 1)


def stream(path: str, first: int, last: int, chunk: int = CHUNK) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(first)
        left = last - first + 1
        while left > 0 and (part := f.read(min(chunk, left))):
            left -= len(part)
            yield part


def response(path: str, size: int, header: str | None) -> dict:
    """Status, headers and the byte span of a file response: 200 whole, 206 a part."""
    first, last = parse(header, size) if header else (0, size - 1)
    headers = {"Accept-Ranges": "bytes", "Content-Length": str(last - first + 1)}
    if header:
        headers["Content-Range"] = f"bytes {first}-{last}/{size}"
    return {"status": 206 if header else 200, "headers": headers, "first": first, "last": last}
