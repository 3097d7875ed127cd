"""Where to cut a record file that has no sync marks.

``exact`` walks headers, seeking over payloads, so a payload that looks like headers cannot
mislead it. ``sampled`` looks, near each target, for a run of plausible headers; it only
trusts bytes it has read, takes a run that ends at the file's end, and widens its window
until it finds a boundary, so no range is left empty by an unlucky window. It cuts where the run ends, not where
it begins: a run that begins beside a record (a byte early, its length is read from the key's last byte and the lower bytes
of the true one) can only go on once it has come upon a true record, and from there on it is true.
"""

from __future__ import annotations

from typing import BinaryIO

from keytide.functions.keys import HEADER_BYTES


def chain_end(buf: bytes, at: int, max_payload: int, links: int, at_eof: bool, min_payload: int = 0) -> int | None:
    """Where ``links`` plausible records that follow each other from ``at`` end (fewer, if that is exactly the file's end); None if they do not."""
    for _ in range(links):
        if at == len(buf):
            return at if at_eof else None
        if at + HEADER_BYTES > len(buf):
            return None
        size = int.from_bytes(buf[at + 8 : at + 12], "little")
        if not min_payload <= size <= max_payload or at + HEADER_BYTES + size > len(buf):
            return None
        at += HEADER_BYTES + size
    return at


def sampled_splits(
    f: BinaryIO, size: int, parts: int, max_payload: int, links: int = 8, window: int = 1 << 20, min_payload: int = 0
) -> list[int]:
    """parts + 1 non-decreasing byte offsets, first 0 and last ``size``."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    cuts = [0]
    for i in range(1, parts):
        target, found, span = size * i // parts, None, window
        while found is None and target < size:
            f.seek(target)
            buf = f.read(min(span, size - target))
            eof = target + len(buf) >= size
            ends = (chain_end(buf, p, max_payload, links, eof, min_payload) for p in range(len(buf)))
            found = next((target + x for x in ends if x is not None), None)
            if found is None and eof:
                found = size
            span *= 4
        cuts.append(max(cuts[-1], size if found is None else found))
    return [*cuts, size]


def exact_splits(f: BinaryIO, size: int, parts: int) -> list[int]:
    """The same from a walk over all headers: the first record start at or after each target."""
    if parts < 1:
        raise ValueError("parts must be at least 1")
    targets, cuts, at = [size * i // parts for i in range(1, parts)], [0], 0
    while len(cuts) <= len(targets):
        if at >= size:
            cuts.append(size)
        elif at >= targets[len(cuts) - 1]:
            cuts.append(at)
        else:
            f.seek(at + 8)
            head = f.read(4)
            at = size if len(head) < 4 else min(size, at + HEADER_BYTES + int.from_bytes(head, "little"))
    return [*cuts, size]
