"""Vectorised subword features of UTF-8 text for the language and toxicity models (numpy)."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)

BITS3, BITS5 = 16, 18
#: ASCII bytes that are no letters become separators.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def lowered(text: str) -> bytes:
    """Lower-case text as bytes in which every ASCII byte but a-z is a space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def pieces(texts, limit: int = 1 << 17):
    """Yield lists of (row, bytes) of about ``limit`` bytes; a longer text is cut at a separator
    (or, without one, at a code point's start), so the arrays made of a list don't depend on a text's length."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        data = lowered(text)
        at = 0
        while at < len(data):
            end = min(len(data), at + limit)
            if end < len(data):
                gap = data.rfind(b" ", at, end)
                if gap > at:
                    end = gap + 1
                else:
                    while end > at + 1 and data[end] & 0xC0 == 0x80:
                        end -= 1
            batch.append((row, data[at:end]))
            size += end - at
            at = end
            if size >= limit:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def features(batch):
    """For pieces: bucket of the 3-gram and of the 5-gram around each letter byte, the index in these
    of each word's first letter byte, each word's piece, and each word's first byte.

    Context never reaches over a word's ends: what lies beyond reads as a space.
    """
    data = b"  " + b"  ".join(p for _, p in batch) + b"  "
    a = np.frombuffer(data, np.uint8)
    c = a[2:-2]
    at = np.flatnonzero(c != 32)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(0, np.uint8)
    at = at + 2
    c = a[at].astype(np.uint64)
    p1, n1 = a[at - 1].astype(np.uint64), a[at + 1].astype(np.uint64)
    p2 = np.where(p1 == 32, 32, a[at - 2]).astype(np.uint64)
    n2 = np.where(n1 == 32, 32, a[at + 2]).astype(np.uint64)
    code3 = p1 | c << np.uint64(8) | n1 << np.uint64(16)
    code5 = code3 << np.uint64(16) | p2 | n2 << np.uint64(8)
    mult = np.uint64(0x9E3779B97F4A7C15)
    i3 = ((code3 + np.uint64(1)) * mult >> np.uint64(64 - BITS3)).astype(np.int64)
    i5 = ((code5 + np.uint64(1)) * mult >> np.uint64(64 - BITS5)).astype(np.int64)
    starts = np.flatnonzero(p1 == 32)
    lengths = np.fromiter((len(p) + 2 for _, p in batch), np.int64, len(batch))
    ends = np.cumsum(lengths)
    piece = np.searchsorted(ends, at[starts] - 2, side="right")
    return i3, i5, starts, piece, a[at[starts]]
