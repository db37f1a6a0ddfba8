"""Prefix-free parsing of texts: a rolling hash triggers phrase boundaries, by content alone."""

from __future__ import annotations

import numpy as np

from govlens.llm.common import mix, spans_hash

#: Bytes of the rolling hash, and of the key at a trigger.
ROLL, KEY = 8, 32
_BYTE = mix(np.arange(256).astype(np.uint64) + np.uint64(15485863))
#: Other values of bytes, for a second hash of a phrase's content.
_CHECK = mix(np.arange(256).astype(np.uint64) + np.uint64(982451653))


def rolling(raw: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ROLL bytes from each position on."""
    x = raw.astype(np.uint64)
    for width in (1, 2, 4):
        y = np.zeros_like(x)
        y[:-width] = x[width:]
        x |= y << np.uint64(8 * width)
    return mix(x) >> np.uint64(32)


def triggers(raw: np.ndarray, span: int) -> np.ndarray:
    """For each position the first position among the next span with the least rolling hash: the same for equal bytes."""
    n = len(raw)
    v = (rolling(raw) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        np.minimum(v[: n - width], v[width:], out=v[: n - width])
        width *= 2
    if span > width:
        rest = span - width
        v[: n - rest] = np.minimum(v[: n - rest], v[rest:])
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cut each text of at least length bytes into phrases: (text, start, n, trigger, key, content, check).

    A phrase is the n positions that share a trigger, which lies so many bytes after its start. Its content hashes (content and check, 128 bits together) cover the bytes [start, start + n - 1 + length),
    so equal contents hold equal strings of length bytes at every position; equal strings of that length always lie in
    phrases of equal key, as both their triggers and the KEY bytes there are inside them.
    """
    span = length - KEY + 1
    if span < 1:
        raise ValueError(f"length must be at least {KEY}")
    ends = offsets[1:] - length + 1
    starts = offsets[:-1]
    long = np.flatnonzero(ends > starts)
    empty = np.zeros(0, np.int64)
    if not len(long):
        return empty, empty, empty, empty, *[empty.view(np.uint64)] * 3
    at = triggers(raw, span)
    new = np.zeros(len(raw) + 1, bool)
    new[1:-1] = at[1:] != at[:-1]
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long], -1)
    inside = np.cumsum(inside[:-1]) > 0
    new[starts[long]] = True
    first = np.flatnonzero(new[:-1] & inside)
    text = np.searchsorted(offsets, first, side="right") - 1
    stop = np.minimum(np.concatenate((first[1:], [len(raw)])), ends[text])
    n = stop - first
    value = _BYTE[raw]
    trigger = at[first]
    key = spans_hash(value, trigger, trigger + KEY)
    content = mix(spans_hash(value, first, stop - 1 + length) + mix((trigger - first).astype(np.uint64)))
    check = mix(spans_hash(_CHECK[raw], first, stop - 1 + length) ^ n.astype(np.uint64))
    return text, first - offsets[text], n, trigger - first, key, content, check
