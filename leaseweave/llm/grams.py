"""Byte n-gram counts of many texts at once, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text worked on at once; a longer text is taken in parts of this size.
PIECE_BYTES = 2 << 20


def groups(data: list[bytes]) -> Iterator[list[int]]:
    """Positions of neighbouring texts that together stay under PIECE_BYTES, or one long text alone."""
    held, size = [], 0
    for i, x in enumerate(data):
        if held and size + len(x) > PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(x)
    if held:
        yield held


def trigrams(data: list[bytes], table: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in `data`, hashed code) of each trigram of bytes mapped by `table` to `width` bits."""
    raw = table[np.frombuffer(b"".join(data), np.uint8)].astype(np.uint32)
    ends = np.cumsum([len(x) for x in data])
    code = raw[:-2] << (2 * width) | raw[1:-1] << width | raw[2:]
    owner = np.repeat(np.arange(len(data), dtype=np.int32), [len(x) for x in data])
    inside = owner[:-2] == owner[2:]
    del ends
    hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return owner[:-2][inside], hashed[inside]


def counts(data: list[bytes], table: np.ndarray, width: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of texts: their positions, and (text within the group, code, count) of all distinct codes, by text."""
    for at in groups(data):
        if len(at) == 1 and len(data[at[0]]) > PIECE_BYTES:
            total, text = np.zeros(1 << bits, np.int64), data[at[0]]
            for i in range(0, len(text), PIECE_BYTES):
                total += np.bincount(trigrams([text[i : i + PIECE_BYTES + 2]], table, width, bits)[1], minlength=1 << bits)
            code = np.flatnonzero(total)
            yield np.array(at), np.zeros(code.size, np.int64), code, total[code]
        else:
            owner, code = trigrams([data[i] for i in at], table, width, bits)
            both, n = np.unique(owner.astype(np.int64) << bits | code, return_counts=True)
            yield np.array(at), both >> bits, both & ((1 << bits) - 1), n
