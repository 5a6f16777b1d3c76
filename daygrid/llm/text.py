"""Word hashes of whole texts in numpy, a bounded block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WHITE)] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_number(value: int, salt: int = 0) -> int:
    return int(mix(np.array([(value + salt * _BASE) & (2**64 - 1)], dtype=np.uint64))[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]))
                 for base in (_BASE, pow(_BASE, -1, 2**64)))


def _hash_block(data: bytes, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one block."""
    if not data:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[codes], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = powers if len(powers[0]) > len(codes) else _powers(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    return mix(found + (ends - starts).astype(np.uint64)), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in blocks that end at white space."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in WHITE:
            end += 1
        yield data[at:end]
        at = end


def doc_words(docs: list[bytes | None], lower: bool) -> Iterator[np.ndarray]:
    """The 64-bit word hashes of each document, in order; nothing for null."""
    fold = (lambda b: b.lower()) if lower else (lambda b: b)
    held: list[bytes] = []
    size = 0
    powers = _powers(min(BLOCK + 1, sum(len(d or b"") + 1 for d in docs)))

    def flush() -> Iterator[np.ndarray]:
        hashes, starts = _hash_block(fold(b" ".join(held)), powers)
        begins = np.cumsum([0, *[len(d) + 1 for d in held]])
        cuts = np.searchsorted(starts, begins)
        for i in range(len(held)):
            yield hashes[cuts[i] : cuts[i + 1]]

    for doc in docs:
        doc = doc or b""
        if held and size + len(doc) > BLOCK:
            yield from flush()
            held, size = [], 0
        if len(doc) > BLOCK:
            yield np.concatenate([_hash_block(fold(p), powers)[0] for p in _pieces(doc)])
        else:
            held.append(doc)
            size += len(doc) + 1
    if held:
        yield from flush()


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(_BASE) + words[i : i + n])
    return out
