"""64-bit hashes of the words of many texts at once, by array operations on their bytes."""

from __future__ import annotations

import numpy as np

_BASE, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 64), _BASE, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, and begins and ends of its words (runs without ASCII white space)."""
    b = np.frombuffer(data, np.uint8)
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return b, edges[::2], edges[1::2]


def word_hashes(texts: list[str | None], lower: bool = False, block: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many each text has.

    ``lower`` takes A-Z as a-z.  A null text has no words.  Texts are worked on in blocks of about ``block`` bytes,
    cut at white space, so that the memory used doesn't follow the longest text but its longest word.
    """
    hashes, counts = [], []
    for group in _blocks([(t or "").encode("utf-8", "surrogatepass") for t in texts], block):
        data, owners, n = group
        b, begins, ends = word_spans(data)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
        counts.append((owners, begins, n))
        if not len(begins):
            hashes.append(np.zeros(0, np.uint64))
            continue
        lengths = ends - begins
        owner = np.repeat(np.arange(len(begins)), lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        letters = b[place + begins[owner]].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(letters * powers(int(lengths.max()))[place], np.cumsum(lengths) - lengths)
        hashes.append(mixed(sums + lengths.astype(np.uint64) * _C2))
    per_text = np.zeros(len(texts), np.int64)
    for owners, begins, _ in counts:
        at = np.array([o for o, _ in owners], np.int64)
        starts = np.array([s for _, s in owners], np.int64)
        per_text += np.bincount(at[np.searchsorted(starts, begins, "right") - 1], minlength=len(texts)) if len(begins) else 0
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), per_text


def _blocks(texts: list[bytes], block: int):
    """(bytes, [(text, where it begins)], size) of joined texts; long texts are cut before a white space."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        first = 0
        while first < len(t):
            last = min(len(t), first + block)
            if last < len(t):
                cut = max(t.rfind(c, first, last) for c in (b" ", b"\n", b"\t"))
                if cut <= first:
                    found = [p for p in (t.find(c, last) for c in (b" ", b"\n", b"\t")) if p >= 0]
                    cut = min(found) if found else len(t)
                last = cut
            owners.append((i, size))
            parts.append(t[first:last])
            size += last - first + 1
            first = last
            if size >= block:
                yield b"\n".join(parts), owners, size
                parts, owners, size = [], [], 0
    if parts:
        yield b"\n".join(parts), owners, size


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(len(hashes) - n + 1, np.uint64), 1
    for k in range(n):
        factor = (factor * int(_BASE) + 2 * k) % 2**64
        total += hashes[k : len(hashes) - n + 1 + k] * np.uint64(factor)
    return mixed(total + np.uint64(n))
