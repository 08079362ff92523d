"""Hashed word n-gram sets of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once.
CHUNK = 500_000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and where they start."""
    codes = np.frombuffer(data, np.uint8)
    blank = _BLANK[codes]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    sizes = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(sizes.max()), _BASE, np.uint64))
        h = np.add.reduceat(_BYTES[codes[inside]] * powers[place], first)
        return mixed(h + sizes.astype(np.uint64)), inside[first]


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about CHUNK bytes, cut at blanks."""
    at = 0
    while len(text) - at > CHUNK:
        tail = text[at + CHUNK : at + 2 * CHUNK]
        cut = next((k for k, b in enumerate(tail) if _BLANK[b]), None)
        if cut is None:
            break
        yield text[at : at + CHUNK + cut]
        at += CHUNK + cut
    yield text[at:]


def _grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each n-gram; a document with fewer words has one, of all of them. doc ascends."""
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n if len(whole) else 0):
            whole += h[k : k + len(whole)] * _PLACES[k]
        inside = doc[: len(whole)] == doc[n - 1 :] if len(whole) else np.zeros(0, bool)
        ids, first, counts = np.unique(doc, return_index=True, return_counts=True)
        few = np.flatnonzero(counts < n)
        short = np.array([sum((h[first[i] + k] * _PLACES[k] for k in range(counts[i])), np.uint64(counts[i])) for i in few], np.uint64)
    return np.concatenate([doc[: len(whole)][inside], ids[few]]), mixed(np.concatenate([whole[inside], short]))


def sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The ascending distinct n-gram hashes (int64) of each text, A-Z taken as a-z. Empty for null and for texts without words."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)

    def flush(batch: list[tuple[int, bytes]]) -> None:
        starts = np.cumsum([0, *(len(t) + 1 for _, t in batch)])
        h, at = _word_hashes(b"\n".join(t for _, t in batch))
        doc, g = _grams(h, np.searchsorted(starts, at, side="right") - 1, n)
        g = g.view(np.int64)
        order = np.lexsort((g, doc))
        doc, g = doc[order], g[order]
        new = np.ones(len(g), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
        doc, g = doc[new], g[new]
        cuts = np.searchsorted(doc, np.arange(len(batch) + 1))
        for k, (i, _) in enumerate(batch):
            out[i] = g[cuts[k] : cuts[k + 1]].copy()

    batch, size = [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode().lower()  # of bytes: A-Z alone
        if len(data) > CHUNK:
            h = np.concatenate([_word_hashes(p)[0] for p in _parts(data)])
            out[i] = np.unique(_grams(h, np.zeros(len(h), np.int64), n)[1].view(np.int64)) if len(h) else out[i]
            continue
        batch.append((i, data))
        size += len(data)
        if size > CHUNK:
            flush(batch)
            batch, size = [], 0
    if batch:
        flush(batch)
    return out
