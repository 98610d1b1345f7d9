"""Words of whole texts as numpy arrays, a few megabytes of text at a time.

Texts are Arrow columns; a null text counts as empty. Words are runs of bytes
outside the six ASCII blanks, which is the same on UTF-8 bytes as on code
points. A word is represented by a 64-bit hash of its bytes: equal words have
equal hashes, and two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

GROUP_BYTES = 8 << 20  # texts handled together, unless one alone is longer
PIECE_BYTES = 1 << 20  # bytes hashed at a time

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: A pseudo-random odd number for each byte value.
BYTE_VALUE = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for pieces of the usual size."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    made = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
    made[0] = 1
    np.multiply.accumulate(made, out=made)
    if len(made) == PIECE_BYTES + 1:
        _powers[base] = made
    return made[:n]


INVERSE = pow(BASE, -1, 2**64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans data[starts[i]:ends[i]]."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Neighbouring rows of a column: ``data[bounds[i]:bounds[i+1]]`` is row i."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_groups(column: pa.Array | pa.ChunkedArray, limit: int = GROUP_BYTES) -> Iterator[Texts]:
    """The rows of a string column in order, in groups of at most ``limit``
    bytes; a longer text is a group of its own."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if len(chunk) == 0:
            continue
        flat = pc.fill_null(chunk, "").cast(pa.large_binary())
        _, at, body = flat.buffers()
        bounds = np.frombuffer(at, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(body or b"", dtype=np.uint8)
        low = 0
        while low < len(flat):
            high = int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1
            high = min(max(high, low + 1), len(flat))
            yield Texts(
                base + low,
                data[bounds[low] : bounds[high]],
                bounds[low : high + 1] - bounds[low],
            )
            low = high
        base += len(flat)


@dataclass
class Words:
    """Words of a group of texts, in order: their hashes, where they start and
    end in the group's bytes, and ``bounds`` of each text's words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def _cuts(data: np.ndarray, blank: np.ndarray) -> list[int]:
    """Where to cut bytes into pieces: at blanks, so that no word is cut."""
    cuts = [0]
    while len(data) - cuts[-1] > PIECE_BYTES:
        low, reach = cuts[-1], PIECE_BYTES
        while True:
            blanks = np.flatnonzero(blank[data[low : low + reach]])
            if len(blanks) or low + reach >= len(data):
                break
            reach *= 2
        # A cut after a blank leaves something behind, so pieces shrink.
        cuts.append(low + int(blanks[-1]) + 1 if len(blanks) else len(data))
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return cuts


def words_of(texts: Texts, lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    """All words of the group; with ``lower``, A-Z count as a-z. ``blank`` tells
    which byte values stand between words."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = _cuts(texts.data, blank)
    for low, high in zip(cuts, cuts[1:], strict=False):
        piece = texts.data[low:high]
        if lower:
            piece = LOWER[piece]
        inner = texts.bounds[
            np.searchsorted(texts.bounds, low, "right") : np.searchsorted(texts.bounds, high)
        ] - low
        word = ~blank[piece]
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        before[inner] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[inner - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        parts.append((span_hashes(piece, starts, ends), starts + low, ends + low))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(texts.bounds), np.int64))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(hashes, starts, ends, np.searchsorted(starts, texts.bounds))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n neighbouring words; across text bounds as well."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total += mix(hashes[k : len(hashes) - n + 1 + k] + np.uint64(k * 0x632BE59BD9B4E019 % 2**64))
    return mix(total + np.uint64(n))


# Workers get this module with the functions that use it, so that they need not
# have the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
