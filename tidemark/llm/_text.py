"""Word arrays for Arrow batches: many texts become one array of 64-bit word hashes.

Used inside tasks only.  A word is a maximal run of bytes that are not
separators; ``normal_words`` takes ``\\x20`` and ``\\x09-\\x0D`` as separators (every
other character, any script, belongs to a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20          # texts are hashed in chunks of about this size; arrays take 8 bytes a byte

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15                       # odd, so it has an inverse mod 2**64
_INV = pow(_BASE, -1, 2**64)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for k, b in (("p", _BASE), ("q", _INV)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"], _pow["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def normal_words(text: bytes | None) -> bytes:
    """The words of a text joined by one space (bytes.split cuts at \\x20, \\x09-\\x0D)."""
    return b" ".join(text.split()) if text else b""


def n_words(normal: bytes) -> int:
    return normal.count(b" ") + 1 if normal else 0


def word_hashes(normals: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the texts: len + 1) of texts in normal form."""
    counts = np.fromiter((n_words(x) for x in normals), np.int64, len(normals))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    full = [x for x in normals if x]
    if not full:
        return np.empty(0, np.uint64), offsets
    buf = np.frombuffer(b" ".join(full) + b" ", np.uint8)
    p, q = _powers(len(buf))
    ends = np.flatnonzero(buf == 32)
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    v = _BYTE[buf]
    v *= p[:len(buf)]
    s = np.empty(len(buf) + 1, np.uint64)
    s[0] = 0
    np.cumsum(v, out=s[1:])
    h = (s[ends] - s[starts]) * q[starts]
    return mix(h + (ends - starts).astype(np.uint64)), offsets


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words of the array (len - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    m = np.uint64(_BASE)
    for i in range(k):                        # k fused passes beat power tables for small k
        h *= m
        h += words[i:i + n]
    return mix(h)


def chunks(texts: list, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes and at most ``rows`` texts
    each (at least one text)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > limit or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def as_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` bytes of text each (at least one
    row), so that what is made of a run stays small however large a batch is."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def carried(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    """(id, text, ...) batches; of (row) batches, whose struct holds the whole input row, the id
    and the text are taken out of it, so that a text travels once."""
    for b in batches:
        if b.schema.names[:1] == ["row"]:
            row = b.column(0)
            kind = row.type
            parts = [row.field(kind.get_field_index(c)) for c in (id_col, text_col)]
            b = pa.RecordBatch.from_arrays([*parts, *b.columns[1:], row], names=["id", "text", *b.schema.names[1:], "row"])
        yield b
