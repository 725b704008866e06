"""Words of texts as 64-bit fingerprints, in whole Arrow batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once.
CHUNK_BYTES = 4 << 20


def _settle() -> None:
    """In a Python worker, blocks of a megabyte or more go back to the system when they are freed; workers outlive their tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is not None:
        for option, value in ((_MMAP_THRESHOLD, 1 << 20), (_TRIM_THRESHOLD, 1 << 20), (_ARENA_MAX, 2)):
            tune(option, value)


#: Numbers of mallopt's options.
_TRIM_THRESHOLD, _MMAP_THRESHOLD, _ARENA_MAX = -1, -3, -8

if "pyspark.worker" in sys.modules:
    _settle()


def trim() -> None:
    """Give freed memory back to the system, which a worker that waits for its next task would hold."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = _lengths(column)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).fill_null(b"").to_pylist()


#: Bytes that separate words.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Longer words are hashed one by one.
_LONG = 256


class Words:
    """The words of a batch's texts as places in one buffer: `start` and `length` in bytes, `ends` the number of words up to and with each text."""

    def __init__(self, batch: pa.RecordBatch, text: str = "text", lower: bool = False):
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if len(column) and offsets[-1] > offsets[0] else b""
        self._split(raw.lower() if lower else raw, offsets - offsets[0])

    @classmethod
    def joined(cls, texts: list[bytes]) -> Words:
        """Of texts put together with a space between them."""
        out = cls.__new__(cls)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at[-1] -= bool(texts)
        out._split(b" ".join(texts), at)
        return out

    def _split(self, raw: bytes, at: np.ndarray) -> None:
        self.buffer = padded(raw)
        space = _SPACE[self.buffer[: len(raw)]]
        inside = at[at < len(raw)]
        first = ~space
        first[1:] &= space[:-1]
        first[inside] = ~space[inside]
        last = ~space
        last[:-1] &= space[1:]
        ends = at[at > 0] - 1
        last[ends] = ~space[ends]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.ends = np.searchsorted(self.start, at[1:])

    def packed(self) -> tuple[bytes, np.ndarray]:
        """All words with one space behind each, and where they start there; of texts that don't touch."""
        place = np.cumsum(self.length + 1) - (self.length + 1)
        own = self.buffer[:-7].copy()  # a byte behind the last word is there
        keep = ~_SPACE[own]
        keep[-1] = False
        behind = self.start + self.length
        keep[behind] = True
        own[behind] = 0x20
        return own[keep].tobytes(), place


def padded(raw: bytes) -> np.ndarray:
    """Bytes that can be read eight at a time from any place."""
    return np.frombuffer(raw + bytes(8), dtype=np.uint8)


def _eights(buffer: np.ndarray) -> np.ndarray:
    return np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))


def _some(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The first `rest` bytes of each eight."""
    return x & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - 8 * np.clip(rest, 1, 8).astype(np.uint64)))


def fingerprints(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words of at least one byte, eight bytes of all of them at a time."""
    eights = _eights(buffer)
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at = np.flatnonzero(length <= _LONG), 0
    while len(live):
        rest = length[live] - at
        out[live] = mix(out[live] ^ (_some(eights[start[live] + at], rest) * np.uint64(0xD6E8FEB86659FD93)))
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(length > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buffer[start[i] : start[i] + length[i]])
    return out


def equal(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the `length` bytes at a and at b are equal, for each of many."""
    eights = _eights(buffer)
    out = np.ones(len(a), dtype=bool)
    live, at = np.flatnonzero(length > 0), 0
    while len(live):
        rest = length[live] - at
        same = _some(eights[a[live] + at] ^ eights[b[live] + at], rest) == 0
        out[live[~same]] = False
        live, at = live[same & (rest > 8)], at + 8
    return out


def places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... `count` times, for each of many."""
    at = np.cumsum(count) - count
    return np.repeat(start - at, count) + np.arange(count.sum())


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all windows of `width` consecutive values (none if h is shorter)."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    return mix(out)
