"""Substring dedup by super-k-mers.

A window is `width` consecutive words of one document. The minimiser of a window is the least fingerprint of its
`mer`-word runs; consecutive windows that share it travel together, as one packed string of words, to the bucket of
the minimiser, so equal windows always meet. A bucket sorts its windows, compares those whose fingerprints are equal byte by
byte, and finds for each whether the same words start earlier: in a smaller doc_id, or earlier in the same document.

Runs of words that many documents have come last among a window's runs, so that texts around a common phrase don't all go to the phrase's
bucket. Which they are is estimated from about `SAMPLE` documents; this only shares out the work, results don't depend on it.

Before anything is shuffled, each chunk of a scan partition keeps only the first of its equal windows in sequence: the others are
known to have an earlier one and their ranges are settled at once. So copies, common lines and common passages leave a task once
per chunk, whatever their number. The strings of a chunk for one bucket are one compressed blob.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import words as W

MER = 4
#: Bytes of the input's files for each bucket.
BUCKET_BYTES = 2 << 20
CHUNK_BYTES = 8 << 20
NULL_ID = -(1 << 63)
#: Documents that tell which runs are common: those that at least FEW of them and one in SELDOM have.
SAMPLE, FEW, SELDOM = 4_000, 8, 200
CELLS = 1 << 20


def minimisers(h: np.ndarray, width: int, mer: int, common: np.ndarray | None = None) -> np.ndarray:
    """The minimiser of each window of `width` values; runs in common cells come after all others."""
    m = W.windows(h, mer)
    if common is not None:
        m = (m >> np.uint64(1)) | (common[_cells(m)].astype(np.uint64) << np.uint64(63))
    k = width - mer + 1
    n = len(h) - width + 1
    out = m[:n].copy()
    for i in range(1, k):
        np.minimum(out, m[i : i + n], out=out)
    return out


def runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _cells(m: np.ndarray) -> np.ndarray:
    return (m & np.uint64(CELLS - 1)).astype(np.int64)


def common_runs(docs: DataFrame, mer: int) -> np.ndarray:
    """A bit for each cell of runs of `mer` words: whether many documents have its runs."""
    n = max(1, docs.count())
    drawn = docs.filter(F.pmod(F.xxhash64("__key", "__doc"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / n)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            words = W.Words(batch)
            h = W.fingerprints(words.buffer, words.start, words.length)
            ends = [0, *words.ends.tolist()]
            found = [np.unique(_cells(W.windows(h[a:b], mer))) for a, b in zip(ends, ends[1:], strict=False)]
            cell, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(count, pa.int64())], ["cell", "n"])

    least = max(FEW, min(n, SAMPLE) // SELDOM)
    out = np.zeros(CELLS, dtype=bool)
    # at most CELLS numbers
    rows = drawn.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("cell").toArrow()
    out[rows.column(0).to_numpy()] = True
    return out


def later(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray, order: tuple[np.ndarray, np.ndarray], prints: np.ndarray) -> np.ndarray:
    """For windows of `size` bytes from `begin` on: whether an equal window has a smaller (doc, start).

    Windows are sorted by fingerprint, then (doc, start); neighbours are compared byte by byte, and a run of equal
    fingerprints with differing words is told apart by the words themselves.
    """
    doc, at = order
    by = np.argsort(prints)
    ties = prints[by[1:]] == prints[by[:-1]]
    same = np.concatenate([[False], ties])
    among = np.flatnonzero(same | np.concatenate([ties, [False]]))  # only equal fingerprints need the order of (doc, start)
    few = by[among]
    by[among] = few[np.lexsort((at[few], doc[few], prints[few]))]
    hit = np.zeros(len(by), dtype=bool)
    pairs = np.flatnonzero(same)
    here, before = by[pairs], by[pairs - 1]
    equal = (size[here] == size[before]) & W.equal(buffer, begin[here], begin[before], np.minimum(size[here], size[before]))
    group = np.cumsum(~same)
    odd = set(group[pairs[~equal]].tolist())
    first_of = np.maximum.accumulate(np.where(~same, np.arange(len(by)), 0))
    lead = by[first_of]
    hit[by] = same & ((doc[by] != doc[lead]) | (at[by] != at[lead]))
    for g in odd:  # fingerprints collide: group by the words
        seen: dict[bytes, tuple[int, int]] = {}
        for w in by[group == g]:
            words = buffer[begin[w] : begin[w] + size[w]].tobytes()
            place = (int(doc[w]), int(at[w]))
            hit[w] = words in seen and seen[words] != place
            seen.setdefault(words, place)
    return hit


def _ranges(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(a.astype("<i8").tobytes() for a in (doc, key, start, end))


def pack(docs: DataFrame, width: int, mer: int, buckets: int, common=None) -> DataFrame:
    """Blobs of super-k-mers by bucket; in buckets below 0, word ranges (doc, key, start, end) that are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=7)
        flags = None if common is None else common.value
        for batch in W.chunks(batches, size=CHUNK_BYTES):
            doc_id = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc_key = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            # documents in the order of their ids, so that what comes first in the chunk comes first
            order = np.lexsort((doc_key, doc_id))
            doc_id, doc_key = doc_id[order], doc_key[order]
            texts = W.texts(batch)
            found = W.Words.joined([texts[i] for i in order.tolist()])
            del texts
            lens = np.diff(np.concatenate([[0], found.ends]))
            if not len(lens) or lens.max() < width:
                continue
            h = W.fingerprints(found.buffer, found.start, found.length)
            text, place = found.packed()
            until = place + found.length
            buffer = W.padded(text)
            begin = found.ends - lens
            which = np.repeat(np.arange(len(lens)), lens)
            n = len(h) - width + 1
            inside = which[:n] == which[width - 1 :]
            least = minimisers(h, width, mer, flags)
            starts = np.flatnonzero(inside)
            gone = np.zeros(n, dtype=bool)
            gone[starts] = later(buffer, place[starts], until[starts + width - 1] - place[starts], (doc_id[which[starts]], starts - begin[which[starts]]), W.windows(h, width)[starts])
            out_bucket, out_blob = [], []
            if gone.any():
                r = runs(gone)
                # a run may go on into the next document only through windows that are not inside, which are never gone
                d = which[r[:, 0]]
                out_bucket.append(-1 - int(W.mix(doc_id[:1].astype(np.uint64))[0] % np.uint64(buckets)))
                out_blob.append(_ranges(doc_id[d], doc_key[d], r[:, 0] - begin[d], r[:, 1] - begin[d] + width - 1))
            # super-k-mers: runs of windows that stay, of one document, with one minimiser
            stay = inside & ~gone
            cut = np.concatenate([[True], (least[1:] != least[:-1]) | ~stay[:-1] | (which[1:n] != which[: n - 1])])
            first = np.flatnonzero(stay & cut)
            if len(first):
                group = np.cumsum(stay & cut) - 1
                count = np.bincount(group[stay], minlength=len(first))
                bucket = (W.mix(least[first]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                low, high = place[first].tolist(), until[first + count + width - 2].tolist()
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    s, c = first[part], count[part]
                    d = which[s]
                    head = b"".join(a.astype("<i8").tobytes() for a in (doc_id[d], doc_key[d], s - begin[d])) + c.astype("<i4").tobytes()
                    out_bucket.append(int(bucket[part[0]]))
                    out_blob.append(press.compress(np.array([len(part)], "<i8").tobytes() + head + b" ".join([text[low[k] : high[k]] for k in part.tolist()])))
            for k in range(0, len(out_bucket), 512):
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket[k : k + 512], pa.int32()), pa.array(out_blob[k : k + 512], pa.binary())], ["bucket", "blob"])

    return docs.mapInArrow(run, "bucket int, blob binary")


def bucket_ranges(width: int):
    """Word ranges (doc, key, ranges) that are to go, of one bucket."""

    def table(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        order = np.lexsort((start, key, doc))
        doc, key, start, end = doc[order], key[order], start[order], end[order]
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1
        heads = np.concatenate([[0], cuts]) if len(doc) else np.array([], dtype=int)
        pairs = np.column_stack([start, end]).astype("<i4")
        return pa.table({"doc": pa.array(doc[heads], pa.int64()), "key": pa.array(key[heads], pa.int64()), "ranges": pa.array([x.tobytes() for x in np.split(pairs, cuts)] if len(doc) else [], pa.binary())})

    def run(t: pa.Table) -> pa.Table:
        blobs = t.column("blob").to_pylist()
        if t.column("bucket")[0].as_py() < 0:
            own = [np.frombuffer(b, "<i8").reshape(4, -1) for b in blobs]
            return table(*np.concatenate(own, axis=1))
        texts, doc, key, start, count = [], [], [], [], []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            three = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
            doc.append(three[0])
            key.append(three[1])
            start.append(three[2])
            count.append(np.frombuffer(raw, "<i4", n, 8 + 24 * n))
            texts.append(raw[8 + 28 * n :])
        doc, key, start, count = (np.concatenate(x) for x in (doc, key, start, count))
        packed = b" ".join(texts)
        texts.clear()
        buffer = W.padded(packed)
        spaces = np.flatnonzero(buffer[: len(packed)] == 0x20)
        place, until = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(packed)]])
        size = count + width - 1
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        window = base[owner] + step
        prints = W.windows(W.fingerprints(buffer, place, until - place), width)[window]
        gone = later(buffer, place[window], until[window + width - 1] - place[window], (doc[owner], start[owner] + step), prints)
        # runs of gone windows within one super-k-mer
        split = np.concatenate([[True], owner[1:] != owner[:-1]])
        head = np.flatnonzero(gone & (split | ~np.concatenate([[False], gone[:-1]])))
        tail = np.flatnonzero(gone & np.concatenate([split[1:] | ~gone[1:], [True]]))
        o = owner[head]
        return table(doc[o], key[o], start[o] + step[head], start[o] + step[tail] + width)

    return run


def repeated(docs: DataFrame, width: int = 20, mer: int = MER) -> DataFrame:
    """docs with `gone`: the word ranges covered by windows that start earlier elsewhere, as packed pairs of 32-bit numbers; null if none.

    docs needs doc_id and text; other columns stay, whatever their names, but for one named `gone`. Null, empty or short texts have no windows. Rows that share doc_id
    and text are one document, so they don't make each other's windows repeat; rows that share a doc_id with other texts are
    told apart by the text, and of equal windows at equal places in them neither is earlier. A null doc_id comes before all others.
    An empty table gives no rows.
    """
    keyed = docs.drop("gone").select(F.struct(*[c for c in docs.columns if c != "gone"]).alias("row"), F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("__doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__key"))
    buckets = max(64, min(1 << 22, shared.scan_bytes(docs) // BUCKET_BYTES))
    texts = keyed.select("__doc", "__key", F.col("row.text").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_runs(texts, mer))
    ranges = pack(texts, width, mer, buckets, common).groupBy("bucket").applyInArrow(bucket_ranges(width), "doc long, key long, ranges binary")
    ranges = ranges.groupBy("doc", "key").agg(F.array_join(F.collect_list(F.hex("ranges")), "").alias("gone")).withColumn("gone", F.unhex("gone"))
    joined = keyed.join(ranges, (F.col("__doc") == F.col("doc")) & (F.col("__key") == F.col("key")), "left")
    return joined.select("row.*", "gone")


def covered(ranges: bytes | None, n: int) -> np.ndarray:
    """Which of n words the ranges cover."""
    mask = np.zeros(n + 1, dtype=np.int32)
    if ranges:
        pairs = np.frombuffer(ranges, "<i4").reshape(-1, 2)
        np.add.at(mask, pairs[:, 0], 1)
        np.add.at(mask, pairs[:, 1], -1)
    return np.cumsum(mask[:n]) > 0


def kept_words(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            n, removed, kept = [], [], []
            for text, ranges in zip(W.texts(batch), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if ranges:
                    mask = covered(ranges, len(words))
                    stay = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                else:
                    stay = words
                n.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")

