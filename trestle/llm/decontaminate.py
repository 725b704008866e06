"""Benchmark decontamination: hits of test windows in training texts.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lowered. A window is
`width` consecutive words of an item; an item with fewer words is one window of all of them. The fingerprints of all
windows are broadcast as sorted arrays. Texts are scanned in Arrow batches: a word that no item has ends every
window that would cover it, the remaining windows are looked up by fingerprint, and each hit is verified word by word.
There is no shuffle, and no key that could be hot.

The broadcast has a bound: items are dealt into blocks of at most `block_words` words (a longer item is a block of its
own), and the texts are scanned once for each block, in one pass over the table each, with the hits of blocks joined
by row. One block is the usual case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Every ASCII character but letters and digits separates words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_WORDS = 1_000_000


def split(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Index:
    """Windows of benchmark items by number of words: sorted fingerprints, the words behind them, and the items of each, all as arrays."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int):
        self.width = width
        self.words: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        texts = [np.fromiter((self.words.setdefault(w, len(self.words) + 1) for w in split(text)), dtype=np.int32) for _, text in items]
        self.prints, self.grams, self.owners = {}, {}, {}
        for n in sorted({min(width, len(x)) for x in texts} - {0}):
            own = [k for k, x in enumerate(texts) if min(width, len(x)) == n]
            every = np.concatenate([np.lib.stride_tricks.sliding_window_view(texts[k], n) for k in own])
            owner = np.repeat(np.array(own), [len(texts[k]) - n + 1 for k in own])
            grams, of = np.unique(every, axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack([of.ravel(), owner]), axis=0)
            prints = _prints(grams)
            order = np.argsort(prints, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            at = place[pairs[:, 0]]
            self.prints[n], self.grams[n] = prints[order], grams[order]
            # the items of window j: from ends[j] to ends[j + 1]
            self.owners[n] = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(order)))]), pairs[np.argsort(at, kind="stable"), 1].astype(np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, items' numbers) of each window of the index in a row of word ids, 0 for a word of no item."""
        for n, prints in self.prints.items():
            if len(ids) < n:
                continue
            known = np.concatenate([[0], np.cumsum(ids != 0)])
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            got = W.windows(ids.astype(np.uint64), n)[starts]
            at = np.searchsorted(prints, got)
            likely = np.flatnonzero((at < len(prints)) & (prints[np.minimum(at, len(prints) - 1)] == got))
            ends, owners = self.owners[n]
            for k in likely:
                start, j = int(starts[k]), int(at[k])
                while j < len(prints) and prints[j] == got[k]:
                    if np.array_equal(self.grams[n][j], ids[start : start + n]):
                        yield start, start + n, owners[ends[j] : ends[j + 1]]
                        break
                    j += 1


def _prints(grams: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of word ids, as of windows."""
    out = grams[:, 0].astype(np.uint64)
    for k in range(1, grams.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64)
    return W.mix(out)


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, `spans` (array of word ranges [start, end) that are hit, merged) and `items` (ids of the items found).

    docs needs text, benchmark item_id and text. Null or empty texts have no words; items without words hit nothing; a
    null item_id is not listed but its windows count. Items of equal text are all listed. Rows that repeat are
    scanned each by itself; empty tables are allowed on either side. Columns of docs stay; those named n_words, spans or items
    are replaced. The benchmark is streamed to the driver block by block and broadcast one block at a time.
    """
    docs = docs.drop("n_words", "spans", "items")
    spark = docs.sparkSession
    kept = docs.columns
    out = docs.withColumns({"n_words": F.lit(None).cast("long"), "spans": F.expr("CAST(array() AS array<struct<start:int,end:int>>)"), "items": F.expr("CAST(array() AS array<bigint>)")})
    schema = out.schema

    def scanner(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = index.value
            lookup = found.words.get
            for batch in W.chunks(batches):
                n_words, spans, items = [], [], []
                before = zip(batch.column(batch.schema.get_field_index("spans")).to_pylist(), batch.column(batch.schema.get_field_index("items")).to_pylist(), strict=True)
                for text, (old, had) in zip(W.texts(batch), before, strict=True):
                    words = split(text)
                    ids = np.fromiter((lookup(w, 0) for w in words), dtype=np.int64, count=len(words))
                    ranges, own = [(s["start"], s["end"]) for s in old], set(had)
                    if ids.any():
                        for start, end, who in found.hits(ids):
                            ranges.append((start, end))
                            own.update(found.names[k] for k in who.tolist())
                    n_words.append(len(words))
                    spans.append(merged(ranges))
                    items.append(sorted(x for x in own if x is not None))
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                target = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(spans, target), pa.array(items, pa.list_(pa.int64()))], [*kept, "n_words", "spans", "items"])

        return run

    def dealt() -> Iterator[list]:
        held, n = [], 0
        for r in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
            text = bytes(r["text"] or b"")
            k = len(split(text))
            if held and n + k > block_words:
                yield held
                held, n = [], 0
            held.append((r["item_id"], text))
            n += k
        yield held

    from . import shared

    for number, items in enumerate(dealt()):
        if number:
            out = shared.table(out, "hits")
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast(Index(items, width))), schema)
    return out


def merged(ranges: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def n_hit():
    return F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def remove_spans(docs: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """docs whose text lacks the words that are hit: from the first character of a span's first word to the last one of its last."""
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(rb"[0-9a-z\x80-\xff]+")
        for batch in W.chunks(batches, text):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for i, own in enumerate(batch.column(batch.schema.get_field_index(spans)).to_pylist()):
                if own:
                    raw = texts[i].encode()
                    places = [m.span() for m in word.finditer(raw.translate(_LOWER))]
                    for s in reversed(own):
                        raw = raw[: places[s["start"]][0]] + raw[places[s["end"] - 1][1] :]
                    texts[i] = raw.decode()
            yield batch.set_column(at, kept[at], pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
