"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct word shingles, as 64-bit fingerprints; documents with equal sets are one *class*,
named by a 128-bit digest of the set. Tokens are hashed into `GROUPS` groups, and the counts of a set's groups are its
point. The overlap of two sets is at most the sum of the coordinate minima of their points, so a pair can be
linked only if 185 * sum >= 85 * (a + b) for sizes a, b (at 85 per cent). An R-tree's node keeps the coordinate maxima
of its points, with which the same sum bounds every pair below it. The points of large sets have more groups, about 16 tokens to each,
or any two of them would seem to overlap; they are added up to `GROUPS` for the tree, and to the fewer groups of the two for a pair that it finds.

1. A sketch counts the tokens that prefixes could hold, over all documents, to order common tokens last.
2. Sets that are linked share a token among the first n - ceil(t n) + 1 of their ordered tokens. Each class goes by name
   to the buckets of these tokens; tokens of one class end there. What is left are sets of classes that hold a token, each set once
   however many tokens have it. Points join these sets, and the R-tree finds the pairs whose bound holds. The result is the
   edges of a spanning forest, not pairs.
3. Classes connected by such edges meet once with their whole sets; the R-tree finds pairs again, skips nodes
   whose points are already connected with the query, and the surviving pairs are verified by intersection.
   Large candidate components are dealt into blocks that meet pairwise.
4. Components of the verified edges give each document the least doc_id it can reach.

No pair of documents is dropped anywhere. Hot tokens come last in the order, copies are one class from the map side on,
and all rows of a bucket or block are arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as C
from . import shared
from . import words as W

GROUPS, MOST_GROUPS = 128, 1 << 14
#: Tokens to a group where whole sets of different blocks are compared.
FINE = 2
LEAF = 32
#: A candidate component of more classes is dealt into blocks of about so many, and a set of holders into blocks of at most so many.
BLOCK, SPLIT = 4096, 4096
#: A token that prefixes hold more often has its holders dealt over several buckets from the start.
HELD = 1 << 20
#: Up to so many candidate documents (about 60 bytes each with their class) are broadcast; more are joined by shuffle.
BROADCAST_DOCS = 500_000
#: Classes with more copies than this, and than one in MANY of all rows, are named by broadcast: they can't be more than MANY.
FEW_COPIES, MANY = 1_000, 20_000
MAX_LONG = (1 << 63) - 1


def sets(batches: Iterator[pa.RecordBatch], width: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each chunk with the sorted distinct shingle fingerprints of its texts."""
    for batch in W.chunks(batches, text):
        words = W.Words(batch, text, lower=True)
        h = W.fingerprints(words.buffer, words.start, words.length)
        ends = [0, *words.ends.tolist()]
        grams = W.windows(h, width)
        out = []
        for a, b in zip(ends, ends[1:], strict=False):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                out.append(W.windows(h[a:b], b - a) ^ np.uint64(b - a))
            else:
                out.append(h[:0])
        yield batch, out


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def points(all_sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """Counts of each set's tokens by group; bytes if they fit."""
    most = max((len(s) for s in all_sets), default=0)
    out = np.zeros((len(all_sets), groups), dtype=np.uint32 if most > 65535 else np.uint16)
    for i, s in enumerate(all_sets):
        out[i] = np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return out.astype(np.uint8) if len(out) and out.max() < 256 else out


def fine_groups(most: int) -> int:
    """Groups for whole sets of up to `most` tokens: about two tokens each, so that the bound is close to the overlap."""
    return min(4096, max(GROUPS, 1 << max(0, most // 2 - 1).bit_length()))


def resolution(n: int, each: int = 16) -> int:
    """Groups of the point of a set of n tokens, so that a group has up to about `each`."""
    return min(MOST_GROUPS, max(GROUPS, 1 << max(0, n // each - 1).bit_length()))


def point_bytes(s: np.ndarray, each: int = 16) -> bytes:
    """Counts of the set's tokens by group at its own resolution; bytes if they fit."""
    groups = resolution(len(s), each)
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return counts.astype("u1" if counts.max() < 256 else "<u4").tobytes()


def read_point(raw: bytes, n: int, each: int = 16) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == resolution(n, each) else "<u4").astype(np.int32)


class Points:
    """Points at their own resolutions: added up to `GROUPS` in `coarse`, and bounds of pairs at the lesser resolution of the two."""

    def __init__(self, raw: list[bytes], size: np.ndarray, each: int = 16):
        self.own = [read_point(x, n, each) for x, n in zip(raw, size.tolist(), strict=True)]
        self.groups = np.array([len(x) for x in self.own], dtype=np.int64)
        self.coarse = np.array([x.reshape(-1, GROUPS).sum(axis=0) for x in self.own], dtype=np.int32).reshape(-1, GROUPS)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        if groups not in self.levels:
            of = np.flatnonzero(self.groups >= groups)
            place = np.zeros(len(self.own), dtype=np.int64)
            place[of] = np.arange(len(of))
            self.levels[groups] = np.array([self.own[k].reshape(-1, groups).sum(axis=0) for k in of], dtype=np.int32), place
        return self.levels[groups]

    def __call__(self, q: int, others: np.ndarray) -> np.ndarray:
        """Bounds of overlaps; no bound where there is no better one than the coarse points give."""
        out = np.full(len(others), 1 << 50, dtype=np.int64)
        groups = np.minimum(self.groups[others], self.groups[q])
        for g in np.unique(groups[groups > GROUPS]).tolist():
            rows, place = self.level(g)
            k = np.flatnonzero(groups == g)
            out[k] = np.minimum(rows[place[others[k]]], rows[place[q]]).sum(axis=1, dtype=np.int64)
        return out


class Forest:
    """Union-find over 0..n-1; a root is its component's least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)

    def roots(self, idx: np.ndarray) -> np.ndarray:
        r = self.up[idx]
        while True:
            rr = self.up[r]
            if np.array_equal(rr, r):
                self.up[idx] = r
                return r
            r = rr


class RTree:
    """Points of count vectors, packed into leaves by splitting at medians of the widest coordinate."""

    def __init__(self, p: np.ndarray, size: np.ndarray):
        leaves, stack = [], [np.arange(len(p))]
        while stack:
            idx = stack.pop()
            if len(idx) <= LEAF:
                leaves.append(idx)
                continue
            own, sizes = p[idx], size[idx]
            spread = own.max(axis=0) - own.min(axis=0)
            dim = int(spread.argmax())
            order = np.argsort(sizes if sizes.max() - sizes.min() > spread[dim] else own[:, dim], kind="stable")
            half = len(idx) // 2
            stack += [idx[order[:half]], idx[order[half:]]]
        self.leaves = leaves
        self.high = np.array([p[x].max(axis=0) for x in leaves])
        self.least = np.array([size[x].min() for x in leaves])

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points of the leaves whose bound with a point holds."""
        bound = np.minimum(self.high, point).sum(axis=1, dtype=np.int64)
        open_ = np.flatnonzero(reach(bound, size, self.least, percent))
        return np.concatenate([self.leaves[k] for k in open_]) if len(open_) else open_


def reach(overlap: np.ndarray, a: int | np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b are linked if they share so many tokens."""
    return (100 + percent) * overlap >= percent * (a + b)


class Overlaps:
    """Exact overlaps of one set with many others."""

    def __init__(self, own: list[np.ndarray]):
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int64)
        tokens, self.flat = np.unique(np.concatenate(own), return_inverse=True)
        self.mark = np.zeros(len(tokens), dtype=np.int32)

    def __call__(self, q: int, others: np.ndarray) -> np.ndarray:
        mine = self.flat[self.starts[q] : self.starts[q + 1]]
        self.mark[mine] = 1
        begin, n = self.starts[others], self.starts[others + 1] - self.starts[others]
        at = np.cumsum(n) - n
        hits = self.mark[self.flat[np.repeat(begin - at, n) + np.arange(n.sum())]]
        self.mark[mine] = 0
        return np.add.reduceat(hits, at, dtype=np.int64)  # no set is empty


def connect(p: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int, exact: Callable[[int, np.ndarray], np.ndarray] | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the components of all pairs that are linked, by the points' bound and, if `exact` is given, by the overlaps or bounds that it tells.

    label says what is connected already. Every pair of two components is looked at once, or with `queries` every pair that
    has a query, until all are connected.
    """
    names, label = np.unique(label, return_inverse=True)
    left, edges = len(names), []
    if left < 2:
        return edges
    tree = RTree(p, size) if len(p) > LEAF else None
    for q in range(len(p)) if queries is None else queries.tolist():
        near = np.arange(q + 1 if queries is None else 0, len(p)) if tree is None else tree.near(p[q], int(size[q]), percent)
        if queries is None and tree is not None:
            near = near[near > q]
        near = near[label[near] != label[q]]
        if not len(near):
            continue
        over = np.minimum(p[near], p[q]).sum(axis=1, dtype=np.int64)
        yes = reach(over, int(size[q]), size[near], percent)
        near = near[yes][np.argsort(-over[yes], kind="stable")]
        at, step = 0, len(near) if exact is None else LEAF
        while at < len(near):  # the likeliest first: components that they join needn't be looked at again
            some = near[at : at + step]
            at, step = at + step, 8 * step
            some = some[label[some] != label[q]]
            if exact is not None and len(some):
                some = some[reach(exact(q, some), int(size[q]), size[some], percent)]
            found, first = np.unique(label[some], return_index=True)
            if len(found):
                edges += [(q, int(j)) for j in some[first]]
                label[np.isin(label, found)] = label[q]
                left -= len(found)
        if left == 1:
            break
    return edges


def hot_tokens(docs: DataFrame, width: int, percent: int, bits: int, times: int = 8, least: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each of 2**bits cells of tokens: whether prefixes hold its tokens `times` more often than the mean cell's, and in how many pieces the holders of such a token are dealt."""
    cells = 1 << bits
    part = min(cells, 1 << 14)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for _, chunk in sets(batches, width):
            likely = [s[: prefix_length(len(s), percent) * 3 // 2 + 8] for s in chunk if len(s)]
            if likely:
                total += np.bincount((np.concatenate(likely) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        rows = total.reshape(-1, part)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in rows], pa.binary())], ["part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, dtype="<i8") for c in t.column("counts").to_pylist())
        return pa.table({"part": t.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    summed = docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    counts = np.zeros(cells, dtype=np.int64)
    for r in summed.toLocalIterator():  # 2**bits numbers, whatever the size of the input
        counts[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["counts"], dtype="<i8")
    pieces = 1 + counts // max(HELD, int(64 * counts.mean()))
    return counts > max(least, times * counts.mean()), np.minimum(pieces, 1 << 15).astype(np.uint16)


def _blob(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unblob(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths = np.frombuffer(raw, "<i8", n, 8)
    at, out = 8 * (n + 1), []
    for k, size in zip(kinds, lengths, strict=True):
        out.append(np.frombuffer(raw, k, int(size) // np.dtype(k).itemsize, at))
        at += int(size)
    return out


def index(docs: DataFrame, width: int, percent: int, hot, buckets: int) -> DataFrame:
    """Blobs by bucket: prefix tokens with their classes, and in buckets below 0 what documents and points there are.

    A token whose cell is dealt in pieces goes to the buckets of its pieces, from `buckets` on, each class to one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, pieces = hot.value
        split = bool((pieces > 1).any())
        mask = np.uint64(len(flags) - 1)
        for batch, chunk in sets(batches, width):
            ids = [digest(s) if len(s) else None for s in chunk]
            doc, sub = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype("<i8") for c in ("doc_id", "sub"))
            named = np.frombuffer(b"".join(i or bytes(16) for i in ids), "u1")
            first: dict[bytes, int] = {}
            for k, i in enumerate(ids):
                if i is not None:
                    first.setdefault(i, k)
            places = np.fromiter(first.values(), dtype="<i4", count=len(first))
            unique = [chunk[k] for k in places]
            p = [point_bytes(s) for s in unique]
            own = _blob(doc, sub, np.array([len(s) for s in chunk], dtype="<i8"), named, places, np.array([len(x) for x in p], dtype="<i4"), np.frombuffer(b"".join(p), "u1"))
            out_bucket, out_blob = [-1 - int(W.mix(doc[:1].astype(np.uint64))[0] % np.uint64(buckets))], [own]
            if unique:
                key = np.frombuffer(b"".join(i[:8] for i in first), dtype=">i8").astype("<i8")
                tokens, owners = [], []
                for k, s in enumerate(unique):
                    m = prefix_length(len(s), percent)
                    common = flags[(s & mask).astype(np.int64)]
                    rare = s[~common][:m]
                    tokens.append(rare if len(rare) == m else np.concatenate([rare, s[common][: m - len(rare)]]))
                    owners.append(np.full(m, k, dtype="<i4"))
                token, owner = np.concatenate(tokens), np.concatenate(owners)
                if split:
                    n = pieces[(token & mask).astype(np.int64)]
                    for k in np.unique(n[n > 1]).tolist():
                        of = np.flatnonzero(n == k)
                        piece = W.mix(key[owner[of]].astype(np.uint64)) % np.uint64(k)
                        to = (W.mix(token[of] + piece) % np.uint64(buckets)).astype(np.int64) + buckets
                        for b in np.unique(to).tolist():
                            out_bucket.append(b)
                            out_blob.append(_blob(token[of[to == b]], piece[to == b], key[owner[of[to == b]]]))
                    token, owner = token[n == 1], owner[n == 1]
                bucket = (token % np.uint64(buckets)).astype(np.int64)
                # 32 bits tell the tokens of a bucket apart well enough: a false match costs a look at its bound
                short = ((token // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                    who, inverse = np.unique(owner[part], return_inverse=True)
                    out_bucket.append(int(bucket[part[0]]))
                    out_blob.append(_blob(short[part], inverse.astype("<u4"), key[who]))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], ["bucket", "blob"])

    return docs.mapInArrow(run, "bucket int, blob binary")


FOUND = pa.schema([("doc_id", pa.int64()), ("sub", pa.int64()), ("n", pa.int64()), ("id", pa.binary()), ("key", pa.int64()), ("point", pa.binary()), ("holders", pa.int64()), ("block", pa.int64())])
INDEXED = "doc_id long, sub long, n long, id binary, key long, point binary, holders long, block long"


def _raw(values: np.ndarray, width: int) -> list[bytes]:
    raw = values.tobytes()
    return [raw[at : at + width] for at in range(0, len(raw), width)]


def holders(buckets: int):
    """Tokens that at least two classes hold, as (holders, key, block): a number of the token's set of classes, and each of them.

    A set of more than `SPLIT` classes is in several blocks, numbered above 0; so is that of a token dealt in pieces. A bucket below 0 gives its documents
    (doc_id, sub, n, id), with key and point at one document of each class and chunk. Near copies share many tokens, and these have few different
    sets of holders; points needn't come along for each token.
    """

    def documents(blobs: list[bytes]) -> pa.Table:
        parts = []
        for blob in blobs:
            doc, sub, n, name, places, lengths, flat = _unblob(blob, ["<i8", "<i8", "<i8", "u1", "<i4", "<i4", "u1"])
            flat, ends = flat.tobytes(), np.cumsum(lengths).tolist()
            names = _raw(name, 16)
            k = len(doc)
            key, point = np.zeros(k, dtype="<i8"), [None] * k
            for at, end, length in zip(places.tolist(), ends, lengths.tolist(), strict=True):
                key[at], point[at] = int.from_bytes(names[at][:8], "big", signed=True), flat[end - length : end]
            ids = pa.array([x if n[i] else None for i, x in enumerate(names)], pa.binary())
            parts.append(pa.table([pa.array(doc), pa.array(sub), pa.array(n), ids, pa.array(key, mask=np.array([x is None for x in point])), pa.array(point, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=FOUND))
        return pa.concat_tables(parts)

    def table(group: list[np.ndarray], member: list[np.ndarray], block: list[np.ndarray]) -> pa.Table:
        g, m, b = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (group, member, block))
        k = len(g)
        return pa.table([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(m), pa.nulls(k, pa.binary()), pa.array(g), pa.array(b)], schema=FOUND)

    def pieces(blobs: list[bytes]) -> pa.Table:
        token, piece, key = (np.concatenate(x) for x in zip(*(_unblob(b, ["<u8", "<u8", "<i8"]) for b in blobs), strict=True))
        groups, members, blocks = [], [], []
        for t, p in set(zip(token.tolist(), piece.tolist(), strict=True)):
            of = np.unique(key[(token == t) & (piece == p)])
            groups.append(np.full(len(of), W.mix(np.array([t], dtype=np.uint64))[0]).astype(np.int64))
            members.append(of)
            blocks.append(1 + p + (np.arange(len(of)) // SPLIT << 32))
        return table(groups, members, blocks)

    def run(t: pa.Table) -> pa.Table:
        blobs, bucket = t.column("blob").to_pylist(), t.column("bucket")[0].as_py()
        if bucket < 0:
            return documents(blobs)
        if bucket >= buckets:
            return pieces(blobs)
        tokens, owners, keys, base = [], [], [], 0
        for blob in blobs:
            tok, own, key = _unblob(blob, ["<u4", "<u4", "<i8"])
            tokens.append(tok)
            owners.append(own.astype(np.int64) + base)
            keys.append(key)
            base += len(key)
        names, same = np.unique(np.concatenate(keys), return_inverse=True)
        token, owner = _unique(np.concatenate(tokens), same.ravel()[np.concatenate(owners)])
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(token)]]))
        groups, members, blocks = [], [], []
        seen = set()
        for k in np.flatnonzero(lengths > 1):
            of = names[owner[starts[k] : starts[k] + lengths[k]]]
            number = xxhash.xxh3_64_intdigest(of.tobytes())
            if number not in seen:
                seen.add(number)
                groups.append(np.full(len(of), np.uint64(number)).astype(np.int64))
                members.append(of)
                blocks.append(np.zeros(len(of), dtype=np.int64) if len(of) <= SPLIT else 1 + np.arange(len(of)) // SPLIT)
        return table(groups, members, blocks)

    return run


def holder_edges(percent: int):
    """Spanning edges (u, v) of the pairs of holders whose bound holds, by the first 64 bits of their classes' names, set by set and block by block."""

    def run(t: pa.Table) -> pa.Table:
        names, first, who = np.unique(t.column("key").to_numpy(), return_index=True, return_inverse=True)
        size = t.column("n").to_numpy()[first].astype(np.int64)
        points_ = Points(t.column("point").take(pa.array(first)).to_pylist(), size)
        # two blocks with one number would only be searched together
        of = W.mix(t.column("holders").to_numpy().astype(np.uint64) + W.mix(t.column("block").to_numpy().astype(np.uint64)))
        group, owner = _unique(of, who.ravel())
        forest = Forest(len(first))
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(group)]]))
        many = np.flatnonzero(lengths > LEAF)
        for k in many[np.argsort(-lengths[many], kind="stable")]:  # what large sets connect needn't be looked at in the others
            own = owner[starts[k] : starts[k] + lengths[k]]
            for i, j in connect(points_.coarse[own], size[own], forest.roots(own), percent, lambda q, others, own=own: points_(int(own[q]), own[others])):
                forest.join(int(own[i]), int(own[j]))
        for length in np.unique(lengths[(lengths > 1) & (lengths <= LEAF)]):
            sets_ = starts[lengths == length]
            i, j = np.triu_indices(length, 1)
            step = max(1, 200_000 // len(i))
            for at in range(0, len(sets_), step):
                rows = owner[sets_[at : at + step, None] + np.arange(length)]
                pairs = np.unique(rows[:, i].ravel().astype(np.int64) << 32 | rows[:, j].ravel())
                x, y = pairs >> 32, pairs & 0xFFFFFFFF
                open_ = forest.roots(x) != forest.roots(y)
                x, y = x[open_], y[open_]
                over = np.minimum(points_.coarse[x], points_.coarse[y]).sum(axis=1, dtype=np.int64)
                yes = np.flatnonzero(reach(over, size[x], size[y], percent))
                for u, v in zip(x[yes].tolist(), y[yes], strict=True):
                    if forest.find(u) != forest.find(int(v)) and reach(points_(u, v[None]), size[u], size[v], percent)[0]:
                        forest.join(u, int(v))
        root = forest.roots(np.arange(len(names)))
        u = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"u": pa.array(names[u], pa.int64()), "v": pa.array(names[root[u]], pa.int64())})

    return run


def across_edges(percent: int):
    """The same between a block of queries and another block, whose components are given by `root`."""

    def run(t: pa.Table) -> pa.Table:
        names = t.column("key").to_numpy()
        size = t.column("n").to_numpy().astype(np.int64)
        points_ = Points(t.column("point").to_pylist(), size)
        found = connect(points_.coarse, size, t.column("root").to_numpy(), percent, points_, np.flatnonzero(t.column("query").to_numpy()))
        return pa.table({"u": pa.array([names[i] for i, _ in found], pa.int64()), "v": pa.array([names[j] for _, j in found], pa.int64())})

    return run


def _unique(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    keep = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
    return token[keep], owner[keep]


def _verified(ids: list[bytes], tokens: list[bytes], label: np.ndarray | None, queries: np.ndarray | None, percent: int) -> list[tuple[bytes, bytes]]:
    own = [np.frombuffer(s, dtype="<u8") for s in tokens]
    size = np.array([len(s) for s in own], dtype=np.int64)
    found = connect(points(own, fine_groups(int(size.max()))), size, np.arange(len(own)) if label is None else label, percent, Overlaps(own), queries)
    return [(ids[i], ids[j]) for i, j in found]


def _edge_table(found: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"u": pa.array([i for i, _ in found], pa.binary()), "v": pa.array([j for _, j in found], pa.binary())})


def block_edges(percent: int):
    """Verified spanning edges (u, v) within candidate components or blocks of them."""

    def run(t: pa.Table) -> pa.Table:
        roots, blocks, ids, tokens = (t.column(c).to_pylist() for c in ("root", "block", "id", "tokens"))
        groups: dict[tuple[int, int], dict[bytes, bytes]] = {}
        for r, b, i, s in zip(roots, blocks, ids, tokens, strict=True):
            groups.setdefault((r, b), {})[i] = s  # a class comes once, or again with equal tokens
        return _edge_table([e for g in groups.values() if len(g) > 1 for e in _verified(list(g), list(g.values()), None, None, percent)])

    return run


def participants(percent: int):
    """Of a block of queries and another block, those that have a partner in another component by the bound of their fine points."""

    def run(t: pa.Table) -> pa.Table:
        size = t.column("n").to_numpy().astype(np.int64)
        label = np.unique(t.column("root").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        points_ = Points(t.column("point").to_pylist(), size, FINE)
        members = np.flatnonzero(~t.column("query").to_numpy())
        keep = np.zeros(len(size), dtype=bool)
        for q in np.flatnonzero(t.column("query").to_numpy()).tolist():
            others = members[label[members] != label[q]]
            for bound in (lambda k: np.minimum(points_.coarse[k], points_.coarse[q]).sum(axis=1, dtype=np.int64), lambda k: points_(q, k)):  # noqa: B023
                others = others[reach(bound(others), int(size[q]), size[others], percent)]
            keep[others] = True
            keep[q] = len(others) > 0
        return t.filter(pa.array(keep)).select(["set", "a", "b", "key", "root", "query"])

    return run


def block_across(percent: int):
    """Verified edges between the participants of two blocks, whose components are given by `root`."""

    def run(t: pa.Table) -> pa.Table:
        label = np.unique(t.column("root").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        return _edge_table(_verified(t.column("key").to_pylist(), t.column("tokens").to_pylist(), label, np.flatnonzero(t.column("query").to_numpy()), percent))

    return run


def across(rows: DataFrame, labels: DataFrame, payload: DataFrame) -> DataFrame | None:
    """What is left to compare between the blocks of sets: (set, a, b, key, root, query, payload), a group being one block of queries and one of all members.

    rows are (set, key, block), labels (node, root) what is connected so far, payload (key, ...) what a search needs. In a set, the members
    of its largest component are compared with the others, and these among each other; a set that is one component by now has nothing left,
    which is what near copies come to. None if no set has anything left.
    """
    own = rows.join(labels, rows["key"] == labels["node"], "left").select("set", "key", "block", F.coalesce("root", "key").alias("root"))
    counts = own.groupBy("set", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("set").agg(F.max_by("root", "n").alias("top"), F.count(F.lit(1)).alias("m"), (F.sum("n") - F.max("n")).alias("rest")).filter("m > 1")
    tops = shared.table(tops.select("set", "top", F.ceil(F.col("rest") / SPLIT).cast("int").alias("parts")), "open")
    n = tops.limit(BROADCAST_DOCS + 1).count()
    if not n:
        return None
    own = own.join(F.broadcast(tops) if n <= BROADCAST_DOCS else tops, "set")
    others = own.select("set", "block").distinct().withColumnRenamed("block", "b")
    queries = own.filter("root != top").withColumn("a", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).join(others, "set").select("set", "a", "b", "key", "root", F.lit(True).alias("query"))
    # a query stands among the members of its own block too, with its equal root it meets itself no more
    members = own.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("set", "a", F.col("block").alias("b"), "key", "root", F.lit(False).alias("query"))
    return queries.unionByName(members).join(payload, "key")


def classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    A null or empty text has no shingles and is linked with nothing. Rows that repeat get a row each; rows that share a
    doc_id but not the text are linked by their texts alone. A null doc_id comes after all others and stays null, and a component
    of such rows alone has a null component_id. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    # rows without an id are told apart by their texts
    sub = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("sub")
    docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(MAX_LONG)).alias("doc_id"), sub, "text")
    size = shared.scan_bytes(docs)
    bits = min(22, max(16, math.ceil(math.log2(max(size, 1) / 512))))
    buckets = max(64, min(1 << 20, size >> 21))
    hot = spark.sparkContext.broadcast(hot_tokens(docs, width, percent, bits))
    indexed = shared.table(index(docs, width, percent, hot, buckets).groupBy("bucket").applyInArrow(holders(buckets), INDEXED), "index")
    hot.unpersist()
    rows = indexed.filter("holders is null").select("doc_id", "sub", "n", "id")
    held = indexed.filter("holders is not null").select(F.col("holders").alias("set"), "key", "block").distinct()
    # classes that share the first 64 bits of their names keep a point each; either stands for both, as both come along below
    point = indexed.filter("point is not null").select("key", "n", "point").dropDuplicates(["key"])
    candidates = _candidates(held, point, percent, buckets)
    least = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("doc_id", "sub")).alias("m"), F.count(F.lit(1)).alias("copies"))
    least = shared.table(least.select("id", F.col("m.doc_id").alias("least"), "m.sub", "copies"), "classes")
    blocks = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    # the first 8 bytes of the name, big-endian; two classes that share them both come along
    key = F.conv(F.hex(F.substring("id", 1, 8)), 16, -10).cast("long")
    wanted = candidates.join(blocks, "root").join(least.withColumn("key", key), F.col("node") == F.col("key")).select(F.col("least").alias("doc_id"), "sub", F.col("id").alias("want"), "root", F.when(F.col("blocks") > 1, 1 + F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(0).alias("block"))
    wanted = shared.table(wanted, "candidates")
    large = wanted.filter("block > 0").limit(1).count() > 0
    whole = _wholes(docs, wanted, width, large)
    part = F.pmod(F.xxhash64("root", "block"), F.lit(buckets)).cast("int")
    if large:
        # their sets are read three times
        whole = shared.table(whole, "wholes")
    edges = whole.withColumn("part", part).groupBy("part").applyInArrow(block_edges(percent), "u binary, v binary")
    if large:
        edges = shared.table(edges, "verified")
        split = whole.filter("block > 0").select(F.col("root").alias("set"), F.col("id").alias("key"), "block")
        # fine points go to all pairs of blocks, whole sets only where a point says that they may be needed
        left = across(split, C.components(edges), whole.filter("block > 0").select(F.col("id").alias("key"), "n", "point"))
        if left is not None:
            some = left.groupBy("set", "a", "b").applyInArrow(participants(percent), "set long, a int, b long, key binary, root binary, query boolean")
            sets_ = some.join(whole.select(F.col("id").alias("key"), "tokens"), "key")
            edges = edges.unionByName(sets_.groupBy("set", "a", "b").applyInArrow(block_across(percent), "u binary, v binary"))
    linked = C.components(edges)
    reached = linked.join(least, linked["node"] == least["id"])
    tops = reached.groupBy("root").agg(F.min("least").alias("component"))
    named = reached.join(tops, "root").select("id", "component")
    full = shared.table(least.join(named, "id", "left").select("id", "copies", F.coalesce("component", "least").alias("component")), "components")
    out = _named(rows, full).unionByName(rows.filter("id is null").select("doc_id", "n", F.col("doc_id").alias("component")))
    real = lambda c: F.when(F.col(c) != MAX_LONG, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def _candidates(held: DataFrame, point: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(node, root) of classes connected by pairs that share a token of their prefixes and whose bound holds."""
    dealt = held.join(point, "key").withColumnRenamed("set", "holders").withColumn("part", F.pmod(F.xxhash64("holders", "block"), F.lit(buckets)).cast("int"))
    edges = dealt.groupBy("part").applyInArrow(holder_edges(percent), "u long, v long")
    split = held.filter("block > 0")
    if not split.limit(1).count():
        return C.components(edges)
    edges = shared.table(edges, "near")
    left = across(split, C.components(edges), point)
    if left is None:
        return C.components(edges)
    return C.components(edges.unionByName(left.groupBy("set", "a", "b").applyInArrow(across_edges(percent), "u long, v long")))


def _wholes(docs: DataFrame, wanted: DataFrame, width: int, pointed: bool) -> DataFrame:
    """(id, root, block, tokens), and n and point if asked for: the whole sets of the classes that are wanted, each from its first document."""
    small = wanted.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = docs.join(F.broadcast(wanted) if small else wanted, ["doc_id", "sub"]).select("want", "root", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in sets(batches, width):
            want = batch.column(0).to_pylist()
            keep = [k for k, s in enumerate(chunk) if len(s) and digest(s) == want[k]]
            took = batch.take(pa.array(keep, pa.int64()))
            columns = [took.column(0), took.column(1), took.column(2), pa.array([chunk[k].astype("<u8").tobytes() for k in keep], pa.binary())]
            if pointed:
                columns += [pa.array([len(chunk[k]) for k in keep], pa.int64()), pa.array([point_bytes(chunk[k], FINE) for k in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "root", "block", "tokens", "n", "point"][: len(columns)])

    found = texts.mapInArrow(run, "id binary, root long, block long, tokens binary" + ", n long, point binary" * pointed)
    # rows that repeat with one doc_id and text give one class several times
    return found.dropDuplicates(["id"]) if pointed else found


def _named(rows: DataFrame, full: DataFrame) -> DataFrame:
    """(doc_id, n, component) of rows with words. Classes of very many copies are at most MANY and are broadcast; the others meet by shuffle."""
    total = full.agg(F.sum("copies")).collect()[0][0] or 0
    many = max(FEW_COPIES, total // MANY)
    crowded = full.filter(F.col("copies") > many).select("id", F.col("component").alias("near"))
    tagged = rows.filter("id is not null").join(F.broadcast(crowded), "id", "left")
    rest = tagged.filter("near is null").select("doc_id", "n", "id").join(full.filter(F.col("copies") <= many), "id").select("doc_id", "n", "component")
    return tagged.filter("near is not null").select("doc_id", "n", F.col("near").alias("component")).unionByName(rest)
