"""WARC archives, and an index of captures by external merge.

Pages become WARC records in uncompressed archives, written by Spark's own writer (so only files of committed tasks
exist) and read back as whole files. Records are written by classes of size, each with its own number of records to a file, so that no file holds more
than about `FILE_BYTES` of payload but for a single larger page. Of records with equal payloads, the one with the smallest page_id is the
response and the others are revisits that carry no payload.

The index: each task sorts the captures it has read into runs by (URL key, timestamp, page_id); a run is cut at global
boundaries into compressed blocks, and a range of the index merges its pieces of all runs with a loser tree, which has one block of each run unpacked.
Boundaries are quantiles of a bounded number of hashed keys, and page_id is part of the order, so a URL or host with very many captures is cut like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import shared

CRLF = "\r\n"
#: Payload bytes of one archive file, unless a single page has more.
FILE_BYTES = 128 << 20
#: Records to a file, by classes of size: a class has pages of up to FILE_BYTES divided by its number, and the last one all others.
RECORDS = (2048, 128, 8, 1)
#: Captures that are sorted at once, and those of a compressed block.
RUN, BLOCK = 50_000, 2_000
#: Keys that may come to the driver for boundaries, and how many there are for each range.
KEYS, EACH = 1_000_000, 20
#: Up to so many repeated digests (about 60 bytes each) are broadcast.
BROADCAST_FIRSTS = 500_000


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, by five hexadecimal digits times eight."""
    h = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_types(pages: DataFrame, least_bytes: int = 0, seen: Observation | None = None) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest and refers_to (the response's page_id for a revisit, else null)."""
    base = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    base = base.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("payload")))
    # only digests that occur twice take part in the join, without their pages
    counted = base if seen is None else base.observe(seen, F.max("payload_bytes").alias("largest"))
    firsts = counted.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # a bounded table of digests is broadcast, so that payloads stay where they are; a larger one is joined by shuffle
    firsts = shared.table(firsts, "firsts")
    small = firsts.limit(BROADCAST_FIRSTS + 1).count() <= BROADCAST_FIRSTS
    joined = base.join(F.broadcast(firsts) if small else firsts, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return joined.withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def record(page: str = "page_id") -> Column:
    """A WARC/1.1 record but for the empty lines that end it, which the writer puts between rows."""
    revisit = F.col("refers_to").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    date = F.date_format(F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(F.pmod("page_id", F.lit(1 << 30)), F.lit(0)).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(page)),
        line("WARC-Target-URI", clean),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Original-Length", F.col("payload_bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("html"), F.lit(""))))


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives in folders of `path`, one for each class of sizes that there is."""
    if pages.isEmpty():
        return
    seen = Observation()
    rows = with_types(pages.select("page_id", "url", "html"), least_bytes, seen)
    largest = seen.get["largest"] or 0
    low = -1
    for records in RECORDS:
        high = file_bytes // records if records > 1 else None
        own = F.col("payload_bytes") > low if high is None else (F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high)
        if largest > low:
            rows.filter(own).select(record().alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records).text(f"{path}/{records}")
        low = high


def parse(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """(headers, start of the record, start of its payload) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, at, end + 4
        at = end + 4 + int(headers["Content-Length"]) + 4


def surt(url: str) -> str:
    """A sortable key: host reversed, then port, path and query in lower case, without scheme, www, user or fragment."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (u.path or "/").lower()
    return key + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


class LoserTree:
    """Merge of k sorted runs: the winner's path is replayed against the losers kept in the nodes."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (item := self.heads[self.tree[0]]) is not None:
            yield item
            self.heads[self.tree[0]] = next(self.runs[self.tree[0]], None)
            self._replay(self.tree[0])


INDEX = "url_key string, timestamp string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, record_offset long, record_length long"
FIELDS = [x.split() for x in INDEX.split(", ")]


def _number(uri: str) -> int | None:
    x = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "none" else int(x)


def captures(files: DataFrame) -> DataFrame:
    """A row for each record of archives (path, content), with payloads checked against their digests."""
    import base64
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for h, start, body in parse(data):
                    n = int(h["Content-Length"])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(data[body : body + n]).digest()).decode() != digest:
                        raise ValueError(f"{path} at {start}: the payload doesn't have its digest")
                    url = h["WARC-Target-URI"]
                    stamp = h["WARC-Date"].translate({ord(c): None for c in "-:TZ"})
                    rows.append((surt(url), stamp, _number(h["WARC-Record-ID"]), url, h["WARC-Type"], digest, int(h.get("WARC-Original-Length", n)), _number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, path, start, body + n + 4 - start))
                yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, INDEX)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(FIELDS)], [n for n, _ in FIELDS])


def _key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def merge(found: DataFrame, rows_per_range: int = 50_000, keys: int = KEYS) -> DataFrame:
    """Captures in global order, with `range` (of the index, ascending), `rank` (from 0 in its range) and `position` (from 0 in the index)."""
    total = found.count()
    ranges = max(1, min(-(-total // rows_per_range), keys // EACH))
    cuts: list[tuple] = []
    if ranges > 1:
        want = min(keys, ranges * max(EACH, 200))
        rate = F.pmod(F.xxhash64("url_key", "page_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, want / total)) + 1
        # boundaries only share out the work: a bounded number of keys finds them
        sample = sorted((r[0], r[1], r[2] is None, r[2] or 0) for r in found.filter(rate).select("url_key", "timestamp", "page_id").limit(2 * want).collect())
        cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        held: list[tuple] = []
        press = zstandard.ZstdCompressor(level=1)
        run = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal run
            held.sort(key=_key)
            groups: dict[int, list[tuple]] = {}
            for row in held:
                groups.setdefault(bisect_right(cuts, _key(row)[:4]), []).append(row)
            held.clear()
            blocks = [(number, run, k, g[k : k + BLOCK]) for number, g in groups.items() for k in range(0, len(g), BLOCK)]
            run += 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            columns = zip(*((number, r, k, len(g), press.compress(pickle.dumps(g))) for number, r, k, g in blocks), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["range", "run", "block", "n", "rows"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if len(held) >= RUN:
                yield from flush()
        if held:
            yield from flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("range", "run", "block", "rows", "before")}
            number, before = columns["range"][0], columns["before"][0]
            for r, k, rows in zip(columns["run"], columns["block"], columns["rows"], strict=True):
                runs.setdefault(r, []).append((k, rows))

        def unpacked(blocks: list[tuple[int, bytes]]) -> Iterator[tuple]:
            for _, rows in sorted(blocks):
                for row in pickle.loads(zstandard.ZstdDecompressor().decompress(rows)):
                    yield _key(row), row

        rank, out = 0, []

        def batch_of(rows: list[tuple], rank: int) -> pa.RecordBatch:
            made = _batch(rows)
            ranks = range(rank, rank + len(rows))
            more = [pa.array([number] * len(rows), pa.int32()), pa.array(ranks, pa.int64()), pa.array([before + k for k in ranks], pa.int64())]
            return pa.RecordBatch.from_arrays([*made.columns, *more], [*made.schema.names, "range", "rank", "position"])

        for _, row in LoserTree(unpacked(runs[r]) for r in sorted(runs)):
            out.append(row)
            if len(out) == BLOCK:
                yield batch_of(out, rank)
                rank += len(out)
                out = []
        if out:
            yield batch_of(out, rank)

    runs = shared.table(found.mapInArrow(sort, "range int, run long, block int, n long, rows binary"), "runs")
    # a row for each of at most keys / EACH ranges
    counts = runs.groupBy("range").agg(F.sum("n").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return runs.join(F.broadcast(before), "range").groupBy("range").applyInArrow(join, INDEX + ", range int, rank long, position long")


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives, read them back, and return the merged index.

    pages needs page_id, url and html; other columns are not read. A null html is an empty payload and a null url an empty
    one. A null page_id is never the response that others refer to unless nothing else is there. Rows that repeat with the least page_id of
    their payload are all responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or shared.new_path(spark, "warc")
    write(pages, path, least_bytes, file_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
    if pages.isEmpty():
        return spark.createDataFrame([], INDEX + ", range int, rank long, position long")
    return merge(shared.table(captures(files.load(path)), "captures"))
