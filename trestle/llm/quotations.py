"""Quotation linking: conversations as they were answered, without the quotes.

A message's lines carry quote levels (`>` marks, with or without spaces between them). Each maximal run of lines at one level or
deeper is a quoted passage; an attribution line just before it goes with it. Passages and messages are
normalised (marks, case and white space removed) and hashed paragraph by paragraph, so a passage that was wrapped anew or cut
at a paragraph still has hashes in common with its original. Hashes of quoted paragraphs are joined to those of what earlier messages of the same
conversation wrote themselves. At the lowest level with a common hash, whole passages go before paragraphs and these before lines, then
longer pieces before shorter ones, so greetings and the like decide only where nothing longer is found; the latest earlier message among equals is the parent.
Messages that quote nothing found answer the one before them. Conversations are then put in the order of their reply trees.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import replies, shared

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"(?:^On\b.*\bwrote:|^.{1,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s?:|^-{2,}\s*(?:Original|Forwarded) Message\s*-{2,})\s*$", re.I)
SPACE = re.compile(r"\s+")
#: Turns of a conversation that are searched together.
STRETCH = 4_096
#: Messages in a part of an assembled conversation.
PART = 100


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, rest of the line) of each line."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        m = MARK.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normalised(text: str) -> str:
    return SPACE.sub(" ", text).strip().lower()


def paragraphs(lines: list[str]) -> list[tuple[int, int, int]]:
    """(hash, kind, length) of the whole passage (kind 0) and of each of its paragraphs (1) and lines (2); of equal pieces the first kind."""
    pieces = [(0, "\n".join(lines)), *((1, p) for p in "\n".join(x if x.strip() else "" for x in lines).split("\n\n")), *((2, x) for x in lines)]
    kept: dict[str, int] = {}
    for kind, p in pieces:
        n = normalised(p)
        if n:
            kept.setdefault(n, kind)
    return sorted((xxhash.xxh3_64_intdigest(n) - (1 << 63), kind, len(n)) for n, kind in kept.items())


def split(text: str) -> tuple[str, list[int], list[tuple[int, int, int, int]]]:
    """(own text, hashes of it, (level, hash, kind, length) of quoted passages)."""
    lines = levels(text)
    own: list[str] = []
    quoted: dict[int, list[list[str]]] = {}
    before = 0
    for k, (level, rest) in enumerate(lines):
        if level == 0:
            if not (ATTRIBUTION.match(rest.strip()) and any(x for x, _ in lines[k + 1 : k + 3])):
                own.append(rest)
        else:
            if level != before or level not in quoted:
                quoted.setdefault(level, []).append([])
            quoted[level][-1].append(rest)
        before = level
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n") if quoted else text
    return body, [h for h, _, _ in paragraphs(own)], [(level, *h) for level, found in sorted(quoted.items()) for lines_ in found for h in paragraphs(lines_)]


def parts(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with own, own_hashes and quotes (array of level, hash, kind, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("kind", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            found = [split(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([[{"level": a, "hash": h, "kind": k, "length": n} for a, h, k, n in f[2]] for f in found], kind)], [*batch.schema.names, "own", "own_hashes", "quotes"])

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text string, own string, own_hashes array<long>, quotes array<struct<level:int,hash:long,kind:int,length:int>>")


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent_turn, link, position, depth, depth_quoted, text) for each message; text is without quotes.

    link is `quote`, `previous` or `root`. A message's parent is always an earlier turn of its conversation, so replies
    make trees; rows that share conv_id and turn get a row each and are one message for links. Null texts are empty; a null turn
    or conversation has no parent. position is the rank in the conversation's reply tree from 0, a parent before its children and
    siblings by turn, depth the number of messages above; both are null where turn or conversation is. An empty table gives no rows, and other columns are not read.

    The join is by (conversation, hash); each quoting message takes the latest writer before it by a running maximum over stretches
    of turns, so neither a hash that very many messages share nor a conversation of very many turns makes pairs or a task of its own.
    """
    # parsed once: the table is read for the links and for the texts, of which only what the message itself says is needed
    base = shared.table(parts(messages).drop("text"), "messages")
    # written and quoted hashes in one pass: those that nobody quotes end in the window
    written = F.transform("own_hashes", lambda h: F.struct(F.lit(0).alias("level"), h.alias("hash"), F.lit(0).alias("kind"), F.lit(0).alias("length")))
    both = base.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.concat(written, "quotes")).alias("q")).select("conv_id", "turn", "q.hash", "q.level", "q.kind", "q.length").distinct()
    found = shared.greatest_before(both, ["conv_id", "hash"], "turn", F.when(F.col("level") == 0, F.col("turn")), "writer", STRETCH).filter("level > 0 and writer is not null")
    parents = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "kind", (-F.col("length")).alias("short"), (-F.col("writer")).alias("back"))).alias("best"))
    turns = base.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    previous = shared.greatest_before(turns, ["conv_id"], "turn", F.col("turn"), "before", STRETCH)
    parent = F.coalesce(-F.col("best.back"), F.col("before"))
    kind = F.when(F.col("best").isNotNull(), "quote").when(F.col("before").isNotNull(), "previous").otherwise("root")
    links = shared.table(previous.join(parents, ["conv_id", "turn"], "left").select("conv_id", "turn", parent.alias("parent_turn"), kind.alias("link")), "links")
    placed = links.join(replies.places(links.select("conv_id", "turn", "parent_turn")), ["conv_id", "turn"])
    out = base.join(placed, ["conv_id", "turn"], "left")
    depth_quoted = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long")
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("link", F.lit("root")).alias("link"), "position", "depth", depth_quoted.alias("depth_quoted"), F.col("own").alias("text"))


def conversations(linked: DataFrame) -> DataFrame:
    """(conv_id, part, n_messages, text): conversations in reply order without quotes, in parts of `PART` messages.

    Each message is `role: text`, with an empty line between two. Rows that repeat are one message; rows that share a
    turn and differ follow one another. Messages without turn or conversation have no place and stand in no conversation.
    """
    rows = linked.filter("position is not null").select("conv_id", F.floor(F.col("position") / PART).cast("long").alias("part"), F.struct("position", "role", "text").alias("m"))
    found = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_set("m")).alias("m"))
    said = F.transform("m", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), m["text"]))
    return found.select("conv_id", "part", F.size("m").cast("long").alias("n_messages"), F.array_join(said, "\n\n").alias("text"))
