"""Places of messages in the reply trees of their conversations.

A message's position is its rank in preorder: a parent before its children, and siblings by turn. Conversations of up to `SMALL`
turns are numbered one by one, as arrays. A larger one is never in one task: its tree becomes a list of two
elements for each turn, entering and leaving it, and each round of `_ranked` doubles the stretch of the list that an element has summed up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Turns of a conversation that are numbered in one task.
SMALL = 2_000
PLACED = "conv_id long, turn long, position long, depth long"


def preorder(turns: list[int], parents: list[int | None]) -> tuple[list[int], list[int]]:
    """(position, depth) of each turn; turns ascend and parents are earlier turns or None."""
    at = {t: i for i, t in enumerate(turns)}
    children: list[list[int]] = [[] for _ in turns]
    stack = []
    for i, p in enumerate(parents):
        (stack if p is None else children[at[p]]).append(i)
    stack.reverse()
    position, depth, n = [0] * len(turns), [0] * len(turns), 0
    while stack:
        i = stack.pop()
        position[i], n = n, n + 1
        for c in reversed(children[i]):
            depth[c] = depth[i] + 1
            stack.append(c)
    return position, depth


def _few(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, position, depth = [], [], [], []
            for c, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                turns = [x["turn"] for x in found]
                p, d = preorder(turns, [x["parent_turn"] for x in found])
                conv += [c] * len(turns)
                turn, position, depth = turn + turns, position + p, depth + d
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (conv, turn, position, depth)], ["conv_id", "turn", "position", "depth"])

    return nodes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "parent_turn"))).alias("found")).mapInArrow(run, PLACED)


def _ranked(nodes: DataFrame) -> DataFrame:
    """List ranking by pointer doubling; turns without a parent hang one after the other, at depth 0."""
    child = nodes.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    # the next answer to the same turn, by stretches, as a turn may have very many answers; those without a parent are dealt as answers to nothing
    back = nodes.select("conv_id", "turn", "parent_turn", (-F.col("turn")).alias("back"), F.struct(F.col("parent_turn").isNull().alias("top"), F.coalesce("parent_turn", F.lit(0)).alias("p")).alias("under"))
    after = shared.greatest_before(back, ["conv_id", "under"], "back", F.col("back"), "next", SMALL)
    sibling = after.select("conv_id", "turn", "parent_turn", (-F.col("next")).alias("sibling"))
    sibling = sibling.join(child.filter("turn is not null"), ["conv_id", "turn"], "left")
    # elements: 2 * turn enters, 2 * turn + 1 leaves
    element = lambda t, leave: F.struct(t.alias("turn"), F.lit(leave).alias("leave"))
    turn = F.col("turn")
    enter = F.struct(element(turn, False).alias("e"), F.when(F.col("child").isNotNull(), element(F.col("child"), False)).otherwise(element(turn, True)).alias("to"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("s"))
    after = F.when(F.col("sibling").isNotNull(), element(F.col("sibling"), False)).when(F.col("parent_turn").isNotNull(), element(F.col("parent_turn"), True))
    leave = F.struct(element(turn, True).alias("e"), after.alias("to"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s"))
    rows = shared.table(sibling.select("conv_id", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "x.*"), "tour")
    while rows.filter("to is not null").limit(1).count():
        far = rows.select("conv_id", F.col("e").alias("to"), F.col("to").alias("next"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        ahead = rows.filter("to is not null").join(far, ["conv_id", "to"]).select("conv_id", "e", F.col("next").alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("s") + F.col("s2")).alias("s"))
        rows = shared.table(ahead.unionByName(rows.filter("to is null")), "tour")
    entered = rows.filter("not e.leave").select("conv_id", F.col("e.turn").alias("turn"), "n", "s")
    total = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"))
    # n counts the turns entered from here on, s is minus the depth
    return entered.join(total, "conv_id").select("conv_id", "turn", (F.col("m") - F.col("n")).alias("position"), (-F.col("s")).alias("depth"))


def places(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, position, depth) of each row of nodes (conv_id, turn, parent_turn), which has each turn once and no null conv_id or turn."""
    large = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SMALL).select("conv_id")
    large = shared.table(large, "large")
    if not large.limit(1).count():
        return _few(nodes)
    return _few(nodes.join(large, "conv_id", "left_anti")).unionByName(_ranked(nodes.join(large, "conv_id", "left_semi")))
