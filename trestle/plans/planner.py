"""From stages to one lazy DataFrame.

The planner keeps a frame whose columns have names of its own, the columns in scope (derived before left before right tables,
the latest first), and the logical order of rows as a list of columns. Sorting puts a column in front of that list; the rows
themselves are sorted once, at the end or under a limit, where Spark turns both into a top-k. Positions of rows are read only
if a stage depends on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors as E
from ..functions import arithmetic
from ..sources import folders
from ..sources.catalog import ID, Catalog, Table, widened
from . import parser as P

COUNT = "எண்ணிக்கை"
#: Spark's own limits are 32-bit numbers.
MAX_LIMIT = (1 << 31) - 1
_planning = RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Integer arithmetic of expressions built inside wraps around, whatever the session's ANSI setting is; one planner at a time changes it."""
    with _planning:
        before = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", before)


@dataclass
class Col:
    internal: str
    kind: T.DataType

    @property
    def is_long(self) -> bool:
        return isinstance(self.kind, T.LongType)


Scope = dict[str, Col]


@dataclass
class State:
    df: DataFrame
    table: str
    derived: Scope = field(default_factory=dict)
    left: Scope = field(default_factory=dict)
    rights: list[Scope] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    #: Whether the frame's rows need sorting by `order` to be in logical order.
    moved: bool = False
    grouped: bool = False
    sums: dict[str, Col] = field(default_factory=dict)
    output: list[tuple[str, Col]] | None = None
    last_derived: str | None = None


class Planner:
    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog, self.made = spark, catalog, 0

    def new(self) -> str:
        self.made += 1
        return f"c{self.made}"

    # --- names ----------------------------------------------------------------------------

    def scopes(self, s: State) -> list[Scope]:
        return [s.derived, s.left, *s.rights]

    def any(self, s: State, name: str) -> Col:
        for scope in self.scopes(s):
            if name in scope:
                return scope[name]
        raise E.ColumnNotFound(s.table, name)

    def long(self, s: State, name: str) -> Col:
        """A column of that name that is a whole number; others of the name are passed over."""
        for scope in self.scopes(s):
            if name in scope and scope[name].is_long:
                return scope[name]
        raise E.ColumnNotFound(s.table, name)

    # --- stages ---------------------------------------------------------------------------

    def source(self, table: Table, used: set[str], positions: bool) -> tuple[DataFrame, Scope, list[str]]:
        """The columns of a table that the pipeline names, and its position columns if they matter."""
        scope: Scope = {}
        picked: list[Column] = []
        for name, (column, kind) in widened(table.df).items():
            scope[name] = Col(self.new(), kind)
            if name in used:
                picked.append(column.alias(scope[name].internal))
        order = []
        if positions:
            for column in table.positions():
                order.append(self.new())
                picked.append(column.alias(order[-1]))
        return table.df.select(*picked), scope, order

    def plan(self, stages: list[P.Stage]) -> DataFrame:
        used = {ID} | {x for s in stages for x in _names(s)}
        positions = any(isinstance(s, (P.Take, P.Sort, P.Group)) for s in stages)
        s: State | None = None
        with wrapping(self.spark):
            for k, stage in enumerate(stages):
                s = self.step(s, stage, stages[k + 1 :], used, positions)
            return self.finish(s)

    def step(self, s: State | None, stage: P.Stage, rest: list[P.Stage], used: set[str], positions: bool) -> State:
        match stage:
            case P.From(name):
                df, scope, order = self.source(self.catalog[name], used, positions)
                return State(df, name, left=scope, order=order)
            case P.Filter(name, op, value):
                c, v = F.col(self.long(s, name).internal), F.lit(value).cast("long")
                s.df = s.df.filter(c > v if op == ">" else c < v if op == "<" else c == v)
            case P.Derive(name, left, op, right):
                a = self.operand(s, left)
                if op:
                    b = self.operand(s, right)
                    a = arithmetic(op, a, b)
                col = Col(self.new(), T.LongType())
                s.df = s.df.withColumn(col.internal, a)
                s.derived[name], s.last_derived = col, name
            case P.Sort(name):
                col = self.any(s, name)
                if not col.is_long:
                    raise E.ParseFailed(f"{name} is not a whole number")
                s.order, s.moved = [col.internal, *s.order], True
            case P.Take(n):
                ordered = s.df.orderBy(*s.order) if s.order else s.df
                s.df = ordered.limit(n) if n <= MAX_LIMIT else first_rows(ordered, n)
                s.moved = True
            case P.Project(names):
                s.output = [(n, self.any(s, n)) for n in names]
            case P.Join():
                self.join(s, stage, used, positions)
            case P.Group(name):
                self.group(s, name, rest)
            case P.Aggregate(name):
                self.aggregate(s, name)
        return s

    def operand(self, s: State, x: P.Operand) -> Column:
        return F.lit(x).cast("long") if isinstance(x, int) else F.col(self.long(s, x).internal)

    def join(self, s: State, stage: P.Join, used: set[str], positions: bool) -> None:
        table = self.catalog[stage.table]
        right, scope, order = self.source(table, used, positions)
        if stage.op is None:
            keys = []
            for own, of in ((s.left, s.table), (scope, table.name)):
                if ID not in own:
                    raise E.ColumnNotFound(of, ID)
                if not own[ID].is_long:
                    raise E.ParseFailed(f"{ID} of {of} is not a whole number")
                keys.append(own[ID])
            a, b = keys
        else:
            if stage.op != "=":
                raise E.ParseFailed(f"a join condition with {stage.op}")
            first, second = stage.left, stage.right
            known = lambda n: any(n in x for x in self.scopes(s))
            if not (known(first) and second in scope):
                first, second = second, first
            if second not in scope:
                raise E.ColumnNotFound(table.name, stage.right)
            a, b = self.any(s, first), scope[second]
            if not (a.is_long and b.is_long):
                raise E.ParseFailed("a join condition on columns that are not whole numbers")
        s.df = s.df.join(right, F.col(a.internal) == F.col(b.internal), "inner")
        s.rights.insert(0, scope)
        # the order matters to later stages, but an output in join order isn't worth a global sort
        s.order = [a.internal, *s.order, *order]

    def group(self, s: State, name: str, rest: list[P.Stage]) -> None:
        key = None
        for scope in (s.left, *s.rights, s.derived):
            if name in scope and scope[name].is_long:
                key = scope[name]
                break
        if key is None:
            raise E.ColumnNotFound(s.table, name)
        wanted: dict[str, Col] = {}
        for later in rest:
            if isinstance(later, P.From):
                break
            for n in _names(later):
                for scope in self.scopes(s):
                    if n in scope:
                        wanted[scope[n].internal] = scope[n]
        wanted = {i: c for i, c in wanted.items() if i != key.internal}
        first = F.struct(*s.order)
        aggs: list[Column] = []
        count = Col(self.new(), T.LongType())
        aggs.append(F.count(F.lit(1)).alias(count.internal))
        aggs += [F.min_by(F.col(i), first).alias(i) for i in wanted]
        s.sums = {}
        for later in rest:
            if isinstance(later, (P.From, P.Group)):
                break
            if isinstance(later, P.Aggregate) and later.column not in s.sums:
                for scope in self.scopes(s):
                    if later.column in scope and scope[later.column].is_long:
                        total = Col(self.new(), T.LongType())
                        s.sums[later.column] = total
                        aggs.append(F.sum(F.col(scope[later.column].internal)).alias(total.internal))
                        break
        s.df = s.df.groupBy(key.internal).agg(*aggs)
        keep = {key.internal, *wanted}
        s.left = {n: c for n, c in s.left.items() if c.internal in keep}
        s.rights = [{n: c for n, c in r.items() if c.internal in keep} for r in s.rights]
        s.derived = {n: c for n, c in s.derived.items() if c.internal in keep}
        s.derived[COUNT], s.last_derived = count, COUNT
        s.order, s.moved, s.grouped = [key.internal], True, True

    def aggregate(self, s: State, name: str) -> None:
        if s.grouped:
            s.derived[name] = s.sums.get(name) or self.long(s, name)
            s.last_derived = name
            return
        c = self.long(s, name)
        total = Col(self.new(), T.LongType())
        s.df = s.df.agg(F.coalesce(F.sum(c.internal), F.lit(0).cast("long")).alias(total.internal))
        s.left, s.rights, s.derived, s.last_derived = {}, [], {name: total}, name
        s.order, s.moved, s.output = [], False, None

    def finish(self, s: State) -> DataFrame:
        if s.output is None:
            if s.last_derived is None:
                return s.df.limit(0).select()
            s.output = [(s.last_derived, s.derived[s.last_derived])]
        df = s.df.orderBy(*s.order) if s.moved and s.order else s.df
        return df.select(*[F.col(c.internal).alias(n) for n, c in s.output])


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a sorted frame, for numbers beyond Spark's limits: it is written once, and whole files and a part of one file are read."""
    rows = folders.written(df, "sorted")
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    left, whole, cut = n, [], None
    for r in rows.groupBy(file.alias("f")).agg(F.count(F.lit(1)).alias("n")).orderBy("f").collect():  # a row for each sorted partition
        if r["n"] > left:
            cut = r["f"]
            break
        whole.append(r["f"])
        left -= r["n"]
    return rows if cut is None else rows.filter(file.isin(whole) | ((file == cut) & (row < left)))


def _names(stage: P.Stage) -> set[str]:
    """Columns that a stage names."""
    match stage:
        case P.Filter(name) | P.Sort(name) | P.Group(name) | P.Aggregate(name):
            return {name}
        case P.Derive():
            return {x for x in (stage.left, stage.right) if isinstance(x, str)}
        case P.Project(names):
            return set(names)
        case P.Join():
            return {x for x in (stage.left, stage.right) if x}
    return set()


def run(spark: SparkSession, catalog: Catalog, source: str | bytes) -> DataFrame:
    """The result of a pipeline as a lazy DataFrame; every error is raised here."""
    try:
        stages = P.parse(source)
    except E.NumberOverflow as e:
        raise E.LiteralOverflow(str(e)) from e
    except E.ParserError as e:
        raise E.ParseFailed(f"{type(e).__name__}: {e}") from e
    return Planner(spark, catalog).plan(stages)


@dataclass(frozen=True)
class PageStats:
    """What a query read of pages on disk."""

    pages_total: int = 0
    pages_skipped: int = 0
    pages_scanned: int = 0
    rows_scanned: int = 0
    rows_kept: int = 0


def run_checked(spark: SparkSession, catalog: Catalog, source: str | bytes) -> tuple[DataFrame, PageStats]:
    """The result of a pipeline with its statistics, which are zero: catalog tables have no pages."""
    return run(spark, catalog, source), PageStats()
