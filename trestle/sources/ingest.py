"""Strict CSV ingest into Parquet, with the first error in file order and its line number.

A file is read once: its lines are parsed in Arrow batches and written to a staging folder, while the least place of an error and the number of rows are observed. Only a file
without an error is moved to its place; for an error, the lines before it are counted in a second read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from . import folders

#: Names of the two column types.
TYPES = {"i64": "long", "int64": "long", "int": "long", "utf8": "string", "text": "string", "string": "string"}
INTEGER = re.compile(r"[+-]?[0-9]+")


def parse_schema(spec: str) -> list[tuple[str, str]]:
    """[(name, long or string)] of a specification such as "id:i64,name:utf8"."""
    out: list[tuple[str, str]] = []
    for part in spec.split(","):
        name, colon, kind = (x.strip() for x in part.partition(":"))
        if not name or not colon or kind.lower() not in TYPES:
            raise E.SchemaError(f"{part!r} in {spec!r}")
        if name in (n for n, _ in out):
            raise E.SchemaError(f"{name!r} twice in {spec!r}")
        out.append((name, TYPES[kind.lower()]))
    return out


def split_line(line: str, number: int) -> list[str]:
    """Fields of a line. A quote opens only where a field begins; two of them inside are one; text behind the closing one is added."""
    fields, at = [], 0
    while True:
        value = ""
        if at < len(line) and line[at] == '"':
            at += 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    raise E.UnterminatedQuote(number)
                value += line[at:end]
                at = end + 1
                if at < len(line) and line[at] == '"':
                    value += '"'
                    at += 1
                else:
                    break
        end = line.find(",", at)
        if end < 0:
            return [*fields, value + line[at:]]
        fields.append(value + line[at:end])
        at = end + 1


def parse_line(line: str, number: int, schema: list[tuple[str, str]]) -> tuple:
    fields = split_line(line, number)
    if len(fields) != len(schema):
        raise E.ColumnCountMismatch(number, len(schema), len(fields))
    out = []
    for value, (name, kind) in zip(fields, schema, strict=True):
        if kind == "long":
            v = value.strip()
            # very long numbers aren't converted at all
            digits = v.lstrip("+-").lstrip("0") or "0"
            if not INTEGER.fullmatch(v) or len(digits) > 19 or not -(1 << 63) <= (whole := int(v[0].strip("+0123456789") + digits)) < 1 << 63:
                raise E.NumericParse(number, name, value)
            out.append(whole)
        else:
            out.append(value)
    return tuple(out)


def edges(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether the first file begins with a byte order mark, which Spark's reader drops, and the last one ends with a carriage return without a line feed, which stays."""
    fs, p = folders.file_system(spark, path)
    found = list(fs.globStatus(p) or [])
    if found and found[0].isDirectory():
        found = [x for x in fs.listStatus(found[0].getPath()) if not x.getPath().getName().startswith(("_", "."))]
    found = sorted((x for x in found if x.getLen()), key=lambda x: x.getPath().toString())
    if not found:
        return False, False

    def read(file, at: int, n: int) -> list[int]:
        stream = fs.open(file.getPath())
        try:
            stream.seek(at)
            return [stream.read() for _ in range(n)]
        finally:
            stream.close()

    return read(found[0], 0, min(3, found[0].getLen())) == [0xEF, 0xBB, 0xBF], read(found[-1], found[-1].getLen() - 1, 1) == [0x0D]


def ingest_csv(spark: SparkSession, path: str, schema: str | list[tuple[str, str]], out_dir: str, has_header: bool = True) -> int:
    """Write the rows of a CSV file as Parquet and return their number. Nothing is written unless every line is valid."""
    columns = parse_schema(schema) if isinstance(schema, str) else schema
    try:
        lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("at"))
        marked, ends = edges(spark, path)
    except AnalysisException as e:
        raise E.IoError(str(e)) from e
    mark = "\ufeff" if marked else ""
    last = lines.agg(F.max("at")).collect()[0][0] if ends else None
    folders.ship(spark)
    names = [n for n, _ in columns]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, faults = [], []
            for raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # the number of a line is its place in its partition here; what comes before is counted for the first error only
                number = at + 1
                try:
                    line = (mark if at == 0 else "") + (raw.decode() if at == last else raw.decode().removesuffix("\r"))
                    if has_header and at == 0:
                        if split_line(line, 1) != names:
                            raise E.HeaderMismatch(line)
                    elif line:
                        rows.append(parse_line(line, number, columns))
                except UnicodeDecodeError:
                    faults.append((-1, "InvalidUtf8", ["0", "<file>"]))
                except E.IngestError as e:
                    faults.append((at, type(e).__name__, _args(e)))
            worst = min(faults, default=None)
            arrays = [pa.array([r[i] for r in rows] + [None] * bool(worst), kinds[k]) for i, (_, k) in enumerate(columns)]
            fault = [None] * len(rows) + ([{"at": worst[0], "name": worst[1], "args": worst[2]}] if worst else [])
            kind = pa.struct([("at", pa.int64()), ("name", pa.string()), ("args", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(fault, kind)], [*(f"v{i}" for i in range(len(columns))), "fault"])

    struct = ", ".join([*(f"v{i} {'bigint' if k == 'long' else 'string'}" for i, (_, k) in enumerate(columns)), "fault struct<at:bigint,name:string,args:array<string>>"])
    seen = Observation()
    rows = lines.mapInArrow(parsed, struct).observe(seen, F.min("fault").alias("first"), F.count_if(F.col("fault").isNull()).alias("rows"))
    staged = folders.new_path(spark, "ingest")
    rows.filter("fault is null").select(*[F.col(f"v{i}").alias(n) for i, n in enumerate(names)]).write.parquet(staged)
    found = seen.get
    fs, source = folders.file_system(spark, staged)
    if found["first"] is not None:
        fs.delete(source, True)
        raise _error(found["first"]["name"], _numbered(found["first"], lines))
    target_fs, target = folders.file_system(spark, out_dir)
    if target_fs.getUri().equals(fs.getUri()):
        target_fs.delete(target, True)
        target_fs.mkdirs(target.getParent()) if target.getParent() else None
        if not fs.rename(source, target):
            raise E.IoError(f"{staged} can't be moved to {out_dir}")
    else:
        spark.read.parquet(staged).write.mode("overwrite").parquet(out_dir)
        fs.delete(source, True)
    return found["rows"]


def _numbered(fault, lines: DataFrame) -> list[str]:
    """The arguments of an error, with the number of its line among all lines."""
    args, at = list(fault["args"]), fault["at"]
    if fault["name"] in ("HeaderMismatch", "InvalidUtf8") or at < 0:
        return args
    part = at >> 33
    before = lines.filter(F.col("at") < F.lit(part << 33)).count() if part else 0
    return [str(before + (at & ((1 << 33) - 1)) + 1), *args[1:]]


def _args(e: E.IngestError) -> list[str]:
    return [str(v) for v in vars(e).values()] or [str(e)]


def _error(name: str, args: list[str]) -> E.IngestError:
    kind = getattr(E, name)
    return kind(*[int(a) if k in ("line", "expected", "found") else a for k, a in zip(kind.__init__.__code__.co_varnames[1:], args, strict=False)]) if kind is not E.HeaderMismatch else kind(*args)
