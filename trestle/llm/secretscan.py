"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything here is DataFrame expressions; there is no Python on the executors, and no shuffle.

A candidate is a run of at least `window` letters, digits and +/_=-. Its class is hex if it
has only hexadecimal digits, else base64; each class has its alphabet and its limit in bits per character. An
aggregate walks along the candidate, adds the character that enters the window to the counts of its class, takes
out the one that leaves, and adjusts the sum of c * log2(c) by those two counts alone. Windows that overlap a match of the
allow list don't count, whatever else is in the candidate. The span is from the first to the last window over the limit. Spans of the fixed
patterns stay whatever the entropy says. Matches are placed by running sums in blocks, so a text takes time in proportion to its matches.

Offsets are in code points, ends exclusive. A null text counts as empty and has no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which their kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABETS = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="}
LIMITS = {"hex": 3.0, "base64": 3.7}
WINDOW = 20
#: Strings that look random but are no secrets: UUIDs, placeholders, runs of one character, plain counting.
ALLOWED = (
    r"(?<![0-9a-fA-F-])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F-])",
    r"(?i)[a-z0-9+/]{0,33}example(?:key)?|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxx",
    r"(.)\1{7}",
    r"(?i)0123456789|abcdefghij",
)
#: Elements that a running sum or maximum copies at once.
RUN = 64


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _no_spans() -> Column:
    return F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,match:string>>)")


def _span(start: Column, end: Column, rank: int, match: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(KINDS[rank]).alias("kind"), match.alias("match"))


def running(values: Column, combine) -> Column:
    """What comes before each element, combined from 0 on: by blocks of RUN, and over the blocks, for an array that isn't empty."""

    def before(x: Column, value) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out"))
        return F.aggregate(x, empty, lambda acc, v: F.struct(combine(acc["at"], value(v)).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / RUN).cast("int")), lambda b: before(F.slice(values, b * RUN + 1, F.lit(RUN)), lambda v: v))
    return _let(blocks, lambda x: F.flatten(F.zip_with(x, before(x, lambda v: v["at"])["out"], lambda own, at: F.transform(own["out"], lambda v: combine(at, v).cast("int")))))


def matches(text: Column, pattern: str, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches: the text's pieces between them give their places."""
    p = F.lit(pattern)

    def placed(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m))

        def span(m: Column, i: Column, at: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(x["gaps"], i))
            return _span(start, start + F.length(m), rank, m)

        return _let(running(lengths, lambda a, b: a + b), lambda at: F.transform(x["found"], lambda m, i: span(m, i, at)))

    both = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(F.rlike(text, p), _let(both, placed)).otherwise(_no_spans())


def assigned(text: Column) -> Column:
    """Assignments whose value has 8 characters or more."""
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8
    return F.filter(matches(text, ASSIGN, 0), value)


def hot_window(candidate: Column, kind: str, window: int, listed: Column | None = None) -> Column:
    """struct(first, last): the start of the first and the end of the last window whose entropy is over the limit; null if none.

    Windows that overlap a span of `listed` don't count.
    """
    alphabet = ALPHABETS[kind]
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = window * (math.log2(window) - LIMITS[kind])
    folded = F.lower(candidate) if kind == "hex" else candidate
    codes = F.transform(F.split(folded, ""), lambda c: F.call_function("locate", c, F.lit(alphabet)) - 1)

    def walk(codes: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            n_in = F.get(acc["counts"], enters)
            n_out = F.get(acc["counts"], leaves) + F.when(enters == leaves, 1).otherwise(0)
            total = acc["sum"] + F.get(table, n_in + 1) - F.get(table, n_in) + F.when(i >= window, F.get(table, n_out - 1) - F.get(table, n_out)).otherwise(F.lit(0.0))
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0))
            free = F.lit(True) if listed is None else ~F.exists(listed, lambda x: (x["start"] <= i) & (x["end"] > i - window + 1))
            hot = lambda t: (i >= window - 1) & (t <= most + 1e-9) & free
            return _let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(acc["first"].isNotNull(), acc["first"]).when(hot(t), i - window + 1).alias("first"), F.when(hot(t), i + 1).otherwise(acc["last"]).alias("last")))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    return _let(codes, walk)


def entropic(text: Column, window: int, allowed: tuple[str, ...]) -> Column:
    def judged(s: Column) -> Column:
        listed = F.concat(_no_spans(), *[matches(s["match"], pattern, 3) for pattern in allowed])
        hot = lambda x: F.when(F.rlike(s["match"], F.lit(r"^[0-9A-Fa-f]+$")), hot_window(s["match"], "hex", window, x)).otherwise(hot_window(s["match"], "base64", window, x))
        cut = lambda h: F.when(h.isNotNull(), _span(s["start"] + h["first"], s["start"] + h["last"], 3, s["match"].substr(h["first"] + 1, h["last"] - h["first"])))
        return _let(_let(listed, hot), cut)

    return F.filter(F.transform(matches(text, CANDIDATE % window, 3), judged), lambda s: s.isNotNull())


def scan(docs: DataFrame, text: str = "text", window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with `secrets`, an array of (start, rank, end, kind, match) by start, then kind.

    Every row is scanned by itself, so rows that repeat, ties and any other columns make no difference. An empty
    table gives no rows. A column named `secrets` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(assigned(t), matches(t, ACCESS, 1), matches(t, HEX, 2), entropic(t, window, allowed))
    return docs.withColumn("secrets", F.sort_array(found))


def listing(secrets: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark."""

    def cut(at: Column) -> Column:
        # at: the greatest end before each span; a block of spans cuts within the text from its own start to that of the next
        own = F.transform(secrets, lambda s, i: F.struct(s["start"].alias("start"), F.get(at, i).alias("at")))
        end = F.array_max(F.transform(secrets, lambda s: s["end"]))

        def block(spans: Column, b: Column) -> Column:
            first = F.get(at, b * RUN)
            until = F.coalesce(F.get(at, (b + 1) * RUN), end)
            piece = lambda x, s: F.when(s["start"] >= s["at"], F.concat(x.substr(s["at"] - first + 1, s["start"] - s["at"]), F.lit(mark))).otherwise(F.lit(""))
            return _let(text.substr(first + 1, until - first), lambda x: F.array_join(F.transform(spans, lambda s: piece(x, s)), ""))

        blocks = F.transform(F.sequence(F.lit(0), ((F.size(secrets) - 1) / RUN).cast("int")), lambda b: block(F.slice(own, b * RUN + 1, F.lit(RUN)), b))
        return F.concat(F.array_join(blocks, ""), text.substr(end + 1, F.length(text)))

    return F.when(F.size(secrets) > 0, _let(running(F.transform(secrets, lambda s: s["end"]), F.greatest), cut)).otherwise(text)
