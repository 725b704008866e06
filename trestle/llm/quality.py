"""Quality rules: text statistics, hard limits, and robust multivariate outliers per language and source.

Everything here is DataFrame expressions; there is no Python on the executors.

`statistics` counts in each whole text. `robust_outliers` takes transformed statistics x and, for each group of
(lang, source), looks for the share `h` of rows whose covariance has the least determinant. It starts from three estimates: medians with
median absolute deviations, medians with the covariance of spatial signs, and mean and covariance of all rows. A concentration
step takes the `h` rows nearest to an estimate and makes their mean and covariance the next one; after two steps of each start the
one with the least determinant goes on until its determinant settles. Covariances are made consistent with the normal distribution and
regularised by a fixed diagonal (`FLOORS`), since most texts have no symbols or repeats at all: the determinant is that of their sum, which
concentration steps lower as well. Distances use a Cholesky factor that is written out as column expressions, so estimates never leave the executors.

A group below `min_group` rows is judged by the estimate of its language, made of all rows of the language, and a language below it by that of
all rows of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
FEATURES = ("x_words", "x_word_length", "x_symbols", "x_dup_lines", "x_repeats")
#: Variances added to those of the transformed statistics. Without them the first text that has a few symbols would be infinitely far away.
FLOORS = (0.25, 0.09, 0.16, 1.0, 1.0)
#: Signs of deviations that are no harm: more words; fewer symbols, repeated lines and repeated words.
HARMLESS = (1, 0, -1, -1, -1)
#: Groups of up to so many rows of estimates are broadcast; beyond it they are joined by key.
BROADCAST_GROUPS = 100_000
#: A step that moves the logarithm of a determinant by less than this is the last.
SETTLED = 1e-3
#: Up to so many repeated fingerprints of a text are looked up one by one; with more, all its windows are sorted.
FEW = 64


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more."""

    def covered(positions: Column) -> Column:
        gaps = F.aggregate(positions, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))
        return gaps["n"]

    def marked(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["t"].eqNullSafe(F.get(s, j)["t"])
        found = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when(((i > 0) & same(F.greatest(i - 1, F.lit(0)), i)) | ((i < F.size(s) - 1) & same(F.least(i + 1, F.size(s) - 1), i)), F.get(s, i)["p"]))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    def at(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def twice(p: Column) -> Column:
        """Fingerprints that occur twice or more."""
        return let(F.sort_array(p), lambda s: F.array_distinct(F.filter(F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0))) == x), x)), lambda x: x.isNotNull())))

    def candidates(w: Column, p: Column, d: Column) -> Column:
        likely = lambda x: (F.size(d) > FEW) | F.array_contains(d, x)
        made = F.transform(p, lambda x, i: F.when(likely(x), F.struct(F.concat_ws(" ", *at(w, i)).alias("t"), i.alias("p"))))
        return F.sort_array(F.filter(made, lambda c: c.isNotNull()))

    def count(w: Column) -> Column:
        # windows whose fingerprint occurs once occur once; the others are compared as strings
        prints = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*at(w, i)))
        some = lambda p: let(twice(p), lambda d: let(let(candidates(w, p, d), marked), covered))
        return let(prints, lambda p: F.when(F.size(F.array_distinct(p)) == F.size(p), F.lit(0)).otherwise(some(p)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(count(words))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words. A null text has none of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"))
    stats = F.struct(
        let(word_array(t), of_words).alias("w"),
        (F.size(F.split(t, f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return docs.withColumn("__s", stats).select(*docs.columns, "__s.w.n_words", "__s.w.word_chars", "__s.n_symbols", "__s.n_dup_lines", "__s.w.n_repeat_words")


def transformed() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / n),
        F.log1p(100.0 * F.col("n_symbols") / chars),
        F.log1p(100.0 * F.col("n_dup_lines") / (F.lit(10) + n / 10)),
        F.log1p(100.0 * F.col("n_repeat_words") / n),
    ]


def factor_columns(d: int, floors: tuple[float, ...]) -> list[tuple[str, Column]]:
    """Columns l_i_j of the Cholesky factor from columns c_i_j, in the order in which they depend on each other."""
    out = []
    for i in range(d):
        for j in range(i + 1):
            s = F.col(f"c_{i}_{j}") + F.lit(floors[i] if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out.append((f"l_{i}_{j}", F.sqrt(F.greatest(s, F.lit(floors[i] * 1e-3))) if i == j else s / F.col(f"l_{j}_{j}")))
    return out


def _names(d: int) -> tuple[list[str], list[tuple[int, int]]]:
    return [f"x{i}" for i in range(d)], [(i, j) for i in range(d) for j in range(i + 1)]


def _factored(est: DataFrame, d: int, floors: tuple[float, ...]) -> DataFrame:
    """(g, start, m_i, l_i_j, logdet) from columns m_i and c_i_j."""
    for name, value in factor_columns(d, floors):
        est = est.withColumn(name, value)
    logdet = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, d)), 2 * F.log(F.col("l_0_0")))
    return est.select("g", "start", *[f"m_{i}" for i in range(d)], *[f"l_{i}_{j}" for i, j in _names(d)[1]], logdet.alias("logdet"))


def _with(rows: DataFrame, est: DataFrame, small: bool, *on: str) -> DataFrame:
    return rows.join(F.broadcast(est) if small else est, list(on) or ["g"])


def _starts(rows: DataFrame, d: int, floors: tuple[float, ...], small: bool) -> DataFrame:
    """Three estimates of each group, from all its rows."""
    x, pairs = _names(d)
    mid = shared.table(rows.groupBy("g").agg(*[F.percentile_approx(c, 0.5).alias(f"m_{i}") for i, c in enumerate(x)]), "medians")
    spread = _with(rows, mid, small).groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5).alias(f"d_{i}") for i, c in enumerate(x)])
    scaled = [F.sqrt(F.pow(1.4826 * F.col(f"d_{i}"), F.lit(2.0)) + floors[i]).alias(f"s_{i}") for i in range(d)]
    scales = shared.table(mid.join(spread, "g").select("g", *[f"m_{i}" for i in range(d)], *scaled), "spreads")
    signs = _with(rows, scales, small).select("g", *x, *[((F.col(c) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z{i}") for i, c in enumerate(x)])
    norm = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, d)), F.col("z0") * F.col("z0"))
    moments = signs.withColumn("norm", F.greatest(norm, F.lit(1e-12))).groupBy("g").agg(
        *[F.avg(c).alias(f"a_{i}") for i, c in enumerate(x)],
        *[F.avg(F.col(x[i]) * F.col(x[j])).alias(f"q_{i}_{j}") for i, j in pairs],
        *[F.avg(d * F.col(f"z{i}") * F.col(f"z{j}") / F.col("norm")).alias(f"u_{i}_{j}") for i, j in pairs],
    )
    centre = [F.col(f"m_{i}") for i in range(d)]
    kinds = (
        (centre, {(i, j): F.pow(f"s_{i}", F.lit(2.0)) - floors[i] if i == j else F.lit(0.0) for i, j in pairs}),
        (centre, {(i, j): F.col(f"u_{i}_{j}") * F.col(f"s_{i}") * F.col(f"s_{j}") for i, j in pairs}),
        ([F.col(f"a_{i}") for i in range(d)], {(i, j): F.col(f"q_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}") for i, j in pairs}),
    )
    one = lambda k, m, c: F.struct(F.lit(k).alias("start"), *[v.alias(f"m_{i}") for i, v in enumerate(m)], *[c[i, j].alias(f"c_{i}_{j}") for i, j in pairs])
    each = scales.join(moments, "g").select("g", F.explode(F.array(*[one(k, m, c) for k, (m, c) in enumerate(kinds)])).alias("e")).select("g", "e.*")
    return _factored(each, d, floors)


def _concentrated(rows: DataFrame, est: DataFrame, d: int, share: float, floors: tuple[float, ...], small: bool) -> DataFrame:
    """The estimates after one step: mean and covariance of the share of rows nearest to each."""
    x, pairs = _names(d)
    far = _with(rows, est, small).select("g", "start", *x, _far(d).alias("far"))
    limit = far.groupBy("g", "start").agg(F.percentile_approx("far", share).alias("limit"))
    near = _with(far, limit, small, "g", "start").filter("far <= limit")
    sums = near.groupBy("g", "start").agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(x)], *[F.avg(F.col(x[i]) * F.col(x[j])).alias(f"q_{i}_{j}") for i, j in pairs])
    factor = consistency(share, d)
    covariance = [(factor * (F.col(f"q_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}"))).alias(f"c_{i}_{j}") for i, j in pairs]
    return _factored(sums.select("g", "start", *[f"m_{i}" for i in range(d)], *covariance), d, floors)


def _far(d: int, harmless: tuple[int, ...] | None = None) -> Column:
    """The squared distance; deviations with a harmless sign count as zero."""
    total: Column = F.lit(0.0)
    names = []
    for i in range(d):
        y = F.col(f"x{i}") - F.col(f"m_{i}")
        if harmless and harmless[i]:
            y = (F.least if harmless[i] > 0 else F.greatest)(y, F.lit(0.0))
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * names[k]
        y = y / F.col(f"l_{i}_{i}")
        names.append(y)
        total = total + y * y
    return total


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("-"))


def group_name() -> Column:
    return F.concat_ws("\x1f", _named("lang"), _named("source"))


def levels(docs: DataFrame, min_group: int) -> DataFrame:
    """(k, g, also) for each (lang, source), named k: the level that judges its rows, and all levels whose estimates they are part of."""
    sizes = shared.table(docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).select(group_name().alias("k"), _named("lang").alias("l"), "n"), "groups")
    langs = sizes.groupBy("l").agg(F.sum("n").alias("m"), F.min("n").alias("least"))
    none = F.array().cast("array<string>")
    rest = F.array(F.lit("")) if langs.filter(F.col("m") < min_group).limit(1).count() else none
    own = F.when(F.col("n") >= min_group, F.col("k")).when(F.col("m") >= min_group, F.col("l")).otherwise("")
    wide = F.when((F.col("m") >= min_group) & (F.col("least") < min_group), F.array("l")).otherwise(none)
    return sizes.join(langs, "l").select("k", own.alias("g"), F.array_distinct(F.concat(F.array(own), wide, rest)).alias("also"))


def robust_outliers(stats: DataFrame, keep: list[str], share: float = 0.75, most_steps: int = 20, min_group: int = 200, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """The columns `keep` of stats with `distance`, the squared robust Mahalanobis distance within (lang, source), and `harm`.

    `harm` is the distance of the deviations that aren't harmless, and never more than `distance`.
    Null lang or source is a group value of its own. Rows of an empty table have no estimate and there are none. Steps end when no
    determinant's logarithm moves by more than SETTLED, at the latest after `most_steps`.
    """
    d = len(FEATURES)
    known = shared.table(levels(stats, min_group), "levels")
    small = known.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = stats.select(F.struct(*keep).alias("__row"), group_name().alias("k"), *[c.alias(f"x{i}") for i, c in enumerate(transformed())])
    rows = shared.table(_with(rows, known, small, "k").drop("k"), "statistics")
    each = rows.select(F.explode("also").alias("g"), *_names(d)[0])
    est = shared.table(_starts(each, d, floors, small), "starts")
    for _ in range(2):
        est = shared.table(_concentrated(each, est, d, share, floors, small), "estimates")
    best = est.groupBy("g").agg(F.min_by(F.struct(*est.columns[1:]), F.struct("logdet", "start")).alias("e")).select("g", "e.*")
    est = shared.table(best, "best")
    for _ in range(most_steps):
        new = shared.table(_concentrated(each, est, d, share, floors, small), "estimates")
        moved = new.select("g", "logdet").join(est.select("g", F.col("logdet").alias("before")), "g").filter(F.abs(F.col("logdet") - F.col("before")) > SETTLED).limit(1).count()
        est = new
        if not moved:
            break
    return _with(rows, est, small).select("__row.*", _far(d).alias("distance"), F.least(_far(d), _far(d, HARMLESS)).alias("harm"))


def chi_square(x: float, k: int) -> float:
    """The distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a))


def consistency(share: float, d: int) -> float:
    """What the covariance of the nearest `share` of normal rows is short of, as a factor."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, d) < share else (low, middle)
    return share / chi_square(low, d + 2)


def chi_square_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, keep: list[str] | None = None, limit: float | None = None, **mcd) -> DataFrame:
    """Statistics of each document, base_failed, distance and kept.

    docs needs doc_id, text, lang and source. kept is false if base_failed, else whether the robust distance is at
    most `limit` (the 0.9999 quantile of chi-square unless given) or the text isn't extreme in a bad direction:
    far from the centre only by being long, free of symbols or free of repeats is no reason to go. Null texts have
    no words and fail. Rows that repeat are judged each by itself; an empty table gives no rows. Other columns are
    not touched, whatever their names.
    """
    limit = chi_square_quantile(0.9999, len(FEATURES)) if limit is None else limit
    base = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep or []], "doc_id", "text", "lang", "source")
    stats = statistics(base).drop("text")
    carried = [c for c in stats.columns if c not in ("lang", "source")]
    out = robust_outliers(stats, carried, **mcd)
    failed = base_failed()
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("harm") <= limit)).drop("harm")
