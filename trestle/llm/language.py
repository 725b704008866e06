"""Hierarchical language identification.

Features of a whole text are hashed character n-grams (one to `GRAMS` bytes within space-padded, lower-cased letter
runs), counted, damped by square root and scaled to length one. A linear model first predicts the language family;
within the family, one-versus-one linear support vector machines vote between its languages. Both are trained here by
dual coordinate descent on a bounded sample of labelled rows: about `per_language` rows of each language, and fewer of each if there are so many languages that
it would be more than `most_rows` in all (but never fewer than `LEAST_ROWS`), chosen by a hash of doc_id. Their features come to the driver, at most 6 * BUCKETS bytes for each, and no text does; the
model that goes back has a size fixed by `BUCKETS` and the number of languages. Every language that has a labelled row is learnt.

Families come from a table of common languages; a language that is not listed is a family of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BUCKETS = 1 << 13
#: Keeps the top bits of a 32-bit hash.
SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())
GRAMS = 3
PER_LANGUAGE, MOST_ROWS, LEAST_ROWS = 800, 12_000, 30
#: Families of common languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ne si ur",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def counts(text: bytes) -> np.ndarray:
    """Hashed n-gram counts. Every byte that is no ASCII letter and not beyond ASCII counts as a space."""
    b = np.frombuffer(b" " + text.lower().translate(_LETTERS) + b" ", dtype=np.uint8).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    value, parts = np.zeros(len(b), dtype=np.uint32), []
    for n in range(1, min(GRAMS, len(b)) + 1):
        value = value[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        parts.append(((value + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> SHIFT)
    return np.bincount(np.concatenate(parts), minlength=BUCKETS)


_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    x = np.sqrt(counts(text).astype(np.float32))
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


Row = tuple[np.ndarray, np.ndarray]


def sparse(x: np.ndarray) -> Row:
    at = np.flatnonzero(x)
    return at, x[at]


def svm(x: list[Row], y: np.ndarray, c: float = 4.0, passes: int = 8) -> np.ndarray:
    """Weights (with the bias last) of a linear support vector machine with hinge loss, by dual coordinate descent."""
    w = np.zeros(BUCKETS + 1, dtype=np.float64)
    alpha = np.zeros(len(x))
    q = [float(v @ v) + 1.0 for _, v in x]
    rng = np.random.default_rng(7)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - g / q[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    def __init__(self, rows: list[tuple[str, Row]]):
        langs = sorted({lang for lang, _ in rows})
        x = [r for _, r in rows]
        lang = np.array([a for a, _ in rows])
        family = np.array([FAMILY_OF.get(a, a) for a in lang])
        self.families = sorted(set(family.tolist()))
        self.members = {f: [a for a in langs if FAMILY_OF.get(a, a) == f] for f in self.families}
        self.family_w = np.array([svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                own = np.flatnonzero((lang == a) | (lang == b))
                self.pairs[a, b] = svm([x[k] for k in own], np.where(lang[own] == a, 1.0, -1.0))

    def __call__(self, text: bytes) -> tuple[str, float]:
        """The language and a score from 0 to 1: the family's share times the language's share of the logistic margins."""
        x = features(text)
        family, score = self.families[0], 1.0
        if self.family_w is not None:
            m = self.family_w[:, :-1] @ x + self.family_w[:, -1]
            p = np.exp(2 * (m - m.max()))
            k = int(m.argmax())
            family, score = self.families[k], float(p[k] / p.sum())
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], score
        votes, won = dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0)
        for (a, b), w in self.pairs.items():
            if a in votes and b in votes:
                p = 1 / (1 + np.exp(-2 * float(w[:-1] @ x + w[-1])))
                votes[a] += p
                votes[b] += 1 - p
                won[a if p >= 0.5 else b] += 1
        best = max(langs, key=lambda a: (won[a], votes[a]))
        return best, score * votes[best] / (len(langs) - 1)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model | None:
    """A model from the labelled rows of docs (doc_id, text, lang); None if there are none.

    The number of rows of each language is counted over all rows; then rows go in by a hash of their id, at the rate that
    gives about `per_language` of each, or all if there are no more. Languages of few rows go in whole, however many languages there are.
    """
    usable = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known = found.collect()  # a row for each language
    if not known:
        return None
    each = min(per_language, max(LEAST_ROWS, most_rows // len(known)))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in known], "lang string, rate double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(rates), "lang").filter(drawn < F.col("rate")).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            keep, at, value = [], [], []
            for k, text in enumerate(W.texts(batch)):
                if has_letter(text.decode()):
                    i, v = sparse(features(text))
                    keep.append(k)
                    at.append(i.astype("<u2").tobytes())
                    value.append(v.astype("<f4").tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "lang", "at", "value"])

    # a rare id that very many rows share can't bring more than twice the rows asked for
    taken = rows.mapInArrow(run, "doc_id long, lang string, at binary, value binary").orderBy("doc_id", "lang", "at", "value").limit(2 * each * len(known)).collect()
    x = [(r["lang"], (np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4"))) for r in taken]
    return Model(x) if x else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text).

    A null text, or one without a letter, is `und` with score 0; so is every text if there was nothing to learn from. Only
    the text decides, so ties and repeated rows get equal answers. An empty table gives no rows; other columns are not read.
    """
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared_model.value
        for batch in W.chunks(batches):
            lang, score = [], []
            for text in W.texts(batch):
                known = own is not None and has_letter(text.decode())
                a, s = own(text) if known else (UNKNOWN, 0.0)
                lang.append(a)
                score.append(min(1.0, max(0.0, s)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
