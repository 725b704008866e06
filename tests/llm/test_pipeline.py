"""The pipeline's stages, one after the other, against plain versions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import prose
from trestle.llm import shared


def test_pipeline(spark, tmp_path):
    shared.ship(spark)
    rng = random.Random(6)
    item = prose(rng, 40)
    rows = [(i, prose(rng, rng.randint(80, 200)), "en", "a", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "b", 1) for i in range(10)]
    rows += [(200, prose(rng, 60) + " " + item + " " + prose(rng, 60), "fr", None, 1), (201, item + " " + item[:0] + "x", "en", "a", 1), (202, prose(rng, 80) + " password = abcdefgh12345678", None, "a", 1), (203, "too short", "en", "a", 1), (204, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.table(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert not {203, 204} & set(seen["quality_rules"]) and len(set(range(60)) & set(seen["quality_rules"])) >= 58
    components = brute.near([(d, r["text"]) for d, r in seen["quality_rules"].items()])
    assert set(seen["near_duplicates"]) == {c for _, c in components.values()}
    assert item not in seen["decontamination"][200]["text"] and len(seen["decontamination"]) >= len(seen["near_duplicates"]) - 1
    assert "abcdefgh12345678" not in seen["secret_scans"][202]["text"] and set(seen["secret_scans"]) == set(seen["decontamination"])
    assert {r for r in seen["packing"]} == set(seen["secret_scans"])
    total = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).collect()[0][0]
    assert total == docs.agg(F.sum("length")).collect()[0][0]


def five_words(rows, percent=80):
    """Least id of each component of documents whose five-word sets are that similar."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows if (w := t.lower().split())}
    first = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    first[a] = first[b] = min(first[a], first[b])
    return set(first.values())


def test_near_stage(spark):
    """The stage takes five words and 80 per cent: a copy with a fifth of new text goes, one with a third stays."""
    rng = random.Random(15)
    base = [prose(rng, 200) for _ in range(4)]
    texts = [*base, base[0] + " " + prose(rng, 40), base[1] + " " + prose(rng, 70), base[2] + " " + prose(rng, 10)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == five_words(list(enumerate(texts))) == {0, 1, 2, 3, 5}


def test_null_and_repeated_ids(spark):
    """Rows without an id stay, rows that share one are judged apart, and one row of equal ones stays."""
    rng = random.Random(16)
    a, b, c, d = (prose(rng, 120) for _ in range(4))
    rows = [(None, a), (None, b), (1, c), (1, "too short"), (2, d), (2, d), (3, d), (None, d), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    key = lambda r: (r[0] or 0, r[1])
    kept = shared.table(corpus_pipeline.quality_rules(spark, docs, ""), "kept")
    assert sorted((key(r) for r in kept.collect())) == sorted(key(r) for r in rows if r[1] not in (None, "too short"))
    left = corpus_pipeline.near_duplicates(spark, kept, "").collect()
    assert sorted(key(r) for r in left) == sorted([(0, a), (0, b), (1, c), (2, d)])


def test_empty_table(spark, tmp_path):
    """No documents give no pieces, and every stage but the last keeps the columns."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == corpus_pipeline.COLUMNS and found.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
