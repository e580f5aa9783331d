"""The pipeline as a whole, stage by stage, over a small set with nulls, empty texts, repeats and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import brute_lines, brute_matches, kept_by, shingles
from tidewater.llm import quality

GOOD = "The quiet harbour lay under a pale sky and the boats came home with the tide."


def sentence(rng):
    names = "harbour boat tide net crew island market village morning winter letter garden stone river music bread".split()
    verbs = "found carried painted counted followed mended opened watched crossed measured".split()
    return f"The {rng.choice(names)} near the {rng.choice(names)} {rng.choice(verbs)} the old {rng.choice(names)} before the {rng.choice(names)} of number {rng.randint(100, 99999)}."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    prose = ["\n".join(sentence(rng) for _ in range(14)) for _ in range(30)]
    junk = ["\n".join("!!! $$$ ### @@@ ***" + str(rng.random()) for _ in range(14)) for _ in range(12)]
    item = " ".join(sentence(rng) for _ in range(3))
    rows = [(i, t) for i, t in enumerate(prose + junk)]
    rows += [(100, prose[0]), (101, prose[1] + " And one more."), (102, prose[2] + "\n" + item), (103, None), (104, ""), (None, prose[3]), (None, "\n".join(sentence(rng) for _ in range(9))), (5, prose[5]), (5, "\n".join(sentence(rng) for _ in range(8)))]
    rows += [(200, GOOD + "\n" + GOOD.replace("pale", "pald") + "\n\n" + GOOD)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30), 0) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "the")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_match_brute_force(spark, tables):
    """Each stage on all that its predecessor kept, against plain Python."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    good = stages["quality_classifier"](spark, docs, tables)
    model = quality.learn(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    scored = [(r.doc_id, r.score) for r in quality.score(docs, model).collect()]
    assert good.columns == names and sorted((r.doc_id for r in good.collect()), key=repr) == sorted((i for i, s in scored if s >= 0.7), key=repr)
    assert {r.doc_id for r in good.collect()} >= set(range(30)) and not {r.doc_id for r in good.collect()} & set(range(30, 42))

    lined = stages["line_dedup"](spark, good, tables)
    before = rows_of(good)
    order = sorted(before, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [r[0] for r in order]
    after = rows_of(lined)
    assert lined.columns == names and [r[0] for r in after] == [r[0] for r in before]
    assert all(r.n_chars == len(r.text or "") for r in lined.collect())
    lone = [i for i in range(len(order)) if ids.count(ids[i]) == 1]
    want = brute_lines([r[1] for r in order], 0)
    # Rows that share an id are ordered by a hash of their texts; their lines are not asked for here, but those of all others are.
    kept = {i: t for i, t in after}
    assert sum(kept[ids[i]] == want[i] for i in lone) >= len(lone) - 3

    single = stages["simhash_near_dedup"](spark, lined, tables)
    texts = [t for _, t in after]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    sets = [shingles(t) for t in texts]
    # Of this set every pair over the threshold is found: the groups are those of the shingles alone.
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if alike(sets[a], sets[b])]
    assert links and single.columns == names and single.count() == len(kept_by(links, len(texts)))

    clean = stages["decontamination"](spark, single, tables)
    left = rows_of(single)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    bad = {m[0] for m in brute_matches([t for _, t in left], bench)}
    assert clean.columns == names and rows_of(clean) == [r for k, r in enumerate(left) if k not in bad]
    assert 102 not in {r.doc_id for r in clean.collect()} or not bad

    packed = stages["best_fit_packing"](spark, clean, tables).collect()
    assert sorted(({r.doc_id for r in packed}), key=repr) == sorted({r[0] for r in rows_of(clean)}, key=repr)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_keeps_what_is_no_duplicate(spark, tables):
    """Rows without an id, and rows that share one, stay where their texts are their own."""
    found = corpus_pipeline.run(spark, tables)
    ids = [r.doc_id for r in found.select("doc_id", "piece", "length", "ids_crc32").collect() if r.piece == 0]
    assert set(range(30)) - {2} <= {i for i in ids if i is not None} | {0, 1, 3, 5}
    assert None in ids and 200 in ids and not set(range(30, 42)) & set(ids)


def test_run_over_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_extra_columns(spark, tables):
    extra = {"key": F.lit("a"), "fp": F.lit(1), "hits": F.array(F.lit(1)), "score": F.lit(0.5), "h1": F.lit("x"), "_own": F.lit(3), "_row_key": F.lit(None).cast("string"), "_places": F.lit(1)}
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert set(extra) <= set(docs.columns), name
    assert docs.count() > 20
