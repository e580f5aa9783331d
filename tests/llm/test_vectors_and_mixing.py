"""Whitening, source mixing and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_twins import SF
from tidewater.llm import mixing, negatives, queries, whitening

ROWS = "vec_id long, embedding array<float>, label int"
ODD_VECTORS = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0] * 9, [1e30] * 6]


def embeddings(spark, vectors, labels=None, ids=None):
    n = len(vectors)
    ids = list(range(n)) if ids is None else ids
    labels = [0] * n if labels is None else labels
    plain = lambda v: None if v is None else [None if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, plain(v), k) for i, v, k in zip(ids, vectors, labels, strict=True)], ROWS).repartition(3)


def brute_whitening(x, k):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((x * n - sums) ** 2).sum(1), (x * n - sums) / n @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_matches_a_full_decomposition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], dtype=np.float64)).astype(np.int64) + 1_000_000
    n, deviation, whitened, explained = brute_whitening(x, 16)
    found = sorted(queries.op11_embedding_whitening(spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in found] == [(r.vec_id, c) for r in rows for c in range(1, 17)]
    got = np.array([r.whitened for r in found]).reshape(-1, 16)
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got * signs - whitened).max() < 1e-9
    assert {r.n for r in found} == {n} and [r.deviation for r in found[::16]] == deviation.tolist()
    assert np.abs(np.array([r.explained for r in found[:16]]) / explained - 1).max() < 1e-10
    assert {r.identity_error for r in found} <= {found[0].identity_error} and found[0].identity_error < 1e-9


@pytest.mark.parametrize(("dims", "spread"), [(40, 0.97), (120, 0.999), (300, 0.9)])
def test_lobpcg_certifies_leading_pairs(dims, spread):
    """Spectra that fall fast, slowly and over many orders; more dimensions than three blocks span."""
    rng = np.random.default_rng(dims)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    v = (q * spread ** np.arange(dims)) @ q.T
    values, vectors, residuals, rounds = whitening.lobpcg(lambda b: v @ b, dims, 8)
    assert rounds < 200 and residuals.max() <= 4e-13 and np.abs(values - spread ** np.arange(8)).max() < 1e-12
    assert np.abs(np.abs(np.einsum("ij,ij->j", q[:, :8], vectors)) - 1).max() < 1e-10


def test_lobpcg_says_when_it_has_not_settled():
    v = np.diag(np.linspace(1, 1.001, 200))
    with pytest.raises(ArithmeticError, match="rounds"):
        whitening.lobpcg(lambda b: v @ b, 200, 4, guard=0, max_rounds=3)


def test_whitening_of_odd_rows(spark):
    """Rows that cannot be used give none; copies weigh once; directions without variance give no component."""
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((40, 3)) @ rng.standard_normal((3, 6)) * 100
    exact = np.round(flat)
    exact[:, 5] = exact[:, 0] + exact[:, 1]
    vectors = [*exact.tolist(), *[exact[0].tolist()] * 30, *ODD_VECTORS]
    ids = [None, *range(1, 60), *[7] * (len(vectors) - 60)]
    docs = embeddings(spark, vectors, ids=ids).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    found = whitening.whiten(docs, factor=1).collect()
    x = exact.astype(np.int64) + 1_000_000
    n, deviation, _, explained = brute_whitening(x, 5)
    assert len(found) == 70 * 5 and {r.component for r in found} == {1, 2, 3, 4, 5} and {r.n for r in found} == {n}
    assert sum(r.vec_id is None for r in found) == 5 and sorted({r.deviation for r in found}) == sorted(set(deviation.tolist()))
    for c in range(5):
        assert {round(r.explained, 9) for r in found if r.component == c + 1} == {round(float(explained[c]), 9)}
    assert whitening.whiten(docs.limit(0)).count() == 0 == whitening.whiten(embeddings(spark, [[1.0, 2.0]] * 5)).count()
    assert whitening.whiten(embeddings(spark, [None, []])).count() == 0


def test_deviations_beyond_64_bits():
    x = np.array([[2**51, 5], [-(2**51), 7]], dtype=np.int64)
    y = whitening.deviations(x, 2**14, (1, 2))
    assert y.dtype == object and y[0, 0] == 2**65 - 1 and whitening.squared_length(y) == [None, None]
    assert whitening.squared_length(np.array([[3, 4], [2**31, 1]], dtype=np.int64)) == [25, 2**62 + 1]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def brute_targets(sizes, weights, most=3):
    """Share by weight, cap, share the excess again, until none is over."""
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weights[s] for s in sizes if s not in full)
        found = {s: most * sizes[s] if s in full else rest * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and found[s] > most * sizes[s]}
        if not over:
            return found
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "a", "a", "b", "é", "Z", None, "", f"s{i % 4}"] if seed else ["only"])) for i in range(300)]
    rows += [(None, "x y z", "b"), (5, "x y z", "b"), (5, "x y z", "b"), (900, None, "nothing"), (901, "  ", "nothing"), (902, "one \x0b\x1c two three", "tiny")]
    docs = documents(spark, rows).withColumns({"key": F.lit(1), "size": F.lit("clash"), "target": F.lit(0)})
    found = mixing.mix(docs, rows_per_cell=3).collect()
    words = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r["size"], r.source) for r in found), key=repr) == sorted(((i, words(t), s) for i, t, s in rows), key=repr)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in sizes:
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(math.isclose(r.target, want[s], abs_tol=1e-6) for r in mine)
        assert sum(r.taken for r in mine) == math.floor(mine[0].target) and all(r.taken <= 3 * r["size"] for r in mine)
        assert all(len(r.positions) == (math.ceil(r.taken / r["size"]) if r["size"] else 0) for r in mine)
    again = mixing.mix(docs.repartition(7), rows_per_cell=1000).collect()
    plain = lambda rs: sorted((tuple(map(str, r)) for r in rs))
    assert plain(found) == plain(again)


def test_positions_follow_the_integrated_schedule(spark):
    """The share of a source's words that is due by a time is the integral of its weight up to it."""
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    curriculum = (((0.0, 3.0), (0.25, 0.0), (0.5, 0.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (1.0, 4.0)))
    order = mixing.training_order(mixing.mix(documents(spark, rows), curriculum=curriculum))
    found = order.collect()
    assert [r.position for r in found] == sorted(r.position for r in found)
    for s, knots in zip("abc", curriculum, strict=True):
        mine = [r for r in found if r.source == s]
        for t in (0.1, 0.25, 0.4, 0.5, 0.7, 0.9):
            done = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
                u = min(max(t - t0, 0.0), t1 - t0)
                done += a * u + (b - a) / (t1 - t0) * u * u / 2
            share = sum(r.words for r in mine if r.position <= t) / sum(r.words for r in mine)
            assert abs(share - done / mixing.integral(knots)) < 0.002
    plan = order._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(position" in plan
    for bad in ([(0.0, 1.0)], [(0.0, 1.0), (0.5, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, -1.0), (1.0, 5.0)]):
        with pytest.raises(ValueError):
            mixing.mix(documents(spark, rows), curriculum=[bad])


def test_mixed_texts_and_empty_tables(spark):
    docs = documents(spark, [(1, "a b c d", "x"), (2, "e  f", "x"), (2, "e  f", "x"), (3, "g", "y"), (4, None, "y")])
    mixed = mixing.mix(docs)
    texts = mixing.mixed_texts(docs, mixed).collect()
    assert [r.position for r in texts] == sorted(r.position for r in texts)
    assert all(len(r.text.split()) == r.words for r in texts) and sum(r.words for r in texts) == sum(r.taken for r in mixed.collect())
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.mixed_texts(docs.limit(0), mixing.mix(docs.limit(0))).count()
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_mix_runs_no_python(spark):
    plan = queries.op12_source_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_negatives(rows, positives=5, negatives_=5, percent=80, every=100):
    x = {i: (k, np.array([math.floor(256 * float(np.float32(c))) for c in v], dtype=np.int64)) for i, v, k in rows}
    out = []
    for a, (label, v) in x.items():
        if a % every:
            continue
        scored = sorted(((-int(v @ w), i, k == label) for i, (k, w) in x.items() if i != a))
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            inside = [r for r in scored if not r[2] and percent * -s <= 100 * -r[0] <= 100 * -s][:negatives_]
            out += [(a, p, j + 1, i, -s, -t) for j, (t, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "dims", "options"), [(1, 16, {}), (2, 7, {"rows_per_block": 700, "anchors_per_block": 2}), (3, 1, {"quantiser": negatives.Quantiser(parts=3, centroids=4, sample=50, rounds=2)})])
def test_hard_negatives_match_brute_force(spark, seed, dims, options):
    """Clusters, ties, copies, negative scores and labels without a match; blocks of any size give the same rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims)) * 0.3
    vectors = centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, dims)) * rng.choice([0.0, 0.02, 0.3], (1500, 1))
    labels = np.where(rng.random(1500) < 0.4, 1, rng.integers(0, 6, 1500))
    labels[100], labels[200:300] = 77, 3
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(vectors.astype(np.float32).tolist(), labels, strict=True))]
    odd = [(5000 + 100 * j, v, 1) for j, v in enumerate(ODD_VECTORS)] + [(9000, rows[0][1], None), (None, rows[0][1], 1)]
    table = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], k) for i, v, k in rows + odd], ROWS).repartition(5)
    clash = table.withColumns({"x": F.lit("a"), "code": F.lit(1), "anchor": F.lit(2), "block_a": F.lit(3)})
    found = negatives.hard_negatives(clash, **options)
    want = brute_negatives(rows)
    assert len(want) > 150 and sorted(tuple(r) for r in found.collect()) == want
    assert negatives.hard_negatives(table.limit(0)).count() == 0 == negatives.hard_negatives(table.filter("vec_id % 100 <> 0")).count()


def test_repeated_anchors_are_one(spark):
    rows = [(0, [1.0, 0.0], 1)] * 3 + [(1, [1.0, 0.1], 1)] * 2 + [(2, [0.9, 0.0], 2), (3, [0.95, 0.0], 2)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in found) == sorted([(0, 1, 1, 3), (0, 1, 2, 2)] * 2)


def test_bounds_hold_and_rule_most_out():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((4000, 64)) * 32).astype(np.int64)
    book = negatives.fit_codebook(x[:2000])
    codes, left = book.encode(x)
    kept = 0
    for here, some, low, high in negatives._bounded(book, x[:300], x, codes, left):
        exact = x[here] @ x[:300][some].T
        assert (low <= exact).all() and (exact <= high).all()
        kept += int((high >= np.sort(exact, axis=0)[-5]).sum())
    assert kept < 0.1 * 300 * 4000
