"""Fingerprints, exact copies, line dedup, decontamination against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, exact_dedup, line_dedup, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice(["", "s", "ed"]) for _ in range(n))


ODD = [None, "", " \t\n", "one", "One two", "ONE\x0btwo", "é É ß", "x" * 5000, "a b c d e f g", "a b c d e f g"]


def brute_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", folded) if w]
    if not found:
        return 0
    grams = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(3)
    base = words(rng, 300)
    texts = ODD + [words(rng, rng.randint(1, 60)) for _ in range(60)] + [base + " " + words(rng, k % 4) for k in range(40)]
    found = {r.doc_id: r for r in simhash_dedup.near_duplicates(documents(spark, texts)).collect()}
    marks = [brute_fingerprint(t) for t in texts]
    assert [found[i].fingerprint for i in range(len(texts))] == [f"{m:016x}" for m in marks]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert [found[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_simhash_cuts_large_buckets(spark):
    """A dense group is found whole, though no bucket may hold more than a few fingerprints."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)}
    far = {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(near | far)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for limit in (32, 1000):
        links = simhash_dedup.links(df, bucket_limit=limit)
        roots = simhash_dedup.connected_components(links).collect()
        group = {r.node % (1 << 64): r.root for r in roots}
        assert len({group.get(x, group[centre] if x == roots[0].root % (1 << 64) else None) for x in near} - {None}) == 1
        pairs = {(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4}
        reach = {x: group.get(x, x - (1 << 64) if x >> 63 else x) for x in fps}
        assert all(reach[a] == reach[b] for a, b in pairs)


def test_pivot_filter_drops_no_link():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    both = np.unique(np.concatenate([fps, fps ^ np.uint64(0b1011)]))
    table = simhash_dedup.pivot_table(both, simhash_dedup.pivots(16))
    _, a, b = simhash_dedup.bucket_links(both, table, np.full(len(both), len(both)), 4)
    linked = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert {frozenset((int(x), int(x) ^ 0b1011)) for x in fps} <= linked


def test_references_are_far_from_each_other():
    refs = simhash_dedup.pivots(63)
    assert {(a ^ b).bit_count() for a, b in itertools.combinations(refs.tolist(), 2)} == {32}


def test_pivot_table_discards_most_candidates(spark):
    """Of the pairs that share a mask's bits on sf0.01, the table discards nearly all that are no links, and no link."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = np.unique(np.array([r.fp for r in simhash_dedup.fingerprints(docs).collect()], dtype=np.int64).view(np.uint64))
    table = simhash_dedup.pivot_table(fps, simhash_dedup.pivots(16))
    seen = kept = linked = 0
    for mask in simhash_dedup.block_masks(simhash_dedup.choose_blocks(len(fps), 4), 4):
        order = np.argsort(fps & np.uint64(mask), kind="stable")
        keys = fps[order] & np.uint64(mask)
        i, j = (np.array(x, dtype=np.int64) for x in zip(*[(order[a], order[b]) for a, b in itertools.combinations(range(len(fps)), 2) if keys[a] == keys[b]], strict=True)) if len(np.unique(keys)) < len(keys) else (np.zeros(0, np.int64),) * 2
        at = simhash_dedup.may_link(table, i, j, 4)
        links = np.bitwise_count(fps[i] ^ fps[j]) <= 4
        assert set(np.flatnonzero(links)) <= set(at.tolist())
        seen, kept, linked = seen + len(i), kept + len(at), linked + int(links.sum())
    assert seen - linked > 50 and kept - linked <= 0.1 * (seen - linked)


@pytest.mark.parametrize("words", [4, 5])
def test_simhash_null_and_repeated_ids_and_clashing_columns(spark, words):
    texts = ["a b c d e f", "A b c d e f", "other words in this one", None, ""]
    docs = documents(spark, texts, [None, 7, 7, None, 3]).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("mask", F.lit(0))
    found = sorted((r.fingerprint, r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash_dedup.near_duplicates(docs, words=words).collect())
    assert [x[3] for x in found if x[0] == "0" * 16] == [3, 3] and len(found) == 5
    assert {x[3] for x in found} == {3, 7}
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert simhash_dedup.keep_one(docs.limit(0)).columns == docs.columns


def shingles(text):
    found = (text or "").lower().split()
    return {" ".join(found[i : i + 5]) for i in range(len(found) - 4)} or {" ".join(found)} - {""}


def links_by_brute_force(spark, texts):
    """Pairs of texts of which a fingerprint is within 4 bits and that share 0.8 of their distinct shingles."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    marks = {r.row: np.array(r.fps, dtype=np.int64) for r in simhash_dedup.digests_and_prints(rows, 5, 42, 8).collect()}
    sets = [shingles(t) for t in texts]
    near = lambda i, j: (np.bitwise_count(marks[i] ^ marks[j]) <= 4).any()
    return [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near(i, j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]


def kept_by(links, n):
    root = list(range(n))
    for i, j in sorted(links):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    return sorted(set(root))


def kept_ids(spark, texts, **options):
    return sorted(r.doc_id for r in simhash_dedup.keep_one(documents(spark, texts), **options).collect())


def replaced(rng, text, n):
    found = text.split()
    for i in rng.sample(range(len(found)), n):
        found[i] = f"new{rng.randrange(10**6)}"
    return " ".join(found)


@pytest.mark.parametrize("limit", [32, 1024])
def test_keep_one_matches_brute_force(spark, limit):
    """Groups by distance and by similarity of shingles, with copies around the threshold, whatever the size of a bucket."""
    rng = random.Random(4)
    base = [words(rng, 400) for _ in range(6)]
    texts = ODD[:6] + base + [b + " " + words(rng, k) for b in base for k in (1, 3, 9)] + [replaced(rng, b, k) for b in base for k in (1, 4, 7, 9, 11, 14) for _ in range(3)]
    found = links_by_brute_force(spark, texts)
    assert len(found) > 100 and kept_ids(spark, texts, bucket_limit=limit) == kept_by(found, len(texts))


def test_keep_one_leaves_unlike_texts_under_a_dominant_line(spark):
    """A line that makes up most of a text does not make two texts alike."""
    rng = random.Random(8)
    texts = ["menu of the day " * 120 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(20)]
    assert kept_ids(spark, texts) == list(range(20))


def test_keep_one_loses_no_link_that_others_stood_for(spark):
    """A and B, A and C are near in bits but unlike; B and C are alike, and one of them goes. Every pair is a candidate here."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = a[:140] + [f"b{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(a), " ".join(b), " ".join([*b, "end"])]
    want = sorted(set(range(36)) - set(range(2, 36, 3)))
    assert kept_ids(spark, texts) == want
    # With a wide bound the buckets are spanned by pairs that mostly fail; what they stood for is found all the same.
    assert kept_ids(spark, texts, max_bits=24, prints=1, bucket_limit=1 << 26) == want


def test_cross_pairs_are_all_pairs_once(spark):
    rows = [(0, 1, 2, fp, node, node % 3) for node, fp in enumerate([0, 1, 3, 255, 7, 1 << 40, 0, 2, 6, 4])]
    members = spark.createDataFrame(rows, "slot int, mask long, key long, fp long, node long, label long")
    want = sorted((x[4], y[4]) for x, y in itertools.combinations(rows, 2) if (x[3] ^ y[3]).bit_count() <= 2 and x[5] != y[5])
    for limit in (2, 3, 100):
        assert sorted(tuple(r) for r in simhash_dedup.cross_pairs(members, 2, limit).collect()) == want


def test_keep_one(spark):
    texts = ["same text here now please", "other words are in this one", "same text here now please", None, ""]
    kept = simhash_dedup.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_keep_one_tells_rows_of_null_and_repeated_ids_apart(spark):
    a, b, c, d = "same text here now please", "other words are in this one", "a third text of its own words", "nothing in common with any above"
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (None, d), (7, d), (1, c), (5, None), (5, "")]
    kept = simhash_dedup.keep_one(documents(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    # One row of each text: the smallest id; a null id only where no row has one.
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(1, a), (2, b), (1, c), (7, d), (5, "")])
    distinct = [f"word{i} stands with item{i * 7} and thing{i * 13} alone" for i in range(30)]
    for ids in ([None] * 30, [4] * 30, [None, 4] * 15):
        found = simhash_dedup.keep_one(documents(spark, distinct, ids).union(documents(spark, distinct, ids))).collect()
        # The texts share no run of five words: each of them stays, once.
        assert sorted(r.text for r in found) == sorted(distinct)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_dedup(spark, batches):
    texts = ["a", "b", "a", None, "", "a ", "b", "é", "x" * 200_000, "x" * 200_000]
    index = exact_dedup.new_index(spark, 100)
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(documents(spark, texts), index, batches=batches).collect()}
    for i, t in enumerate(texts):
        same = [k for k, u in enumerate(texts) if (u or "") == (t or "")]
        assert (found[i].keep_id, found[i].group_size, found[i].kept) == (max(same), len(same), i == max(same))
        assert found[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    # A later call, with the index opened anew: what it holds stays, whatever the new ids are.
    index.close()
    index = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    later = {r.doc_id: r for r in exact_dedup.exact_duplicates(documents(spark, ["b", "new", "new"], [10, 11, 12]), index, batches=batches).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in later.items()} == {10: (6, 1, False), 11: (12, 2, False), 12: (12, 2, True)}
    assert index.read().count() == len({t or "" for t in texts}) + 1
    assert index.compact(index.path + "-compact").read().exceptAll(index.read()).count() == 0


class Died(Exception):
    pass


def test_exact_dedup_is_safe_to_repeat(spark, monkeypatch):
    """A call that dies between ranges, and one that is done again after it has finished, keep every text once."""
    texts = [f"text {i % 10}" for i in range(20)]
    docs, index = documents(spark, texts), exact_dedup.new_index(spark, 20)
    exact_dedup.exact_duplicates(documents(spark, ["text 3"], [100]), index, run="before").collect()
    add, calls = exact_dedup.DigestIndex.add, []

    def dying(self, *args):
        if len(calls) == 1:
            raise Died
        calls.append(1)
        return add(self, *args)

    monkeypatch.setattr(exact_dedup.DigestIndex, "add", dying)
    with pytest.raises(Died):
        exact_dedup.exact_duplicates(docs, index, run="today")
    monkeypatch.undo()
    assert sorted(r.keep_id for r in index.read().collect()) == [100]
    kept = lambda run: sorted(r.doc_id for r in exact_dedup.exact_duplicates(docs, index, run=run).filter("kept").collect())
    want = [i for i in range(10, 20) if i != 13]
    assert kept("today") == want and kept("today") == want
    later = documents(spark, ["text 1", "own"], [200, 201])
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(later, index, run="later").collect()}
    assert found == {200: (11, False), 201: (201, True)}
    # The earlier run, once more: what it brought in first is still its own.
    assert kept("today") == want and kept(None) == []
    other = index.compact(index.path + "-compact")
    assert other.read().count() == index.read().count() == 11
    found = exact_dedup.exact_duplicates(later, other, run="later").filter("kept").collect()
    assert [r.doc_id for r in found] == [201]


def test_exact_dedup_null_and_repeated_ids(spark):
    docs = documents(spark, ["a", "a", "b", "b", "c", "c", None], [None, 3, None, None, 5, 5, 4]).withColumn("digest", F.lit("clash")).withColumn("keep_id", F.lit(0))
    found = sorted(((r.text_sha256, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, exact_dedup.new_index(spark, 10)).collect()), key=repr)
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "b", "c", "")}
    want = [(sha["a"], None, 3, 2, False), (sha["a"], 3, 3, 2, True), *[(sha["b"], None, None, 2, True)] * 2, *[(sha["c"], 5, 5, 2, True)] * 2, (sha[""], 4, 4, 1, True)]
    assert found == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(docs.limit(0), exact_dedup.new_index(spark, 0)).count() == 0


def test_exact_dedup_meets_an_index_with_rows_and_does_not_shuffle_it(spark):
    index = exact_dedup.new_index(spark, 10)
    exact_dedup.exact_duplicates(documents(spark, ["a", "b"]), index).count()
    new = spark.createDataFrame([(bytearray(b"x"), 1)], "digest binary, keep_id long")
    plan = index.lacking(new)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert index.read().count() == 2


def levenshtein_within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(texts, least):
    order = sorted(range(len(texts)), key=lambda i: i)
    seen, out = [], {}
    for i in order:
        if texts[i] is None:
            out[i] = None
            continue
        kept = []
        for line in texts[i].split("\n"):
            bare = line.strip(" \t\r\v\f")
            if not bare:
                kept.append(line)
                continue
            gone = any(bare == s or (len(bare) >= least and len(s) >= least and levenshtein_within_one(bare, s)) for s in seen)
            seen.append(bare)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def edited(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + "Z" + line[i:], line[:i] + "Q" + line[i + 1 :], line[:i] + "QQ" + line[i:]])


@pytest.mark.parametrize(("seed", "least"), [(1, 0), (2, 12)])
def test_line_dedup_matches_brute_force(spark, seed, least):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 7)) for _ in range(25)] + ["", "  ", "ab", "ac", "ñandú " * 5, "aaaaaaaaaaaaaaaaaaaaaaa"]
    texts = ODD + ["\n".join(rng.choice([x, x, " " + x + "\t", edited(rng, x) if x else x]) for x in rng.choices(base, k=rng.randint(1, 8))) for _ in range(60)]
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, texts), least_chars=least, log2_bits=16).collect()}
    assert found == brute_lines(texts, least)


def test_line_dedup_keeps_columns_and_repeated_rows(spark):
    docs = documents(spark, ["x y z\nnew", "x y z", "x y z"], [1, 2, 2]).withColumn("h1", F.lit("clash")).withColumn("places", F.lit(1))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "x y z\nnew"), (2, ""), (2, "")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_null_ids(spark):
    """Rows without an id come first, in the order of a hash of their texts; one of two such rows keeps the line."""
    docs = documents(spark, ["one line of text", "one line of text!\nown", "one line of text", None, ""], [None, None, 1, None, 2])
    found = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=repr)
    assert len(found) == 5 and (1, "") in found and (2, "") in found and (None, None) in found
    assert sum("one line" in (t or "") for _, t in found) == 1 and sum("own" in (t or "") for _, t in found) == 1


def brute_tiles(text, item, least):
    marked_t, marked_i, found = set(), set(), []
    while True:
        best = []
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in marked_i and t + n not in marked_t:
                    n += 1
                best.append((n, -i, -t))
        n, i, t = max(best, default=(0, 0, 0))
        if n < least:
            return found
        marked_i |= set(range(-i, -i + n))
        marked_t |= set(range(-t, -t + n))
        found.append((-t, -i, n))


@pytest.mark.parametrize("seed", range(15))
def test_tiles_match_brute_force(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([2, 5, 30])
    text = [rng.randrange(alphabet) for _ in range(rng.randint(0, 60))]
    item = [rng.randrange(alphabet) for _ in range(rng.randint(0, 20))]
    if text and item:
        text[5:5] = item[8:] + item[:8]
    for least in (2, 3, 5):
        got = decontaminate.tiles(np.array(text, dtype=np.uint64), np.array(item, dtype=np.uint64), least)
        assert got == brute_tiles(text, item, least)


def brute_matches(texts, items, least=5, threshold=0.5):
    out = []
    for i, text in enumerate(texts):
        for k, item in items:
            have, want = (text or "").lower().split(), (item or "").lower().split()
            if have and len(want) >= least:
                runs = brute_tiles(have, want, least)
                share = sum(n for *_, n in runs) / len(want)
                if share >= threshold:
                    out.append((i, k, round(share, 9), len(runs)))
    return sorted(out)


@pytest.mark.parametrize("bits", [26, 8])
def test_decontamination_catches_reordered_passages(spark, bits):
    """Also where nearly every seed passes the bit table."""
    rng = random.Random(9)
    items = [words(rng, n) + f" item{n}" for n in (30, 24, 3)]
    first = items[0].split()
    texts = ODD + [words(rng, 80), words(rng, 40) + " " + items[0].upper() + " " + words(rng, 5), " ".join(first[15:]) + " filler words here " + " ".join(first[:15]), "x " + " ".join(first[:9]), "pre " + items[2]]
    texts += ["a b c d e a b c d e a b c d e", (words(rng, 3000) + " " + items[1] + " ") * 2]
    docs = documents(spark, texts).withColumn("item", F.lit("clash")).withColumn("key", F.lit(0))
    bench = [*enumerate(items), (7, items[0]), (8, None), (9, ""), (10, "yes"), (11, "a b c d e a b c d e"), (12, "A b c d e a b c d e")]
    bench_df = spark.createDataFrame(bench, "item_id long, text string").withColumn("size", F.lit(0))
    want = brute_matches(texts, bench)
    found = decontaminate.matches(docs, bench_df, log2_bits=bits)
    assert sorted((r.doc_id, r.item_id, round(r.coverage, 9), r.n_tiles) for r in found.collect()) == want
    n = len(ODD)
    assert {(n + 1, 0), (n + 2, 0), (n + 2, 7), (n + 6, 1)} <= {w[:2] for w in want} and not any(w[1] == 10 or w[0] == n + 3 for w in want)
    kept = decontaminate.drop_contaminated(docs, bench_df, log2_bits=bits)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {w[0] for w in want})


def test_decontamination_null_and_repeated_ids_and_empty_tables(spark):
    passage = "one two three four five six seven eight"
    docs = documents(spark, [passage, passage, "clean words only", passage, None, None], [None, 4, 4, 4, 5, None])
    bench = spark.createDataFrame([(1, passage), (1, passage), (None, passage)], "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.matches(docs, bench).collect()]
    assert sorted(found, key=repr) == sorted([(d, i, 1.0) for d in (None, 4, 4) for i in (1, 1, None)], key=repr)
    assert sorted((r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, bench).filter("doc_id is not null").collect() if r.text) == [(4, "clean words only")]
    assert decontaminate.drop_contaminated(docs, bench).count() == 3
    for d, b in ((docs, bench.limit(0)), (docs.limit(0), bench)):
        assert decontaminate.matches(d, b).count() == 0
        assert decontaminate.drop_contaminated(d, b).count() == d.count()


def test_templates_make_no_pairs(spark):
    """A run of words that all items and all texts have: pairs come from the other seeds, and every match is found."""
    rng = random.Random(6)
    template = "which of the following is the best answer to this"
    own = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(30)) for _ in range(40)]
    items = [f"{template} {t}" for t in own]
    texts = [f"intro {template} " + words(rng, 60) for _ in range(60)] + [f"x {t} y" for t in own[:5]] + [f"{template} z {' '.join(t.split()[:24])}" for t in own[5:9]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    seeds = decontaminate.item_seeds(bench, 5).withColumn("item_key", F.col("item"))
    table = decontaminate.seed_table(seeds.select(F.explode("seeds").alias("seed")), 20)
    keyed = decontaminate._keyed(documents(spark, texts), "text")
    pairs = decontaminate.seed_pairs(decontaminate.seeded_texts(keyed, table, 5), seeds, 5, 0.5).count()
    assert pairs <= 3 * len(texts) < len(texts) * len(items) / 10
    found = decontaminate.matches(documents(spark, texts), bench, log2_bits=20)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(60 + i, i) for i in range(9)] == sorted((m[0], m[1]) for m in brute_matches(texts, list(enumerate(items))))
