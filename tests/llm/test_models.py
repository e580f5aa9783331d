"""Classifiers: held-out accuracy, exact inference, bounds."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import language, quality, queries, url_filter
from tidewater.llm.common import byte_view

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_held_out_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.judge(docs, labels).join(labels, "doc_id").filter("held_out")
    good, n = found.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 50 and good / n >= 0.97
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_quality_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a\n\nb"), (4, "x" * 100_000), (4, "\n\n")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.judge(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert quality.keep_good(docs, quality.learn(docs, labels), 0.0).count() == 5
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_ties_extra_columns_and_long_documents(spark):
    """A text at the threshold is good; long documents are learned from, too; columns of other names and types change nothing."""
    bad, good = "!!! ### ***\n" * 900, "A plain line of words that says a thing.\n" * 900
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert np.abs(model.weights).sum() > 1
    rows = quality.judge(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)
    clash = docs.withColumns({"score": F.lit("x"), "quality": F.lit(5), "features": F.lit(1), "turn": F.lit(2)})
    assert sorted(quality.judge(clash, labels).collect()) == sorted(rows)
    at = rows[0].score
    assert quality.keep_good(docs.filter(F.col("doc_id") == rows[0].doc_id), model, at).count() == 1
    assert quality.keep_good(clash, model).columns == clash.columns


def test_document_scores_are_length_weighted_marginals():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    features, length, lines = quality.line_features(*byte_view(pa.array(["one\ntwo words\n\nTHREE!", "", "x" * 50])))
    got, at = quality.document_scores(model, features, length, lines), 0
    for k, n in enumerate(lines):
        scores = features[at : at + n] @ model.weights
        total, by_line = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(scores[i, s] for i, s in enumerate(path)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(path)))
            total += w
            by_line += w * np.array(path)
        weight = length[at : at + n] + 1
        assert math.isclose(got[k], float((by_line / total * weight).sum() / weight.sum()))
        at += n


def test_line_features_by_hand():
    features, length, lines = quality.line_features(*byte_view(pa.array(["AB cd 12.\nx | |\n"])))
    assert lines.tolist() == [2] and length.tolist() == [10, 6]
    own = features[:, : quality._N_OWN]
    assert np.allclose(own[0, 1:5], [0.5, 0.4, 0.2, 0.0]) and math.isclose(own[0, 0], math.log1p(10) / 8)
    assert np.allclose(own[1, [4, 7, 9]], [2 / 6, 2 / 3, 1 / 3])  # three words
    assert np.allclose(features[0, 2 * quality._N_OWN : 3 * quality._N_OWN], own[1]) and np.allclose(features[1, quality._N_OWN : 2 * quality._N_OWN], own[0])


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 5, 2])
    scores, transitions = rng.normal(size=(lines.sum(), 2)), rng.normal(size=(2, 2))
    states, pairs, log_z = quality.marginals(scores, lines, transitions)
    want_pairs, at = np.zeros((2, 2)), 0
    for k, n in enumerate(lines):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weights[path] = math.exp(sum(scores[at + i, s] for i, s in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
        z = sum(weights.values())
        assert math.isclose(math.log(z), log_z[k])
        for i in range(n):
            assert math.isclose(sum(w for p, w in weights.items() if p[i] == 1) / z, states[at + i, 1])
        for p, w in weights.items():
            for a, b in itertools.pairwise(p):
                want_pairs[a, b] += w / z
        at += n
    assert np.allclose(pairs, want_pairs)


def test_line_features_do_not_depend_on_neighbouring_documents():
    texts = ["One line.\nTWO!! LINES!!", "", "a | b |\n\nc c c", "é ü\n"]
    both = quality.line_features(*byte_view(pa.array(texts)))
    alone = [quality.line_features(*byte_view(pa.array([t]))) for t in texts]
    assert np.allclose(both[0], np.concatenate([a[0] for a in alone]))
    assert both[2].tolist() == [2, 1, 3, 1]


def test_language_held_out_accuracy(docs):
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    good, n = found.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 200 and good / n >= 0.97


def test_language_backs_off_and_gives_und(spark):
    rng = random.Random(1)
    train = [(i, " ".join(rng.choice(["the house", "red thing", "other than"]) for _ in range(9)), "en") for i in range(0, 60)]
    train += [(i, " ".join(rng.choice(["der großen", "schöne straße", "über nacht"]) for _ in range(9)), "de") for i in range(60, 120)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "grüßend", None), (1004, "THETHE", None), (1004, "THETHE", None), (None, "other", None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003].lang_pred == "de" and found[1004].lang_pred == "en" and found[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in found.values())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


def test_language_takes_five_grams_before_shorter_ones(spark):
    """The unseen word shares one run of five letters with a German word and many shorter runs with English words."""
    train = [(i, "abcde", "de") for i in range(12)] + [(i, "zabcd zbcde qabcd qbcde rabcd rbcde", "en") for i in range(100, 112)]
    docs = spark.createDataFrame([*train, (1000, "xabcdex", None)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert "abcde" in model.grams[4] and "xabcdex" not in model.words
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model=model).collect()}[1000] == "de"


def brute_language(train, texts, longest=5, least=2, smoothing=0.5):
    """Counts, back-off and scoring in plain Python, from the description alone."""
    import regex

    counts, langs = {}, sorted({lang for _, lang in train})
    for text, lang in train:
        for w in regex.findall(r"\p{L}+", (text or "").lower()):
            items = [(0, w)] + [(k, s[i : i + k]) for k in range(1, longest + 1) for s in [w if k == 1 else f"^{w}$"] for i in range(len(s) - k + 1)]
            for item in items:
                counts.setdefault(item, dict.fromkeys(langs, 0))[lang] += 1
    known = {i: c for i, c in counts.items() if sum(c.values()) >= least}
    total = {(k, lang): sum(c[lang] for (kind, _), c in known.items() if kind == k) for k in range(longest + 1) for lang in langs}
    size = {k: sum(kind == k for kind, _ in known) + 1 for k in range(longest + 1)}
    log = lambda item: [math.log((known[item][lang] + smoothing) / (total[item[0], lang] + smoothing * size[item[0]])) for lang in langs]

    def word(w):
        if (0, w) in known:
            return log((0, w))
        for k in range(longest, 0, -1):
            s = w if k == 1 else f"^{w}$"
            seen = [log((k, s[i : i + k])) for i in range(len(s) - k + 1) if (k, s[i : i + k]) in known]
            if seen:
                return [sum(c) / len(seen) for c in zip(*seen, strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        found = [word(w) for w in regex.findall(r"\p{L}+", (text or "").lower())]
        if not found:
            out.append(("und", 0.0))
            continue
        mean = [sum(c) / len(found) for c in zip(*found, strict=True)]
        best = max(range(len(langs)), key=lambda i: (mean[i], -i))
        out.append((langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)))
    return out


def test_language_matches_brute_force(spark):
    rng = random.Random(8)
    pools = {"en": "the house red thing other than sailing", "de": "der große haus über nacht anders segel", "da": "det røde hus andet end sejl natten"}
    train = [(" ".join(rng.choices(pools[lang].split(), k=rng.randint(1, 9))), lang) for _ in range(40) for lang in pools]
    odd = [None, "", "12 ?!", "hous", "zzz", "Ærø ROTE thing", "the det der", "segeln " * 30_000, "qqq the", "x"]
    texts = [t for t, _ in train] + odd
    docs = spark.createDataFrame([(i, t, train[i][1] if i < len(train) else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = docs.withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1), "item": F.lit("x"), "n": F.lit(2)})
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model=language.learn(docs, held_out_remainder=-1)).collect()}
    want = brute_language(train, texts)
    assert [found[i][0] for i in range(len(texts))] == [w[0] for w in want]
    assert np.allclose([found[i][1] for i in range(len(texts))], [w[1] for w in want])


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "same words", lang) for i, lang in enumerate(["no", "fo"] * 20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(docs, model=language.learn(docs, held_out_remainder=-1)).collect()} == {"fo"}


def test_language_sample_takes_up_to_two_thousand_documents(spark):
    """Each word stands in three documents, as few as the model asks for: all words are known if all documents are taken."""
    docs = spark.range(1800).selectExpr("id AS doc_id", "translate(string(id % 600), '0123456789', 'abcdefghij') AS text", "'en' AS lang")
    assert len(language.learn(docs, held_out_remainder=-1).words) == 600


def test_words_of_matches_regex():
    texts = ["Ab-cd  éF\n", None, "", "x1y", " ñ", "12"]
    import regex

    words, n = language.words_of(pa.array(texts))
    want = [regex.findall(r"\p{L}+", (t or "").lower()) for t in texts]
    assert n.tolist() == [len(w) for w in want] and words.to_pylist() == sum(want, [])


URLS = [
    None, "", "no-scheme.org/x", "http://a.org/x?y", "https://A.Example.ORG/es/9", "http://example.org/es", "http://example.org/en/1", "http://example.org/en/12", "http://notexample.org/es/1",
    "http://site.com/fr/x", "http://site.com/de/x", "http://site.com/frx", "http://x.org", "http://x.org#/a", "http://www.casino-win.example.net/en/5", "http://hering.example.net/en/5", "ftp://://a.com/fr/",
]


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in url_filter.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


def test_url_rules_and_model(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge(pages, url_filter.labelled_urls(spark)).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute_url(url)
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert found[14].verdict == "block" and found[15].verdict == "allow"


def test_url_model_separates_its_labels(spark):
    t = url_filter.labelled_urls(spark)
    weights = url_filter.train(t, url_filter.Training())
    p = t.withColumn("p", url_filter.score(F.col("host"), F.col("path"), weights, url_filter.Training()))
    assert p.filter((F.col("p") >= 0.5).cast("int") != F.col("label")).count() == 0


def test_url_model_on_names_that_its_table_lacks(spark):
    blocked = "casino-royal cheap-loans sex-cams bets-online free-pills spam-ads porn-tube win-slots poker-bets click-farm gambling-site hot-xxx".split()
    allowed = "bookshop dentist zoo city-hall recipes orchestra physics poetry bicycle archive charity botany".split()
    assert not {*blocked, *allowed} & {*url_filter.BLOCKED_NAMES, *url_filter.ALLOWED_NAMES}
    rows = [(f"{p}{n}.{d}", path, int(n in blocked)) for n in blocked + allowed for p in ("", "www.", "shop.") for d in ("example.com", "example.net", "mysite.info") for path in ("/en/7", "/a/b.html")]
    weights = url_filter.train(url_filter.labelled_urls(spark), url_filter.Training())
    p = spark.createDataFrame(rows, "host string, path string, label int").withColumn("p", url_filter.score(F.col("host"), F.col("path"), weights, url_filter.Training()))
    right = {r["label"]: r["share"] for r in p.groupBy("label").agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("int")).alias("share")).collect()}
    assert right[0] >= 0.75 and right[1] >= 0.75


def test_url_edge_cases(spark):
    """Empty table, repeated rows, a very long URL, columns of the names that the operator makes."""
    long = "http://host.example/" + "a/" * 50_000
    pages = spark.createDataFrame([(1, long, 7, "x"), (1, long, 7, "x"), (2, None, 8, "y"), (None, "HTTP://A.ORG", 9, "z")], "page_id long, url string, host int, verdict string")
    found = url_filter.judge(pages, url_filter.labelled_urls(spark)).collect()
    assert len(found) == 4 and {r.verdict for r in found} <= {"allow", "block"}
    assert {(r.host, r.path) for r in found} == {("host.example", long[19:]), ("", ""), ("a.org", "")}
    assert url_filter.judge(pages.limit(0), url_filter.labelled_urls(spark)).count() == 0


def test_url_plan_has_no_python(spark):
    plan = queries.op2_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_url_filter_leaves_other_columns_alone(spark):
    """Columns of any name stay, but for those that the operator gives; the url may have any name."""
    pages = spark.createDataFrame([(1, "http://news.example.com/en/1", 7, "u")], "page_id int, address string, _by_rule int, url string")
    row = url_filter.judge(pages, url_filter.labelled_urls(spark), url_col="address").first()
    assert (row["_by_rule"], row["url"], row["address"], row["host"]) == (7, "u", "http://news.example.com/en/1", "news.example.com")
