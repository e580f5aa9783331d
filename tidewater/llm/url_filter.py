"""URL rules, and logistic regression on hashed character n-grams for the URLs that no rule fits.

Everything is DataFrame functions: training, too, is one expression over the small labelled table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import spare_name

#: Rules of the production list: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The labelled table: names of hosts to block (1) and to allow (0). Written by hand for this library, from general words.
BLOCKED_NAMES = (
    "casino", "casino-win", "cheap-pills", "free-bets", "spam-farm", "adult-x", "ads-track", "xxx-tube", "porn-hub", "win-prize", "bet-now", "poker-chips",
    "viagra-shop", "click-ads", "track-pixel", "free-loans", "adult-cams", "spam-links", "pills-online", "slots-win", "lottery-win", "jackpot", "payday-loan", "escort-girls",
    "hot-singles", "sexy-chat", "warez-crack", "keygen-free", "torrent-porn", "fake-watches", "replica-bags", "weight-loss-pills", "miracle-cure", "crypto-doubler", "get-rich-quick", "clickbait",
    "popup-ads", "adserver", "phishing-login", "malware-download",
)
ALLOWED_NAMES = (
    "news", "library", "weather", "museum", "cooking", "garden", "history", "school", "travel", "science", "theatre", "river",
    "mountain", "music", "bakery", "railway", "hospital", "football", "painting", "university", "forest", "planet", "language", "teacher",
    "chemistry", "market", "parliament", "village", "harbour", "sailing", "fishing", "birds", "insects", "horses", "kitchen", "bread",
    "cheese", "coffee", "health", "doctor", "nursing", "law", "court", "council", "budget", "economy", "energy", "water",
    "bridge", "tunnel", "airport", "station", "tickets", "hotel", "camping", "hiking", "cycling", "running", "tennis", "chess",
    "puzzle", "novel", "author", "drama", "cinema", "camera", "design", "furniture", "textile", "pottery", "jewel", "church",
    "temple", "festival", "children", "family", "wedding", "memory", "letters", "stamps", "maps",
)
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.net", "example.org", "site.com", "place.net")
PATHS = ("/en/12", "/de/345.html", "/fr/6", "/es/78/", "/")


@dataclass(frozen=True)
class Training:
    buckets: int = 1024
    gram: int = 3
    rounds: int = 60
    rate: float = 4.0


def labelled_rows() -> list[tuple[str, str, int]]:
    """Host, path, label (1: block): each name twice, under a prefix, domain and path of its own turn."""
    rows = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for j in range(2 * len(names)):
            rows.append((f"{PREFIXES[j % 4]}{names[j // 2]}.{DOMAINS[j % 5]}", PATHS[(j + j % 2) % 5], label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table as ``host``, ``path``, ``label``."""
    rows = ", ".join(f"('{host}', '{path}', {label})" for host, path, label in labelled_rows())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, label)")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def gram_buckets(text: Column, training: Training) -> Column:
    """Distinct buckets of the character n-grams of a text; a shorter text has none."""
    k = training.gram
    # One pass cuts the text into characters; ``array(x)`` binds their codes to a name, so that each gram looks its characters up in place.
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    grams = F.get(F.transform(F.array(codes), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: _hash(c, i, training))), F.lit(0))
    return F.when(F.length(text) >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<int>"))


def _hash(codes: Column, at: Column, training: Training) -> Column:
    """The positional hash uses code points, so that any SQL engine computes the same buckets."""
    total = F.lit(0)
    for j in range(training.gram):
        total = total * 31 + F.get(codes, at + j)
    return F.pmod(total, F.lit(training.buckets)).cast("int")


def _features(host: Column, path: Column, training: Training) -> Column:
    return gram_buckets(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), training)


def train(labelled: DataFrame, training: Training) -> list[float]:
    """Weights by bucket, the bias last. ``labelled`` is small by contract; it is gathered into one row.

    Batch gradient descent: each round scores all rows with the weights so far and steps along the mean error.
    """
    d = training.buckets
    rows = labelled.select(F.struct(_features(F.col("host"), F.col("path"), training).alias("x"), F.col("label").cast("double").alias("y")).alias("row"))
    data = rows.agg(F.sort_array(F.collect_list("row")).alias("data")).select("data", F.size("data").cast("double").alias("n"))
    who = f"transform(sequence(0, {d - 1}), b -> filter(transform(data, (r, i) -> if(array_contains(r.x, b), i, -1)), i -> i >= 0))"
    data = data.select("data", "n", F.expr(who).alias("who"))
    # aggregate(array(x), ...) binds x to a name: the errors of a round, computed once.
    errors = f"transform(data, r -> 1D / (1D + exp(-(aggregate(r.x, w[{d}], (s, b) -> s + w[b])))) - r.y)"
    update = f"""
        aggregate(sequence(1, {training.rounds}), array_repeat(0D, {d + 1}), (w, t) ->
          aggregate(array({errors}), w, (u, e) -> concat(
            zip_with(slice(w, 1, {d}), who, (v, rows) -> v - {training.rate}D / n * aggregate(rows, 0D, (s, i) -> s + e[i])),
            array(w[{d}] - {training.rate}D / n * aggregate(e, 0D, (s, x) -> s + x)))))"""
    return list(data.select(F.expr(update).alias("w")).first()["w"])


def score(host: Column, path: Column, weights: list[float], training: Training) -> Column:
    """Probability that a URL is to be blocked."""
    known = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate(_features(host, path, training), F.lit(float(weights[training.buckets])), lambda s, b: s + F.get(known, b))
    return 1.0 / (1.0 + F.exp(-total))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does.

    A rule fits its host and all its subdomains, if the path starts with the rule's path. Of equally long
    rules the first in the list wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        cut = text.find("/") if "/" in text else len(text)
        fits = ((host == text[:cut]) | host.endswith("." + text[:cut])) & path.startswith(text[cut:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules=RULES, training: Training = Training(), threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_score`` and ``verdict``; one row per row.

    Null URLs and those without ``://`` have an empty host and path; they fit no rule, and the model judges them like
    any other. Ties at the threshold are blocked. Columns of ``pages`` with one of the new names are replaced.
    """
    weights = train(labelled, training)
    host, path = split_url(F.col(url_col))
    by_rule = spare_name(pages, "_by_rule")
    split = pages.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    scored = split.withColumns({"rule": rule, "block_score": score(F.col("host"), F.col("path"), weights, training), by_rule: verdict})
    by_model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(by_rule, by_model)).drop(by_rule)
