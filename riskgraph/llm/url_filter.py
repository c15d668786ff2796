"""URL filters: allow and block rules first, gradient-boosted trees for the rest.

A rule is a host and a path prefix; it fits its host and all subdomains.  The trees see lexical
features only - length, depth, digit ratio, entropy, parameter counts, and how often URLs of the
same host suffix are blocked - and learn from the URLs that rules decide: at most ``TRAIN_ROWS``
different ones, those with the smallest hashes, each weighted by the number of its rows.  The suffix
statistics are counted over all labelled rows.

Edge cases: a null URL, or one without ``://``, has the empty host and path, fits no rule and is
judged by the trees on its text; without labelled URLs the verdict is ``allow``, with labels of
one kind it is that kind; repeated rows each get their result and only add to the weight of their URL
in the sample; URLs of any length are judged whole; a score of 0.5 (a tie) blocks; an empty table gives
no rows; columns other than the id and the URL are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import read
from riskgraph.plans.lineage import cut

TRAIN_ROWS = 20_000
TREES = 12
DEPTH = 4


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

FEATURES = (
    "n_url", "n_host", "n_path", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "entropy",
    "parameters", "n_query", "has_fragment", "escapes", "longest_segment", "suffix_rate", "pair_rate",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, large, small), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # later ones, which are longer, win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def entropy(s: Column) -> Column:
    """Bits per character: one count per distinct character."""
    n = F.length(s)

    def part(acc, c):
        p = (n - F.length(F.replace(s, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    return F.aggregate(chars, F.lit(0.0), part)


def lexical(pages: DataFrame, *more: str) -> DataFrame:
    """``page_id, host, path, rule, ruled``, the columns ``more`` and the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_of(url), path_of(url)
    df = pages.select("page_id", url.alias("u"), host.alias("host"), path.alias("path"), *more)
    rule, verdict = matched(F.col("host"), F.col("path"))
    u, h, p = F.col("u"), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    return df.select(
        "page_id", "u", "host", "path", *more, rule.alias("rule"), verdict.alias("ruled"),
        F.substring_index(h, ".", -1).alias("suffix"), F.substring_index(h, ".", -2).alias("pair"),
        F.length(u).alias("n_url"), F.length(h).alias("n_host"), F.length(p).alias("n_path"),
        (F.length(p) - F.length(F.translate(p, "/", ""))).alias("depth"),
        (F.length(h) - F.length(F.translate(h, ".", ""))).alias("labels"),
        (F.length(h) - F.length(F.translate(h, "-", ""))).alias("hyphens"),
        (digits / F.greatest(F.length(u), F.lit(1))).alias("digit_ratio"),
        F.length(F.regexp_replace(h, "[^0-9]", "")).alias("host_digits"),
        F.coalesce(entropy(u), F.lit(0.0)).alias("entropy"),
        F.when(query != "", 1 + F.length(query) - F.length(F.translate(query, "&", ""))).otherwise(0).alias("parameters"),
        F.length(query).alias("n_query"), u.contains("#").cast("int").alias("has_fragment"),
        (F.length(u) - F.length(F.translate(u, "%", ""))).alias("escapes"),
        F.array_max(F.transform(F.split(p, "/"), F.length)).alias("longest_segment"))


def _rate(blocked: Column, n: Column, prior: float) -> Column:
    return (F.coalesce(blocked, F.lit(0)) + 4 * prior) / (F.coalesce(n, F.lit(0)) + 4)


def with_rates(df: DataFrame, labelled: DataFrame, prior: float) -> DataFrame:
    """Adds the smoothed share of blocked URLs among the labelled ones of the same suffixes."""
    for name, key in (("suffix_rate", "suffix"), ("pair_rate", "pair")):
        seen = labelled.groupBy(F.col(key).alias("_k")).agg(
            F.sum("label").alias("_b"), F.count(F.lit(1)).alias("_n"))
        df = df.join(seen, df[key] == seen["_k"], "left").withColumn(
            name, _rate(F.col("_b"), F.col("_n"), prior)).drop("_k", "_b", "_n")
    return df


def training_urls(labelled: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` different labelled URLs by their hash, with ``label``, ``copies`` and the features.

    The estimated number of different URLs thins them before rows of the same URL are added up; twice the
    share asked for is let through, so that only an estimate off by half would leave fewer than there are.
    """
    about = labelled.agg(F.approx_count_distinct("u")).first()[0]
    share = min(1.0, 2 * rows / max(about, 1))
    h = F.xxhash64("u")
    thinned = labelled.filter(F.pmod(h, F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    urls = thinned.groupBy("u").agg(F.count(F.lit(1)).cast("double").alias("copies"), F.min("label").alias("label"))
    kept = cut(urls.orderBy(F.pmod(h, F.lit(1 << 20)), h, "u").limit(rows), "url_sample")
    return lexical(kept.select(F.lit(None).cast("long").alias("page_id"), F.col("u").alias("url"), "copies", "label"),
                   "copies", "label")


def judge(pages: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; the score is the trees' chance of a block."""
    rows = lexical(pages)
    labelled = rows.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or blocked in (0, n):
        score = rows.withColumn("score", F.lit(1.0 if n and blocked == n else 0.0))
    else:
        prior = blocked / n
        train = cut(with_rates(training_urls(labelled, train_rows), labelled, prior).select(
            "label", "copies", *FEATURES).coalesce(4), "url_train")
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=42, stepSize=0.3, weightCol="copies").fit(
            vector.transform(train.coalesce(2)).select("label", "copies", "features"))
        told = model.transform(vector.transform(with_rates(rows, labelled, prior)))
        score = told.withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return score.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op10_url_filter(spark, sf_dir) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).drop("score")
