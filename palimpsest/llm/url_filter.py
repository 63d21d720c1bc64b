"""URL filters: domain rules, then logistic regression on hashed character n-grams. Native operations only.

A url's host runs from after the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lowered; its
path from there to ``?``, ``#`` or the end. Null urls and those without ``://`` have both empty. The longest
rule that fits decides (host or subdomain, beginning of the path); where none does, the model.

The model is fitted on a small labelled url table (its size is checked). Features are character n-grams of
host and path, hashed to ``2^BITS`` cells, each counted once per url; the weights, one number per cell whatever
the data, become one constant array, so that scoring is a projection without shuffle or join.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import fold

BITS = 12
SIZES = (3, 4, 5)
MAX_LABELS = 10_000

#: Rules (verdict, host and path beginning).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled urls that the default model is fitted on: words of unwanted and of ordinary addresses.
BAD = ("spam farm", "cheap pills", "casino bonus", "free viagra", "best poker", "win lottery", "adult cams", "hot singles",
       "payday loans", "replica watches", "click ads", "crypto doubler", "slots jackpot", "xxx videos", "warez cracks",
       "seo links", "pills online", "spam links", "cheap replica", "casino win", "free bets", "adult x", "ads track")
GOOD = ("blog", "news", "science", "library", "museum", "weather", "travel", "kitchen", "garden", "history", "music", "school",
        "university", "health", "city", "forum", "docs", "wiki", "archive", "review", "market", "design", "finance", "theatre", "farm",
        "photo", "bakery", "river", "mountain", "village", "tools", "papers")
#: Hosts that tell nothing, and words of ordinary paths, for rows whose path decides.
NEUTRAL = ("site", "page", "host", "server", "portal", "domain", "place", "node", "local", "main", "some-name", "first-page", "my-home", "the-net")
PAGES = ("about", "contact", "article", "articles", "news", "history", "music", "garden chairs", "install", "docs", "index.html", "search", "category",
         "products", "shop", "help", "terms", "privacy", "archive", "events", "people", "research", "report", "map", "recipes", "apply", "login", "download")


def labelled(spark: SparkSession) -> DataFrame:
    """``(url, label)``: the small table for training, 1 is unwanted. First rows whose host decides: each host
    comes with the same ends and paths on both sides, so that neither tells anything. Then rows whose path
    decides, on neutral and on ordinary hosts, which come with the same ends on both sides too. An unwanted
    host stays unwanted whatever its path."""
    rows, ends = [], (("", "com"), ("www.", "org"), ("m.", "net"), ("blog.", "example.com"), ("", "example.org"), ("www.", "example.net"))
    for words, label in ((BAD, 1), (GOOD, 0)):
        for i, w in enumerate(words):
            for k, (front, end) in enumerate(ends):
                lang, page = ("en", "de", "fr", "es")[(i + k) % 4], 7 * i + 131 * k
                rows.append((f"https://{front}{w.replace(' ', '-')}.{end}/{lang}/{page}", label))
    for words, label in ((BAD, 1), (PAGES, 0)):
        for i, w in enumerate(words):
            for k, (front, end) in enumerate(ends):
                lang, page, name = ("en", "de", "fr", "es")[(i + k) % 4], 7 * i + 131 * k, w.replace(" ", "-_"[k % 2])
                way = (f"/{name}", f"/{lang}/{name}/{page}", f"/{PAGES[(5 * i + k) % len(PAGES)].replace(' ', '-')}/{name}", f"/{lang}/{name}.html", f"/{name}/{page}", f"/{lang}/{name}")[k]
                for hosts in (NEUTRAL, GOOD):
                    rows.append((f"https://{front}{hosts[(i + 3 * k) % len(hosts)]}.{end}{way}", label))
    for i, w in enumerate(BAD):
        for k, (front, end) in enumerate(ends[:3]):
            rows.append((f"https://{front}{w.replace(' ', '-')}.{end}/{PAGES[(i + 7 * k) % len(PAGES)].replace(' ', '-')}", 1))
    for i, w in enumerate(NEUTRAL):
        for k, (front, end) in enumerate(ends):
            rows.append((f"https://{front}{w}.{end}/{('en', 'de', 'fr', 'es')[(i + k) % 4]}/{7 * i + 131 * k}", 0))
    return spark.createDataFrame(rows, "url string, label int")


def host(url: Column) -> Column:
    return fold(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """``struct(verdict, rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def cells(host_: Column, path_: Column, bits: int = BITS) -> Column:
    """Distinct cells of the character n-grams of host and path, marked by where they come from."""
    def grams(text: Column, mark: str, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(text, i, F.lit(n))), F.lit(1 << bits)).cast("int"))

    framed = {"h": F.concat(F.lit("^"), host_, F.lit("$")), "p": F.concat(F.lit("^"), path_)}
    return F.array_distinct(F.concat(*[grams(t, m, n) for m, t in framed.items() for n in SIZES]))


def fit(labels: DataFrame, bits: int = BITS, l2: float = 0.003) -> tuple[float, list[float]]:
    """Intercept and weights per cell; ``labels`` holds at most MAX_LABELS rows ``(url, label)``."""
    labels = labels.where("url is not null and label is not null")
    if labels.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labelled urls")
    own = cells(host(F.col("url")), path(F.col("url")), bits)
    to_vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(1 << bits)], inputCol="cells", outputCol="features")
    rows = labels.select(F.col("label").cast("double").alias("label"), own.cast("array<string>").alias("cells")).coalesce(1)
    model = LogisticRegression(regParam=l2, maxIter=60, standardization=False).fit(to_vector.transform(rows).select("label", "features"))
    return float(model.intercept), [float(w) for w in model.coefficients]


def probability(host_: Column, path_: Column, intercept: float, weights: list[float], bits: int = BITS) -> Column:
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # folded to one constant
    score = F.aggregate(cells(host_, path_, bits), F.lit(intercept), lambda total, c: total + F.get(table, c))
    return 1 / (1 + F.exp(-score))


def verdicts(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, cut: float = 0.5, url: str = "url") -> DataFrame:
    """The table with ``host``, ``path``, ``rule`` (null without one), ``verdict`` (allow or block) and
    ``p_block``, the model's probability, without the url; such columns of the input are replaced.

    Every row is judged, repeated ones and null urls too (their empty host and path go to the model). Model
    values depend on the url alone, so equal urls are judged alike."""
    added = ("host", "path", "rule", "verdict", "p_block")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (*added, url)]
    intercept, weights = fit(labelled(pages.sparkSession) if labels is None else labels)
    parts = pages.select(*kept, host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    judged = parts.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("p_block", probability(F.col("host"), F.col("path"), intercept, weights))
    by_model = F.when(F.col("p_block") >= cut, "block").otherwise("allow")
    return judged.select(*kept, "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", by_model).alias("verdict"), "p_block")
