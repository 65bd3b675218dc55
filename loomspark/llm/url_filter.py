"""URL verdicts: fixed host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import ascii_lower

#: Fixed values: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: Fixed values of the labelled table: words of unwanted sites (label 1), of wanted ones (0), and words of both.
UNWANTED = (
    "adult", "affiliate", "baccarat", "betting", "bingo", "blackjack", "bookmaker", "botnet", "camgirls", "casino", "clickbait", "cracked", "cryptodouble", "darkmarket", "dating",
    "erotic", "escort", "fakeid", "fetish", "forex", "gamble", "gambling", "giveaway", "hacked", "hookup", "jackpot", "keygen", "linkfarm", "loanshark", "lottery",
    "lotto", "malware", "milf", "nude", "onlinepharmacy", "payday", "phishing", "pills", "pirate", "poker", "popunder", "porn", "prizes", "ransom", "replica",
    "roulette", "scam", "seolinks", "sexy", "slots", "spam", "spyware", "steroids", "stripper", "sweepstake", "torrent", "tracker", "viagra", "wager", "warez", "webcam", "xanax", "xxx",
)
WANTED = (
    "academy", "archive", "astronomy", "atlas", "baking", "biology", "blog", "botany", "chemistry", "church", "city", "climate", "college", "cooking", "council",
    "court", "cycling", "dictionary", "docs", "economy", "engineering", "farm", "fishing", "forum", "garden", "geology", "government", "grammar", "hiking", "history",
    "hospital", "housing", "journal", "kitchen", "language", "law", "library", "literature", "maps", "mathematics", "medicine", "museum", "music", "nature", "news",
    "opera", "painting", "parliament", "physics", "poetry", "radio", "railway", "recipes", "research", "school", "science", "sports", "theatre", "travel", "university", "weather", "wiki", "winter",
)
BOTH = ("best", "club", "free", "games", "home", "live", "my", "new", "online", "page", "shop", "top", "web", "world")
STARTS = ("b", "br", "c", "ch", "cl", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pl", "qu", "r", "s", "sh", "st", "t", "th", "tr", "v", "w", "y", "z")
VOWELS = ("a", "e", "i", "o", "u", "ea", "io", "ou")
ENDS = ("", "n", "r", "s", "t", "l", "nd", "st", "th", "ck", "ng", "m", "d")
HOSTS = ("{w}.{t}", "www.{w}.{t}", "{w}{b}.{t}", "{b}-{w}.{t}", "{w}-{b}.{t}", "{w}{d}.{t}", "{n}-{w}.{t}", "{w}.{n}.{t}", "m.{b}{w}.{t}", "{n}.{t}")
ENDINGS = ("com", "net", "org", "info", "io", "co.uk", "de", "fr", "test", "example.com", "example.net", "example.org")
PATHS = ("", "/", "/index.html", "/{n}/{d}", "/{d}/", "/{b}/{d}.html", "/{n}-{b}?id={d}", "/en/{n}.php#top", "/a/{n}/{b}/{d}")
#: Addresses for a word; names that mean nothing (wanted too), and addresses for each.
EACH, NAMES, NAMED = 20, 600, 4


def labelled(spark: SparkSession, use=lambda word, number: True) -> DataFrame:
    """The labelled table: url, label; addresses made of words and of names that mean nothing, those that use(word,
    number of its address) takes.

    A word stands in the host, or in every tenth address in the path of a host that means nothing.
    """
    pick = lambda options, *key: options[zlib.crc32(repr(key).encode()) % len(options)]
    name = lambda *key: "".join(pick(part, key, i, j) for i in range(2) for j, part in enumerate((STARTS, VOWELS, ENDS)))
    words = [(w, 1.0, EACH) for w in UNWANTED] + [(w, 0.0, EACH) for w in WANTED] + [(name("name", i), 0.0, NAMED) for i in range(NAMES)]
    rows = []
    for at, (word, label, each) in enumerate(words):
        for i in (i for i in range(at, at + each) if use(word, i)):
            parts = {"w": word, "n": name(word, i), "b": pick(BOTH, word, i, "b"), "d": zlib.crc32(repr((word, i)).encode()) % 10 ** (1 + i % 5), "t": pick(ENDINGS, word, i, "t")}
            shape = HOSTS[i % len(HOSTS)]
            path = pick(PATHS, word, i, "path") if "{w}" in shape else "/{w}/{d}"
            rows.append((("http", "https")[i % 2] + "://" + (shape + path).format(**parts), label))
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES, verdict: bool = False) -> Column:
    """The longest rule that fits, or its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        own = (host == text[:at]) | host.endswith("." + text[:at])
        out = F.when(own & path.startswith(text[at:]), F.lit(what if verdict else text)).otherwise(out)
    return out


def grams(host: Column, path: Column, sizes=(3, 4)) -> Column:
    """The n-grams of host and path, marked with where they are from; digits are one character."""

    def of(c: Column, mark: str, n: int) -> Column:
        c = F.concat(F.lit("^"), F.regexp_replace(c, "[0-9]+", "0"), F.lit("$"))
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(c, i, F.lit(n))))).otherwise(F.array(F.concat(F.lit(mark), c)))

    return reduce(lambda a, b: F.concat(a, b), [of(c, mark, n) for c, mark in ((host, "h"), (path, "p")) for n in sizes])


class UrlFilter:
    """A fitted filter; labelled: url and label (1: unwanted)."""

    def __init__(self, labelled: DataFrame, dims: int = 1 << 16, at: float = 0.5, rules=RULES, reg: float = 0.001):
        self.rules, self.at = rules, at
        self.hashing = HashingTF(inputCol="__loom_grams", outputCol="__loom_features", numFeatures=dims, binary=True)
        self.model = LogisticRegression(featuresCol="__loom_features", labelCol="label", probabilityCol="__loom_probability", rawPredictionCol="__loom_raw", predictionCol="__loom_predicted", regParam=reg, maxIter=40, standardization=False).fit(self._features(labelled))

    def _features(self, df: DataFrame) -> DataFrame:
        return self.hashing.transform(df.withColumn("__loom_grams", grams(host(F.col("url")), path(F.col("url")))))

    def judge(self, pages: DataFrame) -> DataFrame:
        """pages with host, path, rule, score (0 to 1, higher: unwanted) and verdict.

        A null url, or one without "://", has empty host and path, fits no rule and is judged by the model as such.
        Repeated rows are judged each; no rows give no rows; other columns pass through, and columns of pages that have
        the names of the results are replaced. No row is shuffled.
        """
        out = self.model.transform(self._features(pages.drop("host", "path", "rule", "score", "verdict", "__loom_grams", "__loom_features", "__loom_probability", "__loom_raw", "__loom_predicted")))
        out = out.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "score": vector_to_array("__loom_probability")[1]})
        out = out.withColumn("rule", rule(F.col("host"), F.col("path"), self.rules)).drop("__loom_grams", "__loom_features", "__loom_probability", "__loom_raw", "__loom_predicted")
        return out.withColumn("verdict", F.coalesce(rule(F.col("host"), F.col("path"), self.rules, verdict=True), F.when(F.col("score") >= self.at, "block").otherwise("allow")))
