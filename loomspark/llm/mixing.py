"""Mixing sources to target weights by budgets of words, cut exactly in a random order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._common import SPACED_WORD, hash_range, n_ranges, written

#: The weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often.
MOST_EPOCHS = 3


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (no, key, source_size) with weight and target (double): shares of the total, filled up to most times each size.

    A water level is raised until no share is above its source's limit; every round is one aggregate, and the driver
    sees three sums. The order of sources is by code point, nulls last.
    """
    rank = F.row_number().over(Window.orderBy("no", "key")) - 1
    table = written(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")).withColumn("most", F.col("source_size") * float(most)), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = float("inf"), -1
    first = table.agg(F.sum("weight")).first()[0] or 0.0
    level = total / first if first else 0.0
    while True:
        above = F.col("weight") * level > F.col("most")
        full, open_, n = table.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.sum(above.cast("int"))).first()
        if n is None or n == capped or n == 0 or not open_:
            break
        level, capped = (total - full) / open_, n
    return table.withColumn("target", F.least("most", F.col("weight") * level)).drop("most")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """docs with size, source_size, target (of its source), taken (words, repeats counted).

    Each source goes through its documents in the order of a hash of doc_id, as often as its target holds its size,
    and then up to the word at which the target is met, so the document there gives only its first words. Prefix sums
    are distributed: sums within ranges of the hash, and sums over the ranges. Null text has size 0; a null source is
    one more source, the last; rows with equal doc_id stand side by side in the order, each with its own size; no rows
    give no rows; other columns pass through. Columns of docs with the names of the results are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    n = docs.count()
    sized = docs.withColumns({"size": words(F.col("text")), "__loom_no": F.col("source").isNull(), "__loom_source": F.coalesce("source", F.lit("")), "__loom_key": F.xxhash64("doc_id", F.lit(seed))})
    sized = sized.withColumn("__loom_range", hash_range(F.col("__loom_key"), n_ranges(n)))
    cols = ["__loom_no", "__loom_source", "__loom_range"]
    ranges = written(sized.groupBy(*cols).agg(F.sum("size").alias("__loom_words")), "ranges")
    sources = targets(ranges.groupBy(F.col("__loom_no").alias("no"), F.col("__loom_source").alias("key")).agg(F.sum("__loom_words").alias("source_size")), weights, most)
    before = ranges.withColumn("__loom_before", F.coalesce(F.sum("__loom_words").over(Window.partitionBy("__loom_no", "__loom_source").orderBy("__loom_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__loom_words")
    known = before.join(sources.withColumnsRenamed({"no": "__loom_no", "key": "__loom_source"}), ["__loom_no", "__loom_source"]).drop("weight")
    within = F.coalesce(F.sum("size").over(Window.partitionBy(*cols).orderBy("__loom_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = sized.withColumn("__loom_within", within).join(known, cols).withColumn("__loom_epochs", epochs)
    rest = F.round(F.col("target") - F.col("__loom_epochs") * F.col("source_size")).cast("long")
    taken = F.col("__loom_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__loom_before") - F.col("__loom_within")))
    return out.withColumn("taken", taken.cast("long")).drop("__loom_no", "__loom_source", "__loom_key", "__loom_range", "__loom_before", "__loom_within", "__loom_epochs")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with its columns; the last one may end early.

    A document that is taken in part keeps the text up to the last word taken. Documents of which nothing is taken go,
    and so do those without a word.
    """
    row = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("__loom_row"), "doc_id", "text", "source")
    out = mix(row, **options).where("taken > 0").withColumn("__loom_n", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = (F.col("taken") - (F.col("__loom_n") - 1) * F.col("size")).cast("int")
    space = r"[\x20\x09-\x0D]+"
    bare = F.regexp_replace("text", "^" + space, "")
    over = F.length(F.element_at(F.split(bare, space, left + 1), -1))
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(F.regexp_replace(F.substring(bare, F.lit(1), F.length(bare) - over), space + "$", ""))
    return out.select(*(text.alias(c) if c == "text" else F.col("__loom_row")[c].alias(c) for c in docs.columns))
