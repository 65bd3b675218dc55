"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bounded_batches, lean

#: Sentences end at these; words are what stands between, lower-cased.
TOKEN = re.compile(r"[.!?\n]|[^\W_]+")
ENDS = frozenset(".!?\n")

#: The sample that a model is fitted on: at most so many labelled rows of each class, those with the smallest hashes.
MOST_TOXIC, MOST_CLEAN = 2000, 5000
AT = 0.3
#: In training, how toxic a document is without any evidence in its sentences: just what still counts as clean or not.
LEAK = AT


def _features(word: str) -> tuple[int, ...]:
    """Features of a word, as 32-bit hashes: itself and its first four and five characters, so that rare forms share
    weights. So wide a space keeps the few features with weights free of other words."""
    own = {b"w" + word.encode()}
    own |= {b"p" + word[:n].encode() for n in (4, 5) if len(word) > n}
    return tuple(zlib.crc32(x) for x in sorted(own))


class _Known(dict):
    """Word to value, computed once; emptied when it is large."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        value = self[word] = self.of(word)
        return value


def _indexed(text: str, index: dict[str, int]):
    """(numbers of the words in index, numbers of words in each sentence) of a text; new words get the next number.

    A sentence that is there again counts once.
    """
    import numpy as np

    words, lengths, own, seen = [], [], [], set()
    for token in [*TOKEN.findall(text.lower()), "."]:
        if token not in ENDS:
            own.append(index.setdefault(token, len(index)))
        elif own:
            if (key := tuple(own)) not in seen:
                seen.add(key)
                words += own
                lengths.append(len(own))
            own = []
    return np.array(words, np.int32), np.array(lengths, np.int32)


def _train(sample: list[tuple], index: dict[str, int], epochs: int = 200, rate: float = 1.5, least: float = 1.2, leak: float = LEAK):
    """({feature: weight}, bias): noisy-or log likelihood with an L1 penalty, of (label, words, lengths of sentences).

    Proximal gradient steps with momentum, scaled by how many documents a feature is in. The penalty is worth the
    gradient of least times the square root of a feature's documents, so chance gets no weight; features of fewer than
    three documents are left out. The last steps fit what is left almost without the penalty, which had drawn it to 0.
    Weights are not negative, and of a sentence's sigmoid the share that it has without evidence is taken off: so only
    evidence counts, and the number of sentences without it doesn't. What words can't explain is left to a leak that
    a document has, not a sentence. A word's weight is the sum of its features', so that tokens are gone through once
    a step.
    """
    import numpy as np

    sample = [x for x in sample if len(x[1])]
    if not sample or len({x[0] for x in sample}) < 2:
        return {}, -8.0
    y = np.array([x[0] for x in sample], dtype=float)
    word = np.concatenate([x[1] for x in sample])
    lengths = np.concatenate([x[2] for x in sample])
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(x[2]) for x in sample])
    n = len(doc)
    sentence = np.repeat(np.arange(n, dtype=np.int32), lengths)
    start = np.cumsum(lengths) - lengths
    # features of words, and how many documents they are in
    own = [_features(w) for w in index]
    width = np.array([len(f) for f in own])
    known, feature = np.unique(np.fromiter((f for x in own for f in x), np.int64), return_inverse=True)
    n_words, of = len(own), np.repeat(np.arange(len(own), dtype=np.int32), width)
    del own
    table = np.full((n_words, width.max()), len(known), np.int32)
    table[of, np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)] = feature
    often = np.zeros(len(known) + 1, np.int64)
    for x in sample:
        often[np.unique(table[np.unique(x[1])])] += 1
    often = often[:-1]
    # the sentences of each word's tokens, word by word
    by = np.argsort(word, kind="stable")
    where, start_of = sentence[by], np.searchsorted(word[by], np.arange(n_words))
    del by, table, sentence
    use = often[feature] >= 3
    place = np.cumsum(often >= 3) - 1
    feature, of = place[feature[use]], of[use]
    known, often = known[often >= 3], often[often >= 3]
    x, back, b = np.zeros(len(known)), np.zeros(len(known)), -5.0
    toxic = max(1.0, y.sum())
    cost = np.where(y > 0, 1.0, min(1.0, 3 * toxic / max(1.0, (1 - y).sum())))
    chosen, left = epochs * 3 // 5, np.ones(len(known), bool)
    for t in range(epochs):
        ahead = x + t / (t + 3) * (x - back)
        weight = np.bincount(of, weights=ahead[feature], minlength=n_words)
        z = b + np.add.reduceat(weight[word], start)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        bare = 1 / (1 + math.exp(-b))
        clear = np.log1p(-np.minimum(p, 1 - 1e-9)) - math.log1p(-bare)
        none = (1 - leak) * np.exp(np.clip(np.bincount(doc, weights=clear, minlength=len(y)), -50, 0))
        g = (np.where(y > 0, -none / (1 - none), 1.0) * cost)[doc]
        drift, g = (g * (p - bare)).sum(), g * p
        slope = np.add.reduceat(g[where], start_of)
        step = rate / (often + 2.0)
        penalty = np.sqrt(often) * (least if t < chosen else 0.02 * least)
        back, x = x, np.maximum(0, ahead - step * (np.bincount(feature, weights=slope[of], minlength=len(known)) + penalty)) * (left if t > chosen else 1)
        b -= min(0.3, max(-0.3, 0.3 * drift / (1.0 + (cost[doc] * p * (1 - p)).sum())))
        b = min(-4.0, max(-11.0, b))
        if t == chosen:
            left = x > 0
    return dict(zip(known[x > 0].tolist(), x[x > 0].tolist(), strict=True)), float(b)


def fit(docs: DataFrame, labels: DataFrame, most=(MOST_TOXIC, MOST_CLEAN)):
    """({feature: weight}, bias) from labels (doc_id, toxic) of docs, on the bounded sample; rows without a label or text are out.

    Labels are taken from rows whose crc32(doc_id as text) mod 4 is not 2. The sample's size is bounded by parameters,
    so it may be broadcast and fitted in one task.
    """
    from pyspark.sql import Window

    use = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    use = use.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).withColumn("_h", F.xxhash64("doc_id"))
    parts = [use.where(F.col("toxic") == y).orderBy("_h", "doc_id").limit(n).select("doc_id", "toxic") for y, n in ((1, most[0]), (0, most[1]))]
    chosen = parts[0].unionByName(parts[1])
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    # a doc_id that is repeated counts once
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def train(key, pdf):
        import pandas as pd

        index: dict[str, int] = {}
        pdf = pdf.sort_values("doc_id")
        w, b = _train([(int(y), *_indexed(t, index)) for y, t in zip(pdf["toxic"], pdf["text"], strict=True)], index)
        return pd.DataFrame({"ids": [list(w)], "weights": [list(w.values())], "bias": [b]})

    rows = sample.groupBy(F.lit(1).alias("one")).applyInPandas(train, "ids array<long>, weights array<double>, bias double").collect()
    return (dict(zip(rows[0]["ids"], rows[0]["weights"], strict=True)), rows[0]["bias"]) if rows else ({}, -8.0)


RESULT = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, worst_sentence int, worst_score double"


def score(docs: DataFrame, model, at: float = AT, keep: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score, predicted, n_sentences, worst_sentence (from 0), worst_score.

    score = 1 - product of (1 - p) over the different sentences of the whole text that hold evidence, where p is the
    sentence's sigmoid without the share that it has of the bias alone: so a sentence without evidence adds nothing,
    and a text isn't more toxic for its length or for repeating itself. Null and empty texts have no sentence and score
    0. A null doc_id is scored, and is not held out. Repeated rows are scored each; no rows give no rows; other
    columns are read only with keep, which gives the rows of docs that are not predicted toxic, as they are.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model[0], float(model[1])))

    def judged(texts):
        import numpy as np

        w, b = shared.value
        value = _Known(lambda t: float("nan") if t in ENDS else float(sum(w.get(f, 0.0) for f in _features(t))))
        of = value.__getitem__
        for text in texts:
            tokens = TOKEN.findall((text.as_py() or "").lower())
            v = np.fromiter(map(of, tokens), np.float64, len(tokens))
            end = np.isnan(v)
            word = ~end
            n = int(word.sum())
            if not n:
                yield 0.0, 0, None, None
                continue
            sentence = np.cumsum(end)[word]
            first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            z = np.add.reduceat(v[word], first)
            # 1 - p is (1 + e^b) / (1 + e^(b + z)), and exactly 1 where z is 0
            clear = np.minimum(0.0, np.logaddexp(0.0, b) - np.logaddexp(0.0, b + z))
            clear[z <= 0] = 0.0
            use = np.flatnonzero(clear < 0)
            place, last = np.flatnonzero(word), np.r_[first[1:], n] - 1
            once = {tuple(tokens[place[first[i]] : place[last[i]] + 1]): clear[i] for i in use}
            worst = int(clear.argmin())
            yield float(-np.expm1(sum(once.values()))), len(z), worst, float(-np.expm1(clear[worst]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            doc = batch.column("doc_id").to_pylist()
            rows = list(judged(batch.column("text")))
            if keep:
                yield batch.filter(pa.array([r[0] < at for r in rows], pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()), pa.array([d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in doc], pa.bool_()),
                    pa.array([r[0] for r in rows], pa.float64()), pa.array([int(r[0] >= at) for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64()),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_sentence", "worst_score"],
            )

    if keep:
        return docs.mapInArrow(lean(run), docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)
