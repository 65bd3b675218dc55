"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bound

#: A word, in text with A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Templates of notices, a paragraph each: (label, words). A template is the set of its words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("proprietary", "all rights reserved"),
)

#: A block holds a template if it has this share of the template's words.
CONTAINMENT = 0.8
#: Templates of at least so many words are also looked for across line ends; fewer words in a row prove little.
LONG = 8


def _words(text: Column) -> Column:
    """The words of a text. Letters beyond A-Z are lower-cased with them, which leaves places and ASCII words as they are
    once the Kelvin sign, the one letter whose lower case alone is ASCII, is out of the way. The text is split between
    words, which is many times cheaper than extracting each."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b"))), WORD.replace("[^", "[")), "")


def frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each template token stands in all texts: at most as many rows as the templates have tokens."""
    found = docs.select(F.explode(_words(F.col("text").cast("string"))).alias("w")).where(F.col("w").isin(tokens))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _tokens(words) -> Column:
    """Words as a constant array, of one literal: there are hundreds."""
    return F.split(F.lit(" ".join(words)), " ")


def filters(own: Column, words: Column, prefix: Column, need: Column) -> dict[str, Column]:
    """What a block must pass before its overlap with a template is counted, by name.

    own: the block's distinct template tokens, words: the template's, both in the global order, rarest first; prefix:
    the first of words, of which an overlap of need tokens can't lack all. length: the block has as many tokens as the
    overlap needs. prefix: a prefix token is in the block. position: from the first token that both have on, both have
    enough left.
    """
    first = F.get(F.array_intersect(prefix, own), 0)
    both = bound(first, lambda x: F.least(F.size(own) - F.array_position(own, x), F.size(words) - F.array_position(words, x)) + 1)
    return {"length": F.size(own) >= need, "prefix": first.isNotNull(), "position": F.coalesce(both >= need, F.lit(True))}


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, blocks and notices.

    Base: all places of the phrases in the words of the whole text. The join: a block is a line or, for templates of at
    least LONG words, a window of as many words as the template has, across line ends, since notices are wrapped. The
    tokens of the templates are ordered by how often they stand in the corpus, rarest first; blocks that pass the
    length, prefix and positional filters are counted exactly, so every block that holds the share of a template's
    words is found. blocks lists (line, label, containment) of the lines found; notices lists (label, containment) of
    the templates, short ones too, that a window holds, with the greatest containment. labels are those of the phrases,
    of the lines and of the windows of long templates. score: 1 where a phrase stands, else the greatest containment
    of these, else 0.

    Templates are few, so each row is matched where it is and nothing is shuffled. Null text counts as empty: no
    words, no places, labels "", score 0. Repeated rows are scanned each; no rows give no rows; other columns pass
    through, and columns of docs with the names of the results are replaced.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "notices")
    docs = docs.drop(*names)
    sets = [(label, tuple(dict.fromkeys(text.split()))) for label, text in templates]
    tokens = sorted({w for _, words in sets for w in words})
    often = frequencies(docs, tokens)
    rank = lambda w: (often.get(w, 0), w)
    universe = _tokens(sorted(tokens, key=rank))
    rows, hints = [], set()
    for (label, words), (_, whole) in zip(sets, templates, strict=True):
        order = sorted(words, key=rank)
        need = math.ceil(containment * len(order) - 1e-9)
        prefix = order[: len(order) - need + 1]
        hints |= set(prefix)
        rows.append(f"named_struct('label', '{label}', 'words', split('{' '.join(order)}', ' '), 'prefix', split('{' '.join(prefix)}', ' '), 'need', {need}, 'span', {len(whole.split())})")
    table = F.expr(f"array({', '.join(rows)})")
    fewest = min(math.ceil(containment * len(words) - 1e-9) for _, words in sets)
    last = sorted({p.split()[-1] for p, _ in phrases})
    hints = sorted(hints | set(last))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__loom_text", text).withColumn("__loom_words", _words(F.col("__loom_text")))
    out = out.withColumn("__loom_hit", F.arrays_overlap("__loom_words", _tokens(hints)))

    # places: (start, label) of the phrases, found at their last words
    def starts(w: Column, i: Column) -> Column:
        at = F.lit(None).cast("struct<start:long,label:string>")
        for phrase, label in phrases:
            parts = phrase.split()
            n = len(parts)
            fits = i >= n - 1
            for k, part in enumerate(reversed(parts)):
                fits = fits & (F.get(w, i - k) == part)
            at = F.when(fits, F.struct((i - (n - 1)).cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(at)
        return at

    index = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
    found = F.when(F.col("__loom_hit") & F.arrays_overlap("__loom_words", _tokens(last)), F.filter(F.transform(index(F.col("__loom_words")), lambda i: starts(F.col("__loom_words"), i)), lambda x: x.isNotNull()))
    out = out.withColumn("__loom_places", F.coalesce(found, F.array().cast("array<struct<start:bigint,label:string>>")))

    def passes(own: Column, t: Column) -> Column:
        return reduce(and_, filters(own, t["words"], t["prefix"], t["need"]).values())

    def match(line: Column, own: Column) -> Column:
        def held(t: Column) -> Column:
            found = lambda n: F.when(n >= t["need"], F.struct(line.cast("long").alias("line"), t["label"].alias("label"), (n / F.size(t["words"])).alias("containment")))
            return F.when(passes(own, t), bound(F.size(F.array_intersect(own, t["words"])), found))

        return F.filter(F.transform(table, held), lambda x: x.isNotNull())

    lines = F.transform(F.split("__loom_text", "\n"), lambda x, i: F.struct(i.alias("line"), F.array_intersect(universe, _words(x)).alias("own")))
    lines = F.filter(lines, lambda x: F.size(x["own"]) >= fewest)
    blocks = F.flatten(F.transform(lines, lambda x: match(x["line"], x["own"])))
    out = out.withColumn("blocks", F.when(F.col("__loom_hit"), blocks).otherwise(F.array().cast("array<struct<line:bigint,label:string,containment:double>>")))

    def wrapped(words: Column, own: Column) -> Column:
        def held(t: Column) -> Column:
            # the whole text's tokens bound those of a window; the fullest window may be taken to begin at a token
            starts = F.filter(index(words), lambda i: F.array_contains(t["words"], F.get(words, i)))
            most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(words, i + 1, t["span"]), t["words"]))))
            found = lambda m: F.when(m >= t["need"], F.struct(t["label"].alias("label"), (m / F.size(t["words"])).alias("containment"), (t["span"] >= LONG).alias("long")))
            return F.when(passes(own, t) & (F.size(F.array_intersect(own, t["words"])) >= t["need"]), bound(most, found))

        return F.filter(F.transform(table, held), lambda x: x.isNotNull())

    windows = bound(F.array_intersect(universe, F.col("__loom_words")), lambda own: wrapped(F.col("__loom_words"), own))
    out = out.withColumn("__loom_windows", F.when(F.col("__loom_hit"), windows).otherwise(F.array().cast("array<struct<label:string,containment:double,long:boolean>>")))
    out = out.withColumn("notices", F.transform("__loom_windows", lambda x: F.struct(x["label"].alias("label"), x["containment"].alias("containment"))))
    out = out.withColumn("__loom_windows", F.filter("__loom_windows", lambda x: x["long"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    kinds = ("blocks", "__loom_windows")
    base = F.transform("__loom_places", lambda x: x["label"])
    starts_ = F.transform("__loom_places", lambda x: x["start"])
    return out.withColumns(
        {
            "n_words": F.size("__loom_words").cast("long"),
            "n_base": F.size("__loom_places").cast("long"),
            "first_word": F.array_min(starts_),
            "last_word": F.array_max(starts_),
            "base_labels": joined(base),
            "labels": joined(F.concat(base, *(F.transform(c, lambda x: x["label"]) for c in kinds))),
            "score": F.when(F.size("__loom_places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.concat(*(F.transform(c, lambda x: x["containment"]) for c in kinds))), F.lit(0.0))),
        }
    ).drop("__loom_text", "__loom_words", "__loom_places", "__loom_windows", "__loom_hit")
