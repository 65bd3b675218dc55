"""Removal of repeated byte strings over a corpus, by a prefix-free parse into overlapping phrases."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._common import bounded_batches, lean, written

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: Bytes of the rolling hash; a trigger is the least hash of a window's LENGTH - GRAM + 1 grams.
GRAM = 32
GRAMS = LENGTH - GRAM + 1
#: Windows that are parsed at once; longer texts are parsed in parts.
PART = 400_000
#: Phrases that a task compares by itself before it hands on the first of each.
HELD = 400_000
#: A trigger gram with more distinct phrases in a task is dealt by phrase.
HOT = 256

_B = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
LAST = (1 << 63) - 1


class Parser:
    """Rolling hashes of parts of texts and the phrases that their triggers make."""

    def __init__(self):
        import numpy as np

        n = PART + 4 * LENGTH
        self.power, self.back = (self._powers(b, n) for b in (_B, pow(_B, -1, 1 << 64)))
        rng = np.random.default_rng(20)
        self.value, self.other = (rng.integers(1, _ALL, 256, dtype=np.uint64, endpoint=True) for _ in range(2))

    @staticmethod
    def _powers(b: int, n: int):
        import numpy as np

        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(b, len(out), 1 << 64))])
        return out[:n]

    def sums(self, text: bytes, value=None):
        """Prefix sums from which the hash of any range follows, by a value for each byte."""
        import numpy as np

        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((self.value if value is None else value)[np.frombuffer(text, np.uint8)] * self.power[: len(text)], out=out[1:])
        return out

    def hashes(self, sums, start, end):
        import numpy as np

        h = (sums[end] - sums[start]) * self.back[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_B)
        h ^= h >> np.uint64(29)
        return h

    def windows(self, text: bytes):
        """Two hashes of all strings of LENGTH bytes, of 64 and of 32 bits, that know nothing of each other."""
        import numpy as np

        out = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for at in range(0, len(text) - LENGTH + 1, PART):
            part = text[at : at + PART + LENGTH - 1]
            start = np.arange(len(part) - LENGTH + 1)
            own, other = (self.hashes(self.sums(part, v), start, start + LENGTH) for v in (self.value, self.other))
            out.append((own, other >> np.uint64(32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def phrases(self, texts: list[bytes]):
        """(text, first window, last window, trigger hash, phrase hash) of the phrases of texts of at most PART windows in all.

        The trigger of a window is its least gram, the leftmost of equals. Windows in a row with the same trigger are a
        phrase, which spans their bytes. So equal windows have equal triggers at equal places, and each window is in
        one phrase.
        """
        import numpy as np

        lengths = np.array([len(t) for t in texts])
        whole = b"".join(texts)
        first = np.cumsum(lengths) - lengths
        sums = self.sums(whole)
        start = np.arange(max(0, len(whole) - GRAM + 1))
        gram = self.hashes(sums, start, start + GRAM)
        least = (gram & np.uint64(_ALL ^ 0xFFFFFF)) | start.astype(np.uint64)
        width = 1
        while width * 2 <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :]) if width < GRAMS else least
        trigger = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        # windows that lie in one text
        n = np.maximum(0, lengths - LENGTH + 1)
        of = np.repeat(np.arange(len(texts)), n)
        window = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        if not len(window):
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty, empty
        trigger = trigger[window]
        new = np.flatnonzero(np.r_[True, (trigger[1:] != trigger[:-1]) | (of[1:] != of[:-1])])
        last = np.r_[new[1:], len(window)] - 1
        lo, hi, t = window[new], window[last], trigger[new]
        # equal phrases have their trigger at the same place
        phrase = self.hashes(sums, lo, hi + LENGTH) + (t - lo).astype(np.uint64) * np.uint64(_B) + (hi - lo).astype(np.uint64)
        base = first[of[new]]
        return of[new], lo - base, hi - base, gram[t].view(np.int64), phrase.view(np.int64)


ROWS = "gram long, phrase long, doc long, rid long, at long, kind int, salt int"
SPANS = "doc long, rid long, lo long, hi long, kind int"
#: Kinds of rows: phrases, spans found to be repeated, and marks that a gram is hot.
PHRASE, SPAN, MARK = 0, 1, 2


def _batch(columns: dict, types: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], list(types))


def _types(schema: str) -> dict:
    import pyarrow as pa

    return {x.split()[0]: {"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")}


def _firsts(gram, phrase, doc, rid, lo, hi) -> Iterator:
    """What a task hands on of its phrases: the first of each, and the rest as spans."""
    import numpy as np

    by = np.lexsort((lo, rid, doc, phrase, gram))
    gram, phrase, doc, rid, lo, hi = (x[by] for x in (gram, phrase, doc, rid, lo, hi))
    new = np.r_[True, (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])]
    again = np.flatnonzero(~new)
    first = np.flatnonzero(new)
    g = gram[first]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    count = np.diff(np.r_[start, len(g)])
    hot = np.repeat(count > HOT, count)
    salt = np.where(hot, 1 + (phrase[first] & 63), 0)
    marks = g[start[count > HOT]]
    # repeated phrases that follow each other in a document are one span
    s = np.lexsort((lo[again], rid[again], doc[again]))
    d, r, a, b = (x[again][s] for x in (doc, rid, lo, hi))
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (a[1:] != b[:-1] + 1)]) if len(d) else np.empty(0, np.int64)
    ends = np.r_[cut[1:], len(d)] - 1 if len(d) else cut
    d, r, a, b = d[cut], r[cut], a[cut], b[ends]
    zeros = np.zeros(len(marks), np.int64)
    columns = {
        "gram": np.concatenate([g, d * 31 + a, marks]), "phrase": np.concatenate([phrase[first], b, zeros]), "doc": np.concatenate([doc[first], d, zeros]),
        "rid": np.concatenate([rid[first], r, zeros]), "at": np.concatenate([lo[first] * 128 + (hi - lo)[first], a, zeros]),
        "kind": np.repeat([PHRASE, SPAN, MARK], [len(first), len(d), len(marks)]), "salt": np.concatenate([salt, np.zeros(len(d) + len(marks), np.int64)]),
    }
    types = _types(ROWS)
    for i in range(0, len(columns["gram"]), 50_000):
        yield _batch({k: v[i : i + 50_000] for k, v in columns.items()}, types)


def _parse(batches: Iterator) -> Iterator:
    import numpy as np

    parser = Parser()
    held, count = [], 0
    waiting, size = [], 0

    def parsed():
        of, lo, hi, gram, phrase = parser.phrases([w[3] for w in waiting])
        doc, rid, base = (np.array([w[i] for w in waiting], np.int64)[of] for i in (0, 1, 2))
        return gram, phrase, doc, rid, lo + base, hi + base

    for batch in batches:
        for doc, rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(0, len(text or b"") - LENGTH + 1, PART):
                part = text[at : at + PART + LENGTH - 1]
                if size + len(part) > PART + 2 * LENGTH and waiting:
                    held.append(parsed())
                    count += len(held[-1][0])
                    waiting, size = [], 0
                waiting.append((doc, rid, at, part))
                size += len(part)
            if count > HELD:
                yield from _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
    if waiting:
        held.append(parsed())
    if held:
        yield from _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _resolve(windows: bool):
    """From rows sorted by gram, phrase and place: spans that are repeated (SPAN), and phrases still open (PHRASE).

    A phrase is open if its gram has another phrase, since a part of it may be repeated all the same. With windows,
    rows are single windows, gram and phrase are their two hashes, and nothing is open.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        types, names = _types(SPANS), [x.split()[0] for x in ROWS.split(", ")]

        def out(r):
            kind = r["kind"]
            spans = kind == SPAN
            yield {"doc": r["doc"][spans], "rid": r["rid"][spans], "lo": r["at"][spans], "hi": r["phrase"][spans], "kind": np.full(int(spans.sum()), SPAN)}
            gram, phrase, mark = r["gram"][~spans], r["phrase"][~spans], kind[~spans] == MARK
            if not len(gram):
                return
            group = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
            new = np.r_[True, (group[1:] != group[:-1]) | (phrase[1:] != phrase[:-1])]
            own = ~mark
            # a mark and a phrase with hash 0 don't count as one
            first = new & own
            first[1:] |= own[1:] & mark[:-1]
            distinct = np.bincount(group, weights=first)
            open_ = (distinct > 1) | (np.bincount(group, weights=mark) > 0) | (np.bincount(group, weights=r["salt"][~spans] > 0) > 0)
            again, left = own & ~first, first & open_[group]
            if windows:
                left[:] = False
            use = again | left
            at = r["at"][~spans][use]
            lo = at // 128
            yield {"doc": r["doc"][~spans][use], "rid": r["rid"][~spans][use], "lo": lo, "hi": lo + at % 128, "kind": np.where(left[use], PHRASE, SPAN)}

        def whole(parts):
            return {c: np.concatenate([x[c] for x in parts]) for c in names}

        rest: list[dict] = []  # rows of the last gram, which may go on, as they came
        for batch in batches:
            now = {c: batch.column(i).to_numpy() for i, c in enumerate(names)}
            if not len(now["gram"]):
                continue
            last = now["gram"][-1]
            if not rest or rest[-1]["gram"][-1] != last or now["gram"][0] != last:
                now = whole([*rest, now])
                cut = int(np.searchsorted(now["gram"], last))
                if cut:
                    for columns in out({c: x[:cut] for c, x in now.items()}):
                        yield _batch(columns, types)
                rest, now = [], {c: x[cut:] for c, x in now.items()}
            rest.append(now)
        if rest:
            for columns in out(whole(rest)):
                yield _batch(columns, types)

    return run


def _open_windows(batches: Iterator) -> Iterator:
    """Rows for the windows of open phrases of texts, the first of each in the task; the rest as spans."""
    import numpy as np

    parser = Parser()
    held, count = [], 0
    for batch in batches:
        for doc, rid, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lo, n = np.array(lo, np.int64), np.array(hi, np.int64) - np.array(lo, np.int64) + 1
            w = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own, other = (h[w].view(np.int64) for h in parser.windows(text))
            held.append((own, other, np.full(len(w), doc), np.full(len(w), rid), w, w))
            count += len(w)
            if count > 2 * HELD:
                yield from _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
    if held:
        yield from _firsts(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _cut(keep_text: bool):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, kept, spans, at = text or b"", [], [], 0
                if lo:
                    a, b = np.array(lo, np.int64), np.array(hi, np.int64) + LENGTH
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    new = np.r_[True, a[1:] > b[:-1]]
                    spans = list(zip(a[new].tolist(), b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]].tolist(), strict=True))
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                kept = b"".join([*kept, text[at:]])
                row = (doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null without keep_text).

    Bytes covered by a string of 100 bytes that also starts earlier (in a smaller doc_id, or before in the text) go.
    Rolling-hash triggers parse the texts into phrases, of which the dictionary holds the distinct ones, each with its
    first place in the corpus. Phrases that are there again are repeated as a whole. Phrases with the same trigger gram
    but different bytes are opened: the 100-byte prefixes of their suffixes are dealt and ordered by hash, not by bytes,
    and of equal ones all but the first in the corpus are repeated. Suffixes of phrases with unlike triggers can't agree
    in 100 bytes. Phrases are equal if 128 bits of hashes are (gram and phrase), windows if 96 are.

    Null text counts as empty. Documents with null doc_id come last; rows that share a doc_id are put in one fixed order,
    so that of repeated rows one is kept. No rows give no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    clear = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count() == 0
    rid = F.lit(0).cast("long") if clear else F.monotonically_increasing_id()
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), rid.alias("rid"), "text")
    if not clear:  # the order of rows with equal doc_id must be the same each time that they are read
        base = written(base, "substring-rows")
    by = ["gram", "phrase", "doc", "rid", "at"]
    rows = base.select("doc", "rid", "text").mapInArrow(lean(_parse), ROWS)
    found = written(rows.repartition("gram", "salt").sortWithinPartitions(*by).mapInArrow(lean(_resolve(False)), SPANS), "substring-spans")
    spans = found.where(F.col("kind") == SPAN).select("doc", "rid", "lo", "hi")
    open_ = found.where(F.col("kind") == PHRASE).groupBy("doc", "rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    texts = base.select("doc", "rid", "text").join(open_.hint("shuffle_hash"), ["doc", "rid"]).select("doc", "rid", "text", "lo", "hi")
    more = texts.mapInArrow(lean(_open_windows), ROWS).repartition("gram", "salt").sortWithinPartitions(*by).mapInArrow(lean(_resolve(True)), SPANS)
    more = written(more.select("doc", "rid", "lo", "hi"), "substring-spans")
    spans = spans.unionByName(more).groupBy("doc", "rid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    texts = base.join(spans.hint("shuffle_hash"), ["doc", "rid"], "left").select("doc_id", "text", "lo", "hi")
    return texts.mapInArrow(lean(_cut(keep_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
