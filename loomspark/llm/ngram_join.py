"""N-gram Jaccard join: links of documents by word shingles, found over a token-group matrix, and their components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm._common import bounded_batches, components, dropped, lean, written

#: Words in a shingle, and the similarity of a link as a percentage: 100 * |A and B| >= LINK * |A or B|.
SHINGLE = 5
LINK = 80
#: Bands and rows of the min-hashes that put similar documents into one group; groups have about so many members.
BANDS, ROWS = 6, 3
GROUP = 48
#: Tokens in more documents than this stand last in the order, unless there are more such tokens than ORDERED.
HEAVY = 16
ORDERED = 500_000
#: Share of the smaller set that must be common within two prefixes beyond the first token.
EXTRA = 0.02
#: Tables of at most so many rows of two numbers are broadcast; others are joined by a shuffle.
SMALL = 100_000

_ALL = (1 << 64) - 1
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ODD = tuple((0xD6E8FEB86659FD93 * (2 * i + 1) ^ (0xA0761D6478BD642F >> i)) & _ALL | 1 for i in range(64))


def shingles(texts) -> list:
    """The distinct shingles of each text (UTF-8 bytes or None) as sorted 64-bit hashes; many texts are hashed as one."""
    from itertools import chain

    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = [(t or b"").lower().split() for t in texts]  # of bytes: A-Z and ASCII white space alone
    counts = np.array([len(w) for w in words], np.int64)
    total = int(counts.sum())
    w = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, total)

    def mixed(h, k: int):
        h ^= h >> np.uint64(32)
        h += np.uint64(k * _M2 & _ALL)
        h *= np.uint64(_M1)
        h ^= h >> np.uint64(29)
        return h

    def hashed(w, k: int):
        h = w[: len(w) - k + 1] * np.uint64(_ODD[0])
        for i in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_M1) + w[i : len(w) - k + 1 + i] * np.uint64(_ODD[i])
        return mixed(h, k)

    long = hashed(w, SHINGLE) if total >= SHINGLE else w[:0]
    out, start = [], 0
    for n in counts.tolist():
        h = long[start : start + n - SHINGLE + 1] if n >= SHINGLE else hashed(w[start : start + n], n) if n else w[:0]
        h = np.sort(h)
        out.append(h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h)
        start += n
    return out


def identity(tokens) -> int:
    """The id of a set: equal for equal sets."""
    import numpy as np

    mixed = (tokens ^ (tokens >> np.uint64(31))) * np.uint64(_M1)
    total = (len(tokens) * _M2 + int(np.add.reduce(mixed ^ (mixed >> np.uint64(30))))) & _ALL
    return total - (1 << 64) if total >> 63 else total


def prefix(n: int) -> int:
    """How many tokens of a set of n need to be looked at, for any partner."""
    return n - (LINK * n + 99) // 100 + 1


def overlap(a, b):
    """The least overlap of linked sets of these sizes."""
    return -(-LINK * (a + b) // (100 + LINK))


def shared(a, b, need):
    """How many tokens linked sets of these sizes have in common within a - need + shared and b - need + shared tokens.

    At most as many as keep those within both prefixes.
    """
    import numpy as np

    least = 1 + (EXTRA * np.minimum(a, b)).astype(np.int64)
    return np.minimum(least, need + 1 - np.maximum((LINK * a + 99) // 100, (LINK * b + 99) // 100))


def _features(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    odd = np.array(_ODD[8 : 8 + BANDS * ROWS], np.uint64)[:, None]
    for batch in batches:
        sets = shingles(batch.column(1).to_pylist())
        bands = []
        for t in sets:
            if len(t):
                least = (t * odd ^ (t >> np.uint64(17))).min(axis=1).tolist()
                bands.append([hash(tuple(least[i * ROWS : (i + 1) * ROWS])) for i in range(BANDS)])
            else:
                bands.append([])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in sets], pa.int64()), pa.array([identity(t) if len(t) else 0 for t in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "class", "bands"])


def _common_tokens(heavy=None):
    """(token, documents) of the first quarter of each set, counted within the task's batches.

    With heavy tokens known from there: of what such tokens move into prefixes, which is the next quarter, and the
    rest of the set where they are many.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        late = None if heavy is None else heavy.value

        def out():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count, pa.int64())], ["token", "count"])

        for batch in batches:
            for t in shingles(batch.column(1).to_pylist()):
                quarter = len(t) // 4 + 1
                if late is None:
                    part = t[:quarter]
                else:
                    n = _in(t[:quarter], late).sum()
                    part = t[quarter : len(t) if 5 * n >= quarter else 2 * quarter] if n else t[:0]
                if len(part):
                    held.append(part)
                    size += len(part)
            if size > 1_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _in(tokens, heavy):
    import numpy as np

    return heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens


def _heavy(docs: DataFrame):
    """The heaviest tokens, sorted: those in more than HEAVY documents, the ORDERED heaviest classes of them at most."""
    import numpy as np

    spark = docs.sparkSession

    def heaviest(count):
        counts = docs.mapInArrow(lean(count), "token long, count long").groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") > HEAVY)
        counts = written(counts.withColumn("step", F.floor(F.log2("n"))), "ngram-heavy")
        steps = {r["step"]: r["c"] for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("c")).collect()}
        least = 0
        while sum(c for s, c in steps.items() if s >= least) > ORDERED:
            least += 1
        found = np.sort(counts.where(F.col("step") >= least).select("token").toArrow().column(0).to_numpy().view(np.uint64))
        dropped(counts)
        return found

    first = heaviest(_common_tokens())
    if not len(first):
        return first
    return np.union1d(first, heaviest(_common_tokens(spark.sparkContext.broadcast(first))))


def _order(tokens, heavy):
    """tokens in the global order: by hash, those in heavy after all others."""
    import numpy as np

    if not len(heavy):
        return tokens
    late = _in(tokens, heavy)
    return np.concatenate([tokens[~late], tokens[late]]) if late.any() else tokens


def _combined(held: list) -> Iterator:
    """Batches of matrix rows from (grp, n, tokens): the first place of each token, group and size."""
    import numpy as np
    import pyarrow as pa

    lengths = np.array([len(t) for _, _, t in held])
    token = np.concatenate([t for _, _, t in held]).view(np.int64)
    grp, n = (np.repeat(np.array([x[i] for x in held], np.int64), lengths) for i in (0, 1))
    pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    twice = len(held) - len({x[:2] for x in held})
    if twice:  # some group and size has several members
        by = np.lexsort((pos, n, grp, token))
        token, grp, n, pos = token[by], grp[by], n[by], pos[by]
        first = np.r_[True, (token[1:] != token[:-1]) | (grp[1:] != grp[:-1]) | (n[1:] != n[:-1])]
        token, grp, n, pos = token[first], grp[first], n[first], pos[first]
    for i in range(0, len(token), 50_000):
        part = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(grp[part]), pa.array(n[part].astype(np.int32)), pa.array(pos[part].astype(np.int32))], ["token", "grp", "n", "pos"])


def _rows(sets: Iterator) -> Iterator:
    held, size = [], 0
    for x in sets:
        held.append(x)
        size += len(x[2])
        if size > 500_000:
            yield from _combined(held)
            held, size = [], 0
    if held:
        yield from _combined(held)


def _matrix(spark: SparkSession, docs: DataFrame, group: DataFrame, few: bool, heavy) -> DataFrame:
    """Rows (token, grp, n, pos) of the token-group matrix: grp has a member of size n with token at place pos at first.

    Members of one group and size are one row for each token and task; a hot group doesn't make hot tokens. Groups of
    a bounded number of classes are broadcast.
    """
    import numpy as np

    late = spark.sparkContext.broadcast(heavy)

    def prefixes(batches: Iterator) -> Iterator:
        for batch in batches:
            for t in shingles(batch.column(1).to_pylist()):
                if len(t):
                    yield identity(t), len(t), _order(t, late.value)[: prefix(len(t))]

    def listed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = list(prefixes([batch]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64()), pa.array([x[2].tobytes() for x in own], pa.binary())], ["class", "n", "tokens"])

    def exploded(batches: Iterator) -> Iterator:
        return _rows((g, n, np.frombuffer(t, np.uint64)) for batch in batches for g, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    parts = docs.mapInArrow(lean(listed), "class long, n long, tokens binary").join(F.broadcast(group) if few else group, "class", "left")
    return parts.select(F.coalesce("grp", "class").alias("grp"), "n", "tokens").mapInArrow(lean(exploded), "token long, grp long, n int, pos int")


def _meeting(batches: Iterator) -> Iterator:
    """Pairs (a, na, b, nb, common) of groups that share tokens early enough; rows come sorted by token."""
    import numpy as np
    import pyarrow as pa

    found: list = []

    def pairs(token, grp, n, pos):
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[start, len(token)])
        # tokens of two rows at once, then the others that several groups hold
        i = start[length == 2]
        i = i[grp[i] != grp[i + 1]]
        if len(i):
            a, b = n[i].astype(np.int64), n[i + 1].astype(np.int64)
            need = overlap(a, b)
            more = shared(a, b, need)
            fits = (need <= np.minimum(a, b)) & (pos[i] <= a - need + more) & (pos[i + 1] <= b - need + more)
            i = i[fits]
            x, y = np.where(grp[i] < grp[i + 1], i, i + 1), np.where(grp[i] < grp[i + 1], i + 1, i)
            found.append(np.stack([grp[x], n[x], grp[y], n[y]], 1).astype(np.int64))
        if len(start):
            several = (length > 2) & (np.minimum.reduceat(grp, start) != np.maximum.reduceat(grp, start))
            start, length = start[several], length[several]
        for s, k in zip(start.tolist(), length.tolist(), strict=True):
            g, m, p = grp[s : s + k], n[s : s + k].astype(np.int64), pos[s : s + k]
            names, at, often = np.unique(g, return_inverse=True, return_counts=True)
            # rows of all groups but the largest meet all rows, in blocks
            own = np.flatnonzero(at != often.argmax())
            for i in range(0, len(own), max(1, 4_000_000 // k)):
                a = own[i : i + max(1, 4_000_000 // k)]
                need = overlap(m[a][:, None], m[None])
                more = shared(m[a][:, None], m[None], need)
                fits = (g[a][:, None] != g[None]) & (need <= np.minimum(m[a][:, None], m[None]))
                fits &= (p[a][:, None] <= m[a][:, None] - need + more) & (p[None] <= m[None] - need + more)
                x, y = np.nonzero(fits)
                x = a[x]
                # a pair of two small groups is met from both sides
                keep = (g[x] < g[y]) | (at[y] == often.argmax())
                x, y = x[keep], y[keep]
                swap = g[x] > g[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                if len(x):
                    found.append(np.stack([g[x], m[x], g[y], m[y]], 1))

    def out():
        table = np.concatenate(found)
        found.clear()
        by = np.lexsort(table.T[::-1])
        table = table[by]
        first = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]).any(1)])
        count = np.diff(np.r_[first, len(table)])
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(table[first, i])) for i in range(4)), pa.array(count, pa.int64())], ["a", "na", "b", "nb", "common"])

    rest = None
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        token = now[0]
        cut = int(np.searchsorted(token, token[-1])) if len(token) else 0
        rest = [x[cut:] for x in now]
        if cut:
            pairs(*(x[:cut] for x in now))
        if sum(map(len, found)) > 1_000_000:
            yield out()
    if rest is not None and len(rest[0]):
        pairs(*rest)
    if sum(map(len, found)):
        yield out()


def _linked(a, b) -> bool:
    import numpy as np

    small, large = (a, b) if len(a) <= len(b) else (b, a)
    need = overlap(len(a), len(b))
    if need > len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= LINK * (len(a) + len(b) - common)


def _open(key, pdf):
    """Links that connect the members of one group as far as they are linked, and its queries with it.

    A query is compared with members only if enough of its tokens are in the union of the group's tokens.
    """
    import numpy as np
    import pandas as pd

    sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
    ids, query = pdf["class"].tolist(), pdf["query"].tolist()
    edges, clusters = [], []
    for i in sorted((i for i, q in enumerate(query) if not q), key=lambda i: (len(sets[i]), ids[i])):
        if pdf["known"].iat[i]:  # members of a group found before need no links
            clusters = [[*(clusters[0] if clusters else []), i]]
            continue
        joined = []
        for c in clusters:
            hit = next((j for j in c if _linked(sets[i], sets[j])), None)
            if hit is not None:
                edges.append((ids[i], ids[hit]))
                joined.append(c)
        clusters = [c for c in clusters if c not in joined] + [[i, *(j for c in joined for j in c)]]
    if any(query):
        union = np.unique(np.concatenate([sets[j] for c in clusters for j in c])) if clusters else np.empty(0, np.uint64)
        for i in (i for i, q in enumerate(query) if q):
            at = np.searchsorted(union, sets[i])
            at[at == len(union)] = 0
            if not len(union) or 100 * int((union[at] == sets[i]).sum()) < LINK * len(sets[i]):
                continue
            hit = next((j for c in clusters for j in c if _linked(sets[i], sets[j])), None)
            if hit is not None:
                edges.append((ids[i], ids[hit]))
    return pd.DataFrame(edges, columns=["u", "v"])


def _sets(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(class, tokens) of the classes in needed (class, rep), from one document of each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = shingles(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([identity(s) if len(s) else 0 for s in sets], pa.int64())], ["want", "tokens", "class"])

    need = needed.select(F.col("class").alias("want"), F.col("rep").alias("doc_id")).distinct()
    got = docs.select("doc_id", "text").join(F.broadcast(need) if n <= SMALL else need, "doc_id").select("want", "text")
    got = got.mapInArrow(lean(run), "want long, tokens binary, class long").where("class = want")
    return got.dropDuplicates(["class"]).select("class", "tokens")


def join(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, class.

    Words are lower-cased in A-Z; a document's set holds its distinct shingles of five words, or its whole sequence if
    it has fewer. Documents link at a Jaccard similarity of 0.8; component_id is the smallest doc_id reached by links.

    Documents with equal sets are one class. Classes that share a band of min-hashes form groups, whose members are
    linked within the group; connected members are one group from then on, and every other class is its own. The
    token-group matrix has a row for each prefix token of a group and size. Two groups whose shared tokens meet the
    least overlap of linked sets are opened: a query is compared with members if the group's token union can hold
    enough of it. The order of tokens puts heavy ones last; any order gives the same links, so results are exact (up
    to equal 64-bit hashes of different shingles or sets).

    Null or empty text, or text without words: no shingles, a component of its own. A null doc_id links with nothing
    and has a null component. Rows with equal doc_id are linked by their texts alone, each has its text's component. No
    rows give no rows; other columns aren't read.
    """
    return _joined(docs).drop("component")


def _joined(docs: DataFrame) -> DataFrame:
    """The rows of join() with component: a class that stands for the component, null without doc_id or shingles."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    bounded_batches(spark)
    feats = written(docs.mapInArrow(lean(_features), "doc_id long, n long, class long, bands array<long>"), "ngram-features")
    classes = written(feats.where("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("bands").alias("bands")), "ngram-classes")

    # groups of similar classes: each class in its largest bucket, large buckets in parts that share their first member
    band = classes.select("class", F.posexplode("bands").alias("band", "key"))
    buckets = band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("leader")).where("k > 1")
    best = band.join(buckets, ["band", "key"]).groupBy("class").agg(F.max(F.struct("k", "band", "key", "leader")).alias("b")).select("class", "b.*")
    parts = F.greatest(F.lit(1), F.ceil(F.col("k") / GROUP)).cast("int")
    members = best.withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int"))
    members = members.select("band", "key", "part", "class").unionByName(members.select("band", "key", "part", F.col("leader").alias("class"))).distinct()
    members = written(members.join(classes.select("class", "rep"), "class"), "ngram-members")
    sets = _sets(docs, members, members.select("class").distinct().count())
    opened = members.drop("rep").join(sets, "class").select("band", "key", "part", "class", "tokens", F.lit(False).alias("query"), F.lit(False).alias("known"))
    near = written(opened.groupBy("band", "key", "part").applyInPandas(_open, "u long, v long"), "ngram-links")
    group = written(components(near, "ngram-group").select(F.col("node").alias("class"), F.col("component").alias("grp")), "ngram-group")

    heavy = _heavy(docs)
    few = group.count() <= SMALL
    matrix = _matrix(spark, docs, group, few, heavy).repartition("token").sortWithinPartitions("token", "grp", "n")
    pairs = matrix.mapInArrow(lean(_meeting), "a long, na long, b long, nb long, common long").groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))
    need = F.ceil(F.expr(f"{LINK} * (na + nb) / {100 + LINK}"))
    least_common = F.least(1 + F.floor(F.lit(EXTRA) * F.least("na", "nb")), need + 1 - F.ceil(F.expr(f"{LINK} * greatest(na, nb) / 100")))
    pairs = written(pairs.where(F.col("common") >= least_common).drop("common"), "ngram-pairs")
    if pairs.limit(1).count():
        # sides of a pair: the one with more members is the group, the other's members are queries
        known = classes.select("class", "rep", "n").join(group, "class", "left").withColumn("grp", F.coalesce("grp", "class"))
        sides = pairs.select(F.col("a").alias("grp"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("grp"), F.col("nb").alias("n"))).distinct()
        here = written(known.join(sides, ["grp", "n"]), "ngram-sides")
        sizes = here.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("k"))
        both = pairs.join(sizes.withColumnsRenamed({"grp": "a", "n": "na", "k": "ka"}), ["a", "na"]).join(sizes.withColumnsRenamed({"grp": "b", "n": "nb", "k": "kb"}), ["b", "nb"])
        big = F.when(F.col("ka") > F.col("kb"), F.struct(F.col("a").alias("g"), F.col("na").alias("gn"), F.col("ka").alias("gk"), F.col("b").alias("q"), F.col("nb").alias("qn"), F.col("kb").alias("qk"))).otherwise(F.struct(F.col("b").alias("g"), F.col("nb").alias("gn"), F.col("kb").alias("gk"), F.col("a").alias("q"), F.col("na").alias("qn"), F.col("ka").alias("qk")))
        both = both.select(big.alias("x")).select("x.*")
        total = both.groupBy("g", "gn", "gk").agg(F.sum("qk").alias("queries")).withColumn("parts", F.ceil(F.col("gk") / GROUP).cast("int")).withColumn("blocks", F.ceil(F.col("queries") / (4 * GROUP)).cast("int"))
        part, block = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int")
        inside = total.join(here.withColumnsRenamed({"grp": "g", "n": "gn"}), ["g", "gn"]).select("g", "gn", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "class", F.lit(False).alias("query"))
        asked = both.select("g", "gn", "q", "qn").join(total, ["g", "gn"]).join(here.select(F.col("grp").alias("q"), F.col("n").alias("qn"), "class"), ["q", "qn"]).select("g", "gn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), "class", F.lit(True).alias("query"))
        sets = _sets(docs, here, here.select("class").distinct().count())
        opened = inside.unionByName(asked).join(sets, "class").withColumn("known", ~F.col("query"))
        more = written(opened.groupBy("g", "gn", "part", "block").applyInPandas(_open, "u long, v long"), "ngram-links")
        if more.limit(1).count():
            group = written(components(near.unionByName(more), "ngram-group").select(F.col("node").alias("class"), F.col("component").alias("grp")), "ngram-group")
    first = classes.join(group, "class").groupBy("grp").agg(F.min("rep").alias("component_id"))
    named = group.join(first, "grp").select("class", "component_id", "grp")
    component = classes.select("class", "rep").join(named, "class", "left").select("class", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("grp", "class").alias("component"))
    out = feats.select("doc_id", "n", "class").withColumn("_own", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("class")))
    out = out.join(component.withColumnRenamed("class", "_own"), "_own", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class", "component")


def _classed(batches: Iterator) -> Iterator:
    """Batches with the class of the last column, a text, in its place."""
    import pyarrow as pa

    for batch in batches:
        sets = shingles(batch.column(batch.num_columns - 1).to_pylist())
        own = pa.array([identity(t) if len(t) else 0 for t in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], [*batch.schema.names[:-1], "__loom_class"])


def unique(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of join(): that of the smallest doc_id, as it is; rows without doc_id stay.

    Components are those of the rows' own texts: rows that share a doc_id stay or go each with its text. Of rows of one
    component and doc_id the one with the least text stays, then that of the least hash; texts without words are one
    component for each doc_id. What goes is the smaller part, so it is what is joined, broadcast while it is small.
    """
    found = written(_joined(docs).select("doc_id", "component_id", "class", "component"), "ngram-components")
    several = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    several = written(several, "ngram-several")
    n_several = several.count()
    gone = found.where("doc_id <> component_id").select("doc_id")
    gone = (gone.unionByName(several) if n_several else gone).distinct()
    out = docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, "doc_id", "left_anti").select(*docs.columns)
    if n_several:
        # rows that share a doc_id: the class tells which of them the component's row is
        few = n_several <= SMALL
        rows = docs.join(F.broadcast(several) if few else several, "doc_id", "left_semi").select(*docs.columns)
        kinds = rows.schema.add("__loom_class", "long")
        rows = rows.withColumn("__loom_class", F.col("text").cast("string").cast("binary")).mapInArrow(lean(_classed), kinds)
        stay = found.join(F.broadcast(several) if few else several, "doc_id", "left_semi").where("doc_id = component_id")
        stay = stay.select("doc_id", F.col("class").alias("__loom_class"), F.col("component").alias("__loom_component")).distinct()
        hashed = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
        first = F.row_number().over(Window.partitionBy("doc_id", "__loom_component").orderBy(F.col("text").asc_nulls_last(), hashed))
        rows = rows.join(stay, ["doc_id", "__loom_class"]).withColumn("__loom_first", first).where("__loom_first = 1")
        out = out.unionByName(rows.select(*docs.columns))
    return out
