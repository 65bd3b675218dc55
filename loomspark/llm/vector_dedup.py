"""Near-duplicate vectors by cosine, found through an inverted multi-index and verified in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import components, lean, written
from loomspark.llm.hnsw import usable, valid

LINK = 0.9
#: Distinct vectors that codebooks and the number of visited cells are fitted on: so many, or so many for each codeword.
SAMPLE, TO_WORD = 8000, 8
#: Vectors to a cell of the grid on average, and codewords of a half at most (cells stay small up to 10^9 vectors).
CELL, WORDS = 64, 4096
#: Cells that a traversal visits at first, when it is fitted; twice as many until RECALL is met.
FIRST = 256
#: Share of vectors at exactly the link's cosine whose cell a traversal must reach.
RECALL = 0.98
#: Vectors of one side that are compared in one piece of work, at most about.
BLOCK = 1024


def codewords(n: int) -> int:
    """Codewords of a half for n vectors: a cell of the grid holds CELL of them on average."""
    return int(min(WORDS, max(2, round(math.sqrt(n / CELL)))))


def _codebook(half, k: int, rng):
    import numpy as np

    words = half[rng.choice(len(half), min(k, len(half)), replace=False)].copy()
    for _ in range(12):
        at = np.concatenate([_distances(half[i : i + 4096], words).argmin(1) for i in range(0, len(half), 4096)])
        count = np.bincount(at, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, at, half)
        words[count > 0] = total[count > 0] / count[count > 0, None]
    return words


def _distances(half, words):
    return (half * half).sum(1)[:, None] - 2 * (half @ words.T) + (words * words).sum(1)[None]


class Grid:
    """The product grid of two codebooks, one for each half of a vector, independent of each other."""

    def __init__(self, sample, n: int, link: float = LINK, recall: float = RECALL, seed: int = 3):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        self.words = [_codebook(h, codewords(n), rng) for h in (sample[:, : self.half], sample[:, self.half :])]
        # how far a traversal goes: until it reaches the cell of a vector at the link's cosine, or is reached from it;
        # for directions at random, and for the sample's own links, the loosest first
        x = sample[:1000]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1)[:, None] * x
        away /= np.maximum(1e-12, np.linalg.norm(away, axis=1))[:, None]
        tests = [(x, link * x + math.sqrt(1 - link * link) * away)]
        own = self._links(sample, link)
        if len(own):
            tests.append((sample[own[:, 0]], sample[own[:, 1]]))
        self.visited, size = min(FIRST, self.size), self.size
        while True:
            ranks = [self._rank(a, b) for a, b in tests]
            need = max(int(np.quantile(r, recall, method="higher")) + 1 for r in ranks)
            if need <= self.visited or self.visited >= size:
                break
            self.visited = min(size, 2 * self.visited)
        # the whole grid has every cell, so the loop ends with the recall met
        self.visited = min(need, size)
        self.recall = min(float((r < self.visited).mean()) for r in ranks)

    @staticmethod
    def _links(sample, link: float, most: int = 1000):
        """Pairs of the sample at the link's cosine or above it, those next to it first."""
        import numpy as np

        found, near = [], []
        for i in range(0, len(sample), 1000):
            cos = sample[i : i + 1000] @ sample.T
            a, b = np.nonzero(cos >= link)
            use = a + i < b
            a, b = a[use], b[use]
            by = np.argsort(cos[a, b])[:most]
            found.append(np.stack([a[by] + i, b[by]], 1))
            near.append(cos[a[by], b[by]])
        return np.concatenate(found)[np.argsort(np.concatenate(near), kind="stable")[:most]]

    def _rank(self, x, y):
        """The step at which a traversal from one of each two vectors meets the other's cell; the grid's size if none of visited does."""
        import numpy as np

        out, rows = [], max(1, 4_000_000 // (self.visited * 16))
        place = lambda seen, cell: np.where((hit := seen == cell[:, None]).any(1), hit.argmax(1), self.size)
        for i in range(0, len(x), rows):
            a, b = self.traverse(x[i : i + rows]), self.traverse(y[i : i + rows])
            out.append(np.minimum(place(a, b[:, 0]), place(b, a[:, 0])))
        return np.concatenate(out)

    @property
    def size(self) -> int:
        return len(self.words[0]) * len(self.words[1])

    def traverse(self, x):
        """The cells of each vector in the order of their distance, as a multi-sequence walk meets them; its own first.

        With both halves' codewords sorted by distance, the first v cells are among places (i, j), from 1, with
        i * j <= v; only those sums are formed.
        """
        import numpy as np

        one, two = (_distances(h, w) for h, w in zip((x[:, : self.half], x[:, self.half :]), self.words, strict=True))
        by1, by2 = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        i, j = np.nonzero(np.outer(np.arange(1, one.shape[1] + 1), np.arange(1, two.shape[1] + 1)) <= self.visited)
        total = np.take_along_axis(one, by1, 1)[:, i] + np.take_along_axis(two, by2, 1)[:, j]
        first = np.argsort(total, axis=1, kind="stable")[:, : self.visited]
        return (by1[:, i] * two.shape[1] + by2[:, j])[np.arange(len(x))[:, None], first]


def _compare(link: float, kind: str):
    """Counts of links and a forest of edges for the queries and members of one cell; kind: how vectors are packed."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        query = pdf["query"].to_numpy(bool)
        q, m = pdf[query], pdf[~query]
        if not len(q) or not len(m):
            return pd.DataFrame({"node": np.empty(0, np.int64), "n": np.empty(0, np.int64), "to": np.empty(0, np.int64)})

        def unit(rows):
            x = np.frombuffer(b"".join(rows["packed"]), kind).reshape(len(rows), -1).astype(np.float64)
            return x / np.linalg.norm(x, axis=1)[:, None]

        qid, mid = q["rep"].to_numpy(), m["rep"].to_numpy()
        linked = (unit(q) @ unit(m).T >= link) & (qid[:, None] != mid[None])
        if not linked.any():
            return pd.DataFrame({"node": np.empty(0, np.int64), "n": np.empty(0, np.int64), "to": np.empty(0, np.int64)})
        qn = linked @ m["copies"].to_numpy()
        # a member counts a query only where it doesn't visit the query's cell itself
        mn = np.zeros(len(m), np.int64)
        visits, cells = np.array(m["visits"].tolist()), q["cell"].to_numpy()
        copies = q["copies"].to_numpy()
        for cell in np.unique(cells[linked.any(1)]):
            rows, blind = np.flatnonzero(cells == cell), np.flatnonzero(~(visits == cell).any(1))
            if len(blind):
                mn[blind] += copies[rows] @ linked[np.ix_(rows, blind)]
        # components of this piece
        top = np.iinfo(np.int64).max
        lq, lm = qid.copy(), mid.copy()
        while True:
            nm = np.minimum(lm, np.where(linked, lq[:, None], top).min(0))
            nq = np.minimum(lq, np.where(linked, nm[None], top).min(1))
            if (nm == lm).all() and (nq == lq).all():
                break
            lq, lm = nq, nm
        out = pd.DataFrame({"node": np.concatenate([qid, mid]), "n": np.concatenate([qn, mn]), "to": np.concatenate([lq, lm])})
        return out[(out["n"] > 0) | (out["to"] != out["node"])]

    return run


def dedup(vectors: DataFrame, link: float = LINK) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept.

    Equal vectors are one node with a number of copies. Codebooks and the length of a traversal are fitted on a bounded
    sample of nodes; every node is in the cell of its own halves and asks the cells that it visits. A pair is found if
    one of the two visits the other's cell, and counts for both; cosines are of the vectors themselves in double
    precision, so no pair below link counts. Cells with many vectors are compared in blocks, and of what a block finds
    only counts and a forest of edges leave it, never pairs.

    Vectors that are null, zero or hold null or non-finite components have no links and are a component of their own;
    so does a null vec_id, whose component is null and which isn't kept. Rows with equal vec_id and vector are copies of each other; vectors
    of different lengths don't link. No rows give no rows; other columns aren't read.
    """
    import numpy as np

    spark = vectors.sparkSession
    fine = usable(vectors)
    nodes = written(fine.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-nodes")
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("rep"), "rep").limit(max(SAMPLE, TO_WORD * codewords(n))).select("embedding").collect()
    # single precision holds vectors of floats as they are, at half the bytes
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    grids = {}
    for dims in {len(r["embedding"]) for r in sample}:
        x = np.array([r["embedding"] for r in sample if len(r["embedding"]) == dims], np.float64)
        if len(x) > 1 and dims > 1:
            grids[dims] = Grid(x / np.linalg.norm(x, axis=1)[:, None], max(1, n * len(x) // len(sample)), link)
    shared = spark.sparkContext.broadcast(grids)

    def placed(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            lengths = pdf["embedding"].map(len)
            for dims, part in pdf.groupby(lengths, sort=False):
                grid = shared.value.get(dims)
                x = np.array(part["embedding"].tolist(), np.float64)
                if grid is None:  # a length that the sample lacks: one cell
                    visits = np.zeros((len(part), 1), np.int64)
                else:
                    unit, rows = x / np.linalg.norm(x, axis=1)[:, None], max(1, 4_000_000 // (grid.visited * 16))
                    visits = np.concatenate([grid.traverse(unit[i : i + rows]) for i in range(0, len(unit), rows)])
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "packed": [v.tobytes() for v in x.astype(kind)], "dims": dims, "cell": visits[:, 0], "visits": list(visits)})

    where = written(nodes.mapInPandas(lean(placed), "rep long, copies long, packed binary, dims int, cell long, visits array<long>"), "vector-cells")
    sizes = where.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("members"))
    asks = where.select("dims", F.explode("visits").alias("cell")).groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("queries"))
    # pieces of a cell: at most as many cells as the grids have
    cells = sizes.join(asks, ["dims", "cell"]).select("dims", F.col("cell").alias("at"), F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("qb"))
    cells = F.broadcast(cells) if sum(g.size for g in grids.values()) + 1 <= 1_000_000 else cells
    block = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ["rep", "copies", "packed", "cell", "visits"]
    members = where.withColumn("at", F.col("cell")).join(cells, ["dims", "at"]).select("dims", "at", block("mb", 0).alias("m"), every("qb").alias("q"), *data, F.lit(False).alias("query"))
    none = F.array().cast("array<bigint>")
    asking = where.withColumn("at", F.explode("visits")).join(cells, ["dims", "at"]).select("dims", "at", every("mb").alias("m"), block("qb", 1).alias("q"), "rep", "copies", "packed", "cell", none.alias("visits"), F.lit(True).alias("query"))
    found = members.unionByName(asking).groupBy("dims", "at", "m", "q").applyInPandas(_compare(link, kind), "node long, n long, to long")
    found = written(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")), "vector-group")
    known = nodes.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # rows that take no part have no key to be joined by, so they don't gather anywhere
    fine = valid()
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where(fine).join(known, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
