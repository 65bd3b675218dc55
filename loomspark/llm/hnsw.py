"""Approximate nearest neighbours by inner product: a navigable small-world graph for each shard, results merged."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._common import dropped, written

#: Least vectors in a shard of a larger table, and bytes of vectors that a shard holds at most (65,536 of 64 components).
SHARD, SHARD_BYTES = 6000, 1 << 25
#: Links of a node (twice as many on the ground level), breadth of building, and of searching a shard of SHARD vectors.
LINKS = 16
BUILD, SEARCH = 80, 160
#: Queries that are searched together, and least queries of one task.
TOGETHER, BLOCK = 256, 1024
#: The router: most cells, vectors and bytes of the sample it is fitted on, queries it is measured with, its recall, and
#: the share of cells a query may visit; where more are needed, the table has one cell.
CELLS, SAMPLE, SAMPLE_BYTES, PROBED, ROUTED, WORTH = 1024, 16_384, 1 << 25, 400, 0.98, 0.7
QUERY_STEP = 20
NEAREST = 20


def valid() -> Column:
    """Whether a row takes part: a vec_id, and a vector that isn't null or zero and whose components are all finite."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as double) of the vectors that take part."""
    return vectors.where(valid()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


class Graph:
    """A hierarchical navigable small-world graph in flat arrays; rows of x are nodes, near means a large product.

    Vectors get one more component that makes their norms equal, so the largest product is the least distance. Nodes
    come in batches of at most a tenth of those there: a batch is searched for at once and also sees itself.
    """

    def __init__(self, x, levels=None, links=None, entry=0):
        import numpy as np

        self.x, self.entry = x, entry
        norm = (x * x).sum(1)
        self.y = np.concatenate([x, np.sqrt(np.maximum(0, norm.max(initial=0) - norm))[:, None]], 1).astype(np.float32)
        self.levels, self.links = levels, links

    @classmethod
    def build(cls, x, seed: int = 5):
        import numpy as np

        self, n = cls(x), len(x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 4)
        level[order[0]] = top = level.max(initial=0)
        self.levels, self.entry = level.astype(np.int8), int(order[0])
        # for each level the nodes' links, -1 where there is none; upper levels hold few nodes
        self.links = [np.full((n, LINKS * 2 if k == 0 else LINKS), -1, np.int32) for k in range(top + 1)]
        done = 1
        while done < n:
            new = order[done : done + max(1, min(512, done // 10))]
            self._insert(new, level)
            done += len(new)
        return self

    def _insert(self, new, level):
        import numpy as np

        at = np.full(len(new), self.entry)
        for k in range(len(self.links) - 1, -1, -1):
            here = level[new] >= k
            if k and not here.any():
                at = self._search(self.y[new], at[:, None], k, 1)[0][:, 0]
                continue
            ids, near = self._search(self.y[new], at[:, None], k, BUILD if k == 0 else LINKS * 2)
            at = ids[:, 0]
            who = np.flatnonzero(here)
            batch = new[who]
            own = self.y[batch] @ self.y[batch].T
            np.fill_diagonal(own, -np.inf)
            close = np.argsort(-own, axis=1)[:, : LINKS]
            ids = np.concatenate([ids[who], np.where(np.isfinite(np.take_along_axis(own, close, 1)), batch[close], -1)], 1)
            near = np.concatenate([near[who], np.take_along_axis(own, close, 1)], 1)
            near[ids < 0] = -np.inf
            chosen = self._spread(ids, near, LINKS)
            self.links[k][batch, : chosen.shape[1]] = chosen
            # links back; nodes with too many keep those that spread
            source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            count = np.diff(np.r_[first, len(target)])
            nodes, wide = target[first], self.links[k].shape[1]
            if not len(nodes):
                continue
            add = np.full((len(nodes), count.max(initial=0)), -1, np.int64)
            add[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            all_ = np.concatenate([self.links[k][nodes], add], 1)
            room = (all_ >= 0).sum(1) <= wide
            packed = np.take_along_axis(all_, np.argsort(all_ < 0, axis=1, kind="stable"), 1)[:, :wide]
            self.links[k][nodes[room]] = packed[room]
            full = np.flatnonzero(~room)
            for i in range(0, len(full), 1024):
                rows = full[i : i + 1024]
                product = np.einsum("nd,nkd->nk", self.y[nodes[rows]], self.y[np.maximum(all_[rows], 0)])
                product[all_[rows] < 0] = -np.inf
                kept = self._spread(all_[rows], product, wide)
                self.links[k][nodes[rows]] = -1
                self.links[k][nodes[rows], : kept.shape[1]] = kept

    def _spread(self, ids, near, most: int):
        """Of each row's candidates, nearest first, those nearer to the row's node than to any taken before; then the rest."""
        import numpy as np

        by = np.argsort(-near, axis=1)[:, : most * 3]
        ids, near = np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)
        twice = np.zeros(ids.shape, bool)
        for j in range(1, ids.shape[1]):
            twice[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        fine = (ids >= 0) & np.isfinite(near) & ~twice
        y = self.y[np.maximum(ids, 0)]
        between = np.einsum("nad,nbd->nab", y, y)
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            worse = (taken & (between[:, j] > near[:, j : j + 1])).any(1)
            taken[:, j] = fine[:, j] & ~worse & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(fine, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        by = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(fine, by, 1), np.take_along_axis(ids, by, 1), -1)

    def _search(self, q, start, k: int, breadth: int):
        """(ids, products) of the nearest nodes found on a level, nearest first, for many queries at once."""
        import numpy as np

        n, rows = len(q), np.arange(len(q))[:, None]
        links = self.links[k]
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, breadth), -1, np.int64)
        near = np.full((n, breadth), -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        near[:, : start.shape[1]] = np.einsum("nd,nkd->nk", q, self.y[start])
        seen[rows, start] = True
        open_ = np.isfinite(near)
        active = np.arange(n)
        wide = min(4, breadth)
        while len(active):
            # the nearest open nodes of each query that still has one
            a = np.where(open_[active], near[active], -np.inf)
            take = np.argpartition(-a, wide - 1, axis=1)[:, :wide] if wide < breadth else np.argsort(-a, axis=1)
            live = np.isfinite(np.take_along_axis(a, take, 1))
            some = live.any(1)
            active, take, live = active[some], take[some], live[some]
            if not len(active):
                break
            open_[active[:, None], take] = False
            nodes = np.where(live, ids[active[:, None], take], -1)
            next_ = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            fresh = (next_ >= 0) & ~seen[active[:, None], np.maximum(next_, 0)]
            next_ = np.where(fresh, next_, -1)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            next_ = next_[:, (next_ >= 0).any(0)]
            if not next_.shape[1]:
                continue
            r, c = np.nonzero(next_ >= 0)
            node = next_[r, c]
            seen[active[r], node] = True
            product = np.full(next_.shape, -np.inf, np.float32)
            product[r, c] = np.einsum("nd,nd->n", q[active[r]], self.y[node])
            all_ids, all_near = np.concatenate([ids[active], next_], 1), np.concatenate([near[active], product], 1)
            all_open = np.concatenate([open_[active], next_ >= 0], 1)
            best = np.argpartition(-all_near, breadth - 1, axis=1)[:, :breadth]
            ids[active], near[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_near, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1) & np.isfinite(near[active])
        by = np.argsort(-near, axis=1)
        return np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)

    def search(self, q, breadth: int | None = None):
        """The nearest nodes found to each query, nearest first; larger graphs are searched more broadly."""
        import numpy as np

        breadth = breadth or max(SEARCH, int(SEARCH * (len(self.x) / SHARD) ** 0.4))

        q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        at = np.full(len(q), self.entry)
        for k in range(len(self.links) - 1, 0, -1):
            at = self._search(q, at[:, None], k, 1)[0][:, 0]
        return self._search(q, at[:, None], 0, breadth)[0]


class Router:
    """Cells of directions: every vector is in the cell of its nearest centre, a query visits the `visits` nearest."""

    def __init__(self, centres, visits: int):
        self.centres, self.visits = centres, visits

    @classmethod
    def fit(cls, x, cells: int, nearest: int = NEAREST):
        """Centres of one half of x; visits: as few as find ROUTED of the neighbours within the other half.

        Neighbours within a sample are farther than those in the table, so the table's recall is rather higher. None
        if that takes more than WORTH of the cells: neighbours lie in all directions then, and cells are of no use.
        """
        import numpy as np

        own, other = x[::2], x[1::2]
        unit = own / np.linalg.norm(own, axis=1)[:, None]
        cells = min(cells, len(own) // 8)
        if cells < 2 or len(other) < 2:
            return None
        self = cls(unit[:cells].copy(), cells)
        for _ in range(8):
            at = self.order(unit, 1)[:, 0]
            total = np.zeros_like(self.centres)
            np.add.at(total, at, unit)
            norm = np.linalg.norm(total, axis=1)[:, None]
            self.centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), self.centres)
        asked = other[:PROBED]
        product = asked @ other.T
        np.fill_diagonal(product, -np.inf)
        near = np.argsort(-product, axis=1)[:, : min(nearest, len(other) - 1)]
        place = np.argsort(self.order(asked, cells), axis=1)
        visit = np.sort(np.take_along_axis(place, self.order(other, 1)[:, 0][near], 1).ravel())
        self.visits = int(visit[min(len(visit) - 1, math.ceil(ROUTED * len(visit)))]) + 1
        return self if self.visits <= WORTH * cells else None

    def order(self, x, most: int):
        """The nearest cells of each vector, nearest first."""
        import numpy as np

        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")[:, :most]


def shard_size(n: int, dims: int) -> int:
    """Vectors in a shard of a table of n: as a root of n, since larger shards make fewer visits of dearer graphs."""
    return max(1, min(max(SHARD, math.isqrt(SHARD * n)), SHARD_BYTES // (8 * max(1, dims))))


def fit_routers(nodes: DataFrame, counts: dict[int, int], shard: int | None, nearest: int = NEAREST) -> dict[int, Router]:
    """A router for each dimension with more than one shard, where it is of use; fitted on a bounded sample by hash."""
    import numpy as np

    out = {}
    for dims, n in counts.items():
        cells = min(CELLS, math.ceil(n / (shard or shard_size(n, dims))))
        if cells > 1:
            most = max(32, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
            key = F.xxhash64("embedding", F.lit("router"))
            share = min(1.0, 2 * most / n)  # twice what is wanted, so that the sort is of a bounded sample too
            kept = nodes.where((F.col("dims") == dims) & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))))
            rows = kept.select("embedding").orderBy(key).limit(most).collect()
            if fitted := Router.fit(np.array([r[0] for r in rows], np.float64).reshape(-1, dims), cells, nearest):
                out[dims] = fitted
    return out


def celled(df: DataFrame, routers: dict[int, Router], visits: bool) -> DataFrame:
    """df, of rows with dims and embedding, with cells: its own, or those that it visits; [0] where there is no router."""
    if not routers:
        return df.withColumn("cells", F.array(F.lit(0)))
    plain = {d: (r.centres, r.visits) for d, r in routers.items()}

    def run(batches):
        import numpy as np

        for pdf in batches:
            cells = np.empty(len(pdf), object)
            dims = pdf["dims"].to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                if int(d) not in plain:
                    for i in rows:
                        cells[i] = [0]
                    continue
                centres, most = plain[int(d)]
                found = Router(centres, most).order(np.array(pdf["embedding"].iloc[rows].tolist(), np.float64), most if visits else 1)
                for i, f in zip(rows, found, strict=True):
                    cells[i] = f
            yield pdf.assign(cells=cells)

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "cells array<int>"]))


def index(vectors: DataFrame, shard: int | None = None, nearest: int = NEAREST) -> tuple[DataFrame, DataFrame, dict[int, Router]]:
    """The index, written: a row for each shard with flat arrays (members, vectors, levels, links, entry); its cells
    (dims, cell, pieces); its routers.

    Equal vectors are one node with the smallest vec_ids that an answer may hold (nearest, and one for the query
    itself). A cell with more nodes than a shard holds is cut into pieces by a hash of the vector, so a crowded cell
    is no larger task than any; every vector is in one shard.
    """
    # the smallest ids of equal vectors: Spark limits a ranked window before its shuffle, so copies don't gather
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = vectors.distinct().withColumn("_rank", rank).where(F.col("_rank") <= nearest + 1)
    nodes = nodes.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumn("dims", F.size("embedding")), "ann-nodes")
    # only dimensions with more than one shard are told to the driver: no more of them than there are shards
    size = F.lit(shard) if shard else F.least(F.greatest(F.lit(SHARD), F.floor(F.sqrt(F.lit(SHARD) * F.col("n")))), F.floor(F.lit(SHARD_BYTES) / (F.col("dims") * 8)))
    sizes = nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.greatest(size, F.lit(1)).cast("long"))
    sizes = written(sizes, "ann-sizes")
    large = {r.dims: r.n for r in sizes.where("n > size").collect()}
    routed = fit_routers(nodes, large, shard, nearest)

    def build(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.assign(first=[int(i[0]) for i in pdf["ids"]]).sort_values("first")
        x = np.array(pdf["embedding"].tolist(), np.float64)
        g = Graph.build(x)
        members = pdf["ids"].tolist()
        flat = np.concatenate([np.asarray(m, np.int64) for m in members])
        return pd.DataFrame({"dims": [x.shape[1]], "cell": [int(pdf["cell"].iat[0])], "piece": [int(pdf["piece"].iat[0])], "entry": [g.entry], "ids": [flat.tobytes()], "counts": [np.array([len(m) for m in members], np.int32).tobytes()], "vectors": [x.tobytes()], "levels": [g.levels.tobytes()], "links": [[k.tobytes() for k in g.links]]})

    of = celled(nodes, routed, visits=False).withColumn("cell", F.col("cells")[0]).drop("cells")
    if routed:
        of = written(of, "ann-celled")
        dropped(nodes)
    dealt = of if routed else nodes
    cells = of.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("held")).join(sizes.select("dims", "size"), "dims")
    cells = written(cells.select("dims", "cell", F.ceil(F.col("held") / F.col("size")).cast("int").alias("pieces")), "ann-cells")
    of = of.join(small(cells), ["dims", "cell"]).withColumn("piece", F.pmod(F.xxhash64("embedding"), F.col("pieces")).cast("int")).drop("pieces")
    schema = "dims int, cell int, piece int, entry int, ids binary, counts binary, vectors binary, levels binary, links array<binary>"
    table = written(of.groupBy("dims", "cell", "piece").applyInPandas(build, schema), "ann-index")
    dropped(dealt)
    return table, cells, routed


def small(cells: DataFrame) -> DataFrame:
    """The table of cells to join with: at most CELLS rows for a dimension, broadcast unless there are very many dimensions."""
    return F.broadcast(cells) if cells.count() < 100_000 else cells


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, shard: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest vectors found to each of queries, itself left out.

    Both hold vec_id and embedding. Nearness is the inner product in double precision of the vectors as they are; ties
    go to the smaller vec_id. Shards hold `shard` vectors, by default a number that grows with the table; each query
    meets the graphs of the cells that the router names, in blocks of queries. Vectors that are null, zero
    or have null or non-finite components take no part; a vec_id that is repeated with the same vector counts once,
    with other vectors it is found by its best. A dimension of its own has its own graphs. No rows give no rows;
    other columns aren't read.
    """
    spark = vectors.sparkSession
    table, cells, routed = index(usable(vectors), shard, nearest)
    asked = usable(queries).withColumnsRenamed({"vec_id": "query_id"}).distinct().withColumn("dims", F.size("embedding"))
    asked = written(celled(asked, routed, visits=True), "ann-queries")
    visits = asked.select("dims", F.explode("cells").alias("cell"))
    # a task per shard and block of its queries; blocks are as large as shards where there are enough tasks without
    tasks = visits.join(small(cells), ["dims", "cell"]).agg(F.sum("pieces")).first()[0] or 0
    block = min(shard or SHARD_BYTES // 512, max(BLOCK, tasks // (4 * spark.sparkContext.defaultParallelism)))
    blocks = visits.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cells = written(cells.join(blocks, ["dims", "cell"]), "ann-blocks")
    met = asked.select("query_id", "embedding", "dims", F.explode("cells").alias("cell")).join(small(cells), ["dims", "cell"])
    met = met.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))

    def find(key, left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        row = right.iloc[0]
        x = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dims"]))
        n = len(x)
        links = [np.frombuffer(b, np.int32).reshape(n, -1) for b in row["links"]]
        g = Graph(x, np.frombuffer(row["levels"], np.int8), links, int(row["entry"]))
        count = np.frombuffer(row["counts"], np.int32)
        start, ids = np.cumsum(count) - count, np.frombuffer(row["ids"], np.int64)
        out = []
        for i in range(0, len(left), TOGETHER):
            part = left.iloc[i : i + TOGETHER]
            asked = part["query_id"].to_numpy()
            q = np.array(part["embedding"].tolist(), np.float64)
            found = g.search(q)
            who, place = np.nonzero(found >= 0)
            node = found[who, place]
            score = np.zeros(len(node))
            for d in range(q.shape[1]):  # in the order of components, as a plain sum has it
                score += x[node, d] * q[who, d]
            # each node stands for the ids of its copies
            held = count[node]
            vec = ids[np.repeat(start[node] - (np.cumsum(held) - held), held) + np.arange(held.sum())]
            who, score = np.repeat(who, held), np.repeat(score, held)
            use = vec != asked[who]
            who, vec, score = who[use], vec[use], score[use]
            by = np.lexsort((vec, -score, who))
            who, vec, score = who[by], vec[by], score[by]
            use = np.arange(len(who)) - np.searchsorted(who, who) < nearest
            out.append(pd.DataFrame({"query_id": asked[who[use]], "vec_id": vec[use], "score": score[use]}))
        return pd.concat(out)

    copies = table.join(small(cells), ["dims", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("pieces", "blocks")
    key = ["dims", "cell", "piece", "block"]
    met = met.select("query_id", "embedding", *(F.col(c).alias(f"to_{c}") for c in key))
    found = met.groupBy(*(f"to_{c}" for c in key)).cogroup(copies.groupBy(*key)).applyInPandas(find, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
