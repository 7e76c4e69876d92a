"""Exact top-k inner-product search with distributed M-trees.

Largest inner product becomes nearest neighbour: with M the largest norm, (x, sqrt(M^2 - |x|^2)) and (q, 0)
lie at squared distance |q|^2 + M^2 - 2 q.x. That metric carries the M-tree's bounds; scores are computed
from the integers themselves, so they are exact.

The upper nodes are a bounded number of pivots. A pivot's vectors are divided by their distance to it into rings,
each of which is a page (several, dealt by hash of the id, where more vectors than fill a page lie at one distance,
as copies do). Within a page the tree goes on: every node has a centre, a covering radius and its centre's
distance to the parent's, every entry of a leaf its distance to the leaf's centre. Queries, in blocks, first search
the most promising pages, which gives each a k-th best score; then only pages whose ring leaves room for a
better score are searched. Inside a page, nodes are ruled out by the stored distances before any distance of
their own is computed, leaves are taken best first, and a leaf's inner products are one product of those
entries and queries that the triangle inequality allows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.common import Workspace, tidy

SCALE = 256
#: Vectors a page holds, about; and queries a block holds, about.
PAGE = 8192
BLOCK = 1024
#: Pivots at most, and classes of distance to a pivot. The pivots and a row per pivot and class are all that the
#: driver and every task hold of the data.
MAX_PIVOTS = 1024
CLASSES = 256
#: Vectors the pivots are chosen from: those smallest by hash of the id.
PIVOT_SAMPLE = 20_000
#: Vectors in a leaf, children of an inner node, and entries that children are chosen from.
LEAF = 64
FAN = 16
SEEDS = 512
#: Pages a query searches first.
FIRST = 2
#: Slack of distances relative to the norms they are computed from, well above rounding.
EPS = 1e-6
LOWEST = np.iinfo(np.int64).min


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part: no null vector, component or id, all finite."""
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of a and b, exact; those beyond a long are its largest or smallest."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]])


def _asked(q: np.ndarray) -> np.ndarray:
    return np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


def reach(q: np.ndarray, top: float, score: np.ndarray) -> np.ndarray:
    """Distance within which vectors lie that score at least so much with the queries (LOWEST: anywhere)."""
    norm = (q.astype(np.float64) ** 2).sum(1) + top
    far = np.sqrt(np.maximum(0.0, norm - 2 * score.astype(np.float64))) * (1 + EPS) + EPS * np.sqrt(norm)
    return np.where(score == LOWEST, np.inf, far)


def _spread(x: np.ndarray, want: int) -> list[int]:
    """Rows of x by farthest-first traversal from the first, as many as differ."""
    chosen = [0]
    nearest = _distances(x, x[:1])[:, 0]
    while len(chosen) < want:
        far = int(np.argmax(nearest))
        if nearest[far] <= 0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, _distances(x, x[far : far + 1])[:, 0])
    return chosen


class Page:
    """An M-tree. Nodes are numbered top-down, the children of one follow each other; entries are in the order
    of leaves. centre, radius and to_parent are a node's; first and last are its children, or a leaf's entries."""

    ARRAYS = ("ids", "vectors", "to_centre", "centre", "radius", "to_parent", "first", "last", "leaf")

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, pivot: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        x = _lift(vectors, top)
        start = _distances(x, x[:1])[:, 0]
        nodes = [(np.arange(len(x)), 0, start, float(_distances(x[:1], pivot[None])[0, 0]))]
        centre, radius, to_parent, first, last, leaf, place, near = [], [], [], [], [], [], [], []
        at = done = 0
        while at < len(nodes):
            members, c, d, parent = nodes[at]
            nodes[at] = None
            children = []
            if len(members) > LEAF and d.max() > 0:
                some = members[np.linspace(0, len(members) - 1, min(SEEDS, len(members))).astype(int)]
                seeds = some[_spread(x[some], FAN)]
                all_d = _distances(x[members], x[seeds])
                owner = all_d.argmin(1)
                kept = [k for k in range(len(seeds)) if (owner == k).any()]
                if len(kept) > 1:
                    up = _distances(x[seeds], x[c : c + 1])[:, 0]
                    children = [(members[owner == k], int(seeds[k]), all_d[owner == k, k], float(up[k])) for k in kept]
            centre.append(x[c])
            radius.append(float(d.max()))
            to_parent.append(parent)
            leaf.append(not children)
            if children:
                first.append(len(nodes))
                nodes += children
                last.append(len(nodes))
            else:
                first.append(done)
                done += len(members)
                last.append(done)
                place.append(members)
                near.append(d)
            at += 1
        rows = np.concatenate(place)
        self.ids, self.vectors, self.to_centre = ids[rows], vectors[rows], np.concatenate(near)
        self.centre, self.radius, self.to_parent = np.array(centre), np.array(radius), np.array(to_parent)
        self.first, self.last, self.leaf = np.array(first), np.array(last), np.array(leaf)

    def pack(self) -> bytes:
        out = io.BytesIO()
        arrays = {k: getattr(self, k) for k in self.ARRAYS}
        if len(self.vectors) and max(self.vectors.max(), -self.vectors.min()) < 2**31:
            arrays["vectors"] = self.vectors.astype(np.int32)
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Page:
        page = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as z:
            for name in z.files:
                setattr(page, name, z[name])
        page.vectors = page.vectors.astype(np.int64)
        return page

    def _leaves(self, x: np.ndarray, limit: np.ndarray, to_pivot: np.ndarray) -> list[tuple[float, int, np.ndarray, np.ndarray]]:
        """(least bound, leaf, queries, their distances to its centre) of the leaves the bounds leave open."""
        out = []
        slack = EPS * np.sqrt((x * x).sum(1) + (self.centre[0] ** 2).sum())
        stack = []
        rows = np.flatnonzero(np.abs(to_pivot - self.to_parent[0]) - self.radius[0] <= limit + slack)
        if len(rows):
            stack.append((0, rows, _distances(x[rows], self.centre[:1])[:, 0]))
        while stack:
            node, rows, d = stack.pop()
            low = d - self.radius[node]
            keep = low <= limit[rows] + slack[rows]
            rows, d, low = rows[keep], d[keep], low[keep]
            if not len(rows):
                continue
            if self.leaf[node]:
                out.append((float(low.min()), node, rows, d))
                continue
            children = np.arange(self.first[node], self.last[node])
            # The stored distance to the parent bounds a child's before it is computed.
            near = np.abs(d[:, None] - self.to_parent[children][None]) - self.radius[children][None] <= (limit + slack)[rows][:, None]
            some = near.any(1)
            rows, near = rows[some], near[some]
            children, near = children[near.any(0)], near[:, near.any(0)]
            if len(children):
                all_d = _distances(x[rows], self.centre[children])
                stack += [(int(c), rows[near[:, j]], all_d[near[:, j], j]) for j, c in enumerate(children)]
        return sorted(out, key=lambda o: o[:2])

    def search(self, qid: np.ndarray, q: np.ndarray, top: float, k: int, bound: np.ndarray, to_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, vec_id): the page's entries that can be among a query's k best, given that bound is reached
        elsewhere; ties to smaller ids. Best-first over the leaves, all queries of a block together."""
        x = _asked(q)
        limit = reach(q, top, bound)
        slack = EPS * np.sqrt((x * x).sum(1) + top)
        scores = np.full((len(q), k), LOWEST)
        found = np.full((len(q), k), np.iinfo(np.int64).max)
        for _, node, rows, d in self._leaves(x, limit, to_pivot):
            a, b = self.first[node], self.last[node]
            keep = d - self.radius[node] <= (limit + slack)[rows]
            near = np.abs(d[keep, None] - self.to_centre[None, a:b]) <= (limit + slack)[rows[keep]][:, None]
            rows = rows[keep][near.any(1)]
            entries = a + np.flatnonzero(near.any(0))
            if not len(rows) or not len(entries):
                continue
            s = products(q[rows], self.vectors[entries])
            i = np.broadcast_to(self.ids[entries], s.shape)
            better = (s >= np.maximum(scores[rows, -1], bound[rows])[:, None]) & (i != qid[rows][:, None])
            r, _ = np.nonzero(better)
            if not len(r):
                continue
            hit = np.unique(rows[r])
            # The k best of what was found before and now, per query.
            owner = np.r_[rows[r], np.repeat(hit, k)]
            score, vec = np.r_[s[better], scores[hit].ravel()], np.r_[i[better], found[hit].ravel()]
            order = np.lexsort((vec, ~score, owner))
            owner, score, vec = owner[order], score[order], vec[order]
            nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
            best = nth < k
            scores[owner[best], nth[best]], found[owner[best], nth[best]] = score[best], vec[best]
            limit[hit] = np.minimum(limit[hit], reach(q[hit], top, scores[hit, -1]))
        r, c = np.nonzero(scores > LOWEST)
        return qid[r], scores[r, c], found[r, c]


class Rings:
    """The pages of every pivot by distance to it: ring i lies between low and high and has parts pages from page."""

    def __init__(self, histogram: pd.DataFrame, size: int):
        """histogram: (pivot, class, many, low, high), one row each."""
        rows = []
        for pivot, part in histogram.sort_values(["pivot", "class"]).groupby("pivot", sort=True):
            page, open_ = 0, None
            for r in part.itertuples():
                many, low, high, cls = int(r.many), float(r.low), float(r.high), int(r[2])
                if open_ and open_[3] + many <= size:
                    open_ = [open_[0], open_[1], high, open_[3] + many, cls]
                else:
                    if open_:
                        rows.append((pivot, *open_, page, -(-open_[3] // size)))
                        page += rows[-1][-1]
                    open_ = [cls, low, high, many, cls]
            rows.append((pivot, *open_, page, -(-open_[3] // size)))
        whole = lambda i: np.array([r[i] for r in rows], np.int64)
        self.pivot, self.first, self.last, self.page, self.parts = map(whole, (0, 1, 5, 6, 7))
        self.low, self.high = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least distance of each query to anything in each ring, from its distances to the pivots."""
        to = d[:, self.pivot]
        return np.maximum(0.0, np.maximum(to - self.high, self.low - to))


def _pivots(vectors: DataFrame, count: int, top: float, page: int) -> np.ndarray:
    """Lifted pivots by farthest-first traversal of a bounded sample."""
    want = int(min(MAX_PIVOTS, max(1, -(-count // page))))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOT_SAMPLE, 16 * want)).collect()
    x = _lift(np.array([np.frombuffer(r["v"], "<i8") for r in rows]), top)
    return x[_spread(x, want)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE, page: int = PAGE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible by `every`, its k best of all
    other rows by integer inner product, ties to the smaller vec_id.

    Rows with a null id or vector, or a null or non-finite component, take no part. Fewer than k other rows give
    fewer results, an empty table none. Equal vectors are ties. Of rows with one id, each is a
    candidate and one is the query (its results don't hold its own id). A vector shorter than the longest counts
    as having zeros behind. Scores are exact, up to the range of a long. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    work = Workspace(spark, "topk")
    every_row = integer_vectors(embeddings, scale)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = every_row.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("many"), F.max(norm).alias("top")).first()
    if not sizes["many"]:
        return spark.createDataFrame([], out)
    dim, count, top = max(1, sizes["dim"]), sizes["many"], float(sizes["top"])

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.asarray(x + [0] * (dim - len(x)), "<i8").tobytes() for x in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(v, pa.binary())], names=["vec_id", "v"])

    vectors = work.table(every_row.mapInArrow(tidy(bytes_of), "vec_id long, v binary"), "vectors")
    pivots = _pivots(vectors, count, top, page)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_lift(_matrix(b.column("v"), dim), top), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])],
                    names=["vec_id", "v", "pivot", "distance"],
                )

    assigned = work.table(vectors.mapInArrow(tidy(assign), "vec_id long, v binary, pivot int, distance double"), "assigned")
    widest = max(1e-300, assigned.agg(F.max("distance")).first()[0])
    classed = assigned.withColumn("class", F.least(F.lit(CLASSES - 1), (F.col("distance") / F.lit(widest) * CLASSES).cast("int")))
    histogram = classed.groupBy("pivot", "class").agg(F.count("*").alias("many"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    rings = Rings(histogram.toPandas(), page)  # a row per pivot and class at most
    plan = [(int(p), c, int(g), int(n)) for p, a, b, g, n in zip(rings.pivot, rings.first, rings.last, rings.page, rings.parts) for c in range(a, b + 1)]
    plan = spark.createDataFrame(plan, "pivot int, class int, page0 int, parts int")
    placed = classed.join(F.broadcast(plan), ["pivot", "class"])  # a row per pivot and class at most
    placed = placed.select("pivot", (F.col("page0") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))).cast("int").alias("page"), "vec_id", "v")

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(frame["v"]), "<i8").reshape(-1, dim)
        tree = Page(frame["vec_id"].to_numpy(np.int64), v, top, pivots[int(key[0])])
        return pd.DataFrame({"pivot": [key[0]], "page": [key[1]], "tree": [tree.pack()]})

    trees = work.table(placed.groupBy("pivot", "page").applyInPandas(build, "pivot int, page int, tree binary"), "trees")
    queries = assigned.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select("vec_id", "v")

    def home(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rings, pages) a query searches first: the FIRST of least bound, nearer pivots before others."""
        order = np.lexsort((d[:, rings.pivot], rings.bounds(d)), axis=-1)[:, :FIRST]
        return order, rings.page[order] + ids[:, None] % rings.parts[order]

    def routed(second: bool):
        """Queries with the pages they are to search: in the second round all open ones but those searched first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    ids, q = b.column("vec_id").to_numpy(), _matrix(b.column("v"), dim)
                    bound = b.column("bound").to_numpy()
                    d = _distances(_asked(q), pivots)
                    ring, page_ = home(d, ids)
                    if second:
                        slack = EPS * np.sqrt((q.astype(float) ** 2).sum(1) + top)
                        row, open_ = np.nonzero(rings.bounds(d) <= (reach(q, top, bound) + slack)[:, None])
                        times = rings.parts[open_]
                        row, open_ = np.repeat(row, times), np.repeat(open_, times)
                        pages = rings.page[open_] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                        fresh = ~((ring[row] == open_[:, None]) & (page_[row] == pages[:, None])).any(1)
                        row, open_, pages = row[fresh], open_[fresh], pages[fresh]
                    else:
                        row, open_, pages = np.repeat(np.arange(len(q)), ring.shape[1]), ring.ravel(), page_.ravel()
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).take(take) for c in ("vec_id", "v", "bound")] + [pa.array(rings.pivot[open_], pa.int32()), pa.array(pages, pa.int32())],
                        names=["vec_id", "v", "bound", "pivot", "page"],
                    )

        return run

    asked = "vec_id long, v binary, bound long, pivot int, page int"

    def blocks(rows: DataFrame) -> DataFrame:
        """Queries (vec_id, v, bound) for (pivot, page), in blocks of limited size."""
        many = rows.groupBy("pivot", "page").agg(F.count("*").alias("many"))
        part = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.ceil(F.col("many") / block)).cast("int")

        def together(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            ids, bound = f["vec_id"].to_numpy("<i8"), f["bound"].to_numpy("<i8")
            return pd.DataFrame({"pivot": [key[0]], "page": [key[1]], "ids": [ids.tobytes()], "v": [b"".join(f["v"])], "bounds": [bound.tobytes()]})

        grouped = rows.join(many, ["pivot", "page"]).withColumn("part", part).groupBy("pivot", "page", "part")
        return grouped.applyInPandas(together, "pivot int, page int, ids binary, v binary, bounds binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, bounds, pivot, tree = (batch.column(c)[r].as_py() for c in ("ids", "v", "bounds", "pivot", "tree"))
                q = np.frombuffer(v, "<i8").reshape(-1, dim)
                to_pivot = _distances(_asked(q), pivots[pivot][None])[:, 0]
                got = Page.unpack(tree).search(np.frombuffer(ids, "<i8"), q, top, k, np.frombuffer(bounds, "<i8"), to_pivot)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "score", "vec_id"])

    def searched(rows: DataFrame) -> DataFrame:
        return blocks(rows).join(trees, ["pivot", "page"]).mapInArrow(tidy(search), "query_id long, score long, vec_id long")

    unknown = F.lit(int(LOWEST)).cast("long")
    first = work.table(queries.withColumn("bound", unknown).mapInArrow(tidy(routed(False)), asked), "routes")
    first_hits = work.table(searched(first), "first")
    # Rows of one id on several pages are several candidates, so the k best hits are k candidates.
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    reached = first_hits.withColumn("nth", nth).where(F.col("nth") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    again = queries.join(reached, "vec_id", "left").withColumn("bound", F.coalesce("bound", unknown))
    again = work.table(again.mapInArrow(tidy(routed(True)), asked), "routes-2")
    both = first_hits.unionByName(searched(again))
    # k hits per query and page at most; the window keeps k per task before it shuffles.
    best = both.withColumn("rank", nth).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 50, k: int = 5, scale: int = SCALE) -> str:
    """The same in DuckDB SQL."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
    """
