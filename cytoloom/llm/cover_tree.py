"""Exact top-k search by inner product: both sides dealt to places in space, and cover trees over them walked together."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.shared import Work

#: Rows of a leaf, of queries and of data.
QUERY_LEAF, LEAF = 128, 512
#: Places of a side, at most: what the driver and a task know of a side is so many centers and radii, however many rows there are.
PLACES = 256


class Tree:
    """A cover tree over the rows of x, written as lists: center and radius of every node, its children, and the rows of its leaves.

    Centers are rows. Children's centers are more than half their parent's radius apart (separation), all rows of a node are within its
    radius (covering), and a child's radius is at most half its parent's, unless 16 centers don't cover the parent so far: then the rows
    left go to the nearest of them, and the next level covers them. Where one of the centers would still get over 3/4 of the rows (as in
    many dimensions), the node is cut into leaves of rows by their distance from its own center instead, so the depth stays small. Nodes of at most `leaf` rows, or of equal rows, are leaves."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.leaf, self.center, self.radius, self.children, self.rows = x, leaf, [], [], [], []
        if len(x):
            self._grow(np.arange(len(x)), int(((x - x.mean(0)) ** 2).sum(1).argmin()))

    def _grow(self, rows: np.ndarray, center: int) -> int:
        far = np.sqrt(((self.x[rows] - self.x[center]) ** 2).sum(1))
        node, radius = len(self.center), float(far.max())
        self.center.append(self.x[center])
        self.radius.append(radius)
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= self.leaf or radius == 0:
            return node
        owner, nearest, picked = np.zeros(len(rows), int), far, [center]
        while len(picked) < 16 and nearest.max() > radius / 2:
            picked.append(int(rows[nearest.argmax()]))
            d = np.sqrt(((self.x[rows] - self.x[picked[-1]]) ** 2).sum(1))
            closer = d < nearest
            owner[closer], nearest = len(picked) - 1, np.minimum(nearest, d)
        if np.bincount(owner).max() > 0.75 * len(rows):
            order = rows[np.argsort(far, kind="stable")]
            self.children[node] += [self._grow(order[at : at + self.leaf], center) for at in range(0, len(rows), self.leaf)]
            return node
        for c, at in enumerate(picked):
            self.children[node].append(self._grow(rows[owner == c], at))
        return node


def upper(cq: np.ndarray, rq: np.ndarray, cx: np.ndarray, rx: np.ndarray) -> np.ndarray:
    """The most that a row within rq of cq and one within rx of cx can give, for each pair, with room for rounding."""
    lq, lx = np.sqrt((cq**2).sum(1))[:, None], np.sqrt((cx**2).sum(1))[None]
    top = cq @ cx.T + rq[:, None] * lx + lq * rx[None] + rq[:, None] * rx[None]
    return top + 1e-6 * np.abs(cq) @ np.abs(cx).T + 1e-6 * np.abs(top) + 1e-6


def dual_search(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k highest inner products of integers with rows of another id, ties to the smaller id: query rows, ids, scores.
    known: a score of each query that k rows elsewhere reach (-inf if none); lower ones may be left out.

    Pairs of nodes are taken best bound first; one is left out when its bound is below the worst kth score of its group of queries. Pairs
    of leaves are multiplied as blocks, in doubles as long as all their sums are below 2^53, in 64-bit integers beyond that; scores
    that may be beyond 2^63 raise an OverflowError."""
    if not len(q) or not len(x):
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64)
    fq, fx = q.astype(np.float64), x.astype(np.float64)
    most = float(np.sqrt((fq**2).sum(1).max()) * np.sqrt((fx**2).sum(1).max()))
    if most >= 2.0**63:
        raise OverflowError("inner products of these vectors may not fit a long")
    kind = np.float64 if most < 2.0**53 else np.int64
    q, x = (fq, fx) if kind is np.float64 else (q, x)
    a, b = Tree(fq, QUERY_LEAF), Tree(fx, LEAF)
    ca, cb, ra, rb = np.array(a.center), np.array(b.center), np.array(a.radius), np.array(b.radius)
    none = kind(-np.inf) if kind is np.float64 else np.iinfo(np.int64).min
    best_s, best_i = np.full((len(q), k), none, kind), np.full((len(q), k), np.iinfo(np.int64).max)
    kth = np.full(len(q), none, kind)
    if known is not None:
        told = known > -np.inf
        kth[told] = (known if kind is np.float64 else np.nextafter(known, -np.inf))[told].astype(kind)  # a long in a double may be rounded up

    def bound(i: int, js: list[int]) -> np.ndarray:
        return upper(ca[[i]], ra[[i]], cb[js], rb[js])[0]

    work, n = [(-float(bound(0, [0])[0]), 0, 0, 0)], 1
    while work:
        least, _, i, j = heapq.heappop(work)
        rows = a.rows[i]
        if -least < kth[rows].min():
            continue
        if not a.children[i] and not b.children[j]:
            cols = b.rows[j]
            s = q[rows] @ x[cols].T
            s[q_id[rows][:, None] == x_id[cols][None]] = none
            ok = (s >= kth[rows][:, None]) & (s != none)
            if s.shape[1] > k:  # no more than the block's own kth can come in
                ok &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]
            for r in np.flatnonzero(ok.any(1)).tolist():
                row = rows[r]
                score, ids = np.concatenate([best_s[row], s[r, ok[r]]]), np.concatenate([best_i[row], x_id[cols[ok[r]]]])
                order = np.lexsort((-ids, score))[::-1][:k]
                best_s[row], best_i[row] = score[order], ids[order]
                kth[row] = max(kth[row], best_s[row, -1])
            continue
        split_a = bool(a.children[i]) and (not b.children[j] or ra[i] > rb[j])
        for i2 in a.children[i] if split_a else [i]:
            js = [j] if split_a else b.children[j]
            for j2, top in zip(js, bound(i2, js).tolist(), strict=True):
                if top >= kth[a.rows[i2]].min():
                    heapq.heappush(work, (-top, n, i2, j2))
                    n += 1
    r, c = np.nonzero(best_s != none)
    return r, best_i[r, c], best_s[r, c].astype(np.int64)


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or holds a null, NaN or infinite component."""
    whole = F.transform(vector.cast("array<double>"), lambda x: F.floor(scale * x))
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.when(F.forall(vector, fine), whole)


class Side:
    """One side of a search, its rows dealt to places: table(id, v, place, far, row). A place is a center, the nearest to its rows, and the radius
    that covers them; its rows are cut by a hash of their row numbers into parts of about `size`, so that equal rows or keys can't fill a task.

    Centers are up to PLACES different rows, one for about `size` rows, by the smallest hashes of those that one in n / (4 * centers)
    takes. Rows of a length that no center has are place -1, which nothing is left out for."""

    def __init__(self, rows: DataFrame, size: int, work: Work):
        n = rows.count()
        many = min(PLACES, max(1, -(-n // size)))
        some = rows.select(F.xxhash64("v").alias("h"), "v").where(F.pmod("h", F.lit(max(1, n))) < 4 * many).dropDuplicates(["h"])
        self.centers = [np.array(r.v, dtype=np.float64) for r in some.orderBy("h").limit(many).collect()]
        centers = self.centers

        @F.pandas_udf("struct<place: int, far: double>")
        def nearest(v: pd.Series) -> pd.DataFrame:
            place, far, sizes = np.full(len(v), -1), np.full(len(v), np.inf), v.map(len).to_numpy(int)
            for d in set(sizes.tolist()):
                at, ks = np.flatnonzero(sizes == d), np.array([k for k, c in enumerate(centers) if len(c) == d], int)
                if len(ks):
                    x, c = np.array(v.iloc[at].tolist(), dtype=np.float64).reshape(len(at), d), np.array([centers[k] for k in ks]).reshape(len(ks), d)
                    near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
                    place[at], far[at] = ks[near], np.sqrt(((x - c[near]) ** 2).sum(1))
            return pd.DataFrame({"place": place, "far": far})

        self.table = work.table(rows.withColumn("to", nearest("v")).select("id", "v", "to.place", "to.far", F.monotonically_increasing_id().alias("row")))
        told = self.table.groupBy("place").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max("far").alias("r")).collect()
        self.rows, self.ids, self.radius = ({t.place: t[c] for t in told} for c in ("n", "ids", "r"))
        self.parts = {p: -(-m // size) for p, m in self.rows.items()}

    def dealt(self, pairs: list[tuple[int, int]], mine: str, other: Side, theirs: str, turn: bool) -> DataFrame:
        """The rows, once for each part of the places that they meet. pairs: at most (PLACES + 1) ** 2, sent to all tasks."""
        known = [(p, o, self.parts[p], other.parts[o]) for p, o in (((b, a) if turn else (a, b)) for a, b in pairs)]
        small = F.broadcast(self.table.sparkSession.createDataFrame(known, f"place int, {theirs} int, own int, parts int"))
        met = self.table.join(small, "place").withColumn(f"{theirs}_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return met.select(F.col("place").alias(mine), F.pmod(F.xxhash64("row"), F.col("own")).cast("int").alias(f"{mine}_part"), theirs, f"{theirs}_part", "id", "v")


def bounds(q: Side, x: Side) -> dict[int, list[tuple[float, int]]]:
    """For each place of queries the places of data, best bound first; places of vectors of another length are left out."""
    out = {}
    for p in q.rows:
        told = []
        for o in x.rows:
            if p < 0 or o < 0:
                told.append((np.inf, o))
            elif len(q.centers[p]) == len(x.centers[o]):
                told.append((float(upper(q.centers[p][None], np.array([q.radius[p]]), x.centers[o][None], np.array([x.radius[o]]))[0, 0]), o))
        out[p] = sorted(told, reverse=True)
    return out


def first_pairs(q: Side, x: Side, k: int) -> list[tuple[int, int]]:
    """For each place of queries the places of the best bounds, until they have more than k rows: (place of queries, place of data)."""
    out = []
    for p, told in bounds(q, x).items():
        n = 0
        for top, o in told:
            if n > k and top < np.inf:
                break
            out.append((p, o))
            n += x.rows[o]
    return out


def other_pairs(q: Side, x: Side, done: list[tuple[int, int]], worst: dict[int, float]) -> list[tuple[int, int]]:
    """The pairs not done whose bound reaches the worst kth score of the place's queries (-inf if not given)."""
    seen = set(done)
    return [(p, o) for p, told in bounds(q, x).items() for top, o in told if (p, o) not in seen and top >= worst.get(p, -np.inf)]


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "v", block: int = 65536, query_block: int = 2048) -> DataFrame:
    """Of each query the k data rows of another key with the highest inner product: query_id, rank (from 1), vec_id, score.

    vector: arrays of integers; scores are exact, and an OverflowError says that one might not fit a long. Rows with a null key or vector
    take no part, nor those whose length differs from a query's. Ties go to the smaller key. All if there are fewer; none for empty
    tables. A query given twice is answered once; of data given twice, every row counts. Other columns are left out, whatever their names.

    Both sides are dealt to places in space, of about the given numbers of rows, and those cut into parts. First every place of queries
    meets the data places of the best bounds, part by part, each pair in a task where both parts get a cover tree. This gives every query
    a kth score. Then only those other pairs of places meet whose covering radii let them reach the worst kth score of the place's
    queries, and every query brings its own kth score. Where the radii leave nothing out (vectors without clusters, of many dimensions) all
    pairs meet, which an exact search can't avoid. The driver sees the centers, radii and numbers of at most PLACES places a side.
    The table behind the result stays in the shared folder until its owner clears that.
    """
    work = Work(data.sparkSession)
    sides = [df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL") for df in (queries, data)]
    q, x = Side(sides[0].distinct(), query_block, work), Side(sides[1], block, work)
    schema = "place int, query_id long, vec_id long, score long"

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d in sorted(set(map(len, a["v"]))) if len(a) and len(b) else []:
            p, r = a[a["v"].map(len) == d], b[b["v"].map(len) == d]
            if len(r):
                q_id, x_id = p["id"].to_numpy(np.int64), r["id"].to_numpy(np.int64)
                left, right = (np.concatenate([np.empty(0, np.int64), *f["v"]]).astype(np.int64).reshape(len(f), d) for f in (p, r))
                rows, ids, scores = dual_search(left, q_id, right, x_id, k, p["known"].astype(float).fillna(-np.inf).to_numpy())
                out.append(pd.DataFrame({"place": int(a["q"].iloc[0]), "query_id": q_id[rows], "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("place", "query_id", "vec_id", "score")}, dtype="int64")

    def met(pairs: list[tuple[int, int]], known: DataFrame | None) -> DataFrame:
        left, right, by = q.dealt(pairs, "q", x, "x", False), x.dealt(pairs, "x", q, "q", True), ["q", "q_part", "x", "x_part"]
        if known is None:
            left = left.withColumn("known", F.lit(None).cast("long"))
        else:
            left = left.join(known.select("place", F.col("query_id"), "known"), (F.col("q") == F.col("place")) & (F.col("id") == F.col("query_id")), "left").select(*by, "id", "v", "known")
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, schema)

    def best(found: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")).cast("int")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    pairs = first_pairs(q, x, k)
    found = work.table(best(met(pairs, None), "place", "query_id").drop("rank"))
    known = work.table(found.groupBy("place", "query_id").agg(F.count("*").alias("n"), F.min("score").alias("known")).where(F.col("n") == k))
    full = known.groupBy("place").agg(F.count("*").alias("n"), F.min("known").alias("worst")).collect()
    pairs = other_pairs(q, x, pairs, {r.place: float(r.worst) for r in full if r.n == q.ids[r.place]})
    if pairs:
        found = found.unionByName(met(pairs, known))
    out = work.table(best(found, "query_id").select("query_id", "rank", "vec_id", "score"), keep=True)
    work.drop()
    return out
