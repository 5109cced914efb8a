"""Doublet scores by sample: cells are compared with sums of two cells of their sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.functions.values import as_group
from cytoloom.operators import reduction
from cytoloom.sources.scratch import Scratch

#: Cells of a sample at least; rows of a place, about; places of a group at most; rows that a task compares with others, about; places that a
#: row is compared with; bins of the histogram; entries of packed rows and distances that a task holds at a time.
LEAST_CELLS, PLACE, GROUP, PART, PROBES, BINS, HELD = 30, 4096, 64, 1 << 18, 2, 256, 1 << 22


def placed(cells: DataFrame, group: str, key: str = "cell_id", seed: int = 0, bucket: int = 4096) -> DataFrame:
    """group, key, n (rows of the group) and r, the row's place from 0 in an order of the group by a hash. Groups are cut into buckets of the
    hash, so that one of any size is ranked in many tasks; only the numbers of rows of its buckets are added up together."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    size = cells.groupBy(group).agg(F.count("*").alias("n"))
    rows = cells.select(group, key, h.alias("h")).join(size, group)
    rows = rows.withColumn("bucket", F.floor((F.col("h") / 2.0**64 + 0.5) * F.ceil(F.col("n") / bucket)).cast("long"))
    many = rows.groupBy(group, "bucket").agg(F.count("*").alias("m"))
    before = many.select(group, "bucket", (F.sum("m").over(Window.partitionBy(group).orderBy("bucket")) - F.col("m")).alias("before"))
    own = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("h", key)) - 1
    return rows.withColumn("own", own).join(before, [group, "bucket"]).select(group, key, "n", (F.col("before") + F.col("own")).alias("r"))


def _step(seed: int) -> Column:
    return 1 + F.pmod(F.xxhash64("sample", "t", F.lit(seed)), F.col("n") - 1)


def simulated(counts: DataFrame, ranks: DataFrame, ratio: int = 2, seed: int = 0) -> DataFrame:
    """(sample, sim, gene, cnt): `ratio` times as many simulated doublets as cells, each the sum of two cells of a sample. The t-th time the cell
    at place r of a hashed order meets the one a hashed step further, so that every cell is in as many doublets. ranks: sample, cell_id, n, r;
    sim: t * n + r."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("t")
    told = ranks.select("sample", "cell_id", "n", "r", steps)
    pairs = F.explode(F.array(F.col("r"), F.pmod(F.col("r") - _step(seed), F.col("n"))))
    parents = told.select("sample", "cell_id", "n", "t", pairs.alias("at")).select("sample", "cell_id", (F.col("t") * F.col("n") + F.col("at")).alias("sim"))
    return counts.join(parents.hint("merge"), "cell_id").groupBy("sample", "sim", "gene").agg(F.sum("cnt").alias("cnt"))


def _slices(batch: pa.RecordBatch, *lists: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose lists have about HELD entries, a longer row alone."""
    ends = np.cumsum(sum(pc.list_value_length(batch.column(c)).to_numpy() for c in lists)) // HELD
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    return (batch.slice(i, j - i) for i, j in zip(edges, edges[1:]) if i < j)


def _lists(rows: int, row: np.ndarray, at: np.ndarray, cnt: np.ndarray, genes: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Entries in the order of rows and places, those of a row and place added up: where rows end, and row, place and count of each."""
    key = row * genes + at
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    cnt = np.add.reduceat(cnt[order], first) if len(first) else np.zeros(0)
    row, at = np.divmod(key[order][first], genes)
    return np.searchsorted(row, np.arange(rows + 1)).astype(np.int32), row, pa.array(at.astype(np.int16)), cnt


def _entries(batch: pa.RecordBatch, at: str, cnt: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    many = pc.list_value_length(batch.column(at)).to_numpy()
    return np.repeat(np.arange(batch.num_rows), many), batch.column(at).flatten().to_numpy(), batch.column(cnt).flatten().to_numpy()


def packed_cells(counts: DataFrame, ranks: DataFrame, names: list[str]) -> DataFrame:
    """ranks (sample, cell_id, n, r) with each cell's `total`, and the places `at` among the names and counts `cnt` of its genes: a row a cell."""
    place = F.broadcast(counts.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], "gene string, at short"))
    one = F.when(F.col("at").isNotNull(), F.struct("at", "cnt"))
    rows = counts.join(place, "gene", "left").groupBy("cell_id").agg(F.sum("cnt").alias("total"), F.collect_list(one).alias("row"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    every = ranks.join(rows.hint("merge"), "cell_id", "left").select("sample", "cell_id", "n", "r", F.coalesce("total", F.lit(0.0)).alias("total"), none(F.col("row.at"), "array<short>").alias("at"), none(F.col("row.cnt"), "array<double>").alias("cnt"))
    kept, g = ["sample", "cell_id", "n", "r", "total"], max(1, len(names))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in _slices(whole, "at")):
            ends, _, at, cnt = _lists(b.num_rows, *_entries(b, "at", "cnt"), g)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.ListArray.from_arrays(ends, at), pa.ListArray.from_arrays(ends, cnt)], names=[*kept, "at", "cnt"])

    return every.mapInArrow(ordered, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in every.schema))


def log_values() -> Column:
    """The values of a packed cell, as `qc.log_normalised` has them."""
    return F.transform("cnt", lambda c: F.log1p(c / F.col("total") * 1e4))


def packed_doublets(cells: DataFrame, ratio: int, genes: int, seed: int = 0) -> DataFrame:
    """(sample, sim, n, at, v): the doublets of `simulated`, log-normalised and packed. cells: as `packed_cells` gives them; each is sent once
    as the doublets' first cell and `ratio` times as their second."""
    told = cells.select("sample", "n", "r", F.col("total").alias("more"), F.col("at").alias("at2"), F.col("cnt").alias("cnt2"), F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))).alias("t"))
    second = told.withColumn("r", F.pmod(F.col("r") - _step(seed), F.col("n"))).drop("n")
    met = cells.drop("cell_id").join(second.hint("merge"), ["sample", "r"])
    met = met.select("sample", (F.col("t") * F.col("n") + F.col("r")).alias("sim"), "n", (F.col("total") + F.col("more")).alias("total"), "at", "cnt", "at2", "cnt2")
    g = max(1, genes)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in _slices(whole, "at", "at2")):
            both = (np.concatenate(p) for p in zip(_entries(b, "at", "cnt"), _entries(b, "at2", "cnt2")))
            ends, row, at, cnt = _lists(b.num_rows, *both, g)
            v = np.log1p(cnt / b.column("total").to_numpy()[row] * 1e4)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("sample", "sim", "n")), pa.ListArray.from_arrays(ends, at), pa.ListArray.from_arrays(ends, v)], names=["sample", "sim", "n", "at", "v"])

    return met.mapInArrow(added, "sample string, sim long, n long, at array<short>, v array<double>")


def valley(many: np.ndarray, most: int = 10_000) -> int | None:
    """The bin of the lowest count between the two peaks of a histogram that is smoothed until it has two; None if it never has."""
    h = many.astype(float)
    for _ in range(most):
        rise = np.sign(np.diff(h))
        for i in np.flatnonzero(rise == 0):  # a plateau goes on as it began
            rise[i] = rise[i - 1] if i else 1
        peaks = np.flatnonzero((rise[:-1] > 0) & (rise[1:] < 0)) + 1
        if len(peaks) == 2:
            return int(peaks[0] + h[peaks[0] : peaks[1] + 1].argmin())
        if len(peaks) < 2:
            return None
        h = np.convolve(np.pad(h, 1, mode="edge"), np.ones(3) / 3, mode="valid")
    return None


def _centers(points: DataFrame, seed: int) -> dict[str, tuple[int, np.ndarray | None]]:
    """Of each sample the number of its cells and a center for about PLACE points, by a hash."""
    size = points.groupBy("sample").agg(F.count("*").alias("all"), F.max("n").alias("n"))
    order = F.xxhash64("id", "sim", F.lit(seed))
    some = points.drop("n").join(F.broadcast(size), "sample").where(F.pmod(order, F.col("all")) < 4 * F.ceil(F.col("all") / PLACE))  # a row a sample
    place = F.row_number().over(Window.partitionBy("sample").orderBy(order, "id"))
    rows = some.withColumn("place", place).where(F.col("place") <= F.ceil(F.col("all") / PLACE)).select("sample", "v").collect()
    out: dict[str, list] = {r["sample"]: [] for r in size.collect()}
    for r in rows:
        out[r["sample"]].append(r.v)
    return {r["sample"]: (r.n, np.array(out[r["sample"]], dtype=float) if out[r["sample"]] else None) for r in size.collect()}


def grouped(centers: np.ndarray, most: int) -> np.ndarray:
    """The group of each center, from 0: halves along the direction in which they vary most, until none has over `most`."""
    of, last, left = np.zeros(len(centers), dtype=int), 0, [np.arange(len(centers))]
    while left:
        at = left.pop()
        if len(at) > most:
            c = centers[at] - centers[at].mean(0)
            order = np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")
            left += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        else:
            of[at] = last
            last += 1
    return of


def _nearest_sims(x: np.ndarray, own: np.ndarray, y: np.ndarray, cells: int, order: np.ndarray, k: int) -> np.ndarray:
    """How many of the k rows of y nearest to each row of x are simulated, those from `cells` on; own: the row's place in y, which doesn't count.
    Ties go by `order`."""
    long, out = (y**2).sum(1), [np.empty(0, int)]
    step = max(1, HELD // len(y))
    for begin in range(0, len(x), step):
        z = x[begin : begin + step]
        d = long - 2 * z @ y.T
        d[np.arange(len(z)), own[begin : begin + step]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        under, at = d < last, d == last
        sims = np.count_nonzero(under[:, cells:], axis=1)
        free, ties = k - np.count_nonzero(under, axis=1), np.count_nonzero(at, axis=1)
        sims += np.where(ties == free, np.count_nonzero(at[:, cells:], axis=1), 0)
        for i in np.flatnonzero(ties > free):
            tied = np.flatnonzero(at[i])
            sims[i] += np.count_nonzero(tied[np.argsort(order[tied], kind="stable")[: free[i]]] >= cells)
        out.append(sims)
    return np.concatenate(out)


def neighbour_shares(points: DataFrame, ratio: int, scratch: Scratch, seed: int = 0) -> DataFrame:
    """(sample, id, sim, n, k, doublets): how many of the k nearest points of a point's sample are simulated. points: sample, id, sim (whether it
    is), n (cells of the sample), v; k is half the root of n, times 1 + ratio.

    Points are dealt to places, the nearest of hashed centers, and compared with those of their PROBES nearest places: with all of samples of
    one or two places, approximately in larger ones. A task has the points of a group of near places, and those of all places that they are
    compared with: what leaves it is a number a point, so that no distances are sent. A group of many points is dealt to several tasks.
    Vectors are compared as floats."""
    spark = points.sparkSession
    places, groups = {}, []
    first = 0
    for s, (n, c) in sorted(_centers(points, seed).items()):
        of = grouped(c, GROUP) if c is not None else np.zeros(1, dtype=int)
        places[s] = (c, first, of + len(groups))
        first += len(of)
        groups += [(s, n)] * (int(of.max()) + 1)
    held = spark.sparkContext.broadcast((places, groups))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples, out = np.array(b.column("sample").to_pylist(), dtype=object), np.zeros((b.num_rows, PROBES), dtype=np.int32)
            to = np.zeros(b.num_rows, dtype=np.int32)
            v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            for s in set(samples.tolist()):
                at = np.flatnonzero(samples == s)
                c, begin, of = held.value[0][s]
                c = np.zeros((1, v.shape[1])) if c is None else c
                best = np.argsort((c**2).sum(1) - 2 * v[at] @ c.T, axis=1, kind="stable")[:, :PROBES]
                out[at], to[at] = begin + best[:, np.minimum(np.arange(PROBES), best.shape[1] - 1)], of[best[:, 0]]
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * PROBES
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "sim", "v")), pa.ListArray.from_arrays(ends, pa.array(out.ravel())), pa.array(to)], names=["id", "sim", "v", "places", "own"])

    dealt = points.select("sample", "id", "sim", F.col("v").cast("array<float>").alias("v"))
    dealt = scratch.table(dealt.mapInArrow(near, "id long, sim boolean, v array<float>, places array<int>, own int"))
    parts = dealt.groupBy("own").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asks = dealt.select("own", F.explode("places").alias("place")).distinct().join(F.broadcast(parts), "own")  # some rows a place
    asks = scratch.table(asks.withColumnRenamed("own", "task"))
    part = F.pmod(F.xxhash64("id", "sim"), F.col("parts")).cast("int")
    rows = dealt.withColumn("place", F.get("places", F.lit(0))).join(F.broadcast(asks), "place")
    rows = rows.select("task", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "sim", "v", "places", ((F.col("own") == F.col("task")).cast("int") * (part + 1) - 1).alias("asked"))
    rows = rows.select("task", "part", "id", "sim", "v", "places", (F.col("asked") == F.col("part")).alias("asked"))
    told = pa.schema([("sample", pa.string()), ("id", pa.int64()), ("sim", pa.bool_()), ("n", pa.int64()), ("k", pa.int64()), ("doublets", pa.int64())])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        sample, n = held.value[1][key[0].as_py()]
        ids, sim, asked = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("id", "sim", "asked"))
        places = rows["places"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = (2 * ids.astype(np.uint64) + sim) * np.uint64(0x9E3779B97F4A7C15)
        by = np.lexsort((order, sim, places[:, 0]))
        ids, sim, asked, places, order = ids[by], sim[by], asked[by], places[by], order[by]
        v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[by].astype(float)
        at = np.flatnonzero(asked)
        pairs, of = np.unique(places[at], axis=0, return_inverse=True)
        turn = np.argsort(of.ravel(), kind="stable")
        cuts = np.searchsorted(of.ravel()[turn], np.arange(len(pairs) + 1))
        k, got = np.zeros(len(at), dtype=int), np.zeros(len(at), dtype=int)
        key2 = 2 * places[:, 0].astype(np.int64) + sim  # rows by place, cells before doublets
        for p, pair in enumerate(pairs):
            some = turn[cuts[p] : cuts[p + 1]]
            spans = [tuple(np.searchsorted(key2, [2 * q + s, 2 * q + s + 1])) for s in (0, 1) for q in dict.fromkeys(pair.tolist())]
            met = np.concatenate([np.arange(*s) for s in spans])
            cells = sum(int(b - a) for a, b in spans[: len(spans) // 2])
            k[some] = most = min(_k(n, ratio), len(met) - 1)
            if most:
                back = np.argsort(met)
                own = back[np.searchsorted(met, at[some], sorter=back)]
                got[some] = _nearest_sims(v[at[some]], own, v[met], cells, order[met], most)
        columns = [pa.array([sample] * len(at), pa.string()), pa.array(ids[at]), pa.array(sim[at]), pa.array(np.full(len(at), n)), pa.array(k), pa.array(got)]
        return pa.Table.from_arrays(columns, schema=told)

    tasks = max(1, asks.select("task", "parts").distinct().agg(F.sum("parts")).first()[0] or 1)
    return rows.repartition(4 * int(tasks), "task", "part").groupBy("task", "part").applyInArrow(meet, "sample string, id long, sim boolean, n long, k long, doublets long")


def _k(n: int, ratio: int) -> int:
    return max(1, int(np.floor(np.floor(0.5 * np.sqrt(n) + 0.5) * (1 + ratio) + 0.5)))


def scores(counts: DataFrame, cells: DataFrame, sample: str, genes: DataFrame | None = None, ratio: int = 2, rate: float = 0.05, components: int = 30, least_cells: int = LEAST_CELLS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cell_id, sample, doublet_score, predicted_doublet) of every cell, and (sample, n_cells, reason) of the samples that were skipped or
    got no threshold.

    In each sample `ratio` doublets a cell are simulated (see `simulated`); both kinds are log-normalised and put into the principal components
    of the cells, fitted once for all samples over `genes` (gene; all if not given); from the share of simulated ones among a cell's nearest
    points in its sample follows its chance of being one, at an expected `rate` (Wolock 2019). Above the valley of the simulated doublets' scores
    cells are called doublets; where their histogram has no two peaks none is (`no_threshold`).

    Samples of fewer than `least_cells` cells are skipped (`too_few_cells`), their scores are null and no call is made. Null samples are one
    sample, null and repeated cell ids are left out or count once; cells without counts are at the point of no expression. cell_id must be a
    whole number. No sample has to fit a task."""
    scratch = Scratch(counts.sparkSession)
    known = cells.select("cell_id", as_group(F.col(sample)).alias("sample")).where("cell_id IS NOT NULL").dropDuplicates(["cell_id"])
    known = scratch.table(known, keep=True)
    ranks = placed(known, "sample", seed=seed)
    few = scratch.table(known.groupBy("sample").agg(F.count("*").alias("n_cells")), keep=True)
    ranks = scratch.table(ranks.where(F.col("n") >= least_cells))
    long = Scratch(counts.sparkSession)
    own = long.table(counts.select("cell_id", "gene", F.col("cnt").cast("double").alias("cnt")).where("cnt > 0"))  # read twice, made once
    scratch.sweep()
    names = reduction.named(own if genes is None else genes)
    held = scratch.table(packed_cells(own, ranks, names))
    long.drop()
    scratch.sweep()
    model = reduction.of_packed(held.select("cell_id", "at", log_values().alias("v")), names, ranks.count(), components, 1e-4, seed=seed)
    first = reduction.projected(held.select("sample", "n", "cell_id", "at", log_values().alias("v")), model)
    second = reduction.projected(packed_doublets(held, ratio, len(names), seed), model)
    base = ranks.groupBy("sample", "n").count().select("sample", (F.sum(F.col("n") * ratio).over(Window.orderBy("sample")) - F.col("n") * ratio).alias("base"))  # a row a sample
    second = second.join(F.broadcast(base), "sample").withColumn("sim", F.col("base") + F.col("sim"))
    point = lambda df, c, sim: df.select("sample", F.col(c).cast("long").alias("id"), F.lit(sim).alias("sim"), "n", F.col("scores").cast("array<float>").alias("v"))
    points = scratch.table(point(first, "cell_id", False).unionByName(point(second, "sim", True)))
    scratch.sweep()
    q = (F.col("doublets") + 1) / (F.col("k") + 2)
    chance = q * rate / ratio / (1 - rate - q * (1 - rate - rate / ratio))
    told = scratch.table(neighbour_shares(points, ratio, scratch, seed).select("sample", "id", "sim", chance.alias("score")), keep=True)
    scratch.sweep()
    sims = told.where("sim")
    span = sims.groupBy("sample").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    place = F.least(F.lit(BINS - 1), F.floor((F.col("score") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) * BINS)).cast("int")
    bins = sims.join(F.broadcast(span), "sample").groupBy("sample", "low", "high", place.alias("bin")).count()

    def cut(one: pd.DataFrame) -> pd.DataFrame:
        many = np.zeros(BINS)
        many[one["bin"].to_numpy()] = one["count"].to_numpy()
        at, low, high = valley(many), one["low"].iloc[0], one["high"].iloc[0]
        return pd.DataFrame({"sample": one["sample"].iloc[:1], "cut": [None if at is None else low + (at + 0.5) * (high - low) / BINS]})

    cuts = scratch.table(bins.groupBy("sample").applyInPandas(cut, "sample string, cut double"), keep=True)
    found = told.where("NOT sim").select(F.col("id").alias("cell_id"), "score")
    out = known.join(found.hint("merge"), "cell_id", "left").join(F.broadcast(cuts), "sample", "left")
    out = out.select("cell_id", "sample", F.col("score").alias("doublet_score"), F.coalesce(F.col("score") > F.col("cut"), F.lit(False)).alias("predicted_doublet"))
    reason = F.when(F.col("n_cells") < least_cells, "too_few_cells").when(F.col("cut").isNull(), "no_threshold")
    skipped = few.join(F.broadcast(cuts), "sample", "left").withColumn("reason", reason).where("reason IS NOT NULL").select("sample", "n_cells", "reason")
    scratch.drop()
    return out, skipped
