"""Approximate nearest neighbours by a permutation index: pivots in order of distance, inverted files of pivots, footrule, rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.shared import Work

#: Pivots of a vector length, at most: a rank fits a byte, and what the driver and a task know of the index is so many vectors.
PIVOTS = 256
#: Files that a vector is posted in, and that a query reads; candidates by footrule whose distance is measured.
POSTED, PROBES, RERANK = 20, 16, 500
#: Rows of a part of a file, about; lengths of vectors that one index takes.
PART, LENGTHS = 16384, 16


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and has finite components only."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def pivots(rows: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Of each length up to `most` different vectors by their hash, out of about 4 * most rows that a hash picks, or of all where these are too
    few. rows: v, h (the vector's hash)."""
    out = {}
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    for d, n in sizes:
        own = rows.where(F.size("v") == d)
        for share in (own.where(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(n)) < 4 * most), own):
            found = share.groupBy("h").agg(F.min("v").alias("v")).orderBy(F.xxhash64("h", F.lit(7)), "h").limit(most).collect()
            if len(found) == most:
                break
        out[d] = np.array([r.v for r in found], dtype=np.float64)
    return out


def permutations(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The rank of every pivot for each vector, the nearest 0, as bytes."""
    far = (to**2).sum(1) - 2 * vectors @ to.T
    ranks = np.empty(far.shape, dtype=np.uint8)
    np.put_along_axis(ranks, np.argsort(far, axis=1, kind="stable"), np.arange(len(to), dtype=np.uint8)[None], axis=1)
    return ranks


def footrule(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Spearman's footrule of permutations (rows of ranks) and one other."""
    return np.abs(rows.astype(np.int16) - query.astype(np.int16)).sum(1, dtype=np.int32)


def ranked(rows: DataFrame, to: dict[int, np.ndarray]) -> DataFrame:
    """rows(id, v) with their ranks."""
    held = rows.sparkSession.sparkContext.broadcast(to)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, out = batch.column("v"), np.full(batch.num_rows, None, dtype=object)
            sizes = np.diff(v.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
                for i, r in zip(at.tolist(), permutations(x, held.value[d])):
                    out[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(out, pa.binary())], names=["id", "v", "ranks"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(told, f"id long, v {kind}, ranks binary")


def posts(table: DataFrame, files: int, own: str) -> DataFrame:
    """An entry in the file of each of a vector's nearest `files` pivots: d, pivot, own, ranks; d: the vector's length."""
    schema = f"d int, pivot int, {own} long, ranks binary"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [np.flatnonzero(np.frombuffer(r, np.uint8) < files) for r in batch.column("ranks").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(near)), [len(x) for x in near]))
            pivot = pa.array(np.concatenate([np.empty(0, np.int64), *near]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("d").take(row), pivot, batch.column("id").take(row), batch.column("ranks").take(row)], names=["d", "pivot", own, "ranks"])

    return table.select(F.size("v").alias("d"), "id", "ranks").mapInArrow(made, schema)


def search(queries: DataFrame, data: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", most_pivots: int = PIVOTS, posted: int = POSTED, probes: int = PROBES, rerank: int = RERANK, part: int = PART) -> DataFrame:
    """Of each query the k nearest rows of data found, of another key, by Euclidean distance: query_id, rank (from 1), vec_id, score (the
    distance in doubles, of the original vectors). Ties go to the smaller key; all candidates if there are fewer than k.

    Every vector is represented by the order of its pivots, a hashed sample of `most_pivots` different vectors, and posted in the files of
    its `posted` nearest. A query reads the files of its `probes` nearest pivots, ranks what it finds there by the footrule of the whole
    permutations, and measures the distance of the best `rerank`. A pair that shares several files meets in that of the query's nearest
    pivot among them. Files are dealt to tasks in parts of about `part` rows, to each of which its queries go. If data has no more vectors
    of a length than `rerank`, its pivots are each query's files all the same, so a small table may give fewer candidates than it has:
    then every pivot is read and posted, and the result is exact.

    Rows with a null key or vector, or one that is empty, zero or not finite take no part; a query meets vectors of its own length only.
    Of equal vectors only the k + 1 smallest keys can be answers, and only they are posted, so copies don't fill a file. Repeated rows
    count once; of a key with several vectors the nearest counts. Other columns are left out, whatever their names; empty tables give no
    rows. The table behind the result stays in the shared folder until its owner clears that."""
    if not 1 <= most_pivots <= PIVOTS:
        raise ValueError(f"1 to {PIVOTS} pivots")
    work = Work(data.sparkSession)
    sides = [df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))) for df in (queries, data)]
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))
    rows = work.table(sides[1].withColumn("h", F.xxhash64("v")).withColumn("place", place).where(F.col("place") <= k + 1).drop("place"))
    to = pivots(rows, most_pivots)
    to |= {d: to[d][:1] for d, n in rows.groupBy(F.size("v").alias("d")).count().collect() if n <= rerank}
    table = work.table(ranked(rows, to))
    asked = work.table(ranked(sides[0].where(F.size("v").isin(list(to)) if to else F.lit(False)).dropDuplicates(["id", "v"]), to))
    files = work.table(posts(table, posted, "vec_id"))
    parts = {(r.d, r.pivot): -(-r["count"] // part) for r in files.groupBy("d", "pivot").count().collect()}
    many = F.broadcast(data.sparkSession.createDataFrame([(d, p, n) for (d, p), n in parts.items()], "d int, pivot int, parts int"))
    by = ["d", "pivot", "part"]
    left = posts(asked, probes, "query_id").join(many, ["d", "pivot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = files.join(many, ["d", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def meet(found: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("far", pa.int32())])
        if not q.num_rows or not x.num_rows:
            return schema.empty_table()
        d, pivot = found[0].as_py(), found[1].as_py()
        ids, n = x["vec_id"].to_numpy(), len(to[d])
        ranks = np.frombuffer(b"".join(x["ranks"].to_pylist()), np.uint8).reshape(-1, n)
        held, out = ranks < posted, []
        for own, own_ranks in zip(q["query_id"].to_pylist(), q["ranks"].to_pylist()):
            r = np.frombuffer(own_ranks, np.uint8)
            before = np.flatnonzero(r < r[pivot])
            at = np.flatnonzero(~held[:, before].any(1) & (ids != own))
            far = footrule(ranks[at], r)
            if len(at) > rerank:
                best = np.lexsort((ids[at], far))[:rerank]
                at, far = at[best], far[best]
            out.append(pa.table([np.full(len(at), own, np.int64), ids[at], far.astype(np.int32)], schema=schema))
        return pa.concat_tables(out)

    met = left.select(*by, "query_id", "ranks").groupBy(*by).cogroup(right.select(*by, "vec_id", "ranks").groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, far int")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "vec_id"))
    near = work.table(met.withColumn("order", order).where(F.col("order") <= rerank).select("query_id", "vec_id").distinct())
    pairs = near.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(table.select(F.col("id").alias("vec_id"), "v"), "vec_id").where(F.size("q") == F.size("v"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("q", "v"))
            ends = batch.column("q").offsets.to_numpy()
            ends = ends - ends[0]
            d = np.sqrt(np.add.reduceat((q - v) ** 2, ends[:-1])) if len(q) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(d)], names=["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "q", "v").mapInArrow(measured, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    out = work.table(scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), keep=True)
    work.drop()
    return out
