"""Conversation prefix trie: nodes by distinct turn sequences, and subtree totals passed from the leaves to the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.llm.shared import Work, words

#: A conversation c takes its first turns, fewer than MOST, from the conversation c - c % FAMILY.
FAMILY, MOST = 20, 4
#: Keys of a chunk of an ordered list of keys, at most: chunks are the keys that differ in their lowest bits alone.
CHUNK_BITS = 10
_NODE = ["depth", "a", "b"]


def running(df: DataFrame, by: str, order: list[str], sums: list[str], work: Work) -> DataFrame:
    """df with every column of `sums` (longs) replaced by its sum over the rows of the same `by` (a long) up to the row in that order, and
    with the sum before the row as `<column>_before`; sums are modulo 2^64.

    Rows are dealt to tasks by ranges of by and order, so that one value of `by` may fill many tasks. Each task adds up its own rows; then
    its first value's rows get what that value has gathered in the tasks before. The driver sees one row a task."""
    cols = df.columns
    dealt = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("part", F.spark_partition_id())
    at, where, before = cols.index(by), [cols.index(c) for c in sums], [f"{c}_before" for c in sums]
    types = [f"{c} {df.schema[c].dataType.simpleString()}" for c in cols]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, begun, part, kinds = np.zeros(len(sums), np.uint64), None, None, None, None
        names = [*cols, *before, "part", "own"]
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(at).to_numpy()
            begun, part, kinds = (key[0], batch.column("part")[:1], batch.schema) if begun is None else (begun, part, kinds)
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))  # -1: the value goes on from the batch before
            out, earlier = list(batch.columns[: len(cols)]), []
            for j, c in enumerate(where):
                x = batch.column(c).to_numpy().view(np.uint64)
                total = np.cumsum(x, dtype=np.uint64)
                total = total - np.where(start < 0, np.uint64(0) - held[j : j + 1], (total - x)[start])
                out[c] = pa.array(total.view(np.int64))
                earlier.append(pa.array((total - x).view(np.int64)))
                held[j] = total[-1]
            last = key[-1]
            yield pa.RecordBatch.from_arrays([*out, *earlier, batch.column("part"), pa.array(np.where(key == begun, 1, 2).astype(np.int32))], names=names)
        if last is not None:  # one row about the task: its last value, what that has gathered, its first value
            out = [pa.nulls(1, kinds.field(c).type) for c in cols]
            out[at] = pa.array([last], pa.int64())
            for j, c in enumerate(where):
                out[c] = pa.array(held[j : j + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([*out, pa.array([begun], pa.int64()), *[pa.nulls(1, pa.int64())] * (len(sums) - 1), part, pa.array([0], pa.int32())], names=names)

    table = work.table(dealt.mapInArrow(added, ", ".join([*types, *(f"{c} long" for c in before), "part int", "own int"])))
    carry: dict[int, np.ndarray] = {}
    so_far, of = np.zeros(len(sums), np.uint64), None
    for r in table.where("own = 0").select("part", by, F.col(before[0]).alias("begun"), *sums).orderBy("part").collect():
        carry[r.part] = so_far if r.begun == of else np.zeros(len(sums), np.uint64)
        own = np.array([r[c] for c in sums], np.int64).view(np.uint64)
        so_far, of = own + carry[r.part] if r[by] == r.begun else own, r[by]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, first, out = batch.column("part").to_numpy(), batch.column("own").to_numpy() == 1, list(batch.columns[:-2])
            told, row = np.unique(part, return_inverse=True)
            more = np.array([carry[p] for p in told.tolist()], np.uint64).reshape(-1, len(sums))[row] * first[:, None].astype(np.uint64)
            for j, c in enumerate(sums):
                for i in (cols.index(c), len(cols) + j):
                    out[i] = pa.array((out[i].to_numpy().view(np.uint64) + more[:, j]).view(np.int64))
            yield pa.RecordBatch.from_arrays(out, names=[*cols, *before])

    return table.where("own > 0").mapInArrow(carried, ", ".join([*types, *(f"{c} long" for c in before)]))


def rebuilt(turns: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations, (c), and their turns, (c, d, turn, tok): conversation c has the first h turns of c - c % FAMILY, all if that
    has fewer and none if it is absent, and then its own from the h-th on; h is the crc32 of c in decimals, modulo MOST. turns: c, at, turn
    (a digest of role and text), tok; their order is by at, nulls first, and then by turn."""
    placed = work.table(running(turns.withColumn("r", F.lit(1).cast("long")), "c", ["at", "turn"], ["r"], work).select("c", "r", "turn", "tok"))
    size = work.table(placed.groupBy("c").agg(F.max("r").alias("n")))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % MOST
    head = size.select("c", (F.col("c") - F.col("c") % FAMILY).alias("base"), h.alias("h"))
    convs = head.join(size.select(F.col("c").alias("base"), "n"), "base", "left").select("c", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("given"))
    convs = work.table(convs)
    own = placed.join(convs.select("c", "h", "given"), "c").where("r > h").select("c", (F.col("r") - F.col("h") + F.col("given")).alias("d"), "turn", "tok")
    opening = placed.where(F.col("r") < MOST).withColumnRenamed("c", "base").join(convs, "base").where("r <= given").select("c", F.col("r").alias("d"), "turn", "tok")
    return convs.select("c"), own.unionByName(opening)


def listed(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of ends(c, depth, a, b): the hash of each node's keys, ascending, comma-joined. Keys are joined in chunks
    first; a task then hashes a node's chunks one after the other."""
    chunk = F.shiftright("c", CHUNK_BITS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*_NODE, chunk.alias("chunk")).agg(text.alias("keys"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = [*_NODE, "ends_sha256"]
        told = lambda done: pa.RecordBatch.from_arrays([*[pa.array([d[i] for d, _ in done], pa.int64()) for i in range(3)], pa.array([x for _, x in done], pa.string())], names=names)
        for batch in batches:
            done = []
            for *node, keys in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "keys"))):
                if node == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(keys.encode())
            yield told(done)
        if now is not None:
            yield told([(now, state.hexdigest())])

    return chunks.repartition(*[F.col(c) for c in _NODE]).sortWithinPartitions(*_NODE, "chunk").mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see `rebuilt`): conv_id, its smallest member; depth; parent_conv_id; n_convs;
    n_children; n_leaves, the childless nodes of its subtree; saved_tokens, summed over the subtree, (n_convs - 1) times the words of a
    node's last text; ends_sha256, the hash of the members that end there. A node is a sequence of turns, equal in role and text, and known
    by its depth and 128 bits of hash, sums of hashes of the turns and their places; the root has none.

    Totals are passed up by peeling leaves: every node holds the number of children it waits for. Finished nodes send their totals to their
    parents, those that wait for no more are finished next, and so on until the root is. A node whose members are all the same conversation
    to the end has a single path below it and is finished from the start, its totals told by sums along that conversation, so single and
    copied conversations of any length take no rounds; these are as many as the deepest node at which different ones part.

    Null role and text are empty, null turns come first; equal turn numbers are ordered by a hash of role and text. Rows with a null key are
    left out; a conversation without turns (of others' and of its own) is a member of the root. Repeated rows are turns of their own. Other
    columns are left out, whatever their names; an empty table gives no rows. One conversation's turns may fill many tasks. The table
    behind the result stays in the shared folder until its owner clears that."""
    work = Work(conversations.sparkSession)
    told = conversations.select(F.col(key).cast("long").alias("c"), F.col(turn).alias("at"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("c IS NOT NULL")
    digest = F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256))
    convs, turns = rebuilt(told.select("c", "at", digest.alias("turn"), F.size(words(F.col("text"))).cast("long").alias("tok")), work)
    lane = lambda seed: F.xxhash64(F.lit(seed), "d", "turn")
    steps = turns.select("c", F.col("d").alias("depth"), "tok", lane(1).alias("a"), lane(2).alias("b"), F.col("tok").alias("s"))
    steps = work.table(running(steps, "c", ["depth"], ["a", "b", "s"], work).drop("s_before"))
    last = steps.groupBy("c").agg(F.max(F.struct("depth", "a", "b", "s")).alias("e"))
    zero = F.lit(0).cast("long")
    ends = work.table(convs.join(last, "c", "left").select("c", *[F.coalesce(f"e.{c}", zero).alias(f"e_{c}") for c in (*_NODE, "s")]))
    root = ends.select("c", *[zero.alias(c) for c in ("depth", "tok", "a", "b", "s", "a_before", "b_before")], *[f"e_{c}" for c in (*_NODE, "s")])
    members = root.unionByName(steps.join(ends, "c"))
    end = F.struct(*[F.col(f"e_{c}") for c in _NODE])
    firsts = [F.min(c).alias(c) for c in ("a_before", "b_before", "tok", "s", "e_s")]
    nodes = members.groupBy(*_NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), *firsts, (F.min(end) == F.max(end)).alias("single"))
    nodes = work.table(nodes)
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("a_before").alias("a"), F.col("b_before").alias("b")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("a_before"), F.col("b").alias("b_before"), F.col("conv_id").alias("parent_conv_id"))
    over = listed(ends.select("c", *[F.col(f"e_{c}").alias(c) for c in _NODE]))
    nodes = nodes.join(kids, _NODE, "left").join(over, _NODE, "left").join(above, ["depth", "a_before", "b_before"], "left")
    extra = F.col("n_convs") - 1
    open_ = ~F.col("single")
    nodes = nodes.select(
        *_NODE, "a_before", "b_before", "single", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(open_, zero).otherwise(1).cast("long").alias("n_leaves"), (extra * F.when(open_, F.col("tok")).otherwise(F.col("e_s") - F.col("s") + F.col("tok"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.coalesce("n_children", zero).alias("waits"),
    )
    nodes = work.table(nodes, keep=True)
    done, waiting, found = nodes.where("single"), nodes.where("NOT single"), [nodes.where("single")]
    while not waiting.isEmpty():
        sent = done.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("a_before").alias("a"), F.col("b_before").alias("b"))
        sent = sent.agg(F.count("*").alias("k"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        plus = {"waits": F.col("waits") - F.coalesce("k", zero), "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", zero), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", zero)}
        state = work.table(waiting.join(sent, _NODE, "left").withColumns(plus).select(*nodes.columns), keep=True)
        done, waiting = state.where("waits = 0"), state.where("waits > 0")
        found.append(done)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    work.drop()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
