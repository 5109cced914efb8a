"""Near-duplicates by Order MinHash: sketches that keep the order of sampled k-mers, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.shared import Work, words

#: Words of a k-mer; k-mers in a sketch; sketches. k-mers are short, so that enough of them outlive edits: if a share e of the words is
#: changed at random, (1 - e) ** 3 of the k-mers are left, and a sketch agrees with a chance of about the square of their Jaccard index.
#: Measured, all 24 differ in under 0.1 % of pairs of long texts at e = 0.1, 2 % at 0.15 and 8 % at 0.2.
K, PICKED, SKETCHES = 3, 2, 24
#: Texts of up to SHORT words get as many sketches of single words too, of so many words by their length, as few k-mers of a short text
#: outlive an edit: with a fifth of the words changed two thirds of the different words are shared at any length.
SHORT, PICKED_WORDS = 75, ((12, 2), (30, 3), (75, 4))
#: Rarer words that a row of a text's rare word carries, so that two texts meet at the first that they share. Texts of up to about 1275
#: words have no more; longer ones that share none of these may meet at several.
CARRIED = 256
#: The least edit similarity of words of linked texts: 1 - edit distance / words of the longer text.
SIMILAR = 0.8
#: A bucket of more texts that isn't one class after the first alignments is searched by rare words instead of pair by pair.
SMALL = 32
#: Pairs that a task aligns for one group of texts, about, and texts of a group that meet the others together.
PARTNERS, TOGETHER = 512, 64
#: Longs of a text's parities: 2048 bits, so that they still tell apart texts of a thousand words that differ in a fourth of them.
PARITIES = 32
#: Cells of the histogram that says which words are rare; it has this size however many texts there are.
CELLS, BLOCK = 1 << 22, 1 << 16
#: Cells of the table of main classes, and words that are taken from a batch together.
MAINS, WORDS = 1 << 20, 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of hashed words in text order, each with the number of its occurrence in it, so that all differ. A text of
    fewer than k words is one k-mer, an empty one none."""
    w = np.asarray(words).astype(np.int64).view(np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, np.uint64(len(w)) if len(w) < k else np.uint64(k))
    for j in range(min(k, len(w))):
        h = _mix((h * _A) ^ w[j : j + n])
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    begun = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    times = np.empty(n, dtype=np.uint64)
    times[order] = np.arange(n) - begun
    return _mix(h + times * _A)


def sketches(words: np.ndarray, many: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """For each of `many` hash functions the `picked` labelled k-mers that it ranks lowest, in text order, hashed to one number; for a short
    text also such numbers of its labelled words."""
    long = _sketches(labelled_kmers(words), 1, many, picked)
    if len(words) > SHORT:
        return long
    few = next(p for most, p in PICKED_WORDS if len(words) <= most)
    return np.concatenate([long, _sketches(labelled_kmers(words, 1), 1001, many, few)])


def _sketches(labelled: np.ndarray, seed: int, many: int, picked: int) -> np.ndarray:
    if not len(labelled):
        return np.empty(0, dtype=np.int64)
    p, seeds = min(picked, len(labelled)), np.arange(seed, seed + many, dtype=np.uint64)
    out = np.empty((many, p), dtype=np.uint64)
    step = max(1, (1 << 18) // len(labelled))
    for at in range(0, many, step):
        ranks = _mix(labelled ^ (seeds[at : at + step, None] * _A))
        lowest, rows = np.empty((len(ranks), p), dtype=np.int64), np.arange(len(ranks))
        for j in range(p):
            lowest[:, j] = ranks.argmin(axis=1)
            ranks[rows, lowest[:, j]] = np.iinfo(np.uint64).max
        out[at : at + step] = labelled[np.sort(lowest, axis=1)]
    keys = seeds
    for j in range(p):
        keys = _mix((keys * _A) ^ out[:, j])
    return keys.view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The fewest words to insert, delete or replace to make b of a, None if more than `most`.

    Only places within `most` of the diagonal are filled in, column by column; the differences between neighbours of a column are the
    bits of whole numbers, as wide as the band (Myers 1999, Hyyrö 2003). Bits of a word's places are kept from where they begin."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    begin = n if same.all() else int(same.argmin())
    a, b = a[begin:], b[begin:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    end = n if same.all() else int(same.argmin())
    x, y = a[: len(a) - end].tolist(), b[: len(b) - end].tolist()
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return n + m
    down, up = min(most, n), min(most, m)
    width = up + down + 1
    whole, top = (1 << width) - 1, 1 << (width - 1)
    seen: dict[int, tuple[int, int]] = {}  # of a word: a row, and the rows from there on that hold it

    def enter(row: int) -> None:
        base, bits = seen.get(x[row], (row, 0))
        if row - base > width:
            bits >>= row - base - width
            base = row - width
        seen[x[row]] = (base, bits | 1 << (row - base)) if bits else (row, 1)

    for row in range(down):
        enter(row)
    plus, minus, now, slack = whole ^ ((1 << up) - 1), 0, down, most + m - (n - down)
    for j, word in enumerate(y):
        low = j - up  # the row of bit 0
        if j + down < n:
            enter(j + down)
        found = seen.get(word)
        equal = 0
        if found:
            shift = found[0] - low
            equal = (found[1] << shift if shift >= 0 else found[1] >> -shift) & whole
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & whole
        right_plus, right_minus = (minus | ~(diagonal | plus)) & whole, diagonal & plus
        if j + down < n:
            now += not diagonal & top
        else:
            last = n - 1 - low
            now += (right_plus >> last & 1) - (right_minus >> last & 1)
        if now > slack:
            return None
        plus, minus = (right_minus | ~(diagonal >> 1 | right_plus)) & whole, diagonal >> 1 & right_plus
    return now if now <= most else None


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Edit similarity of two texts of hashed words, 1 - edit distance / words of the longer one; 0 if it is below `least` or a text has no
    words. Texts with too few words in common, in whatever order, aren't aligned."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if not len(a) or not len(b) or abs(len(a) - len(b)) > most:
        return 0.0
    if longer > 2 * most and len(np.intersect1d(labelled_kmers(a, 1), labelled_kmers(b, 1), assume_unique=True)) < longer - most:
        return 0.0
    far = edit_distance(a, b, most)
    return 0.0 if far is None else 1 - far / longer


def rare_first(labelled: np.ndarray, counts: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """The labelled words of a text of which any other of an edit similarity of `least` or more has one among its own, and their places: as
    the two have at least least * n words in common, the first n - least * n + 1 in an order that all texts share, by the count of the
    word's cell and then the word itself. Those of a count of 1 are in no other text and not given."""
    n = len(labelled)
    many = n - int(np.ceil(least * n - 1e-9)) + 1
    count = counts[labelled % np.uint64(len(counts))]
    order = np.lexsort((labelled, count))[:many]
    at = np.flatnonzero(count[order] > 1)
    return labelled[order[at]], at


def by_words(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about WORDS words of its lists, so that what is made of them stays small whatever Spark's batches are."""
    upto = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()), dtype=np.int64) // WORDS
    edges = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(batch)]
    return (batch.slice(i, j - i) for i, j in zip(edges, edges[1:]) if i < j)


def rare_rows(batch: pa.RecordBatch, counts: np.ndarray, least: float = SIMILAR, mains: tuple[np.ndarray, np.ndarray] | None = None, own: bool = False) -> Iterator[pa.RecordBatch]:
    """A row for each rare word (`rare_first`, cut to 32 bits) of each text: the text's tid, comp, number of words and bits, the word, its
    place, and up to CARRIED of the text's rarer words. Two texts first meet where these have none in common. Words that 32 bits don't tell
    apart are one word throughout, which makes texts meet that needn't. batch: tid, comp, labelled words, bits.

    With mains (`main_classes`) the batch has the class's number too, and rows, with the main class's number, are those of words that
    several classes may have, `own`: where the text's is the main class, else where it isn't."""
    for some in by_words(batch, 2):
        told = [(len(w), *rare_first(w.view(np.uint64) & np.uint64(0xFFFFFFFF), counts, least)) for w in lists(some.column(2))]
        if mains is None:
            given = [np.arange(len(at)) for _, _, at in told]
        else:
            cells = [(w % np.uint64(MAINS)).astype(np.int64) for _, w, _ in told]
            given = [np.flatnonzero(mains[1][c] & ((mains[0][c] == k) == own)) for c, k in zip(cells, some.column(4).to_numpy())]
        many = [len(g) for g in given]
        row, n = pa.array(np.repeat(np.arange(len(told)), many)), np.repeat([n for n, _, _ in told], many)
        cut = [w.astype(np.uint32).view(np.int32) for _, w, _ in told]
        carried = [np.minimum(g, CARRIED) for g in given]
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *carried]))]).astype(np.int32)
        before = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *(w[:k] for w, c in zip(cut, carried) for k in c.tolist())]))
        found, at = np.concatenate([np.empty(0, np.int32), *(w[g] for w, g in zip(cut, given))]), np.concatenate([np.empty(0, np.int64), *(at[g] for (_, _, at), g in zip(told, given))])
        made = {"tid": some.column(0).take(row), "comp": some.column(1).take(row), "n": pa.array(n, pa.int32()), "word": pa.array(found), "at": pa.array(at, pa.int32()), "bits": some.column(3).take(row), "before": before}
        if mains is not None:
            made["main"] = pa.array(np.concatenate([np.empty(0, np.int64), *(mains[0][c[g]] for c, g in zip(cells, given))]))
        yield pa.RecordBatch.from_pydict(made)


def parities(labelled: np.ndarray) -> np.ndarray:
    """64 * PARITIES bits, whether an even or odd number of labelled words falls on each. Where those of two texts of n and m words differ,
    a word of one isn't in the other, so they have at most (n + m - differing bits) / 2 in common (Sandes et al. 2017)."""
    odd = np.bincount(_mix(labelled * _B) % np.uint64(64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of longs of a batch's column, as views; a null one is empty."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))


def _packed(counts: np.ndarray) -> bytes:
    """The cells of a block that aren't 0: their places (uint16), then their counts (int64)."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<i8").tobytes()


def _added(packed: Iterator[bytes]) -> np.ndarray:
    out = np.zeros(BLOCK, dtype=np.int64)
    for b in packed:
        n = len(b) // 10
        out[np.frombuffer(b, "<u2", n)] += np.frombuffer(b, "<i8", n, 2 * n)
    return out


def counted_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The histogram of a task's labelled words (lists, in the first column), in packed blocks of BLOCK cells; empty blocks are left out."""
    cells = np.zeros(CELLS, dtype=np.uint32)
    for some in (x for batch in batches for x in by_words(batch, 0)):
        found = some.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        np.add.at(cells, found % np.uint64(CELLS), 1)
    held = [(k, _packed(c)) for k, c in enumerate(cells.reshape(-1, BLOCK)) if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([c for _, c in held], pa.binary())], names=["block", "many"])


def added_blocks(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    """The sum of one block's counts."""
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "many": pa.array([_packed(_added(x.as_py() for x in blocks["many"]))], pa.binary())})


def gathered(some: DataFrame, added: Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]) -> pa.Table:
    """The tasks' packed blocks, added in two steps, so that no group holds more than a 256th of them, and the driver gets one of each, whose
    size is fixed."""
    schema = "block bigint, many binary"
    some = some.withColumn("salt", F.spark_partition_id() % 256)
    return some.groupBy("block", "salt").applyInArrow(added, schema).groupBy("block").applyInArrow(added, schema).toArrow()


def histogram(found: DataFrame) -> np.ndarray:
    """Counts of CELLS cells of the labelled words (lists of longs, the only column), in 16 bits, as every task gets them: those over 2^15
    are put on a scale of logarithms, which keeps their order."""
    told = gathered(found.mapInArrow(counted_cells, "block bigint, many binary"), added_blocks)
    cells = np.zeros((CELLS // BLOCK, BLOCK), dtype=np.int64)
    for block, many in zip(told["block"].to_pylist(), told["many"].to_pylist()):
        cells[block] = _added([many])
    for block in cells:
        over = block >= 1 << 15
        block[over] = np.minimum((1 << 15) + 1024 * np.log2(block[over] / (1 << 15)), np.iinfo(np.uint16).max)
    return cells.ravel().astype(np.uint16)


class Mains:
    """Of each cell of words the class that a task has most of, how many, and whether there are several classes."""

    def __init__(self, cells: int):
        self.of, self.n, self.several = np.zeros(cells, "<i8"), np.zeros(cells, "<i4"), np.zeros(cells, "u1")

    def take(self, cell: np.ndarray, of: np.ndarray, n: np.ndarray, several: np.ndarray) -> None:
        """Takes in other cells, each once, with their classes."""
        self.several[cell] |= several | ((self.n[cell] > 0) & (self.of[cell] != of))
        more = (n > self.n[cell]) | ((n == self.n[cell]) & (of > self.of[cell]))
        self.of[cell[more]], self.n[cell[more]] = of[more], n[more]

    def count(self, cell: np.ndarray, of: np.ndarray) -> None:
        """Takes in words' cells and classes."""
        if not len(cell):
            return
        order = np.lexsort((of, cell))
        cell, of = cell[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])]))
        cell, of, n = cell[at], of[at], np.diff(np.append(at, len(cell)))
        order = np.lexsort((of, n, cell))
        cell, of, n = cell[order], of[order], n[order]
        last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
        self.take(cell[last], of[last], n[last], np.diff(last, prepend=-1) > 1)

    def pack(self) -> bytes:
        at = np.flatnonzero(self.n)
        return b"".join(x.tobytes() for x in (at.astype("<u2"), self.of[at], self.n[at], self.several[at]))

    def unpack(self, b: bytes) -> None:
        n = len(b) // 15
        self.take(np.frombuffer(b, "<u2", n), np.frombuffer(b, "<i8", n, 2 * n), np.frombuffer(b, "<i4", n, 10 * n), np.frombuffer(b, "u1", n, 14 * n))


def added_mains(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    """What the tasks' Mains of one block come to."""
    out = Mains(BLOCK)
    for b in blocks["many"]:
        out.unpack(b.as_py())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "many": pa.array([out.pack()], pa.binary())})


def main_classes(found: DataFrame, counts: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """For each of MAINS cells of rare words (found: labelled words, number of the class) a class that has many of them, and whether several
    classes have any. Which class it is decides who looks for whom, not what is found."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Mains(MAINS)
        for batch in batches:
            told = [rare_first(w.view(np.uint64) & np.uint64(0xFFFFFFFF), counts, least)[0] for w in lists(batch.column(0))]
            cells = np.concatenate([np.empty(0, np.uint64), *told]) % np.uint64(MAINS)
            out.count(cells.astype(np.int64), np.repeat(batch.column(1).to_numpy(), [len(w) for w in told]))
        for k in range(MAINS // BLOCK):
            part, at = Mains(BLOCK), slice(k * BLOCK, (k + 1) * BLOCK)
            part.of, part.n, part.several = out.of[at], out.n[at], out.several[at]
            if part.n.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.pack()], pa.binary())], names=["block", "many"])

    told, of, several = gathered(found.mapInArrow(counted, "block bigint, many binary"), added_mains), np.zeros(MAINS, np.int64), np.zeros(MAINS, bool)
    for block, many in zip(told["block"].to_pylist(), told["many"].to_pylist()):
        part, at = Mains(BLOCK), slice(block * BLOCK, (block + 1) * BLOCK)
        part.unpack(many)
        of[at], several[at] = part.of, part.several > 0
    return of, several


def hashed_words(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def components(links: DataFrame, work: Work) -> DataFrame:
    """(id, comp): the smallest id of every id's connected component; links: a, b. Labels spread along links and then jump to their
    labels' labels until nothing changes; every round is written, and only the count of changes reaches the driver."""
    both = work.table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = work.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"))
    while True:
        seen = labels.select(F.col("id").alias("b"), F.col("comp").alias("near"))
        spread = both.join(seen, "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(spread, labels.id == spread.a).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("of"), F.col("comp").alias("further"))
        step = work.table(step.join(jump, F.col("comp") == F.col("of"), "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = step.select("id", "comp")
        if step.where("old != comp").limit(1).count() == 0:
            return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per document: key, tid (its text's digest), class_id, the smallest key in its class, and kept, true for the class's text
    that a deduplication keeps (that of the smallest key).

    Texts are compared by their words in lower case. Equal texts are one class at once and go on as one. Texts that share a sketch and
    whose numbers of words allow it are candidates: in every bucket all are aligned with the first. Where a bucket of up to SMALL texts is
    not one class then, every two of its texts of different classes are aligned. The texts of larger ones, which may have a common
    passage alone, are matched by their rarest words: two texts of an edit similarity of `least` have one of them in common, so that no
    link between classes is lost, and those that do, whose other words allow it and that are in different classes are aligned: first one
    text of the class that has most of a word's texts with those outside it, then all that are still apart. Linked texts, of an edit similarity of `least` or more, are in
    one class, and so are chains of them.

    A null text is in a class of its own, whose tid is null; a text without words only with texts equal to it. Repeated rows are
    documents of one class. Null keys: class_id is the smallest other key of the class, or null. Other columns are left out. The table
    behind the result stays in the shared folder until its owner clears that.
    """

    work = Work(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    id_type, tid = rows.schema["id"].dataType.simpleString(), F.unhex(F.md5(F.encode("t", "UTF-8")))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in by_words(whole, 2)):
            found = [sketches(w) for w in lists(batch.column(2))]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            keys = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *found]))
            size = np.diff(batch.column(2).offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), keys], names=["id", "tid", "n", "keys"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(x, y, least) >= least for x, y in zip(lists(batch.column(2)), lists(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in by_words(whole, 2)):
            found = [labelled_kmers(w, 1) for w in lists(batch.column(2))]
            ends, bits = np.cumsum([0, *map(len, found)], dtype=np.int32), [parities(w) for w in found]
            sides = [(ends, found), (np.arange(len(found) + 1, dtype=np.int32) * PARITIES, bits)]
            made = [pa.ListArray.from_arrays(e, np.concatenate([np.empty(0, np.int64), *(x.view(np.int64) for x in f)])) for e, f in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["tid", "comp", "words", "bits"])

    hashed = rows.select("id", tid.alias("tid"), hashed_words(F.col("t")).alias("w")).mapInArrow(sketched, f"id {id_type}, tid binary, n int, keys array<bigint>")
    hashed = work.table(hashed, keep=True)
    texts = work.table(hashed.where("tid IS NOT NULL").groupBy("tid").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.first("keys").alias("keys")))
    posts = texts.select(F.explode("keys").alias("bucket"), "tid", "n", "first")
    lead = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("f"), "tid", "n")).alias("lead")
    shared = posts.groupBy("bucket").agg(lead, F.count("*").alias("many")).where("many > 1")
    posts = work.table(posts.join(shared, "bucket").select("bucket", "tid", "n", F.col("lead.tid").alias("lead"), F.col("lead.n").alias("lead_n")))
    work.sweep()
    wanted = posts.select("tid").distinct()
    held = rows.where("t IS NOT NULL").groupBy(tid.alias("tid")).agg(F.first("t").alias("t")).join(wanted, "tid")
    held = work.table(held.select("tid", hashed_words(F.col("t")).alias("w")))
    work.sweep()

    def fits(a: str, b: str) -> Column:
        return (F.col(a) >= least * F.col(b)) & (F.col(b) >= least * F.col(a))

    def common(n: str, m: str, bits: str, other: str) -> Column:
        """Whether two texts can have enough words in common, by their parities."""
        differ = sum(F.bit_count(F.get(bits, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(PARITIES))
        return F.col(n) + F.col(m) - differ >= 2 * least * F.greatest(n, m)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough. Pairs of the same `of` are dealt to tasks by up to TOGETHER texts a and by parts of the
        texts b, so that the words of a text b are sent once for so many a, and those of a text a once for each part."""
        pairs = work.table(pairs)
        work.sweep()
        sizes = pairs.groupBy("of", "a").agg(F.count("*").alias("c")).groupBy("of").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("sides"), F.sum("c").alias("c"))
        sizes = work.table(sizes.select("of", "sides", F.ceil(F.col("c") / F.col("sides") / PARTNERS).cast("int").alias("parts")))
        task = ["of", "side", "part"]
        dealt = work.table(pairs.join(sizes, "of").select("of", F.pmod(F.hash("a"), F.col("sides")).alias("side"), F.pmod(F.hash("b"), F.col("parts")).alias("part"), "a", "b"))
        # Both joins read held by tid, under the same names, so that it is sent once.
        ones = dealt.select(*task, "a").distinct().join(held, F.col("a") == F.col("tid")).select(*task, "a", F.col("w").alias("wa"))
        others = dealt.groupBy(*task, "b").agg(F.collect_set("a").alias("partners")).join(held, F.col("b") == F.col("tid")).select(*task, "b", "partners", F.col("w").alias("wb"))
        met = others.join(ones, task).where(F.array_contains("partners", F.col("a")))
        near = work.table(met.select("a", "b", "wa", "wb").mapInArrow(linked, "a binary, b binary"))
        work.sweep()
        return near

    by_lead = [F.col("lead").alias("of"), F.col("lead").alias("a"), F.col("tid").alias("b")]
    led = posts.where("tid != lead").where(fits("n", "lead_n")).select(*by_lead).distinct()
    comps = components(verified(led), work)

    def merged(links: DataFrame) -> DataFrame:
        """(comp, top): the classes that links join, and what they are joined to."""
        of = lambda end: comps.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}"))
        between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        return components(between, work).select(F.col("id").alias("comp"), F.col("comp").alias("top"))

    state = work.table(posts.join(comps.withColumnRenamed("id", "tid"), "tid", "left").select("bucket", "tid", "n", F.coalesce("comp", "tid").alias("comp")))
    split = state.groupBy("bucket").agg(F.count("*").alias("many"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket", "many")
    state = work.table(state.join(split, "bucket"))
    small = state.where(F.col("many") <= SMALL).select("bucket", "tid", "n", "comp")
    other = small.select("bucket", F.col("tid").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
    few = small.join(other, "bucket").where("tid < x AND comp != cx").where(fits("n", "nx")).select(F.col("tid").alias("of"), F.col("tid").alias("a"), F.col("x").alias("b"))

    large = held.join(state.where(F.col("many") > SMALL).select("tid", "comp").distinct(), "tid")
    large = work.table(large.select("tid", "comp", "w").mapInArrow(labelled, "tid binary, comp binary, words array<bigint>, bits array<bigint>"))
    # A class's number is a hash of comp; what a word's cell has is told apart into the main class's rows and those of the others.
    cells, number = histogram(large.select("words")), F.xxhash64("comp")
    mains = main_classes(large.select("words", number.alias("cls")), cells, least)

    def rare_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rare_rows(batch, cells, least, mains)

    def rare_mains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rare_rows(batch, cells, least, mains, own=True)

    schema = "tid binary, comp binary, n int, word int, at int, bits array<bigint>, before array<int>, main bigint"
    others = work.table(large.withColumn("cls", number).mapInArrow(rare_others, schema))
    leads = large.groupBy(number.alias("main")).agg(F.min(F.struct("tid", F.size("words").alias("n"), "bits")).alias("lead"))
    leads = leads.select("main", F.col("lead.tid").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.bits").alias("lead_bits"))
    led = others.dropDuplicates(["tid", "main"]).join(leads, "main").where(fits("n", "lead_n")).where(common("n", "lead_n", "bits", "lead_bits"))
    led = verified(led.select(*by_lead))
    # A cell's main class stays the same one, under the name it has been joined to.
    top = merged(led)
    main_top = top.select(number.alias("main"), F.xxhash64("top").alias("main_top"))
    others = others.join(top, "comp", "left").join(main_top, "main", "left").withColumn("comp", F.coalesce("top", "comp")).withColumn("main", F.coalesce("main_top", "main"))
    others = work.table(others.select("tid", "comp", "n", "word", "at", "bits", "before", "main"))
    own = large.withColumn("cls", number).join(top, "comp", "left").select("tid", F.coalesce("top", "comp").alias("comp"), "words", "bits", "cls").mapInArrow(rare_mains, schema)
    other = others.union(own).select(F.col("word").alias("shared"), F.col("tid").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("bits").alias("bx"), F.col("before").alias("fx"))
    reach = F.least(F.col("n") - F.col("at"), F.col("nx") - F.col("ax")) >= least * F.greatest("n", "nx")  # the words in common that can follow
    rest = others.where(number != F.col("main")).join(other, F.col("word") == F.col("shared")).where("comp != cx AND (xxhash64(cx) = main OR tid < x)").where(fits("n", "nx")).where(reach)
    rest = rest.where(common("n", "nx", "bits", "bx")).where(~F.arrays_overlap("before", "fx")).select(F.unhex(F.hex("main")).alias("of"), F.col("tid").alias("a"), F.col("x").alias("b"))

    once = few.union(rest).groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct("of", "a", "b")).alias("pair"))
    new = verified(once.select("pair.*"))
    joined = merged(led.union(new))
    named = texts.join(comps.withColumnRenamed("id", "tid"), "tid", "left").select("tid", "first", F.coalesce("comp", "tid").alias("comp"))
    named = named.join(joined, "comp", "left").select("tid", "first", F.coalesce("top", "comp").alias("comp"))
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("f"), "tid")).alias("best"), F.min("first").alias("class_id"))
    named = work.table(named.join(best, "comp").select("tid", "class_id", (F.col("best.tid") == F.col("tid")).alias("kept")), keep=True)
    work.drop()
    out = hashed.select("id", "tid").join(named, "tid", "left")
    return out.select(F.col("id").alias(key), "tid", F.when(F.col("tid").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which `classes` keeps the text, one row for each class: of the smallest key, one if it is repeated. Rows with a
    null text all stay. The rows keep docs' columns, whatever their names."""
    tid = F.unhex(F.md5(F.encode("text", "UTF-8")))
    one = found.where("kept AND tid IS NOT NULL").groupBy(F.col("tid").alias("kept")).agg(F.min(key).alias("first"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    held = rows.where("text IS NOT NULL").withColumn("tid", tid)
    picked = held.join(one, (F.col("tid") == F.col("kept")) & F.col("id").eqNullSafe(F.col("first"))).dropDuplicates(["tid", "id"])
    return picked.select("row.*").union(rows.where("text IS NULL").select("row.*"))
