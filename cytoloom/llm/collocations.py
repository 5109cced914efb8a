"""Phrase collocations of each language: n-gram rows, counts, scores of the weakest cut, phrases inside longer ones left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoloom.llm.shared import Work, groups

#: Characters that end a piece, and that part words: \x0A to \x0D are both kinds' rest of white space.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bits of the filter of phrases that are frequent enough: 16 for each of them, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Parts of a language that are ranked apart first.
PARTS = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _chained(begun: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return _mix(begun * _A + word)


def tokens(text: bytes) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """The words of texts, of which each ends a piece with the next: a number for each word, the words by number, and the piece of each."""
    b = np.frombuffer(text, np.uint8)
    kind = _KIND[b]
    own = kind == 0
    edge = np.diff(own.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0, np.int64)
    piece = np.cumsum(kind == 2, dtype=np.int64)[begin]
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(_LOWER[b[own]])).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, piece


class Filter:
    """A Bloom filter of phrases: two bits of each, in 64-bit words. It never says no to a phrase it was made of."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        m = np.uint64(bits - 1)
        return np.stack([h & m, _mix(h ^ _A) & m])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, 64 * len(self.words))
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)

    @classmethod
    def of(cls, phrases: DataFrame) -> Filter:
        """phrases: lang, phrase. Its bits are set in tasks, and those of one 64-bit word joined before the driver gets at most MOST_BITS."""
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * phrases.count()).bit_length()))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = [hashed(lang, phrase) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                at = cls.places(np.array(h, np.uint64), bits).ravel()
                word, row = np.unique(at >> np.uint64(6), return_inverse=True)
                out = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(out, row, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(out.view(np.int64))], names=["word", "bits"])

        told = phrases.select("lang", "phrase").mapInArrow(put, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[told["word"].to_numpy()] = told["bits"].to_numpy().view(np.uint64)
        return cls(words)


def hashed(lang: str, phrase: str) -> np.uint64:
    h = _hashes([lang.encode()])
    for w in _hashes(phrase.encode().split(b" ")):
        h = _chained(h, np.array([w]))
    return h[0]


def counted(lang: str, text: bytes, sizes: range, known: Filter | None, of: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, c): the phrases of `sizes` words of the text, each once with its count. known: the phrases of `of` words that
    are frequent; longer ones that hold another are left out. For size 1 a row of a null phrase has the number of all words."""
    word, names, piece = tokens(text)
    if not len(word):
        return

    def rows(size: int, phrase: pa.Array, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(c), np.int8))), pa.array(np.full(len(c), size, np.int32)), phrase, pa.array(c.astype(np.int64))], names=["lang", "size", "phrase", "c"])

    if 1 in sizes:
        yield rows(1, names, np.bincount(word, minlength=len(names)))
        yield rows(1, pa.array([None], pa.string()), np.array([len(word)]))
    fine = np.ones(len(word), bool)
    if known is not None:
        h, one = _hashes(names.cast(pa.binary()).to_pylist())[word], _hashes([lang.encode()])[0]
        got = _chained(np.full(len(word), one), h)
        for j in range(1, of):
            got = _chained(got[:-1], h[j:])
        fine = known.has(got)
    gram = word  # the number of the phrase that begins at each word
    for n in range(2, max(sizes) + 1):
        m = len(word) - n + 1
        if m <= 0:
            return
        near = piece[:m] == piece[n - 1 :]
        for j in range(n - of + 1):
            near &= fine[j : j + m]
        at = np.flatnonzero(near)
        _, first, row, c = np.unique(gram[at] * len(names) + word[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        if n in sizes and len(c):
            begin = at[first]
            yield rows(n, pc.binary_join_element_wise(*(names.take(pa.array(word[begin + j])) for j in range(n)), " "), c)
        gram = np.full(m, -1, np.int64)
        gram[at] = row


def ngrams(docs: DataFrame, sizes: range, known: Broadcast | None, of: int = 1, chunk: int = 1 << 22) -> DataFrame:
    """(lang, size, phrase, c): a row for each phrase of about `chunk` bytes of a task's texts in a language. docs: lang, text, neither null."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _chunks(batch, chunk):
                for lang, text in texts.items():
                    yield from counted(lang, text, sizes, known.value if known else None, of)

    return docs.select("lang", "text").mapInArrow(made, "lang string, size int, phrase string, c long")


def _chunks(batch: pa.RecordBatch, chunk: int) -> Iterator[dict[str, bytes]]:
    """The texts of each language, about `chunk` bytes at a time, a line end between two; a longer text is cut where a piece ends."""
    begun = 0
    for texts in groups(batch.column("text"), chunk):
        langs = batch.column("lang").slice(begun, len(texts)).to_pylist()
        begun += len(texts)
        found: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts.to_pylist()):
            found.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        if len(texts) > 1 or len(next(iter(found.values()))[0]) <= 2 * chunk:
            yield {lang: b"\n".join(x) for lang, x in found.items()}
            continue
        (lang, (text,)), at = next(iter(found.items())), 0
        while at < len(text):
            to = min(len(text), at + chunk)
            while to < len(text) and text[to - 1] not in ENDS:
                to += 1
            yield {lang: text[at:to]}
            at = to


def phrases(docs: DataFrame, max_n: int, least: int, work: Work) -> DataFrame:
    """(lang, size, phrase, f): counts of all phrases of 1 to max_n words with f of `least` or more, and a row of a null phrase with the
    number of all words of each language. docs: lang, text, neither null.

    A phrase is no more frequent than the phrases in it, so one that holds a rarer one needs no row: words come first, then pairs of
    frequent words, then longer phrases of frequent pairs. Filters of bounded size say which are frequent; what they let through besides
    is counted and then found to be rare, so the counts don't depend on them. Rows are summed in tasks before they are sent by phrase."""
    spark, levels, known, of = docs.sparkSession, [], None, 1
    for sizes in (range(1, 2), range(2, 3), range(3, max_n + 1)):
        if not len(sizes) or sizes[0] > max_n:
            break
        made = ngrams(docs, sizes, known, of).groupBy("lang", "size", "phrase").agg(F.sum("c").alias("f"))
        levels.append(work.table(made.where((F.col("f") >= least) | F.col("phrase").isNull())))
        if sizes[-1] < max_n:
            known, of = spark.sparkContext.broadcast(Filter.of(levels[-1].where("phrase IS NOT NULL"))), sizes[0]
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def mine(docs: DataFrame, max_n: int = 4, least: int = 30, inside: int = 80, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's `top` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Words are lower-cased (A-Z), parted at blanks within pieces that end at punctuation and line ends. Candidates are the phrases of 2 to
    max_n words with a count a of `least` or more. Of all cuts in two the one of the lowest floor(2000000 * a / (l + r)) counts, l and r
    being the counts of its sides, ties to the earliest. A candidate inside a longer one of at least `inside` per cent of its count is left
    out. Order: score, a (both descending), phrase by its bytes.

    A longer candidate as frequent as that holds an extension by one word as frequent as that, so only those are looked up. Null texts have
    no words, null languages are `und`; a language without candidates, or an empty table, gives no rows; repeated rows are counted each.
    Other columns are left out, whatever their names. The table behind the result stays in the shared folder until its owner clears that."""
    if max_n < 2:
        raise ValueError("phrases have two words or more")
    work = Work(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = phrases(rows, max_n, least, work)
    total = known.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    known = known.where("phrase IS NOT NULL")
    found = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda begin, many: F.array_join(F.slice("w", begin, many), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    score = F.expr("(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    longer = found.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    covered = longer.select(F.col("lang").alias("of"), F.col("phrase").alias("within"), "f")
    left = best.join(covered, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("within")) & (wide("f") * 100 >= wide("a") * inside), "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    out = some.withColumn("rank", rank).where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = work.table(out, keep=True)
    work.drop()
    return out
