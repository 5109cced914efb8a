"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def words(text: Column) -> Column:
    """The words of a text, null and empty text giving an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def beside(df: DataFrame, kept: list[str], result: Column) -> DataFrame:
    """The columns `kept` of df, whatever their names, and the fields of a struct beside them."""
    if not kept:
        return df.select(result.alias("result")).select("result.*")
    return df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), result.alias("result")).select("row.*", "result.*")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Only a session in one process (a local master), where it
    is unset, gets a temporary folder of this machine; on a cluster an unset folder is an error."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="shared-")
    return f"{top}/work-{uuid.uuid4().hex}"


class Work:
    """Tables of one operator's call, in a folder of its own in the cluster's shared folder (spark.checkpoint.dir), so that a lost
    executor costs no more than the step it was in. Tables also give joins their true sizes, which checkpoints carry on as estimates
    that multiply with every join. Tables that a lazy result reads are kept: whoever owns the shared folder clears them, as with
    checkpoints, once the result is used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, shared_folder(spark), 0

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """df, written and read again; `keep`: it outlives drop()."""
        self.made += 1
        path = f"{self.folder}/{'keep' if keep else 'step'}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def sweep(self) -> None:
        """Has the driver collect its garbage: only then does Spark delete the files of shuffles whose tables have been written, and a driver
        with room seldom does it by itself, so that all shuffles of a call would lie on the executors' disks at once."""
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        """Deletes what no result needs."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/step")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def groups(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in their order, about `most` bytes at a time, so that only so many of a batch become Python strings at once; a longer
    text comes alone. A null text has no bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return (texts.slice(i, j - i) for i, j in zip(edges, edges[1:]) if i < j)


def _shares(n_by_label: dict, most: int, total: int, label: str) -> Column:
    """The share of each label's different rows to take, in millionths, for about `most` of each label and `total` in all."""
    per = max(1, min(most, total // max(1, len(n_by_label))))
    whens = [F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per / max(1, n)) * 1_000_000)) for k, n in n_by_label.items()]
    return F.coalesce(*whens, F.lit(0.0)) if whens else F.lit(0.0)


def labelled_sample(df: DataFrame, label: str, most: int, total: int, text: str = "text") -> DataFrame:
    """(label, text): a bounded sample of labelled rows, about `most` different texts of each label and `total` in all, and never more than
    twice `total`. Repeated rows count once.

    The labels' numbers of different texts are estimated first, in sketches that don't grow; texts are then chosen by a hash, with the
    probability that gives the bound, so that no row is sorted or gathered before. A label of few texts keeps all of them.
    """
    known = df.select(F.col(label).alias("label"), F.col(text).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    counts = known.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "label").limit(total).collect()
    chosen = known.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_000)) < _shares({r[0]: r[1] for r in counts}, most, total, "label"))
    one = chosen.groupBy("label", F.md5(F.encode("text", "UTF-8")).alias("digest")).agg(F.first("text").alias("text"))
    return one.select("label", "text").limit(2 * total)


def marked_texts(docs: DataFrame, marks: DataFrame, most: int, total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of a bounded sample of marks(key, label): about `most` of each label and never over twice `total`, chosen by a hash
    of the key before any text is read. The sample, of so few rows, is sent to where the texts are; of a key that docs has several times
    the smallest text is taken, so that repeated rows add none."""
    known = marks.select(F.col(key).alias("_of"), F.col("label")).where("_of IS NOT NULL AND label IS NOT NULL")
    counts = known.groupBy("label").agg(F.approx_count_distinct("_of").alias("n")).orderBy(F.desc("n"), "label").limit(total).collect()
    share = _shares({r[0]: r[1] for r in counts}, most, total, "label")
    sample = known.where(F.pmod(F.xxhash64(F.col("_of").cast("string"), F.lit(17)), F.lit(1_000_000)) < share).distinct().limit(2 * total)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(sample), F.col("_id") == F.col("_of")).groupBy("_of", "label").agg(F.min("text").alias("text")).select("text", "label")


# ---- hashed character n-grams -------------------------------------------------------------------------------------------------

BITS = 13
_MUL = np.uint32(2654435761)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ngram_counts(text: str, longest: int = 3, letters_only: bool = False) -> np.ndarray:
    """Counts of the 1- to `longest`-grams of characters of the whole text, hashed to 2**BITS cells."""
    c = _code_points(text)
    if letters_only:
        c = np.where((c < 128) & ~((c >= 97) & (c <= 122)), np.uint32(32), c)
    out = np.zeros(1 << BITS, dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint32)
    for k in range(1, longest + 1):
        if len(c) < k:
            break
        h = (h[: len(c) - k + 1] * np.uint32(31) + c[k - 1 :] + np.uint32(k)) * _MUL
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def style_counts(text: str) -> np.ndarray:
    """Counts that tell prose from lists, tables and noise, for the whole text: words, adjacent equal words, distinct words, lines,
    distinct lines, lines without closing mark, capitals, symbols, digits, bars, marks in a row, characters."""
    w, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    c = _code_points(text)
    small = np.bincount(c[c < 128], minlength=128)
    same = sum(map(str.__eq__, w, w[1:]))
    ended = sum(x.rstrip()[-1] in ".!?…:;\"'”»)" for x in lines)
    symbols = small[[35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 126]].sum()
    return np.array([len(w), same, len(set(w)), len(lines), len(set(lines)), len(lines) - ended, small[65:91].sum(), symbols, small[48:58].sum(), small[124], text.count("!!") + text.count("??"), len(c)], dtype=np.float64)


def style_terms(s: np.ndarray) -> np.ndarray:
    """Shares from style_counts, between 0 and about 1."""
    w, n, lines = max(s[0], 1), max(s[11], 1), max(s[3], 1)
    return np.sqrt(np.array([s[1] / w, 1 - s[2] / w, 1 - s[4] / lines if s[3] else 0, s[5] / lines, s[6] / n, s[7] / n, s[8] / n, s[9] / n, s[10] / w]))


def text_vector(text: str) -> np.ndarray:
    """Logarithmic n-gram counts, of length 1, followed by the style terms."""
    v = np.log1p(ngram_counts(text)).astype(np.float32)
    return np.concatenate([v / max(1e-9, float(np.linalg.norm(v))), style_terms(style_counts(text)).astype(np.float32)])


def sparse(v: np.ndarray) -> bytes:
    """The cells of a vector that aren't 0, as bytes: their places (uint16), then values (float32)."""
    i = np.flatnonzero(v)
    return i.astype("<u2").tobytes() + v[i].astype("<f4").tobytes()


def dense(data: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(data), width), dtype=np.float32)
    for row, b in zip(out, data, strict=True):
        n = len(b) // 6
        row[np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f4", n, 2 * n)
    return out


