"""Order-preserving packing: the windows' cuts are chosen by dynamic programming with a monotone queue."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoloom.llm.shared import groups

#: Costs of a cut, in tokens of padding: between documents, after a sentence, inside a sentence.
AT_DOCUMENT, AT_SENTENCE, INSIDE = 0, 24, 96
#: A sentence longer than this many tokens can also be cut at every multiple of it.
GRID = 256
#: Bytes of the texts that are encoded together; a longer text is encoded alone. What is made of a group takes many times its bytes.
GROUP = 1 << 19
CLOSING = (".", "!", "?", "…", "。", "！", "？")


def cut_windows(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Where to end windows, as indexes into `at`, rising places of which the first is 0 and the last must be an end.

    The cost of a window is its padding to `window` tokens, none if its length is a power of two, plus the penalty of its end. Two
    places that follow each other are at most `window` apart. f(j) = min over i of f(i) + padding(j - i) + penalty(j): without the
    powers it is the smallest f(i) + at(i) among the places in reach, which a monotone queue holds.
    """
    n, places = len(at), at.tolist()
    jumps: list[list[int]] = [[] for _ in range(n)]
    power = 1 << (window.bit_length() - 1)
    while power:
        i = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at >= power) & (at[np.minimum(i, n - 1)] == at - power))
        for j, k in zip(hit.tolist(), i[hit].tolist(), strict=True):
            jumps[j].append(k)
        power //= 2
    f, back, queue, pen = [0.0] * n, [0] * n, deque([(0.0, 0)]), penalty.tolist()
    for j in range(1, n):
        here, reach = places[j], places[j] - window
        while places[queue[0][1]] < reach:
            queue.popleft()
        key, i = queue[0]
        best, frm = key + window - here, i
        for k in jumps[j]:
            if f[k] < best:
                best, frm = f[k], k
        f[j], back[j] = best + pen[j], frm
        key = f[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


class Encoder:
    """Ids of a text, and after how many of them its sentences end. The tokenizer drops white space and no token spans it, so the pieces
    between spaces and line breaks are encoded once and remembered, at most about `most` of them. Nor does a token span the end of an
    ASCII letter and a mark after it: a piece of ASCII letters and last marks is taken as its body, in lower case as the tokenizer has it,
    and its marks. Other pieces stay whole, as lower case may end them in a mark of its own. Arrow splits the texts and finds the
    different bodies, so that Python sees each of them once a group."""

    MARKS = ".,;:!?"

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])  # tokens that end a run of letters
        self.mark = next((i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), None)
        self.forget()

    def forget(self) -> None:
        """Frees all that was remembered."""
        self.row: dict[str, int] = {"": 0}  # of bodies and tails: rows of first, size and seen; the ids lie in flat
        self.used, self.flat, self.first, self.size, self.seen = 0, np.zeros(1 << 16, "<u4"), *(np.zeros(1 << 14, np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Forgets pieces that were met in one group only, as most have been, and more of the rarest if those are too few."""
        n = len(self.row)
        seen = self.seen[:n].copy()
        seen[0] = np.iinfo(np.int64).max
        least = max(2, int(np.partition(seen, n - self.most // 2)[n - self.most // 2]) + 1)
        rows = np.flatnonzero(seen >= least)
        size = self.size[rows]
        upto = np.cumsum(size)
        flat = self.flat[np.repeat(self.first[rows] - upto + size, size) + np.arange(upto[-1])]
        names, kept = list(self.row), {int(r): i for i, r in enumerate(rows)}
        self.forget()
        self.row = {names[r]: i for r, i in kept.items()}
        self.used, self.flat = len(flat), self._grown(self.flat, len(flat))
        self.flat[: len(flat)] = flat
        self.first, self.size, self.seen = (self._grown(x, len(rows)) for x in (self.first, self.size, self.seen))
        self.first[: len(rows)], self.size[: len(rows)] = upto - size, size

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many parts and their numbers. Runs of letters go through the tokenizer as one text, and the tokens that end a word
        tell them apart; other parts with a special token between them, which always stands alone."""
        if self.last.any() and all(map(str.isalpha, parts)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.last[ids])
            if len(at) == len(parts) and at[-1] == len(ids) - 1:
                return ids, np.diff(at, prepend=-1)
        if self.mark is None or any("<|" in p for p in parts):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            return np.array([i for c in coded for i in c], "<u4"), np.array([len(c) for c in coded], np.int64)
        text = self.tokenizer.id_to_token(self.mark).join(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1

    def _grown(self, x: np.ndarray, n: int) -> np.ndarray:
        while n > len(x):
            x = np.concatenate([x, np.zeros_like(x)])
        return x

    def _learn(self, new: list[str]) -> np.ndarray:
        """Encodes parts that have no row yet and gives them rows, which it returns."""
        out, letters = np.empty(len(new), np.int64), np.fromiter(map(str.isalpha, new), bool, len(new))
        for at in (x[i : i + 1024] for x in (np.flatnonzero(letters), np.flatnonzero(~letters)) for i in range(0, len(x), 1024)):
            some = [new[i] for i in at.tolist()]
            ids, sizes = self._encode(some)
            n, used = len(self.row), self.used + len(ids)
            self.flat = self._grown(self.flat, used)
            self.first, self.size, self.seen = (self._grown(x, n + len(some)) for x in (self.first, self.size, self.seen))
            self.flat[self.used : used] = ids
            self.first[n : n + len(some)], self.size[n : n + len(some)] = self.used + np.cumsum(sizes) - sizes, sizes
            self.used = used
            out[at] = np.arange(n, n + len(some))
            self.row.update(zip(some, range(n, n + len(some)), strict=True))
        return out

    def _rows(self, strings: pa.Array) -> np.ndarray:
        """The row of each body or tail; new ones are encoded."""
        coded = strings.dictionary_encode()
        values = coded.dictionary.to_pylist()
        rows = np.fromiter(map(self.row.get, values, repeat(-1)), np.int64, len(values))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn([values[i] for i in new.tolist()])
        self.seen[rows] += 1
        return rows[coded.indices.to_numpy()]

    @staticmethod
    def _of_last(strings: pa.Array, test: Callable[[str], bool]) -> np.ndarray:
        """Whether the last character of each string passes; that of an empty one is an empty string."""
        coded = pc.utf8_slice_codeunits(strings, -1).dictionary_encode()
        return np.array([test(x) for x in coded.dictionary.to_pylist()], dtype=bool)[coded.indices.to_numpy()]

    def __call__(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text (none null) its ids, and after how many of them its sentences end."""
        if len(self.row) > self.most:
            self._thin()
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        many, pieces = pc.list_value_length(split).to_numpy(), split.flatten()
        bodies = pc.ascii_rtrim(pieces, self.MARKS)
        plain = pc.and_(pc.string_is_ascii(bodies), pc.utf8_is_alpha(bodies))
        bodies = pc.if_else(plain, bodies, pieces)
        marks = pc.subtract(pc.binary_length(pieces), pc.binary_length(bodies)).to_numpy()
        marked = np.flatnonzero(marks)
        tails = [p[-k:] for p, k in zip(pieces.take(pa.array(marked)).to_pylist(), marks[marked].tolist(), strict=True)]
        parts = np.zeros((len(pieces), 2), np.int64)
        parts[:, 0] = self._rows(pc.if_else(plain, pc.ascii_lower(bodies), bodies))
        parts[marked, 1] = self._rows(pa.array(tails, pa.large_string()))
        parts = parts.ravel()
        size = self.size[parts]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[parts] - upto + size, size) + np.arange(upto[-1])]
        last, done, cuts = upto[1::2], np.cumsum(many), []
        begun = np.concatenate([[0], last[done - 1]])
        closes = self._of_last(pieces, CLOSING.__contains__)
        for d, (i, j) in enumerate(zip((done - many).tolist(), done.tolist(), strict=True)):
            cuts.append((ids[begun[d] : begun[d + 1]], last[i:j][closes[i:j]] - begun[d]))
        return cuts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of this Python worker, read once. What a task has it remember goes at the task's end."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = 2, window: int = 4096, ahead: int = 1 << 18) -> DataFrame:
    """Packs the token ids of every row's whole text, an end id after each, into sequences of at most `window` tokens.

    Returns the input columns but the text, in one row per piece: start (ids of its document before it), length, ids (little-endian
    32-bit, binary), doc_tokens, sequence_id and offset (its place in the sequence; pieces of a sequence have no gap). Every id lies
    in one piece and rows stay in the order of their partition. Sequences end at documents, sentences or, in sentences over 256
    tokens, inside, wherever padding and cuts together cost least; the choice is made for about `ahead` tokens at a time, ending at a
    document. Null and empty texts are documents of the end id alone; repeated rows are packed each. Input columns with the names of
    the results are replaced. No row leaves its partition: nothing is shuffled, and a lost task is done again from its own rows.
    `tokenizer` must be readable by that path on every executor.
    """
    made = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    carried = [f for f in docs.schema.fields if f.name not in {m.name for m in made} | {text}]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in carried], F.col(text).alias("_text"))
    schema = T.StructType([*carried, *made])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cytoloom.llm.packing import encoder  # by name, so that the worker's own module is used

        encode, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 33
        end = np.uint32(end_id).tobytes()
        rows, parts, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            sizes = np.array([len(b) // 4 for b, _ in rows], dtype=np.int64)
            first = np.concatenate([[0], np.cumsum(sizes)])
            places, costs = [first], [np.full(len(first), AT_DOCUMENT)]
            for base, n, (_, ends) in zip(first.tolist(), sizes.tolist(), rows):
                inside = ends[(ends > 0) & (ends < n - 1)]
                places.append(base + inside)
                costs.append(np.full(len(inside), AT_SENTENCE))
                edges = np.concatenate([[0], inside, [n]])
                for k in np.flatnonzero(np.diff(edges) > GRID).tolist():
                    grid = np.arange(edges[k] + GRID, edges[k + 1], GRID)
                    places.append(base + grid)
                    costs.append(np.full(len(grid), INSIDE))
            place, cost = np.concatenate(places), np.concatenate(costs)
            order = np.lexsort((cost, place))
            place, cost = place[order], cost[order]
            keep = np.concatenate([[True], np.diff(place) > 0])
            place, cost = place[keep], cost[keep]
            stops = place[cut_windows(place, cost, window)]
            edges = np.union1d(first, np.concatenate([[0], stops]))
            begin, finish = edges[:-1], edges[1:]
            doc, seq = np.searchsorted(first, begin, side="right") - 1, np.searchsorted(stops, begin, side="right")
            opened = np.concatenate([[0], stops])[seq]
            start, length = begin - first[doc], finish - begin
            ids = [rows[d][0][4 * i : 4 * (i + n)] for d, i, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            columns = [c.take(pa.array(doc)) for c in pa.concat_batches(parts).columns] if carried else []
            columns += [pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(sizes[doc]), pa.array(sequence + seq), pa.array(begin - opened)]
            sequence += len(stops)
            return pa.RecordBatch.from_arrays(columns, names=names)

        def encoded(some: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            out = encode(some)
            pa.default_memory_pool().release_unused()
            return out

        def packed_batches() -> Iterator[pa.RecordBatch]:
            nonlocal rows, parts, waiting
            for batch in batches:
                yield from packed(batch)
            if rows:
                yield flush()

        def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal rows, parts, waiting
            begun, others = 0, batch.select(range(batch.num_columns - 1))
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
            for n, (ids, ends) in enumerate(x for some in groups(texts, GROUP) for x in encoded(some)):
                rows.append((ids.tobytes() + end, ends))
                waiting += len(rows[-1][0]) // 4
                if waiting >= ahead:
                    parts.append(others.slice(begun, n + 1 - begun))
                    yield flush()
                    rows, parts, waiting, begun = [], [], 0, n + 1
            parts.append(others.slice(begun))
        try:
            yield from packed_batches()
        finally:
            encode.forget()
            pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)
