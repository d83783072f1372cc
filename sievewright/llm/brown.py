"""Perplexity of documents under a Brown class bigram model, its classes found by the exchange algorithm."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import Columns, Mapped, chunks, lowered, mix64, released, small_side, text_buffers, tokenise, write_table

#: Words that occur at least this often are exchanged between classes, however many they are. Words that occur once,
#: and words never seen, are in fixed classes by their endings.
LEAST = 2
#: Vocabularies of at most so many words are files that tasks map (some 24 bytes a word, shared by an executor's
#: workers) and 2 bytes a word in memory; beyond it the same steps run as joins.
DRIVER_WORDS = 16_000_000
#: Words that reach the driver at a time.
_SLICE = 1 << 21
CLASSES, ENDINGS = 64, 32
#: The exchange ends when a pass over all words raises the log likelihood by less than this, a token.
TOLERANCE = 0.02
#: Absolute discount of class transitions.
DISCOUNT = 0.5
_CODES = 1 << 21
#: Neighbours of words that are gathered in one task, about; words and neighbours of a row of the table of neighbours.
_PART, _BLOCK_WORDS, _BLOCK = 1_000_000, 4096, 200_000
#: Words whose gains are found at a time; a task holds some ten arrays of words x classes x classes.
_AT_ONCE = 128
#: Bytes of text that are split into words at a time; a longer text comes alone and whole.
_CHUNK = 1 << 20


def endings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The fixed class of each word: 0 with a digit at the end, else by its last two bytes."""
    if not len(end):
        return np.zeros(0, np.uint64)
    last = data[end - 1].astype(np.uint16)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0)
    return _ENDING[(last << 8) | before]


def _ending_table() -> np.ndarray:
    low = lowered(np.arange(256, dtype=np.uint8)).astype(np.int64)
    last, before = low[:, None], low[None, :]
    return np.where((last >= 48) & (last <= 57), 0, 1 + (last * 31 + before) % (ENDINGS - 1)).astype(np.uint64).ravel()


_ENDING = _ending_table()


def named_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each word, first word of each row): the hash of the word, with its ending in the lowest bits."""
    words, rows, start, end = tokenise(data, offsets)
    return words & ~np.uint64(ENDINGS - 1) | endings(data, start, end), rows


@dataclass
class Vocabulary:
    """The exchanged words: names in order, and the id of each. Ids: 0 a document's start, 1..V words, then endings."""

    hashes: np.ndarray
    ids: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes)

    #: Where the hashes with each value of their leading bits begin; made when needed.
    leads: np.ndarray | None = None

    @cached_property
    def index(self) -> tuple[np.uint64, np.ndarray]:
        """(shift, first): where the hashes with each value of their leading bits begin."""
        bits = max(1, int(self.size).bit_length())
        shift, first = np.uint64(64 - bits), self.leads
        if first is None:
            first = np.full((1 << bits) + 1, self.size, np.int32)
            for i in range(0, 1 << bits, _SLICE):
                j = min(i + _SLICE, 1 << bits)
                first[i:j] = np.searchsorted(self.hashes, np.arange(i, j, dtype=np.uint64) << shift)
        return shift, first

    def mapped(self, spark: SparkSession) -> Mapped:
        """For tasks: Vocabulary(**mapped.arrays)."""
        return Mapped(spark, hashes=self.hashes, ids=self.ids, leads=self.index[1])

    def symbols(self, words: np.ndarray) -> np.ndarray:
        out = ((words & np.uint64(ENDINGS - 1)) + np.uint64(1 + self.size)).astype(np.int32)
        if not self.size:
            return out
        shift, first = self.index
        lead = (words >> shift).astype(np.int32)
        at = np.minimum(first[lead], self.size - 1)
        hit = self.hashes[at] == words  # most are where their leading bits say
        np.copyto(out, self.ids[at], where=hit)
        live = np.flatnonzero(~hit)
        at, stop = first[lead[live]] + 1, first[lead[live] + 1]
        on = at < stop
        live, at, stop = live[on], at[on], stop[on]
        while len(live):
            same = self.hashes[at] == words[live]
            out[live[same]] = self.ids[at[same]]
            on = ~same & (at + 1 < stop)
            live, at, stop = live[on], at[on] + 1, stop[on]
        return out


def _symbols(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol of each token, of the one before it, tokens of each row)."""
    words, rows = named_words(data, offsets)
    now = vocabulary.symbols(words)
    before = np.append(np.int32(0), now[:-1])[: len(now)]
    before[rows[:-1][rows[:-1] < rows[1:]]] = 0
    return now, before, np.diff(rows)


def _counted(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different values, in order, and how often each occurs; empties the list."""
    code = np.concatenate(codes)
    codes.clear()
    code.sort()
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.diff(np.append(new, len(code)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) of every word of docs (id, text): its name, fixed class and count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            names, n = _counted(codes)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, _CHUNK):
                codes.append(named_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
                if sum(map(len, codes)) >= _CODES:
                    yield counted()
        if codes:
            yield counted()

    counts = docs.mapInArrow(released(count), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.select("word", F.expr(f"cast(word & {ENDINGS - 1} as int)").alias("ending"), "n")


NEIGHBOURS = "word binary, right_each binary, right binary, right_n binary, left_each binary, left binary, left_n binary"


def _ints(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, np.int32)


def _part_of(symbol: np.ndarray, parts: int) -> np.ndarray:
    out = np.empty(len(symbol), np.uint16 if parts <= 1 << 16 else np.int32)
    for i in range(0, len(symbol), 1 << 17):
        out[i : i + (1 << 17)] = mix64(symbol[i : i + (1 << 17)].astype(np.uint64)) % np.uint64(parts)
    return out


def _pairs_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int, side: int) -> pa.RecordBatch:
    """(part, side, data): the pairs (a, b, n), int32, packed by the part of a."""
    part = _part_of(a, parts)
    order = np.argsort(part, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(part, minlength=parts))
    found = np.flatnonzero(np.diff(ends, prepend=0))
    data = [np.concatenate([x[order[(ends[p - 1] if p else 0) : ends[p]]] for x in (a, b, n)]).tobytes() for p in found]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.full(len(found), side, np.int32)), pa.array(data, pa.binary())], names=["part", "side", "data"])


def _merged(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, neighbour, n), each pair once, by word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word, other, n = np.concatenate([_ints(x).reshape(3, -1) for x in data], axis=1)
    code = word.astype(np.int64) << 32 | other
    del word, other
    order = np.argsort(code)
    code, n = code[order], n[order].astype(np.int64)
    del order
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[new] >> 32, code[new] & 0xFFFFFFFF, np.add.reduceat(n, new) if len(new) else n


def neighbours(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> DataFrame:
    """NEIGHBOURS: blocks of symbols with what follows (right) and precedes them (left) and how often, as arrays.

    Every task counts its pairs of symbols and sends them, packed, to the part of either symbol; so a row of the
    shuffle is thousands of pairs.
    """
    shared = vocabulary.mapped(docs.sparkSession)
    parts = max(16, -(-2 * tokens // _PART))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**shared.arrays)
        size = vocabulary.size + 1 + ENDINGS
        codes: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            code, n = _counted(codes)
            n, a = n.astype(np.int32), (code // size).astype(np.int32)
            code %= size
            b = code.astype(np.int32)
            del code
            yield _pairs_of(a, b, n, parts, 0)
            yield _pairs_of(b, a, n, parts, 1)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, _CHUNK):
                now, before, _ = _symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vocabulary)
                if len(now):
                    codes.append(before.astype(np.int64) * size + now)
                if sum(map(len, codes)) >= _CODES:
                    yield from counted()
        if codes:
            yield from counted()

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [_merged(pdf["data"][pdf["side"] == side].tolist()) for side in (0, 1)]
        words = np.union1d(sides[0][0], sides[1][0])
        each = [np.bincount(np.searchsorted(words, w), minlength=len(words)) for w, _, _ in sides]
        ends = [np.append(0, np.cumsum(e)) for e in each]
        load = ends[0] + ends[1]
        out, i = [], 0
        while i < len(words):
            j = min(i + _BLOCK_WORDS, max(i + 1, int(np.searchsorted(load, load[i] + _BLOCK, side="right")) - 1))
            row = [words[i:j]]
            for (_, other, n), e, end in zip(sides, each, ends, strict=True):
                row += [e[i:j], other[end[i] : end[j]], n[end[i] : end[j]]]
            out.append([x.astype(np.int32).tobytes() for x in row])
            i = j
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in NEIGHBOURS.split(", ")])

    return docs.mapInArrow(released(count), "part int, side int, data binary").groupBy("part").applyInPandas(gather, NEIGHBOURS)


# ---------------------------------------------------------------- exchange


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(m: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, from the class bigram counts."""
    return float(_f(m).sum() - _f(m.sum(axis=0)).sum() - _f(m.sum(axis=1)).sum())


#: Counts up to this have the changes they cause made beforehand.
_SMALL = 16
#: Counts up to this are summed as products of matrices, words x classes by classes x classes.
_TINY = 4


class Gains:
    """What the objective gains when words move to each of the first `classes` classes, all others staying.

    m: the class bigram counts. f(x + n) - f(x) is looked up for small n, which is nearly all of a rare word's.
    """

    def __init__(self, m: np.ndarray, classes: int):
        self.m, self.classes = m, classes
        small = np.arange(_SMALL + 1)[:, None, None]
        self.tables = []
        for table in (m.T[:, :classes], m[:, :classes]):
            table = np.ascontiguousarray(table)
            made = _f(table + small) - _f(table)
            made[:, np.arange(classes), np.arange(classes)] = 0  # what a class has with itself is reckoned apart
            self.tables.append((table, _f(table), made))
        self.margins = []
        for margin in (m.sum(axis=1)[:classes], m.sum(axis=0)[:classes]):
            self.margins.append((margin, _f(margin), _f(margin + small[:, 0]) - _f(margin)))

    def _added(self, n: np.ndarray, base: np.ndarray, of: np.ndarray, made: np.ndarray) -> np.ndarray:
        """f(base + n) - f(base) for rows base, whose f is `of` and whose changes by small n are `made`."""
        out = made.copy()
        large = np.flatnonzero(n > _SMALL)
        out[large] = _f(base[large] + n[large, None]) - of[large]
        return out

    def __call__(self, own: np.ndarray, right: np.ndarray, left: np.ndarray, self_n: np.ndarray) -> np.ndarray:
        """A row for each word of class `own`. right[w, j], left[w, j]: how often a word of class j follows, precedes
        it; self_n: how often it follows itself."""
        classes, each = self.classes, np.arange(len(own))
        new_right, new_left = right.copy(), left.copy()
        new_right[each, own] -= self_n
        new_left[each, own] -= self_n
        total = np.zeros((len(own), classes))
        for (table, of, made), mine, other, new in zip(self.tables, (right, left), (left, right), (new_right, new_left), strict=True):
            w, j = np.nonzero(new)
            if not len(w):
                continue
            add, o = new[w, j], own[w]
            rest = new.copy()
            rest[each, own] = 0
            change = np.zeros((len(own), classes))
            for n in range(1, _TINY + 1):
                change += (rest == n).astype(float) @ made[n]
            many = np.flatnonzero((add > _TINY) & (j != o))
            if len(many):
                to, at, n = w[many], j[many], add[many]
                each_change = self._added(n, table[at], of[at], made[np.minimum(n, _SMALL).astype(np.int64), at])
                inner = np.flatnonzero(at < classes)
                each_change[inner, at[inner]] = 0
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                change[to[first]] += np.add.reduceat(each_change, first)
            within = np.flatnonzero(j == o)  # at most one a word
            to, at, lines = w[within], j[within], np.arange(len(within))
            base = table[at].copy()
            base[lines, at] -= mine[to, at]
            base -= other[to, :classes]
            base[lines, at] += self_n[to]
            change[to] += _f(base + add[within][:, None]) - _f(base)
            base = table[j, o] - mine[w, j]  # without the word itself, wherever it is
            change[each, own] = np.bincount(w, np.where(j == o, 0, _f(base + add) - _f(base)), len(own))
            total += change
        add = new_right[:, :classes] + new_left[:, :classes] + self_n[:, None]
        w, k = np.nonzero(add)
        both = np.diag(self.m)[k] - np.where(k == own[w], right[w, k] + left[w, k] - self_n[w], 0)
        total[w, k] += _f(both + add[w, k]) - _f(both)
        for (margin, of, made), n in zip(self.margins, (right.sum(axis=1), left.sum(axis=1)), strict=True):
            few = np.minimum(n, _SMALL).astype(np.int64)
            rows = (len(own), classes)
            change = self._added(n, np.broadcast_to(margin, rows), np.broadcast_to(of, rows), made[few])
            rest = margin[own] - n
            change[each, own] = _f(rest + n) - _f(rest)
            total -= change
        return total - total[each, own][:, None]


def gains(m: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, self_n: float, classes: int) -> np.ndarray:
    """Gains of one word."""
    return Gains(m, classes)(np.array([own]), np.asarray(right, float)[None], np.asarray(left, float)[None], np.array([self_n], float))[0]


def _best_moves(gains: Gains, own: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The class of each word in which the objective is highest; its own, if no other is better."""
    gain = gains(own, sides[0], sides[1], sides[2, :, 0])
    return np.where(gain.max(axis=1) > 1e-6, gain.argmax(axis=1), own)


def _is_turn(word: np.ndarray, parts: int, turn: int) -> np.ndarray:
    return mix64(word.astype(np.uint64)) % np.uint64(parts) == turn


class _Held:
    """The exchange over neighbours(), with the class of each symbol in an array that every task has."""

    def __init__(self, table: DataFrame, vocabulary: int, n_classes: int):
        self.table, self.vocabulary, self.n_classes, self.total = table, vocabulary, n_classes, n_classes + 1 + ENDINGS
        self.context = table.sparkSession.sparkContext

    def start(self) -> np.ndarray:
        return np.concatenate([[self.n_classes], np.arange(self.vocabulary) % self.n_classes, self.n_classes + 1 + np.arange(ENDINGS)]).astype(np.int16)

    def matrix(self, classes: np.ndarray) -> np.ndarray:
        shared, total = self.context.broadcast(classes), self.total

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, m = shared.value, np.zeros(total * total)
            for batch in batches:
                for word, each, right, n in zip(*(batch.column(k) for k in range(4)), strict=True):
                    m += np.bincount(np.repeat(own[_ints(word)].astype(np.int64) * total, _ints(each)) + own[_ints(right)], _ints(n), total * total)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

        sums = self.table.select("word", "right_each", "right", "right_n").mapInArrow(released(count), "m binary").toArrow()
        shared.destroy()  # else executors hold the classes of every round
        return sum((np.frombuffer(x.as_buffer()) for x in sums["m"]), np.zeros(total * total)).reshape(total, total)

    def moved(self, m: np.ndarray, classes: np.ndarray, parts: int, turn: int) -> np.ndarray:
        shared, total, n_classes, vocabulary = self.context.broadcast((m, classes)), self.total, self.n_classes, self.vocabulary

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, classes = shared.value
            gains = Gains(m, n_classes)
            for batch in batches:
                words, targets = [], []
                for row in zip(*batch.columns, strict=True):
                    word, *rest = map(_ints, row)
                    chosen = (word >= 1) & (word <= vocabulary) & _is_turn(word, parts, turn)
                    at = np.flatnonzero(chosen)
                    number = np.cumsum(chosen) - 1
                    for i in range(0, len(at), _AT_ONCE):
                        mine = at[i : i + _AT_ONCE]
                        lo, hi = mine[0], mine[-1] + 1
                        sides = np.zeros((3, len(mine), total))
                        for side, (each, other, n) in enumerate((rest[:3], rest[3:])):
                            first, stop = int(each[:lo].sum()), int(each[:hi].sum())
                            of = np.repeat(np.arange(lo, hi), each[lo:hi])
                            use = chosen[of]
                            of, o, k = of[use], other[first:stop][use], n[first:stop][use]
                            sides[side] = np.bincount((number[of] - i) * total + classes[o], k, len(mine) * total).reshape(len(mine), total)
                            if side == 0:
                                sides[2, :, 0] = np.bincount(number[of] - i, np.where(word[of] == o, k, 0), len(mine))
                        words.append(word[mine])
                        targets.append(_best_moves(gains, classes[word[mine]].astype(np.int64), sides).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int32)) for x in (words, targets)], names=["word", "target"])

        to = self.table.mapInArrow(released(move), "word int, target int").toArrow()  # a row a word of the turn
        shared.destroy()
        new = classes.copy()
        new[to["word"].to_numpy()] = to["target"].to_numpy()
        return new


def _class_counts(bigrams: DataFrame, table: DataFrame) -> DataFrame:
    """(word, side, class, n) of the words: class following (0), preceding (1), the word itself (2)."""
    right = bigrams.join(table.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("word"), F.lit(0).alias("side"), "class").agg(F.sum("n").alias("n"))
    left = bigrams.join(table.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("word"), F.lit(1).alias("side"), "class").agg(F.sum("n").alias("n"))
    return right.unionByName(left).unionByName(bigrams.where("a = b").select(F.col("a").alias("word"), F.lit(2).alias("side"), F.lit(0).alias("class"), "n"))


def _sized(table: DataFrame) -> DataFrame:
    return small_side(table, F.lit(16))


class _Joined:
    """The exchange over pairs (a, b, n), with the class of each symbol in a table (id, class)."""

    def __init__(self, bigrams: DataFrame, vocabulary: int, n_classes: int):
        self.bigrams, self.vocabulary, self.n_classes, self.total = bigrams, vocabulary, n_classes, n_classes + 1 + ENDINGS

    def start(self) -> DataFrame:
        first = F.when(F.col("id") == 0, self.n_classes).when(F.col("id") <= self.vocabulary, F.pmod(F.col("id") - 1, F.lit(self.n_classes))).otherwise(F.col("id") - self.vocabulary + self.n_classes)
        ids = self.bigrams.sparkSession.range(self.vocabulary + 1 + ENDINGS).select(F.col("id").cast("int").alias("id"))
        return _sized(write_table(ids.withColumn("class", first.cast("int")), "lm-classes"))

    def matrix(self, classes: DataFrame) -> np.ndarray:
        rows = self.bigrams.join(classes.select(F.col("id").alias("a"), F.col("class").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("class").alias("y")), "b")
        m = np.zeros((self.total, self.total))
        for r in rows.groupBy("x", "y").agg(F.sum("n").alias("n")).collect():  # classes squared at most
            m[r["x"], r["y"]] = r["n"]
        return m

    def moved(self, m: np.ndarray, classes: DataFrame, parts: int, turn: int) -> DataFrame:
        shared, n_classes = self.bigrams.sparkSession.sparkContext.broadcast(m), self.n_classes

        @F.pandas_udf("boolean")
        def mine(word: pd.Series) -> pd.Series:
            return pd.Series(_is_turn(word.to_numpy(), parts, turn))

        def move(pdf: pd.DataFrame) -> pd.DataFrame:
            m = shared.value
            gains = Gains(m, n_classes)
            pdf = pdf.sort_values("word", kind="stable")
            words, first, number = np.unique(pdf["word"].to_numpy(), return_index=True, return_inverse=True)
            own = pdf["own"].to_numpy()[first].astype(np.int64)
            side, cls, n = (pdf[c].to_numpy() for c in ("side", "class", "n"))
            ends, targets = np.append(first, len(pdf)), own.copy()
            for i in range(0, len(words), _AT_ONCE):
                j = min(i + _AT_ONCE, len(words))
                at = slice(ends[i], ends[j])
                sides = np.zeros((3, j - i, len(m)))
                np.add.at(sides, (side[at], number[at] - i, cls[at]), n[at])
                targets[i:j] = _best_moves(gains, own[i:j], sides)
            return pd.DataFrame({"word": words, "target": targets}, dtype="int32")

        chosen = classes.where(f"id between 1 and {self.vocabulary}").select(F.col("id").alias("word"), F.col("class").alias("own")).where(mine("word"))
        counts = _class_counts(self.bigrams, classes).join(chosen, "word")
        groups = max(64, -(-self.vocabulary // 8000))
        to = counts.withColumn("part", F.pmod("word", F.lit(groups))).groupBy("part").applyInPandas(move, "word int, target int")
        to = _sized(write_table(to, "lm-moved")).withColumnRenamed("word", "id")
        return _sized(write_table(classes.join(to, "id", "left").select("id", F.coalesce("target", "class").alias("class")), "lm-classes"))


def exchange(over: _Held | _Joined, tolerance: float = TOLERANCE, rounds: int | None = None) -> tuple[np.ndarray | DataFrame, np.ndarray]:
    """(class of each symbol, class bigram counts): the exchange algorithm with half of the words moving in a round.

    Words begin in classes by their rank of frequency, which is their id. In each round every word of one half finds
    the class in which the likelihood would be highest with all others where they are. A round that lowers the
    likelihood is undone, and from then on words move in twice as many parts (a word alone can't lower it). It ends
    when a pass over all words raises the log likelihood by less than tolerance a token (or after so many rounds, if
    given). Starts and endings keep classes of their own, after the first n_classes.
    """
    classes = over.start()
    m = over.matrix(classes)
    best, parts, turn, gained, done = objective(m), 2, 0, 0.0, 0
    while over.vocabulary and (rounds is None or done < rounds):
        new = over.moved(m, classes, parts, turn)
        new_m = over.matrix(new)
        value = objective(new_m)
        done += 1
        if value < best and parts <= over.vocabulary:
            parts *= 2  # the same words, and then as many again
            continue
        if value > best:
            gained += value - best
            classes, m, best = new, new_m, value
        turn += 1
        if turn == parts:
            if gained < tolerance * m.sum():
                break
            turn, gained = 0, 0.0
    return classes, m


# ---------------------------------------------------------------- model


@dataclass
class Model:
    """log P(class | class before) and, for each symbol, its class and log P(word | class)."""

    vocabulary: Vocabulary
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray


@dataclass
class TableModel:
    """A Model whose words are a table (word, class, emission); class and emission of the endings are arrays."""

    words: DataFrame
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray


def transitions(m: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Log transition probabilities, absolutely discounted and interpolated with the (add-half) class frequencies.

    No class but the start itself (which nothing precedes) is impossible anywhere.
    """
    into = m.sum(axis=0) + 0.5
    into[len(m) - 1 - ENDINGS] = 0
    low = into / into.sum()
    out = m.sum(axis=1, keepdims=True)
    kept = np.maximum(m - discount, 0)
    p = np.where(out > 0, (kept + (out - kept.sum(axis=1, keepdims=True)) * low) / np.maximum(out, 1), low)
    return np.log(np.maximum(p, 1e-300))


def _ranked(words: DataFrame) -> DataFrame:
    """(word, n, id) of words: ids from 1 on, by falling count, equal counts by hash."""
    placed = write_table(words.orderBy(F.desc("n"), "word").select("word", "n", F.monotonically_increasing_id().alias("place")), "lm-ranked")
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["size"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect())  # a row a partition
    before = np.append(0, np.cumsum([n for _, n in sizes]))
    offsets = words.sparkSession.createDataFrame([(p, int(o)) for (p, _), o in zip(sizes, before, strict=False)], "part bigint, before bigint")
    rank = F.col("place") - F.shiftleft("part", 33) + F.col("before") + 1
    return write_table(placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("word", "n", rank.cast("int").alias("id")), "lm-vocabulary")


def _words_of(docs: DataFrame, size: int, ranked: DataFrame) -> DataFrame:
    """(a, b, n), how often symbol b follows symbol a, for a vocabulary that is a table (word, id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, _CHUNK):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words, rows = named_words(own, at)
                if not len(words):
                    continue
                names, number = np.unique(words, return_inverse=True)
                last = (names & np.uint64(ENDINGS - 1)).astype(np.int64)
                before = np.append(-1, number[:-1])
                before[rows[:-1][rows[:-1] < rows[1:]]] = -1
                code, n = np.unique((before + 1) * len(names) + number, return_counts=True)
                a, b = code // len(names) - 1, code % len(names)
                yield pa.RecordBatch.from_arrays([pa.array(names[a].view(np.int64)), pa.array(np.where(a < 0, -1, last[a]).astype(np.int32)), pa.array(names[b].view(np.int64)), pa.array(last[b].astype(np.int32)), pa.array(n.astype(np.int64))], names=["wa", "ea", "wb", "eb", "n"])

    counted = docs.mapInArrow(count, "wa bigint, ea int, wb bigint, eb int, n bigint")
    of = _sized(ranked.select("word", "id"))
    for side in "ab":
        known = of.select(F.col("word").alias(f"w{side}"), F.col("id").alias(side))
        symbol = F.when(F.col(f"e{side}") < 0, 0).otherwise(F.coalesce(side, F.lit(1 + size) + F.col(f"e{side}")))
        kept = [c for c in counted.columns if c[1:] != side]
        counted = counted.join(known, f"w{side}", "left").select(*kept, symbol.cast("int").alias(side))
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _scratch(n: int, kind: type) -> np.ndarray:
    """An array in a file without a name."""
    return np.memmap(tempfile.TemporaryFile(), kind, shape=max(n, 1))[:n]


def _collected(ranked: DataFrame, size: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of ranked (word, n, id), and the counts by id; words come by the leading bits of their hashes."""
    vocabulary, counts, done = Vocabulary(_scratch(size, np.uint64), _scratch(size, np.int32)), _scratch(size, np.int64), 0
    bits = max(0, (size // _SLICE).bit_length())
    for lead in range(1 << bits):
        own = (ranked.where(F.shiftrightunsigned("word", 64 - bits) == lead) if bits else ranked).toArrow()
        hashes, ids = own["word"].to_numpy().view(np.uint64), own["id"].to_numpy()
        order, to = np.argsort(hashes), slice(done, done + len(ids))
        vocabulary.hashes[to], vocabulary.ids[to] = hashes[order], ids[order]
        counts[ids - 1] = own["n"].to_numpy()
        done += len(ids)
    return vocabulary, counts


def fit(docs: DataFrame, n_classes: int = CLASSES, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, driver_words: int = DRIVER_WORDS, tolerance: float = TOLERANCE) -> Model | TableModel | None:
    """The model of all texts of docs; None if they have no word.

    Words that occur `least` times are exchanged and have emissions of their own. Null and empty texts add nothing;
    repeated rows count each time; ids and columns with other names are ignored; equally frequent words begin in the
    order of their hashes. An empty table has no model.
    """
    slim = Columns(docs).select(id=id_col, text=text_col)
    words = write_table(word_counts(slim), "lm-words")
    tokens = words.agg(F.sum("n").alias("n")).first()["n"]
    if not tokens:
        return None
    is_frequent = F.col("n") >= least
    ranked = _ranked(words.where(is_frequent))
    size = ranked.count()
    rare = {r["ending"]: r["types"] for r in words.where(~is_frequent).groupBy("ending").agg(F.count("*").alias("types")).collect()}
    unseen = -np.log([rare.get(e, 0) + 1.0 for e in range(ENDINGS)])  # one more for words never seen
    if size <= driver_words:
        vocabulary, counts = _collected(ranked, size)
        over = _Held(write_table(neighbours(slim, vocabulary, tokens), "lm-neighbours"), size, n_classes)
    else:
        over = _Joined(write_table(_words_of(slim, size, ranked), "lm-bigrams"), size, n_classes)
    classes, m = exchange(over, tolerance, rounds)
    in_class = m[:, :n_classes].sum(axis=0)  # each word follows a word or a start
    if size > driver_words:
        sums = F.array(*[F.lit(float(x)) for x in in_class])
        emission = F.log(F.col("n") / F.element_at(sums, F.col("class") + 1))
        return TableModel(write_table(ranked.join(classes, "id").select("word", "class", emission.alias("emission")), "lm-model"), n_classes + 1 + np.arange(ENDINGS), transitions(m), unseen)
    emission = _scratch(size + 1 + ENDINGS, np.float64)
    for i in range(0, size, _SLICE):
        n = counts[i : i + _SLICE]
        emission[i + 1 : i + 1 + len(n)] = np.log(n / in_class[classes[i + 1 : i + 1 + len(n)]])
    emission[size + 1 :] = unseen
    return Model(vocabulary, classes, transitions(m), emission)


def log_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, log probability) of each row."""
    now, before, n = _symbols(data, offsets, model.vocabulary)
    each = model.transition[model.classes[before], model.classes[now]] + model.emission[now]
    return n, np.bincount(np.repeat(np.arange(len(n)), n), each, len(n))


def _score_joined(slim: DataFrame, model: TableModel, names: list[str]) -> DataFrame:
    """score_documents() with a row for each token, joined with the words of the model."""
    keyed = write_table(slim.withColumn("key", F.monotonically_increasing_id()), "lm-keyed")
    start = int(model.classes[0]) - 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys = batch.column(0).to_numpy()
            for i, j in chunks(offsets, _CHUNK):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words, rows = named_words(own, at)
                n = np.diff(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[i:j], n)), pa.array(np.arange(len(words)) - np.repeat(rows[:-1], n)), pa.array(words.view(np.int64)), pa.array((words & np.uint64(ENDINGS - 1)).astype(np.int32))], names=["key", "at", "word", "ending"])

    tokens = keyed.select("key", "text").mapInArrow(read, "key bigint, at bigint, word bigint, ending int")
    unseen = F.element_at(F.array(*[F.lit(float(x)) for x in model.emission]), F.col("ending") + 1)
    known = tokens.join(small_side(model.words, F.lit(24)), "word", "left").select("key", "at", F.coalesce("class", F.lit(start + 1) + F.col("ending")).alias("class"), F.coalesce("emission", unseen).alias("emission"))
    before = F.coalesce(F.lag("class").over(Window.partitionBy("key").orderBy("at")), F.lit(start))
    size = len(model.transition)
    steps = slim.sparkSession.createDataFrame([(i, j, float(model.transition[i, j])) for i in range(size) for j in range(size)], "before int, class int, step double")
    scores = known.withColumn("before", before).join(F.broadcast(steps), ["before", "class"]).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("step") + F.col("emission")).alias("log"))
    n, log = F.coalesce("n", F.lit(0).cast("bigint")), F.coalesce("log", F.lit(0.0))
    return keyed.join(scores, "key", "left").select("id", n.alias(names[1]), log.alias(names[2]), F.expr("case when n > 0 then exp(least(-log / n, 700D)) end").alias(names[3])).toDF(*names)


def score_documents(docs: DataFrame, model: Model | TableModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row under the model.

    P(word | word before) = P(class | class before) P(word | class). Words seen twice or more have classes by exchange
    and emissions by their counts; the others (seen once or never) have classes by their endings, equally likely within.
    Perplexity is exp(-log_prob / n_tokens). The text is read whole, as one sequence.

    Nulls: a null or wordless text has no tokens, log_prob 0 and a null perplexity; without a model so has every row.
    Null ids are returned; repeated rows get equal scores (each counts in the model); an empty table gives no rows.
    """
    slim = Columns(docs).select(id=id_col, text=text_col)
    if isinstance(model, TableModel):
        return _score_joined(slim, model, [id_col, "n_tokens", "log_prob", "perplexity"])
    words = scores = transition = None
    if model is not None:
        words, transition = model.vocabulary.mapped(docs.sparkSession), model.transition
        scores = Mapped(docs.sparkSession, classes=model.classes, emission=model.emission)
    schema = T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = words and Model(Vocabulary(**words.arrays), transition=transition, **scores.arrays)
        for batch in batches:
            rows = batch.num_rows
            n, log = np.zeros(rows, np.int64), np.zeros(rows)
            if model:
                data, offsets = text_buffers(batch.column(1))
                for i, j in chunks(offsets, _CHUNK):
                    n[i:j], log[i:j] = log_probabilities(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            perplexity = np.exp(np.minimum(-log / np.maximum(n, 1), 700))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(log), pa.array(perplexity, mask=n == 0)], names=schema.names)

    return slim.mapInArrow(released(score), schema)
