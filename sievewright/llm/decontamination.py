"""Benchmark decontamination by suffix arrays over shards of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import Columns, chunks, mix64, text_buffers, tokenise

#: A verbatim run of so many words of a test item is a leak; an item of fewer words counts where it occurs whole.
MIN_TOKENS = 13
#: Items of fewer words than this occur by chance within sentences, and count where they are whole lines of a text.
LEAST_ITEM = 8
#: The test texts are sent to the executors in slices of at most about this many bytes.
SLICE_BYTES = 32 << 20


@dataclass
class Tests:
    """Test suffixes: words of all items end to end, where each suffix begins, how many words it has and needs."""

    words: np.ndarray
    item: np.ndarray  # of each suffix, index into items
    start: np.ndarray
    length: np.ndarray
    need: np.ndarray
    offset: np.ndarray  # of the suffix within its item
    items: list
    item_tokens: np.ndarray
    as_line: np.ndarray  # of each suffix, whether its item counts as whole lines only


def suffixes_of(items: list[tuple], min_tokens: int = MIN_TOKENS, least_item: int = LEAST_ITEM) -> Tests:
    data, offsets = text_buffers(pa.array([t for _, t in items], pa.large_string()))
    words, rows, _, _ = tokenise(data, offsets)
    words = np.maximum(words, np.uint64(1))
    n = np.diff(rows)
    item = np.repeat(np.arange(len(items)), n)
    start = np.arange(len(words))
    length = rows[1:][item] - start
    need = np.minimum(min_tokens, n)[item]
    use = length >= need
    return Tests(np.append(words, np.uint64(0)), item[use], start[use], length[use], need[use], (start - rows[:-1][item])[use], [i for i, _ in items], n, (n[item] < least_item)[use])


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the words of seq (0 ends a document), ordered by the suffixes that begin there.

    Prefix doubling, each round sorting only what is still tied, until nothing is; suffixes that are equal up to the
    end of their documents are in the order of these.
    """
    sa = np.flatnonzero(seq)
    sa = sa[np.argsort(seq[sa])]
    n = len(sa)
    if not n:
        return sa
    ends = np.flatnonzero(seq == 0)
    rank = np.zeros(len(seq) + 1, np.int64)  # 0: beyond the end
    rank[ends] = np.arange(1, len(ends) + 1)
    new = np.append(True, seq[sa[1:]] != seq[sa[:-1]])
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + len(ends) + 1
    width = 1
    slots = np.arange(n)
    while True:
        tied = np.append(~new[1:], False) | ~new
        slots = slots[tied]
        if not len(slots):
            return sa
        sub = sa[slots]
        key = rank[sub] * (len(seq) + 2) + rank[np.minimum(sub + width, len(seq))]
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[slots] = sub
        new = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[sub] = slots[first] + len(ends) + 1
        width *= 2


def _bound(seq: np.ndarray, sa: np.ndarray, tests: Tests, upper: bool) -> np.ndarray:
    """For each test suffix, the first place in sa whose suffix is not below (upper: is above) its first `need` words."""
    m = len(tests.start)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    seen_lo, seen_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)  # words shared with the bounds so far
    while True:
        q = np.flatnonzero(lo < hi)
        if not len(q):
            return lo
        mid = (lo[q] + hi[q]) >> 1
        at, same = sa[mid], np.minimum(seen_lo[q], seen_hi[q])
        live = np.arange(len(q))
        while len(live):
            k = same[live]
            equal = (k < tests.need[q[live]]) & (seq[at[live] + k] == tests.words[tests.start[q[live]] + k])
            live = live[equal]
            same[live] += 1
        whole = same >= tests.need[q]
        below = seq[at + np.where(whole, 0, same)] < tests.words[tests.start[q] + np.where(whole, 0, same)]
        right = np.where(whole, upper, below)
        lo[q[right]], seen_lo[q[right]] = mid[right] + 1, same[right]
        hi[q[~right]], seen_hi[q[~right]] = mid[~right], same[~right]


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of so many things of each owner."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _maximal(seq: np.ndarray, sa: np.ndarray, tests: Tests, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, position) of the occurrences in sa[lo:hi] that the word before doesn't prolong.

    A longest match is never prolonged by a word before. Runs of suffixes with the same word before are taken or left
    whole, so that repeated text, where nearly every occurrence is part of a longer one, isn't enumerated.
    """
    before = np.where(sa > 0, seq[np.maximum(sa - 1, 0)], np.uint64(0))
    run = np.append(0, np.cumsum((before[1:] != before[:-1]) | (before[1:] == 0)))
    starts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(sa))
    some = np.flatnonzero(hi > lo)
    own, k = _spread(run[hi[some] - 1] - run[lo[some]] + 1)
    q = some[own]
    r = run[lo[q]] + k
    word = before[starts[r]]
    whole = (word == 0) | (tests.offset[q] == 0) | (word != tests.words[np.maximum(tests.start[q] - 1, 0)])
    q, r = q[whole], r[whole]
    first, stop = np.maximum(lo[q], starts[r]), np.minimum(hi[q], starts[r + 1])
    own, k = _spread(stop - first)
    return q[own], sa[first[own] + k]


def _blocks(words: np.ndarray, levels: int) -> list[np.ndarray]:
    """Names of the runs of 1, 2, 4, ... words that begin at each place."""
    out = [words]
    for k in range(levels):
        after = np.zeros_like(words)
        after[: max(0, len(words) - (1 << k))] = out[-1][1 << k :]
        out.append(mix64(out[-1] * np.uint64(0x9E3779B97F4A7C15) + after))
    return out


def _extended(seq: np.ndarray, tests: Tests, q: np.ndarray, at: np.ndarray, steps: int = 256) -> np.ndarray:
    """Words that test suffix q and the text at `at` share, given that they share as many as q needs.

    Word by word for some steps; what goes on after them by runs of words, halving.
    """
    size = tests.need[q].copy()
    live = np.arange(len(q))
    for _ in range(steps):
        k = size[live]
        live = live[(k < tests.length[q[live]]) & (seq[at[live] + k] == tests.words[tests.start[q[live]] + k])]
        if not len(live):
            return size
        size[live] += 1
    items, item = np.unique(tests.item[q[live]], return_inverse=True)
    head = (tests.start - tests.offset)[q[live]]
    heads = np.zeros(len(items), np.int64)
    heads[item] = head
    n = tests.item_tokens[items]
    own, k = _spread(n)
    levels = int(np.log2(max(1, n.max())))
    mine, theirs = _blocks(tests.words[heads[own] + k], levels), _blocks(seq, levels)
    place = (np.cumsum(n) - n)[item] + tests.offset[q[live]]
    for level in range(levels, -1, -1):
        width = 1 << level
        k = size[live]
        fits = np.flatnonzero((k + width <= tests.length[q[live]]) & (at[live] + k + width <= len(seq)))
        same = fits[mine[level][place[fits] + k[fits]] == theirs[level][at[live[fits]] + k[fits]]]
        size[live[same]] += width
    return size


def longest_matches(data: np.ndarray, offsets: np.ndarray, tests: Tests) -> dict[str, np.ndarray]:
    """For each (row, item) that share a run of enough words: the longest, and where it lies in both."""
    words, rows, begin, end = tokenise(data, offsets)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) + row  # one separator after each row
    seq = np.zeros(len(words) + len(n) + 1, np.uint64)
    seq[place] = np.maximum(words, np.uint64(1))
    none = {k: np.zeros(0, np.int64) for k in ("row", "item", "tokens", "item_offset", "byte_start", "byte_end")}
    if not len(words) or not len(tests.start):
        return none
    sa = suffix_array(seq)
    q, at = _maximal(seq, sa, tests, _bound(seq, sa, tests, False), _bound(seq, sa, tests, True))
    if not len(q):
        return none
    size = _extended(seq, tests, q, at)
    of = np.zeros(len(seq), np.int64)
    of[place] = np.arange(len(words))
    token = of[at]
    if tests.as_line[q].any():
        line = np.cumsum(data == 10)[begin]
        starts = np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))
        stops = np.append(starts[1:], True)
        fine = ~tests.as_line[q] | (starts[token] & stops[token + size - 1])
        q, token, size = q[fine], token[fine], size[fine]
        if not len(q):
            return none
    order = np.lexsort((tests.offset[q], token, -size, tests.item[q], row[token]))
    r, i = row[token][order], tests.item[q][order]
    best = order[np.append(True, (r[1:] != r[:-1]) | (i[1:] != i[:-1]))]
    t, s, q = token[best], size[best], q[best]
    return {"row": row[t], "item": tests.item[q], "tokens": s, "item_offset": tests.offset[q], "byte_start": begin[t] - offsets[row[t]], "byte_end": end[t + s - 1] - offsets[row[t]]}


def _slices(benchmark: DataFrame, item_col: str, text_col: str, slice_bytes: int) -> Iterator[list[tuple]]:
    """The items in slices of bounded size: a large set of tests costs more passes, not more memory."""
    items = Columns(benchmark).select(item=item_col, text=text_col).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = max(1, -(-size // slice_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        if rows := sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is not None, r)):
            yield rows


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, least_item: int = LEAST_ITEM, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, match_tokens, item_tokens, item_offset, byte_start, byte_end): the longest verbatim match of
    each document with each benchmark item, where it has min_tokens words or is the whole item.

    Every shard of documents (what fits in a few MB, a longer document alone and whole) gets a suffix array of its
    words, in which every suffix of every test item is binary-searched; the occurrences that no word before prolongs
    are then extended to their full length. Words are compared in lower case, without the punctuation between them; in
    scripts without spaces each character is a word. An item of fewer than least_item words counts where it makes up
    whole lines of a text. Of equally long matches the first in the document counts, and of these the first in the
    item. byte_start and byte_end are its place in the UTF-8 text.

    Nulls: a null text (on either side) and one without words match nothing; null ids are returned as nulls. Repeated
    documents are each reported; repeated items once. Empty tables give no rows. Other columns are ignored, whatever
    their names.
    """
    t = Columns(docs)
    slim = t.select(id=id_col, text=text_col)
    item_type = Columns(benchmark).select(item=item_col).schema[0].dataType
    schema = T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("item", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("match_tokens", "item_tokens", "item_offset", "byte_start", "byte_end")]])
    out = None
    spark = docs.sparkSession
    for items in _slices(benchmark, item_col, item_text_col, slice_bytes):
        shared = spark.sparkContext.broadcast(suffixes_of(items, min_tokens, least_item))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for batch in batches:
                data, offsets = text_buffers(batch.column(1))
                for i, j in chunks(offsets):
                    m = longest_matches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tests)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(m["row"] + i)), *[pa.array(x.astype(np.int32 if k == 0 else np.int64)) for k, x in enumerate((m["item"], m["tokens"], tests.item_tokens[m["item"]], m["item_offset"], m["byte_start"], m["byte_end"]))]],
                        names=schema.names,
                    )

        found = slim.mapInArrow(search, schema)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, item_type)]))
        named = found.join(names, "item").select(id_col, item_col, "match_tokens", "item_tokens", "item_offset", "byte_start", "byte_end")
        out = named if out is None else out.unionByName(named)
    if out is None:
        final = T.StructType([schema[0], T.StructField(item_col, item_type), *schema.fields[2:]])
        return spark.createDataFrame([], final)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, least_item: int = LEAST_ITEM, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs that share no such match (see benchmark_matches) with any item, columns and all.

    Rows with a null or wordless text stay; so does every row if the items are none. Repeated rows go or stay together.
    Columns with clashing names travel along. Nothing is shuffled: rows are dropped where they are searched.
    """
    t = Columns(docs)
    kept = t.df
    at = t.outer.index(text_col)
    for items in _slices(benchmark, item_col, item_text_col, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(suffixes_of(items, min_tokens, least_item))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(batch.column(at))
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, j in chunks(offsets):
                    keep[longest_matches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value)["row"] + i] = False
                yield batch if keep.all() else pc.filter(batch, pa.array(keep))

        kept = kept.mapInArrow(clean, kept.schema)
    return t.restore(kept)
