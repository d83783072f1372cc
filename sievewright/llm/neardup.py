"""Near-duplicate groups by Order MinHash sketches, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import Columns, Mapped, chunks, mix64, text_buffers, text_digest, tokenise, write_table
from sievewright.storage import delete_path, new_path

#: Edit similarity (in words) from which texts are near.
THRESHOLD = 0.8
#: Families of sketches: (words in a k-mer, k-mers in a sketch, sketches, least and most words of a text that has them).
#: The ranges overlap by more than the threshold lets lengths differ, so any two near texts have a family in common.
FAMILIES = ((1, 4, 48, 1, 48), (3, 3, 24, 38, None), (1, 6, 40, 38, None))
#: Counters of words (by hash) that order words by rarity.
COUNTERS = 1 << 18
#: Bits, by digest, that tell the texts that need no alignment from most of those that may: 64 for each that may, and
#: at least and most so many (powers of two), as every executor gets a file of them.
LEAST_BITS, BITS = 1 << 22, 1 << 27
#: Counters of words (by hash) of one text, for a bound on its distance to another.
BAG = 256

_rng = np.random.default_rng(97)
_MULTIPLY = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, 4096, dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def labelled_kmers(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (k-mer, how often it occurred before in the row), in text order, and the rows' offsets in them.

    A row of 1 to k - 1 words has one k-mer, of all its words.
    """
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(n)), count)
    at = rows[:-1][row] + np.arange(len(row)) - out[:-1][row]
    h = np.zeros(len(row), np.uint64)
    end = rows[1:][row]
    for i in range(k):
        there = at + i < end
        h = mix64(h * _GOLD + np.where(there, words[np.minimum(at + i, max(len(words) - 1, 0))], np.uint64(0)) + np.uint64(i + 1))
    own = h ^ mix64(row.astype(np.uint64) + np.uint64(7))
    order = np.argsort(own, kind="stable")
    s = own[order]
    new = np.append(True, s[1:] != s[:-1]) if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else new
    occurrence = np.zeros(len(s), np.uint64)
    occurrence[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return mix64(h + occurrence * _GOLD), out


def order_sketches(x: np.ndarray, sketches: int, ell: int) -> np.ndarray:
    """Of one document's labelled k-mers, for each sketch: the ell smallest under its hash, in text order, as one hash."""
    ell = min(ell, len(x))
    picked = np.empty((sketches, ell), np.int64)
    step = max(1, 262144 // len(x))
    for s in range(0, sketches, step):
        e = min(sketches, s + step)
        h = ((x[None, :] * _MULTIPLY[s:e, None] + _ADD[s:e, None]) >> np.uint64(32)).astype(np.uint32)
        lines = np.arange(e - s)
        for j in range(ell):
            least = h.argmin(axis=1)
            picked[s:e, j] = least
            h[lines, least] = np.uint32(0xFFFFFFFF)
    picked.sort(axis=1)
    sig = np.arange(sketches, dtype=np.uint64) + np.uint64(ell * 100_003)
    for j in range(ell):
        sig = mix64(sig * _GOLD + x[picked[:, j]])
    return sig


def sketch_texts(data: np.ndarray, offsets: np.ndarray, families: tuple = FAMILIES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each row, and its sketches."""
    words, rows, _, _ = tokenise(data, offsets)
    n = np.diff(rows)
    out: list[list[np.ndarray]] = [[] for _ in n]
    made = {k: labelled_kmers(words, rows, k) for k in {f[0] for f in families}}
    for number, (k, ell, sketches, least, most) in enumerate(families):
        x, at = made[k]
        for i in np.flatnonzero((n >= least) & (n <= (most or n.max(initial=0)))):
            out[i].append(mix64(order_sketches(x[at[i] : at[i + 1]], sketches, ell) + np.uint64(number)))
    return n, [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in out]


# ---------------------------------------------------------------- rare words


def labelled_words(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes of (word, how often it occurred before in the row), in text order."""
    return labelled_kmers(words, rows, 1)[0]


def rarest(x: np.ndarray, counters: np.ndarray, threshold: float) -> np.ndarray:
    """Of one text's labelled words, so many of the rarest that any near text has one of them among its own rarest.

    Of n words a near text lacks at most a share 1 - threshold; so two near texts, both in the same order of rarity,
    have a word in common among the first (1 - threshold) n + 1. Words whose counter says that no other text has them
    join nothing and are left out.
    """
    count = counters[(x % np.uint64(len(counters))).astype(np.int64)]
    first = np.lexsort((x, count))[: int((1 - threshold) * len(x) + 1e-9) + 1]
    return x[first[count[first] > 1]]


# ---------------------------------------------------------------- alignment


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Edit distances of pairs of sequences, of alignments that stay within k of the diagonal: exact where the true
    distance is at most k, an upper bound otherwise; large where the lengths differ by more than k."""
    p, w = len(a), 2 * k + 1
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    top = int(n.max(initial=0))
    wide = np.full((p, top + w + 1), -1, np.int64)
    tall = np.full((top, p), -2, np.int64)
    for i in range(p):
        tall[: n[i], i] = a[i]
        own = b[i][: top + k + 1]
        wide[i, k : k + len(own)] = own
    far = 1 << 29
    across = np.arange(w, dtype=np.int32)
    now = np.broadcast_to(np.where(across >= k, across - k, far).astype(np.int32), (p, w)).copy()
    out = np.full(p, far, np.int64)
    reach = np.abs(m - n) <= k
    zero = np.flatnonzero((n == 0) & reach)
    out[zero] = m[zero]
    by_end: dict[int, list[int]] = {}
    for i in np.flatnonzero((n > 0) & reach):
        by_end.setdefault(int(n[i]), []).append(int(i))
    for r in range(1, top + 1):
        new = now + (tall[r - 1][:, None] != wide[:, r - 1 : r - 1 + w])
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        new -= across
        np.minimum.accumulate(new, axis=1, out=new)
        now = (new + across).astype(np.int32, copy=False)
        for i in by_end.get(r, ()):
            out[i] = now[i, m[i] - n[i] + k]
    return out


def near(a: list[np.ndarray], b: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether 1 - edit distance / longer length reaches the threshold, for each pair of word sequences."""
    n = len(a)
    result = np.zeros(n, dtype=bool)
    most = [int((1 - threshold) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if abs(len(x) - len(y)) > most[i]:
            continue
        s = min(len(x), len(y))
        differ = np.flatnonzero(x[:s] != y[:s])
        lead = int(differ[0]) if len(differ) else s
        x, y = x[lead:], y[lead:]
        s = min(len(x), len(y))
        differ = np.flatnonzero(x[len(x) - s :][::-1] != y[len(y) - s :][::-1])
        tail = int(differ[0]) if len(differ) else s
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if max(len(x), len(y)) <= most[i]:
            result[i] = True
            continue
        values, counts = np.unique(np.concatenate([x, y]), return_inverse=True)
        in_x, in_y = np.bincount(counts[: len(x)], minlength=len(values)), np.bincount(counts[len(x) :], minlength=len(values))
        if max(len(x), len(y)) - np.minimum(in_x, in_y).sum() > most[i]:  # no alignment can be better than the bags
            continue
        todo.append((i, counts[: len(x)], counts[len(x) :]))
    width = 16
    while todo:
        todo.sort(key=lambda t: len(t[1]))
        left: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(todo):
            e, cells = at, 0
            k = min(width, max(most[t[0]] for t in todo[at : at + 512]))
            while e < len(todo) and e - at < 512 and (e == at or (e + 1 - at) * (len(todo[e][1]) + 2 * k) <= 1 << 20):
                e += 1
            group = todo[at:e]
            k = min(width, max(most[t[0]] for t in group))
            found = banded_distance([t[1] for t in group], [t[2] for t in group], k)
            for (i, x, y), d in zip(group, found, strict=True):
                if d <= most[i]:
                    result[i] = True
                elif k < most[i]:
                    left.append((i, x, y))
            at = e
        todo, width = left, width * 4
    return result


def bag_of(words: np.ndarray) -> bytes:
    """How many of the words have each of BAG hashes; one, two, four or eight bytes for each, as the largest needs."""
    n = np.bincount((words % np.uint64(BAG)).astype(np.int64), minlength=BAG)
    return n.astype(np.min_scalar_type(n.max())).tobytes()


def maybe_near(a: list[bytes], b: list[bytes], threshold: float = THRESHOLD) -> np.ndarray:
    """Of pairs of bag_of(): False where no texts with these bags are near; no near pair is lost.

    Texts share at most as many words as their bags, and no alignment is better than the words they share.
    """
    result = np.zeros(len(a), dtype=bool)
    for i, sides in enumerate(zip(a, b, strict=True)):
        x, y = (np.frombuffer(side, f"u{len(side) // BAG}").astype(np.int64) for side in sides)
        longer = int(max(x.sum(), y.sum()))
        result[i] = longer - np.minimum(x, y).sum() <= int((1 - threshold) * longer + 1e-9)
    return result


# ---------------------------------------------------------------- plan


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node of its connected component.

    Each round a node takes the smallest root among its neighbours' and then its root's root, so long chains halve;
    rounds are written to the shared folder until none changes.
    """
    both = write_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    roots = write_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), label)
    while True:
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        lower = roots.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "seen").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = write_table(lower.join(jump, "root", "left").select("node", "was", F.coalesce(F.least("root", "up"), "root").alias("root")), label)
        roots = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return roots


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) with whether their texts are near."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                batch = whole.slice(s, 512)
                sides = []
                for c in (2, 3):
                    data, offsets = text_buffers(batch.column(c))
                    words, rows, _, _ = tokenise(data, offsets)
                    sides.append([words[i:j] for i, j in zip(rows[:-1], rows[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near(*sides, threshold))], names=["a", "b", "near"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(align, "a binary, b binary, near boolean")


def _token_counts(texts: DataFrame) -> np.ndarray:
    """In how many of the texts (node, text) a labelled word occurs, by hash; at most COUNTERS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in chunks(offsets):
                words, rows, _, _ = tokenise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += np.bincount((labelled_words(words, rows) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["counter", "n"])

    found = texts.select("text").mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def _rare_words(texts: DataFrame, threshold: float) -> DataFrame:
    """(key, word) of the rarest() words of texts (node, text); of copies, each time."""
    shared = texts.sparkSession.sparkContext.broadcast(_token_counts(texts))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                words, rows, _, _ = tokenise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x = labelled_words(words, rows)
                own = [rarest(x[a:b], shared.value, threshold) for a, b in zip(rows[:-1], rows[1:], strict=True)]
                row = np.repeat(np.arange(len(own)), [len(o) for o in own])
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(batch.column(0))[row + i]), pa.array(flat.view(np.int64))], names=["key", "word"])

    return texts.select("node", "text").mapInArrow(pick, "key bigint, word bigint")


def _keys(nodes: pa.Array) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(nodes.to_pylist()), np.int64).reshape(-1, 2)[:, 0]


def _places(nodes: pa.Array, size: int) -> np.ndarray:
    """A bit among `size` for each digest, or its key."""
    keys = nodes.to_numpy() if pa.types.is_int64(nodes.type) else _keys(nodes)
    return (keys.view(np.uint64) % np.uint64(size)).astype(np.int64)


def _marks(nodes: DataFrame, size: int = BITS) -> Callable[[Column], Column]:
    """Of a digest: whether it may be in nodes (a column of digests or keys); true for all that are.

    What tasks read is at most size / 8 bytes, however many nodes there are.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(batch.column(0), size)).astype(np.int32))], names=["place"])

    places = nodes.mapInArrow(mark, "place int").toArrow()["place"].to_numpy()  # 4 bytes a node
    while size > max(LEAST_BITS, 64 * len(places)):
        size //= 2
    places = places % size
    bits = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    shared = Mapped(nodes.sparkSession, bits=bits)

    @F.arrow_udf("boolean")
    def marked(node: pa.Array) -> pa.Array:
        at = _places(node, size)
        return pa.array(shared.arrays["bits"][at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return marked


def _maybe_in(base: DataFrame, nodes: DataFrame, size: int = BITS) -> DataFrame:
    """base without most of the rows whose node isn't in nodes (digests or keys), so that their texts aren't shuffled
    for a join. No row of a node in nodes is lost."""
    return base.where(_marks(nodes, size)("node"))


def _bags(texts: DataFrame) -> DataFrame:
    """(key, node, bag) of texts (node, text), once for each node."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                words, rows, _, _ = tokenise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                nodes = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(_keys(nodes)), nodes, pa.array([bag_of(words[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())], names=["key", "node", "bag"])

    return texts.select("node", "text").mapInArrow(count, "key bigint, node binary, bag binary").dropDuplicates(["key", "node"])


def _close(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(key_a, key_b, a, b, close) of pairs (key_a, key_b): all nodes of the keys, and whether their bags let them be near."""
    both = pairs.select("key_a", "key_b")
    for side in "ab":
        both = both.join(bags.select(F.col("key").alias(f"key_{side}"), F.col("node").alias(side), F.col("bag").alias(f"bag_{side}")), f"key_{side}")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(maybe_near(batch.column(4).to_pylist(), batch.column(5).to_pylist(), threshold))], names=["key_a", "key_b", "a", "b", "close"])

    return both.select("key_a", "key_b", "a", "b", "bag_a", "bag_b").mapInArrow(bound, "key_a bigint, key_b bigint, a binary, b binary, close boolean")


def _nodes(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.select(F.col(a).alias("node")).union(pairs.select(F.col(b).alias("node"))).distinct()


def _once(texts: DataFrame) -> DataFrame:
    return texts.groupBy("node").agg(F.first("text").alias("text"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, families: tuple = FAMILIES, text_col: str = "text") -> DataFrame:
    """(node, root): digests of texts that are not alone in their group of near duplicates, and the group's name.

    Equal texts share a digest and count once. Texts with an equal sketch are candidates. In each bucket of an equal
    sketch every text is aligned with the bucket's smallest one. Those that are not near it are then aligned with the
    others of the bucket that share one of their rarest words, as any near one must; so all near pairs of a bucket are
    aligned or already joined through the smallest, while texts that have only a template in common, however many,
    aren't aligned with each other. Pairs whose bags of words are too different to be near are never aligned. Groups
    are the connected components of near pairs.

    Sketches travel with 64 bits of the digest (the key), and all texts of a key are compared; of two texts with the
    same key only their pair with each other isn't a candidate, which for near texts has the odds of 1 to 2 ** 64.

    Null texts have no node; texts without words have no sketch and are alone. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    base = Columns(docs).select(text=text_col).where("text is not null").select(text_digest(F.col("text")).alias("node"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, 1 << 21):
                _, sigs = sketch_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], families)
                row = np.repeat(np.arange(len(sigs)), [len(s) for s in sigs])
                flat = np.concatenate(sigs) if len(sigs) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(_keys(batch.column(0))[row + i])], names=["sig", "key"])

    paths: list[str] = []

    def table(df: DataFrame, label: str) -> DataFrame:
        paths.append(new_path(df.sparkSession, label))
        return write_table(df, label, path=paths[-1])

    sigs = base.mapInArrow(sketch, "sig bigint, key bigint")
    least = F.min("key").over(Window.partitionBy("sig"))  # one shuffle of the sketches, and no table of them
    stars = sigs.withColumn("key_a", least).where("key <> key_a").select("sig", "key_a", F.col("key").alias("key_b"))
    stars = table(stars.dropDuplicates(["sig", "key_b"]), "near-stars")
    pairs = table(stars.select("key_a", "key_b").distinct(), "near-pairs")
    bags = table(_bags(_maybe_in(base, _nodes(pairs, "key_a", "key_b"))), "near-bags")
    close = table(_close(pairs, bags, threshold), "near-close")
    todo = close.where("close").select("a", "b")
    texts = table(_maybe_in(base, _nodes(todo)), "near-texts")
    good = table(_verify(todo, _once(texts), threshold), "near-first").where("near").select("a", "b")
    failed = close.join(good, ["a", "b"], "left_anti").select("key_a", "key_b").distinct()
    again = table(stars.join(failed, ["key_a", "key_b"]).select("sig", F.col("key_b").alias("x")), "near-again")
    met = table(again.select("sig").distinct().join(stars, "sig").select("sig", F.col("key_b").alias("y")), "near-met")
    wide = table(met.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig"), "near-wide")  # in other buckets none is left to meet
    again, met = again.join(wide, "sig", "left_semi"), met.join(wide, "sig", "left_semi")
    members = table(_maybe_in(base, met.select("y").distinct()), "near-members")
    rare = table(_rare_words(members, threshold).distinct(), "near-rare")
    left = again.join(rare.withColumnRenamed("key", "x"), "x")
    right = met.join(rare.withColumnRenamed("key", "y"), "y")
    others = left.join(right, ["sig", "word"]).where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
    second = table(_close(others.join(pairs, ["key_a", "key_b"], "left_anti"), bags, threshold).where("close").select("a", "b"), "near-others")
    texts = table(_maybe_in(base, _nodes(second)), "near-second-texts")
    more = table(_verify(second, _once(texts), threshold).where("near").select("a", "b"), "near-second")
    roots = components(good.union(more), "near-roots")
    for path in paths:
        delete_path(docs.sparkSession, path)
    return roots


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, families: tuple = FAMILIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, keep) for every row that has at least one exact or near copy.

    group_id is the smallest id of the group; keep marks the one row that stays. Two texts are near if the edit
    distance of their word sequences is at most 1 - threshold of the longer; groups are connected components.

    Nulls: rows with a null text are in no group; a null id sorts last, so a group has a null group_id only if all its
    ids are null. Texts without words have only exact copies. Rows that repeat an id are copies of each other if their
    texts are, and one of them is kept. An empty table gives no rows.
    """
    t = Columns(docs)
    rows = t.select(id=id_col, text=text_col).where("text is not null").select("id", text_digest(F.col("text")).alias("node"))
    roots = near_groups(docs, threshold, families, text_col)
    rooted = rows.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    order = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "node")
    group = Window.partitionBy("root")
    out = rooted.withColumn("n", F.row_number().over(order)).withColumn("size", F.count("*").over(group)).withColumn("group_id", F.min("id").over(group))
    return out.where("size > 1").select(F.col("id").alias(id_col), "group_id", (F.col("n") == 1).alias("keep"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, families: tuple = FAMILIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one of each group of near_duplicates(), with the columns of docs.

    The row that stays is the one with the smallest id (nulls last); of rows that repeat that id and text, any one.
    Rows with a null text all stay.
    """
    t = Columns(docs)
    roots = near_groups(docs, threshold, families, text_col)
    node = text_digest(t(text_col))
    ids = t.df.where(t(text_col).isNotNull()).select(t(id_col).alias("id"), node.alias("node")).groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("least"), F.count("*").alias("copies"))
    rooted = ids.join(roots, "node", "left").where("root is not null or copies > 1").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = write_table(rooted, "near-shared")  # all other rows stay, and aren't shuffled
    best = rooted.groupBy("root").agg(F.min(F.struct("least", "node")).alias("best"))
    stays = rooted.join(best, "root").select(F.col("node").alias("__node"), (F.col("node") == F.col("best.node")).alias("__stays"))
    one = Window.partitionBy("__node").orderBy(t(id_col).asc_nulls_last())
    marked = _marks(rooted.select("node"))(F.coalesce(node, F.unhex(F.lit("00" * 16))))
    alone = t.df.where(t(text_col).isNull() | ~marked)
    texts = t.df.where(t(text_col).isNotNull() & marked).withColumn("__node", node).join(stays, "__node", "left").where(F.coalesce("__stays", F.lit(True)))
    kept = texts.withColumn("__nth", F.row_number().over(one)).where("__nth = 1").select(*t.inner)
    return t.restore(alone.unionByName(kept))
