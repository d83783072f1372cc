"""Toxic documents by weak supervision: voters, a generative label model, and a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import Columns, chunks, lowered, prefix_hashes, small_side, text_buffers, tokenise, write_table

#: Insults of general English, in three lexicons.
LEXICONS = (
    ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "dimwit", "retard"),
    ("trash", "scum", "clown", "filth", "vermin", "garbage", "bastard", "bitch"),
    ("pathetic", "loser", "worthless", "disgusting", "ugly", "hateful", "asshole", "shit", "fuck"),
)
#: Labelled documents of each class from which lexicons of words and word beginnings are mined.
DEV_DOCS = 3000
#: A mined entry is in so many toxic documents of those and so many times as frequent there as in the others.
MINED_DOCS, MINED_ODDS = 8, 12.0
#: Documents of each class of posterior labels that the classifier is trained on.
TRAIN_DOCS = 3000
PREFIXES = (6, 7, 8)
CUTOFF = 0.5
#: Votes: three general lexicons; words mined from labels, and words that only begin like such; patterns over all of
#: these: two different ones, and many for the length of the text.
VOTERS = ("lexicon_a", "lexicon_b", "lexicon_c", "mined_words", "mined_beginnings", "several", "dense")
#: Correlation of two voters within the classes from which the label model has a factor for them.
LEAST_CORRELATION = 0.2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the words and word beginnings of each row, as often as they occur; words of each row; and the
    hash of the word that each is of."""
    words, rows, start, end = tokenise(data, offsets)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    parts = [(row, words, words), *[(row[live], h, words[live]) for live, h in prefix_hashes(lowered(data), start, end, PREFIXES)]]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), n, np.concatenate([p[2] for p in parts])


def once(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of a row and a feature once."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.append(True, (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], feature[new]


def word_hash(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8)
    return tokenise(b, np.array([0, len(b)]))[0][0]


class Lookup:
    """Sorted hashes, and a table of their low bits that rules nearly all others out."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.low_bits = np.zeros(1 << 16, bool)
        self.low_bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of f are there, their places among the hashes)."""
        maybe = np.flatnonzero(self.low_bits[(f & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, f[maybe]), max(0, len(self.hashes) - 1))
        there = self.hashes[at] == f[maybe] if len(self.hashes) else np.zeros(0, bool)
        return maybe[there], at[there]


class Known:
    """All entries of the lexicons: the general lexicon of each (0 to 2), 3 for mined words, 4 for mined beginnings."""

    def __init__(self, words: np.ndarray, beginnings: np.ndarray):
        entries = {int(h): 4 for h in beginnings} | {int(h): 3 for h in words} | {int(word_hash(w)): j for j, lexicon in enumerate(LEXICONS) for w in lexicon}
        self.find = Lookup(np.array(sorted(entries), np.uint64))
        self.lexicon = np.array([entries[int(h)] for h in self.find.hashes])


def vote(data: np.ndarray, offsets: np.ndarray, known: Known) -> np.ndarray:
    """For each row, the voters that find it toxic, as bits."""
    r, f, n, word = features(data, offsets)
    rows = len(n)
    which, at = known.find(f)
    r, word, kind = r[which], word[which], known.lexicon[at]
    whole = kind < 4
    begins = ~whole & ~np.isin(word, known.find.hashes[known.lexicon < 4])  # a word that is known itself doesn't count twice
    bits = np.zeros(rows, np.int64)
    for j in range(5):
        bits[r[(kind == j) & (begins if j == 4 else whole)]] |= 1 << j
    hits = np.bincount(r[whole], minlength=rows)
    own, begun = once(r[begins], word[begins])
    different, _ = once(np.append(r[whole], own), np.append(word[whole], begun))
    bits |= (np.bincount(different, minlength=rows) >= 2).astype(np.int64) << 5
    bits |= ((hits + np.bincount(own, minlength=rows)) * 50 >= np.maximum(n, 1)).astype(np.int64) << 6
    return bits


# ---------------------------------------------------------------- label model


@dataclass
class LabelModel:
    """P(toxic); fires[class, voter]: how often a voter fires in a class; pairs: voters that have a factor together;
    log_p[class, pattern]: the probability of every pattern of votes."""

    prior: float
    fires: np.ndarray
    pairs: list[tuple[int, int]]
    log_p: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        clean, toxic = self.log_p[:, np.asarray(patterns)]
        z = np.log(self.prior / (1 - self.prior)) + toxic - clean
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def bits_of(patterns: np.ndarray, voters: int) -> np.ndarray:
    return ((np.asarray(patterns)[:, None] >> np.arange(voters)) & 1).astype(float)


def _independent(prior: float, fires: np.ndarray) -> LabelModel:
    every = bits_of(np.arange(1 << fires.shape[1]), fires.shape[1])
    return LabelModel(prior, fires, [], np.log(fires) @ every.T + np.log(1 - fires) @ (1 - every).T)


def _with_pairs(prior: float, fires: np.ndarray, together: np.ndarray, pairs: list[tuple[int, int]], sweeps: int = 8) -> LabelModel:
    """The log-linear model with a factor for each voter and each of the pairs: in each class voters fire as often as
    `fires`, and pairs as often together as `together`; by iterative scaling over all patterns."""
    model = _independent(prior, fires)
    voters = fires.shape[1]
    every = bits_of(np.arange(1 << voters), voters).astype(int)
    cells = [(j, k, 2 * every[:, j] + every[:, k]) for j, k in pairs]
    for _ in range(sweeps):
        for j, k, cell in cells:
            for c in (0, 1):
                both = min(together[c, j, k], fires[c, j], fires[c, k])
                want = np.maximum([1 - fires[c, j] - fires[c, k] + both, fires[c, k] - both, fires[c, j] - both, both], 1e-9)
                now = np.bincount(cell, np.exp(model.log_p[c]), 4)
                model.log_p[c] += np.log(want / want.sum() / np.maximum(now, 1e-300))[cell]
    return LabelModel(prior, fires, pairs, model.log_p)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, voters: int = len(VOTERS), rounds: int = 60, paired_rounds: int = 200) -> LabelModel:
    """Expectation maximisation over the counts of all vote patterns; the first guess is that two votes mean toxic.

    Each class fires each voter at a rate of its own (its accuracy). Rounds with independent voters tell the classes
    apart first. Voters that then still agree more, or less, within the classes than chance has it get a factor for
    their pair, and further rounds estimate rates, factors and labels together: what two voters have in common by
    themselves is no longer taken for evidence.
    """
    bits = bits_of(patterns, voters)
    toxic = np.where(bits.sum(axis=1) >= 2, 0.95, np.where(bits.sum(axis=1) == 1, 0.2, 0.001))

    def rates(paired: bool = False) -> tuple:
        weight = np.stack([(1 - toxic) * counts, toxic * counts]).astype(float)
        total = weight.sum(axis=1)
        prior = float(np.clip((total[1] + 1) / (total.sum() + 2), 1e-6, 0.5))
        fires = np.clip((weight @ bits + np.array([[0.01], [1.0]])) / (total[:, None] + 2), 1e-6, 0.999)
        return (prior, fires, np.einsum("cp,pj,pk->cjk", weight, bits, bits) / (total[:, None, None] + 2)) if paired else (prior, fires)

    for _ in range(rounds):
        model = _independent(*rates())
        toxic = model.posterior(patterns)
    cov = np.eye(voters) * 1e-9
    for c, w in ((0, (1 - toxic) * counts), (1, toxic * counts)):
        off = bits - model.fires[c]
        cov += (off * w[:, None]).T @ off
    deviation = np.sqrt(np.diag(cov))
    correlation = cov / np.outer(deviation, deviation)
    pairs = [(j, k) for j in range(voters) for k in range(j + 1, voters) if abs(correlation[j, k]) >= LEAST_CORRELATION]
    for _ in range(paired_rounds if pairs else 0):
        model = _with_pairs(*rates(True), pairs)
        toxic = model.posterior(patterns)
    return model


# ---------------------------------------------------------------- linear classifier


@dataclass
class Linear:
    """Weights of the features (hashes, in order) that have any, and the bias."""

    find: Lookup
    weights: np.ndarray
    bias: float

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """A text's feature counts once, however often it occurs."""
        which, at = self.find(feature)
        r, at = once(row[which], at)
        z = np.bincount(r, self.weights[at], rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(row: np.ndarray, feature: np.ndarray, rows: int, target: np.ndarray, weight: np.ndarray, l1: float = 1.5e-4, steps: int = 500, tolerance: float = 2e-3) -> Linear:
    """Logistic regression with an L1 penalty on binary features, by accelerated proximal gradient steps, until twenty of
    them lower the objective by less than tolerance x what it is at first (or so many steps)."""
    names, column = np.unique(feature, return_inverse=True)
    size = len(names)
    w, bias, look, look_b, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 1.0
    weight = weight / weight.sum()
    v, norm = np.ones(rows), 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        v = np.bincount(row, np.bincount(column, (weight * v)[row], size)[column], rows) + (weight * v).sum()
        norm = float(np.abs(v).max()) or 1.0
        v /= norm
    rate = 4.0 / (1.1 * norm)
    first = last = np.inf
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, look[column], rows) + look_b, -50, 50)))
        d = (p - target) * weight
        new = look - rate * np.bincount(column, d[row], size)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = look_b - rate * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - bias)
        if ((look - new) * (new - w)).sum() < 0:
            t2 = 1.0
        w, bias, t = new, new_b, t2
        if step % 20 == 19:
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], rows) + bias, -50, 50)))
            now = -(weight * (target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12))).sum() + l1 * np.abs(w).sum()
            first = now if first == np.inf else first
            if last - now < tolerance * first:
                break
            last = now
    some = w != 0
    return Linear(Lookup(names[some]), w[some], bias)


# ---------------------------------------------------------------- plan


def _texts_of(t: Columns, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text and the columns of ids) for a bounded number of ids."""
    ids = small_side(write_table(ids, "toxic-chosen"), F.lit(48))
    return t.select(id=id_col, text=text_col).where("text is not null").join(ids, "id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def mine(docs: DataFrame, labels: DataFrame, dev_docs: int = DEV_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and of word beginnings, that mark toxic documents, from a bounded sample of labelled ones."""
    own = Columns(labels).select(id=id_col, label=label_col).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit("dev"), "id"), "id"))
    texts = write_table(_texts_of(Columns(docs), own.withColumn("nth", nth).where(F.col("nth") <= dev_docs).select("id", "label"), id_col, text_col).select("label", "text"), "toxic-dev")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            label = batch.column(0).to_numpy()
            for i, j in chunks(offsets):
                r, f, _, word = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                r, f = once(r, f)
                names, at = np.unique(f, return_inverse=True)
                bad = np.bincount(at, label[i:j][r], len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(names)) - bad), pa.array(np.isin(names, word))], names=["feature", "bad", "good", "whole"])

    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    sums = texts.mapInArrow(count, "feature bigint, bad bigint, good bigint, whole boolean").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.max("whole").alias("whole"))
    odds = (F.col("bad") + 0.5) / F.lit(n.get(1, 0) + 1) / ((F.col("good") + 0.5) / F.lit(n.get(0, 0) + 1))
    found = sums.where((F.col("bad") >= MINED_DOCS) & (odds >= MINED_ODDS)).select("feature", "whole").toArrow()  # fewer than the words of the sample
    names, whole = found["feature"].to_numpy().view(np.uint64), np.asarray(found["whole"])
    general = " ".join(w for words in LEXICONS for w in words).encode()  # the mined voters are to add to the general ones
    new = ~np.isin(names, features(np.frombuffer(general, np.uint8), np.array([0, len(general)]))[1])
    return names[new & whole], names[new & ~whole]


def _training_features(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of each different feature, and class and posterior of each row, of (class, posterior, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            out = []
            for i, j in chunks(offsets):
                r, f = once(*features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[:2])
                ends = np.searchsorted(r, np.arange(j - i + 1))
                out += [f[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["class", "posterior", "features"])

    found = texts.select("class", "posterior", "text").mapInArrow(read, "class int, posterior double, features binary").toArrow()
    each = [np.frombuffer(x.as_buffer(), np.uint64) for x in found["features"]]
    row = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
    return row, np.concatenate([*each, np.zeros(0, np.uint64)]), found["class"].to_numpy(), found["posterior"].to_numpy()


def toxicity_scores(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, train_docs: int = TRAIN_DOCS, dev_docs: int = DEV_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) of every row: the classifier's probability, and whether it reaches the cutoff.

    1. Voters look at every document; two use lexicons mined from a bounded sample of labels. 2. The label model is
    fitted to the counts of all vote patterns. 3. A linear classifier over words and word beginnings is trained on the
    posterior labels of a bounded sample of documents of either posterior. 4. It scores every whole document.

    Nulls: a null or empty text has no feature and gets the score of the bias alone. Null ids are returned but not
    trained on; repeated rows get equal scores; empty labels only cost the mined voters; an empty table gives no rows.
    """
    t = Columns(docs)
    spark = docs.sparkSession
    slim = t.select(id=id_col, text=text_col)
    known = spark.sparkContext.broadcast(Known(*mine(docs, labels, dev_docs, id_col, text_col)))

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            bits = [vote(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known.value) for i, j in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64))], names=["id", "votes"])

    votes = write_table(slim.mapInArrow(cast_votes, T.StructType([slim.schema[0], T.StructField("votes", T.LongType())])), "toxic-votes")
    cells = sorted((r["votes"], r["count"]) for r in votes.groupBy("votes").count().collect())  # at most 2 ** voters rows
    linear = Linear(Lookup(np.zeros(0, np.uint64)), np.zeros(0), -10.0)
    if cells:
        patterns, counts = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
        posterior = fit_label_model(patterns, counts).posterior(patterns)
        table = spark.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, posterior, strict=True)], "votes bigint, posterior double")
        own = votes.where("id is not null").join(F.broadcast(table), "votes").withColumn("class", (F.col("posterior") >= 0.5).cast("int"))
        nth = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64(F.lit("train"), "id"), "id"))
        chosen = own.groupBy("id").agg(F.max("posterior").alias("posterior"), F.max("class").alias("class")).withColumn("nth", nth).where(F.col("nth") <= train_docs).drop("nth")
        row, feature, kind, target = _training_features(_texts_of(t, chosen, id_col, text_col))
        if len(kind):
            share = np.array([counts[(posterior >= 0.5) == bool(k)].sum() / max(1, (kind == k).sum()) for k in (0, 1)])
            share[1] = max(share[1], share[0])  # a rare toxic document counts for as much as a clean one
            linear = fit_linear(row, feature, len(kind), target, share[kind])
    shared = spark.sparkContext.broadcast(linear)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = [np.zeros(0)]
            for i, j in chunks(offsets):
                r, f, n, _ = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out.append(shared.value.scores(r, f, len(n)))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= cutoff)], names=[id_col, "score", "toxic"])

    return slim.mapInArrow(score, T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))
