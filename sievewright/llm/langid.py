"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import Columns, chunks, small_side, text_buffers, write_table

HIDDEN = 8
#: Texts are read in windows of so many bytes side by side, then the states at their borders are carried on until they
#: change a state by less than SETTLED; a longer text than BLOCK bytes is read in blocks of windows.
WINDOW, BLOCK, SETTLED = 1024, 1 << 21, 5e-3
#: The most of a state that stays from one byte to the next: an unbounded memory would be worth little to a label.
LONGEST = 0.9
#: Windows are first read from what so many bytes beside them leave, which is close to what the whole text does.
WARM = 64
#: Training: labelled documents of each language (those with the smallest hashes of their ids), pieces of each, evenly
#: spaced over the whole text, steps, windows a step, bytes of a piece.
DOCS_PER_LANG, PIECES, STEPS, BATCH, TRAIN_WINDOW, RATE = 150, 8, 220, 96, 128, 0.02
#: Pooled probability under which a document is rejected.
MIN_PROB = 0.5
#: The label of what is no known language: digits, signs, random letters, codes, other scripts.
UNKNOWN = "und"
_SCRIPTS = ((0x400, 0x44F), (0x391, 0x3C9), (0x4E00, 0x9FA5), (0x5D0, 0x5EA), (0x627, 0x64A), (0x3041, 0x3096))


@dataclass
class Network:
    """Weights of both directions, first axis: x (2, 3H, 256) for each byte, u (2, 3H, H), b (2, 3H); output v (2, L, H), c (L).

    Rows of the gates: update, reset (x / 4 + 1/2, cut off at 0 and at LONGEST or 1), candidate (a hyperbolic
    tangent).
    """

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.v, self.c]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
    g = np.random.default_rng(seed)
    f = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
    return Network(langs, f(2, 3 * hidden, 256, scale=0.3), f(2, 3 * hidden, hidden, scale=0.5 / np.sqrt(hidden)), np.zeros((2, 3 * hidden), np.float32), f(2, len(langs), hidden, scale=0.3), np.zeros(len(langs), np.float32))


def _most(hid: int) -> np.ndarray:
    return np.repeat(np.array([LONGEST, 1], np.float32), hid)


def _softmax(z: np.ndarray, axis: int) -> np.ndarray:
    z = np.exp(z - z.max(axis=axis, keepdims=True))
    z /= z.sum(axis=axis, keepdims=True)
    return z


def train_step(net: Network, text: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of text (steps, batch), and its gradients, by backpropagation through time."""
    steps, batch = text.shape
    hid = net.u.shape[2]
    both = np.stack([text, text[::-1]])
    h = np.zeros((steps + 1, 2, hid, batch), np.float32)
    gates = np.zeros((steps, 2, 3 * hid, batch), np.float32)
    inner = np.zeros((steps, 2, hid, batch), np.float32)
    for t in range(steps):
        a = np.stack([net.x[d][:, both[d, t]] for d in (0, 1)]) + net.b[:, :, None]
        m = net.u @ h[t]
        zr = np.clip(0.25 * (a[:, : 2 * hid] + m[:, : 2 * hid]) + 0.5, 0, _most(hid)[:, None])
        z, r = zr[:, :hid], zr[:, hid:]
        inner[t] = m[:, 2 * hid :]
        n = np.tanh(a[:, 2 * hid :] + r * inner[t])
        gates[t] = np.concatenate([z, r, n], axis=1)
        h[t + 1] = n + z * (h[t] - n)
        h[t + 1, 1] *= mask[steps - 1 - t]  # reading backwards begins at the last byte, not in the padding
    fwd, bwd = h[1:, 0], h[1:, 1][::-1]
    prob = _softmax(net.v[0] @ fwd + net.v[1] @ bwd + net.c[:, None], 1)
    total = max(1, int(mask.sum()))
    hit = prob[np.arange(steps)[:, None], labels[None, :], np.arange(batch)[None, :]]
    loss = float(-(np.log(hit + 1e-9) * mask).sum() / total)
    d = prob
    d[np.arange(steps)[:, None], labels[None, :], np.arange(batch)[None, :]] -= 1
    d *= (mask / total)[:, None, :]
    gv = np.stack([np.einsum("tlb,thb->lh", d, fwd, optimize=True), np.einsum("tlb,thb->lh", d, bwd, optimize=True)])
    gc = d.sum(axis=(0, 2))
    out = np.stack([net.v[0].T @ d, (net.v[1].T @ d)[::-1]], axis=1)  # in the order each direction read
    gx, gu, gb = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.b)
    dh = np.zeros((2, hid, batch), np.float32)
    da = np.zeros((2, 3 * hid, batch), np.float32)
    every = np.zeros((steps, 2, 3 * hid, batch), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = dh + out[t]
        dh[1] *= mask[steps - 1 - t]
        z, r, n = gates[t][:, :hid], gates[t][:, hid : 2 * hid], gates[t][:, 2 * hid :]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h[t] - n) * 0.25 * ((z > 0) & (z < LONGEST))
        dr = dn * inner[t] * 0.25 * ((r > 0) & (r < 1))
        da = np.concatenate([dz, dr, dn], axis=1)
        dm = np.concatenate([dz, dr, dn * r], axis=1)
        gu += dm @ h[t].transpose(0, 2, 1)
        dh = dh * z + net.u.transpose(0, 2, 1) @ dm
        every[t] = da
    gb += every.sum(axis=(0, 3))
    for k in (0, 1):
        one_hot = np.zeros((steps * batch, 256), np.float32)
        one_hot[np.arange(steps * batch), both[k].reshape(-1)] = 1
        gx[k] = every[:, k].transpose(1, 0, 2).reshape(3 * hid, -1) @ one_hot
    return loss, [gx, gu, gb, gv, gc]


def noise(g: np.random.Generator, size: int) -> np.ndarray:
    """Bytes without a language, of one of several kinds, to train the label UNKNOWN on."""
    kind = int(g.integers(0, 5))
    if kind == 0:
        alphabet = "0123456789 .,:-/"
    elif kind == 1:
        alphabet = "!#$%&*+-/<=>?@^_|~ "
    elif kind == 2:
        alphabet = "abcdefghijklmnopqrstuvwxyz  "
    elif kind == 3:
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    else:
        low, high = _SCRIPTS[int(g.integers(0, len(_SCRIPTS)))]
        alphabet = "".join(chr(int(c)) for c in g.integers(low, high + 1, 60)) + "   "
    return np.frombuffer("".join(alphabet[i] for i in g.integers(0, len(alphabet), size)).encode()[:size], np.uint8)


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, window: int = TRAIN_WINDOW, rate: float = RATE, seed: int = 11) -> Network | None:
    """A network for the languages of (text, language), and for UNKNOWN by made examples; None without any text."""
    samples = sorted(s for s in samples if s[0])
    langs = sorted({lang for _, lang in samples} | {UNKNOWN})
    if len(langs) == 1:
        return None
    net = new_network(langs, hidden)
    g = np.random.default_rng(seed)
    by_lang = [[np.frombuffer(t, np.uint8) for t, lang in samples if lang == own] for own in langs]
    first, second = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        labels = g.integers(0, len(langs), batch)
        text, mask = np.zeros((window, batch), np.uint8), np.zeros((window, batch), np.float32)
        for i, k in enumerate(labels):
            doc = by_lang[k][g.integers(0, len(by_lang[k]))] if by_lang[k] else noise(g, window)
            size = window if g.random() < 0.8 else int(g.integers(4, window))
            at = int(g.integers(0, max(1, len(doc) - size + 1)))
            piece = doc[at : at + size]
            text[: len(piece), i], mask[: len(piece), i] = piece, 1
        _, grads = train_step(net, text, mask, labels)
        norm = np.sqrt(sum(float((x * x).sum()) for x in grads))
        lr = rate * min(1.0, 4.0 * (1 - (step - 1) / steps))
        for a, gr, m, s in zip(net.arrays(), grads, first, second, strict=True):
            gr = gr * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (gr - m)
            s += 0.01 * (gr * gr - s)
            a -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


class _Reader:
    """The network's weights as the reading pass uses them: the gates scaled, so that they only need to be cut off."""

    def __init__(self, net: Network):
        self.hid = net.u.shape[2]
        scale, shift = np.ones((3 * self.hid, 1), np.float32), np.zeros((3 * self.hid, 1), np.float32)
        scale[: 2 * self.hid], shift[: 2 * self.hid] = 0.25, 0.5
        self.table = (net.x + net.b[:, :, None]) * scale + shift
        self.u = np.ascontiguousarray(net.u * scale)
        self.net = net

    def _step(self, d: int, byte: np.ndarray, h: np.ndarray, new: np.ndarray, space: tuple | None = None) -> None:
        hid, n = self.hid, len(byte)
        g, m = (np.empty((3 * hid, n), np.float32), np.empty((3 * hid, n), np.float32)) if space is None else (s[: 3 * hid * n].reshape(3 * hid, n) for s in space)
        np.take(self.table[d], byte, axis=1, out=g, mode="clip")
        np.matmul(self.u[d], h, out=m)
        zr, c, mc = g[: 2 * hid], g[2 * hid :], m[2 * hid :]
        zr += m[: 2 * hid]
        np.clip(zr[:hid], 0, LONGEST, out=zr[:hid])
        np.clip(zr[hid:], 0, 1, out=zr[hid:])
        mc *= zr[hid:]
        c += mc
        np.tanh(c, out=c)
        np.subtract(h, c, out=mc)
        mc *= zr[:hid]
        np.add(mc, c, out=new)

    def states(self, d: int, text: np.ndarray, lengths: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        """(steps + 1, unit, window): direction d over the windows of text (steps, windows), whose lengths rise; begin:
        the state of each window at its first place (else nothing). Forwards, [t + 1] is the state after place t;
        backwards, [t] is."""
        steps, batch = text.shape
        h = np.zeros((steps + 1, self.hid, batch), np.float32)
        if begin is not None:
            h[np.zeros(batch, np.int64) if d == 0 else lengths, :, np.arange(batch)] = begin.T
        short = np.searchsorted(lengths, np.arange(steps), side="right")  # windows that end before each place
        space = (np.empty(3 * self.hid * batch, np.float32), np.empty(3 * self.hid * batch, np.float32))
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            s, one, two = short[t], *((t, t + 1) if d == 0 else (t + 1, t))
            self._step(d, text[t, s:], h[one][:, s:], h[two][:, s:], space)
        return h

    def warm(self, d: int, text: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(unit, window): the state that the nearest WARM bytes of the window which is read before each one leave."""
        out = np.zeros((self.hid, len(before)), np.float32)
        at = np.flatnonzero(before >= 0)
        size = min(WARM, len(text))
        beside = text[len(text) - size :, before[at]] if d == 0 else text[:size, before[at]][::-1]
        now = np.zeros((self.hid, len(at)), np.float32)
        for k in range(size if len(at) else 0):
            new = np.empty_like(now)
            self._step(d, beside[k], now, new)
            if d == 1:
                new[:, lengths[before[at]] <= size - 1 - k] = 0
            now = new
        out[:, at] = now
        return out

    def carry(self, h: np.ndarray, d: int, text: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> None:
        """In place: states() as if every window began where the one that direction d reads before it ended.

        before: for each window that one, or -1. Windows are read again from their new beginning as far as that changes
        them; those that it changes to the end pass it on.
        """
        steps = len(text)
        after = np.full(len(before), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        live = np.flatnonzero(before >= 0)
        now = h[steps if d == 0 else 0][:, before[live]]
        began = h[0][:, live] if d == 0 else h[lengths[live], :, live].T
        far = np.abs(now - began).max(axis=0) > SETTLED
        live, now = live[far], now[:, far]
        while len(live):
            now = np.ascontiguousarray(now)
            for k in range(steps):
                t = k if d == 0 else steps - 1 - k
                new = np.empty_like(now)
                self._step(d, text[t, live], now, new)
                there = h[t + 1 if d == 0 else t]
                if (k + 1) % 16 and k + 1 < steps:
                    there[:, live], now = new, new
                    continue
                on = np.abs(new - there[:, live]).max(axis=0) > SETTLED
                if d == 0:
                    on &= k + 1 < lengths[live] + (k + 1 == steps)
                there[:, live] = new
                live, now = live[on], np.ascontiguousarray(new[:, on])
                if not len(live):
                    return
            on = after[live] >= 0
            live, now = after[live[on]], now[:, on]

    def scores(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """What label probabilities are in proportion to; states lie between -1 and 1, so nothing overflows."""
        z = self.net.v[0] @ forward
        z += self.net.v[1] @ backward
        z += self.net.c[:, None]
        return np.exp(z, out=z)


def position_probabilities(net: Network, text: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """(steps, languages, windows): a label distribution for every position of text (steps, windows), each window a
    text of its own; what lies beyond its length is padding, whose labels mean nothing and change no others."""
    reader = _Reader(net)
    lengths = np.full(text.shape[1], len(text)) if lengths is None else lengths
    e = reader.scores(reader.states(0, text, lengths)[1:], reader.states(1, text, lengths)[:-1])
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class _Windows:
    """Windows of some texts, by rising length: their texts, bytes (steps, windows), lengths, and neighbours (or -1)."""

    row: np.ndarray
    text: np.ndarray
    length: np.ndarray
    before: np.ndarray
    after: np.ndarray


def _windows(data: np.ndarray, offsets: np.ndarray, window: int) -> _Windows:
    n = -(-np.diff(offsets) // window)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + window * nth
    length = np.minimum(window, offsets[1:][row] - start)
    order = np.argsort(length, kind="stable")  # windows of like length together, so that few steps are padding
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    before = np.where(nth > 0, at[np.arange(len(row)) - 1], -1)[order] if len(row) else order
    after = np.where(nth + 1 < n[row], at[np.minimum(np.arange(len(row)) + 1, len(row) - 1)], -1)[order] if len(row) else order
    steps = np.arange(int(length.max(initial=0)))
    inside = steps[:, None] < length[order][None, :]
    text = np.where(inside, data[np.minimum(start[order][None, :] + steps[:, None], max(len(data) - 1, 0))], 0).astype(np.intp) if len(row) else np.zeros((0, 0), np.intp)
    return _Windows(row[order], text, length[order], before, after)


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each text (rows, languages): the sum over its positions of the label probabilities, and of the labels.

    Both directions read the whole text, from its first byte to its last and back.
    """
    rows, reader = len(offsets) - 1, _Reader(net)
    prob, label = np.zeros((rows, len(net.langs))), np.zeros((rows, len(net.langs)))
    block = max(window, block // window * window)

    def add(w: _Windows, forward: np.ndarray, backward: np.ndarray, row: np.ndarray) -> None:
        steps = len(w.text)
        for t in range(0, steps, 64):
            s, e = int(np.searchsorted(w.length, t, side="right")), min(steps, t + 64)
            p = reader.scores(forward[t + 1 : e + 1, :, s:], backward[t:e, :, s:])
            hit = p == p.max(axis=1, keepdims=True)
            p /= p.sum(axis=1, keepdims=True)
            if w.length[s] < e:
                inside = (np.arange(t, e)[:, None] < w.length[None, s:])[:, None, :]
                p *= inside
                hit &= inside
            total, hits = p.sum(axis=0), hit.sum(axis=0)
            for k in range(len(net.langs)):
                prob[:, k] += np.bincount(row[s:], total[k], rows)
                label[:, k] += np.bincount(row[s:], hits[k], rows)

    def read(d: int, w: _Windows, entry: np.ndarray | None = None) -> np.ndarray:
        """Direction d over the windows; entry: the state before the first that it reads of a text in several blocks."""
        neighbour = (w.before, w.after)[d]
        begin = reader.warm(d, w.text, w.length, neighbour)
        if entry is not None:
            begin[:, neighbour < 0] = entry[:, None]
        h = reader.states(d, w.text, w.length, begin)
        reader.carry(h, d, w.text, w.length, neighbour)
        return h

    for i, j in chunks(offsets, block):
        if j > i + 1 or offsets[j] - offsets[i] <= block:
            w = _windows(data, offsets[i : j + 1], window)
            if len(w.row):
                add(w, read(0, w), read(1, w), w.row + i)
            continue
        cuts = [*range(int(offsets[i]), int(offsets[j]), block), int(offsets[j])]
        parts = [np.array(c) for c in zip(cuts[:-1], cuts[1:], strict=True)]
        entry, back = None, [None] * len(parts)
        for k in range(len(parts) - 1, 0, -1):  # what the backward direction brings into each block
            w = _windows(data, parts[k], window)
            entry = back[k - 1] = read(1, w, entry)[0][:, int(np.flatnonzero(w.before < 0)[0])].copy()
        entry = None
        for k, part in enumerate(parts):
            w = _windows(data, part, window)
            forward = read(0, w, entry)
            add(w, forward, read(1, w, back[k]), np.full(len(w.row), i))
            last = int(np.flatnonzero(w.after < 0)[0])
            entry = forward[w.length[last]][:, last].copy()
    return prob, label


def _identify(net: Network | None, texts: pa.Array, min_prob: float, languages: frozenset[str] | None):
    """lang (or None), probability, share of positions with that label, and whether the document stays, as arrays."""
    data, offsets = text_buffers(texts)
    rows = len(texts)
    best, p, share = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
    if net is not None:
        for i, j in chunks(offsets, BLOCK):
            prob, label = pooled(net, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.maximum(1, np.diff(offsets[i : j + 1]))
            best[i:j] = prob.argmax(axis=1)
            at = np.arange(j - i)
            p[i:j], share[i:j] = prob[at, best[i:j]] / size, label[at, best[i:j]] / size
    some = np.diff(offsets) > 0 if net is not None else np.zeros(rows, bool)
    names = net.langs if net is not None else [""]
    allowed = np.array([x != UNKNOWN and (languages is None or x in languages) for x in names])
    lang = pa.DictionaryArray.from_arrays(pa.array(best, mask=~some), pa.array(names, pa.string())).cast(pa.string())
    return lang, p, share, some & (p >= min_prob) & allowed[best]


def labelled_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces: int = PIECES, size: int = TRAIN_WINDOW) -> list[tuple[bytes, str]]:
    """Pieces of docs_per_lang labelled documents of each language: those whose ids have the smallest hashes.

    A text of up to pieces x size characters is one piece; of a longer one come so many of that size, evenly spaced from
    its beginning to its end. So what reaches the driver is bounded, however long the texts. Rows with a null id, label
    or text are left out; of rows that repeat an id and a label, the text whose pieces come first counts.
    """
    t = Columns(docs)
    ids = t.select(id=id_col, lang=lang_col).where("id is not null and lang is not null").select("id", "lang", F.xxhash64(F.lit("train"), "id").alias("h")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = ids.withColumn("nth", nth).where(F.col("nth") <= docs_per_lang).select("id", "lang")
    chosen = small_side(write_table(chosen, "lang-chosen"), F.lit(24) + F.octet_length("lang"))
    cut = F.expr(f"case when length(text) <= {pieces * size} then array(text) else transform(sequence(0, {pieces - 1}), k -> substring(text, cast(1 + floor(k * (length(text) - {size}) / {max(1, pieces - 1)}) as int), {size})) end")
    rows = t.select(id=id_col, text=text_col, lang=lang_col).where("text is not null").join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min(cut).alias("pieces"))
    return [(p.encode(), r["lang"]) for r in rows.collect() for p in r["pieces"]]


def fit_languages(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> Network | None:
    """A network trained on a bounded sample of the labelled rows of docs; None if no row has an id, a label and a text."""
    return train(labelled_sample(docs, docs_per_lang, id_col, text_col, lang_col), **kw)


def identify_languages(docs: DataFrame, net: Network | None, min_prob: float = MIN_PROB, languages: frozenset[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_id, prob, label_share, keep) of every row.

    The network labels every byte, having read the whole text from both ends; prob is the mean probability
    of the best language over all positions, label_share the share of positions whose own label it is. keep: prob is
    min_prob at least, the label isn't UNKNOWN, and, if languages are given, it is one of them.

    Nulls: a null or empty text has a null lang_id, probability 0, and isn't kept; so has every text where there is no
    network. A null id is returned as null; repeated rows get equal answers; an empty table gives no rows.
    """
    slim = Columns(docs).select(id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("lang_id", T.StringType()), T.StructField("prob", T.DoubleType()), T.StructField("label_share", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) if isinstance(x, np.ndarray) else x for x in _identify(shared.value, batch.column(1), min_prob, languages)]], names=schema.names)

    return slim.mapInArrow(label, schema)


def keep_identified(docs: DataFrame, net: Network | None, min_prob: float = MIN_PROB, languages: frozenset[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify_languages() keeps, with the columns of docs, whatever their names.

    Rows with a null or empty text go; repeated rows stay or go together; an empty table stays empty.
    """
    t = Columns(docs)
    at = t.outer.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pc.filter(batch, pa.array(_identify(shared.value, batch.column(at), min_prob, languages)[3]))

    return t.restore(t.df.mapInArrow(pick, t.df.schema))
