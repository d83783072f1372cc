"""Main text of web pages by wrappers that are inferred from the pages of a host (union-free regular expressions)."""

from __future__ import annotations

import html as entities
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import Columns, small_side, write_table

#: Elements nested deeper become siblings at this depth, as in browsers; all their texts stay.
MAX_DEPTH = 512
#: Templates of a host that are aligned in one task; their wrappers are aligned in turn, until one is left.
FOLD = 64
#: Elements (or classes) whose variable text is no content.
FURNITURE = frozenset("head title nav footer header aside form button select script style ad ads advert sidebar menu breadcrumb cookie".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|([^<]++)|<", re.S | re.I)
_NEVER_CLOSED = re.compile(r"<(?!!--|(?:script|style|noscript|template)\b)", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("p div article section nav aside header footer main h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote form hr figure".split())
_ENDS_SAME = frozenset("li td th tr dt dd option".split())

sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * MAX_DEPTH))

# A template is [symbol, [[child, optional, repeated], ...]]; a text slot has the symbol "#". A page's tree is
# [symbol, [child, ...]], and ["#", text] for a text.


def parse(page: str) -> list:
    """The tree of a page's token stream: tags (with the first class), and texts; comments, scripts and styles go.

    One pass: a "<" that no ">" follows anywhere opens nothing and only ends a text.
    """
    page = page.replace("\0", "")
    last = page.rfind(">") + 1
    page = page[:last] + _NEVER_CLOSED.sub("\0", page[last:])
    root: list = ["", []]
    stack, names = [root], [""]
    there: Counter = Counter()

    def close(name: str) -> None:
        while (own := names.pop()) != name:
            there[own] -= 1
            stack.pop()
        there[name] -= 1
        stack.pop()

    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            stack[-1][1].extend(["#", entities.unescape(" ".join(part.split()))] for part in text.split("\0") if part.strip())
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if there[name]:
                close(name)
            continue
        if name in _ENDS_P and there["p"]:
            close("p")
        elif name in _ENDS_SAME and names[-1] == name:
            close(name)
        cls = _CLASS.search(m.group(4)) if m.group(4) else None
        node: list = [f"{name}.{cls.group(1).lower()}" if cls else name, []]
        stack[-1][1].append(node)
        if name not in _VOID and not m.group(4).endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
            names.append(name)
            there[name] += 1
    return root


def _periods(syms: list[str]) -> dict[int, int]:
    """For each position at which a run of two different symbols at least follows twice in a row, the shortest such run.

    A run of length k that repeats covers some position i that is a multiple of k, from which it equals what lies k
    further on; so all runs are found by extending the pairs (i, i + k) both ways, by doubling, n log n of them.
    """
    n = len(syms)
    if n < 4 or len(set(syms)) in (1, n):
        return {}
    codes = np.unique(np.array(syms, dtype=object).astype(str), return_inverse=True)[1].astype(np.uint64)
    levels, width = [codes + np.uint64(1)], 1  # names of the runs of 1, 2, 4, ... symbols that begin at each position
    while width * 2 <= n:
        before = levels[-1]
        pairs = before[:-width] << np.uint64(32) | before[width:]
        levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.uint64) + np.uint64(1))
        width *= 2
    i = np.concatenate([np.arange(0, n - k, k) for k in range(2, n // 2 + 1)])
    k = np.concatenate([np.full(len(range(0, n - k, k)), k) for k in range(2, n // 2 + 1)])
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        own, width = levels[level], 1 << level
        fits = i + k + right + width <= n
        at = np.flatnonzero(fits)
        at = at[own[(i + right)[at]] == own[(i + k + right)[at]]]
        right[at] += width
        at = np.flatnonzero(i - left - width >= 0)
        at = at[own[(i - left - width)[at]] == own[(i + k - left - width)[at]]]
        left[at] += width
    changes = np.append(0, np.cumsum(codes[1:] != codes[:-1]))
    first, stop = i - left, i + right - k
    twice = np.flatnonzero((left + right >= k) & (changes[np.minimum(first + k - 1, n - 1)] > changes[first]))
    runs = np.unique(np.stack([-k[twice], first[twice], stop[twice]], axis=1), axis=0)  # the longest first
    shortest = np.zeros(n, np.int64)
    for p, f, e in runs.tolist():
        shortest[f : e + 1] = -p
    at = np.flatnonzero(shortest)
    return dict(zip(at.tolist(), shortest[at].tolist(), strict=True))


def grouped(children: list) -> list:
    """Children in which runs of siblings that repeat (dt dd dt dd), however long, are group nodes "()", one for each
    repetition."""
    out: list = []
    syms = [c[0] for c in children]
    periods = _periods(syms)
    i, n = 0, len(children)
    while i < n:
        k = periods.get(i)
        if k is None:
            out.append(children[i])
            i += 1
            continue
        unit = syms[i : i + k]
        while syms[i : i + k] == unit:
            out.append(["()", children[i : i + k]])
            i += k
    return out


def template_of(node: list) -> list:
    """The template of a page's tree; the tree gets the group nodes it is matched with."""
    if node[0] == "#":
        return ["#", []]
    node[1] = grouped(node[1])
    return [node[0], _collapse([[template_of(c), False, False] for c in node[1]])]


def _collapse(children: list) -> list:
    """Adjacent children of one symbol become one that repeats."""
    out: list = []
    for child, optional, repeated in children:
        if out and out[-1][0][0] == child[0]:
            before = out[-1]
            out[-1] = [merge(before[0], child), before[1] and optional, True]
        else:
            out.append([child, optional, repeated])
    return out


def merge(a: list, b: list) -> list:
    """The least template (of those that alignment finds) that has both; their symbols are the same.

    Children are aligned by a longest common subsequence of symbols; what has no partner becomes optional, and where
    that puts equal symbols side by side, repeated.
    """
    if a == b:
        return a
    x, y = a[1], b[1]
    n, m = len(x), len(y)
    best = _Common(x, y)
    out: list = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i][0][0] == y[j][0][0]:
            out.append([merge(x[i][0], y[j][0]), x[i][1] or y[j][1], x[i][2] or y[j][2]])
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([x[i][0], True, x[i][2]])
            i += 1
        else:
            out.append([y[j][0], True, y[j][2]])
            j += 1
    return [a[0], _collapse(out)]


class _Common:
    """[i][j]: the longest common subsequence of the symbols of x[i:] and y[j:].

    Of the table's rows only every so many are kept; those between are made again, a block at a time, as i rises.
    """

    def __init__(self, x: list, y: list):
        codes: dict = {}
        self.a = [codes.setdefault(c[0][0], len(codes)) for c in x]
        self.b = np.array([codes.setdefault(c[0][0], len(codes)) for c in y], np.int64)
        self.step = int(len(x) ** 0.5) + 1
        row = np.zeros(len(y) + 1, np.int32)
        self.kept, self.block, self.rows = {len(x): row}, -1, {}
        for i in range(len(x) - 1, -1, -1):
            row = self._above(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        row = np.zeros_like(below)
        row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], np.where(self.b == self.a[i], below[1:] + 1, 0))[::-1])[::-1]
        return row

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if self.block != i // self.step:
            self.block = i // self.step
            self.rows = {}
            end = min(len(self.a), (self.block + 1) * self.step)
            row = self.kept[end]
            for k in range(end - 1, self.block * self.step, -1):
                row = self.rows[k] = self._above(k, row)
        return self.rows[i]


def infer(templates: list[str]) -> str:
    """The wrapper of a host from the templates of its pages, aligned one after another in a fixed order."""
    return json.dumps(reduce(merge, (json.loads(t) for t in sorted(templates, key=lambda t: (len(t), t)))), ensure_ascii=False)


def expression(template: list) -> str:
    """The template as a regular expression over tags and text slots (#)."""
    if template[0] == "#":
        return "#"
    inner = "".join((f"({e})" if o or r else e) + ("*" if o and r else "?" if o else "+" if r else "") for e, o, r in ((expression(c), o, r) for c, o, r in template[1]))
    return inner if template[0] in ("", "()") else f"<{template[0]}>{inner}</{template[0]}>"


def slots(template: list) -> list[tuple[str, bool]]:
    """(path, whether it is content) of each text slot, in order."""
    out: list[tuple[str, bool]] = []

    def walk(node: list, path: str, content: bool) -> None:
        if node[0] == "#":
            out.append((path, content))
            return
        name, _, cls = node[0].partition(".")
        content = content and name not in FURNITURE and cls not in FURNITURE
        for child, _, _ in node[1]:
            walk(child, f"{path}/{node[0]}" if node[0] not in ("", "()") else path, content)

    walk(template, "", True)
    return out


def _count_slots(template: list, memo: dict) -> int:
    key = id(template)
    if key not in memo:
        memo[key] = 1 if template[0] == "#" else sum(_count_slots(c, memo) for c, _, _ in template[1])
    return memo[key]


def match(node: list, template: list) -> list[tuple[int, list]]:
    """(slot number, text node) of the tree's texts; the children of both follow one another in the same order."""
    memo: dict = {}
    out: list[tuple[int, list]] = []

    def walk(node: list, template: list, first: int) -> None:
        if node[0] == "#":
            out.append((first, node))
            return
        starts = [first]
        for child, _, _ in template[1]:
            starts.append(starts[-1] + _count_slots(child, memo))
        places: dict[str, list[int]] = {}
        for k, (child, _, _) in enumerate(template[1]):
            places.setdefault(child[0], []).append(k)
        at = 0
        for child in node[1]:
            own = places.get(child[0])
            if own:
                k = own[bisect_left(own, at) % len(own)]  # the next of its symbol, or else the first
                walk(child, template[1][k][0], starts[k])
                at = k

    walk(node, template, 0)
    return out


@lru_cache(maxsize=4096)
def slot_map(template: str, wrapper: str) -> tuple[int, ...]:
    """For each slot of a page's template, its slot of the wrapper."""
    t = json.loads(template)

    def tree(node: list) -> list:
        return [node[0], [tree(c) for c, _, _ in node[1]]] if node[0] != "#" else ["#", ""]

    as_tree = tree(t)
    to = {id(node): k for k, node in match(as_tree, json.loads(wrapper))}
    return tuple(to[id(node)] for _, node in match(as_tree, t))


# ---------------------------------------------------------------- plan

_PARSED = T.StructType([T.StructField("template", T.StringType()), T.StructField("structure", T.LongType()), T.StructField("texts", T.ArrayType(T.StructType([T.StructField("local", T.IntegerType()), T.StructField("text", T.StringType())])))])
_ARROW_TEXTS = pa.list_(pa.struct([("local", pa.int32()), ("text", pa.string())]))


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, template, texts) of every page."""
    t = Columns(pages)
    host = F.coalesce(F.lower(F.regexp_extract(t(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    slim = t.df.select(t(id_col).alias("id"), host.alias("host"), F.coalesce(t(html_col), F.lit("")).alias("html"))
    schema = T.StructType([slim.schema[0], slim.schema[1], *_PARSED.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                names, codes, texts = [], [], []
                for page in batch.column(2):
                    tree = parse(page.as_py())
                    template = template_of(tree)
                    names.append(json.dumps(template, ensure_ascii=False))
                    codes.append(xxhash.xxh3_64_intdigest(names[-1]) - (1 << 63))
                    texts.append([{"local": k, "text": node[1]} for k, node in match(tree, template)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(codes, pa.int64()), pa.array(texts, _ARROW_TEXTS)], names=schema.names)

    return slim.mapInArrow(read, schema)


def _wrappers(templates: DataFrame, fold_size: int = FOLD) -> DataFrame:
    """(host, wrapper) from (host, template): a host's distinct structures are merged fold_size at a time in hashed
    parts, the results likewise, until one is left, so that a large host is many tasks."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [infer(list(pdf["template"]))]})

    now = templates.select("host", "template").distinct()
    while True:
        sizes = now.groupBy("host").agg(F.ceil(F.count("*") / F.lit(fold_size)).alias("parts"))
        part = F.pmod(F.xxhash64("template"), "parts")
        parts = now.join(sizes, "host").withColumn("part", F.when(F.col("parts") > 1, part).otherwise(0)).groupBy("host", "part")
        now = write_table(parts.applyInPandas(fold, "host string, template string"), "html-fold")
        if now.groupBy("host").count().where("count > 1").isEmpty():
            return now.withColumnRenamed("template", "wrapper")


def page_wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, expression): the wrapper of each host as a union-free regular expression.

    Pages without a host share the host ''; a null or empty page has the empty expression, which other pages of the
    host make optional; repeated pages change nothing; an empty table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("string")
    def show(wrappers: pd.Series) -> pd.Series:
        return wrappers.map(lambda w: expression(json.loads(w)))

    return _wrappers(_parsed(pages, id_col, url_col, html_col).select("host", "template").distinct()).select("host", show("wrapper").alias("expression"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, n_fields, text): each page's variable content by the wrapper of its host, a line for each text.

    1. Every page's token stream is read into a template in which repeated siblings are collapsed. 2. A host's distinct
    templates are aligned one after another; mismatches become optional or repeated groups. 3. Text slots of the
    wrapper whose text is the same on all of at least two different pages are part of the template; so are slots within
    navigation, footers and other furniture. 4. A page's text is that of its other slots, in order; n_fields counts
    them.

    Nulls: a null page has no text (''); pages without a host (null or odd URL) share the host ''. A host whose pages
    are all alike has no constant slots: copies of a page, under whatever id, count as one. Malformed HTML is read as a
    stream: unknown end tags are skipped, open elements end with their parent, a "<" that is never closed only ends a
    text. An empty table gives no rows. Columns with other names are ignored.
    """
    parsed = write_table(_parsed(pages, id_col, url_col, html_col), "html-parsed", "zstd")
    templates = write_table(parsed.groupBy("host", "structure").agg(F.min("template").alias("template")), "html-templates")
    wrappers = _wrappers(templates)
    target = T.StructType([T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("content", T.ArrayType(T.BooleanType()))])

    @F.pandas_udf(target)
    def mapped(template: pd.Series, wrapper: pd.Series) -> pd.DataFrame:
        rows = [slot_map(t, w) for t, w in zip(template, wrapper, strict=True)]
        kinds = {w: [c for _, c in slots(json.loads(w))] for w in set(wrapper)}
        return pd.DataFrame({"slots": [list(r) for r in rows], "content": [[kinds[w][k] for k in r] for r, w in zip(rows, wrapper, strict=True)]})

    maps = write_table(templates.join(wrappers, "host").select("host", "structure", mapped("template", "wrapper").alias("m")), "html-maps")
    placed = parsed.join(small_side(maps, F.size("m.slots") * 5 + 100), ["host", "structure"]).select("id", "host", F.xxhash64("structure", "texts").alias("page"), F.transform("texts", lambda x: F.struct(F.element_at("m.slots", x["local"] + 1).alias("slot"), F.element_at("m.content", x["local"] + 1).alias("content"), x["text"].alias("text"))).alias("texts"))
    each = placed.select("host", "page", F.explode(F.filter("texts", lambda x: x["content"])).alias("x")).select("host", "page", "x.slot", F.xxhash64("x.text").alias("h"))
    constant = each.groupBy("host", "slot").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.min("page").alias("one"), F.max("page").alias("other")).where("low = high and one <> other").groupBy("host").agg(F.collect_set("slot").alias("constant"))
    constant = write_table(constant, "html-constant")
    kept = F.filter("texts", lambda x: x["content"] & ~F.coalesce(F.array_contains("constant", x["slot"]), F.lit(False)))
    return placed.join(small_side(constant, F.size("constant") * 4 + 100), "host", "left").select("id", "host", kept.alias("kept")).select(F.col("id").alias(id_col), "host", F.size("kept").alias("n_fields"), F.array_join(F.transform("kept", lambda x: x["text"]), "\n").alias("text"))
