import gzip
import json
import re
import time

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import html, warc

PAGES = "page_id bigint, url string, html string"


def page(i, paragraphs, extra=""):
    body = "".join(f"<p>text {i} {k} &amp; more</p>" if k % 3 else f"<p><b>bold {i} {k}<br>" for k in range(paragraphs))
    return f"<!DOCTYPE html><html><head><title>t{i}</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=x>home</a></li><li><a>about</a></li></ul></nav><div class='box'>Fixed words</div>{extra}<article><h1>Title {i}</h1>{body}</article><footer>&copy; site</footer></body></html>"


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://a.example/{i}", page(i, 1 + i % 7, "<div class=note>note %d</div>" % i if i % 4 == 0 else "")) for i in range(40)]
    rows += [(100 + i, f"https://B.example:8080/{i}?q=1", page(0, 3)) for i in range(3)] + [(200, "http://c.example/", page(9, 2))]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture
def odd_pages(spark):
    rows = [(1, None, page(1, 2)), (2, "http://a/", None), (3, "nonsense", ""), (None, "http://a/", "<p>un<closed"), (4, "http://a/", "</div></p>text < 5 <b>x"), (4, "http://a/", "</div></p>text < 5 <b>x"), (5, "http://a/", "<div>" * 3000 + "deep"), (6, "http://a/", "<p>long</p>" * 20000)]
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], PAGES + ", host string, HTML string")


def test_round_trip(pages):
    headers, payloads = warc.archive(warc.page_records(pages))
    assert headers.count() == pages.count()
    assert payloads.count() == pages.select("html").distinct().count() < pages.count()
    back = {r["record_id"]: bytes(r["record"]) for r in warc.reconstruct(headers, payloads).collect()}
    for r in warc.page_records(pages).collect():
        assert back[r["record_id"]] == bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_files_are_read_archived_and_rebuilt_exactly(spark, tmp_path, pack):
    records = [(b"WARC/1.0\r\nWARC-Type: response\r\nX-Odd:  a : b \r\ncontent-length: %d\r\n\r\n" % len(p), p) for p in (b"abc", b"", b"\x00\xff\r\n\r\nWARC/1.0", b"abc", b"z" * 100_000)]
    (tmp_path / "a.warc").write_bytes(b"".join(pack(h + p + b"\r\n\r\n") for h, p in records))
    read = warc.read_warc(spark, str(tmp_path))
    headers, payloads = warc.archive(read)
    assert payloads.count() == 4
    rebuilt = {int(r["record_id"].rsplit("#", 1)[1]): bytes(r["record"]) for r in warc.reconstruct(headers, payloads).collect()}
    assert b"".join(rebuilt[k] for k in sorted(rebuilt)) == b"".join(h + p + b"\r\n\r\n" for h, p in records)


def test_broken_files_are_refused():
    for bad in (b"no warc", b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabc", b"WARC/1.0\r\n\r\nabc", b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_warc(bad))


def test_null_payloads_and_headers(spark):
    rows = [("a", b"h1", None), ("b", None, b"x"), ("c", b"h3", b""), ("c", b"h3", b"")]
    headers, payloads = warc.archive(spark.createDataFrame([(*r, 1) for r in rows], "record_id string, header binary, payload binary, digest int"))
    got = sorted((r["record_id"], r["record"] and bytes(r["record"])) for r in warc.reconstruct(headers, payloads).collect() if r["record_id"] != "b")
    assert got == [("a", None), ("c", b"h3\r\n\r\n"), ("c", b"h3\r\n\r\n")]


def test_warc_sql_and_messy(pages, odd_pages, spark):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([tuple(r) for r in pages.collect()], columns=pages.columns))
    rel = con.sql(warc.WARC_SQL)
    assert sorted(tuple(r[c] for c in rel.columns) for r in warc.archived_pages(pages).collect()) == sorted(rel.fetchall())
    assert warc.archived_pages(odd_pages).count() == 8
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_wrapper_is_one_expression(pages):
    got = {r["host"]: r["expression"] for r in html.page_wrappers(pages).collect()}
    assert set(got) == {"a.example", "b.example", "c.example"}
    assert "(<li><a>#</a></li>)+" in got["a.example"] and "(<div.note>#</div.note>)?" in got["a.example"] and "<p>(<b>#<br></br></b>)?(#)?</p>" in got["a.example"]


def by_hand(source, constant):
    """Brute force for these pages: everything between tags within the article and the notes."""
    out = re.findall(r"<div class=note>([^<]*)", source) + re.findall(r"<h1>([^<]*)", source)
    out += re.findall(r"<(?:p|b)>([^<]+)", source[source.index("</h1>") :])
    return "\n".join(x.replace("&amp;", "&") for x in out if x not in constant)


def test_extraction_against_the_pages(pages):
    got = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    for r in pages.where("page_id < 100").collect():
        assert got[r["page_id"]]["text"] == by_hand(r["html"], {"Fixed words"})
    assert got[200]["text"].startswith("Fixed words\nTitle 9")  # one page can't tell what is constant
    copies = pages.where("page_id = 100").collect()[0]["html"]  # a host whose pages are all alike tells no constant text
    assert all(got[100 + i]["text"] == "Fixed words\n" + by_hand(copies, set()) for i in range(3))


def test_texts_that_only_copies_have_are_content(spark):
    rows = [(i, f"http://a/{i}", f"<p>fixed</p><h1>t{i}</h1>") for i in range(4)] + [(10 + i, f"http://a/x{i}", "<p>fixed</p><h1>tx</h1><div class=extra>once</div>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**{i: f"t{i}" for i in range(4)}, **{10 + i: "tx\nonce" for i in range(3)}}


@pytest.mark.parametrize("bad", ["<a" * 500_000, "<" * 1_000_000, "<script " * 130_000, "<!-- " * 200_000, "<a " + " " * 1_000_000, "<b>a</b><i>c</i>" * 60_000])
def test_malformed_pages_take_linear_time(bad):
    began = time.process_time()
    tree = html.parse(bad)
    assert time.process_time() - began < 4  # well under a second on a machine of its own
    template = html.template_of(tree)
    assert len(html.match(tree, template)) == {"<a<": 500_000, "<a ": 1, "<b>": 120_000}.get(bad[:3], 0)
    assert time.process_time() - began < 30


def test_deep_pages_keep_their_texts():
    tree = html.parse("".join(f"<div>{i} " for i in range(3000)))
    assert [node[1] for _, node in html.match(tree, html.template_of(tree))] == [str(i) for i in range(3000)]
    assert html.infer([json.dumps(html.template_of(tree))] * 2)


@given(st.lists(st.sampled_from("abc"), max_size=26))
@settings(max_examples=300, deadline=None)
def test_shortest_repeated_runs(syms):
    want = {}
    for i in range(len(syms)):
        for k in range(2, len(syms) // 2 + 1):
            if len(set(syms[i : i + k])) > 1 and len(syms[i : i + k]) == k and syms[i + k : i + 2 * k] == syms[i : i + k]:
                want[i] = k
                break
    assert html._periods(syms) == want


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=100, deadline=None)
def test_alignment_table(a, b):
    table = html._Common([[[c]] for c in a], [[[c]] for c in b])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    assert [list(table[i]) for i in range(len(a) + 1)] == best


def test_long_groups_repeat():
    unit = "".join(f"<{t}>x</{t}>" for t in ("a", "b", "i", "u", "s", "q"))
    assert html.expression(html.template_of(html.parse(unit * 3 + "<hr>"))) == "(<a>#</a><b>#</b><i>#</i><u>#</u><s>#</s><q>#</q>)+<hr></hr>"


def test_a_large_host_is_folded_in_rounds(spark):
    kinds = "a b i u s q em h1 h2 h3".split()
    rows = [(m, f"http://h/{m}", "".join(f"<{k}>{m}</{k}>" for i, k in enumerate(kinds) if m >> i & 1)) for m in range(100)]
    df = spark.createDataFrame(rows, PAGES)
    parsed = html._parsed(df, "page_id", "url", "html").select("host", "template")
    assert html._wrappers(parsed, 16).count() == 1
    got = {r["page_id"]: r["text"] for r in html.extract_pages(df).collect()}
    assert got == {m: "\n".join([str(m)] * bin(m).count("1")) for m in range(100)}


def test_wrappers_of_odd_pages(odd_pages, spark):
    got = {r["host"]: r["expression"] for r in html.page_wrappers(odd_pages).collect()}
    assert set(got) == {"", "a"} and got["a"].startswith("(<p>(#)+</p>)*(#)*(<b>#</b>)?(<div>")
    assert html.page_wrappers(spark.createDataFrame([], PAGES)).count() == 0


def test_order_of_pages_does_not_matter(pages):
    rows = lambda df: sorted(map(tuple, html.extract_pages(df).collect()))
    assert rows(pages) == rows(pages.repartition(5).orderBy(F.rand(1)))


def test_merged_template_covers_both():
    a, b = (html.template_of(html.parse(x)) for x in ("<ul><li>a</li><li>b</li></ul><p>x</p>", "<p>y</p><dl><dt>1</dt><dd>2</dd><dt>3</dt><dd>4</dd></dl>"))
    assert html.expression(html.merge(a, b)) == "(<ul>(<li>#</li>)+</ul>)?<p>#</p>(<dl>(<dt>#</dt><dd>#</dd>)+</dl>)?"


def test_odd_pages(odd_pages, spark):
    got = sorted(map(tuple, html.extract_pages(odd_pages).collect()), key=repr)
    assert len(got) == 8
    text = {r[0]: r[3] for r in got}
    assert text[2] == "" and text[3] == "" and "Title 1" in text[1] and text[5] == "deep"
    assert html.extract_pages(spark.createDataFrame([], PAGES)).count() == 0
