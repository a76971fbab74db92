"""The page tokeniser against markup whose tokens are known, the standard library's parser, and hostile pages."""

from __future__ import annotations

import os
import random
import time
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest

from tidewatch.functions import html, lists, text
from tidewatch.plans import registry

CASES = {
    "<!-- <script> -->hello world": "hello world", '<a title="<script>">hi</a> bye': "tag_a hi bye", "x <b": "x", "x <b>y": "x tag_b y", "a<!-- b": "a",
    "<noscript>a<noscript>b</noscript>c</noscript>d<noscript>e": "d", "<script>a<b>c</script>d</script>e": "d e", "<style>x</STYLE >y": "y", "a &amp;amp; b&nbsp;c": "a & b c",
    "<p title=\"a>b\">t": "tag_p t", "<input value='p&quot;w' type=password>": "tag_input attr_value_p_w attr_type_password", "<a href=//H.test:8/x>": "tag_a attr_href_//h.test_8/x href_domain_h.test_8",
    "<noscript><img src='//t.test/p.gif'>n</noscript>": "tag_img attr_src_//t.test/p.gif src_domain_t.test", "<a href='http://[x'>bad</a> ok": "bad ok", "<br/>": "tag_br", "": "", "plain &lt;b&gt;": "plain <b>",
}


@pytest.mark.parametrize("page", CASES)
def test_known_pages(page):
    assert html.visible(page) == CASES[page]


def standard(page):
    """The same tokens, from the parser's callbacks one by one."""
    out, hidden = [], [0]

    def start(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            hidden[0] += 1
            return
        out.append(f"tag_{tag}")
        for k, v in attrs:
            if k in lists.SIGNAL_ATTRS:
                out.extend([f"attr_{k}_{html.token(v)}"] * bool(html.token(v)))
                host = html.token(urlsplit(v or "").netloc) if k in ("action", "href", "src") else ""
                out.extend([f"{k}_domain_{host}"] * bool(host))

    def end(self, tag):
        hidden[0] -= tag in ("script", "style", "noscript") and hidden[0] > 0

    made = type("Standard", (HTMLParser,), {"handle_starttag": start, "handle_endtag": end, "handle_data": lambda self, x: None if hidden[0] else out.append(x)})
    made().feed(page)
    return text.normalise_text(" ".join(out))


def test_broken_pages_are_the_parsers():
    rng = random.Random(8)
    bits = ["<", ">", "/", "a", "script", "style", "noscript", "<!--", "-->", "<!", "<?", " ", "=", "'", '"', "href", "type", "x&amp;y", "&#65;", "&am", "</", "<p>", "</p>", "<a href='//h.test/q'>", "\n", "é", "]]>", "<title>"]
    done = 0
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        try:
            want = standard(page)
        except (AssertionError, ValueError):
            assert isinstance(html.visible(page), str)
            continue
        assert html.visible(page) == want
        done += 1
    assert done > 3000


@pytest.mark.parametrize("part", ["<a ", '<a x="', "<!--", "<", "</a ", "<p>&lt;", "<script></scrip>", "&am"])
def test_hostile_pages_take_linear_time(part):
    began = time.time()
    html.visible(part * (1_000_000 // len(part)))
    assert time.time() - began < 8


def test_signals_as_rows(spark):
    spark.udtf.register("html_signals", html.html_signals())
    rows = spark.createDataFrame([(1, "<a href='http://h.test/x' class=q>go  <b>on</b></a>"), (2, None), (3, "<script>x</script>")], "id int, page string")
    got = spark.sql("SELECT id, seq, kind, name, value FROM {rows}, LATERAL html_signals(page) ORDER BY id, seq", rows=rows).collect()
    assert [tuple(r) for r in got] == [(1, 0, "tag", None, "a"), (1, 1, "attr", "href", "http_//h.test/x"), (1, 2, "domain", "href", "h.test"), (1, 3, "text", None, "go"), (1, 4, "tag", None, "b"), (1, 5, "text", None, "on")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_the_query_reads_what_the_parser_reads(spark):
    from tidewatch.plans.views import pages_x

    pages = {r.page_id: r.html for r in pages_x(spark, "/root/testdata/sf0.001").collect()}
    got = {r.page_id: r.tokens for r in registry.queries()["html_tokens"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: standard(x[:2000]) for i, x in pages.items()}
    signals = registry.queries()["html_signals"](spark, "/root/testdata/sf0.001").select("page_id", "seq", "kind", "name", "value").collect()
    assert sorted(map(tuple, signals), key=repr) == sorted(((i, *x) for i, page in pages.items() for x in html.signals_of(page)), key=repr)
