"""Character references and odd URLs, against the standard library."""

from __future__ import annotations

import html as _html
import ipaddress
import random
from html.entities import html5
from urllib.parse import urlsplit

from pyspark.sql import functions as F
from test_operators import column

from tidewatch.functions import entities, lists, text, url


def test_all_names_and_numbers(spark):
    names = [f"&{x}" for x in html5] + [f"&{x.rstrip(';')}" for x in html5] + [f"a&{x.rstrip(';')}zz&amp;" for x in html5]
    numbers = [*range(0, 400), *range(0xD7F0, 0xE010, 7), *range(0xFDC8, 0xFDF8), 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**30]
    refs = [f"&#{n};" for n in numbers] + [f"&#x{n:x}" for n in numbers] + [f"&#0{n:05d}x" for n in numbers]
    rng = random.Random(1)
    bits = ["&", "#", "x", "amp", ";", "lt", "notit", "é", " ", "&amp;lt;", "1", "41", "&#", "&#X", "frac12", "\t", "&nbsp", "😀", "&ThickSpace;"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + ["", "none", "&" * 40, "&" + "a" * 60 + ";"]
    every = names + refs + odd
    got = column(spark, every, entities.unescape)
    assert [(x, g) for x, g in zip(every, got, strict=True) if g != _html.unescape(x)] == []
    assert column(spark, odd, text.normalise) == [text.normalise_text(x) for x in odd]


ODD_URLS = [
    "http://[::1]/a", "http://[::1", "http://a]b/c?d=e", "http://[x]/p", "http://[1.2.3.4]/", "http://u@[2001:db8::1]:80/x", "http://x[::1]/", "http://[::1]x/", "http://[v1.a]/", "http://[vx]/",
    "http://a[b]@h.test/", "http://h℀i.test/p", "http://[h℀i.test/p", "http://ａ.test/", "https://plain.test/x?y=1", "no-scheme[.test/q", "http://[fe80::1%25eth0]/",
]


def parsed(u):
    try:
        return urlsplit(u)
    except ValueError:
        try:
            return urlsplit(u.replace("[", "").replace("]", ""))
        except ValueError:
            return urlsplit("https://invalid.local/")


def test_urls_that_cannot_be_parsed(spark):
    whole = [u if "://" in u else f"https://{u}" for u in ODD_URLS]
    got = column(spark, whole, url.tolerant)
    assert [urlsplit(g).netloc for g in got] == [parsed(u).netloc for u in whole]
    rows = column(spark, ODD_URLS, url.features)
    assert [(r.domain_length, r.path_length, r.query_length) for r in rows] == [(len(parsed(u).netloc), len(parsed(u).path), len(parsed(u).query)) for u in whole]


def test_addresses_are_global_as_the_standard_library_says(spark):
    four = ["192.0.0.8", "192.0.0.9", "192.0.0.10", "192.0.0.11", "8.8.8.8", "10.1.1.1", "198.18.0.1", "203.0.113.9"]
    six = ["2001:20::1", "2001:2f:ffff::", "2001:30::1", "2001:40::1", "2001:4:112::1", "2001:4:113::1", "2001:3::5", "2001:1::1", "2001:1::2", "2001:1::3", "2001:db8::1", "2606:4700::1", "::1"]
    got = column(spark, four + six, url.is_unsafe_host)
    assert got == [not ipaddress.ip_address(x).is_global for x in four + six]


def test_paths_are_portable(spark):
    import os

    root = "/data/project"
    paths = ["a/b.html", "./a//b/../c", "../outside/x", "/data/project/a/x.png", "/data/projects/x", "/data/project/../other", "/", "a/../../../../../x", "é/ü.txt", "/data/project", None]
    whole = [p if p is None else os.path.normpath(os.path.join(root, p)).replace("//", "/") for p in paths]
    assert column(spark, paths, lambda c: text.resolved(c, root)) == whole
    assert column(spark, paths, lambda c: text.portable(c, root)) == [p if p is None or not p.startswith(f"{root}/") else p[len(root) + 1 :] for p in whole]


def test_features_of_pages_know_all_references(spark):
    """Also those without a semicolon or with any name, in titles and in words; what they leave at a title's ends is stripped."""
    import re

    from tidewatch.functions import html as pages

    titles = ["the&amp;&amp;&amp", "&copy;&middot; caf&eacute", "&nbsp;a&#32;b&nbsp;", "&amp;lt;", "&#x41;&#65&notit;", "\u2003x\u00a0 y\x1c", "&unknown;", "&"]
    rows = spark.createDataFrame([(i, f"<title>{t}</title><p>v&#101;rify w&#x61;llet</p>") for i, t in enumerate(titles)], "id int, html string")
    got = {r.id: r.f for r in rows.select("id", pages.features(F.col("html"), F.lit("https://a.test/")).alias("f")).collect()}
    assert [got[i].title_length for i in range(len(titles))] == [len(_html.unescape(re.sub(r"\s+", " ", t)).strip()) for t in titles]
    plain = "verify wallet"
    assert all(got[i].suspicious_html_word_count == sum(w in plain for w in lists.HTML_WORDS) for i in (1, 3, 4, 6)) and any(w in plain for w in lists.HTML_WORDS)
