"""URL functions as native expressions: one regular expression splits a URL the way browsers' lenient splitters do."""

from __future__ import annotations

import sys
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
IP = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query of a URL with a scheme; empty where it has none."""
    return F.regexp_extract(url, SPLIT, k)


def with_scheme(url: Column) -> Column:
    """A scheme is put before what has none."""
    u = strip(url)
    return F.when(u.rlike(SCHEME), u).otherwise(F.concat(F.lit("https://"), u))


@cache
def _composed() -> str:
    """The characters that compatibility composition turns into delimiters of a URL."""
    from unicodedata import normalize

    return "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and set(normalize("NFKC", c)) & set("/?#@:"))


def tolerant(url: Column) -> Column:
    """The URL, without brackets where its host can't be parsed, and a fixed one where it can't even so."""

    def composed(u: Column) -> Column:
        return part(u, 2).rlike(f"[{_composed()}]")

    def bracketed(net: Column) -> Column:
        opened, closed = F.contains(net, F.lit("[")), F.contains(net, F.lit("]"))
        inside = F.substring_index(F.regexp_replace(net, r"^[^\[]*\[", ""), "]", 1)
        wrong = lambda x: F.when(x.startswith("v"), ~x.rlike(r"^v[a-fA-F0-9]+\..+$")).otherwise((x == "") | hextets(F.regexp_replace(x, "%[^%]+$", "")).isNull())
        return (opened != closed) | (opened & let(inside, wrong))

    def checked(u: Column) -> Column:
        bare = F.replace(F.replace(u, F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
        return F.when(~(bracketed(part(u, 2)) | composed(u)), u).otherwise(let(bare, lambda b: F.when(composed(b), "https://invalid.local/").otherwise(b)))

    return let(url, lambda u: F.when(part(u, 2).rlike(r"^[!-Z\\^-~]*$"), u).otherwise(checked(u)))


def hostname(url: Column) -> Column:
    """Lower-case host without user info, port and brackets."""
    host = F.regexp_replace(part(url, 2), "^.*@", "")
    return F.lower(F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(host, "^([^:]*)", 1)))


def port(url: Column) -> Column:
    """The port's text, or an empty string."""
    return F.regexp_extract(F.regexp_replace(part(url, 2), "^.*@", ""), r":([^:\]]*)$", 1)


def address(host: Column) -> Column:
    """A dotted quad as a number; null if it's none."""
    quads = [F.try_to_number(F.nullif(F.split_part(host, F.lit("."), F.lit(i + 1)), F.lit("")), F.lit("999")).cast("bigint") for i in range(4)]
    valid = host.rlike(IP) & ~host.rlike(r"(^|\.)0[0-9]") & reduce(lambda a, b: a & b, [q <= 255 for q in quads])
    return F.when(valid, reduce(lambda a, b: a * 256 + b, quads))


def hextets(host: Column) -> Column:
    """The eight numbers of an IPv6 address (four dotted ones: an IPv4 address mapped into it); null if it's none.

    The JVM parses literals in brackets without looking a name up.
    """
    full = F.regexp_extract(F.try_reflect(F.lit("java.net.InetAddress"), F.lit("getByName"), F.concat(F.lit("["), host, F.lit("]"))), r"/([0-9a-f:.]+)$", 1)
    return F.when(full.contains("."), F.transform(F.split(full, r"\."), lambda x: x.cast("bigint"))).when(full != "", F.transform(F.split(full, ":"), lambda x: F.conv(x, 16, 10).cast("bigint")))


def is_local_v6(x: Column) -> Column:
    """Whether the eight numbers are an address that isn't global."""
    return _in_v6(x, lists.LOCAL_NETWORKS_V6) & ~_in_v6(x, lists.GLOBAL_INSIDE_V6)


def _in_v6(x: Column, networks: tuple[str, ...]) -> Column:
    tests = []
    for net in networks:
        prefix, _, bits = net.partition("/")
        given = [int(y, 16) for y in prefix.split(":") if y]
        whole, rest = divmod(int(bits), 16)
        given += [0] * (whole + 1 - len(given))
        same = [F.get(x, F.lit(i)) == given[i] for i in range(whole)]
        if rest:
            same.append(F.shiftright(F.get(x, F.lit(whole)), 16 - rest) == given[whole] >> (16 - rest))
        tests.append(reduce(lambda a, b: a & b, same))
    return reduce(lambda a, b: a | b, tests)


def ascii_host(host: Column) -> Column:
    """The host with labels beyond ASCII encoded (IDNA); null if they can't be."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))).otherwise(host)


def is_unsafe_host(host: Column) -> Column:
    """PF4: local names, and addresses that aren't global or, with a colon, none at all."""

    def local(n: Column) -> Column:
        nets = []
        for net in lists.LOCAL_NETWORKS:
            base, _, bits = net.partition("/")
            low = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
            nets.append((n >= low) & (n < low + (1 << (32 - int(bits)))))
        return F.coalesce(reduce(lambda a, b: a | b, nets) & ~n.isin(*lists.GLOBAL_INSIDE), F.lit(False))

    def local_v6(x: Column) -> Column:
        mapped = reduce(lambda a, b: a * 256 + b, [F.get(x, F.lit(i)) for i in range(4)])
        return F.when(x.isNull(), True).when(F.size(x) == 4, local(mapped)).otherwise(is_local_v6(x))

    named = lambda h: F.when(F.contains(h, F.lit(":")), let(hextets(h), local_v6)).otherwise(h.isin("localhost", "localhost.localdomain") | h.endswith(".localhost") | let(address(h), local))
    return let(F.regexp_replace(F.lower(host), r"\.+$", ""), named)


def let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once: without it, nested uses would multiply the expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _normalised(raw: Column, check_host: bool) -> Column:
    def checked(raw, u, p, host):
        scheme, number, clean = p["scheme"], p["port"], F.regexp_replace(host, r"\.+$", "")
        labels = F.split(clean, r"\.")
        odd = F.exists(labels, lambda x: (x == "") | (F.length(x) > 63))
        bad_port = (number != "") & (~number.rlike("^[0-9]{1,9}$") | (F.coalesce(F.try_to_number(F.when(number.rlike("^[0-9]{1,9}$"), number), F.lit("999999999")).cast("bigint"), F.lit(0)) > 65535))
        error = (
            F.when(raw == "", "empty_url")
            .when(~u.rlike(SCHEME) | ~scheme.isin("http", "https"), "unsupported_scheme")
            .when(host == "", "missing_hostname")
            .when(F.coalesce(odd | bad_port, F.lit(True)) | (F.contains(host, F.lit(":")) & hextets(host).isNull()), "invalid_url")
        )
        if check_host:
            error = error.when(is_unsafe_host(clean), "unsafe_hostname")
        plain = F.regexp_replace(number, "^0+(?=[0-9])", "")
        hidden = (plain == "") | ((scheme == "http") & (plain == "80")) | ((scheme == "https") & (plain == "443"))
        if not check_host:
            hidden = hidden | (plain == "0")
        path = F.regexp_replace(p["path"], "/+$", "")
        joined = F.concat(scheme, F.lit("://"), clean, F.when(hidden, F.lit("")).otherwise(F.concat(F.lit(":"), plain)), F.when(path == "", F.lit("/")).otherwise(path), F.when(p["query"] == "", F.lit("")).otherwise(F.concat(F.lit("?"), p["query"])))
        return let(error, lambda e: F.struct(F.when(e.isNull(), joined).alias("url"), e.alias("error")))

    parts = lambda u: F.struct(F.lower(part(u, 1)).alias("scheme"), port(u).alias("port"), part(u, 3).alias("path"), part(u, 4).alias("query"), ascii_host(hostname(u)).alias("host"))
    return let(raw, lambda r: let(F.when(F.instr(r, "://") > 0, r).otherwise(F.concat(F.lit("https://"), r)), lambda u: let(parts(u), lambda p: checked(r, u, p, p["host"]))))


def normalise(url: Column) -> Column:
    """struct(url, error); exactly one is null."""
    return _normalised(strip(url), True)


def normalise_feed(url: Column) -> Column:
    """As U1 without the check of the host; a port 0 falls away, as does a byte order mark."""
    return _normalised(strip(F.regexp_replace(url, "\ufeff", "")), False)


def domain_to_url(value: Column) -> Column:
    """U4: what has a scheme is a URL; else the text before a comma is a domain."""
    raw = strip(F.regexp_replace(F.coalesce(value, F.lit("")), "﻿", ""))


    def made(r: Column) -> Column:
        domain = strip(F.substring_index(r, ",", 1))
        wrong = F.when(r == "", F.lit("empty_domain")).when((F.instr(r, "://") == 0) & domain.rlike(r"\s"), F.lit("invalid_domain"))
        n = normalise_feed(F.when(F.instr(r, "://") > 0, r).otherwise(domain))
        return F.when(wrong.isNotNull(), F.struct(F.lit(None).cast("string").alias("url"), wrong.alias("error"))).otherwise(n)

    return let(raw, made)


def matches(host: Column, domain: str) -> Column:
    """U7."""
    return (host == domain) | host.endswith("." + domain)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def count_in(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return reduce(lambda a, b: a + b, [flag(F.contains(text, F.lit(w))) for w in words])


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, to 4 places."""
    n = F.length(text).cast("double")

    def term(c):
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return p * F.log2(p)

    return F.when(n > 0, F.round(-F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(term(c))), 4)).otherwise(F.lit(0.0))


URL_FEATURES = (
    "url_length", "domain_length", "path_length", "query_length", "num_dots", "num_hyphens", "num_digits", "num_special_chars", "has_https",
    "has_ip", "has_at", "num_subdomains", "has_suspicious_tld", "has_url_shortener", "has_punycode", "has_encoded_chars",
    "has_redirect_param", "has_embedded_url", "has_long_token", "has_public_hosting_platform", "has_brand_impersonation",
    "suspicious_word_count", "entropy",
)


def features(url: Column) -> Column:
    """U8: the 23 features of a URL as one struct. Select it first and its fields afterwards, so that it's computed once."""
    path = lambda u: F.regexp_replace(part(u, 3), ";[^/]*$", "")
    parts = lambda u, t: F.struct(u.alias("url"), F.lower(u).alias("low"), t.alias("parsed"), hostname(t).alias("host"), path(t).alias("path"), part(t, 4).alias("query"))
    made = lambda p: _features(*(p[k] for k in ("url", "low", "parsed", "host", "path", "query")))
    return let(with_scheme(url), lambda u: let(let(tolerant(u), lambda t: parts(u, t)), lambda p: F.struct(*(c.alias(k) for k, c in zip(URL_FEATURES, made(p), strict=True)))))


def _features(u: Column, low: Column, parsed: Column, host: Column, path: Column, query: Column) -> list[Column]:
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    ip = host.rlike(IP)
    less = lambda pattern: (F.length(u) - F.length(F.regexp_replace(u, pattern, ""))).cast("int")
    return [
        F.length(u), F.length(part(parsed, 2)), F.length(path), F.length(query), less(r"\."), less("-"), less("[0-9]"),
        less(r"[^\p{L}\p{N}]"), flag(F.lower(part(parsed, 1)) == "https"), flag(ip), flag(F.contains(u, F.lit("@"))),
        F.when(ip, F.lit(0)).otherwise(F.greatest(F.size(labels) - 2, F.lit(0))), flag(F.try_element_at(labels, F.lit(-1)).isin(*lists.RISKY_TLDS)),
        flag(host.isin(*lists.SHORTENERS)), flag(F.contains(host, F.lit("xn--"))), flag(F.contains(u, F.lit("%"))),
        let(F.lower(query), lambda q: flag(any_of([F.contains(q, F.lit(f"{p}=")) for p in lists.REDIRECT_PARAMS]))),
        flag(F.regexp_count(low, F.lit("https?://")) > 1), flag(F.concat(host, path, query).rlike("(?i)[a-z0-9]{18,}")),
        flag(any_of([matches(host, d) for d in lists.HOSTING_DOMAINS])), flag(any_of([F.contains(low, F.lit(w)) for w in lists.BRAND_WORDS])),
        count_in(low, lists.SUSPICIOUS_WORDS), entropy(u),
    ]
