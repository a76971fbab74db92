"""Queries over the decorated pages: URLs, markup, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, lists, score, text, url
from ..operators.errors import top_values
from .views import WITH_PAGES, pages_x, table

# ---- Spark


def url_parts(s: SparkSession, d: str) -> DataFrame:
    u = url.with_scheme(F.col("url"))
    return pages_x(s, d).select("page_id", u.alias("full_url"), F.lower(url.part(u, 1)).alias("scheme"), url.part(u, 2).alias("netloc"), url.part(u, 3).alias("path"), url.part(u, 4).alias("query"), url.hostname(u).alias("host"), url.port(u).alias("port"))


def url_normalise(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", url.normalise(F.col("url")).alias("n")).select("page_id", "n.url", "n.error")


def feed_normalise(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", url.normalise_feed(F.col("url")).alias("n")).select("page_id", "n.url", "n.error")


#: Hosts beyond plain names, one for each page in turn, and what the normaliser says of them.
ODD_HOSTS = ("bücher.example", "[::1]", "[fe80::1]:8080", "[::ffff:10.0.0.1]", "[2606:4700::1111]", "[2001:db8::7]", "[not::an::address]", "localhost", "192.168.1.7", "MÜNCHEN.de", "8.8.8.8")
ODD_RESULTS = ("xn--bcher-kva.example", "", "", "", "2606:4700::1111", "", "!", "", "", "xn--mnchen-3ya.de", "8.8.8.8")


def url_normalise_idna(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", url.normalise(F.concat(F.lit("http://"), F.element_at(F.array(*map(F.lit, ODD_HOSTS)), (F.pmod("page_id", F.lit(len(ODD_HOSTS))) + 1).cast("int")), F.lit("/"), F.col("page_id"))).alias("n")).select("page_id", "n.url", "n.error")


def domain_urls(s: SparkSession, d: str) -> DataFrame:
    p = pages_x(s, d).select("page_id", F.concat(url.hostname(url.with_scheme(F.col("url"))), F.lit(", "), F.col("page_id").cast("string")).alias("v"))
    return p.select("page_id", url.domain_to_url(F.col("v")).alias("n")).select("page_id", "n.url", "n.error")


def unsafe_hosts(s: SparkSession, d: str) -> DataFrame:
    made = F.concat((F.col("event_id") * 37 % 256).cast("string"), F.lit("."), (F.col("event_id") * 101 % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".7"))
    return table(s, d, "events").select("event_id", made.alias("host")).select("event_id", "host", url.is_unsafe_host(F.col("host")).cast("int").alias("unsafe"))


def url_features(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", url.features(F.col("url")).alias("f")).select("page_id", "f.*")


def html_features(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", html.features(F.col("html"), F.col("url")).alias("f")).select("page_id", "f.*")


def featured(s: SparkSession, d: str) -> DataFrame:
    """All 35 features and the score, computed once each."""
    p = pages_x(s, d)
    f = p.select("page_id", "url", "label", url.features(F.col("url")).alias("u"), html.features(F.col("html"), F.col("url")).alias("h")).select("page_id", "url", "label", "u.*", "h.*")
    names = (*url.URL_FEATURES, *html.HTML_FEATURES)
    return f.withColumn("score", score.heuristic({n: F.col(n) for n in names})).withColumn("host", url.hostname(url.with_scheme(F.col("url"))))


def heuristic_score(s: SparkSession, d: str) -> DataFrame:
    return featured(s, d).select("page_id", F.round("score", 9).alias("score"))


def risk_level(s: SparkSession, d: str) -> DataFrame:
    f = featured(s, d)
    deep = F.col("page_id") % 2 == 0
    return f.select("page_id", score.risk_level(F.col("score"), deep).alias("risk_level"), score.decision(F.col("score"), F.lit(0.5), ~deep).alias("label"))


SIGNALS = ("has_https", "has_ip", "has_at", "has_suspicious_tld", "has_url_shortener", "has_punycode", "has_encoded_chars", "has_redirect_param", "has_embedded_url", "has_long_token", "has_public_hosting_platform", "has_brand_impersonation", "has_login_form", "has_meta_refresh", "has_javascript_redirect")


def observed_signals(s: SparkSession, d: str) -> DataFrame:
    f = featured(s, d).select("page_id", *SIGNALS)
    return f.unpivot("page_id", list(SIGNALS), "signal", "value").where("value = 1")


def risk_by_domain(s: SparkSession, d: str) -> DataFrame:
    f = featured(s, d).where("host <> ''")
    return f.groupBy("host").agg(F.count("*").alias("pages"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("max_score"), F.count_if(F.col("score") >= 0.5).alias("risky"))


def online_predict(s: SparkSession, d: str) -> DataFrame:
    from .workflow import predict

    return predict(pages_x(s, d).select("page_id", "url", "html")).select("page_id", "full_url", "decision", "risk_level", F.round("phishing_probability", 4).alias("phishing_probability"), "model_source", "html_available")


def tag_counts(s: SparkSession, d: str) -> DataFrame:
    p = pages_x(s, d).select(F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<\s*([a-z0-9]+)\b"), F.lit(1))).alias("tag"))
    return p.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def top_tlds(s: SparkSession, d: str) -> DataFrame:
    p = featured(s, d).where("host <> ''").select("label", F.element_at(F.split("host", r"\."), -1).alias("tld"), F.col("page_id").alias("ord"))
    return top_values(p, ["label"], "tld", 3)


def html_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).groupBy(html.fingerprint(F.col("html")).alias("html_sha256")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def error_page(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", html.error_signature(F.col("html")).alias("signature")).where("signature is not null")


def text_normalise(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", text.normalise(F.col("html")).alias("v")).select("page_id", F.length("v").cast("bigint").alias("n"), F.md5("v").alias("digest"))


def strip_markup(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", html.strip_markup(F.col("html")).alias("v")).select("page_id", F.length("v").cast("bigint").alias("n"), F.md5("v").alias("digest"))


def html_tokens(s: SparkSession, d: str) -> DataFrame:
    return pages_x(s, d).select("page_id", html.html_text()(text.trimmed(F.col("html"), 2000)).alias("tokens"))


def html_signals(s: SparkSession, d: str) -> DataFrame:
    """Tags, attributes, link hosts and texts of whole pages, a row each."""
    s.udtf.register("html_signals", html.html_signals())
    return s.sql("SELECT page_id, seq, kind, name, value FROM {pages}, LATERAL html_signals(html)", pages=pages_x(s, d).select("page_id", "html"))


def char_encode(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", "turn", text.char_encode(F.col("text"), 200, 128).alias("ids"))
    return c.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


# ---- SQL

STRIP = lambda x: rf"regexp_replace(coalesce({x}, ''), '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
PART = lambda u, k: rf"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', {k})"
SCHEMED = rf"CASE WHEN regexp_matches({STRIP('url')}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {STRIP('url')} ELSE concat('https://', {STRIP('url')}) END"
BARE = lambda netloc: rf"regexp_replace({netloc}, '^.*@', '')"
HOST = lambda netloc: rf"lower(CASE WHEN {BARE(netloc)} LIKE '[%' THEN regexp_extract({BARE(netloc)}, '^\[([^\]]*)\]', 1) ELSE regexp_extract({BARE(netloc)}, '^([^:]*)', 1) END)"
PORT = lambda netloc: rf"regexp_extract({BARE(netloc)}, ':([^:\]]*)$', 1)"
PARTS = f"""{WITH_PAGES}, u AS (SELECT page_id, url, html, label, {SCHEMED} AS full_url FROM pages_x),
parts AS (SELECT *, lower({PART('full_url', 1)}) AS scheme, {PART('full_url', 2)} AS netloc, {PART('full_url', 3)} AS path, {PART('full_url', 4)} AS query FROM u),
hosts AS (SELECT *, {HOST('netloc')} AS host, {PORT('netloc')} AS port FROM parts)"""


def unsafe_sql(host: str) -> str:
    n = " + ".join(f"try_cast(split_part({host}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    nets = []
    for net in lists.LOCAL_NETWORKS:
        base, _, bits = net.partition("/")
        low = sum(int(x) << k for x, k in zip(base.split("."), (24, 16, 8, 0), strict=True))
        nets.append(f"({n}) BETWEEN {low} AND {low + (1 << (32 - int(bits))) - 1}")
    return f"({host} IN ('localhost', 'localhost.localdomain') OR {host} LIKE '%.localhost' OR (regexp_matches({host}, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') AND ({' OR '.join(nets)})))"


def normalise_sql(check: bool) -> str:
    raw = STRIP("url") if check else STRIP("replace(url, '﻿', '')")
    bad = "OR list_bool_or(list_transform(string_split(rtrim(host, '.'), '.'), lambda x: x = '' OR length(x) > 63))"
    host_check = f"WHEN {unsafe_sql(chr(39).join(['rtrim(host, ', '.', ')']))} THEN 'unsafe_hostname'" if check else ""
    number = "regexp_replace(port, '^0+([0-9])', '\\1')"
    zero = "" if check else f" OR {number} = '0'"
    return f"""WITH {WITH_PAGES}, u AS (SELECT page_id, {raw} AS raw FROM pages_x),
full_ AS (SELECT page_id, raw, CASE WHEN contains(raw, '://') THEN raw ELSE concat('https://', raw) END AS u FROM u),
parts AS (SELECT *, lower({PART('u', 1)}) AS scheme, {PART('u', 2)} AS netloc, {PART('u', 3)} AS path, {PART('u', 4)} AS query FROM full_),
hosts AS (SELECT *, {HOST('netloc')} AS host, {PORT('netloc')} AS port FROM parts),
checked AS (SELECT *, CASE WHEN raw = '' THEN 'empty_url' WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN host = '' THEN 'missing_hostname'
  WHEN (port <> '' AND coalesce(try_cast(port AS BIGINT), 99999) > 65535) {bad} THEN 'invalid_url' {host_check} END AS error FROM hosts)
SELECT page_id, CASE WHEN error IS NULL THEN concat(scheme, '://', rtrim(host, '.'),
  CASE WHEN port = '' OR (scheme = 'http' AND {number} = '80') OR (scheme = 'https' AND {number} = '443'){zero} THEN '' ELSE concat(':', {number}) END,
  CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END, CASE WHEN query = '' THEN '' ELSE concat('?', query) END) END AS url, error FROM checked"""


def any_sql(expr: str, words, fmt: str = "contains({e}, '{w}')") -> str:
    return "(" + " OR ".join(fmt.format(e=expr, w=w) for w in words) + ")"


def count_sql(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, '{w}') AS INT)" for w in words) + ")"


IS_IP = r"regexp_matches(host, '^([0-9]{1,3}\.){3}[0-9]{1,3}$')"
LABELS = "list_filter(string_split(host, '.'), lambda x: x <> '')"
CUT_PATH = "regexp_replace(path, ';[^/]*$', '')"
ENTROPY = "CASE WHEN length(full_url) > 0 THEN round(-list_sum(list_transform(list_distinct(string_split(full_url, '')), lambda c: CASE WHEN c = '' THEN 0e0 ELSE ((length(full_url) - length(replace(full_url, c, ''))) / CAST(length(full_url) AS DOUBLE)) * log2((length(full_url) - length(replace(full_url, c, ''))) / CAST(length(full_url) AS DOUBLE)) END)), 4) ELSE 0e0 END"
URL_SQL = {
    "url_length": "length(full_url)", "domain_length": "length(netloc)", "path_length": f"length({CUT_PATH})", "query_length": "length(query)",
    "num_dots": "length(full_url) - length(replace(full_url, '.', ''))", "num_hyphens": "length(full_url) - length(replace(full_url, '-', ''))",
    "num_digits": "length(regexp_replace(full_url, '[^0-9]', '', 'g'))", "num_special_chars": r"length(regexp_replace(full_url, '[\p{L}\p{N}]', '', 'g'))",
    "has_https": "scheme = 'https'", "has_ip": IS_IP, "has_at": "contains(full_url, '@')",
    "num_subdomains": f"CASE WHEN {IS_IP} THEN 0 ELSE greatest(len({LABELS}) - 2, 0) END",
    "has_suspicious_tld": f"coalesce({LABELS}[-1] IN ({', '.join(repr(x) for x in lists.RISKY_TLDS)}), false)",
    "has_url_shortener": f"host IN ({', '.join(repr(x) for x in lists.SHORTENERS)})", "has_punycode": "contains(host, 'xn--')", "has_encoded_chars": "contains(full_url, '%')",
    "has_redirect_param": any_sql("lower(query)", lists.REDIRECT_PARAMS, "contains({e}, '{w}=')"),
    "has_embedded_url": "len(regexp_extract_all(lower(full_url), 'https?://')) > 1", "has_long_token": f"regexp_matches(concat(host, {CUT_PATH}, query), '(?i)[a-z0-9]{{18,}}')",
    "has_public_hosting_platform": any_sql("host", lists.HOSTING_DOMAINS, "({e} = '{w}' OR ends_with({e}, '.{w}'))"),
    "has_brand_impersonation": any_sql("lower(full_url)", lists.BRAND_WORDS), "suspicious_word_count": count_sql("lower(full_url)", lists.SUSPICIOUS_WORDS), "entropy": ENTROPY,
}
#: The references that the tables hold, the ampersand last.
UNESCAPE = "{x}"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·")):
    UNESCAPE = f"replace({UNESCAPE}, '{_name}', '{_char}')"
UNESCAPE = f"regexp_replace({UNESCAPE}, '&amp;?', '&', 'g')"
PASSWORDS = "(len(string_split(lower(html), 'type=\"password\"')) - 1 + len(string_split(lower(html), 'type=''password''')) - 1)"
TAG = lambda t: rf"len(regexp_extract_all(html, '(?i)<\s*{t}\b'))"
PLAIN = UNESCAPE.format(x="regexp_replace(lower(html), '<[^>]+>', ' ', 'g')")
HREFS = "list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda h: CASE WHEN starts_with(h, '//') THEN concat('x:', h) ELSE h END)"
LINKS = f"CASE WHEN host = '' THEN 0 ELSE len(list_filter(list_transform({HREFS}, lambda h: {HOST(PART('h', 2))}), lambda x: x <> '' AND x <> host)) END"
HTML_SQL = {
    "html_available": "1", "html_length": "length(html)", "title_length": "length(trim(" + UNESCAPE.format(x=r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')") + "))",
    "num_forms": TAG("form"), "num_password_inputs": PASSWORDS, "num_iframes": TAG("iframe"), "num_scripts": TAG("script"), "num_external_links": LINKS,
    "has_login_form": f"{PASSWORDS} > 0 OR ({TAG('form')} > 0 AND {any_sql(PLAIN, lists.LOGIN_WORDS)})",
    "has_meta_refresh": "contains(lower(html), 'http-equiv=\"refresh\"') OR contains(lower(html), 'http-equiv=''refresh''')",
    "has_javascript_redirect": "contains(lower(html), 'window.location') OR contains(lower(html), 'location.href')", "suspicious_html_word_count": count_sql(PLAIN, lists.HTML_WORDS),
}
URL_LIST = ", ".join(f"{v if k == 'entropy' else f'CAST({v} AS INT)'} AS {k}" for k, v in URL_SQL.items())
HTML_LIST = ", ".join(f"CAST(CASE WHEN html = '' THEN 0 ELSE CAST({v} AS INT) END AS INT) AS {k}" for k, v in HTML_SQL.items())


def score_sql() -> str:
    special = {"path_and_query": "path_length + query_length", "no_https": "1 - has_https", "hosted_subdomain": "CASE WHEN has_public_hosting_platform = 1 AND num_subdomains > 0 THEN 1 ELSE 0 END", "hosted_brand": "CASE WHEN has_public_hosting_platform = 1 AND has_brand_impersonation = 1 THEN 1 ELSE 0 END", "high_entropy": "least(greatest(entropy - 34e-1, 0e0) / 24e-1, 1e0)"}
    term = lambda w, n, c: f" + {w!r}::DOUBLE * " + (f"CAST({special.get(n, n)} AS DOUBLE)" if c is None else f"least(CAST({special.get(n, n)} AS DOUBLE) / {c}e0, 1e0)")
    base = "2e-2" + "".join(term(*t) for t in score.URL_TERMS)
    return f"greatest(1e-2, least(CASE WHEN html_available = 1 THEN {base + ''.join(term(*t) for t in score.HTML_TERMS)} ELSE {base} END, 99e-2))"


FEATURED = f"WITH {PARTS}, f AS (SELECT page_id, label, host, {URL_LIST}, {HTML_LIST} FROM hosts), featured AS (SELECT *, {score_sql()} AS score FROM f)"
CANONICAL = "replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
COLLAPSED = r"lower(regexp_replace(html, '\s+', ' ', 'g'))"
NORMAL = lambda x: "lower(trim(regexp_replace(" + UNESCAPE.format(x=rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')") + r", '\s+', ' ', 'g')))"
quoted = lambda x: "'" + x.replace("'", "''") + "'"

SQL = {
    "url_parts": f"WITH {PARTS} SELECT page_id, full_url, scheme, netloc, path, query, host, port FROM hosts",
    "url_normalise": normalise_sql(True),
    "feed_normalise": normalise_sql(False),
    "unsafe_hosts": "WITH h AS (SELECT event_id, concat(CAST(event_id * 37 % 256 AS STRING), '.', CAST(event_id * 101 % 256 AS STRING), '.', CAST(event_id % 256 AS STRING), '.7') AS host FROM events) SELECT event_id, host, CAST(" + unsafe_sql("host") + " AS INT) AS unsafe FROM h",
    "url_features": f"WITH {PARTS} SELECT page_id, {URL_LIST} FROM hosts",
    "html_features": f"WITH {PARTS} SELECT page_id, {HTML_LIST} FROM hosts",
    "heuristic_score": f"{FEATURED} SELECT page_id, round(score, 9) AS score FROM featured",
    "risk_level": f"""{FEATURED} SELECT page_id, CASE WHEN score >= 75e-2 THEN 'phishing' WHEN page_id % 2 <> 0 OR score >= 4e-1 THEN 'suspicious' ELSE 'legitimate' END AS risk_level,
CASE WHEN page_id % 2 <> 0 AND score < 75e-2 THEN 'inconclusive' WHEN score >= 5e-1 THEN 'phishing' ELSE 'legitimate' END AS label FROM featured""",
    "observed_signals": FEATURED + " " + " UNION ALL ".join(f"SELECT page_id, '{x}' AS signal, {x} AS value FROM featured WHERE {x} = 1" for x in SIGNALS),
    "risk_by_domain": f"{FEATURED} SELECT host, count(*) AS pages, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count_if(score >= 5e-1) AS risky FROM featured WHERE host <> '' GROUP BY host",
    "tag_counts": rf"WITH {WITH_PAGES}, t AS (SELECT lower(unnest(regexp_extract_all(html, '(?i)<\s*([a-z0-9]+)\b', 1))) AS tag FROM pages_x) SELECT tag, count(*) AS n FROM t GROUP BY tag",
    "top_tlds": f"""WITH {PARTS}, c AS (SELECT label, string_split(host, '.')[-1] AS tld, count(*) AS n, min(page_id) AS first FROM hosts WHERE host <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, first) AS rk FROM c) SELECT label, string_agg(tld, '; ' ORDER BY rk) AS top FROM r WHERE rk <= 3 GROUP BY label""",
    "html_fingerprint": f"WITH {WITH_PAGES} SELECT sha256({CANONICAL}) AS html_sha256, count(*) AS n, min(page_id) AS first_page FROM pages_x GROUP BY 1",
    "error_page": f"WITH {WITH_PAGES}, e AS (SELECT page_id, coalesce({', '.join(f'CASE WHEN contains({COLLAPSED}, {quoted(x)}) THEN {quoted(x)} END' for x in lists.ERROR_SIGNATURES)}) AS signature FROM pages_x) SELECT * FROM e WHERE signature IS NOT NULL",
    "text_normalise": f"WITH {WITH_PAGES}, v AS (SELECT page_id, {NORMAL('html')} AS v FROM pages_x) SELECT page_id, length(v) AS n, md5(v) AS digest FROM v",
    "strip_markup": f"WITH {WITH_PAGES}, v AS (SELECT page_id, " + NORMAL(r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')") + " AS v FROM pages_x) SELECT page_id, length(v) AS n, md5(v) AS digest FROM v",
    "char_encode": "WITH c AS (SELECT conv_id, turn, list_transform(range(1, 201), lambda i: CASE WHEN i <= length(text) THEN least(unicode(substring(lower(text), i, 1)), 127) ELSE 0 END) AS ids FROM conversations) SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n, CAST(list_sum(ids) AS BIGINT) AS total, md5(array_to_string(ids, ',')) AS digest FROM c",
}

QUERIES = {f.__name__: f for f in (url_parts, url_normalise, feed_normalise, url_normalise_idna, domain_urls, unsafe_hosts, url_features, html_features, heuristic_score, risk_level, observed_signals, risk_by_domain, online_predict, tag_counts, top_tlds, html_fingerprint, error_page, text_normalise, strip_markup, html_tokens, html_signals, char_encode)}
SQL["online_predict"] = f"""{FEATURED} SELECT page_id, full_url, CASE WHEN score < 75e-2 THEN 'inconclusive' WHEN score >= 5e-1 THEN 'phishing' ELSE 'legitimate' END AS decision, CASE WHEN score >= 75e-2 THEN 'phishing' ELSE 'suspicious' END AS risk_level,
round(score, 4) AS phishing_probability, 'rules' AS model_source, html_available FROM featured JOIN (SELECT page_id, full_url, url FROM hosts) USING (page_id) WHERE length(trim(url)) BETWEEN 3 AND 2048"""
SQL["domain_urls"] = f"WITH {PARTS} SELECT page_id, CASE WHEN host = '' THEN NULL ELSE concat('https://', host, '/') END AS url, CASE WHEN host = '' THEN 'empty_url' END AS error FROM hosts"

_RESULTS = ", ".join(f"'{r}'" for r in ODD_RESULTS)
SQL["url_normalise_idna"] = f"""SELECT page_id, CASE WHEN r NOT IN ('', '!') THEN concat('http://', r, '/', page_id) END AS url, CASE r WHEN '' THEN 'unsafe_hostname' WHEN '!' THEN 'invalid_url' END AS error
FROM (SELECT page_id, [{_RESULTS}][page_id % {len(ODD_RESULTS)} + 1] AS r FROM pages)"""
