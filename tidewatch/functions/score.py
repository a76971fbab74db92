"""The rule-based score of a page and what is decided from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score's terms in the order in which they are added: weight, feature(s), cap (None: as it is).
BASE = 0.02
URL_TERMS = (
    (0.12, "url_length", 160), (0.08, "path_and_query", 90), (0.10, "num_special_chars", 28), (0.10, "num_digits", 10), (0.06, "num_dots", 5),
    (0.06, "num_hyphens", 4), (0.08, "num_subdomains", 3), (0.24, "suspicious_word_count", 2), (0.18, "has_ip", None), (0.18, "has_at", None),
    (0.12, "no_https", None), (0.20, "has_url_shortener", None), (0.14, "has_redirect_param", None), (0.22, "has_embedded_url", None),
    (0.14, "has_long_token", None), (0.18, "has_brand_impersonation", None), (0.12, "hosted_subdomain", None), (0.34, "hosted_brand", None),
    (0.12, "has_punycode", None), (0.10, "has_encoded_chars", None), (0.10, "has_suspicious_tld", None), (0.06, "high_entropy", None),
)
HTML_TERMS = (
    (0.06, "num_forms", 3), (0.12, "num_password_inputs", 2), (0.06, "num_iframes", 2), (0.06, "num_external_links", 20),
    (0.12, "has_login_form", None), (0.10, "has_meta_refresh", None), (0.10, "has_javascript_redirect", None), (0.12, "suspicious_html_word_count", 4),
)
LOW, HIGH = 0.01, 0.99
SUSPICIOUS, PHISHING = 0.40, 0.75


def heuristic(f: dict[str, Column]) -> Column:
    """A sum of doubles in a fixed order, between LOW and HIGH."""
    d = lambda c: c.cast("double")
    f = f | {
        "path_and_query": f["path_length"] + f["query_length"],
        "no_https": F.lit(1) - f["has_https"],
        "hosted_subdomain": F.when((f["has_public_hosting_platform"] == 1) & (f["num_subdomains"] > 0), 1).otherwise(0),
        "hosted_brand": F.when((f["has_public_hosting_platform"] == 1) & (f["has_brand_impersonation"] == 1), 1).otherwise(0),
        "high_entropy": F.least(F.greatest(f["entropy"] - 3.4, F.lit(0.0)) / 2.4, F.lit(1.0)),
    }

    def add(total: Column, terms) -> Column:
        for weight, name, cap in terms:
            total = total + F.lit(weight) * (d(f[name]) if cap is None else F.least(d(f[name]) / float(cap), F.lit(1.0)))
        return total

    url = add(F.lit(BASE), URL_TERMS)
    total = F.when(f["html_available"] == 1, add(url, HTML_TERMS)).otherwise(url)
    return F.greatest(F.lit(LOW), F.least(total, F.lit(HIGH)))


def risk_level(score: Column, deep: Column) -> Column:
    """PF9: without a deep model nothing is called legitimate."""
    return F.when(score >= PHISHING, "phishing").when(~deep | (score >= SUSPICIOUS), "suspicious").otherwise("legitimate")


def decision(score: Column, threshold: Column, fallback: Column) -> Column:
    """PF10."""
    return F.when(fallback & (score < PHISHING), "inconclusive").when(score >= threshold, "phishing").otherwise("legitimate")
