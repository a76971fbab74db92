"""Character references of HTML as native expressions, with what the standard library's table of names says."""

from __future__ import annotations

import html as _html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import let

REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
REPLACEMENT = "�"
#: Numbers below this have replacements of their own, among them the Windows characters from 128 to 159.
LOW = 160


def _constant(value, kind: str) -> Column:
    """One literal that the optimizer parses once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _names(chosen) -> Column:
    """Names by their first letter: maps are searched from their start, so they're kept short."""
    by: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        if chosen(name):
            by.setdefault(name[0], {})[name] = text
    return _constant(by, "map<string,map<string,string>>")


def numbered(ref: Column) -> Column:
    """The character of &#123; or &#x7b;: nothing for what is none, U+FFFD beyond the last one."""
    digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    hexadecimal = F.lower(F.substring(ref, 3, 1)) == "x"
    n = F.when(F.length(digits) > 8, F.lit(0x110000)).when(digits == "", F.lit(0)).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint"))
    low = _constant([_html.unescape(f"&#{i};") for i in range(LOW)], "array<string>")

    def char(n: Column) -> Column:
        beyond = (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        none = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
        return F.when(n < LOW, F.get(low, n.cast("int"))).when(beyond, REPLACEMENT).when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    return let(n.cast("bigint"), char)


def named(ref: Column) -> Column:
    """The text of a name, of the longest name without semicolon that it starts with, or the reference as it is."""
    short = _names(lambda x: not x.endswith(";"))
    sizes = sorted({len(x) for x in html5 if not x.endswith(";")}, reverse=True)

    def found(s: Column) -> Column:
        first = F.substring(s, 1, 1)
        starts = [F.when(F.length(s) > n, F.concat(short[first][F.substring(s, 1, n)], F.substring(s, n + 1, 40))) for n in sizes]
        return F.coalesce(_names(lambda x: True)[first][s], *starts, F.concat(F.lit("&"), s))

    return let(F.substring(ref, 2, 40), found)


def unescape(text: Column) -> Column:
    """All character references of a text replaced once, from its start to its end."""

    def replaced(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        rest = F.split(t, REFERENCE)
        made = F.zip_with(refs, F.slice(rest, F.lit(2), F.size(rest)), lambda r, after: F.concat(F.when(r.startswith("&#"), numbered(r)).otherwise(named(r)), after))
        return F.concat(F.get(rest, F.lit(0)), F.array_join(made, ""))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), replaced(t)).otherwise(t))
