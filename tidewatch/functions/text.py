"""Text functions."""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import unescape

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def normalise(text: Column) -> Column:
    """T1, natively."""
    t = unescape(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, " "))
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def normalise_text(text: str | None) -> str:
    """T1 of one text, with all entities."""
    return re.sub(r"\s+", " ", _html.unescape(re.sub(CONTROL, " ", text or ""))).strip().lower()


def normalise_udf():

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(normalise_text)

    return of


def trimmed(text: Column, most: int) -> Column:
    """The first characters; all where ``most`` isn't positive."""
    t = F.coalesce(text, F.lit(""))
    return t if most <= 0 else F.substring(t, 1, most)


def without_bom(text: Column) -> Column:
    """A byte order mark goes, also one that was decoded wrongly."""
    return F.regexp_replace(text, "^(﻿|ï»¿)", "")


def char_encode(text: Column, most: int, vocabulary: int) -> Column:
    """Code points of the lower-cased start, at most ``vocabulary - 1``, padded with 0."""
    t = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, most)
    ids = F.when(t == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(t, ""), lambda c: F.least(F.ascii(c), F.lit(vocabulary - 1))))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), most)), 1, most)


def label_of(value: Column) -> Column:
    """PF1: 0, 1 or null."""
    from . import lists

    v = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(v.isin(*lists.LEGITIMATE), F.lit(0)).when(v.isin(*lists.PHISHING), F.lit(1))


def resolved(path: Column, root: str) -> Column:
    """PF16: an absolute path without empty, ``.`` and ``..`` steps; a relative one starts at ``root``."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))


def portable(path: Column, root: str) -> Column:
    """PF16: the path from ``root``, where it is inside; else the absolute path."""
    from .url import let

    inside = root.rstrip("/") + "/"
    return let(resolved(path, root), lambda p: F.when(p.startswith(inside), F.substr(p, F.lit(len(inside) + 1))).otherwise(p))
