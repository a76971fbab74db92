"""Scorers: a registry of names, numpy forward passes of the networks in Arrow batches, and a trainable logistic model.

Weights are a dictionary of arrays by layer (see ``seeded``); where trained ones are at hand they are passed instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists

URL_CHARS, URL_VOCABULARY, HTML_CHARS, HTML_VOCABULARY, IMAGE = 200, 128, 2000, 256, 64
EMBEDDING, FILTERS, HIDDEN, IMAGE_FEATURES = 64, 128, 96, 128
#: Rows of an Arrow batch, sums of a first layer and images that are held at a time, and characters up to which pairs of them are looked up.
ROWS, BLOCK, IMAGES, PAIRED = 256, 480, 16, 112


def windows1d(padded: np.ndarray, width: int) -> np.ndarray:
    """padded: length + width - 1, in; each place's window as a row, without copies: length, width * in."""
    step, item = padded.strides
    return np.lib.stride_tricks.as_strided(padded, (len(padded) - width + 1, width * padded.shape[1]), (step, item))


def conv1d(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x: n, length, in; w: width, in, out; same length."""
    padded = np.pad(x, ((0, 0), (len(w) // 2, len(w) // 2), (0, 0)))
    return np.maximum(np.stack([windows1d(row, len(w)) @ w.reshape(-1, w.shape[2]) for row in padded]) + b, 0)


class Embedded:
    """The sums of a convolution over ``emb[ids]``, without its bias: what each character gives at each place of the window is multiplied once and looked up.

    Where the rows have few different characters, neighbouring places are looked up as a pair.
    """

    def __init__(self, ids: np.ndarray, lengths: list[int], emb: np.ndarray, w: np.ndarray):
        """Each row ends at its length."""
        side, used = len(w) // 2, np.flatnonzero(np.bincount(ids.reshape(-1), minlength=len(emb)))
        n, at = len(used) + 1, np.zeros(len(emb), np.intp)  # the last one is outside
        at[used] = np.arange(n - 1)
        shares = np.concatenate([emb[used] @ w, np.zeros((len(w), 1, w.shape[2]), np.float32)], axis=1)
        singles = np.pad(at[ids], ((0, 0), (side, side)), constant_values=n - 1)
        singles[np.arange(singles.shape[1]) >= np.array(lengths)[:, None] + side] = n - 1
        paired = len(w) // 2 * 2 if n <= PAIRED else 0
        pairs = singles[:, :-1] * n + singles[:, 1:] if paired else singles
        self.looked = [(i, (shares[i][:, None] + shares[i + 1]).reshape(n * n, -1), pairs) for i in range(0, paired, 2)]
        self.looked += [(i, shares[i], singles) for i in range(paired, len(w))]
        self.out, self.next = np.empty((2, BLOCK, w.shape[2]), shares.dtype)

    def blocks(self, row: int, length: int):
        """The first sums of a row, at most ``BLOCK`` at a time, which stay in the processor's cache; each takes the place of the one before."""
        for start in range(0, length, BLOCK):
            k = min(BLOCK, length - start)
            for j, (i, table, ids) in enumerate(self.looked):
                np.take(table, ids[row, start + i : start + i + k], axis=0, out=(self.next if j else self.out)[:k], mode="clip")
                if j:
                    self.out[:k] += self.next[:k]
            yield self.out[:k]


def unpadded(ids: np.ndarray, width: int, pool: int) -> np.ndarray:
    """The ids without most of the padding that all rows end with: a convolution, a pool and a convolution, all of this width or less, have the same maxima.

    Beyond what the last character reaches the values repeat up to what the end reaches; one of the repeated places stays.
    """
    length, used = ids.shape[1], np.flatnonzero(ids.any(axis=0))
    reached = (int(used[-1]) + 1 if len(used) else 0) + width // 2
    return ids[:, : min(length, (-(-reached // pool) + 2 * width) * pool + length % pool)]


def conv2d(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x: n, h, w, in; w: 3, 3, in, out, the batch norm folded into it; without the bias."""
    n, height, wide, ins = x.shape
    padded = np.zeros((n, height + 2, wide + 2, ins), x.dtype)
    padded[:, 1:-1, 1:-1] = x
    seen = np.lib.stride_tricks.as_strided(padded, (n, height, wide, 3, 3 * ins), (*padded.strides[:3], padded.strides[1], padded.itemsize))
    return (seen.reshape(-1, 9 * ins) @ w.reshape(9 * ins, -1)).reshape(n, height, wide, -1)


def pool1d(x: np.ndarray, k: int) -> np.ndarray:
    n = x.shape[-2] // k
    return reduce(np.maximum, [x[..., i : n * k : k, :] for i in range(k)])


def pool2d(x: np.ndarray) -> np.ndarray:
    return pool1d(np.maximum(x[:, : x.shape[1] // 2 * 2 : 2], x[:, 1::2]), 2)


def lstm(ids: np.ndarray, emb: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The last hidden state; gates in the order input, forget, cell, output.

    Rows join when their leading padding is over, with the state that this many steps of padding give. A sigmoid is a tanh of half its argument.
    """
    n, size = len(ids), wh.shape[0]
    half = np.repeat(np.array([0.5, 0.5, 1, 0.5], np.float32), size)
    shares, wh = (emb @ wx + b) * half, wh * half

    def step(x: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = h @ wh
        z += x
        np.tanh(z, out=z)
        i, f, g, o = (z[:, k * size : (k + 1) * size] for k in range(4))
        c = (f + 1) * c + (i + 1) * g
        c *= 0.5
        return (o + 1) * np.tanh(c) * np.float32(0.5), c

    lead = np.where(ids.any(axis=1), (ids != 0).argmax(axis=1), ids.shape[1])
    order = np.argsort(lead, kind="stable")
    ids, lead = ids[order], lead[order]
    h, c = np.zeros((2, n, size), np.float32)
    padded = np.zeros((2, 1, size), np.float32)
    for t in range(ids.shape[1] + 1):
        now, joined = np.searchsorted(lead, t, side="left"), np.searchsorted(lead, t, side="right")
        h[now:joined], c[now:joined] = padded
        if t == ids.shape[1]:
            break
        if joined:
            h[:joined], c[:joined] = step(shares[ids[:joined, t]], h[:joined], c[:joined])
        if joined < n:
            padded = step(shares[:1], *padded)
    out = np.empty_like(h)
    out[order] = h
    return out


# A bias and a cut at 0 keep the order of values, so they come after a maximum.


def _url(ids, p):
    w, b = p["conv"]
    lengths = [unpadded(row[None], len(w), 1).shape[1] for row in ids]
    first, top = Embedded(ids, lengths, p["emb"], w), np.empty((len(ids), w.shape[2]), np.float32)
    for i, length in enumerate(lengths):
        top[i] = reduce(np.maximum, (x.max(axis=0) for x in first.blocks(i, length)))
    return np.maximum(top + b, 0)


def _twice(ids, p, pool):
    (w1, b1), (w2, b2) = p["conv1"], p["conv2"]
    lengths = [unpadded(row[None], max(len(w1), len(w2)), pool).shape[1] for row in ids]
    first, top, flat = Embedded(ids, lengths, p["emb"], w1), np.empty((len(ids), w2.shape[2]), np.float32), w2.reshape(-1, w2.shape[2])
    side, most = len(w2) // 2, max(lengths, default=0) // pool
    padded, seen, made = (np.zeros(size, flat.dtype) for size in ((most + 2 * side, w2.shape[1]), (most, len(flat)), (most, flat.shape[1])))  # for all rows, as fresh memory takes time
    for i, length in enumerate(lengths):
        n, end = length // pool, side
        for sums in first.blocks(i, n * pool):
            padded[end : (end := end + len(sums) // pool)] = pool1d(sums, pool)
        padded[side:end] += b1
        np.maximum(padded[side:end], 0, out=padded[side:end])
        padded[end : end + side] = 0
        seen[:n] = windows1d(padded[: end + side], len(w2))
        top[i] = np.matmul(seen[:n], flat, out=made[:n]).max(axis=0)
    return np.maximum(top + b2, 0)


def _html(ids, p):
    return _twice(ids, p, 4)


def _image(x, p):
    x = x.reshape(len(x), 3, IMAGE, IMAGE)
    same, out = (x == x[:, :, :1]).all(axis=(1, 2, 3)), np.empty((len(x), IMAGE_FEATURES), np.float32)
    for level in (True, False):
        rows = np.flatnonzero(same == level)
        for at in (rows[i : i + IMAGES] for i in range(0, len(rows), IMAGES)):
            out[at] = _images(x[at].transpose(0, 2, 3, 1), p, level)
    return out


def _images(x, p, level: bool):
    """The means of the last layer. Where an image's rows are all the same (``level``), so are all rows of a layer but the two next to each edge.

    Six rows then stand for all: two at each edge, two for what is between. A pool leaves three of them, of which the middle one is repeated.
    """
    for k in range(4):
        if level:
            x = x[:, [0, 1, 1, 1, 1, 2]]
        w, b = p[f"conv{k}"]
        x = conv2d(x, w)
        x = np.maximum((pool2d(x) if k < 3 else x) + b, 0)
    rows = x.mean(axis=2)
    return (rows.sum(axis=1) + (IMAGE // 8 - 6) * rows[:, 2]) / (IMAGE // 8) if level else rows.mean(axis=1)


def _head(x, p):
    for k in range(len(p)):
        x = x @ p[f"w{k}"][0] + p[f"w{k}"][1]
        x = np.maximum(x, 0) if k < len(p) - 1 else x
    return x[:, 0]


def _deep(ids, p):
    return _twice(ids, p, 2)


FORWARD: dict[str, Callable] = {
    "url_cnn": lambda p, url: _head(_deep(url, p["url"]), p["head"]),
    "url_lstm": lambda p, url: _head(np.concatenate([lstm(url, p["emb"], *p["ahead"]), lstm(url[:, ::-1], p["emb"], *p["back"])], axis=1), p["head"]),
    "html_cnn": lambda p, html: _head(_html(html, p["html"]), p["head"]),
    "screenshot_cnn": lambda p, image: _head(_image(image, p["image"]), p["head"]),
    "dual_branch_cnn": lambda p, url, html: _head(np.concatenate([_url(url, p["url"]), _html(html, p["html"])], axis=1), p["head"]),
    "tri_branch_cnn": lambda p, url, html, image: _head(np.concatenate([_url(url, p["url"]), _html(html, p["html"]), _image(image, p["image"])], axis=1), p["head"]),
}


def seeded(model: str, seed: int = 42) -> dict:
    """Weights of the right shapes from a seed."""
    rng = np.random.default_rng([seed, [m for m, _ in lists.MODELS].index(model)])
    layer = lambda *shape: ((rng.normal(size=shape) / np.sqrt(np.prod(shape[:-1]))).astype(np.float32), np.zeros(shape[-1], np.float32))
    emb = lambda n: np.concatenate([np.zeros((1, EMBEDDING)), rng.normal(size=(n - 1, EMBEDDING))]).astype(np.float32)
    head = lambda *sizes: {f"w{k}": layer(a, b) for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False))}
    two = lambda n, k: {"emb": emb(n), "conv1": layer(k, EMBEDDING, FILTERS), "conv2": layer(k, FILTERS, FILTERS)}
    url = lambda: {"emb": emb(URL_VOCABULARY), "conv": layer(5, EMBEDDING, FILTERS)}
    image = lambda: {f"conv{k}": layer(3, 3, a, b) for k, (a, b) in enumerate(((3, 32), (32, 64), (64, 128), (128, IMAGE_FEATURES)))}
    gate = lambda: ((rng.normal(size=(EMBEDDING, 4 * HIDDEN)) / 8).astype(np.float32), (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / 10).astype(np.float32), np.zeros(4 * HIDDEN, np.float32))
    if model == "url_cnn":
        return {"url": two(URL_VOCABULARY, 5), "head": head(FILTERS, 128, 1)}
    if model == "url_lstm":
        return {"emb": emb(URL_VOCABULARY), "ahead": gate(), "back": gate(), "head": head(2 * HIDDEN, 128, 1)}
    if model == "html_cnn":
        return {"html": two(HTML_VOCABULARY, 7), "head": head(FILTERS, 128, 1)}
    if model == "screenshot_cnn":
        return {"image": image(), "head": head(IMAGE_FEATURES, 1)}
    if model == "dual_branch_cnn":
        return {"url": url(), "html": two(HTML_VOCABULARY, 7), "head": head(2 * FILTERS, 128, 64, 1)}
    return {"url": url(), "html": two(HTML_VOCABULARY, 7), "image": image(), "head": head(2 * FILTERS + IMAGE_FEATURES, 192, 64, 1)}


def scorers(models: list[str], spark, weights: dict[str, dict] | None = None) -> Callable[..., Column]:
    """ML7: a function of the inputs url, html (ids as arrays of int) and screenshot (arrays of float) that models read: a struct of their probabilities.

    What several models read goes to Python once. An image takes 48 KB, so the session's Arrow batches get at most ``ROWS`` rows.
    """

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))
    reads = {m: r.split("+") for m, r in lists.MODELS if m in models}
    sent = spark.sparkContext.broadcast({m: (weights or {}).get(m) or seeded(m) for m in models})

    @F.pandas_udf(", ".join(f"{m} double" for m in models))
    def of(frame: pd.DataFrame) -> pd.DataFrame:
        x = {c: np.stack([np.asarray(v) for v in frame[c]]) if len(frame) else None for c in frame.columns}
        z = lambda m: FORWARD[m](sent.value[m], *(x[r] for r in reads[m])).astype(float)
        return pd.DataFrame({m: 1 / (1 + np.exp(-z(m))) if len(frame) else np.empty(0) for m in models})

    return lambda **inputs: of(F.struct(*(c.alias(k) for k, c in inputs.items())))


def scorer(model: str, spark, weights: dict | None = None) -> Callable[..., Column]:
    """ML7: a function of one model's input columns, in their order: a probability.

    Each model reads its own inputs only, so the columns that it doesn't need are pruned from the scan.
    """
    of = scorers([model], spark, weights and {model: weights})
    reads = dict(lists.MODELS)[model].split("+")
    return lambda *columns: of(**dict(zip(reads, columns, strict=True)))[model]


def selected(names: list[str] | None = None) -> list[str]:
    """PF11: the models asked for, in the registry's order."""
    every = [m for m, _ in lists.MODELS]
    if not names or names == ["all"]:
        return every
    if unknown := sorted(set(names) - set(every)):
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    return [m for m in every if m in names]


def train_logistic(rows: DataFrame, columns: list[str], label: str = "label", **kw):
    """ML8: a logistic regression over feature columns; returns a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", predictionCol="predicted", maxIter=kw.get("max_iter", 50), regParam=kw.get("ridge", 1e-3))]
    return Pipeline(stages=steps).fit(rows)
