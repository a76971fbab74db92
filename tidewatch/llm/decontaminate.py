"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over token windows and verified.

Words are the runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII. A benchmark item gives
one window for each run of ``window`` consecutive words; an item of fewer words, but not none, is one window of its
own length. A document word inside any occurrence of a window is hit.

The scan is a narrow map: no document text is shuffled. The benchmark is broadcast in slices of about ``slice_windows``
windows. A larger benchmark takes a pass for each slice: only that slice is held by the driver and the workers, the hits of
the texts that have any are written, its broadcast is destroyed, and the passes' hits are united by the text's hash. So
memory is bounded whatever the benchmark's size, and no window is dropped.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; equal items all
count; items without an id count as hits and together as one item, and are not named; ids are compared as strings; repeated documents each
keep their row; an empty benchmark leaves every document clean; new columns that clash with those of ``docs`` raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialised, short_batches

WINDOW = 10
#: Windows in one broadcast slice: some 200 bytes each.
SLICE_WINDOWS = 200_000
#: Bytes of a text that are split at once.
STEP = 4 << 20

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A word, where upper case letters are not lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_chunks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)
    at = 0
    while at < len(data):
        end = len(data) if at + STEP >= len(data) else data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = (h ^ ids[at + j].astype(np.uint64)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """A slice of the benchmark: word ids, and for each window length the sorted hashes and the windows themselves."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]]):
        """items: (item's id, the words of one window)."""
        self.ids: dict[bytes, int] = {}
        of: dict[int, dict[tuple, set]] = {}
        for item, words in items:
            key = tuple(self.ids.setdefault(w, len(self.ids)) for w in words)
            of.setdefault(len(key), {}).setdefault(key, set()).add(item)
        self.of = {n: {k: tuple(v) for k, v in windows.items()} for n, windows in of.items()}
        self.hashes = {n: np.unique(_hashes(a := np.array(list(w), np.int64).reshape(-1), np.arange(0, len(a), n), n)) for n, w in self.of.items()}

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Words, positions of the hit words, ids of the items that occur."""
        parts = [np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words)) for words in word_chunks(text)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        mark, found = np.zeros(len(ids) + 1, np.int32), set()
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        for n, windows in self.of.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            h, known = _hashes(ids, at, n), self.hashes[n]
            at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            for i in at.tolist():  # a hash may collide: the words decide
                if items := windows.get(tuple(ids[i : i + n].tolist())):
                    found.update(items)
                    mark[i] += 1
                    mark[i + n] -= 1
        return len(ids), np.flatnonzero(np.cumsum(mark) > 0) if found else np.zeros(0, np.int64), found


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): one row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w for part in word_chunks(text) for w in part]
                out += [(item, b" ".join(words[i : i + window])) for i in range(max(len(words) - window + 1, min(len(words), 1)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["item", "words"])

    return benchmark.select(F.col(item_col).cast("string"), text_col).mapInArrow(run, "item string, words binary")


def slices(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[tuple[int, Windows]]:
    """The number of slices, and one slice at a time: of at most about ``most`` windows."""
    made = materialised(windows_of(benchmark, item_col, text_col, window), "windows")
    n = max(1, -(-made.count() // most))
    for k in range(n):
        own = made.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k)
        yield n, Windows([(r.item, bytes(r.words).split(b" ")) for r in own.toLocalIterator()])


#: What a scan finds in a text: names and types.
FOUND = (("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items", "array<string>"), ("spans", "array<array<bigint>>"))
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))


def spans_of(hit: np.ndarray) -> list[list[int]]:
    """Runs of consecutive positions: first, past the last."""
    edge = np.flatnonzero(np.diff(hit) != 1)
    return [[int(a), int(z) + 1] for a, z in zip(hit[np.r_[0, edge + 1]], hit[np.r_[edge, -1]], strict=True)] if len(hit) else []


def scanned(docs: DataFrame, text_col: str, sent, names: list[str]) -> DataFrame:
    """``docs`` with what a broadcast slice finds in each text."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, (_, k) in zip(names, FOUND, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(at).to_pylist():
                n, hit, found = sent.value.scan(text)
                named = sorted(x for x in found if x is not None)
                for column, v in zip(out, (n, len(hit), len(found), named, spans_of(hit)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, k) for v, k in zip(out, _KINDS, strict=True))], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_windows: int = SLICE_WINDOWS, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (ids as strings, sorted), spans (first hit word, past the last).

    ``prefix`` goes before the new columns' names, where ``docs`` has columns of these names.
    """
    short_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    names = [prefix + x for x, _ in FOUND]
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns of these names exist already: {sorted(clash)}")
    parts = []
    for n, part in slices(benchmark, item_col, item_text_col, window, slice_windows):
        sent = sc.broadcast(part)
        if n == 1:
            return scanned(docs, text_col, sent, names)
        texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
        found = scanned(texts, "text", sent, [x for x, _ in FOUND]).where("n_hit > 0")
        one = found.groupBy("h").agg(*(F.first(x).alias(x) for x in ("items", "spans")), F.first(F.col("n_items") - F.size("items")).alias("unnamed"))
        parts.append(materialised(one, "hits"))
        sent.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.max("unnamed").alias("unnamed"))
    # the words that any pass hit: runs are joined where they touch or overlap
    begin, end = (lambda x: x[0]), (lambda x: x[1])
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<array<bigint>>"),
        lambda done, x: F.when((F.size(done) > 0) & (end(F.element_at(done, -1)) >= begin(x)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(begin(F.element_at(done, -1)), F.greatest(end(F.element_at(done, -1)), end(x)))))).otherwise(F.concat(done, F.array(x))),
    )
    every = materialised(every.select("h", "items", joined.alias("spans"), (F.size("items") + F.col("unnamed")).alias("n")), "hits")
    key, of = free_name(docs, "_text_hash"), free_name(docs, "_found")
    rows = docs.withColumn(key, F.xxhash64(text_col)).join(every.select(F.col("h").alias(key), F.struct("items", "spans", "n").alias(of)), key, "left")
    hit = F.aggregate(F.col(of)["spans"], F.lit(0).cast("bigint"), lambda a, x: a + end(x) - begin(x))
    made = (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("bigint"), F.coalesce(hit, F.lit(0)), F.coalesce(F.col(of)["n"], F.lit(0)).cast("bigint"), F.coalesce(F.col(of)["items"], F.array().cast("array<string>")), F.coalesce(F.col(of)["spans"], F.array().cast("array<array<bigint>>")))
    return rows.select(*docs.columns, *(c.alias(x) for c, x in zip(made, names, strict=True)))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """Only the documents without a hit word; the columns of ``docs``."""
    mark = free_name(docs, "_d_n_hit").removesuffix("n_hit")
    return decontaminate(docs, benchmark, text_col, prefix=mark, **kw).where(F.col(f"{mark}n_hit") == 0).select(*docs.columns)


def remove_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without the words in the spans, its other characters as they are."""
    if not text or not spans:
        return text
    import re

    out, last = [], 0
    words = list(re.finditer(WORDS, text))
    for a, z in spans:
        out.append(text[last : words[a].start()])
        last = words[z - 1].end()
    return "".join([*out, text[last:]])


def digest(items: list) -> str:
    return hashlib.sha256(",".join(map(str, items)).encode()).hexdigest()


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


__all__ = ["Windows", "clean", "decontaminate", "digest", "query", "remove_spans"]
