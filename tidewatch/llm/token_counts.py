"""Token counts by a map-side two-tier lookup: no pre-token is shuffled.

A text's pieces never span the place between a word and the white space (the vocabulary's space mark) after it, nor a
newline, so the count of a text is the sum over its pre-tokens: a run of spaces with the word that follows, a lone run of
spaces, or a newline. The first tier is a compact table of frequent pre-tokens' lengths, fitted on a bounded sample
and broadcast; it saves time only and cannot change a count. Misses are encoded in the worker and kept in its cache,
which is emptied when ``CACHE`` entries are reached.

Texts that hold the space mark itself are encoded whole. Null counts as empty, and empty texts have no tokens; texts
are never truncated; longer ones than ``STEP`` characters are scanned without a list of all their pre-tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, short_batches

MARK = "▁"
PRE = re.compile(r" *[^ \n]+| +|\n")
#: Entries of the broadcast table; of a worker's cache; longest pre-token that either keeps; documents of the sample.
FREQUENT, CACHE, LONGEST, SAMPLE = 50_000, 200_000, 48, 4_000
STEP = 1 << 22


class Lengths(dict):
    """Pre-token -> tokens. A missing one is encoded; the sum of all in a text is the text's count."""

    def __init__(self, model: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent, self.encode = frequent, sentencepiece.SentencePieceProcessor(model_file=model).encode
        self.newline = len(self.encode("\n"))
        self.additive = True

    def __missing__(self, unit: str) -> int:
        n = self.length(unit)
        if len(unit) <= LONGEST:
            if len(self) >= CACHE + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[unit] = n
        return n

    def length(self, unit: str) -> int:
        if unit == "\n":
            return self.newline - 1
        if unit == " ":
            return 1  # the space mark alone
        if unit[0] == " ":
            return len(self.encode(unit[1:]))  # the library sets the mark before a text
        return len(self.encode("\n" + unit)) - self.newline

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text or not self.additive:
            return len(self.encode(text))
        text = " " + text
        if len(text) > STEP:
            return sum(self[m[0]] for m in PRE.finditer(text))
        return sum(map(self.__getitem__, PRE.findall(text)))


def additive(model: str) -> bool:
    """Whether no piece spans the end of a pre-token and no normaliser looks beyond it; else texts are encoded whole."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    spans = re.compile(rf"[^{MARK}]{MARK}|.\n|\n.", re.S)
    plain = m.encode("a  b ") and "".join(m.encode("a  b ", out_type=str)) == f"{MARK}a{MARK}{MARK}b{MARK}"
    return bool(plain) and not any(spans.search(m.id_to_piece(i)) for i in range(m.get_piece_size()))


def frequent_lengths(docs: DataFrame, text_col: str, model: str, sample: int = SAMPLE, size: int = FREQUENT) -> dict[str, int]:
    """The table of the first tier: the ``size`` most frequent pre-tokens of about ``sample`` documents."""
    n = docs.count()
    if not n:
        return {}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and len(text) <= STEP:
                    seen.update(x for x in PRE.findall(" " + text) if len(x) <= LONGEST)
                if len(seen) > 8 * size:
                    seen = Counter(dict(seen.most_common(4 * size)))
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], names=["unit", "n"])

    short_batches(docs.sparkSession)
    few = docs.select(text_col).sample(fraction=min(1.0, sample / n), seed=7)
    top = few.mapInArrow(tally, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(size)
    lengths = Lengths(model, {})
    return {r.unit: lengths.length(r.unit) for r in top.collect()}


def token_counts(docs: DataFrame, model: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text, as the library counts without added special tokens."""
    sums = additive(model)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, model) if sums else {})

    def start():
        lengths = Lengths(model, table.value)
        lengths.additive = sums
        return lambda texts: [[lengths.count(x) for x in texts]]

    return append(docs, text_col, [(name, "bigint")], start)


def query(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    out = token_counts(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
