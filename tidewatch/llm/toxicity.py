"""Toxicity by class-conditional Kneser-Ney models over word pairs.

A toxic and an ordinary model give each text's words, from a start to an end symbol, a log-likelihood; their difference,
normalised by length, is the evidence. Both are interpolated bigram models with absolute discount ``D``. For class k::

    P_k(w | v) = (1 - rest(v)) * c'_k(v w) / sum of c'_k(v .)  +  rest(v) * U_k(w)
    U_k(w)     = (1 - rest)    * N'_k(. w) / sum of N'_k       +  rest    * B_k(w)
    B_k(w)     = (1 - left)    * M'_k(s) / sum of M'_k * S(w) / S(s)  +  left * S(w)
    S(w)       = n(w) / (sum of all n + 1)      n: N(. w) + 1 of both classes; 1 for told words and words of told stems

``c`` are token counts, ``N_k(. w)`` the numbers of different words before w in class k (continuation counts), M_k(s) and
S(s) sums of N_k and S over the words longer than ``STEM`` that begin with the stem s. ``S`` is the backoff that both classes
share; x' is max(x - D, 0) of told expressions and 0 of others, and ``rest(v)``, ``rest`` and ``left`` are what the discounted counts of
both classes together leave: the backoff's weights are shared too (a class without told expressions has weight 1).

A word, pair or stem is told if the numbers of texts of either class that hold it differ beyond chance (``SIGMAS``) and by a
factor (``TIMES``), in ``ROWS`` texts at least: else the words of a language in which fewer texts are toxic would count against
each text in it. These texts must be of ``KINDS`` kinds at least, a kind being those whose least sentence by hash is the same, as
most near copies have. What isn't told, all rare expressions among it, leaves its whole mass to the backoff, so rare words
speak through their stems only and others add a constant. Each model sums to 1 over words, end and unseen words together.

Counts cover every labelled training row of different text (copies would count one writer's words again). A task counts
its pairs by hash (64 bits) and sends one packed block to each bucket; a bucket is one hash range of words, and words
that are frequent in a sample are dealt by pair instead, so a hot word is spread. The sample places rows and decides no
count. The model's entries grow with the corpus: it is broadcast in slices of ``MOST``, more slices taking more passes.

The difference becomes a probability by a logistic regression on it and the length, fitted on at most about
``CALIBRATION`` rows of a fold of the training texts with a model that leaves this fold out; all rows make the model that
scores. Texts of one kind share a fold.

Training rows are those whose crc32 of the id as text, modulo ``FOLDS``, is not 0. Scores depend on the text alone.

Defined results: null and empty texts score as a text of no words; without labelled rows of both classes every score is
0; several labels of one document count as toxic if any is; documents without an id, or with a repeated one, are scored
as others; ties and columns with the names used here make no difference.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, few_or_not, free_name, materialised, release, short_batches

WORD = re.compile(r"[^\W\d_]+")
D, FOLDS = 0.75, 5
#: Deviations from chance, and times as common in a class, that tell the classes apart; texts that a word and a pair need.
SIGMAS, TIMES, ROWS, PAIR_ROWS = 4.0, 2.0, 3, 5
#: Kinds of texts, by their least sentence, that must hold what is told; kinds are told apart by so many bits.
KINDS, BITS = 3, 16
#: Letters of a stem, and different words that a told one begins.
STEM, TYPES = 4, 3
#: Entries of a slice of the broadcast model, about (some 30 bytes each); training rows of the regression.
MOST, CALIBRATION = 1_000_000, 20_000
#: Pairs that a task holds before it sends them; pairs of a block; pairs of a bucket, about; words that a worker knows.
HELD, BLOCK, BUCKET, KNOWN = 1_000_000, 2_048, 500_000, 120_000
#: Texts of the sample that finds frequent words; a word is dealt by pair if it is more than this share of a bucket.
SAMPLE, SHARE = 2_000, 0.1
#: Hashes of the symbols for a text's start and end; words' hashes end in 4 to 7. MARK ends the hash of a word's stem (0: none)
#: in the entry that counts the word's texts.
START, END, MARK = 1, 3, 2


def training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, toxic, fold, kind) of the labelled rows outside the held-out fold, one for each different text: toxic if any row of the text is."""
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("_label_id").cast("string")) % FOLDS != 0)
    sentences = F.filter(F.split(F.col(text_col), "[.\n]+"), lambda x: F.length(x) > 20)
    like = F.coalesce(F.array_min(F.transform(sentences, lambda x: F.xxhash64(x))), F.xxhash64(text_col))
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.pmod(F.xxhash64(like), F.lit(FOLDS)).alias("fold"), F.pmod(like, F.lit(BITS)).cast("int").alias("kind"))
    first = hashed.join(few_or_not(known), F.col("id") == F.col("_label_id")).groupBy("h").agg(F.min(F.struct("id", "fold", "kind")).alias("x"), F.max("toxic").alias("toxic"))
    first = first.select(F.col("x.id").alias("_label_id"), F.col("h").alias("_h"), "toxic", "x.fold", "x.kind")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return rows.join(few_or_not(first), (F.col("id") == F.col("_label_id")) & (F.col("h") == F.col("_h"))).select("id", "text", "toxic", "fold", "kind")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hash_of(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 4  # no symbol


def stem_of(word: str) -> int:
    """The hash of the word's stem; 0 if it is too short for one."""
    return hash_of(word[:STEM] + "-") & ~7 if len(word) > STEM else 0


class Known(dict):
    """Word -> number, for the words met since it was last emptied; ``hashes`` and ``stems`` by number."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = [START, END]
        self.stems: list[int] = [0, 0]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(hash_of(word))
        self.stems.append(stem_of(word))
        return n

    def forget(self) -> None:
        self.clear()
        del self.hashes[2:], self.stems[2:]


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = (v * np.uint64(0x9E3779B97F4A7C15) + w) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def apart(t, o, p: float, absolute=np.abs, root=np.sqrt):
    """Whether t toxic of t + o texts are too far from the share ``p`` for chance, and the rates ``TIMES`` apart."""
    expected, odds = (t + o) * p, (1 - p) / p
    return (absolute(t - expected) >= SIGMAS * root(expected * (1 - p))) & ((t * odds >= TIMES * o) | (o >= TIMES * odds * t))


class Often:
    """Words and stems that are frequent in a sample: their entries are dealt out. Decides where entries go, and no count."""

    def __init__(self, words: list[str], stems: list[int]):
        made = sorted({(hash_of(w), stem_of(w)) for w in words} | {(END, 0)})
        self.words, self.word_stems = (np.array([x[i] for x in made], np.uint64) for i in (0, 1))
        self.stems = np.unique(np.array([*stems, *(x[1] for x in made)], np.uint64))

    def bucket(self, v: np.ndarray, w: np.ndarray, stem: np.ndarray, buckets: int) -> np.ndarray:
        """That of the stem, of the word if its stem is frequent (or it has none), and of the pair if the word is."""
        by = np.where(np.isin(stem, self.stems), w, stem)
        return mixed(np.where(np.isin(w, self.words), v, np.uint64(0)), by) % np.uint64(buckets)


def frequent(train: DataFrame, n: int, share: float) -> Often:
    """The words and stems that make up more than ``share`` of the words of a sample of the ``n`` texts."""
    few = train.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < int(1e6 * min(1.0, SAMPLE / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words = words_of(text)
                seen.update(words)
                seen.update(w[:STEM] + "-" for w in words if len(w) > STEM)
                seen[""] += len(words)
        least = share / 4 * seen[""]
        top = [(w, k) for w, k in seen.items() if k > least or not w]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], names=["word", "n"])

    found = few.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most 8 / share a task
    total = sum(r.n for r in found if not r.word)
    top = [r.word for r in found if r.word and r.n > share * total]
    return Often([w for w in top if w[-1] != "-"], [stem_of(w) for w in top if w[-1] == "-"])


#: Stands for the word before, where a word is counted alone.
ALONE = 0x7FFFFFFF
ENTRY = np.dtype([("w", "<u8"), ("v", "<u8"), ("part", "u1"), ("tokens", "<i4"), ("texts", "<i4"), ("kinds", "<u2")])


def blocks(train: DataFrame, buckets: int, often: Often) -> DataFrame:
    """(bucket, data): packed entries (w, v, class and fold, tokens, texts, their kinds' bits) of all pairs v w, and of words with ``MARK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, counts, parts, bits, held = Known(), [], [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, tokens, n = np.concatenate(keys), np.concatenate(counts), [len(k) for k in keys]
            part, kinds = np.repeat(np.array(parts, np.uint8), n), np.repeat(np.array(bits, np.uint16), n)
            order = np.lexsort((part, key))
            key, part, tokens, kinds = (x[order] for x in (key, part, tokens, kinds))
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            e = np.zeros(len(cut), ENTRY)
            hashes, stems = np.array(known.hashes, np.uint64), np.array(known.stems, np.uint64)
            head, word = key[cut] >> 32, key[cut] & 0xFFFFFFFF
            e["w"] = hashes[word]
            e["v"] = np.where(head < len(hashes), hashes[np.minimum(head, len(hashes) - 1)], stems[word] | np.uint64(MARK))
            e["part"], e["tokens"], e["texts"] = part[cut], np.add.reduceat(tokens, cut), np.diff(np.r_[cut, len(key)])
            e["kinds"] = np.bitwise_or.reduceat(kinds, cut)
            by = often.bucket(e["v"], e["w"], stems[word], buckets)
            order = np.lexsort((e["w"], by))
            e, by = e[order], by[order]
            edges = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            for a, z in zip(edges, np.r_[edges[1:], len(e)], strict=True):
                own = [e[i : min(i + BLOCK, z)] for i in range(a, z, BLOCK)]
                # column by column, so that what repeats compresses
                data = [b"".join(np.ascontiguousarray(x[f]).tobytes() for f in ENTRY.names) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([int(by[a])] * len(own), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

        for b in batches:
            for text, label, fold, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                every = np.concatenate(((np.r_[0, ids] << 32) | np.r_[ids, 1], (ALONE << 32) | ids))
                key, n = np.unique(every, return_counts=True)
                keys.append(key)
                counts.append(n)
                parts.append(2 * bool(label) + (fold == 0))
                bits.append(1 << kind)
                held += len(key)
                if held > HELD or len(known) > KNOWN:
                    yield from out()
                    known.forget()
                    keys, counts, parts, bits, held = [], [], [], [], 0
        if held:
            yield from out()
        del keys, counts, parts, bits, known
        release()

    short_batches(train.sparkSession)
    return train.select("text", "toxic", "fold", "kind").mapInArrow(run, "bucket int, data binary")


def unpacked(data: bytes) -> np.ndarray:
    n, at = len(data) // ENTRY.itemsize, 0
    out = np.empty(n, ENTRY)
    for name in ENTRY.names:
        kind = ENTRY.fields[name][0]
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


GRAMS = "whole boolean, kind int, w bigint, v bigint, t bigint, o bigint, nt bigint, no bigint, rt bigint, ro bigint, kinds bigint"


def grams(packed: DataFrame, often: Often, share: dict[bool, float]) -> DataFrame:
    """Of all counts (``whole``) and of those without fold 0: kind 0, totals of a bucket; 1, words; 2, told pairs; 4, stems.

    v is the word before of a pair, and a word's stem (0: none); stems have the number of their different words in t.

    t, o: tokens of either class; nt, no: continuation counts; rt, ro: texts; kinds: bits of their kinds. Totals have the numbers of different
    pairs in nt and no, and of different words in t. Frequent words and stems come in parts, one for each bucket.
    ``share``: the toxic texts' share of all.
    """
    kinds = [pa.bool_(), pa.int32(), *[pa.int64()] * 9]
    names = [x.split()[0] for x in GRAMS.split(", ")]

    def solved(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(parts)
        e = e[np.lexsort((e["v"], e["w"]))]
        cut = np.flatnonzero(np.r_[True, (e["w"][1:] != e["w"][:-1]) | (e["v"][1:] != e["v"][:-1])])
        w, v = e["w"][cut], e["v"][cut]
        word = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        alone = v & np.uint64(7) == MARK
        by = {(f, p): np.add.reduceat(np.where(e["part"] == p, e[f], 0).astype(np.int64), cut) for f in ("tokens", "texts") for p in range(4)}
        stem = np.maximum.reduceat(np.where(alone, v & ~np.uint64(7), np.uint64(0)), word)
        split = np.isin(w[word], often.words)  # the mark may be in another bucket
        stem[split] = often.word_stems[np.searchsorted(often.words, w[word][split])]
        in_kinds = np.bitwise_or.reduceat(e["kinds"], cut).astype(np.int64)
        of_kinds = np.bitwise_or.reduceat(np.where(alone, in_kinds, 0), word)
        sums = lambda x: np.add.reduceat(x, word)
        for whole, p in share.items():
            t, o, rt, ro = (by[f, k] + (by[f, k + 1] if whole else 0) for f in ("tokens", "texts") for k in (2, 0))
            nt, no, wt, wo = sums(~alone & (t > 0)), sums(~alone & (o > 0)), sums(np.where(alone, rt, 0)), sums(np.where(alone, ro, 0))
            of_word = [w[word], stem, sums(np.where(alone, 0, t)), sums(np.where(alone, 0, o)), nt, no, wt, wo, of_kinds]
            order = np.argsort(stem, kind="stable")
            first = np.flatnonzero(np.r_[True, stem[order][1:] != stem[order][:-1]])
            of_stem = [np.add.reduceat(x[order], first) for x in ((wt + wo > 0).astype(np.int64), np.zeros_like(wt), nt, no, wt, wo)]
            of_stem = [(of := stem[order][first]), np.zeros_like(of), *of_stem, np.bitwise_or.reduceat(of_kinds[order], first)]
            some = (of > 0) & (np.isin(of, often.stems) | (of_stem[2] >= TYPES) & apart(of_stem[6], of_stem[7], p))
            enough = (wt + wo >= ROWS) | split
            two = ~alone & (rt + ro >= PAIR_ROWS) & apart(rt, ro, p) & (np.bitwise_count(in_kinds) >= KINDS)
            zero = np.zeros(1, np.int64)
            rows = [
                (0, [zero, zero, np.array([(alone & (rt + ro > 0)).sum()]), zero, nt.sum(keepdims=True), no.sum(keepdims=True), zero, zero, zero]),
                (1, [x[enough] for x in of_word]),
                (2, [x[two] for x in (w, v, t, o, np.zeros_like(t), np.zeros_like(t), rt, ro, in_kinds)]),
                (4, [x[some] for x in of_stem]),
            ]
            for kind, columns in rows:
                n = len(columns[0])
                made = [np.full(n, whole), np.full(n, kind), *(np.ascontiguousarray(c).view(np.int64) for c in columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield from solved(held)
                    held = []
                at = bucket
                held.append(unpacked(data))
        if held:
            yield from solved(held)
        del held
        release()

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, GRAMS)


def count(train: DataFrame) -> tuple[DataFrame, dict[bool, tuple[int, int]]]:
    """The grams of all training rows, and the numbers of toxic and ordinary texts, of all and without fold 0."""
    sums = train.groupBy("toxic", "fold").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # a few rows
    texts = {whole: tuple(sum(r.n for r in sums if bool(r.toxic) == k and (whole or r.fold)) for k in (True, False)) for whole in (True, False)}
    buckets = max(64, -(-sum(r["size"] or 0 for r in sums) // (6 * BUCKET)))
    often = frequent(train, sum(texts[True]), SHARE / buckets)
    share = {whole: t / (t + o) for whole, (t, o) in texts.items() if t and o}
    return materialised(grams(blocks(train, buckets, often), often, share), "grams"), texts


def model(found: DataFrame, texts: tuple[int, int], whole: bool) -> tuple[DataFrame, float]:
    """(kind, w, v, value): what words (1: w), pairs (2), heads, the words before told pairs (3: v), and stems (4: w) add;
    and the constant of every word.

    A pair's value replaces its word's and its head's, a word's its stem's: what is replaced is taken off here, so values
    only add up and any part of the model can be summed on its own.
    """
    own = found.where(F.col("whole") == whole)
    total = own.where("kind = 0").agg(F.sum("nt").alias("nt"), F.sum("no").alias("no"), F.sum("t").alias("types")).first()
    nt, no = float(total.nt), float(total.no)
    p, both = texts[0] / sum(texts), F.col("rt") + F.col("ro")
    told = (both >= ROWS) & (F.bit_count("kinds") >= KINDS) & apart(F.col("rt"), F.col("ro"), p, F.abs, F.sqrt)
    above = lambda x: F.greatest(x - D, F.lit(0.0))
    over = lambda df, *columns: [float(x or 0) for x in df.agg(*map(F.sum, columns)).first()]
    summed = lambda kind, *keys: own.where(F.col("kind") == kind).groupBy(*keys).agg(*(F.sum(x).alias(x) for x in ("t", "o", "nt", "no", "rt", "ro")), F.bit_or("kinds").alias("kinds"))

    stems = materialised(summed(4, "w").where(told & (F.col("t") >= TYPES)).withColumnRenamed("w", "stem"), "stems")
    words = summed(1, "w", "v").withColumnRenamed("v", "stem").withColumn("told", told)
    words = materialised(words.join(stems.select("stem", F.lit(True).alias("stemmed")), "stem", "left").withColumn("stemmed", F.coalesce("stemmed", F.lit(False))), "words")
    n_t, n_o, n = F.col("nt"), F.col("no"), F.col("nt") + F.col("no")
    stem_t, stem_o, first, once = over(stems, above(n_t), above(n_o), above(n), n)
    left = 1 - first / (nt + no)
    word_t, word_o, first, once_too = over(words.where("told"), above(n_t), above(n_o), above(n), F.when(~F.col("stemmed"), n))
    rest = 1 - first / (nt + no)
    left_t, left_o, rest_t, rest_o = (weight if some else 1.0 for weight, some in ((left, stem_t), (left, stem_o), (rest, word_t), (rest, word_o)))
    every = nt + no + total.types + 2 - once - once_too  # the end and the unseen words count one each
    share = F.col("t") / every  # of the stem's words, each counted once, in S
    by = lambda x, total, weight: above(x) * ((1 - weight) / max(total, 1.0))
    stems = stems.select("stem", (by(n_t, stem_t, left_t) / share + left_t).alias("st"), (by(n_o, stem_o, left_o) / share + left_o).alias("so"))
    stems = stems.withColumn("of_stem", F.log(F.col("st") / F.col("so")) - float(np.log(left_t / left_o)))

    constant = float(np.log(rest_t * left_t / (rest_o * left_o)))
    words = words.join(stems, "stem", "left")
    shared = F.when(F.col("told") | F.col("stemmed"), F.lit(1)).otherwise(n + 1) / every
    plain = lambda first, rest, back, left: F.when(F.col("told"), first).otherwise(0.0) + rest * shared * F.coalesce(back, F.lit(left))
    words = words.withColumn("ut", plain(by(n_t, word_t, rest_t), rest_t, F.col("st"), left_t)).withColumn("uo", plain(by(n_o, word_o, rest_o), rest_o, F.col("so"), left_o))
    words = words.withColumn("value", F.log(F.col("ut") / F.col("uo")) - constant).select("w", "t", "o", "told", "ut", "uo", "value", (F.col("value") - F.coalesce("of_stem", F.lit(0.0))).alias("more"))
    words = materialised(words, "words")

    # told pairs, and what they leave of their head's mass
    start = words.sparkSession.createDataFrame([(START, *texts)], "v bigint, ht bigint, ho bigint")
    heads = words.select(F.col("w").alias("v"), F.col("t").alias("ht"), F.col("o").alias("ho")).unionByName(start)
    pairs = own.where("kind = 2").select("v", "w", F.col("t").alias("ct"), F.col("o").alias("co")).join(heads, "v")
    pairs = materialised(pairs.select("v", "w", above(F.col("ct")).alias("et"), above(F.col("co")).alias("eo"), (above(F.col("ct") + F.col("co")) / (F.col("ht") + F.col("ho"))).alias("e")), "pairs")
    left = pairs.groupBy("v").agg(F.sum("et").alias("at"), F.sum("eo").alias("ao"), (1 - F.sum("e")).alias("l"))
    left = left.select("v", "at", "ao", F.when(F.col("at") > 0, F.col("l")).otherwise(1.0).alias("lt"), F.when(F.col("ao") > 0, F.col("l")).otherwise(1.0).alias("lo"))
    left = left.withColumn("head", F.log(F.col("lt") / F.col("lo")))
    part = lambda e, a, weight: F.col(e) * (1 - F.col(weight)) / F.greatest(F.col(a), F.lit(D / 9))
    ratio = F.log((part("et", "at", "lt") + F.col("lt") * F.col("ut")) / (part("eo", "ao", "lo") + F.col("lo") * F.col("uo")))
    two = pairs.join(left, "v").join(words.select("w", "ut", "uo", "value"), "w")

    none = F.lit(0).cast("bigint").alias
    entries = [
        words.where("told").select(F.lit(1).alias("kind"), "w", none("v"), F.col("more").alias("value")),
        two.select(F.lit(2).alias("kind"), "w", "v", (ratio - constant - F.col("value") - F.col("head")).alias("value")),
        left.select(F.lit(3).alias("kind"), none("w"), "v", F.col("head").alias("value")),
        stems.select(F.lit(4).alias("kind"), F.col("stem").alias("w"), none("v"), F.col("of_stem").alias("value")),
    ]
    return materialised(reduce(DataFrame.unionByName, entries), "model"), constant


class Part:
    """A slice of the model: for each kind the sorted hashes, and their values."""

    def __init__(self, rows):
        made: dict[int, list] = {1: [], 2: [], 3: [], 4: []}
        for r in rows:
            made[r.kind].append((r.w if r.kind != 3 else r.v, r.v, r.value))
        self.of = {}
        for kind, own in made.items():
            a = np.array([x[0] for x in own], np.int64).view(np.uint64)
            if kind == 2:
                a = mixed(np.array([x[1] for x in own], np.int64).view(np.uint64), a)
            order = np.argsort(a)
            self.of[kind] = a[order], np.array([x[2] for x in own], float)[order]

    def values(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        keys, values = self.of[kind]
        if not len(keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], 0.0)


class Reader:
    """Sums of a text's values by a slice of the model; keeps what it looked up for words that come again."""

    def __init__(self, part: Part):
        self.part, self.known = part, Known()
        self.hash, self.word, self.head = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def look_up(self) -> None:
        at = len(self.hash)
        new, stems = np.array(self.known.hashes[at:], np.uint64), np.array(self.known.stems[at:], np.uint64)
        values = self.part.values
        self.hash = np.concatenate((self.hash, new))
        self.word = np.concatenate((self.word, values(1, new) + values(4, stems)))
        self.head = np.concatenate((self.head, values(3, new)))

    def total(self, text: str | None) -> tuple[float, int]:
        """The sum over the text's words and its end, and their number."""
        if len(self.known) > KNOWN:
            self.known.forget()
            self.hash, self.word, self.head = self.hash[:0], self.word[:0], self.head[:0]
        words = words_of(text)
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known.hashes) > len(self.hash):
            self.look_up()
        v, w = np.r_[0, ids], np.r_[ids, 1]
        total = float(self.word[w].sum() + self.head[v].sum())
        if len(self.part.of[2][0]):
            total += float(self.part.values(2, mixed(self.hash[v], self.hash[w])).sum())
        return total, len(w)


def compared(docs: DataFrame, text_col: str, entries: DataFrame, total: str, size: str) -> DataFrame:
    """``docs`` with the difference of the log-likelihoods but for the constant, and the number of words and ends.

    A model of more than ``MOST`` entries is broadcast in slices, one at a time, each summed over all different texts.
    """
    spark = docs.sparkSession
    slices = max(1, -(-entries.count() // MOST))

    def summed(df: DataFrame, i: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(Part(entries.where(F.pmod(F.xxhash64("w", "v"), F.lit(slices)) == i).toLocalIterator()))

        def start():
            reader = Reader(sent.value)
            return lambda texts: tuple(zip(*(reader.total(x) for x in texts), strict=True)) if texts else ([], [])

        return append(df, text_col, [(total, "double"), (size, "bigint")], start)

    if slices == 1:
        return summed(docs, 0)
    key = free_name(docs, "_text_hash")
    texts = docs.select(F.xxhash64(text_col).alias(key), text_col)
    sums = [materialised(summed(texts, i).groupBy(key).agg(F.max(total).alias(total), F.max(size).alias(size)), "sums") for i in range(slices)]
    every = reduce(DataFrame.unionByName, sums).groupBy(key).agg(F.sum(total).alias(total), F.max(size).alias(size))
    return docs.withColumn(key, F.xxhash64(text_col)).join(every, key).select(*docs.columns, total, size)


def terms(total, n, centre: float, root, log1p, least):
    """The length-normalised difference: itself, by the root of the length and by the length (bounded); and the length."""
    mean = total / n - centre
    return [10 * mean, mean * root(n), least(total) / 5, log1p(n) / 3]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a toxicity score between 0 and 1 (column ``name``)."""
    train = training(docs, labels, id_col, text_col)
    found, texts = count(train)
    if not all(texts[False]):
        return docs.withColumn(name, F.lit(0.0))
    entries, _ = model(found, texts[False], False)
    unseen = sum(texts[True]) - sum(texts[False])
    few = train.where(F.col("fold") == 0).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * min(1.0, CALIBRATION / max(unseen, 1))))
    rows = compared(few, "text", entries, "total", "n").select("total", "n", "toxic").collect()
    if not rows:
        return docs.withColumn(name, F.lit(0.0))
    total, n, y = (np.array([r[i] for r in rows], float) for i in range(3))
    centre = float(np.median((total / n)[y == 0])) if (y == 0).any() else 0.0
    x = np.stack([np.ones(len(y)), *terms(total, n, centre, np.sqrt, np.log1p, lambda x: np.clip(x, -20, 40))], axis=1)
    weights = logistic(x, (y > 0).astype(float)).tolist()
    # the regression is fitted on texts that its counts leave out; what scores counts all of them
    entries, _ = model(found, texts[True], True)
    total_col, n_col = free_name(docs, "_total"), free_name(docs, "_n")
    columns = terms(F.col(total_col), F.col(n_col), centre, F.sqrt, F.log1p, lambda x: F.greatest(F.lit(-20.0), F.least(F.lit(40.0), x)))
    z: Column = sum((w * c for w, c in zip(weights[1:], columns, strict=True)), F.lit(weights[0]))
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))
    return compared(docs, text_col, entries, total_col, n_col).select(*docs.columns, score.alias(name))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold; the columns of ``docs``."""
    name = free_name(docs, "_toxic")
    return scored(docs, labels, id_col, text_col, name).where(F.col(name) < threshold).select(*docs.columns)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
