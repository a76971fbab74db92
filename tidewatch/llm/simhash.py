"""SimHash near-duplicates: bit-sliced comparison of fingerprints within exact candidate buckets.

A fingerprint has a bit for each of the 64 of its shingles' XXH64, set if over half of the shingles set it. Equal
fingerprints are one class. Two classes are linked if at most ``RADIUS`` bits differ: then at least one of RADIUS + 1
bands of the fingerprint is equal, so each class goes to one bucket for each band and no link can be missed.

Within sorted buckets the fingerprints are stored vertically, one bit plane of 64 lanes a word. Row i is compared with
row i + d for all i at once: planes are combined with themselves shifted by d lanes, the differing bits of each lane
are added in carry-save counters, and words whose lanes have all exceeded the radius (or lie in other buckets) are
abandoned. Buckets of many classes are split again by the bits that their members need not share, by the same pigeonhole,
in the shuffle (``HOT``) and within a task (``LARGE``), so a hot bucket is neither one task nor quadratic.

A bucket gives a star of links for each group of linked classes rather than all its pairs.

A radius of 3 of 64 bits is far too narrow for copies that share but 0.8 of their shingles. ``near_texts``, which the
pipeline uses, has fingerprints of 256 bits over the different five-word shingles, of which some 39 differ at that similarity, and
a radius of ``WIDE``, which all but about one in 10 000 of such pairs meet (one in 200 of texts of some five shingles). Its
buckets are bands of minima over the shingles' hashes. In each bucket all members are compared with a lead in the same
bit-sliced way, the lead being the member nearest to the majority of the bucket's bits, as a text is whose edited copies the others
are. What is beyond the radius is abandoned and gets a lead of its own; what is within it is linked if the sets of
shingles, compared exactly, share ``SIMILAR`` or more. What isn't is compared exactly with the others of its bucket that
aren't, the leads among them being taken one after the other.

Defined results: null, empty and blank texts have fingerprint zero (no shingles), which links like any other; fewer words than a
shingle give one shingle of all words; repeated rows share a class; an empty table gives an empty result. Rows that share
an id, but not a class, are documents of their own. Deduplication keeps rows without an id as they are; of
a group's rows with the smallest id and equal texts it keeps the one whose columns have the least hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append, connected_components, few_or_not, free_name, materialised, short_batches

RADIUS, BITS, SHINGLE, SEED = 3, 64, 3, 42
#: Classes of a bucket beyond which it is split in the shuffle; and within a task.
HOT, LARGE = 65_536, 4_096
STEP = 1 << 16
#: Near texts: words of a shingle, the Jaccard similarity that links, and bands of so many minima each: two texts of that
#: similarity share one with a probability of 1 - (1 - 0.8 ** 5) ** 16 = 0.998.
WORDS, SIMILAR, MIN_BANDS, MINIMA = 5, 0.8, 16, 5
#: Words of 64 bits of a wide fingerprint, and its radius.
LANES, WIDE = 4, 64
#: Rows of a band that are compared together at least, where there are so many; pairs of a lead that one task verifies;
#: members of a bucket that are compared exactly in one task.
TOGETHER, PAIRS, EXACT = 1 << 14, 2_048, 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit integer."""
    from xxhash import xxh64_intdigest as xxh

    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: only A-Z
    words, total, counts = data.split(), 0, np.zeros(BITS, np.int64)
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    for at in range(0, n, STEP):
        part = words[at : min(at + STEP, n) + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxh(x, seed) for x in joined], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def planes(fps: np.ndarray, pad: int) -> np.ndarray:
    """Bit planes: plane k has bit k of row i at lane i % 64 of word i // 64; pad more words of zeros."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = -(-len(fps) // 64) + pad
    out = np.zeros((BITS, words * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def near_lanes(p: np.ndarray, d: int, valid: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of the rows i in ``valid`` (packed as planes), those within the radius (at most 3) of row i + d."""
    assert 0 <= radius <= 3
    skip, shift = divmod(d, 64)
    alive = np.flatnonzero(valid)
    one = np.zeros(len(alive), np.uint64)
    two, over, live = one.copy(), one.copy(), valid[alive]
    s, back = np.uint64(shift), np.uint64(64 - shift)

    def differ(k: int) -> np.ndarray:
        row = p[k]
        far = row[alive + skip]
        if shift:
            far = (far >> s) | (row[alive + skip + 1] << back)
        return row[alive] ^ far

    for k in range(0, BITS - 1, 3):
        a, b, c = differ(k), differ(k + 1), differ(k + 2)
        ab = a ^ b
        low, high = ab ^ c, (a & b) | (ab & c)  # a full adder of three planes
        carry = one & low
        one ^= low
        over |= two & high
        two ^= high
        over |= two & carry
        two ^= carry
        keep = (live & ~over) != 0
        if not keep.any():
            return np.zeros(0, np.int64)
        if k % 9 == 6 and keep.mean() < 0.75:
            alive, one, two, over, live = alive[keep], one[keep], two[keep], over[keep], live[keep]
    last = differ(BITS - 1)
    carry = one & last
    one ^= last
    over |= two & carry
    two ^= carry
    if radius < 3:
        over |= two if radius == 0 else two & one if radius == 2 else two
        over |= one if radius == 0 else np.uint64(0)
    lanes = np.unpackbits((live & ~over).view(np.uint8), bitorder="little")
    at = np.flatnonzero(lanes)
    return alive[at // 64] * 64 + at % 64


def links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars (root's row, row) that join the linked rows of each group. Rows of a group are adjacent; fps: uint64."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    left = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows to the end of the group, itself included
    most = int(sizes.max(initial=0))
    root = np.arange(n)
    p = planes(fps, most // 64 + 2)
    words = -(-n // 64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for d in range(1, most):
        bits = np.packbits(left > d, bitorder="little")
        valid = np.zeros(words * 8, np.uint8)
        valid[: len(bits)] = bits
        i = near_lanes(p, d, valid.view(np.uint64), radius)
        if len(i) and len(i := i[root[i] != root[i + d]]):
            for x in i.tolist():
                a, b = find(x), find(x + d)
                if a != b:
                    root[max(a, b)] = min(a, b)
            while (root[root] != root).any():
                root = root[root]
    rows = np.flatnonzero(root != np.arange(n))
    return root[rows], rows


def bands(free: tuple[tuple[int, int], ...], n: int) -> list[tuple[tuple[int, int], ...]]:
    """The bits (ranges: first, past the last) dealt out to n bands."""
    bits = [b for a, z in free for b in range(a, z)]
    cut = [round(i * len(bits) / n) for i in range(n + 1)]
    out = []
    for a, z in zip(cut, cut[1:], strict=False):
        ranges: list[list[int]] = []
        for b in bits[a:z]:
            if ranges and ranges[-1][1] == b:
                ranges[-1][1] = b + 1
            else:
                ranges.append([b, b + 1])
        out.append(tuple((a, z) for a, z in ranges))
    return out


def bits_of(fps: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for a, z in ranges:
        out = (out << np.uint64(z - a)) | ((fps >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1))
    return out


def bucket_links(fps: np.ndarray, group: np.ndarray, free: tuple[tuple[int, int], ...], radius: int = RADIUS, large: int = LARGE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As links(), but groups of over ``large`` rows are split by their free bits first."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fps)])
    big = sizes > large if sum(z - a for a, z in free) > 2 * (radius + 1) else np.zeros(len(sizes), bool)
    small = np.repeat(~big & (sizes > 1), sizes)
    if small.any():
        rows = np.flatnonzero(small)
        a, b = links(fps[rows], group[rows], radius)
        yield rows[a], rows[b]
    for at, size in zip(starts[big], sizes[big], strict=True):
        part = fps[at : at + size]
        for band in bands(free, radius + 1):
            key = bits_of(part, band)
            order = np.argsort(key, kind="stable")
            taken = {b for a, z in band for b in range(a, z)}
            rest = bands(tuple((b, b + 1) for a, z in free for b in range(a, z) if b not in taken), 1)[0]
            for a, b in bucket_links(part[order], key[order], rest, radius, large):
                yield at + order[a], at + order[b]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The sorted rows' columns in larger parts, none of which ends within a group of the first ``keys`` columns."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([np.asarray(c) for c in b.columns])
        n += b.num_rows
        if n < TOGETHER:
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0))
        if len(edge):
            last = int(edge[-1]) + 1
            yield [c[:last] for c in columns]
            columns = [c[last:] for c in columns]
        held, n = [columns], len(columns[0]) if len(edge) else n // 2  # a group that goes on is joined again when it has doubled
    if held and sum(len(x[0]) for x in held):
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def near_stars(classes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b): stars that connect the fingerprints (fp) linked directly or through others of a bucket."""
    cut = bands(((0, BITS),), radius + 1)
    mask = lambda f, r: F.shiftrightunsigned(f, r[0][0]).bitwiseAND(F.lit((1 << (r[0][1] - r[0][0])) - 1))
    wide = classes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), mask("fp", r).alias("key")) for i, r in enumerate(cut)))).alias("x")).select("fp", "x.band", "x.key")
    heavy = [(r.band, r.key) for r in wide.groupBy("band", "key").count().where(F.col("count") > hot).collect()]  # fewer than rows / hot
    none = F.struct(F.lit(0).alias("sub"), F.lit(0).cast("bigint").alias("subkey"))
    wide = wide.withColumn("y", none)
    if heavy:
        again = {i: bands(tuple(x for j, r in enumerate(cut) if j != i for x in r), radius + 1) for i in range(radius + 1)}
        spark = classes.sparkSession
        marks = F.broadcast(spark.createDataFrame(heavy, "band int, key bigint").withColumn("heavy", F.lit(True)))

        def packed(ranges):
            out = F.lit(0).cast("bigint")
            for a, z in ranges:
                out = F.shiftleft(out, z - a).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (z - a)) - 1)))
            return out

        sub = F.when(F.lit(False), F.array(none))
        for i, parts in again.items():
            sub = sub.when((F.col("band") == i) & F.col("heavy"), F.array(*(F.struct(F.lit(j + 1).alias("sub"), packed(r).alias("subkey")) for j, r in enumerate(parts))))
        wide = wide.drop("y").join(marks, ["band", "key"], "left").withColumn("y", F.explode(sub.otherwise(F.array(none))))
    wide = wide.select("band", "key", "y.sub", "y.subkey", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(*keys, fps):
            for band in np.unique(keys[0]):
                for sub in np.unique(keys[2]):
                    at = np.flatnonzero((keys[0] == band) & (keys[2] == sub))
                    if not len(at):
                        continue
                    used = {b for a, z in cut[band] for b in range(a, z)}
                    rest = tuple((b, b + 1) for b in range(BITS) if b not in used)
                    if sub:
                        used |= {b for a, z in bands(rest, radius + 1)[sub - 1] for b in range(a, z)}
                        rest = tuple((b, b + 1) for b in range(BITS) if b not in used)
                    group = np.cumsum(np.r_[0, (keys[1][at][1:] != keys[1][at][:-1]) | (keys[3][at][1:] != keys[3][at][:-1])])
                    for a, b in bucket_links(fps[at], group, rest, radius):
                        yield pa.RecordBatch.from_arrays([pa.array(fps[at[a]].view(np.int64)), pa.array(fps[at[b]].view(np.int64))], names=["a", "b"])

        for *keys, fps in whole_groups(batches, 4):
            yield from solve(*keys, fps=fps.view(np.uint64))

    sorted_ = wide.repartition("band", "key", "sub", "subkey").sortWithinPartitions("band", "key", "sub", "subkey", "fp")
    return sorted_.mapInArrow(run, "a bigint, b bigint")


def fingerprinted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """(id, fp, low): the fingerprint of each row, and the smallest id of its group."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = append(narrow, "text", [("fp", "bigint")], lambda: lambda texts: [[fingerprint(x, shingle) for x in texts]]).select("id", "fp")
    fps = materialised(fps, "fingerprints")
    classes = materialised(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    return fps.join(lowest(classes, "fp", near_stars(classes, radius)), "fp").select("id", "fp", "low")


def lowest(classes: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """(key, group, low): the group of the classes that links (a, b: keys) join, and its smallest id (rep)."""
    of = materialised(connected_components(links).withColumnRenamed("node", key), "components")
    low = of.join(classes, key).groupBy("component").agg(F.min("rep").alias("low"))
    return classes.join(of, key, "left").join(low, "component", "left").select(key, F.coalesce("component", key).alias("group"), F.coalesce("low", "rep").alias("low"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fp: bigint, component_id): the smallest id reachable by links, itself included."""
    found = fingerprinted(docs, id_col, text_col, shingle, radius)
    return found.select(F.col("id").alias(id_col), "fp", F.col("low").alias("component_id"))


def _first_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``groups``: (id, h: hash of the text, group) of the rows with an id."""
    first = groups.groupBy("group").agg(F.min(F.struct("id", "h")).alias("x")).select("group", F.col("x.id").alias("first"), F.col("x.h").alias("first_h"))
    of = materialised(groups.join(first, "group").groupBy("id", "h").agg(F.count("*").alias("n"), F.min((F.col("id") == F.col("first")) & (F.col("h") == F.col("first_h"))).alias("stays")), "first")
    mark, key = free_name(docs, "_mark"), free_name(docs, "_h")
    rows = docs.withColumn(key, F.xxhash64(text_col))
    on = lambda x: (F.col(id_col) == F.col("id_")) & (F.col(key) == F.col("h_"))
    these = lambda x: few_or_not(x.select(F.col("id").alias("id_"), F.col("h").alias("h_")))
    stay = rows.join(these(of.where("not stays")), on(of), "left_anti")
    again = of.where("stays and n > 1")
    if again.limit(1).count():  # repeated rows
        again = these(again)
        one = Window.partitionBy(id_col, key).orderBy(F.xxhash64(*docs.columns))
        repeated = stay.join(again, on(of), "left_semi").withColumn(mark, F.row_number().over(one)).where(F.col(mark) == 1).drop(mark)
        stay = stay.join(again, on(of), "left_anti").unionByName(repeated)
    return stay.select(*docs.columns)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each group stays: that with the smallest id, once. The columns of ``docs``."""
    own = docs.where(F.col(id_col).isNotNull())
    narrow = own.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    fps = append(narrow, "text", [("fp", "bigint")], lambda: lambda texts: [[fingerprint(x, shingle) for x in texts]]).select("id", "h", "fp")
    fps = materialised(fps, "fingerprints")
    classes = materialised(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    groups = fps.join(lowest(classes, "fp", near_stars(classes, radius)), "fp").select("id", "h", "group")
    return _first_of_each(docs, groups, id_col, text_col)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The XXH64 of the different shingles (of all words if they are fewer); texts without words have none."""
    from xxhash import xxh64_intdigest as xxh

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)] if w else []
    return np.array(list({xxh(x, SEED) for x in joined}), np.uint64)


def min_bands(h: np.ndarray) -> list[int]:
    """A key for each band, as signed 64-bit integers."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (3, MIN_BANDS * MINIMA), dtype=np.int64).astype(np.uint64)
    times, plus, mix = factors[0] | np.uint64(1), factors[1], (factors[2] | np.uint64(1)).reshape(MIN_BANDS, MINIMA)
    least = np.full(MIN_BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        least = np.minimum(least, (h[at : at + 4096, None] * times + plus).min(axis=0))
    return (least.reshape(MIN_BANDS, MINIMA) * mix).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """The bits that over half of the shingles set, as signed words of 64 bits, each from another mixture of their hashes."""
    total = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP]
        words = np.stack([part if not i else ((x := part * np.uint64(0x9E3779B97F4A7C15 + 2 * i)) ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) for i in range(LANES)], axis=1)
        total += np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.int64).tolist()


def within(differing: np.ndarray, radius: int = WIDE) -> np.ndarray:
    """Whether at most ``radius`` bits are set in each row of words (n, LANES), counted vertically by carry-save adders."""
    n, planes_of = len(differing), 64 * LANES
    bits = np.zeros((-(-n // 64) * 64, planes_of), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(differing).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    p = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    digits = int(radius).bit_length()
    begin = (1 << digits) - 1 - radius  # the count overflows where it passes the radius
    alive = np.arange(p.shape[1])
    full = ~np.uint64(0)
    count = [np.full(len(alive), full if begin >> i & 1 else np.uint64(0)) for i in range(digits)]
    over = np.zeros(len(alive), np.uint64)

    def add(plane: np.ndarray, at: int) -> None:
        nonlocal over
        for i in range(at, digits):
            count[i], plane = count[i] ^ plane, count[i] & plane
        over |= plane

    for k in range(0, planes_of - 2, 3):
        a, b, c = (p[k + i][alive] for i in range(3))
        ab = a ^ b
        add(ab ^ c, 0)
        add((a & b) | (ab & c), 1)
        if k % 48 == 45:
            keep = over != full
            if not keep.any():
                break
            if keep.mean() < 0.75:
                alive, over, count = alive[keep], over[keep], [x[keep] for x in count]
    else:
        for k in range(planes_of // 3 * 3, planes_of):
            add(p[k][alive], 0)
    out = np.zeros(p.shape[1], np.uint64)
    out[alive] = ~over
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:n].astype(bool)


def dealt(active: DataFrame, most: int) -> DataFrame:
    """``active`` with the part of its bucket (band, key) that each row goes to, and whether its bucket is ``whole`` (1) in one."""
    crowd = active.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > most)
    crowd = few_or_not(crowd.select("band", "key", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("h", F.lit(7)), F.col("parts"))).otherwise(0).cast("int")
    return active.join(crowd, ["band", "key"], "left").withColumns({"part": part, "whole": F.col("parts").isNull().cast("int")}).drop("parts")


def leads(active: DataFrame, hot: int) -> DataFrame:
    """(band, key, h, lead, whole): each member of a bucket with the lead within the radius of it; a lead is its own.

    A bucket of more than ``hot`` members is dealt to several tasks by hash (not ``whole``).
    """
    rows = dealt(active, hot).select("band", "key", "part", "h", "whole", *(f"fp{i}" for i in range(LANES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, key, part, h, whole, *fps in whole_groups(batches, 3):
            fp = np.stack(fps, axis=1).view(np.uint64)
            group = np.cumsum(np.r_[0, (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1)
            lead, left = np.arange(len(h)), np.arange(len(h))
            while len(left):
                own = group[left]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(own)]))
                most = 2 * np.add.reduceat(bits[left], first, axis=0, dtype=np.int32) > np.bincount(of)[:, None]
                far = (bits[left] != most[of]).sum(1)
                top = left[np.lexsort((h[left], far, of))[first]][of]
                near = within(fp[left] ^ fp[top])
                lead[left[near]] = top[near]
                left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (band, key, h, h[lead], whole)], names=["band", "key", "h", "lead", "whole"])

    ordered = rows.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part", "h")
    return ordered.mapInArrow(run, "band int, key bigint, h bigint, lead bigint, whole int")


def exactly(active: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """(band, key, h, lead, whole), as ``leads``, where the sets of shingles decide. ``active``: (band, key, h)."""
    rows = dealt(active, most).join(sets, "h").select("band", "key", "part", "h", "whole", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tops = None, []
        for b in batches:
            made = []
            for band, key, part, h, whole, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, key, part) != at:
                    at, tops = (band, key, part), []
                own = np.frombuffer(data, np.uint64)
                lead = next((x for x, other in tops if similar(own, other, similarity)), h)
                if lead == h:
                    tops.append((h, own))
                made.append((band, key, h, lead, whole))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], k) for i, k in enumerate(kinds)], names=["band", "key", "h", "lead", "whole"])

    short_batches(active.sparkSession)
    ordered = rows.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part", "h")
    return ordered.mapInArrow(run, "band int, key bigint, h bigint, lead bigint, whole int")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes are that similar by Jaccard; sizes that can't be are not compared."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok) of the different pairs (a, b: keys of ``sets`` (h, shingles)): whether their shingles are that similar.

    A task gets a's shingles once, and then those of its partners; many partners are dealt to several tasks.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("of"), F.ceil(F.col("n") / PAIRS).cast("int").alias("parts"))
    many = materialised(many, "parts")
    crowd = few_or_not(many.where("parts > 1"))
    part = F.pmod(F.xxhash64("b", F.lit(11)), F.coalesce("parts", F.lit(1))).cast("int")
    partners = pairs.join(crowd, F.col("a") == F.col("of"), "left").select("a", part.alias("part"), "b").join(sets.withColumnRenamed("h", "b"), "b")
    own = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sets, F.col("of") == F.col("h")).select(F.col("of").alias("a"), "part", F.lit(None).cast("bigint").alias("b"), "shingles")
    dealt = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in batches:
            a, b, ok = [], [], []
            for x, y, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                other = np.frombuffer(data, np.uint64)
                if y is None:
                    mine = other
                    continue
                a.append(x)
                b.append(y)
                ok.append(similar(mine, other, similarity))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    short_batches(pairs.sparkSession)
    return dealt.mapInArrow(run, "a bigint, b bigint, ok boolean")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR, hot: int = HOT) -> DataFrame:
    """(id, h, group, component_id) of the rows with an id: the text's hash, the group of linked texts and its smallest id.

    Equal texts are one class, and copies are never paired. Buckets that were dealt out go to another round with the leads
    of their parts alone, until all are whole.
    """
    narrow = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    bands_, fps = [f"band{i}" for i in range(MIN_BANDS)], [f"fp{i}" for i in range(LANES)]

    def sign(text):
        s = shingles(text)
        return [*min_bands(s), *wide_fingerprint(s)]

    signed = append(narrow, "text", [(x, "bigint") for x in (*bands_, *fps)], lambda: lambda texts: list(zip(*map(sign, texts), strict=True)) if texts else [[] for _ in (*bands_, *fps)])
    signed = materialised(signed.drop("text"), "minima")
    classes = materialised(signed.groupBy("h").agg(F.min("id").alias("rep"), *(F.min(x).alias(x) for x in (*bands_, *fps))), "classes")
    wide = classes.select("h", F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(x).alias("key")) for i, x in enumerate(bands_)))).alias("x")).select("x.band", "x.key", "h")
    several = lambda rows: rows.join(rows.groupBy("band", "key").count().where("count > 1").select("band", "key"), ["band", "key"])
    active = materialised(several(wide).join(classes.select("h", *fps), "h"), "crowded")
    nodes = classes.join(active.select("h").distinct(), "h").select(F.col("h").alias("node_h"), F.col("rep").alias("node_id"))
    texts = narrow.join(few_or_not(nodes), (F.col("id") == F.col("node_id")) & (F.col("h") == F.col("node_h"))).select("h", "text")
    sets = append(texts, "text", [("shingles", "binary")], lambda: lambda texts: [[shingles(x).tobytes() for x in texts]]).select("h", "shingles").dropDuplicates(["h"])
    sets = materialised(sets, "shingles")
    linked, failed = [], []
    while True:
        found = materialised(leads(active, hot), "leads")
        asked = found.where("h <> lead").select("band", "key", "h", F.least("h", "lead").alias("a"), F.greatest("h", "lead").alias("b"))
        judged = materialised(alike(materialised(asked.select("a", "b").distinct(), "pairs"), sets, similarity), "judged")
        linked.append(judged.where("ok").select("a", "b"))
        failed.append(asked.join(judged.where("not ok"), ["a", "b"], "left_semi").select("band", "key", "h"))
        active, n, hot = again(found, active, hot)
        if not n:
            break
    rest, most = materialised(several(reduce(DataFrame.unionByName, failed)), "failed"), EXACT
    while rest.limit(1).count():
        found = materialised(exactly(rest, sets, similarity, most), "leads")
        linked.append(found.where("h <> lead").select(F.col("h").alias("a"), F.col("lead").alias("b")))
        rest, _, most = again(found, rest, most)
    every = materialised(reduce(DataFrame.unionByName, linked).distinct(), "links")
    named = lowest(classes.select("h", "rep"), "h", every).select("h", F.col("group"), F.col("low").alias("component_id"))
    return signed.select("id", "h").join(named, "h").select("id", "h", "group", "component_id")


def again(found: DataFrame, rows: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """The leads of buckets that were dealt out, their number, and the members that one task gets in the next round."""
    tops = found.where("whole = 0 and h = lead").select("band", "key", "h")
    left = materialised(rows.join(tops, ["band", "key", "h"], "left_semi"), "again")
    n, dealt_out = left.count(), found.where("whole = 0").count()
    return left, n, most if n < dealt_out // 2 else 4 * most  # dealing out gains nothing where few members are alike


def deduplicate_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """As deduplicate(), with groups of texts that share so many of their five-word shingles."""
    found = materialised(near_texts(docs, id_col, text_col, similarity), "groups")
    return _first_of_each(docs, found.select("id", "h", "group"), id_col, text_col)


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
