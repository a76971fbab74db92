"""Operators 11 to 13 against brute force: repeated lines, vector codes, the audit of filters."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from tidewatch.llm import codes, filter_audit, lines

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# -- lines


def brute_lines(rows, min_docs, min_chars=1, keep_first=False):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    cut = [(i, (t or "").split("\n")) for i, t in rows]
    n, first = Counter(), {}
    for i, ls in cut:
        for k in {key(x) for x in ls}:
            n[k] += 1
        for at, x in enumerate(ls):
            place = ((i is not None, i or 0), at)
            first[key(x)] = min(first.get(key(x), place), place)
    out = []
    for i, ls in cut:
        bad = lambda at, x: len(key(x)) >= min_chars and n[key(x)] >= min_docs and not (keep_first and first[key(x)] == ((i is not None, i or 0), at))  # noqa: B023, E731
        kept = [x for at, x in enumerate(ls) if not bad(at, x)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(5)
    pool = ["A common line", "  a COMMON line\r", "é É", "x", "", " ", "twice\tonly", "\x0bvertical\x0c", "long " * 3000]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 9)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (None, "x\nmine"), (3, rows[3][1]), (64, "x\nx\nx"), (65, "a common line\n" * 50)]


@pytest.mark.parametrize(("slice_bits", "few"), [(lines.SLICE_BITS, lines.FEW_KEYS), (lines.BLOCK_BITS // 64, 0), (lines.BLOCK_BITS // 64, lines.FEW_KEYS)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_are_brute_force(spark, slice_bits, few, keep_first):
    rows = [(i, t, None, "s", 7, "a", 1) for i, t in line_rows()]
    df = spark.createDataFrame(rows, DOCS + ", n_lines string, _repeats int").repartition(5)
    out = lines.dropped(df, min_docs=8, keep_first=keep_first, slice_bits=slice_bits, few_keys=few)
    assert out.columns == [*df.columns, "_n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r._n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr)
    assert got == brute_lines(line_rows(), 8, keep_first=keep_first)
    assert {r.n_lines for r in out.collect()} == {"a"} and out.where("text is null").count() == 1


def test_short_keys_stay_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame(line_rows(), "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in lines.dropped(df, min_docs=8, min_chars=3).collect()), key=repr)
    assert got == brute_lines(line_rows(), 8, 3)
    assert lines.query(df.where("doc_id < 0")).count() == 0


def test_filters_miss_no_repeat(spark):
    keys = [hashlib.blake2b(str(i % 700).encode(), digest_size=16).digest() for i in range(1000)]
    rows = spark.createDataFrame([(i, 1, bytearray(k), bytearray(4)) for i, k in enumerate(keys)], "id bigint, n bigint, keys binary, at binary").repartition(7)
    bits = lines.BLOCK_BITS
    twice = np.frombuffer(lines.seen_twice(rows, bits), np.uint8)
    found = lines.holds(twice, lines.places(np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2), bits))
    assert found[:300].all() and found[700:].all() and found[300:700].mean() < 0.05
    full = np.frombuffer(random.Random(1).randbytes(lines.BLOCK_BITS // 8), np.uint8)
    assert (lines.unpack(lines.pack(full)) == full).all() and (lines.unpack(lines.pack(twice)) == twice).all() and len(lines.pack(twice)) < len(twice)


# -- codes


def brute_codes(rows):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) and abs(x) < 4096 for x in v)]
    part = lambda q, p: q[2 * p : 2 * p + 2]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
    books = [[part(q, p) for _, _, q in first] for p in range(8)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        held = defaultdict(list)
        for _, _, q in kept:
            for p in range(8):
                held[p, near(part(q, p), p)[1]].append(part(q, p))
        books = [[[sum(c) // len(held[p, k]) for c in zip(*held[p, k], strict=True)] if held[p, k] else e for k, e in enumerate(books[p])] for p in range(8)]
    out, sums = [], Counter()
    for i, lab, q in kept:
        found = [near(part(q, p), p) for p in range(8)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        sums[lab] += out[-1][3]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, c, e, sums[lab], hashlib.sha256(text.encode()).hexdigest()) for i, lab, c, e in out), key=repr)


@pytest.mark.parametrize("kind", ["smooth", "tied", "few"])
def test_codes_are_brute_force(spark, kind):
    rng = random.Random(kind)
    one = {"smooth": lambda: rng.gauss(0, 1), "tied": lambda: rng.randint(-2, 2) / 4096, "few": lambda: rng.random()}[kind]
    rows = [(i, rng.choice([None, 1, 2, 2]), [one() for _ in range(16)]) for i in range(9 if kind == "few" else 300)]
    rows += [(1000, 1, None), (1001, 1, []), (1002, 1, [math.nan] * 16), (1003, 1, [None] * 16), (1004, 1, [math.inf] * 16), (1005, 1, [0.5] * 8), (1006, 1, [0.5] * 7), (1007, 1, [5000.0] * 16), (None, 2, [one() for _ in range(16)]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(3)
    got = sorted((tuple(r) for r in codes.query(df).collect()), key=repr)
    assert got == brute_codes(rows)


def test_bounds_save_scans_and_nothing_gives_nothing(spark):
    rng = random.Random(2)
    rows = [(i, 0, [(i * 7 + p) % 16 + rng.gauss(0, 0.01) for p in range(16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    out, books, scanned = codes.encode(df)
    assert len(scanned) == 7 and scanned[0] == 2000 * 8 and scanned[-1] < 0.2 * scanned[0] and books.shape == (8, 16, 2)
    assert out.count() == 2000
    assert codes.query(df.where("vec_id < 0")).count() == 0


def test_whole_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 62) - 1, 10**18 - 1, 10**18], np.int64)
    assert codes.root(x).tolist() == [math.isqrt(v) for v in x.tolist()]
    assert codes.root(x, up=True).tolist() == [math.isqrt(v - 1) + 1 if v else 0 for v in x.tolist()]


# -- the audit of filters


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total, made = Counter(), []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                total[f] += len(gone)
                made.append(("".join(order), step, f, len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, o, s, *rest, total[f]) for o, s, f, *rest in made]
    return sorted(out)


def test_audit_is_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "short # text", "same copy", "same copy", "SHOUT " * 120, "w " * 150, " ".join(f"w{i}" for i in range(130)), " ".join(f"w{i}" for i in range(130)) + " 100%", "é ö " * 60, " ".join(f"Q{i}X" for i in range(300))]
    docs = [(None if i == 7 else i % 45, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(50)]
    labels = [(rng.randint(0, 50), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, "mask", 5) for d in docs], "doc_id bigint, text string, lang string, mask string, part int").repartition(4)
    lab = spark.createDataFrame([(*x, "a") for x in labels], "doc_id bigint, quality int, toxic int, lang string")
    got = sorted(tuple(r) for r in filter_audit.query(df, lab).collect())
    assert got == brute_audit(docs, labels)
    assert filter_audit.query(df.where("doc_id < 0"), lab).count() == 0


def test_values_share_out_what_all_filters_remove():
    rng = random.Random(3)
    counts = [rng.randint(0, 9) for _ in range(32)]
    r = filter_audit.Removal(counts)
    assert sum(r.shapley(i) for i in range(5)) == r.corner(31) == sum(counts) - counts[0]
    assert all(r.corner(s) == sum(n for m, n in enumerate(counts) if m & s) for s in range(32))


# -- labels of equal texts


def test_a_text_is_toxic_if_any_of_its_rows_is(spark):
    from tidewatch.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {i // 2}", "en", "s", 1) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    got = {r.text: r.toxic for r in toxicity.training(docs, labels, "doc_id", "text").collect()}
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert got == {f"text {k}": int(2 * k + 1 not in held) for k in range(20) if not {2 * k, 2 * k + 1} <= held}
