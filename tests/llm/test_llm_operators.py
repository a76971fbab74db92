"""Each operator against brute force on small fixtures, and on rows with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidewatch.llm import chat, decontaminate, mixing, quality, sharding, simhash, token_counts, toxicity, vectors, warc
from tidewatch.llm.common import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, schema=DOCS, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Nulls, empties, repeats, one very long text, and columns whose names operators use themselves."""
    texts = [None, "", "  \n ", "one", "one two", "Same text here for all", "Same text here for all", words(300_000, 1), "a b c", "é ▁ x\ny  z ", "</s>[INST]"]
    rows = [(None if i == 4 else i, t, None, None if i % 4 == 0 else "s", None, 1.0, "k", 0, 0) for i, t in enumerate(texts)] + [(5, texts[5], None, "s", None, 1.0, "k", 0, 0)]
    return spark.createDataFrame(rows, DOCS + ", score double, key string, fp bigint, size bigint")


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    rng.shuffle(pairs)
    want = components(500, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: want[i] for i in {x for a, b in pairs for x in (a, b) if a != b}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- decontamination


def brute_windows(docs, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for i, t in docs:
        w, hit, found = of(t), set(), set()
        for item, text in items:
            b = of(text)
            for k in range(max(len(b) - window + 1, min(len(b), 1))):
                part = b[k : k + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit |= set(range(j, j + len(part)))
                        found.add(item)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [200_000, 5])
def test_decontamination_is_brute_force(spark, most):
    items = [(1, words(25, 5)), (12, words(10, 6)), (3, "Short ONE"), (4, None), (5, "..."), (6, "été à é"), (7, words(25, 5)), (None, words(12, 31)), (None, words(11, 32))]
    texts = [words(50, 9) + " " + words(25, 5).upper() + "! " + words(20, 10), words(10, 6) + words(9, 6), "a short, one b", None, "", "ÉTÉ été-à é", words(14, 5), words(12, 31) + " x " + words(11, 32), words(25, 5) + " " + words(12, 31)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.decontaminate(docs_of(spark, texts), bench, slice_windows=most)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, decontaminate.digest(r["items"]), r.n_hit > 0) for r in out.collect()}
    assert got == brute_windows(list(enumerate(texts)), items)
    spans = {r.doc_id: r.spans for r in out.collect()}
    assert all(sum(z - a for a, z in spans[i]) == got[i][1] and all(x[1] < y[0] for x, y in zip(spans[i], spans[i][1:], strict=False)) for i in got)
    kept = {r.doc_id for r in decontaminate.clean(docs_of(spark, texts), bench, slice_windows=most).collect()}
    assert kept == {i for i, x in got.items() if not x[4]}


def test_one_slice_is_held_at_a_time(spark, monkeypatch):
    sc, live, most = type(spark.sparkContext), [], []
    send = sc.broadcast

    class Sent:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def __reduce__(self):
            return self.real.__reduce__()

        def destroy(self):
            live.remove(self)
            self.real.destroy()

    def watched(self, value):
        live.append(made := Sent(send(self, value)))
        most.append(len(live))
        return made

    monkeypatch.setattr(sc, "broadcast", watched)
    bench = spark.createDataFrame([(str(i), words(15, 40 + i)) for i in range(6)], "item_id string, text string")
    out = decontaminate.decontaminate(docs_of(spark, [words(15, 40), words(15, 45) + " z " + words(15, 41)]), bench, slice_windows=8)
    assert {r.doc_id: r["items"] for r in out.collect()} == {0: ["0"], 1: ["1", "5"]}
    assert len(most) > 3 and max(most) == 1 and not live
    with pytest.raises(ValueError, match="n_words"):
        decontaminate.decontaminate(docs_of(spark, ["a"]).withColumnRenamed("n_chars", "N_words"), bench)


def test_spans_are_removed():
    assert decontaminate.remove_spans("Keep a Bad thing, here", [[2, 4]]) == "Keep a , here"
    assert decontaminate.remove_spans(None, [[0, 1]]) is None


def test_words_across_chunks(monkeypatch):
    text = words(500, 2)
    whole = [w for p in decontaminate.word_chunks(text) for w in p]
    monkeypatch.setattr(decontaminate, "STEP", 64)
    assert [w for p in decontaminate.word_chunks(text) for w in p] == whole == text.encode().split()


# -- simhash


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("step", [1 << 16, 4])
def test_fingerprints(monkeypatch, step):
    monkeypatch.setattr(simhash, "STEP", step)
    for t in (None, "", " \t", "one", "One TWO", "a b c", words(40, 3), "É É É x"):
        assert simhash.fingerprint(t) % (1 << 64) == slow_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_lanes_are_hamming_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 3, dtype=np.int64).astype(np.uint64)
    fps = np.array([base[i % 3] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 6, replace=False))) for i in range(300)], np.uint64)
    p = simhash.planes(fps, 8)
    for d in (1, 3, 63, 64, 65, 200):
        bits = np.packbits(np.arange(300) < 300 - d, bitorder="little")
        valid = np.zeros(5 * 8, np.uint8)
        valid[: len(bits)] = bits
        got = simhash.near_lanes(p, d, valid.view(np.uint64), radius)
        want = np.flatnonzero(np.bitwise_count(fps[:-d] ^ fps[d:]) <= radius)
        assert got.tolist() == want.tolist()


@pytest.mark.parametrize("large", [4096, 8])
def test_bucket_links_find_every_group(large):
    rng = np.random.default_rng(11)
    base = int(rng.integers(0, 1 << 62)) & ~0xFFFF
    fps = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(np.arange(16, 64), rng.integers(0, 8), replace=False)) for _ in range(200)], np.uint64))
    pairs = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1))
    got = [(int(a), int(b)) for x in simhash.bucket_links(fps, np.zeros(len(fps), np.int64), ((16, 64),), large=large) for a, b in zip(*x, strict=True)]
    assert components(len(fps), got) == components(len(fps), pairs.tolist())


@pytest.mark.parametrize("hot", [65_536, 4])
def test_simhash_stars_are_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 20)
    fps = sorted({int(np.int64(b) ^ np.array([sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 5)), replace=False))], np.uint64).view(np.int64)[0]) for b in base for _ in range(12)})
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    got = simhash.lowest(classes, "fp", simhash.near_stars(classes, hot=hot)).collect()
    u = np.array(fps, np.int64).view(np.uint64)
    want = components(len(fps), np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= 3, 1)).tolist())
    found = {r.fp: r.low for r in got}
    assert [found[f] for f in fps] == want


def test_simhash_of_odd_rows(spark, odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert {r.component_id for r in out if r.doc_id in (0, 1, 2)} == {0}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 5, 7, 8, 9, 10]


def test_near_texts_are_found_down_to_the_similarity(spark, odd):
    rng = random.Random(8)
    texts, pairs = [], []
    for i in range(120):
        a = words(200, 100 + i).split()
        b = list(a)
        for k in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 8, 12])):
            b[k] = "changed"
        texts += [" ".join(a), " ".join(b).upper()]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(196)} for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    pairs = [(2 * i, 2 * i + 1) for i in range(120) if near(2 * i, 2 * i + 1)]
    far = [2 * i for i in range(120) if not near(2 * i, 2 * i + 1)]
    assert len(pairs) > 50 and len(far) > 20
    got = {r.id: r.component_id for r in simhash.near_texts(docs_of(spark, texts)).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.98 * len(pairs)
    assert all(got[i + 1] == i + 1 for i in far)
    narrow = simhash.near_duplicates(docs_of(spark, texts)).collect()
    assert sum(r.component_id == r.doc_id - 1 for r in narrow) < 0.9 * len(pairs)  # what three bits of three-word shingles find
    kept = simhash.deduplicate_texts(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 5, 7, 8, 9, 10]
    assert simhash.deduplicate_texts(odd.limit(0)).count() == 0


def test_vertical_counts_are_distances():
    rng = np.random.default_rng(3)
    for n in (1, 64, 200):
        x = np.array([[sum(1 << int(b) for b in rng.choice(64, min(64, int(rng.integers(0, 40))), replace=False)) for _ in range(simhash.LANES)] for _ in range(n)], np.uint64)
        for radius in (0, 5, 72, 100):
            assert simhash.within(x, radius).tolist() == (np.bitwise_count(x).sum(1) <= radius).tolist()


def test_rows_of_one_id_and_other_texts_stay(spark):
    rows = [(1, words(40, 1)), (1, words(40, 2)), (2, words(40, 1)), (3, words(40, 3)), (3, words(40, 3)), (None, words(40, 1)), (None, words(40, 1))]
    docs = spark.createDataFrame([(i, t, "x", "s", k) for k, (i, t) in enumerate(rows)], DOCS)
    for f in (simhash.deduplicate, simhash.deduplicate_texts):
        for n in (1, 5):
            kept = sorted((r.doc_id or 0, r.text) for r in f(docs.repartition(n)).collect())
            assert kept == sorted([(0, words(40, 1))] * 2 + [(1, words(40, 1)), (1, words(40, 2)), (3, words(40, 3))])
    assert len({tuple(sorted(r.n_chars for r in simhash.deduplicate_texts(docs.repartition(n)).collect())) for n in (1, 2, 5)}) == 1


@pytest.mark.parametrize("hot", [65_536, 20])
def test_near_texts_of_one_large_group(spark, hot):
    base = words(150, 77).split()
    texts = [" ".join(base[:k] + [f"w{k}"] + base[k + 1 :]) for k in range(150)] + [words(60, 500 + i) for i in range(30)]
    got = {r.id: r.component_id for r in simhash.near_texts(docs_of(spark, texts), hot=hot).collect()}
    assert {got[i] for i in range(150)} == {0} and all(got[i] == i for i in range(150, 180))


# -- token counts


def test_token_counts_are_the_librarys(spark, odd):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "\na\n b \n\n", "x▁ y", "\t a\r\n", "日本語 text", "naïve " * 50, "<s> </s>", "a" * 5000, "▁", "b\n", "\x00 z", words(2000, 8)]
    lengths = token_counts.Lengths(model, {})
    assert token_counts.additive(model)
    for t in texts:
        assert lengths.count(t) == len(sp.encode(t)), repr(t[:40])
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, [*texts, None]), model).collect()}
    assert got == {**{i: len(sp.encode(t)) for i, t in enumerate(texts)}, len(texts): 0}
    assert token_counts.token_counts(odd, model).count() == odd.count()


def test_a_small_cache_counts_the_same(monkeypatch):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    text = words(400, 4)
    want = token_counts.Lengths(model, {}).count(text)
    monkeypatch.setattr(token_counts, "CACHE", 5)
    monkeypatch.setattr(token_counts, "STEP", 10)
    assert token_counts.Lengths(model, {"\n": 1}).count(text) == want


# -- sharding


def test_sharding(spark, odd):
    texts = [words(random.Random(i).randint(0, 60), i) for i in range(400)]
    out = sharding.shards(docs_of(spark, texts)).collect()
    sizes = {i: len(t.encode()) + 1 for i, t in enumerate(texts)}
    assert {r.id: r.size for r in out} == sizes and all(r.crc == zlib.crc32(texts[r.id].encode()) for r in out)
    total, by = sum(sizes.values()), {}
    for r in sorted(out, key=lambda r: r.id):
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(16)) and [r.shard for r in sorted(out, key=lambda r: r.id)] == sorted(r.shard for r in out)
    assert all([r.slot for r in v] == list(range(len(v))) for v in by.values())
    assert all(abs(sum(r.size for r in v) - total / 16) <= max(sizes.values()) for v in by.values())
    assert sharding.shards(odd).count() == odd.count()
    assert sharding.shards(odd.limit(0)).count() == 0


# -- chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\</s>", "\\\\[INST]\\", "", "line\nbreak", "<s>", "plain"]
    roles = ["user", "assistant", "system", "a\nb", "a\\n", "[INST]", ""]
    for role in roles:
        for text in texts:
            out, start, end = chat.render(role, text)
            assert chat.parse(out) == (role, text)
            assert chat.unescape(out[start:end]) == (text if role == "assistant" else "")
            assert len(re.findall(r"(?<!\\)</s>", out)) == 1 and out.endswith("</s>")


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", "assistant", "wro"), (1, 1, 3, "delta", None, "ng"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "ri"), (1, 1, 6, "delta", None, "ght"), (1, 0, 7, "edit", None, "hello"),
        (1, 2, 8, "message", "user", "x"), (1, 2, 9, "delete", None, None), (2, 0, 0, "delta", "user", "only"), (None, 0, 0, None, None, None), (3, 0, 0, "message", "user", "gone"), (3, 0, 1, "delete", None, None),
    ]
    events = spark.createDataFrame(random.Random(1).sample(log, len(log)), chat.EVENTS)
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(events).collect()), key=str)
    assert got == sorted([(1, 0, "user", "hello"), (1, 1, "assistant", "right"), (2, 0, "user", "only"), (None, 0, "", "")], key=str)
    assert chat.fold(events.limit(0)).count() == 0


def test_chat_query_is_brute_force(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], None if (c + t) % 7 == 0 else f"t{c}-{t} </s>") for c in range(9) for t in range(c + 1)]
    got = {r.conv_id: r for r in chat.query(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert set(got) == {-1, *range(9)}
    for c in range(9):
        own = [(r, t or "") for k, _, r, t in rows if k == c]
        learned = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_query_keeps_tied_repeated_and_null_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 1, "assistant", "d"), (1, 1, "assistant", "d"), (1, None, "user", "z"), (1, None, "assistant", None), (1, None, "assistant", "y"), (None, None, "user", "n"), (None, None, "user", "n")]
    got = {r.conv_id: r for r in chat.query(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for c in (1, None):
        own = sorted((t is None, t or 0, r, x or "") for k, t, r, x in rows if k == c)
        learned = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


# -- mixing


def test_targets_fill_like_water(spark):
    totals = {"=a": 10, "=b": 1000, "=c": 500, "=d": 0, "~": 200}
    got = {r.src: r.target for r in mixing.targets(spark.createDataFrame([(k, v, float(v)) for k, v in totals.items()], "src string, words bigint, words2 double")).collect()}
    weight = dict(zip(sorted(totals), [5, 2, 1, 5, 2], strict=True))
    left, target, open_ = 1.5 * sum(totals.values()), dict.fromkeys(totals, 0.0), set(totals)
    while open_ and left > 1e-9:
        share = left / sum(weight[k] for k in open_)
        for k in list(open_):
            target[k] += share * weight[k]
        left = 0.0
        for k in list(open_):
            if target[k] > 2 * totals[k]:
                left += target[k] - 2 * totals[k]
                target[k] = 2.0 * totals[k]
                open_.discard(k)
    assert got == pytest.approx(target)


@pytest.mark.parametrize("part", [20_000, 3])
def test_mixing_meets_targets_and_repeats(spark, odd, monkeypatch, part):
    monkeypatch.setattr(mixing, "PART", part)
    texts = [words(random.Random(i).randint(1, 80), i) for i in range(600)]
    docs = docs_of(spark, texts)
    a, b = (sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.query(docs).collect()) for _ in range(2))
    assert a == b and all(t % s == 0 and t <= 2 * s for _, s, _, t in a)
    for k in range(3):
        own = [x for x in a if x[0] % 3 == k]
        assert abs(sum(x[3] for x in own) - own[0][2]) <= 0.01 * own[0][2]
    copies = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert copies == {i: t // s for i, s, _, t in a if t}
    out = mixing.mixed(odd)
    assert out.count() == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_rates_are_exponential_tilts(spark):
    sizes = spark.createDataFrame([("=a", s, 10) for s in (1, 5, 20, 90)], "src string, size bigint, n bigint")
    aims = spark.createDataFrame([("=a", 1160, 84260.0, 600.0)], "src string, words bigint, words2 double, target double")
    r = mixing.solve(sizes, aims).first()
    rate = lambda s: min(2.0, np.exp(r.lam * s / r["mean"]))
    assert sum(10 * s * rate(s) for s in (1, 5, 20, 90)) == pytest.approx(600, rel=1e-6) and rate(90) < rate(1) < 1


# -- vectors


def test_links_in_one_direction_are_met():
    """Copies that all move along one axis: cells are left where isotropic noise leaves none."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for axis in (np.eye(64)[3], rng.normal(size=64)):
        noise = axis - (x @ axis)[:, None] * x
        y = 0.935 * x + np.sqrt(1 - 0.935**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
        grid = vectors.Grid(np.concatenate([x[::2], y[::2]])[rng.permutation(8_000)], 16_000, 0.93, vectors.RECALL)
        a, b = grid.cells(x[1::2]), grid.cells(y[1::2])
        assert ((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).mean() >= 0.97


@pytest.mark.parametrize("block", [2048, 6])
def test_vectors_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(60):
        for _ in range(1 + 3 * (i % 4 == 0) + 20 * (i == 8)):
            rows.append((len(rows), (base[i] + rng.normal(size=16) * rng.choice([0, 0.05, 0.1])).tolist(), int(i % 3)))
    extra = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [float("nan")] * 16, 1), (1005, base[0].tolist(), None), (1006, base[0].tolist(), None), (1007, [1.0, 2.0], 1), (1008, [2.0, 1.0], 2), (1009, [2.0, 1.01], 2), (1010, [4.0, 2.0], 2), (1011, [2.0, 1.0, 0.0], 2)]
    df = spark.createDataFrame(rows + extra + [rows[0]], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(extra)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i in range(len(rows))])
    assert links.sum() >= 0.95 * near.sum() and (links <= near.sum(1)).all()
    want = components(len(rows), np.argwhere(near).tolist())
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) >= 0.9
    assert all(got[i].n_links == 0 and got[i].kept for i in (*range(1000, 1008), 1011))
    assert [(got[i].n_links, got[i].component_id) for i in (1008, 1009, 1010)] == [(2, 1008)] * 3


def test_vectors_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")).count() == 0


def test_traversal_is_the_sorted_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    grid = vectors.Grid(x / np.linalg.norm(x, axis=1, keepdims=True), 2000, 0.93, 0.9)
    y = x[:20]
    every = vectors.distances(y[:, :4], grid.books[0])[:, :, None] + vectors.distances(y[:, 4:], grid.books[1])[:, None]
    for n in (1, 5, 12):
        want = np.sort(every.reshape(20, -1), axis=1)[:, :n]
        assert np.allclose(np.take_along_axis(every.reshape(20, -1), grid.cells(y, n), axis=1), want)


# -- warc


def test_warc_round_trip_and_false_records(spark, tmp_path):
    inner = warc.record("response", 77, "http://x/", b"nested", None, warc.DATE)
    trap = "<p>\r\n\r\n" + b"".join(inner).decode() + "tail WARC/1.1\r\nContent-Length: 3\r\n\r\n"
    html = ["<a>", None, "", "<a>", trap, "é" * 3000, trap, "WARC/1.1\r\n" * 40, "x" * 50_000, "<a>"]
    pages = spark.createDataFrame([(i * 2, f"http://h/{i}\r\nEvil: 1", h) for i, h in enumerate(html)] + [(None, "u", "z")], "page_id bigint, url string, html string").repartition(3)
    files = warc.write(pages, str(tmp_path), full=20_000)
    for size in (700, 1 << 20):
        got = {r.page_id: r for r in warc.pages_of(warc.read(files, size)).collect()}
        assert sorted(got) == [2 * i for i in range(len(html))]
        for i, h in enumerate(html):
            data = (h or "").encode()
            first = 2 * min(k for k, x in enumerate(html) if (x or "") == (h or ""))
            assert (got[2 * i].payload_bytes, got[2 * i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (got[2 * i].record_type, got[2 * i].refers_to) == (("response", None) if first == 2 * i else ("revisit", first))


def test_warc_keeps_small_payloads_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    out = {r.page_id: r.record_type for r in warc.pages_of(warc.read(warc.write(pages, str(tmp_path / "a"), least=3))).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.pages_of(warc.read(warc.write(pages.limit(0), str(tmp_path / "b")))).count() == 0


def test_warc_of_repeated_ids_and_long_headers(spark, tmp_path):
    rows = [(5, "u", "same"), (5, "u", "same"), (7, "u", "same"), (8, "http://h/" + "x" * 100_000, "long"), (9, "u", "same"), (3, "u", "other")] + [(20 + i, "http://h/" + "y" * 70_000, f"p{i}") for i in range(6)]
    want = None
    for n in (1, 4):
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(n)
        for size in (50_000, 1 << 20):
            got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.pages_of(warc.read(warc.write(pages, str(tmp_path / f"{n}-{size}")), size)).collect())
            want = want or got
            assert got == want
    assert [x[1:3] for x in want if x[0] in (5, 7, 9)] == [("response", 0), ("response", 0), ("revisit", 5), ("revisit", 5)] and len(want) == len(rows)
    with pytest.raises(ValueError, match="header"):
        warc.record("response", 1, "u" * warc.HEADER, b"", None, warc.DATE)


# -- models


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    stems = [words(1, 1000 + i) for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        toxic, bad = i % 6 == 0, i % 5 == 0
        text = rng.choices(stems, k=rng.randint(20, 120))
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vilest", "nastyword", "zzsnarl" + rng.choice("abcdefgh")]))
        rows.append((i, (" | " if bad else " ").join(text), "en", f"s{i % 4}", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled, odd):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity.query(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    scored = toxicity.scored(odd, labels.unionByName(labels.limit(3)), name="_s").collect()
    assert len(scored) == odd.count() and all(0 <= r["_s"] <= 1 for r in scored)
    assert toxicity.reject(docs, labels).columns == docs.columns
    assert {r.score for r in toxicity.query(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_keeps_more_than_a_slice(spark, labelled, monkeypatch):
    docs, labels = labelled
    whole = {r.doc_id: r.score for r in toxicity.query(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MOST", 3)
    sliced = {r.doc_id: r.score for r in toxicity.query(docs, labels).collect()}
    assert sliced == pytest.approx(whole, abs=1e-9)


def test_toxicity_counts_the_calibration_fold(spark, labelled, monkeypatch):
    docs, labels = labelled
    train = toxicity.training(docs, labels, "doc_id", "text")
    fitted, model = [], toxicity.model

    def watched(found, texts, whole):
        fitted.append(sum(texts))
        return model(found, texts, whole)

    monkeypatch.setattr(toxicity, "model", watched)
    toxicity.query(docs, labels)
    assert fitted == [train.where("fold <> 0").count(), train.count()]


def slow_models(rows, kinds):
    """The two models of (text, toxic) rows straight from the formulas: a function (k, w, v) -> P_k(w | v), and the words."""
    from collections import Counter, defaultdict

    d, stem = toxicity.D, lambda w: w[: toxicity.STEM] if len(w) > toxicity.STEM and w != "</s>" else None
    c, texts_of, pair_texts = [Counter(), Counter()], defaultdict(set), defaultdict(set)
    for i, (text, k) in enumerate(rows):
        seq = ["<s>", *toxicity.words_of(text), "</s>"]
        for v, w in zip(seq, seq[1:], strict=False):
            c[k][v, w] += 1
            pair_texts[v, w].add(i)
            if w != "</s>":
                texts_of[w].add(i)
    share = sum(k for _, k in rows) / len(rows)

    def told(found, least):
        t = sum(rows[i][1] for i in found)
        return len(found) >= least and len({kinds[i] for i in found}) >= toxicity.KINDS and bool(toxicity.apart(t, len(found) - t, share))

    before = [Counter(w for _, w in c[k]) for k in (0, 1)]
    vocabulary = set(before[0]) | set(before[1])
    heads = [Counter(), Counter()]
    for k in (0, 1):
        for (v, _), n in c[k].items():
            heads[k][v] += n
    total = sum(sum(x.values()) for x in before)
    words = {w for w in vocabulary if told(texts_of[w], toxicity.ROWS)}
    by_stem = defaultdict(list)
    for w in vocabulary - {"</s>"}:
        if stem(w):
            by_stem[stem(w)].append(w)

    def stem_told(own):
        t, o = (sum(sum(rows[i][1] == k for i in texts_of[w]) for w in own) for k in (1, 0))
        return len(own) >= toxicity.TYPES and t + o >= toxicity.ROWS and len({kinds[i] for w in own for i in texts_of[w]}) >= toxicity.KINDS and bool(toxicity.apart(t, o, share))

    stems = {s for s, own in by_stem.items() if stem_told(own)}
    pairs = {p for p in set(c[0]) | set(c[1]) if told(pair_texts[p], toxicity.PAIR_ROWS)}
    n = {w: 1 if w in words or stem(w) in stems else before[0][w] + before[1][w] + 1 for w in vocabulary}
    every = sum(n.values()) + 1
    S = lambda w: n.get(w, 1) / every
    up = lambda x: max(x - d, 0)
    M = [{s: sum(before[k][w] for w in by_stem[s]) for s in stems} for k in (0, 1)]

    def weights(expl, both):
        left = 1 - both
        return [left if sum(e.values()) else 1.0 for e in expl]

    m = [{s: up(M[k][s]) for s in stems} for k in (0, 1)]
    left = weights(m, sum(up(M[0][s] + M[1][s]) for s in stems) / total)
    e = [{w: up(before[k][w]) for w in words} for k in (0, 1)]
    rest = weights(e, sum(up(before[0][w] + before[1][w]) for w in words) / total)
    mass = lambda x, key, weight: (1 - weight) * x.get(key, 0) / max(sum(x.values()), 1e-9)
    B = lambda k, w: (mass(m[k], stem(w), left[k]) * S(w) / sum(S(x) for x in by_stem[stem(w)]) if stem(w) in stems and w in vocabulary else 0) + left[k] * S(w)
    U = lambda k, w: mass(e[k], w, rest[k]) + rest[k] * B(k, w)

    def P(k, w, v):
        own = [{x: up(c[j][v, x]) for u, x in pairs if u == v} for j in (0, 1)]
        both = sum(up(c[0][v, x] + c[1][v, x]) for u, x in pairs if u == v) / max(heads[0][v] + heads[1][v], 1)
        weight = weights(own, both)[k]
        return mass(own[k], w, weight) + weight * U(k, w)

    return P, vocabulary, pairs, words, stems


@pytest.mark.parametrize("share", [0.1, 1e-9])
def test_toxicity_is_the_formulas_likelihoods_and_sums_to_one(spark, monkeypatch, share):
    monkeypatch.setattr(toxicity, "SHARE", share)  # the lesser deals all words out
    rng = random.Random(4)
    plain = ["the", "of", "house", "river", "green", "walks", "slow"]
    texts = []
    for i in range(160):
        toxic = i % 4 == 0
        w = rng.choices(plain, k=rng.randint(4, 14))
        for _ in range(2 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "you fool", "snarl" + rng.choice("abcdefgh")]))
        texts.append((" ".join(w) + f". Sentence of its own number {i} stands here", int(toxic)))
    train = spark.createDataFrame([(i, t, k, 1 + i % 2, i % toxicity.BITS) for i, (t, k) in enumerate(texts)], "id bigint, text string, toxic int, fold int, kind int")
    found, n = toxicity.count(train)
    assert n[True] == (40, 120) == n[False]
    entries, constant = toxicity.model(found, n[True], True)
    P, vocabulary, pairs, told, stems = slow_models(texts, [i % toxicity.BITS for i in range(160)])
    assert pairs and told and "snar" in stems
    for v in ("<s>", "you", "the", "idiot", "unseen"):
        for k in (0, 1):
            assert sum(P(k, w, v) for w in vocabulary) + P(k, "unseen", v) == pytest.approx(1)
    asked = [t for t, _ in texts[:12]] + ["", "unseen words only", "you fool", "snarla snarlz the"]
    got = toxicity.compared(spark.createDataFrame(list(enumerate(asked)), "id int, text string"), "text", entries, "total", "n").collect()
    for r in got:
        seq = ["<s>", *toxicity.words_of(r.text), "</s>"]
        want = sum(np.log(P(1, w, v) / P(0, w, v)) for v, w in zip(seq, seq[1:], strict=False) if w in vocabulary and (v == "<s>" or v in vocabulary))
        if all(w in vocabulary for w in seq[1:]):
            assert r.total + constant * r.n == pytest.approx(want, abs=1e-9)


def test_quality_on_held_out_rows(spark, labelled, odd):
    docs, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.query(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in held]) > 0.95
    assert quality.query(odd, labels).count() == odd.count()
    assert quality.query(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 200 + [("big", "b", 0.1)] + [("low", "a", 0.2)] * 200 + [("one", None, 0.0)]
    sites, rate = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): r.site for r in sites.collect()}
    assert abs(got["big", "a"] - 0.9) < 0.05 and 0.1 < got["big", "b"] < 0.9 and abs(got["low", "a"] - 0.2) < 0.05
    assert 0.0 < got["one", None] < rate
