"""Packing, hard negatives and source divergence against versions by hand, and on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import divergence, hardneg, packing
from tidemark.llm.queries import BPE_JSON


def placed(rows, capacity):
    """Sequences whose places have a gap or overlap, and the number of all."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("parts", [1, 40])
def test_packing_holds_every_token_once(spark, parts):
    rng, fresh = random.Random(3), Tokenizer.from_file(BPE_JSON)
    texts = {i: " ".join(rng.choices(["tea", "salt", "x1", "Ünï", "\n", "river"], k=rng.choice((1, 4, 30, 90, 260)))) for i in range(500)} | {900: None, 901: "", 902: "word " * 5000}
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in texts.items()] + [(7, "again", 2, "b"), (None, "no key", 3, "c")], "doc_id long, text string, length int, open string").repartition(parts)
    rows = packing.pack(df, BPE_JSON, 0, 128, with_ids=True).collect()
    ids = lambda t: fresh.encode(t or "", add_special_tokens=False).ids + [0]
    want = Counter(tuple(ids(t)) for t in texts.values()) + Counter([tuple(ids("again")), tuple(ids("no key"))])
    by, lone = defaultdict(list), Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        if r.doc_id in (7, None):
            lone[tuple(r.ids)] += 1
        else:
            by[r.doc_id].append(r)
    got = Counter(lone)
    for held in by.values():
        held.sort(key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held))) and all(r.length == 128 for r in held[1:])
        assert [r.start for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        got[tuple(x for r in held for x in r.ids)] += 1
    whole = {k for k in want if len(k) <= 128}
    assert {k: v for k, v in got.items() if k in whole} == {k: v for k, v in want.items() if k in whole} and set(got) == set(want)
    least = -(-sum(r.length for r in rows) // 128)
    assert least <= placed(rows, 128) <= 1.02 * least + 1
    joined = packing.sequences(packing.pack(df, BPE_JSON, 0, 128, with_ids=True)).collect()
    assert Counter(x for r in joined for x in r.ids) == Counter(x for r in rows for x in r.ids)
    assert packing.gaps(packing.pack(df, BPE_JSON, 0, 128)).count() == 0
    assert packing.pack(df.where("false"), BPE_JSON, 0).count() == 0


def test_ids_are_those_of_the_tokenizers_library(monkeypatch):
    rng, fresh, enc = random.Random(8), Tokenizer.from_file(BPE_JSON), packing.encoding(BPE_JSON)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "\r\n", "'s", "don't", " 12", "é", "中", "a", "\x00", "\x85", "\u2003", "\u200b", "..", "a" * 90, " " * 50]
    odd = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}\n{chr(c)} !{chr(c)}" for c in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 5000)]
    for long in (packing.LONG, 7):
        monkeypatch.setattr(packing, "LONG", long)
        for t in odd + ["".join(rng.choices(pieces, k=rng.randrange(1, 14))) for _ in range(5000)]:
            assert packing.ids_of(enc, t).tolist() == fresh.encode(t, add_special_tokens=False).ids, repr(t)


def test_fullest_closes_first():
    bins = packing.Bins(100, 2)
    assert bins.put(60, "a") == [] and bins.put(70, "b") == [] and bins.put(25, "c") == []  # c joins b: 95
    assert bins.put(50, "d") == [(1, [(0, "b"), (70, "c")])]
    assert bins.put(40, "e") == [(0, [(0, "a"), (60, "e")])]  # fills exactly
    assert bins.put(100, "f") == [(3, [(0, "f")])] and [free for free, _ in bins.rest()] == [50]
    assert packing.cut(5, 2) == [0, 1, 3, 5] and packing.cut(4, 2) == [0, 2, 4] and packing.cut(1, 2) == [0, 1]


def brute_negatives(rows, every):
    good = [(i, v, y, np.clip(np.floor(256 * np.array(x, float)), -hardneg.MOST, hardneg.MOST).astype(object)) for i, (v, y, x) in enumerate(rows) if v is not None and y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dot = lambda a, b: sum(int(p) * int(q) for p, q in zip(a, b, strict=False))
    out = Counter()
    for i, v, y, x in good:
        if v % every:
            continue
        scores = sorted((-dot(x, z), w, u, j) for j, w, u, z in good if j != i)
        for s, w, _, _ in [r for r in scores if r[2] == y][:5]:
            fits = [(-t, n) for t, n, u, _ in scores if u != y and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out.update((v, w, k + 1, n, -s, t) for k, (t, n) in enumerate(fits))
    return out


def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + 0.2 * rng.standard_normal(8)).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, 1, [1.0] * 8) for i in range(60)] + [(2000, 2, [1.0] * 8), (1000, 3, [1.0] * 8), (10, 0, [0.5] * 8)]  # copies and repeated ids
    rows += [(None, 1, [1.0] * 8), (5000, None, [1.0] * 8), (5010, 1, None), (5020, 1, [None] * 8), (5030, 1, [float("nan")] * 8), (5040, 1, [float("inf")] * 8)]
    rows += [(5050, 1, [0.0] * 8), (5060, 2, []), (5070, 2, [3.0, 1.0]), (5080, 1, [3e5, -4e5] + [0.0] * 6), (5090, 2, [2e9] * 8), (5091, 2, [2.9e5, -3.9e5] + [1.0] * 6)]
    kind = "vec_id long, label int, vector array<double>, score string, block int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], kind).repartition(5)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    for block, anchors, stripe in ((1024, 4096, 8), (32, 16, 2)):
        for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("STRIPE", stripe)):
            monkeypatch.setattr(hardneg, name, value)
        got = Counter(tuple(r[c] for c in names) for r in hardneg.hard_negatives(df, 10).collect())
        assert got == brute_negatives(rows, 10)
    assert hardneg.hard_negatives(df.where("false"), 10).count() == 0
    assert hardneg.hard_negatives(df.where("vec_id = 20"), 10).count() == 0


def test_brackets_hold_the_score():
    rng = np.random.default_rng(2)
    x, a = (rng.integers(-300, 300, (n, 12)).astype(np.int32) for n in (400, 30))
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    pivots = hardneg.Pivots(x[:100], most, 8)
    norm = (a.astype(float) ** 2).sum(axis=1)
    low, high = hardneg.bracket(pivots.distances(a, True), pivots.distances(x), norm, most)
    assert ((low <= a @ x.T) & (a @ x.T <= high)).all() and (high - low).mean() < 4 * np.sqrt(norm.mean() * most)
    assert hardneg.exact(np.array([[1 << 27] * 3], np.int32), np.array([[1 << 27] * 3], np.int32)).tolist() == [[3 << 54]]


def brute_divergence(rows, least, most):
    docs = [((x[1] or ""), (x[2] or ""), ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x[0] or "")]) for x in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        v, n = len(kept), {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in own}}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        p, q = {s: p_of(c) for s, c in n.items()}, p_of(sum(n.values(), Counter()))
        for s in n:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in n if o != s))
            best = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[s][t] and p[s][t] > q[t])[:most]
            out |= {(lang, s, part, item.decode(), -f, k + 1) for part, found in (("pair", pairs), ("term", best)) for k, (f, item) in enumerate(found)}
    return out


def test_divergence_by_hand(spark):
    rng = random.Random(9)
    words = [a + b for a in ("tea", "Tea", "é", "日本", "z", "I_O", "d'or") for b in ("", "s", "X", "ß", "9k")]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(25))), rng.choice(("en", "en", "fr", None)), rng.choice("aaaabcde") if rng.random() < 0.9 else None) for _ in range(300)]
    rows += [(None, "en", "null text"), ("", "xx", "q"), ("--- 123", "xx", "r"), ("one two", "yy", "s"), ("a b İK\x00k", "en", "é"), ("tea " * 300_000, "fr", "b")] + [("tea copies", "en", "copy")] * 50
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(6)
    for least, most in ((3, 200), (1, 4)):
        got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(df, least, most).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least, most)
    assert divergence.divergence(df.where("false")).count() == 0


def test_shards_of_divergence_follow_the_rows(spark, monkeypatch):
    """Partial sums have a row for every pair of sources in every shard: more shuffle partitions may not make more of them."""
    rows = [(" ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j)}" for j in range(1, 12)), "en", f"s{i % 6}") for i in range(120)]
    df, made, saved = spark.createDataFrame(rows, "text string, lang string, source string"), [], divergence.saved

    def seen(spark, df, name):
        found = saved(spark, df, name)
        if name == "partial":
            made.append(found[0].where("part = 'pair'").count())
        return found

    monkeypatch.setattr(divergence, "saved", seen)
    monkeypatch.setattr(divergence, "LEAST_ROWS", 100)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, divergence.divergence(df).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and made[0] == made[1] > 30
    assert [divergence.shards_of(n) for n in (0, 10, 101, 10**6, 10**9)] == [1, 1, 2, 16, 4000]


def test_counts_beyond_64_bits():
    """2e10 occurrences times 10^9 don't fit in 64 bits."""
    import pyarrow as pa

    kept = pa.table({"lang": ["a", "a", "a"], "source": ["s", "s", "t"], "term": ["x", "y", "x"], "n": [2 * 10**10, 1, 5], "total": [2 * 10**10 + 5, 1, 2 * 10**10 + 5], "first": [True, True, False]})
    groups = pa.table({"lang": ["a", "a"], "source": ["s", "t"], "n": [2 * 10**10 + 1, 5], "v": [2, 2], "lang_n": [2 * 10**10 + 6] * 2})
    found = {(r["part"], r["source"], r["item"]): int(r["value"]) for r in divergence._sql(divergence._SHARD.format(most=9), kept=kept, groups=groups).to_pylist()}
    p = {("s", "x"): 1 + 10**9 * (2 * 10**10 + 1) // (2 * 10**10 + 3), ("s", "y"): 1 + 2 * 10**9 // (2 * 10**10 + 3), ("t", "x"): 1 + 6 * 10**9 // 7, ("t", "y"): 1 + 10**9 // 7}
    assert found["pair", "t", "s"] == sum((p["t", w] - p["s", w]) ** 2 // p["s", w] for w in "xy") and found["pair", "s", "t"] == sum((p["s", w] - p["t", w]) ** 2 // p["t", w] for w in "xy")
