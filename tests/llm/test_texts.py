"""Operators on texts against brute-force versions, with the awkward rows each must bear."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, graphs, langid, linededup, lmscore, mixing, quality, rans, simhash, toxicity
from tidemark.llm.queries import BPE_JSON, BPE_RANKS

ODD = [None, "", " ", "\n\n", "a", "the cat", "x" * 3000, " " * 500, "12 34\t é! ", "ÀB c\r\nd", "the cat sat on the mat " * 300, "the cat", "日本語 テキスト", "don't  stop\x00now\x1c!"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["ab", "cd", "ef", "gh", "Ij"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 5}", 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score int, ids string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_bpe_equals_the_library_however_texts_are_cut(docs, empty):
    enc = bpe.encoding(BPE_RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in docs.collect()}
    for cut in (bpe.SPLIT_CHARS, 7):
        got = bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN, split_chars=cut).collect()
        assert len(got) == len(rows)
        for r in got:
            text = rows[r.doc_id].text or ""
            assert list(r.ids) == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    one = bpe.digests(bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN)).where("doc_id = 5").first()
    ids = enc.encode_ordinary("the cat")
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"the cat").hexdigest())
    assert bpe.round_trip(empty, BPE_RANKS, public_tokenizers.PATTERN).count() == 0
    assert isinstance(enc, tiktoken.Encoding)


def test_safe_parts_are_safe():
    enc, rng = bpe.encoding(BPE_RANKS, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab Z'.,!s\n\té12中 \x1c") for _ in range(rng.randrange(1, 60)))
        parts = list(bpe.safe_parts(text, 3))
        assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_rans_files(spark, docs, empty, tmp_path):
    rans.write(docs, str(tmp_path / "d"), BPE_JSON, 2, files=3)
    tok, start = rans.tokenizer(BPE_JSON), 0
    got = {r.doc_id: r for r in rans.read(spark, str(tmp_path / "d")).collect()}
    digests = {r.doc_id: r for r in rans.read_digests(spark, str(tmp_path / "d")).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert list(got[r.doc_id].ids) == ids and got[r.doc_id].start == start
        d = digests[r.doc_id]
        assert (d.start, d.n_tokens, d.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rans.write(empty, str(tmp_path / "e"), BPE_JSON, 2)
    assert rans.read_digests(spark, str(tmp_path / "e")).count() == 0


def test_rans_blocks_decode_from_any_checkpoint_and_notice_damage():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5000).clip(1, 999).astype(np.uint32)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=1000), 12), 12, lanes=16, checkpoint=20)
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all() and (coder.decode(block, 3) == ids[960:1280]).all()
    assert len(block) < 2 * len(ids) and coder.decode(coder.encode(ids[:0])).size == 0 and (coder.decode(coder.encode(ids[:1])) == ids[:1]).all()
    with pytest.raises(ValueError, match="checksum|block"):
        coder.decode(block[:-9] + bytes([block[-9] ^ 255]) + block[-8:])
    f = rans.frequencies(np.array([1, 0, 10**9, 3]), 4)
    assert f.sum() == 16 and f[1] == 0 and f[0] >= 1


def brute_components(prints, radius=2):
    keys = sorted(set(prints.values()))
    root = {k: k for k in keys}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    first = {}
    for d in sorted(prints):
        first.setdefault(find(prints[d]), d)
    return {d: first[find(p)] for d, p in prints.items()}


@pytest.mark.parametrize("tile,lanes", [(8192, (2, 4, 8)), (4, (8,)), (3, (2, 4))])
def test_simhash_components(spark, docs, tile, lanes):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") * 2 for _ in range(400)]
    near = [" ".join(w if rng.random() > 0.004 else "zz" for w in base) for _ in range(80)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id long, text string"))
    want = {}
    for r in df.collect():
        w = [x.lower() for x in (r.text or "").encode().split()]
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = simhash.near_duplicates(df, tile=tile, lanes=lanes).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == brute_components(want)


def test_components_by_stars_and_at_once(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(a + rng.integers(0, 3))) for a in rng.integers(0, 300, 260)]
    links = spark.createDataFrame(pairs, "u long, v long")
    one, two = (sorted(map(tuple, graphs.components(spark, links, n).collect())) for n in (10**6, 0))
    assert one == two and all(root <= node for node, root in one)
    assert graphs.components(spark, links.where("false")).count() == 0


def test_line_dedup_both_ways(spark):
    rows = [(i, f"shared line\nown {i}\n\n  shared line  " if i < 12 else f"own {i}\ntwice {i // 2}", f"s{i % 10}", "extra") for i in range(20)] + [(50, None, "s1", "e"), (51, "", None, "e"), (52, "shared line", None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines_removed string")
    wide = linededup.spread(df)
    assert [(r.sites, r.first) for r in wide.collect()] == [(10, 0)]
    ways = [{r.doc_id: (r.text, r.n_lines_removed) for r in linededup.stripped(df, wide, broadcast_lines=n).collect()} for n in (100, 0)]
    assert ways[0] == ways[1]
    assert ways[0][0] == ("shared line\nown 0\n", 1) and ways[0][3] == ("own 3\n", 2) and ways[0][15][1] == 0 and ways[0][50] == (None, 0) and ways[0][52] == ("", 1)
    near = linededup.spread(df, least_sites=11, band=0.5)  # estimated near the threshold, counted below it
    assert near.count() == 0


def test_line_dedup_both_ways_with_repeated_and_null_keys(spark):
    rows = [(i, f"shared line\nown {i}", f"s{i}") for i in range(9)] + [(k, t, "s1") for k in (3, None, None) for t in ("shared line\nother", "shared line\nother", "shared line\nown 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = linededup.spread(df)
    ways = [sorted(map(str, linededup.stripped(df, wide, broadcast_lines=n).collect())) for n in (100, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == len(rows)


def test_language_backs_off_to_characters(spark, docs, empty):
    rows = [(i, "der hund und die katze schlafen" if i % 2 else "the dog and the cat sleep", "de" if i % 2 else "en") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("hund und")[0] == "de" and model.predict("the cats")[0] == "en" and model.predict("schlafend")[0] == "de"
    assert model.predict("123 !") == ("und", 0.0) and model.predict(None) == ("und", 0.0)
    for r in langid.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        lang, score = model.predict(r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score) and 0 <= r.score <= 1
    nothing = langid.fit(docs.where("lang = 'none'").select("doc_id", "text", "lang"))
    assert nothing.predict("word") == ("und", 0.0) and langid.predict(empty, model).count() == 0


def brute_quality(text):
    w = text.encode().split()
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in quality.SYMBOLS for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(20, 60)] + [(None, 1)], "doc_id long, quality int")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = quality.rules(docs, labels).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    assert len(got) == len(texts) and quality.rules(empty, labels).count() == 0
    assert {r.score for r in quality.rules(docs, labels.where("false")).where("score is not null").collect()} == {0.0}


def test_quality_ratio_equals_a_direct_count(spark, docs):
    cache = quality.hash_cache(quality.SEED)
    total = quality.counts(docs, docs.where("doc_id % 2 = 0").select("doc_id"))
    want = np.zeros_like(total)
    for r in docs.collect():
        for b in quality.ngrams(quality.looked_up(cache, (r.text or "").encode().split())) if (r.text or "").split() else []:
            want[0, b] += 1
            want[1, b] += r.doc_id % 2 == 0
    assert (total == want).all()


def test_toxicity_folds_excepts_and_ranks(spark, docs, empty):
    rng = random.Random(3)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    text = lambda *more: " ".join(rng.sample(words, 30) + list(more))
    rows = [(i, text("vilewort", "vilewort")) for i in range(120)] + [(i, text()) for i in range(120, 500)] + [(i, text("vilewort", "garden")) for i in range(500, 540)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(df, spark.createDataFrame([(i, int(i < 120)) for i, _ in rows], "doc_id long, toxic int"))
    assert any(k.strip().startswith("vile") for k in lexicon.weights) and any("garden" in p for p in lexicon.exceptions)
    assert lexicon.score(text("vilewort", "and", "vilewort")) > 0.3 > lexicon.score(text())
    assert lexicon.score("V1LEW0RT " + text("vіlewоrt")) > 0.3  # digits, and Cyrillic letters
    assert lexicon.score(text("vilewort", "garden")) < lexicon.score(text("vilewort", "vilewort"))
    got = toxicity.score(docs, lexicon).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and toxicity.score(empty, lexicon).count() == 0
    assert toxicity.learn(df, docs.where("false").select("doc_id", F.lit(1).alias("toxic"))).score("vilewort") == 0


def test_mixing_meets_its_targets(spark, docs, empty):
    rows = [(i, " ".join([("good", "poor", "vile")[i % 3] + str(j % 7) for j in range(20 + i % 50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, ("a", "b", "c")[i % 3]) for i in range(0, 300, 2)], "doc_id long, domain string")
    got = mixing.mixed_rates(df, labels, {"a": 0.7, "b": 0.25, "c": 0.05}).collect()
    tokens = np.array([r.n_tokens for r in got], float)
    p, rate = np.array([r.posteriors for r in got]), np.array([r.rate for r in got])
    assert (rate >= 0).all() and np.allclose((tokens * rate) @ p / tokens.sum(), [0.7, 0.25, 0.05], atol=1e-6)
    right = np.mean([("a", "b", "c")[int(np.argmax(r.posteriors))] == ("a", "b", "c")[r.doc_id % 3] for r in got])
    assert right > 0.95
    n = spark.range(4000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(n[0] - 1.25) < 0.03 and n[1:] == (1, 2)
    assert mixing.mixed_rates(empty, labels, {"a": 1.0, "b": 1.0}).count() == 0


def test_mixing_meets_targets_of_overlapping_posteriors(spark):
    rng = np.random.default_rng(8)
    p = np.exp(rng.standard_normal((3000, 3)) * 1.5 + np.log([0.05, 0.9, 0.05]))
    p /= p.sum(axis=1, keepdims=True)
    n = rng.integers(1, 400, len(p))
    soft = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(len(p))], "doc_id long, n_tokens long, posteriors array<double>")
    fit = mixing.fit_rates(soft, [0.5, 0.4, 0.1])
    rate = np.array([r.rate for r in mixing.rated(soft, fit[0]).orderBy("doc_id").collect()])
    assert (rate >= 0).all() and np.allclose((n * rate) @ p / n.sum(), [0.5, 0.4, 0.1], atol=1e-6)
    with pytest.warns(UserWarning, match="targets"):  # no document is surely of one domain
        _, reached, aim = mixing.fit_rates(soft.where("posteriors[0] < 0.5"), [1.0, 0.0, 0.0])
    assert reached[0] < aim[0] * 0.9


def test_lm_learns_from_every_document(spark):
    rest = spark.range(300).where(F.pmod(F.xxhash64(F.lit("lm"), "id"), F.lit(4)) != 0).select(F.col("id").alias("doc_id"), F.lit("a b c d " * 20).alias("text"))
    vocabulary = lmscore.vocabulary_of(lmscore.counted(rest))
    weights = lmscore.trained(rest, vocabulary)
    assert np.abs(weights["U"] - lmscore.gru.initial(vocabulary.counts)["U"]).max() > 1e-4


def test_lm_is_a_distribution_and_its_base_is_exact(spark, docs):
    train = docs.where("doc_id % 3 <> 0")
    got = {r.doc_id: r for r in lmscore.score(docs, train, head=4, vocabulary=4, sample=1).collect()}
    c = Counter()
    for r in train.collect():
        c.update(lmscore.tokens(r.text))
        c[None] += 1
    n, v = sum(c.values()), len(c)
    for r in docs.collect():
        seq = [*lmscore.tokens(r.text), None]
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(seq), sum(c[w] > 0 for w in seq), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in seq))
        assert g.score < 0
    counts = lmscore.counted(train)
    vocabulary = lmscore.vocabulary_of(counts, head=4, vocabulary=4)
    shares = [(c[w] + 1) / 10**vocabulary.rare for w in c if w is not None and w not in [x for x, i in zip(vocabulary.head, vocabulary.id, strict=False) if i >= 2]]
    assert sum(shares) + 1 / 10**vocabulary.rare == pytest.approx(1)
    assert lmscore.score(docs.where("false"), train, sample=1).count() == 0


def test_lm_score_is_the_product_over_tokens(spark, docs):
    """The composed score against a loop over tokens in double precision: states carried through the text, class times word, a rare word's share."""
    train = docs.where("doc_id % 3 <> 0")
    counts = lmscore.counted(train)
    known = lmscore.vocabulary_of(counts, head=6, vocabulary=6)
    weights = lmscore.trained(train, known, sample=1)
    p = {k: v.astype(float) for k, v in weights.items()}
    c = {r.word: r.c for r in counts.collect()}
    own = {bytes(w): int(i) for w, i in zip(known.head, known.id, strict=False)}
    per, size = lmscore.gru.PER_CLASS, p["U"].shape[0]
    sigmoid, soft = lambda x: 1 / (1 + np.exp(-x)), lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())

    def slow(text):
        h, last, total = np.zeros(size), lmscore.END, 0.0
        for w in [*lmscore.tokens(text), b""]:
            gx, gu = p["T"][last], h @ p["U"]
            z, r = sigmoid(gx[:size] + gu[:size]), sigmoid(gx[size : 2 * size] + gu[size : 2 * size])
            n = np.tanh(gx[2 * size :] + r * gu[2 * size :])
            h = (1 - z) * n + z * h
            i = lmscore.END if w == b"" else own.get(w, lmscore.RARE)
            k = i // per
            total += soft(h @ p["C"] + p["c"])[k] / np.log(10)
            total += soft(p["W"][k * per : (k + 1) * per] @ h + p["w"][k * per : (k + 1) * per])[i - k * per] / np.log(10)
            if i == lmscore.RARE:
                total += np.log10(c.get(w, 0) + 1) - known.rare
            last = i
        return total

    got = {r.doc_id: r.score for r in lmscore.scored(docs, counts, known, weights).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(slow(r.text), rel=2e-4, abs=1e-3)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_lm_words_of_many_texts_are_those_of_each(kind):
    ascii_and_more = "".join(f"A{chr(i)}b" for i in range(128)) + "x\u0085Y\u00a0z \u2003\u00c4"
    some = ["left out", " \t Aa\r\n  bB\x0b\x0c", None, "", " ", "\u0130I", ascii_and_more, "end "]
    flat, n = lmscore.words_of(pa.array(some, kind).slice(1))
    each = [lmscore.tokens(x) for x in some[1:]]
    assert n.tolist() == [len(x) for x in each] and flat.to_pylist() == [w for x in each for w in x]
    place = lmscore.rows_in(pa.array([b"bb", b"aa"]), flat)
    assert place.tolist() == [{b"bb": 0, b"aa": 1}.get(w, -1) for x in each for w in x]
    assert [x.tolist() for x in lmscore.sequences(np.arange(5, 8), np.array([2, 0, 1]))] == [[5, 6, lmscore.END], [lmscore.END], [7, lmscore.END]]
    none, n = lmscore.words_of(pa.array([], kind))
    assert len(none) == len(n) == 0
