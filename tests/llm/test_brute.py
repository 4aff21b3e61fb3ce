"""Operators against independent versions: counts by hand, naive searches, a fresh tokenizer, a plain solver; stages on awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import ann, langid, mixing, neardup, rans, toxicity
from tidemark.llm.queries import BPE_JSON


def test_tokens_are_those_of_a_fresh_tokenizer():
    fresh, parts, rng = Tokenizer.from_file(BPE_JSON), rans.Parts(BPE_JSON, 2), random.Random(8)
    pieces = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "\n\n", "the", "Don't", "x1", "é", "中文", "\t", "\x00", "...", "<", "|>", "　", " "]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", " <|endoftext|>\n<|endoftext|> a"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    ids, n = parts.batch(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == fresh.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_parts_that_come_again_outlast_a_full_store(monkeypatch):
    fresh, parts, rng = Tokenizer.from_file(BPE_JSON), rans.Parts(BPE_JSON, 2), random.Random(9)
    monkeypatch.setattr(rans, "_PARTS", 40)
    made, add = [], parts._add
    monkeypatch.setattr(parts, "_add", lambda new: (made.extend(new), add(new)))
    for k in range(40):
        texts = [" ".join(f"x{rng.randrange(10**6)}é" for _ in range(9)), "q <|endoftext|>\n" + "z" * 60, None] + ["a word that comes often"] * (k % 3 > 0)
        ids, n = parts.batch(texts)
        for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == fresh.encode(text or "", add_special_tokens=False).ids + [2], repr(text)
    assert Counter(made)["often"] == 1 and len(parts.rows) < 60


def test_parts_of_odd_texts_are_those_of_others(monkeypatch):
    """A text with two blanks in a row, or one at its end, shares the parts of plain texts; blanks are those of Python's \\s."""
    fresh, parts = Tokenizer.from_file(BPE_JSON), rans.Parts(BPE_JSON, 2)
    made, add = [], parts._add
    monkeypatch.setattr(parts, "_add", lambda new: (made.extend(new), add(new)))
    texts = ["a word often", None, "q\n\n word often\n word  often ", "", "word often\u2003\u3000 often", "\x85 often\x1c\n", " word\tq often\nq", "e \x00often"]
    for some in ([texts[0]], texts[1:], texts):
        ids, n = parts.batch(some)
        for text, got in zip(some, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == fresh.encode(text or "", add_special_tokens=False).ids + [2], repr(text)
    assert max(Counter(made).values()) == 1 and "\0 often" not in made and "\0 word" not in made
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert [x for x, odd in zip(every, pc.match_substring_regex(pa.array(every), rans._SPACE).to_pylist(), strict=True) if odd] == [x for x in every if re.match(r"\s", x)]


def test_blocks_end_with_the_document_that_fills_them(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7)) for i in range(200)], "doc_id long, text string")
    rows = rans.blocks(docs, BPE_JSON, 2, files=1, block_ids=50).orderBy("block").collect()
    assert [k for r in rows for k in r["keys"]] == list(range(200)) and [r.block for r in rows] == list(range(len(rows)))
    assert all(sum(r.lengths) >= 50 > sum(r.lengths[:-1]) for r in rows[:-1]) and len(rows) > 20
    assert [r.start for r in rows] == [0, *np.cumsum([sum(r.lengths) for r in rows])[:-1]] and all(len(r.ids) == 2 * sum(r.lengths) for r in rows)


def test_language_by_hand(spark):
    rng = random.Random(4)
    stems = {"aa": ["kato", "melin", "sura", "ovi"], "bb": ["kratz", "melun", "sturm", "ove"], "cc": ["ïlha", "çava", "melo", "sur"]}
    text = lambda lang: " ".join(rng.choice(stems[lang]) + rng.choice(["", "a", "en", "s"]) for _ in range(rng.randrange(1, 12)))
    train = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    asked = [text(rng.choice("abc") * 2) + rng.choice(["", " zzz", " KATOEN ½", " x²y"]) for _ in range(60)] + ["½ ² Ⅷ ①", "12 !", "", None, "q", "日本 kato"]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))

    words = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    counts = {n: Counter() for n in range(6)}
    for _, t, lang in train:
        for w in words(t):
            counts[0][lang, w] += 1
            for n in range(1, 6):
                x = f"<{w}>" if n > 1 else w
                for i in range(len(x) - n + 1):
                    counts[n][lang, x[i : i + n]] += 1
    kinds = {n: {g for _, g in c} for n, c in counts.items()}
    total = {(n, lang): sum(v for (k, _), v in c.items() if k == lang) for n, c in counts.items() for lang in stems}
    log = lambda n, lang, g: math.log((counts[n][lang, g] + 0.5) / (total[n, lang] + 0.5 * (len(kinds[n]) + 1)))

    def score(word, lang):
        if word in kinds[0]:
            return log(0, lang, word)
        for n in (5, 4, 3, 2, 1):
            x = f"<{word}>" if n > 1 else word
            found = [g for g in (x[i : i + n] for i in range(len(x) - n + 1)) if g in kinds[n]]
            if found:
                return sum(log(n, lang, g) for g in found) / len(found)
        return 0.0

    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for r in langid.predict(df, model).collect():
        w = words(asked[r.doc_id])
        if not w:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = {lang: sum(score(x, lang) for x in w) for lang in stems}
        best = max(sorted(stems), key=lambda x: sums[x])
        assert sums[r.lang_pred] == pytest.approx(sums[best], abs=1e-4)
        assert r.score == pytest.approx(1 / sum(math.exp(v - sums[r.lang_pred]) for v in sums.values()), abs=1e-4)


def test_toxicity_by_hand(spark):
    rng = random.Random(6)
    plain = [a + b + c + d for a in "bdfgk" for b in "aeiou" for c in "lmnr" for d in ("", "ot")]
    text = lambda *more: " ".join(rng.sample(plain, 25) + list(more))
    rows = [(i, text(rng.choice(["vilewort", "viler", "grimbad"]))) for i in range(150)] + [(i, text()) for i in range(150, 500)] + [(i, text("vilewort", "garden")) for i in range(500, 530)]
    rows += [(i, rows[0][1]) for i in range(600, 680)]  # copies of one toxic document count once, labels of none not at all
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "V1LEW0RT vіlеwort"), (903, "garden vilewort")], "doc_id long, text string")
    labels = {i: int(i < 150 or i >= 600) for i, _ in rows} | {i: 1 for i in range(5000, 5040)}
    lexicon = toxicity.learn(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    bare = toxicity.learn(df.where("doc_id < 250").repartition(8), spark.createDataFrame([(i, int(i < 150)) for i in range(250)], "doc_id long, toxic int"))
    assert bare.weights and not bare.exceptions  # no task finds a phrase in clean documents
    seen = {y: Counter() for y in (0, 1)}
    unique = {(t, labels[i]) for i, t in rows}
    for t, y in unique:
        seen[y].update({e for w in set(t.split()) if len(w) > 2 for e in [f" {w} ", *(f" {w[:k]}" for k in range(4, 10) if len(w) >= k)]})
    n1, n0 = (sum(label == y for _, label in unique) for y in (1, 0))
    assert lexicon.weights and all(w == pytest.approx(math.log((seen[1][e] + 0.5) / (n1 + 1)) - math.log((seen[0][e] + 0.5) / (n0 + 1))) for e, w in lexicon.weights.items())

    def naive(text):
        words = toxicity.folded(text).split()
        total = 0.0
        for i, w in enumerate(words):
            best = max((v for e, v in lexicon.weights.items() if (e.endswith(" ") and e.strip() == w) or (not e.endswith(" ") and w.startswith(e[1:]))), default=0.0)
            around = {" ".join(words[i - 1 : i + 1]) if i else None, " ".join(words[i : i + 2]) if i + 1 < len(words) else None}
            if best > 0 and not lexicon.exceptions & around:
                total += best
        a, b, c = lexicon.curve
        return 1 / (1 + math.exp(-(a + b * total / max(50, len(words)) + c * math.log1p(total))))

    texts = {r.doc_id: r.text for r in df.collect()}
    for r in toxicity.score(df, lexicon).collect():
        assert r.score == pytest.approx(naive(texts[r.doc_id])), r.doc_id


@pytest.mark.parametrize("shares", [(0.6, 0.3, 0.1), (0.9, 0.08, 0.02), (1.0, 0.0, 0.0)])
def test_rates_against_a_plain_solver(spark, shares):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([3, 6, 1], 3000)
    n = rng.integers(0, 300, len(p)).astype(float)
    soft = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(len(p))], "doc_id long, n_tokens long, posteriors array<double>")
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        steps, reached, aim = mixing.fit_rates(soft, list(shares))
    rate = mixing.rates_of(p, steps)
    assert (rate >= 0).all() and np.allclose((n * rate) @ p, reached, rtol=1e-9)
    # plain projected gradient on the same squares, with the tokens as the metric
    r, top = np.ones(len(p)), np.linalg.eigvalsh((p.T * n) @ p / n.sum()).max()
    for _ in range(4000):
        r = np.maximum(0, r - p @ (((n * r) @ p - aim) / n.sum()) / top)
    plain = (((n * r) @ p - aim) ** 2).sum()
    assert ((reached - aim) ** 2).sum() <= plain * 1.001 + (1e-6 * n.sum()) ** 2


def test_posteriors_by_hand_and_labels_of_absent_documents(spark):
    rows = [(i, " ".join([("good", "poor")[i % 2] + str(j % 5) for j in range(10)])) for i in range(80)] + [(100, None), (101, "unheard of")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = mixing.fit_classifier(df, spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "doc_id long, domain string"), ["a", "b"])
    cache = mixing.hash_cache(mixing.SEED)
    got = {r.doc_id: r for r in mixing.memberships(df, model).collect()}
    for i, t in rows:
        x = model.bias.copy()
        n = Counter(int(mixing.mixed(np.array([cache[w]]))[0] & np.uint64(mixing.BUCKETS - 1)) for w in (t or "").encode().split())
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in n.values())) or 1
        for b, c in n.items():
            x = x + model.weights[b] * math.log1p(c) / norm
        want = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert got[i].n_tokens == len((t or "").split()) and list(got[i].posteriors) == pytest.approx(list(want), abs=1e-5)
    absent = mixing.mixed_rates(df, spark.createDataFrame([(7000, "a"), (7001, "b")], "doc_id long, domain string"), {"a": 0.5, "b": 0.5}).collect()
    assert all(list(r.posteriors) == [0.5, 0.5] and r.rate == pytest.approx(1) for r in absent)


def test_rounds_make_the_graph_better(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 64)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((5000, 24)) @ np.diag(np.linspace(1.5, 0.2, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = list(range(0, 5000, 100))
    near = {q: set(np.argsort(-(x @ x[q]))[:21].tolist()) - {q} for q in asked}
    recall = {}
    for rounds in (0, 4):
        index = ann.build(spark, ann.points(df), k=16, rounds=rounds)
        lists = {r.p: set(r.near) for r in index.graph.collect()}
        assert len(lists) == 5000
        recall[rounds] = np.mean([len(lists[q] & near[q]) / 16 for q in asked])
    assert recall[4] > recall[0] + 0.1 and recall[4] > 0.6
    found = ann.search(spark, index, df.where("vec_id % 100 = 0").selectExpr("vec_id AS q"), beam=200, opened=50)  # far fewer than the points
    hit = np.mean([len(set(r.near) & near[r.q]) / 20 for r in found.collect()])
    assert hit > 0.85


AWKWARD = [
    (1, "the cat sat on the mat and the dog lay on the rug", "en", "s1"), (1, "the cat sat on the mat and the dog lay on the rug", "en", "s1"), (2, None, "en", "s2"), (3, "", None, None), (4, "12 ½ !", "en", "s1"), (None, "the dog and the cat are here again", "en", "s3"),
    (5, "der hund und die katze schlafen auf dem teppich", "de", "s4"), (6, "the dog and the cat " * 60_000, "en", "s1"), (7, "der hund \n\n und die katze", "de", "s5"), (8, "the cat sat on the mat and the dog lay on the rug", None, "s6"),
]


def test_stages_on_awkward_rows(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, _language string, n_lines_removed int, _rate double, _copy string, _removed string, _lines string, p long"
    rows = [(*r, "x", 3, 0.5, "y", "z", "w", 9) for r in AWKWARD]
    docs = spark.createDataFrame(rows, names)
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, None, 1), (None, 1, 1), (4000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, str(tmp_path))
    for name in ("language", "lines", "near_duplicates", "mixing"):
        out = run(name, docs)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all((r._language, r.n_lines_removed, r._rate, r._copy, r._removed, r._lines, r.p) == ("x", 3, 0.5, "y", "z", "w", 9) for r in kept), name
        ids = Counter(r.doc_id for r in kept)
        if name == "language":
            assert not {2, 3, 4} & set(ids) and ids[1] in (0, 2)
        if name == "lines":
            assert len(kept) == len(rows) and {r.text for r in kept if r.doc_id == 2} == {None}
        if name == "near_duplicates":  # 1 and 8 are equal; texts without words are one
            assert ids[1] == 2 and 8 not in ids and 2 in ids and 3 not in ids and ids[None] == 1
        assert run(name, docs.where("false")).count() == 0, name
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert run("language", unlabelled).count() == sum(bool(r[1]) for r in AWKWARD)
    encoded = run("bpe", docs).collect()
    assert len(encoded) == len(rows) and all(r.decodes for r in encoded) and run("bpe", docs.where("false")).count() == 0


def test_fingerprints_of_like_sets_are_near():
    rng = np.random.default_rng(1)
    apart = []
    for n in (12, 100, 900):
        for _ in range(120):
            both = rng.integers(0, 1 << 63, (10 * n) // 9 + 1, dtype=np.uint64)
            k = len(both) // 10  # each lacks a tenth of the whole: a Jaccard of 0.8
            a, b = both[k:], np.concatenate([both[:k], both[2 * k :]])
            apart.append((neardup.fingerprint(a) ^ neardup.fingerprint(b)).bit_count())
            assert np.intersect1d(neardup.keys_of(a), neardup.keys_of(b)).size
    assert np.mean(np.array(apart) <= neardup.RADIUS) > 0.98
