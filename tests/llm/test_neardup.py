"""Near duplicates of the pipeline against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from tidemark.llm import neardup


def brute(texts):
    def parts(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    found = {d: parts(t) for d, t in texts.items()}
    root = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            x, y = found[a], found[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if r == d}


def test_near_duplicates_are_those_of_jaccard_08(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts, quoted = {}, [word() for _ in range(60)]
    for _ in range(12):  # copies with one to nine edits each: on both sides of 0.8
        base = [word() for _ in range(rng.choice((12, 60, 200)))]
        for k in range(8):
            copy = list(base)
            for i in rng.sample(range(len(base)), min(k, len(base) // 4)):
                copy[i] = word()
            texts[len(texts)] = " ".join(copy)
    for _ in range(60):  # others that only share a passage
        texts[len(texts)] = " ".join([word() for _ in range(30)] + quoted)
    for _ in range(40):  # a chain: each like the next, the ends unlike
        base[rng.randrange(len(base))] = word()
        texts[len(texts)] = " ".join(base)
    texts |= {900: None, 901: "", 902: "A b", 903: "a  B", 904: "a b c"}
    rows = [(d, t, "en", "s", 1) for d, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == brute(texts)
    for stars, tile in ((0, 3), (1, 2048)):  # what hubs leave to the tiles
        found = neardup.near_duplicates(df, stars=stars, tile=tile).collect()
        assert {r.doc_id for r in found if r.doc_id == r.component_id} == got
    assert corpus_pipeline.near_duplicates(spark, df.where("false"), "").count() == 0


def test_what_fingerprints_and_keys_lose_at_the_threshold():
    """Pairs at exactly 0.8: of 9 shingles in all one is apart on one side, or several of many."""
    rng = np.random.default_rng(7)
    lost = {}
    for size in (4, 8, 36, 400):
        far = apart = 0
        for _ in range(3000):
            whole = np.unique(rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            a, b = np.sort(whole[rng.permutation(len(whole))[:size]]), whole
            assert 5 * len(a) == 4 * len(b)
            far += (neardup.fingerprint(a) ^ neardup.fingerprint(b)).bit_count() > neardup.RADIUS and len(b) > neardup.FEW
            apart += not (neardup.keys_of(a) == neardup.keys_of(b)).any()
        lost[size] = (far, apart)
    assert all(far <= 2 and apart <= 2 for far, apart in lost.values()), lost


def test_large_groups_are_split_by_key(spark):
    """Texts of few shingles and a chain beyond a tile: tiles of three."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        base = list(base)
        base[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    short = [f"s{i}" for i in range(9)]
    rows += [(1000, " ".join(short)), (1001, " ".join(short[:8]))] + [(2000 + i, " ".join(rng.sample(short, 8))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(dict(rows))
    for stars, tile in ((0, 3), (0, 20), (2, 3)):
        found = neardup.near_duplicates(df, stars=stars, tile=tile).collect()
        assert {r.doc_id for r in found if r.doc_id == r.component_id} == want
