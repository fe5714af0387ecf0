import random

import pytest
from pyspark.sql import functions as F

from lexhound.functions.similarity import Algorithm, hamming, jaro, jaro_of
from lexhound.functions.text import HYPHENS, alphanumeric_table, is_alphanumeric, is_whitespace, normalize, normalize_word
from lexhound.operators.tokenize import document_words, tokenize

WORDS = ["test-is good!", "TESTIsGood", "ÀÉ", "ΟΔΟΣ", "Σ", "ς", "İx", "áิb_-²Ⅷ", "", "日本 語", "a😀b", "ﬁ"]


def test_normalize(spark):
    assert normalize_word("test-is good!") == normalize_word("TESTIsGood") == "testisgood"
    assert normalize_word("ΟΔΟΣ") == "οδοσ" and normalize_word("áิb_-²Ⅷ") == "áิb²ⅷ"
    got = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", normalize(F.col("w")).alias("n")).collect()
    assert {r["w"]: r["n"] for r in got} == {w: normalize_word(w) for w in WORDS}
    assert all(alphanumeric_table()[ord(c)] == is_alphanumeric(c) for c in "aZ9²é Ⅷิ_-\n日😀")
    assert is_whitespace("\xa0") and is_whitespace(" ") and not is_whitespace("\x0b") and not is_whitespace("a")


def brute_tokens(text, strict=True):
    """One character at a time."""
    out, n = set(), len(text)
    words, at = [], 0
    while at < n:
        if not is_alphanumeric(text[at]):
            at += 1
            continue
        end = at
        while end < n and is_alphanumeric(text[end]):
            end += 1
        words.append((at, end))
        at = end
    size = lambda k: len(text[:k].encode())
    for k, (a, b) in enumerate(words):
        out.add((normalize_word(text[a:b]), size(a) if strict or b < n else size(n), False))
        if k + 1 < len(words):
            c, d = words[k + 1]
            if c == b + 1 and text[b] in HYPHENS and d < n:
                out.add((normalize_word(text[a:d]), size(a), True))
    return out


def test_tokenize(spark):
    rng = random.Random(1)
    texts = ["", "one", "a-b-c.", "a-b", "next- x", "a--b.", " - ", "—é–ü—.", "Next-Gen stuff", "x\ny", "été–ÉTÉ ΟΔΟΣ-a ", "日本-語 ", "İstanbul-X y"]
    texts += ["".join(rng.choice("abÉé9Σ -—.,😀\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(1000, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    for strict in (True, False):
        got: dict = {}
        for r in tokenize(df, strict_offsets=strict).collect():
            assert (r["word"], r["start"], r["is_compound"]) not in got.setdefault(r["doc_id"], set())
            got[r["doc_id"]].add((r["word"], r["start"], r["is_compound"]))
        for k, t in enumerate(texts):
            assert got.get(k, set()) == {(w, s, c) for w, s, c in brute_tokens(t, strict)}, repr(t)
    assert [(w, s) for w, s, _ in sorted(brute_tokens("a-b-c."), key=lambda x: (x[1], x[0]))] == [("a", 0), ("ab", 0), ("b", 2), ("bc", 2), ("c", 4)]
    assert tokenize(df.limit(0)).count() == 0
    grouped = {(r["doc_id"], r["word"]): r["positions"] for r in document_words(df).collect()}
    want: dict = {}
    for k, t in enumerate(texts):
        for w, s in sorted({(w, s) for w, s, _ in brute_tokens(t)}):
            want.setdefault((k, w), []).append(s)
    assert grouped == want


def test_a_very_long_text(spark):
    text = "word " * 500_000
    got = tokenize(spark.createDataFrame([(1, text), (2, "x" * 1_000_000)], "doc_id long, text string"))
    assert got.groupBy("doc_id").agg(F.count("*"), F.max("start")).orderBy("doc_id").collect() == [(1, 500_000, 2_499_995), (2, 1, 0)]


def brute_jaro(a, b):
    if not a or not b:
        return float(a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == c and not used[j]:
                used[j] = True
                mine.append(c)
                break
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    m = len(mine)
    t = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3 if m else 0.0


def test_similarities(spark):
    rng = random.Random(2)
    words = ["", "martha", "marhta", "dwayne", "duane", "é", "😀a", "a"] + ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    for q in ["", "martha", "abcabé", "a", "ba"]:
        assert jaro_of(q, words).tolist() == pytest.approx([brute_jaro(q, w) for w in words])
    assert jaro_of("martha", ["marhta"])[0] == pytest.approx(0.9444444)
    pairs = [(a, b) for a in words[:12] for b in words]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", hamming(F.col("a"), F.col("b")).alias("h"), jaro(F.col("a"), F.col("b")).alias("j"), Algorithm.EXACT.similarity(F.col("a"), F.col("b")).alias("e"))
    for r in df.collect():
        a, b = r["a"], r["b"]
        d = sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
        assert r["h"] == pytest.approx(1 / (1 + d / min(len(a), len(b))) if a and b else 0)
        assert r["j"] == pytest.approx(brute_jaro(a, b)) and r["e"] == float(a == b)
    assert Algorithm.default() is Algorithm.JARO
