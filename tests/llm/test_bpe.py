import base64
import hashlib
import pickle
import random

import pytest
from pyspark.sql import functions as F

from lexhound.llm.bpe import Encoder, build_vocabulary, decode, encode, merge, read_ranks
from lexhound.llm.queries_bpe import tokens

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_perfect_hash():
    v = build_vocabulary(read_ranks(PATH))
    assert all(v.find(t) == r for t, r in RANKS.items())
    assert sorted(v.slot_id.tolist()) == sorted(RANKS.values()) and pickle.loads(pickle.dumps(v)).find(b"the") == RANKS[b"the"]
    rng = random.Random(1)
    for _ in range(5000):
        x = rng.randbytes(rng.randint(0, 6))
        assert v.find(x) == RANKS.get(x, -1)
    assert build_vocabulary({}).find(b"a") == -1


def texts():
    rng = random.Random(2)
    got = ["", " ", "Hello  world's\n\n\t1234 éàü ñ", "<|endoftext|> ordinary", "\U0001f600" * 9, "à‍\x00 b", "x" * 3000, " " * 500, "ab" * 700, "\r\n \r\n"]
    return got + ["".join(rng.choice("abcdefg é,.'\n1$€") for _ in range(rng.randint(1, 900))) for _ in range(60)]


def test_ids_are_those_of_the_library():
    own = Encoder(build_vocabulary(RANKS), P.PATTERN)
    for t in texts():
        assert own.encode([t])[0].tolist() == THEIRS.encode_ordinary(t)
    long = "über the 1,234 words\n" * 60_000  # split lazily
    assert own.encode([long])[0].tolist() == THEIRS.encode_ordinary(long)
    ids, at = own.encode([None, "a b", "", "c"])
    assert at.tolist() == [0, 0, 2, 2, 3] and len(ids) == 3
    assert merge([], [], {}.get, 1) == []


def test_the_hash_resolves_what_is_in_the_vocabulary():
    own = Encoder(build_vocabulary(RANKS), P.PATTERN)
    text = "the people of the town zzkrtw had to carry water qqxv zzkrtw " * 50
    found = own.split.findall(text)
    assert own.encode([text, text])[0].tolist() == 2 * THEIRS.encode_ordinary(text)
    known = sum(t.encode() in RANKS for t in found)
    others = [t for t in found if t.encode() not in RANKS]
    assert own.by_hash == 2 * known and own.by_merging == len(set(others)) and own.by_memory == 2 * len(others) - own.by_merging
    assert not set(own.place) & {t for t in found if t.encode() in RANKS}
    with pytest.raises(ValueError, match="single bytes"):
        build_vocabulary({b"a": 0})


def test_very_long_pre_tokens():
    own, rng = Encoder(build_vocabulary(RANKS), P.PATTERN), random.Random(4)
    for n in (1000, 70_000):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        assert own.encode([f"a {word} b"])[0].tolist() == THEIRS.encode_ordinary(f"a {word} b")


def test_white_space_of_all_kinds():
    own, rng = Encoder(build_vocabulary(RANKS), P.PATTERN), random.Random(3)
    for n in range(1, 9):
        for _ in range(1500):
            t = "".join(rng.choice(" \n\n  ab'st.1\t\r\xa0\u2003\x1c\x85") for _ in range(n))
            assert own.encode([t])[0].tolist() == THEIRS.encode_ordinary(t), repr(t)
    for _ in range(300):
        t = "".join(rng.choice([" ", "\n", " ", "it's", "été", "12", ",", "  ", "\n ", " \n", "\t"]) for _ in range(200))
        assert own.encode([t])[0].tolist() == THEIRS.encode_ordinary(t), repr(t)


def test_frames(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())] + [(900, None, None, 2), (0, "", "x", 1), (None, "no id", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, k0 int")
    got = decode(encode(df, PATH, P.PATTERN), PATH).collect()
    want = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == THEIRS.encode_ordinary(want[r["doc_id"]][1] or "") and bytes(r["decoded"]).decode() == (want[r["doc_id"]][1] or "")
    digest = {r["doc_id"]: r for r in tokens(df, ["doc_id"]).collect()}
    for d, t, *_ in rows:
        ids = THEIRS.encode_ordinary(t or "")
        r = digest[d]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(),
        )
    assert encode(df.limit(0), PATH, P.PATTERN).count() == 0
    bad = spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        decode(bad, PATH).count()
    assert decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).select(F.length("decoded")).first()[0] == 0
