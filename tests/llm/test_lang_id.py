import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lexhound.llm.lang_id import BOUND_SHARE, BOUND_TIMES, bounds, build, code_lengths, count_grams, fit, keep_known, predict, quantiles
from lexhound.llm.queries_lang_id import training_rows
from lexhound.llm.common import text_buffers
import pyarrow as pa

WORDS = {"en": "the of and to with that this was for have".split(), "de": "der die und nicht mit auf für ein ist über".split(), "fr": "le la et les des pour avec être dans où".split()}


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 30))), lang) for k in range(n) for lang in [rng.choice(sorted(WORDS))]]


def brute_bits(train, lang, text, order=3):
    """Prediction by partial matching as defined: contexts that any language has met, three bytes long ones twice; excluded symbols leave the lower order."""
    counts, met, all_ctx = defaultdict(lambda: defaultdict(int)), {32}, defaultdict(int)
    for _, t, l in train:
        data = b"   " + t.encode()
        met |= set(data)
        for i in range(3, len(data)):
            for d in range(order + 1):
                all_ctx[data[i - d : i]] += 1
                if l == lang:
                    counts[data[i - d : i]][data[i]] += 1

    def p(ctx, c):
        if len(ctx) and (all_ctx[ctx] == 0 or len(ctx) == order and all_ctx[ctx] < 2):
            return p(ctx[1:], c)
        own = counts[ctx]
        total, kinds = sum(own.values()), len(own)
        lower = (lambda x: p(ctx[1:], x)) if len(ctx) else (lambda x: 1 / 256 if x in met else max(1, 256 - len(met)) / 256)
        if not total:
            return lower(c)
        if c in own:
            return own[c] / (total + kinds)
        return kinds / (total + kinds) * lower(c) / max(1 - sum(lower(x) for x in own), 1e-12)

    data = b"   " + text.encode()
    return sum(-math.log2(p(data[i - order : i], data[i])) for i in range(order, len(data)))


def test_code_lengths_are_exact(spark):
    train = corpus(30)
    grams = count_grams(spark.createDataFrame([(l, t) for _, t, l in train], "lang string, text string")).toPandas()
    model = build(grams)
    texts = ["the und le", "a", "", "für où ßx", "the " * 50, "zq", "\x01\x02", "of"]
    data, at = text_buffers(pa.array(texts))
    got = code_lengths(model, data, at)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert got[i, k] == pytest.approx(brute_bits(train, lang, t), rel=1e-4), (t, lang)


def test_held_out_accuracy(spark):
    model = fit(spark.createDataFrame([(k, l, t) for k, t, l in corpus(400)], "key long, lang string, text string"))
    given = corpus(200, seed=9)
    got = {r["doc_id"]: r for r in predict(spark.createDataFrame(given, "doc_id long, text string, lang string"), model, ["doc_id"]).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in given) >= 198
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int, k0 string"
    rows = [(1, None, "en", 1, "a"), (2, "", None, 2, "b"), (3, "12 34 !?", "en", 3, "c"), (4, "the of and with", None, 4, "d"), (4, "the of and with", None, 4, "d"), (None, "der die und nicht", "de", 5, None), (6, "and the " * 100_000, "en", 6, "e")]
    df = spark.createDataFrame(rows, schema)
    model = fit(spark.createDataFrame([(k, l, t) for k, t, l in corpus(200)], "key long, lang string, text string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(df, model, ["doc_id"]).collect()}
    assert [got[d][0] for d in (1, 2, 3, 4, None, 6)] == ["und", "und", "und", "en", "de", "en"] and got[1][1] == 0
    kept = keep_known(df, model)
    assert kept.columns == df.columns and sorted(str(tuple(r)) for r in kept.collect()) == sorted(str(r) for r in rows[3:])
    nothing = fit(training_rows(df.limit(0)))
    assert nothing.languages == [] and {r["lang_pred"] for r in predict(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert predict(df.limit(0), model, ["doc_id"]).count() == 0


def test_a_model_keeps_within_its_bytes(spark):
    train, test = corpus(300), corpus(60, 2)
    grams = count_grams(spark.createDataFrame([(l, t) for _, t, l in train], "lang string, text string")).toPandas()
    whole = build(grams)
    data, at = text_buffers(pa.array([t for _, t, _ in test]))
    for part in (2, 5, 40):
        model = build(grams, whole.bits.nbytes // part)
        base = (model.symbols + 1) * model.symbols * 4 * len(model.languages)  # contexts of one symbol at most
        assert model.bits.nbytes <= max(whole.bits.nbytes // part, base) and len(model.bits) < len(whole.bits)
        pred = code_lengths(model, data, at).argmin(1)
        assert sum(model.languages[p] == l for p, (_, _, l) in zip(pred, test, strict=True)) >= 55, part


def test_bounds_come_from_all_held_out_rows(spark):
    model = fit(spark.createDataFrame([(k, l, t) for k, t, l in corpus(400)], "key long, lang string, text string"))
    rows = [(k, l, t) for k, t, l in corpus(3000, seed=5)]  # more of each language than a sample would have
    held_out = spark.createDataFrame([*rows, (None, "en", "the of and"), (9000, "xx", "the of and"), (9001, "en", "12 34")], "key long, lang string, text string")
    got = predict(held_out, model, ["lang"]).where("lang = lang_pred").toPandas()
    assert bounds(held_out, model) == {lang: BOUND_TIMES * float(np.quantile(x, BOUND_SHARE)) for lang, x in got.groupby("lang")["bits_per_byte"]}
    assert bounds(held_out.limit(0), model) == {}


@pytest.mark.parametrize("bins", [64, 4096])
def test_quantiles_are_exact(spark, bins):
    rng = random.Random(3)
    values = {"one": [2.5], "two": [1.0, 4.0], "same": [3.0] * 50, "ties": [float(rng.randint(0, 5)) for _ in range(400)]}
    values |= {"skewed": [10.0 ** rng.uniform(-4, 4) for _ in range(700)], "near": [1 + k * 2.0**-52 for k in range(300)], "plain": [rng.gauss(3, 1) for _ in range(501)]}
    scored = spark.createDataFrame([(lang, x) for lang, own in values.items() for x in own], "lang string, value double")
    assert quantiles(scored, 0.99, bins) == {lang: float(np.quantile(x, 0.99)) for lang, x in values.items()}
    assert quantiles(scored.limit(0), 0.5) == {}
