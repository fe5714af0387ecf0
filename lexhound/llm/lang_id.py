"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialise, release_memory, segment_sums, text_buffers

ORDER = 3
#: Documents per language from which the statistics are counted (bounded in expectation by hash sampling).
TRAIN_DOCS_PER_LANGUAGE = 600
#: Code lengths of a model, which each Python worker holds, take at most so many bytes; with more languages rare contexts go.
MODEL_BYTES = 1 << 28
#: A score is the posterior that evidence of at most so many bytes gives.
EVIDENCE_BYTES = 64
#: A text is in none of the languages if it takes more than so many times what this share of labelled texts of its language
#: take at most for a byte, and so many bits besides, as short texts tell little.
BOUND_TIMES, BOUND_SHARE, BOUND_BITS = 2.0, 0.99, 64.0
#: Bins that a pass for a quantile cuts the range of a language's values into.
QUANTILE_BINS = 4096


@dataclass
class Model:
    """Frozen statistics: symbol classes, context nodes, and code lengths of each symbol after each node in each language."""

    languages: list[str]
    symbol_of: np.ndarray  # 256 bytes to symbols; 0 is any byte not met in training
    node_of: np.ndarray  # the last three symbols to the node of the longest known context
    bits: np.ndarray  # node * symbols + symbol, language

    @property
    def symbols(self) -> int:
        return int(round(len(self.node_of) ** (1 / ORDER)))


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last three bytes before each byte, and the byte, as one 32-bit number; a text starts after three blanks."""
    n = len(at) - 1
    padded = np.full(len(data) + ORDER * n, 32, np.uint8)
    place = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(at)) + 1)
    padded[place] = data
    p = padded.astype(np.uint32)
    key = np.zeros(len(padded), np.uint32)
    for back in range(ORDER, -1, -1):
        key[ORDER:] = (key[ORDER:] << np.uint32(8)) | p[ORDER - back : len(p) - back]
    return key[place]


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, text) to (lang, gram, n): how often each four bytes occur, counted in each task before they are shuffled."""

    def count(batches):
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for i, j in chunks(at):
                keys = _keys(data[at[i] : at[j]], at[i : j + 1] - at[i])
                of = np.repeat(langs[i:j], np.diff(at[i : j + 1]))
                for lang in dict.fromkeys(langs[i:j]):
                    gram, n = np.unique(keys[of == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    return labelled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, docs_per_language: int = TRAIN_DOCS_PER_LANGUAGE) -> Model:
    """Statistics of (key, lang, text) rows whose lang and text aren't null.

    Of each language a sample is counted whose expected number of whole documents is at most docs_per_language, chosen
    by the hash of key, so what reaches the driver is bounded whatever the size of the corpus.
    """
    per = labelled.groupBy("lang").count().collect()  # a row per language, as the model has a column per language
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for r in per for x in (r["lang"], docs_per_language / r["count"])]), F.col("lang")) if per else F.lit(0.0)
    picked = labelled.where(draw < share)
    return build(count_grams(picked).toPandas())


def _within(contexts: list[tuple[np.ndarray, np.ndarray]], node_bytes: int, most_bytes: int) -> list[np.ndarray]:
    """The contexts of each length, with counts, that become nodes: all, but of the longest those met twice.

    While they take more than most_bytes, the count that the longest need is doubled, then that of the next shorter ones;
    a context whose last symbols are no node isn't either. Those of one symbol, 256 at most, always stay.
    """
    least = [1.0] * (len(contexts) - 1) + [2.0]

    def kept(depth):
        u, n = contexts[depth]
        return u[n >= least[depth]]

    for depth in range(len(contexts) - 1, 0, -1):
        top = max(contexts[depth][1], default=0.0)
        while least[depth] <= top and sum(len(kept(k)) for k in range(len(contexts))) * node_bytes > most_bytes:
            least[depth] *= 2
    return [kept(depth) for depth in range(len(contexts))]


def build(grams, most_bytes: int = MODEL_BYTES) -> Model:
    """A model from a pandas frame (lang, gram, n), whose code lengths take at most most_bytes or so."""
    languages = sorted(grams["lang"].unique())
    gram, n = grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(languages, dtype=object), grams["lang"].to_numpy(object)) if languages else np.zeros(0, int)
    parts = [(gram >> (8 * k)) & 255 for k in range(ORDER, -1, -1)]
    met = np.unique(np.concatenate([*parts, [32]])).astype(int)
    symbol_of = np.zeros(256, np.uint8 if len(met) < 255 else np.uint16)
    symbol_of[met] = np.arange(1, len(met) + 1)
    s_count = len(met) + 1
    parts = [symbol_of[p].astype(np.int64) for p in parts]
    ctx = {0: np.zeros(len(gram), np.int64)}
    for depth in range(1, ORDER + 1):
        ctx[depth] = sum(parts[ORDER - 1 - k] * s_count**k for k in range(depth))
    # Nodes: every context of up to three symbols that some language has met (twice, if it is three long).
    met_contexts = []
    for depth in range(1, ORDER + 1):
        u, inverse = np.unique(ctx[depth], return_inverse=True)
        met_contexts.append((u, np.bincount(inverse, weights=n) if len(u) else np.zeros(0)))
    nodes = [np.zeros(1, np.int64), *_within(met_contexts, s_count * max(1, len(languages)) * 4, most_bytes)]
    base = np.cumsum([0, *map(len, nodes)])
    bits = np.zeros((base[-1], s_count, max(1, len(languages))), np.float32)
    unseen = max(1, 256 - len(met))
    for k in range(len(languages)):
        mine = lang == k
        # order -1: every byte alike; symbol 0 stands for all bytes not met
        below = np.full((1, s_count), 1 / 256)
        below[0, 0] = unseen / 256
        parents = np.zeros(1, np.int64)
        for depth in range(ORDER + 1):
            u = nodes[depth]
            counts = np.zeros((len(u), s_count))
            at = np.searchsorted(u, ctx[depth][mine])
            at[at == len(u)] = 0
            ok = (u[at] == ctx[depth][mine]) if len(u) else np.zeros(mine.sum(), bool)
            np.add.at(counts, (at[ok], parts[ORDER][mine][ok]), n[mine][ok])
            total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            lower = below[parents]
            left = np.maximum(1 - (lower * (counts > 0)).sum(1, keepdims=True), 1e-12)
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            here = np.where(counts > 0, counts / np.maximum(total + kinds, 1), escape * lower / np.where(total > 0, left, 1.0))
            bits[base[depth] : base[depth + 1], :, k] = -np.log2(np.maximum(here, 1e-30))
            below = here
            if depth < ORDER:
                parents = np.searchsorted(u, nodes[depth + 1] % s_count**depth)
    # The node of each three symbols: that of the longest context that is known.
    every = np.arange(s_count**ORDER, dtype=np.int64)
    node_of = np.zeros(len(every), np.int32)
    for depth in range(1, ORDER + 1):
        u = nodes[depth]
        if len(u):
            short = every % s_count**depth
            at = np.searchsorted(u, short)
            at[at == len(u)] = 0
            ok = u[at] == short
            node_of[ok] = base[depth] + at[ok]
    return Model(languages, symbol_of, node_of, bits.reshape(-1, max(1, len(languages))))


def code_lengths(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits that each text takes in each language (text, language); every byte counts."""
    n, s = len(at) - 1, model.symbols
    out = np.zeros((n, len(model.languages)))
    for i, j in chunks(at, 1 << 18):
        lo, hi, step = at[i], at[j], 1 << 18
        for a in range(lo, hi, step):  # one very long text goes in pieces, each after the bytes before it
            b = min(a + step, hi)
            piece = np.clip(at[i : j + 1], a, b)
            sym = model.symbol_of[data[max(a - ORDER, lo) : b]].astype(np.int64)
            lead = a - max(a - ORDER, lo)
            blank = int(model.symbol_of[32])
            if lead < ORDER:
                sym = np.concatenate([np.full(ORDER - lead, blank), sym])
            prior = [sym[ORDER - k : len(sym) - k].copy() for k in range(1, ORDER + 1)]
            starts = at[i:j][(at[i:j] >= a) & (at[i:j] < b)] - a
            for k in range(1, ORDER + 1):  # a text starts after blanks
                for off in range(k):
                    w = starts + off
                    w = w[w < b - a]
                    prior[k - 1][w] = blank
            if len(starts) and (np.diff(starts) < ORDER).any():
                prior = _short_text_context(data, at, i, j, a, b, model)
            node = model.node_of[prior[0] + prior[1] * s + prior[2] * s * s]
            rows = model.bits[node.astype(np.int64) * s + sym[ORDER:]]
            out[i:j] += segment_sums(rows, piece - a, np.float64)
    return out


def _short_text_context(data, at, i, j, a, b, model):
    """As above where texts shorter than the order follow each other."""
    keys = _keys(data[at[i] : at[j]], at[i : j + 1] - at[i])[a - at[i] : b - at[i]]
    return [model.symbol_of[(keys >> np.uint32(8 * k)) & np.uint32(255)].astype(np.int64) for k in range(1, ORDER + 1)]


SCHEMA_FIELDS = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType()))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns of docs with lang_pred, score (0 to 1) and bits_per_byte of every whole text.

    The language with the shortest code wins, ties go to the first by name. score is the posterior, all languages alike
    before, from the mean evidence of at most EVIDENCE_BYTES bytes. Null, empty or letterless text: und, 0, null.
    The model goes to the executors once; its size is bounded by MODEL_BYTES.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    has_letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    # positions, not names, so that no column of docs can clash
    kept = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)]
    # a text that is kept crosses to Python once
    whole = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == T.StringType() else len(keep)
    source = docs.select(*kept, *([F.col(f"`{text_col}`").cast("string").alias("text")] if whole == len(keep) else []), has_letter.alias("has_letter"))
    fields = [*(T.StructField(f"k{n}", docs.schema[c].dataType) for n, c in enumerate(keep)), *(T.StructField(a, b) for a, b in SCHEMA_FIELDS)]

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            data, at = text_buffers(batch.column(whole))
            has_letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            size = np.diff(at)
            pred, score, per = np.full(len(size), len(m.languages)), np.zeros(len(size)), np.full(len(size), np.nan)
            if m.languages and len(size):
                bits = code_lengths(m, data, at)
                best = bits.argmin(1)
                mean = (bits - bits.min(1, keepdims=True)) / np.maximum(size, 1)[:, None]
                weight = np.exp2(-mean * np.minimum(size, EVIDENCE_BYTES)[:, None])
                full = (size > 0) & has_letter
                pred[full] = best[full]
                score[full] = (1 / weight.sum(1))[full]
                per[full] = (bits.min(1) / np.maximum(size, 1))[full]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(names[pred], pa.string()), pa.array(score), pa.array(per, mask=np.isnan(per))],
                [f.name for f in fields],
            )
            release_memory()

    got = source.mapInArrow(run, T.StructType(fields))
    return got.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), *(a for a, _ in SCHEMA_FIELDS))


def bounds(labelled: DataFrame, model: Model) -> dict[str, float]:
    """Bits a byte above which a text isn't in a language, from (key, lang, text) rows that the model hasn't learnt from.

    They are BOUND_TIMES the BOUND_SHARE quantile of all labelled texts that the model finds to be in their language. A
    language without such rows has no bound.
    """
    if not model.languages:
        return {}
    found = predict(labelled, model, ["lang"]).where((F.col("lang") == F.col("lang_pred")) & F.col("bits_per_byte").isNotNull())
    scored = materialise(found.select("lang", F.col("bits_per_byte").alias("value")), "language-held-out")
    return {lang: BOUND_TIMES * x for lang, x in quantiles(scored, BOUND_SHARE).items()}


def quantiles(scored: DataFrame, share: float, bins: int = QUANTILE_BINS) -> dict[str, float]:
    """The exact quantile, as numpy interpolates it, of the finite values of each language of (lang, value), of however many rows.

    It lies between two ranks. For each, a range that holds it is cut into bins, and the least and greatest value of the
    bin it is in are the next range, until they are one value: each pass brings at most two times bins rows a language.
    """
    ranges = scored.groupBy("lang").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    place = {r["lang"]: (r["n"] - 1) * share for r in ranges}
    open_, found = {}, {}
    for r in ranges:
        for rank in {int(place[r["lang"]]), min(int(place[r["lang"]]) + 1, r["n"] - 1)}:
            open_[r["lang"], rank] = (r["low"], r["high"], 0)  # the range, and how many values are below it
    while open_:
        found |= {k: low for k, (low, high, _) in open_.items() if low == high}
        open_ = {k: x for k, x in open_.items() if x[0] < x[1]}
        if not open_:
            break
        cut = scored.sparkSession.createDataFrame([(lang, rank, low, high) for (lang, rank), (low, high, _) in open_.items()], "lang string, rank long, low double, high double")
        inside = scored.join(F.broadcast(cut), "lang").where(F.col("value").between(F.col("low"), F.col("high")))
        # rising with the value, and of low and high never the same
        at = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counted = inside.groupBy("lang", "rank", at.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        below, narrower = {k: x[2] for k, x in open_.items()}, {}
        for r in sorted(counted.collect(), key=lambda r: r["bin"]):
            key = r["lang"], r["rank"]
            if key not in narrower:
                if r["rank"] < below[key] + r["n"]:
                    narrower[key] = (r["low"], r["high"], below[key])
                below[key] += r["n"]
        open_ = narrower
    return {lang: float(np.quantile([found[lang, int(x)], found.get((lang, int(x) + 1), found[lang, int(x)])], x - int(x))) for lang, x in place.items()}


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text", most_bits: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, columns as they are, whose text is in a language of the model with at least that score.

    The score compares the languages of the model with each other only. With most_bits (of bounds()), texts that fit none
    of them go: those that take more bits a byte than that of the language found, and BOUND_BITS more. Null, empty and letterless texts are in none and go. Repeated rows are judged each.
    """
    base = docs.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)))
    got = predict(base, model, base.columns, f"c{docs.columns.index(text_col)}")
    got = got.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    if most_bits:
        size = F.octet_length(F.col(f"c{docs.columns.index(text_col)}").cast("string"))
        most = F.element_at(F.create_map(*[F.lit(x) for pair in most_bits.items() for x in pair]), F.col("lang_pred"))
        got = got.where(most.isNull() | (F.col("bits_per_byte") * size <= most * size + BOUND_BITS))
    return got.select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(docs.columns)))
