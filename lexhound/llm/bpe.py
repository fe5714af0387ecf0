"""Byte-level BPE encoding and decoding: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory

#: Pre-tokens outside the vocabulary whose ids one Python worker remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Texts above this many characters are split and encoded so many pre-tokens at a time.
LAZY_CHARS, LAZY_TOKENS = 1 << 20, 1 << 17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFT = np.uint64(20)
#: Keeps the first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(data: bytes | np.ndarray) -> np.ndarray:
    """For each place in data, the eight bytes from there on as one number; zeros follow the end."""
    raw = np.frombuffer(bytes(data) + bytes(8), np.uint8)
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _hash(words: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of data[start:start + size] for each, eight bytes at a time; words: of _words(data)."""
    h = _mix((words[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    at, more = 8, np.flatnonzero(size > 8)
    while len(more):
        h[more] = _mix(h[more] * np.uint64(3) ^ (words[start[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    return h


@dataclass
class Vocabulary:
    """Tokens in a minimal perfect hash (hash and displace, single keys placed last), and which pairs of them join to another."""

    data: bytes  # all tokens, by id
    start: np.ndarray  # by id
    size: np.ndarray  # by id; 0: no such token
    displacement: np.ndarray  # by bucket; below 0: the slot itself
    slot_id: np.ndarray  # slot to id
    seed: int
    pair: np.ndarray  # left * len(size) + right
    joined: np.ndarray  # the id of what each pair joins to
    n: int

    def __post_init__(self):
        self.words = _words(self.data)
        self.longest = int(self.size.max(initial=0))

    def __reduce__(self):
        return Vocabulary, (self.data, self.start, self.size, self.displacement, self.slot_id, self.seed, self.pair, self.joined, self.n)

    def find_all(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of data[start:start + size] for each, -1 where it isn't in the vocabulary; words: of _words(data).

        The slot comes by the hash, and the bytes of the token there are compared, whatever the hash.
        """
        out = np.full(len(start), -1, np.int64)
        if not self.n:
            return out
        use = np.flatnonzero((size > 0) & (size <= self.longest))
        start, size = start[use], size[use]
        found = self.slot_id[self._slots(_hash(words, start, size, self.seed))]
        same = self.size[found] == size
        at = 0
        live = np.flatnonzero(same)
        while len(live):
            mask = _FIRST[np.minimum(size[live] - at, 8)]
            ok = ((words[start[live] + at] ^ self.words[self.start[found[live]] + at]) & mask) == 0
            same[live[~ok]] = False
            at += 8
            live = live[ok & (size[live] > at)]
        out[use[same]] = found[same]
        return out

    def _slots(self, h: np.ndarray) -> np.ndarray:
        d = self.displacement[h % np.uint64(len(self.displacement))]
        return np.where(d < 0, -d - 1, _slot(h, np.maximum(d, 0).astype(np.uint64), self.n)).astype(np.int64)

    def find(self, token: bytes) -> int:
        """The id of a token, -1 if it isn't in the vocabulary."""
        return int(self.find_all(_words(token), np.zeros(1, np.int64), np.array([len(token)]))[0])


def _slot(h, d, n: int):
    return ((h >> _SHIFT) ^ (d * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0xFFFFFFFFFFF))) % np.uint64(n)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def build_vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    n = len(ranks)
    if n and (missing := [k for k in range(256) if bytes([k]) not in ranks]):
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    start, data = np.cumsum(size) - size, b"".join(tokens)
    ids = np.flatnonzero(size)
    seed = 0
    while True:  # until no two tokens have one hash
        hashes = _hash(_words(data), start[ids], size[ids], seed)
        if len(np.unique(hashes)) == n:
            break
        seed += 1
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max(1, n // 3))]
    for h, r in zip(hashes.tolist(), ids.tolist(), strict=True):
        buckets[h % len(buckets)].append((h >> 20, r))
    displacement = np.zeros(len(buckets), np.int64)
    slot_id = np.full(max(n, 1), -1, np.int64)
    taken = bytearray(n)
    order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
    free = None
    for b in order:
        keys = buckets[b]
        if not keys:
            break
        if len(keys) == 1:
            if free is None:
                free = iter([s for s in range(n) if not taken[s]])
            s = next(free)
            displacement[b] = -s - 1
            slot_id[s] = keys[0][1]
            continue
        d = 0
        while True:
            mix = d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFF
            slots = [(h ^ mix) % n for h, _ in keys]
            if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                break
            d += 1
        displacement[b] = d
        for s, (_, r) in zip(slots, keys, strict=True):
            taken[s] = 1
            slot_id[s] = r
    pairs = [(ranks[t[:k]] * len(tokens) + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    pair, joined = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return Vocabulary(data, start, size, displacement, slot_id, seed, pair, joined, n)


def merge(parts: list[int], heap: list[int], join, ids: int) -> list[int]:
    """Ids of a pre-token: of adjacent parts whose join has the lowest rank, the leftmost are joined first, until none is left.

    parts: the ids of its bytes, which the parts so far form a linked list over. heap: the joins of adjacent bytes, each
    one number of rank, start and end, in ascending order. A join is stale if either of its parts has changed. join: the
    id of what left * ids + right joins to, or None; ids: how many there are.
    """
    n = len(parts)
    bits = n.bit_length()
    low = (1 << bits) - 1
    after = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is part of another
    before = list(range(-1, n))  # where the part before the one that starts here starts
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        end = top & low
        top >>= bits
        i = top & low
        mid = after[i]
        if not mid or mid >= end or after[mid] != end:
            continue
        r = parts[i] = top >> bits
        after[mid], after[i] = 0, end
        if end < n:
            before[end] = i
            if (q := join(r * ids + parts[end])) is not None:
                push(heap, (q << bits | i) << bits | after[end])
        p = before[i]
        if p >= 0 and (q := join(parts[p] * ids + r)) is not None:
            push(heap, (q << bits | p) << bits | end)
    out, i = [], 0
    while i < n:
        out.append(parts[i])
        i = after[i]
    return out


class Encoder:
    """Encodes texts in one Python worker: pre-tokens in the vocabulary by the perfect hash, all of a chunk at once; others by merging."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.split = vocabulary, regex.compile(pattern)
        v, one = vocabulary, vocabulary.size == 1
        self.byte_id = np.zeros(256, np.int64)
        self.byte_id[np.frombuffer(v.data, np.uint8)[v.start[one]]] = np.flatnonzero(one)
        self.join = dict(zip(v.pair.tolist(), v.joined.tolist(), strict=True)).get
        # the joins of two bytes; 0 for none, else the id and 1
        self.two = np.zeros((256, 256), np.int64)
        two = np.flatnonzero(v.size == 2)
        a = np.frombuffer(v.data, np.uint8)
        self.two[a[v.start[two]], a[v.start[two] + 1]] = two + 1
        #: How many pre-tokens came by the hash, from memory, and by merging.
        self.by_hash = self.by_memory = self.by_merging = 0
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, tokens: list[str]) -> None:
        """Merges the bytes of tokens, each once, and remembers their ids."""
        data = "".join(tokens).encode()
        raw = np.frombuffer(data, np.uint8)
        size = self._sizes(tokens, data)
        ends = np.cumsum(size)
        starts = ends - size
        parts = self.byte_id[raw].tolist()
        pairs = self.two[raw[:-1], raw[1:]] if len(raw) else np.zeros(0, np.int64)
        pairs[ends[:-1] - 1] = 0  # none reaches from one token into the next
        some = np.flatnonzero(pairs)
        of = np.searchsorted(ends, some, side="right")
        bits = np.array([n.bit_length() for n in size.tolist()], np.int64)[of]
        within = some - starts[of]
        keys = (((pairs[some] - 1) << bits | within) << bits) | (within + 2)
        wide = size > 1 << 20  # three numbers of such a token don't fit into one of 64 bits
        order = np.lexsort((keys, of))
        first = np.searchsorted(of, np.arange(len(tokens) + 1)).tolist()
        keys = keys[order].tolist()
        join, ids = self.join, len(self.vocabulary.size)
        flat, count, place, k0 = [], [], self.place, len(self.start) - 1
        for k, (token, a, b, big) in enumerate(zip(tokens, starts.tolist(), ends.tolist(), wide.tolist(), strict=True)):
            heap = keys[first[k] : first[k + 1]]
            if big:
                n = (b - a).bit_length()
                heap = sorted(((int(pairs[a + i]) - 1) << n | i) << n | i + 2 for i in np.flatnonzero(pairs[a : b - 1]).tolist())
            got = merge(parts[a:b], heap, join, ids)
            flat += got
            count.append(len(got))
            place[token] = k0 + k
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(np.array(count, np.int64))])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.by_merging += len(tokens)

    @staticmethod
    def _sizes(tokens: list[str], data: bytes) -> np.ndarray:
        """The bytes of each token, of which data is the whole."""
        chars = np.fromiter(map(len, tokens), np.int64, len(tokens))
        if len(data) == chars.sum():
            return chars
        at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        return np.diff(at[np.cumsum(chars)], prepend=0)

    def encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, and how many each has."""
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.place) > REMEMBERED:
            self.reset()
        data = "".join(tokens).encode()
        size = self._sizes(tokens, data)
        ids = self.vocabulary.find_all(_words(data), np.cumsum(size) - size, size)
        n = np.ones(len(tokens), np.int64)
        missed = np.flatnonzero(ids < 0)
        others = [tokens[k] for k in missed.tolist()]
        place = self.place
        new = list(dict.fromkeys(t for t in others if t not in place))
        if new:
            self.learn(new)
        self.by_hash += len(tokens) - len(missed)
        self.by_memory += len(missed) - len(new)
        code = np.fromiter(map(place.__getitem__, others), np.int64, len(others))
        n[missed] = self.start[code + 1] - self.start[code]
        upto = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        hit = ids >= 0
        out[upto[hit]] = ids[hit]
        m = n[missed]
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(upto[missed], m) + within] = self.flat[np.repeat(self.start[code], m) + within]
        return out, n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of each text's."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        tokens, counts = [], np.zeros(len(texts), np.int64)

        def flush(upto: int) -> None:
            nonlocal tokens
            if tokens:
                got, n = self.encode_tokens(tokens)
                out.append(got)
                ends = np.concatenate([[0], np.cumsum(n)])
                of = np.concatenate([[0], np.cumsum(counts[:upto])])
                sizes[:upto] += ends[of[1:]] - ends[of[:-1]]
                counts[:upto] = 0
                tokens = []

        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > LAZY_CHARS:
                flush(k)
                matches = (m.group() for m in self.split.finditer(text))
                while part := list(islice(matches, LAZY_TOKENS)):
                    got, _ = self.encode_tokens(part)
                    out.append(got)
                    sizes[k] += len(got)
                continue
            found = self.split.findall(text)
            counts[k] = len(found)
            tokens += found
        flush(len(texts))
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes)])


_encoders: dict[str, Encoder] = {}


def _groups(texts: list[str | None], limit: int = 1 << 20):
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size > limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _token_bytes(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes by id, where each starts, and its size (0: no such id)."""
    return np.frombuffer(v.data, np.uint8), v.start, v.size


def _bytes_of(ids: np.ndarray, upto: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The bytes that ids[upto[k]:upto[k + 1]] stand for, for each k."""
    data, start, size = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or (size[ids] == 0).any()):
        raise ValueError("ids outside the vocabulary")
    n = size[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    raw = data[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])] if len(ids) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer(ends[upto].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", into: str = "ids", decoded_into: str | None = None) -> DataFrame:
    """docs without text_col, with the ids (array<int>) of its whole text; null and empty texts have none.

    With decoded_into, also the bytes that decode() makes of the ids, in the same pass.

    Each match of pattern is encoded by itself by the ranks in the file at path, without special tokens; characters
    between matches are left out, as in the public libraries. A column of docs that is called as into is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(build_vocabulary(read_ranks(path)))  # bounded: the vocabulary
    keep = [c for c in docs.columns if c not in (text_col, into, decoded_into)]
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decoded_into:
        schema.add("decoded", T.BinaryType())
    key = f"{path}\0{pattern}"

    def run(batches):
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value, pattern)
        coder = _encoders[key]
        table = _token_bytes(coder.vocabulary) if decoded_into else None
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(len(keep)).to_pylist()):
                ids, upto = coder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                more = [_bytes_of(ids, upto, table)] if table else []
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keep))), lists, *more], [f.name for f in schema])
            release_memory()

    got = source.mapInArrow(run, schema)
    more = [F.col("decoded").alias(decoded_into)] if decoded_into else []
    return got.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), F.col("ids").alias(into), *more)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes (binary) that its ids stand for; null ids give no bytes, an unknown id is an error."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(_token_bytes(build_vocabulary(read_ranks(path))))  # bounded: the vocabulary
    keep = [c for c in encoded.columns if c != into]
    source = encoded.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)))
    where = keep.index(ids_col)
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            column = batch.column(where)
            upto = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            first = 0
            while first < len(column):  # some 4 MB of bytes at a time
                last = int(np.searchsorted(upto, upto[first] + (1 << 20), side="right")) - 1
                last = min(max(last, first + 1), len(column))
                out = _bytes_of(ids[upto[first] : upto[last]], upto[first : last + 1] - upto[first], shared.value)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keep))), out], [f.name for f in schema])
                first = last

    got = source.mapInArrow(run, schema)
    return got.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), F.col("decoded").alias(into))
