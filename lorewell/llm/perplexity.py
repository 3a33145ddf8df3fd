"""LM scoring by a hierarchical Pitman-Yor model of words.

Two levels of restaurants: one for each distinct word before (and one for starts of texts), all sharing one parent, the
restaurant of words alone, whose base is uniform over the training vocabulary and one unknown word.

Texts are tokenised once, into blocks of bounded size that are written to the shared folder. Words get whole numbers,
frequent ones small, that hang on the corpus alone. A block's distinct pairs (word, word before) go to the part of the
word, which keeps their counts; a word with more than SHARD occurrences is dealt to several parts by the word before. What
parts need of one another, the tables of a restaurant over all parts, goes as packed numbers to the part that owns
the word before, and only for pairs that can change: a pair seen once always has one table. Model-wide sums, a few numbers
a sweep, pass through the driver, and the sizes of the parts of the vocabulary.

Seating is Gibbs-sampled: a sweep draws for every dish of every restaurant the number of its tables from its full
conditional, the arrangements of its customers at tables summed out by generalised Stirling numbers, given all other
dishes as the sweep before left them over all parts. Draws are seeded by (word, word before, sweep), so the number of
partitions changes nothing. Predictive probabilities are averaged over the sweeps after the burn-in.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, give_back, mix, pack_sorted, partitions, tidy, unpack_sorted, word_hashes
from .groups import frame

SWEEPS, BURN_IN = 6, 3
STRENGTH = 1.0
#: Tokens of a block and of a part, and occurrences of a word that make one part of its pairs.
BLOCK, PART, SHARD = 1 << 20, 1 << 21, 1 << 22
#: What a block is told: the numbers of its words, the tables of restaurants, the customers and tables of pairs and words.
NUMBERS, TABLES, PAIRS = range(3)
#: Up to this count Stirling numbers are kept in a table; beyond, those of a dish are computed by a contour integral.
TABLE = 2048
_U64 = np.uint64
END = mix(np.array([1], np.uint64))[0]
#: Keys of words that several parts share, beyond those of restaurants.
_SHARED = 1 << 40
START = 0  # the number of what stands before the first word
_CODEC = pa.Codec("zstd")


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed planes of bytes, low ones first."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    data = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(x).to_bytes(5, "little") + _CODEC.compress(data, asbytes=True)


def unpack_ints(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:6], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(_CODEC.decompress(data[6:], width * n, asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def bundle(**arrays: np.ndarray) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, **{k: np.frombuffer(pack_ints(x), np.uint8) for k, x in arrays.items()})
    return sink.getvalue()


def unbundle(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {k: unpack_ints(found[k].tobytes()) for k in found.files}


def _restart(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending numbers within groups that start at `first`, as steps; `_resume` undoes it."""
    step = np.diff(x, prepend=0)
    step[first] = x[first]
    return step


def _resume(step: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.cumsum(step)
    before = total[first] - step[first]
    return total - np.repeat(before, np.diff(np.append(first, len(step))))


@lru_cache(2)
def stirling(discount: float, n: int) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of type (-1, -discount, 0): row c, column t."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    for c in range(n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(np.maximum(c - discount * t, 0)))
    return s


def draw_tables(key: np.ndarray, count: np.ndarray, tables_else: np.ndarray, base: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Numbers of tables of dishes with `count` customers, whose restaurants have tables_else tables of other dishes and
    whose parents serve the dish with probability base, from their full conditional; key seeds each draw."""
    out = np.minimum(count, 1)
    a, u = strength / discount + tables_else, _uniform(key)
    order = np.argsort(count, kind="stable")
    values, first = np.unique(count[order], return_index=True)
    for c, at in zip(values.tolist(), np.split(order, first[1:])):
        if 1 < c <= TABLE:
            t = np.arange(1, c + 1)
            w = stirling(discount, TABLE)[c, 1 : c + 1] + np.cumsum(np.log((discount * base[at])[:, None] * (a[at, None] + t - 1)), axis=1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (w < u[at, None] * w[:, -1:]).sum(axis=1)
    for i in np.flatnonzero(count > TABLE).tolist():
        t, w = conditional(int(count[i]), float(a[i]), float(base[i]), discount)
        w = np.cumsum(w)
        out[i] = t[min(int(np.searchsorted(w, u[i] * w[-1])), len(t) - 1)]
    return out


def _halve(falls, low: float = -500.0, high: float = -1e-12) -> float:
    """Where a falling function of a negative number crosses 0."""
    while low - high < 1e-9 * low:
        middle = (low + high) / 2 if low > -1 else -math.sqrt(low * high)
        low, high = (middle, high) if falls(middle) > 0 else (low, middle)
    return low


def _saddle_tables(v: float, c: int, discount: float) -> float:
    """For which number of tables log(1 - x) = v is the saddle point of the integral below; rises with v."""
    return c * math.expm1(discount * v) / math.expm1(v) * math.exp((1 - discount) * v) / discount


def coefficients(c: int, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms, but for a constant, of c! / (t! discount**t) times generalised Stirling numbers, for numbers of tables t that
    lie close together. They are the coefficients of x**c in (1 - (1 - x)**discount)**t, which Cauchy's integral gives. With
    x = exp(-u / c) it is summed by the trapezoidal rule on a parabola u = u0 (1 + i y)**2 through the saddle point of the
    middle t and around the cut, until terms have faded; where nearly all customers open tables, on the circle through it."""
    at = float(t[len(t) // 2])
    v = min(_halve(lambda v: at - _saddle_tables(v, c, discount)), -1e-4)
    u0 = max(-c * math.log1p(-math.exp(v)), 2.0)
    x, s = math.exp(-u0 / c), -math.expm1(-u0 / c)
    fall = discount * s ** (discount - 1) * x / c / (1 - s**discount)
    bend = at * (fall * ((1 - discount) * x / (c * s) + 1 / c) - fall * fall)
    if v > math.log(0.1) and c - at < 1000:
        u, weight = u0 + 1j * np.pi * c * (np.arange(192) + 0.5) / 192, np.ones(192)
    else:
        y = min(0.2, 0.3 / (u0 * math.sqrt(max(bend, 1e-300)))) * (np.arange(96) + 0.5)
        y = y[2 * u0 * y < np.pi * c]
        u, weight = u0 * (1 + 1j * y) ** 2, (1 + 1j * y) * (u0 * (y[1] - y[0]) * 2 / np.pi / c)
    g, mean = np.log(1 - (-np.expm1(-u / c)) ** discount), math.log1p(-(s**discount))
    size = u - u0 + at * (g - mean)
    faded = np.flatnonzero(size.real < -45)[:1]
    n = int(faded[0]) if len(faded) else len(u)
    total = np.exp((t[:, None] - at) * (g[:n] - mean)) @ (np.exp(size[:n]) * weight[:n])
    return np.log(np.maximum(total.real, 1e-300)) + t * mean + u0 - (math.log(192) if len(weight) == 192 else 0)


def conditional(c: int, a: float, base: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tables, their weights) of a dish with so many customers that no table of Stirling numbers is kept: the
    same full conditional, over all numbers whose weight is above 1e-13 of the largest."""
    tables = lambda v: _saddle_tables(v, c, discount)
    slope = lambda v: math.log(-math.expm1(discount * v) * base) + math.log((a + tables(v)) / max(tables(v), 1e-300))
    v = _halve(slope)
    step = 1e-4 * -v
    fall = (slope(v + step) - slope(v - step)) / max(tables(v + step) - tables(v - step), 1e-300)
    top, spread = tables(v), math.sqrt(-1 / fall if fall < 0 else c)
    width, block = 9 * spread + 20, max(32, int(2 * spread))
    while True:
        low, high = max(1, int(top - width)), min(c, int(top + width))
        t = np.arange(low, high + 1)
        log = np.concatenate([coefficients(c, t[i : i + block], discount) for i in range(0, len(t), block)])
        log += np.append(0, np.cumsum(np.log(base * (a + t[1:] - 1) / t[1:])))
        w = np.exp(log - log.max())
        if (w[0] < 1e-13 or low == 1) and (w[-1] < 1e-13 or high == c):
            return t, w
        width *= 2


def _key(word: np.ndarray, before: np.ndarray, sweep: int) -> np.ndarray:
    return mix(mix(word.astype(np.uint64)) + before.astype(np.uint64) * _U64(2 * sweep + 3))


def _uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> _U64(11)).astype(np.float64) * 2.0**-53


def _tokenise(block: int):
    """Map step of (id, text, held_out): blocks of about `block` tokens. Tokens are ranks of words, frequent ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held, facts, n, kind = [], [], 0, None

        def flush():
            sizes = np.array([len(x) for x in held])
            words, where, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            train = np.bincount(where, np.repeat(~np.array([f[1] for f in facts], bool), sizes), len(words)).astype(np.int64)
            ids = pa.RecordBatch.from_arrays([pa.array([f[0] for f in facts], kind), pa.array([f[1] for f in facts], pa.bool_())], ["id", "held_out"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(ids)
            body = bundle(order=order, tokens=rank[where], sizes=sizes, train=train)
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | made], pa.int64()), pa.array([len(where)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([pack_sorted(words)], pa.binary()), pa.array([body], pa.binary())], ["g", "tokens", "docs", "words", "body"])

        for batch in batches:
            kind = batch.column(0).type
            for i, text, out in zip(batch.column(0), batch.column(1), batch.column(2)):
                held.append(np.append(word_hashes(text.as_py(), lower=True)[0], END))
                facts.append((i.as_py(), out.as_py()))
                n += len(held[-1])
                if n >= block:
                    yield flush()
                    held, facts, n, made = [], [], 0, made + 1
        if held:
            yield flush()

    return tidy(run)


def _ask_words(parts: int):
    """Map step of blocks: their words, dealt by ranges of hashes, with training counts."""

    def run(batches):
        for batch in batches:
            for g, words, body in zip(batch.column("g").to_pylist(), batch.column("words"), batch.column("body")):
                words, train = unpack_sorted(words.as_py()), unbundle(body.as_py())["train"]
                part = ((words >> _U64(32)) * _U64(parts) >> _U64(32)).astype(np.int64)
                cut = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                rows = [(int(p), g, pack_sorted(words[cut[p] : cut[p + 1]]), pack_ints(train[cut[p] : cut[p + 1]])) for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "g", "words", "train"])

    return run


def _classes(count: np.ndarray) -> np.ndarray:
    """Bits of a count: words are numbered from the class of the most frequent ones down."""
    return 63 - np.frexp(count.astype(np.float64))[1]


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part of the vocabulary: counts over all blocks, which of its words each block has, and how many of each class."""
    pdf = pdf.sort_values("g")
    keys = [unpack_sorted(x) for x in pdf["words"]]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(where, np.concatenate([unpack_ints(x) for x in pdf["train"]]), len(distinct)).astype(np.int64)
    places = np.split(where, np.cumsum([len(k) for k in keys])[:-1])
    steps = [pack_ints(np.diff(p, prepend=0)) for p in places]
    give_back()
    return frame([(int(pdf["part"].iloc[0]), pack_ints(count), pdf["g"].tolist(), steps, np.bincount(_classes(count), minlength=64).tolist(), int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum()))], ["part", "counts", "gs", "places", "classes", "n", "v", "one", "two"])


def _number_words(first: np.ndarray):
    """Map step: to each block the numbers of its words of a part and their counts; first: each part's first number of
    each class."""

    def run(batches):
        for batch in batches:
            for part, counts, gs, places in zip(*(batch.column(c).to_pylist() for c in ("part", "counts", "gs", "places"))):
                count = unpack_ints(counts)
                kind = _classes(count)
                order = np.argsort(kind, kind="stable")
                number = np.empty(len(count), np.int64)
                start = np.searchsorted(kind[order], np.arange(64))
                number[order] = first[part][kind[order]] + np.arange(len(order)) - start[kind[order]]
                rows = []
                for g, p in zip(gs, places):
                    p = np.cumsum(unpack_ints(p))
                    rows.append((g, part, pack_ints(number[p]), pack_ints(count[p])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["g", "part", "numbers", "counts"])

    return tidy(run)


class Block:
    """A block's tokens by number, with its texts' sizes."""

    def __init__(self, row, numbered: pd.DataFrame):
        numbered = numbered.sort_values("part")
        self.number = np.concatenate([unpack_ints(x) for x in numbered["numbers"]])  # of the words, ascending by hash
        self.count = np.concatenate([unpack_ints(x) for x in numbered["counts"]])
        body = unbundle(row["body"])
        self.sizes, self.train = body["sizes"], None
        self.at = body["order"][body["tokens"]]  # each token's word
        self.word = self.number[self.at]
        self.before = np.append(START, self.word[:-1])
        self.before[np.cumsum(self.sizes) - self.sizes] = START
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        self.ids, self.held_out = docs.column("id").to_pylist(), np.array(docs.column("held_out").to_pylist(), bool)
        if self.number.max() >= 1 << 31:
            raise ValueError("more than 2**31 distinct words")
        self.pairs, self.pair = np.unique(self.word << 32 | self.before, return_inverse=True)

    def dealt(self, parts: int, shard: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each part that gets some: which pairs, and how many shards the word of each has."""
        word, before = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        order = np.argsort(self.number)
        shards = 1 + self.count[order][np.searchsorted(self.number[order], word)] // shard
        part = (word + before % shards * 7919) % parts
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            at = order[cut[p] : cut[p + 1]]
            yield p, at, shards[at]


def _pack_pairs(pairs: np.ndarray, **more: np.ndarray) -> bytes:
    word, before = pairs >> 32, pairs & 0xFFFFFFFF
    first = np.flatnonzero(np.diff(word, prepend=-1))
    return bundle(words=np.diff(word[first], prepend=0), per=np.diff(np.append(first, len(word))), before=_restart(before, first), **more)


def _unpack_pairs(data: dict[str, np.ndarray]) -> np.ndarray:
    first = np.cumsum(data["per"]) - data["per"]
    return np.repeat(np.cumsum(data["words"]), data["per"]) << 32 | _resume(data["before"], first)


def _ask_pairs(parts: int, shard: int):
    def run(key, pdf: pd.DataFrame, numbered: pd.DataFrame) -> pd.DataFrame:
        """Of a block: its distinct pairs with training counts, to the parts of their words."""
        b = Block(pdf.iloc[0], numbered)
        count = np.bincount(b.pair, np.repeat(~b.held_out, b.sizes), len(b.pairs)).astype(np.int64)
        rows = [(p, int(key[0]), _pack_pairs(b.pairs[at], count=count[at], shards=shards - 1)) for p, at, shards in b.dealt(parts, shard)]
        give_back()
        return frame(rows, ["part", "g", "pairs"])

    return run


def _gather(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A part's pairs with counts over all blocks, which of them each block asked for, by owner the keys it exchanges
        sums of, and what the discounts are estimated from: pairs, and words over restaurants, that occur once and twice."""
        part, pdf = int(pdf["part"].iloc[0]), pdf.sort_values("g")
        each = [unbundle(x) for x in pdf["pairs"]]
        asked = [_unpack_pairs(x) for x in each]
        pairs, sample, where = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        count = np.bincount(where, np.concatenate([x["count"] for x in each]), len(pairs)).astype(np.int64)
        shards = np.concatenate([x["shards"] for x in each])[sample]
        places = [pack_ints(np.diff(p, prepend=0)) for p in np.split(where, np.cumsum([len(a) for a in asked])[:-1])]
        model = Model(part, pairs, count, shards, parts)
        fixed = np.where(count < 2, np.minimum(count, 1), 0)
        sums = np.bincount(model.context_at, fixed, len(model.keys)).astype(np.int64)
        to = {owner: bundle(keys=np.diff(model.keys[at], prepend=0), live=model.live[at].astype(np.int64), fixed=sums[at]) for owner, at in model.owners()}
        mine = np.bincount(model.word_at, np.minimum(count, 1), len(model.words))[~model.shared]
        seen = [int(x) for x in ((count == 1).sum(), (count == 2).sum(), (mine == 1).sum(), (mine == 2).sum())]
        give_back()
        return frame([(part, _pack_pairs(pairs, count=count, shards=shards), pdf["g"].tolist(), places, list(to), list(to.values()), seen)], ["part", "pairs", "gs", "places", "owners", "keys", "seen"])

    return run


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse; numbers that lie close are marked in a table instead of being sorted."""
    most = int(x.max()) + 1 if len(x) else 0
    if most > 8 * len(x):
        return np.unique(x, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[x]


class Model:
    """A part's pairs, and the keys of the sums that it exchanges: the tables of each restaurant, and of each word that
    other parts have too."""

    def __init__(self, part: int, pairs: np.ndarray, count: np.ndarray, shards: np.ndarray, parts: int):
        self.part, self.parts, self.count = part, parts, count
        self.word, self.before = pairs >> 32, pairs & 0xFFFFFFFF
        self.first = np.flatnonzero(np.diff(self.word, prepend=-1))
        self.words = self.word[self.first]
        self.word_at = np.repeat(np.arange(len(self.words)), np.diff(np.append(self.first, len(self.word))))
        self.many = np.flatnonzero(count > 1)  # pairs whose tables can change
        self.shared = shards[self.first] > 0
        contexts, self.context_at = _distinct(self.before)
        self.keys = np.concatenate([contexts, _SHARED + self.words[self.shared]])
        self.live = np.zeros(len(self.keys), bool)
        self.live[self.context_at[self.many]] = True
        self.live[len(contexts) :] = True
        self.contexts = len(contexts)

    def owners(self, live: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """Which keys each part owns, ascending."""
        some = np.flatnonzero(self.live) if live else np.arange(len(self.keys))
        owner = self.keys[some] % self.parts
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            yield p, some[order[cut[p] : cut[p + 1]]]

    def own_sums(self, tables: np.ndarray) -> np.ndarray:
        """By key, this part's tables of the pairs that can change (words that are shared: of all pairs)."""
        moving = np.zeros(len(tables), np.int64)
        moving[self.many] = tables[self.many]
        shared = np.bincount(self.word_at, tables, len(self.words)).astype(np.int64)[self.shared]
        return np.concatenate([np.bincount(self.context_at, moving, self.contexts).astype(np.int64), shared])

    def send(self, tables: np.ndarray) -> list[tuple]:
        sums = self.own_sums(tables)
        return [(owner, self.part, pack_ints(sums[at]), None) for owner, at in self.owners(live=True)]


def _model(row, parts: int) -> Model:
    data = unbundle(row["pairs"])
    return Model(int(row["part"]), _unpack_pairs(data), data["count"], data["shards"], parts)


class Owner:
    """The keys that a part owns: who has tables there, and what never changes."""

    def __init__(self, owned: pd.DataFrame):
        owned = owned.sort_values("src")
        each = [unbundle(x) for x in owned["keys"]]
        keys = [np.cumsum(x["keys"]) for x in each]
        self.keys, where = np.unique(np.concatenate(keys), return_inverse=True)
        self.fixed = np.bincount(where, np.concatenate([x["fixed"] for x in each]), len(self.keys)).astype(np.int64)
        live = np.concatenate([x["live"] for x in each]).astype(bool)
        src = np.repeat(owned["src"].to_numpy(np.int64), [len(k) for k in keys])
        self.at = {int(s): where[(src == s) & live] for s in owned["src"]}

    def totals(self, sent: pd.DataFrame) -> np.ndarray:
        total = self.fixed.copy()
        for src, sums in zip(sent["src"], sent["sums"]):
            np.add.at(total, self.at[int(src)], unpack_ints(sums))
        return total


def _add_up(key, owned: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
    """At the owner: the sums over all parts, back to each part in the order of its own."""
    if not len(owned) or not len(sent):
        return frame([], ["part", "src", "sums", "state"])
    owner = Owner(owned)
    total, me = owner.totals(sent), int(key[0])
    return frame([(int(src), me, pack_ints(total[owner.at[int(src)]]), None) for src in sent["src"]], ["part", "src", "sums", "state"])


LETTER = "part int, src int, sums binary, state binary"


def _parent(mine: np.ndarray, top: np.ndarray, customers: float, tables: float, known: dict) -> np.ndarray:
    """Probability of each word at the parent, which has so many customers and tables in all."""
    d, b = known["parent_discount"], STRENGTH
    return (np.maximum(mine - d * top, 0) + (b + d * tables) * known["base"]) / (customers + b)


def _sweep(sweep: int, sums: tuple[float, float], known: dict, parts: int):
    def run(key, pdf: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        """One sweep over a part, or, before the first, one table for each dish. sums: customers and tables at the parent,
        and the letters the part's totals and its own seating, as the sweep before left them."""
        if not len(pdf):
            return frame([], ["part", "src", "sums", "state", "customers", "tops"])
        m = _model(pdf.iloc[0], parts)
        tables, at = np.minimum(m.count, 1), m.many
        mine = np.bincount(m.word_at, tables, len(m.words)).astype(np.int64)
        top = np.minimum(mine, 1)
        if sweep >= 0:
            before = unbundle(letters.loc[letters["state"].notna(), "state"].iloc[0])
            tables[at], top = before["tables"], before["top"]
            total = m.own_sums(tables)
            owned, told = dict(m.owners(live=True)), letters[letters["sums"].notna()]
            for owner, values in zip(told["src"], told["sums"]):
                total[owned[int(owner)]] = unpack_ints(values)
            mine = np.bincount(m.word_at, tables, len(m.words)).astype(np.int64)
            mine[m.shared] = total[m.contexts :]
            top = draw_tables(_key(m.words, np.full(len(m.words), _SHARED), sweep), mine, np.maximum(sums[1] - top, 0), np.full(len(mine), known["base"]), known["parent_discount"], STRENGTH)
            base = _parent(mine, top, *sums, known)
            tables[at] = draw_tables(_key(m.word[at], m.before[at], sweep), m.count[at], np.maximum(total[m.context_at[at]] - tables[at], 0), base[m.word_at[at]], known["discount"], STRENGTH)
        once = m.words % parts == m.part  # of a shared word, one part counts the parent's tables
        new = bundle(tables=tables[at], top=top, mine=mine)
        rows = [(m.part, None, None, new, int(tables.sum()), int(top[once].sum()))] + [(*x, None, None) for x in m.send(tables)]
        give_back()
        return frame(rows, ["part", "src", "sums", "state", "customers", "tops"])

    return run


def _ask_owners(parts: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a block: the numbers of its words, to the parts that own them as restaurants."""
        number = np.sort(np.append(START, np.concatenate([unpack_ints(x) for x in pdf["numbers"]])))
        owner = number % parts
        return frame([(int(p), int(key[0]), pack_ints(np.diff(number[owner == p], prepend=0)), None, None) for p in np.unique(owner)], ["part", "src", "asked", "sweep", "sums"])

    return run


def _tell_tables(kept: list[int]):
    def run(key, owned: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        """At the owner: to each block the tables of the restaurants it asked for, after each kept sweep."""
        asked, sent = letters[letters["asked"].notna()], letters[letters["sums"].notna()]
        if not len(asked) or not len(owned):  # numbers that stand before no word
            return frame([], ["g", "kind", "part", "data"])
        owner, rows = Owner(owned), []
        totals = [owner.totals(sent[sent["sweep"] == k]) for k in kept]
        for g, x in zip(asked["src"], asked["asked"]):
            number = np.cumsum(unpack_ints(x))
            number = number[np.isin(number, owner.keys)]
            at = np.searchsorted(owner.keys, number)
            rows.append((int(g), TABLES, int(key[0]), bundle(number=np.diff(number, prepend=0), **{f"t{i}": t[at] for i, t in enumerate(totals)})))
        return frame(rows, ["g", "kind", "part", "data"])

    return run


def _tell_pairs(kept: list[int], parts: int):
    def run(key, pdf: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        """To each block of its pairs the customers and the sum of tables over kept sweeps, and of its words the customers
        and tables at the parent in each."""
        if not len(pdf):
            return frame([], ["g", "kind", "part", "data"])
        m = _model(pdf.iloc[0], parts)
        tables = np.minimum(m.count, 1) * len(kept)
        each = {int(k): unbundle(s) for k, s in zip(states["sweep"], states["state"])}
        tables[m.many] = sum(each[k]["tables"] for k in kept)
        rows = []
        for g, place in zip(pdf["gs"].iloc[0], pdf["places"].iloc[0]):
            at = np.cumsum(unpack_ints(place))
            words = m.word_at[at]  # ascending, as a block's pairs are
            words = words[np.diff(words, prepend=-1) > 0]
            parent = {f"{n}{i}": each[k][n][words] for i, k in enumerate(kept) for n in ("mine", "top")}
            rows.append((int(g), PAIRS, m.part, bundle(count=m.count[at], tables=tables[at], words=np.diff(m.words[words], prepend=0), **parent)))
        give_back()
        return frame(rows, ["g", "kind", "part", "data"])

    return run


def _score(n: float, vocabulary: float, known: dict, kept: list[int], parts: int, shard: int):
    def run(key, pdf: pd.DataFrame, letters: pd.DataFrame) -> pd.DataFrame:
        """A block's texts under both models."""
        b = Block(pdf.iloc[0], letters[letters["kind"] == NUMBERS].rename(columns={"data": "numbers"}))
        order = np.argsort(b.number)
        number = np.append(START, b.number[order])
        customers = np.append(b.count[np.flatnonzero(b.number == b.word[-1])], b.count[order])  # each text has one start and one end
        seats, mine, top = (np.zeros((len(kept), len(number)), np.int64) for _ in range(3))
        for data in letters.loc[letters["kind"] == TABLES, "data"]:
            x = unbundle(data)
            at = np.searchsorted(number, np.cumsum(x["number"]))
            for i in range(len(kept)):
                seats[i, at] = x[f"t{i}"]
        told = {int(p): unbundle(x) for p, x in zip(*(letters.loc[letters["kind"] == PAIRS, c] for c in ("part", "data")))}
        count, tables = np.zeros(len(b.pairs), np.int64), np.zeros(len(b.pairs), np.int64)
        for p, where, _ in b.dealt(parts, shard):
            x = told[p]
            count[where], tables[where] = x["count"], x["tables"]
            at = np.searchsorted(number, np.cumsum(x["words"]))
            for i in range(len(kept)):
                mine[i, at], top[i, at] = x[f"mine{i}"], x[f"top{i}"]
        word, before = np.searchsorted(number, b.pairs >> 32), np.searchsorted(number, b.pairs & 0xFFFFFFFF)
        d, total = known["discount"], 0.0
        for i, k in enumerate(kept):
            parent = _parent(mine[i], top[i], known["sums"][k - 1][0], known["sums"][k][1], known)
            total = total + (STRENGTH + d * seats[i, before]) * parent[word]
        value = np.log10((count - d * tables / len(kept) + total / len(kept)) / (customers[before] + STRENGTH))
        owner = np.repeat(np.arange(len(b.sizes)), b.sizes)
        c = b.count[b.at]
        base = np.bincount(owner, np.log10(c + 1.0), len(b.sizes)) - b.sizes * np.log10(n + vocabulary + 1)
        score = np.bincount(owner, value[b.pair], len(b.sizes))
        give_back()
        return pd.DataFrame({"doc_id": b.ids, "held_out": b.held_out, "n_tokens": b.sizes, "n_known": np.bincount(owner, c > 0, len(b.sizes)).astype(np.int64), "train_tokens": int(n), "base_score": base, "score": score, "perplexity": 10 ** (-score / b.sizes)})

    return run


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, part: int = PART, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity): log10 probabilities of whole
    texts under the add-one unigram base and the hierarchical Pitman-Yor model, both learned from all rows whose crc32
    of the id as text is not `held_out` modulo `folds`. Tokens are words, A-Z in lower case, and one end.

    Null text counts as empty (an end alone); a null id counts as the text '' in the fold; rows repeat freely; with no
    training rows the model is its base; an empty table gives an empty result; other columns, whatever their names, are
    ignored. Words are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    buckets, tables = partitions(spark), Stored(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_out
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), fold.alias("held_out"))

    # Blocks, a row each, lie in buckets, so that what is told to them meets them without their being shuffled.
    blocks = tables.put_buckets(rows.mapInArrow(_tokenise(block), "g long, tokens long, docs binary, words binary, body binary"), "blocks", "g", buckets)
    # Parts follow the corpus, not the setting of partitions: what they send one another is a row for each two.
    tokens = blocks.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return spark.createDataFrame([], result)
    parts = -(-tokens // part)
    blocks = blocks.select("g", "docs", "words", "body")
    asked = blocks.select("g", "words", "body").mapInArrow(tidy(_ask_words(parts)), "part int, g long, words binary, train binary")
    words = tables.put(asked.groupBy("part").applyInPandas(_count_words, "part int, counts binary, gs array<long>, places array<binary>, classes array<long>, n long, v long, one long, two long"), "words")
    sizes = words.select("part", "classes").collect()
    classes = np.zeros((parts, 64), np.int64)
    for at, n in sizes:
        classes[at] = n
    flat = classes.T.ravel()  # class by class, each by part: the numbers hang on the corpus alone
    first = (1 + np.cumsum(flat) - flat).reshape(64, parts).T
    n, vocabulary = (float(x) for x in words.agg(F.sum("n"), F.sum("v")).first())
    numbered = tables.put(words.select("part", "counts", "gs", "places").mapInArrow(_number_words(first), "g long, part int, numbers binary, counts binary"), "numbers")
    tables.drop("words")

    pairs = blocks.groupBy("g").cogroup(numbered.groupBy("g")).applyInPandas(_ask_pairs(parts, shard), "part int, g long, pairs binary")
    shape = "part int, pairs binary, gs array<long>, places array<binary>, owners array<int>, keys array<binary>, seen array<long>"
    model = tables.put_buckets(pairs.groupBy("part").applyInPandas(_gather(parts), shape), "model", "part", buckets)
    owned = model.select(F.col("part").alias("src"), F.explode(F.arrays_zip("owners", "keys")).alias("x")).select(F.col("x.owners").alias("part"), "src", F.col("x.keys").alias("keys"))
    owned = tables.put_buckets(owned.repartition(buckets, "part"), "owned", "part", buckets)
    one, two, up_one, up_two = (float(x) for x in model.agg(*(F.sum(F.col("seen")[i]) for i in range(4))).first())
    rate = lambda a, b: float(round(min(0.95, max(0.05, a / (a + 2 * b))), 3)) if a + b else 0.5
    known = {"base": 1 / (vocabulary + 1), "discount": rate(one, two), "parent_discount": rate(up_one, up_two), "sums": {}}
    model = model.select("part", "pairs", "gs", "places")

    state, sums, kept = None, (0.0, 0.0), list(range(BURN_IN, SWEEPS))
    for sweep in range(-1, SWEEPS):
        letters = spark.createDataFrame([], LETTER)
        if state is not None:
            totals = owned.groupBy("part").cogroup(state.filter("src is not null").groupBy("part")).applyInPandas(_add_up, LETTER)
            letters = totals.union(state.filter("src is null").select("part", "src", "sums", "state"))
        state = model.select("part", "pairs").groupBy("part").cogroup(letters.groupBy("part")).applyInPandas(_sweep(sweep, sums, known, parts), LETTER + ", customers long, tops long")
        state = tables.put(state, f"sweep{sweep}" if sweep in kept else "sweep")
        sums = tuple(float(x) for x in state.agg(F.sum("customers"), F.sum("tops")).first())
        known["sums"][sweep] = sums
    tables.drop("sweep")

    states = reduce(DataFrame.union, (spark.read.schema(LETTER).parquet(tables.paths[f"sweep{k}"]).withColumn("sweep", F.lit(k)) for k in kept))
    ask = numbered.groupBy("g").applyInPandas(_ask_owners(parts), "part int, src long, asked binary, sweep int, sums binary")
    sent = states.filter("src is not null").select("part", F.col("src").cast("long").alias("src"), F.lit(None).cast("binary").alias("asked"), "sweep", "sums")
    letter = "g long, kind int, part int, data binary"
    seats = owned.groupBy("part").cogroup(ask.union(sent).groupBy("part")).applyInPandas(_tell_tables(kept), letter)
    told = model.groupBy("part").cogroup(states.filter("src is null").select("part", "sweep", "state").groupBy("part")).applyInPandas(_tell_pairs(kept, parts), letter)
    numbers = numbered.select("g", F.lit(NUMBERS).alias("kind"), "part", F.col("numbers").alias("data"), "counts")
    letters = seats.union(told).withColumn("counts", F.lit(None).cast("binary")).union(numbers)
    return blocks.groupBy("g").cogroup(letters.groupBy("g")).applyInPandas(_score(n, vocabulary, known, kept, parts, shard), result)
