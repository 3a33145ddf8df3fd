"""Exact n-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

Sets are cut into segments by hashing their tokens (here: 5-word shingles) modulo M, a number fixed for each band of
set sizes. Two sets whose difference is smaller than the sum of their segments' weights must agree on some segment: on
the whole of it (weight 1), or up to one token (weight 2; both sets then index the segment with each token left out
too). Empty segments agree trivially, so they carry no weight; M and the weights of a band are the cheapest, over
measured numbers of keys, under which every set of the band keeps enough weight in what is left. So no pair is lost.

Tokens are 64-bit hashes of shingles while candidates are searched; what is linked is decided on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, Stored, give_back, mix, pack_sorted, partitions, rolling, tidy, unpack_sorted, word_hashes
from .components import components

WORDS = 5
#: Candidate plans of a band: segments per token of its largest set, the share of segments of weight 2, and the largest
#: set for which the plan is measured. Long sets never need many segments.
PLANS = [(0.31, 0.0, 1 << 40), (0.36, 0.0, 1 << 40), (0.45, 0.0, 1 << 40), (0.45, 1.0, 1 << 40), (0.7, 0.0, 1 << 40), (1.5, 0.0, 128), (8.0, 0.0, 128)]
#: For sets whose keys are hot: few, long segments, each with one token left out in turn. The first that fits is taken.
COARSE = [(f, 1.0, 1 << 40) for f in (0.12, 0.135, 0.15, 0.18, 0.25, 0.4, 0.8)] + [(1.5, 0.0, 128), (8.0, 0.0, 128)]
#: A key is hot if more sets share it.
HOT = 12
#: Rounds in which every bucket that is not yet of one class compares its members with one of them.
ROUNDS = 2
#: Sets that are compared with one another, by parity bits, in one step of a task.
BLOCK = 512
#: Pairs up to which the ids in them are broadcast to pick their texts: 8 bytes each.
FEW = 50_000
_U64 = np.uint64


_LOWER = TO_LOWER.tobytes()


def shingle_set(text: bytes | None, n: int = WORDS, salt: int = 0) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of n words (all words if there are fewer), ascending; A-Z in lower case."""
    words = word_hashes(text or b"", lower=True, salt=salt)[0]
    return np.unique(rolling(words, min(n, len(words)))) if len(words) else words


def word_list(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case (bytes.split cuts at the six blanks)."""
    return text.translate(_LOWER).split()


class Exact:
    """Sets of shingles by their words, which are numbered as they come: rows of whole numbers, distinct and sorted."""

    def __init__(self, n: int):
        self.n, self.number, self.epoch = n, {}, 0

    def __call__(self, text: bytes) -> np.ndarray:
        words = word_list(text)
        if len(self.number) + len(words) >= 1 << 20:
            self.number, self.epoch = {}, self.epoch + 1
        number = self.number
        at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        k = min(self.n, len(at))
        # Two words to an integer; a text of fewer words than n says how many.
        rows = np.lib.stride_tricks.sliding_window_view(at, k)
        packed = [rows[:, i] << 32 | (rows[:, i + 1] if i + 1 < k else 0) for i in range(0, k, 2)]
        return _distinct_rows(np.stack([*packed, np.full(len(rows), k)], 1))


def _distinct_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T)]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    if a.shape[1] != b.shape[1]:
        return 0
    return len(a) + len(b) - len(_distinct_rows(np.concatenate([a, b])))


class Bands:
    """Size bands whose largest set is at most 100 / per times the smallest; per / 100 is the threshold."""

    def __init__(self, per: int = 80):
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1], low[-1] * 100 // per) + 1)
        self.per, self.low = per, np.array(low)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def largest(self, band: np.ndarray) -> np.ndarray:
        return self.low[band + 1] - 1

    def need(self, n: np.ndarray) -> np.ndarray:
        """The weight that finds every partner of at most n tokens: one more than the largest possible difference."""
        return 2 * n * (100 - self.per) // (100 + self.per) + 1

    def need_both(self, n: np.ndarray) -> np.ndarray:
        """The same for larger partners too."""
        return (n + n * 100 // self.per) * (100 - self.per) // (100 + self.per) + 1


def segments(per_token: float | np.ndarray, largest: np.ndarray) -> np.ndarray:
    """M, the number of segments of the sets of a band."""
    return np.maximum(1, np.ceil(per_token * largest)).astype(np.int64)


class Block:
    """Sets laid end to end, cut into segments by hashing: segment `gid` of a set is one of its m."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        self.tokens = np.concatenate(sets)
        self.owner = np.repeat(np.arange(len(sets)), self.n)

    def cut(self, m: np.ndarray):
        self.m, self.offset = m, np.cumsum(m) - m
        self.gid = self.offset[self.owner] + (self.tokens % m.astype(np.uint64)[self.owner]).astype(np.int64)
        self.size = np.bincount(self.gid, minlength=int(m.sum()))
        self.segment = np.arange(len(self.size)) - np.repeat(self.offset, m)
        self.set_of = np.repeat(np.arange(len(m)), m)

    def by_set(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), self.offset)

    def double(self, heavy: np.ndarray) -> np.ndarray:
        """Which segments have weight 2: those with two tokens or more among each set's first `heavy`."""
        return (self.segment < np.repeat(heavy, self.m)) & (self.size >= 2)

    def weight(self, double: np.ndarray) -> np.ndarray:
        """What counts of each set's weight: nothing for empty segments, 1 for single tokens."""
        return self.by_set((self.size > 0) + double).astype(np.int64)

    def cost(self, double: np.ndarray) -> np.ndarray:
        """Keys of each set; keys of one or two tokens, which meet unrelated sets more often, cost more."""
        size, left_out = self.size, np.where(double, self.size, 0)
        return self.by_set((size > 0) + left_out + 3.0 * ((size == 1) + 2 * (left_out == 2)) + (size == 2) + 3 * (left_out == 3))

    def keys(self, band: np.ndarray, double: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of all segments, and of all segments of weight 2 with each token left out; whose they are."""
        code = mix(self.tokens)
        low = np.bincount(self.gid, (code & _U64(0xFFFFFFFF)).astype(np.float64), len(self.size)).astype(np.uint64)
        high = np.bincount(self.gid, (code >> _U64(32)).astype(np.float64), len(self.size)).astype(np.uint64)
        total = low + (high << _U64(32)) + mix(self.segment.astype(np.uint64) + ((band + 1).astype(np.uint64) << _U64(40))[self.set_of])
        full, part = self.size > 0, double[self.gid]
        return mix(np.concatenate([total[full], total[self.gid[part]] - code[part]])), np.concatenate([self.set_of[full], self.owner[part]])


def _blocks(texts, words: int, salt: int, most: int = 1 << 15) -> Iterator[list[np.ndarray]]:
    """The shingle sets of texts, in blocks of bounded size."""
    sets, held = [], 0
    for text in texts:
        sets.append(shingle_set(_plain(text.as_py()), words, salt))
        held += len(sets[-1])
        if held >= most:
            yield sets
            sets, held = [], 0
    if sets:
        yield sets


_CODEC = pa.Codec("zstd")


def _pack(text: bytes) -> bytes:
    """Compressed text behind its length; the first byte, 255, begins no UTF-8 text."""
    return b"\xff" + len(text).to_bytes(4, "little") + _CODEC.compress(text, asbytes=True)


def _plain(text: bytes | None) -> bytes | None:
    return _CODEC.decompress(text[5:], int.from_bytes(text[1:5], "little"), asbytes=True) if text and text[0] == 255 else text


def _node(s: np.ndarray) -> int | None:
    return int(mix(mix(s).sum(keepdims=True) + _U64(len(s))).view(np.int64)[0]) if len(s) else None


def parity(s: np.ndarray) -> bytes:
    """One bit for each residue of tokens, set if an odd number of them have it; as many bits, a power of two, as make
    at least one a token, 64 at least. Where two sets' bits differ, a token differs; longer ones are folded."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(a.reshape(-1, size), axis=0)


def _may_link(per: int):
    """Drops pairs (u, v, n_u, n_v, s_u, s_v) whose bits differ in more places than linked sets can."""

    def run(batches):
        for batch in batches:
            keep = []
            for n_u, n_v, a, b in zip(*(batch.column(c).to_pylist() for c in ("n_u", "n_v", "s_u", "s_v"))):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                size = min(len(a), len(b))
                differ = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
                keep.append(differ * (100 + per) <= (n_u + n_v) * (100 - per))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v", "n_u", "n_v"])

    return run


def _within(per: int):
    """Group step of some small buckets (bucket, node, n, root, parity): their pairs of different classes which sizes and
    parity bits let link. Row i meets row i + 1, i + 2 and so on while the bucket lasts; only those pairs leave the task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "node"], kind="stable")
        bucket, node, n, root = (pdf[c].to_numpy() for c in ("bucket", "node", "n", "root"))
        bits = [np.frombuffer(x, np.uint8) for x in pdf["parity"]]
        short = np.stack([_fold(x, 8) for x in bits])
        out, step = [np.zeros((0, 2), np.int64)], 1
        while True:
            i = np.flatnonzero(bucket[:-step] == bucket[step:])
            if not len(i):
                break
            j = i + step
            total = n[i] + n[j]
            fits = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * per) & (np.bitwise_count(short[i] ^ short[j]).sum(axis=1, dtype=np.int64) * (100 + per) <= total * (100 - per))
            out.append(np.stack([i[fits], j[fits]], 1))
            step += 1
        seen, keep = set(), []
        for i, j in np.concatenate(out).tolist():
            pair = (node[i], node[j])
            if pair not in seen:
                seen.add(pair)
                size = min(len(bits[i]), len(bits[j]))
                if int(np.bitwise_count(_fold(bits[i], size) ^ _fold(bits[j], size)).sum()) * (100 + per) <= (n[i] + n[j]) * (100 - per):
                    keep.append((*pair, n[i], n[j]))
        return pd.DataFrame(keep, columns=["u", "v", "n_u", "n_v"]) if keep else pd.DataFrame({c: [] for c in ("u", "v", "n_u", "n_v")})

    return run


def _cross(per: int):
    """Group step of two blocks of sets (node, n, root, parity, block): all pairs of different classes across the blocks
    (within, if they are the same) which sizes and parity bits let link. Only those leave the task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, a, b = key
        out = []
        parts = {}
        for (k, size), g in pdf.groupby(["block", pdf["parity"].map(len)]):
            parts[k, size] = (g, np.stack([np.frombuffer(x, np.uint8) for x in g["parity"]]))
        for (k1, size1), (g1, p1) in parts.items():
            for (k2, size2), (g2, p2) in parts.items():
                if k1 != a or k2 != b:
                    continue
                size = min(size1, size2)
                f1, f2 = (np.bitwise_xor.reduce(p.reshape(len(p), -1, size), axis=1) for p in (p1, p2))
                n1, n2, r1, r2, v1, v2 = (g[c].to_numpy() for c in ("n", "root", "node") for g in (g1, g2))
                for at in range(0, len(f1), max(1, (1 << 24) // (len(f2) * size))):
                    some = slice(at, at + max(1, (1 << 24) // (len(f2) * size)))
                    differ = np.bitwise_count(f1[some, None] ^ f2[None]).sum(axis=2, dtype=np.int64)
                    total = n1[some, None] + n2[None]
                    fits = (differ * (100 + per) <= total * (100 - per)) & (r1[some, None] != r2[None]) & (np.minimum(n1[some, None], n2[None]) * 100 >= np.maximum(n1[some, None], n2[None]) * per)
                    i, j = np.nonzero(fits)
                    i = i + at
                    low = v1[i] < v2[j]
                    out.append(np.stack([np.where(low, v1[i], v2[j]), np.where(low, v2[j], v1[i]), np.where(low, n1[i], n2[j]), np.where(low, n2[j], n1[i])], 1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64), columns=["u", "v", "n_u", "n_v"])

    return run


def _describe(bands: Bands, words: int, salt: int, plans=PLANS, texts: bool = False):
    """Map step: (id, n, node) per row, with texts its compressed text z and a digest of its words too, and per task one
    row (band, plan, spare, cost) for each plan it measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare: dict[tuple[int, int], int] = {}
        cost: dict[tuple[int, int], float] = defaultdict(float)
        kind = pa.int64()
        for batch in batches:
            ids, ns, nodes, bits = batch.column(0), [], [], []
            kind = ids.type
            for sets in _blocks(batch.column(1), words, salt):
                ns += [len(s) for s in sets]
                nodes += [_node(s) for s in sets]
                bits += [parity(s) if len(s) else None for s in sets]
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                cut = done = None
                for k, (per_token, share, largest) in enumerate(plans):
                    if (per_token, largest) != cut:
                        cut, mine = (per_token, largest), [x for x in sets if bands.largest(bands.band(len(x))) <= largest]
                    if not mine:
                        continue
                    if cut != done:
                        done = cut
                        block = Block(mine)
                        band = bands.band(block.n)
                        block.cut(segments(per_token, bands.largest(band)))
                    double = block.double(np.ceil(share * block.m))
                    left = block.weight(double) - bands.need(block.n)
                    price = block.cost(double)
                    for b in np.unique(band):
                        mine_too = band == b
                        spare[b, k] = min(spare.get((b, k), 1 << 30), int(left[mine_too].min()))
                        cost[b, k] += float(price[mine_too].sum())
            empty = pa.nulls(len(ns))
            z = digest = empty.cast(pa.binary())
            if texts:
                full = [x if n else None for x, n in zip(batch.column(1).to_pylist(), ns)]
                z = pa.array([x and _pack(x) for x in full], pa.binary())
                digest = pa.array([x and hashlib.blake2b(b" ".join(word_list(x)), digest_size=32).digest() for x in full], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), empty.cast(pa.int32()), empty.cast(pa.int32()), empty.cast(pa.int64()), empty.cast(pa.float64()), z, digest], _NAMES)
        at = sorted(spare)
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays([none.cast(kind), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] for x in at], pa.int32()), pa.array([spare[x] for x in at], pa.int64()), pa.array([cost[x] for x in at], pa.float64()), none.cast(pa.binary()), none.cast(pa.binary())], _NAMES)

    return run


_NAMES = ["id", "n", "node", "parity", "band", "plan", "spare", "cost", "z", "digest"]
_SHAPE = "n long, node long, parity binary, band int, plan int, spare long, cost double, z binary, digest binary"


def choose_plans(measured: DataFrame, plans=PLANS, cheapest: bool = True) -> dict[int, tuple[float, float]]:
    """The cheapest plan of each band, or the first, under which no set of the band lacks weight. At most one row per
    band and plan reaches the driver, a few hundred whatever the input."""
    best: dict[int, tuple[float, int]] = {}
    bands = set()
    for band, k, spare, cost in measured.groupBy("band", "plan").agg(F.min("spare"), F.sum("cost")).collect():
        bands.add(band)
        rank = (cost if cheapest else 0.0, k)
        if spare >= 0 and (band not in best or rank < best[band]):
            best[band] = rank
    if bands - set(best):
        raise ValueError(f"no plan fits the size bands {sorted(bands - set(best))}")
    return {band: plans[k][:2] for band, (_, k) in best.items()}


def _index(bands: Bands, plans: dict[int, tuple[float, float]], parts: int, words: int, salt: int, most: int = 1 << 18):
    """Map step: keys dealt to parts, packed. A row is (part, keys, refs, nodes, known): ascending differences of keys;
    for each key its set's place in nodes, with bit 15 set for keys under the plan of the next larger band; and per set
    its node, size and the weight it can spare under either plan. Copies in one block are indexed once.

    A key that more than HOT sets of a block share is hot whatever other blocks hold: HOT + 1 of them tell so to the
    key's part, and what the rest are to learn from it goes, as rows of whole numbers (key, node, n, up, spare, weight),
    to parts dealt by node. So a key in a third of all sets sends a few places a block to one part, not all."""
    limit = HOT

    def flush(keys, refs, table):
        keys, refs = np.concatenate(keys), np.concatenate(refs)
        part = (keys % _U64(parts)).astype(np.int64)
        order = np.lexsort((keys, part))
        keys, refs, part = keys[order], refs[order], part[order]
        table = np.array(table, np.int64)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        place = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
        rest = np.flatnonzero(place > limit)
        out = []
        if len(rest):
            row, up = table[refs[rest] & 0x7FFF], refs[rest] >> 15
            band = bands.band(row[:, 1]) + up
            known = np.stack([_named(keys[rest] >> _U64(24)), row[:, 0], row[:, 1], up, row[np.arange(len(rest)), 2 + up], 1 + double_band[band]], 1)
            to = (mix(row[:, 0].astype(np.uint64)) % _U64(parts)).astype(np.int64)
            out += [(int(p), b"", b"", b"", known[to == p].astype("<i8").tobytes()) for p in np.unique(to)]
        stay = place <= limit
        keys, refs, part = keys[stay] >> _U64(24), refs[stay], part[stay]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(part)]):
            used, ref = np.unique(refs[a:b] & 0x7FFF, return_inverse=True)
            mine = (ref | (refs[a:b] & 0x8000)).astype("<u2")
            rows = table[used]
            packed = rows[:, 0].astype("<i8").tobytes() + rows[:, 1:].astype("<i4").tobytes()
            out.append((int(part[a]), pack_sorted(keys[a:b]), mine.tobytes(), packed, None))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "keys", "refs", "nodes", "known"])

    per_token = np.array([plans.get(b, (0, 0))[0] for b in range(len(bands.low) + 1)])
    share = np.array([plans.get(b, (0, 0))[1] for b in range(len(bands.low) + 1)])
    double_band = (share > 0).astype(np.int64)

    def run(batches):
        keys, refs, table, seen, held = [], [], [], set(), 0
        for batch in batches:
            for sets in _blocks(batch.column(0), words, salt):
                named = {_node(s): s for s in sets if len(s)}
                named = {k: s for k, s in named.items() if k not in seen}
                if len(table) + len(named) > 0x7FFF:
                    yield flush(keys, refs, table)
                    keys, refs, table, seen, held = [], [], [], set(), 0
                if not named:
                    continue
                seen.update(named)
                names, sets = np.array(list(named)), list(named.values())
                n = np.array([len(s) for s in sets])
                spare = np.full((len(sets), 2), -(1 << 30))
                for up in (0, 1):
                    band = bands.band(n) + up
                    on = np.flatnonzero(per_token[band])
                    if len(on):
                        block, band = Block([sets[i] for i in on]), band[on]
                        block.cut(segments(per_token[band], bands.largest(band)))
                        double = block.double(np.ceil(share[band] * block.m))
                        spare[on, up] = block.weight(double) - bands.need_both(n[on])
                        k, whose = block.keys(band, double)
                        keys.append(k)
                        refs.append(on[whose] + len(table) | up << 15)
                        held += len(k)
                table += zip(names.tolist(), n.tolist(), *spare.T.tolist())
                if held >= most:
                    yield flush(keys, refs, table)
                    keys, refs, table, seen, held = [], [], [], set(), 0
        if held:
            yield flush(keys, refs, table)

    return tidy(run)


_INDEX = "part int, keys binary, refs binary, nodes binary, known binary"


def _named(keys: np.ndarray) -> np.ndarray:
    """The name of the bucket of a hot key; keys without the bits that tell the part."""
    return mix(keys + _U64(1 << 50)).view(np.int64)


def _buckets(bands: Bands, plans: dict[int, tuple[float, float]], gather: bool = False):
    """Group step of one part: the sets that share a key. Rows (bucket, node, n, up, spare, weight): a bucket is named
    by its sets, so equal ones, from any key, are one. Keys of more than HOT sets make no bucket, but rows of no bucket
    that tell what each set's hot keys of this part weigh; with gather they do make buckets, named by the key."""
    limit = HOT

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = np.concatenate([np.frombuffer(x, "<i8") for x in pdf["known"] if x is not None] or [np.zeros(0, np.int64)]).reshape(-1, 6)
        pdf = pdf[pdf["known"].isna()]
        keys, refs, nodes, sizes, spares, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int32)], 0
        for k, r, t in zip(pdf["keys"], pdf["refs"], pdf["nodes"]):
            n = len(t) // 20
            nodes.append(np.frombuffer(t, "<i8", n))
            rest = np.frombuffer(t, "<i4", 3 * n, 8 * n).reshape(-1, 3)
            sizes.append(rest[:, 0])
            spares.append(rest[:, 1:])
            keys.append(unpack_sorted(k))
            r = np.frombuffer(r, "<u2").astype(np.int64)
            refs.append(((r & 0x7FFF) + base) << 1 | r >> 15)
            base += n
        keys, refs, nodes, sizes, spares = (np.concatenate(x) for x in (keys, refs, nodes, sizes, spares))
        # Only keys that occur twice matter.
        order = np.argsort(keys, kind="stable")
        keys, refs = keys[order], refs[order]
        same = keys[1:] == keys[:-1]
        keep = np.append(same, False) | np.append(False, same) if len(keys) else np.zeros(0, bool)
        keys, refs = keys[keep], refs[keep]
        node = nodes[refs >> 1]
        order = np.lexsort((node, keys))
        keys, refs, node = keys[order], refs[order], node[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (node[1:] != node[:-1])) if len(keys) else np.zeros(0, bool)
        keys, refs, node = keys[fresh], refs[fresh], node[fresh]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        hot = count > limit
        out = [known] if gather else []
        if hot.any():
            at = np.repeat(first[hot], count[hot]) + _ramp(count[hot])
            n, up = sizes[refs[at] >> 1].astype(np.int64), refs[at] & 1
            double = np.isin(bands.band(n) + up, [b for b, plan in plans.items() if plan[1] > 0])
            known_here = np.stack([np.repeat(_named(keys[first[hot]]), count[hot]), node[at], n, up, spares[refs[at] >> 1, up].astype(np.int64), 1 + double], 1)
            out, known = ([*out, known_here], known) if gather else (out, np.concatenate([known, known_here]))
        first, count = first[(count > 1) & ~hot], count[(count > 1) & ~hot]
        if len(first):
            at = np.repeat(first, count) + _ramp(count)
            name = np.add.reduceat(mix(node[at].astype(np.uint64)), np.cumsum(count) - count)
            name = mix(name + count.astype(np.uint64)).view(np.int64)
            pick = np.unique(np.stack([name, (refs[first] & 1).astype(np.int64)], 1), axis=0, return_index=True)[1]
            at = np.repeat(first[pick], count[pick]) + _ramp(count[pick])
            zero = np.zeros(len(at), np.int64)
            out.append(np.stack([np.repeat(name[pick], count[pick]), node[at], sizes[refs[at] >> 1].astype(np.int64), refs[at] & 1, zero, zero], 1))
        found = pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 6), np.int64), columns=_BUCKET_NAMES).astype({"bucket": "Int64"})
        if not gather and len(known):
            h = pd.DataFrame(known, columns=_BUCKET_NAMES).groupby(["node", "up"], as_index=False).agg(n=("n", "first"), spare=("spare", "first"), weight=("weight", "sum"))
            found = pd.concat([found, h.assign(bucket=pd.NA).astype({"bucket": "Int64"})[_BUCKET_NAMES]])
        give_back()
        return found

    return run


_BUCKET_NAMES = ["bucket", "node", "n", "up", "spare", "weight"]
_BUCKET_SHAPE = "bucket long, node long, n long, up int, spare long, weight long"


def _ramp(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _verify(words: int):
    """Map step of pairs (u, v, z_u, z_v): how many shingles each text has and how many are in both, counted on words."""

    def run(batches):
        exact, last, own = Exact(words), None, None
        for batch in batches:
            u, rows = batch.column(0).to_pylist(), []
            for a, za, zb in zip(u, batch.column(2), batch.column(3)):
                if last != (a, exact.epoch):
                    own = exact(_plain(za.as_py()))
                    last = (a, exact.epoch)
                other = exact(_plain(zb.as_py()))
                if exact.epoch != last[1]:  # numbers began anew
                    own = exact(_plain(za.as_py()))
                    last = (a, exact.epoch)
                rows.append((len(own), len(other), in_both(own, other)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ())))], ["u", "v", "m_u", "m_v", "both"])

    return tidy(run)


_PAIRS = "u long, v long, m_u long, m_v long, both long"


def similar_groups(docs: DataFrame, per: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", salt: int = 0) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id): exact classes of texts linked by a Jaccard similarity of per / 100
    or more of their sets of distinct word shingles. component_id is the smallest id reachable, its own included.

    1. Equal sets are one node, named by a 64-bit hash of the set. Texts of a node whose words are not in the same order
       (BLAKE2b of all words) are compared on their words; if two sets share a name, all starts anew with another salt.
       The same pass measures every plan on every set.
    2. Every set is indexed under its own band's plan and the next larger band's; keys travel packed, in as many
       parts as there are shuffle partitions. Keys that sets share make buckets.
    3. Keys that more than HOT sets share are left out for all sets that keep enough weight in other keys. So a passage
       in a third of all texts makes no large bucket. The sets that don't (near copies of one text, or little but the
       passage) are indexed among themselves again, under plans of few, long segments with one-deletion neighbourhoods.
    4. In each of ROUNDS rounds one node of a bucket is compared with all its others of other classes, on the words of
       the texts, and what that links is merged. What is still apart then in clusters of shared buckets is compared in
       blocks. Sizes and parity bits rule out what cannot link before texts are fetched.

    Null and wordless texts have 0 shingles and are alone. Rows with equal texts, repeated ids included, share their
    component; null ids are the smallest, so the component of one is null (set_id still tells sets apart). Other columns,
    whatever their names, are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    bands, tables = Bands(per), Stored(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    measured = tables.put(rows.mapInArrow(tidy(_describe(bands, words, salt, texts=True)), f"id {kind}, {_SHAPE}"), "sets")
    plans = choose_plans(measured.filter("band is not null"))
    found = measured.filter("band is null").select("id", "n", "node")
    # A struct, for F.min leaves nulls out: a null id is the smallest.
    firsts = measured.filter("node is not null").groupBy("node").agg(F.min(F.struct("id")).alias("first"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("parity").alias("parity"))
    firsts = tables.put(firsts, "firsts")
    if _names_clash(measured, firsts, words):
        tables.drop("sets", "firsts")
        return similar_groups(docs, per, words, id_col, text_col, salt + 1)
    signs = firsts.select("node", "parity")

    parts = partitions(spark)
    packed = rows.select("text").mapInArrow(_index(bands, plans, parts, words, salt), _INDEX)
    buckets = tables.put(packed.groupBy("part").applyInPandas(_buckets(bands, plans), _BUCKET_SHAPE), "buckets")
    members = buckets.filter("bucket is not null").select("bucket", "node", "n").distinct()
    poor = buckets.filter("bucket is null").groupBy("node", "up").agg((F.first("spare") < F.sum("weight")).alias("poor")).filter("poor").select("node").distinct()
    poor = tables.put(poor, "poor")

    wanted = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").select("bucket")
    wanted = members.join(wanted, "bucket", "left_semi").select("node").union(poor).distinct()
    texts = tables.put(measured.filter("node is not null").select("node", "z").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")

    again = texts.join(poor, "node", "left_semi").select("node", F.col("z").alias("text"))
    coarse = choose_plans(again.mapInArrow(tidy(_describe(bands, words, salt, COARSE)), f"id long, {_SHAPE}").filter("band is not null"), COARSE, cheapest=False)
    if coarse:
        packed = again.select("text").mapInArrow(_index(bands, coarse, parts, words, salt), _INDEX)
        fine = packed.groupBy("part").applyInPandas(_buckets(bands, coarse, gather=True), _BUCKET_SHAPE)
        members = members.union(fine.select("bucket", "node", "n")).distinct()
    members = tables.put(members, "members")
    tables.drop("buckets", "poor")

    near = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * per

    def linked(pairs: DataFrame, turn: int) -> DataFrame:
        """Of distinct pairs (u, v, n_u, n_v), u < v, those that are linked: by size, then parity bits, then texts."""
        signed = pairs.filter(near).join(signs.toDF("u", "s_u"), "u").join(signs.toDF("v", "s_v"), "v")
        pairs = tables.put(signed.mapInArrow(tidy(_may_link(per)), "u long, v long, n_u long, n_v long"), "pairs")
        some = texts
        if pairs.count() <= FEW:
            ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            some = texts.join(F.broadcast(ends), "node", "left_semi")
        full = pairs.select("u", "v").join(some.toDF("v", "z_v"), "v").join(some.toDF("u", "z_u"), "u").select("u", "v", "z_u", "z_v")
        both = full.mapInArrow(_verify(words), _PAIRS)
        return tables.put(both.filter(F.col("both") * 100 >= (F.col("m_u") + F.col("m_v") - F.col("both")) * per).select("u", "v"), f"links{turn}")

    def pair(a: str, n_a: str, b: str, n_b: str) -> list:
        low = F.col(a) < F.col(b)
        return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.when(low, F.col(n_a)).otherwise(F.col(n_b)).alias("n_u"), F.when(low, F.col(n_b)).otherwise(F.col(n_a)).alias("n_v")]

    def still_apart(members: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Members of the buckets that hold more than one class. Two members have met in the first round."""
        placed = members.drop("root").withColumn("root", F.col("node")) if roots is None else members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size")).filter("a <> b" if roots is None else "a <> b and size > 2").select("bucket")
        return tables.put(placed.join(mixed, "bucket", "left_semi").select("bucket", "node", "n", "root"), "apart")

    def across(members: DataFrame) -> DataFrame:
        """Pairs of classes that are still apart. Buckets of up to HOT nodes look at all their pairs. Larger ones join
        into clusters of nodes that they connect, so that no pair is looked at for each of its many buckets; a cluster
        is dealt to blocks of about BLOCK nodes and each pair of blocks is one group. Only pairs that may link leave."""
        size = members.groupBy("bucket").agg(F.count("*").alias("size"))
        members = members.join(size, "bucket")
        small = members.filter(F.col("size") <= HOT).join(signs, "node").withColumn("g", F.pmod("bucket", F.lit(8 * parts)))
        near_by = small.repartition(parts, "g").groupBy("g").applyInPandas(_within(per), "u long, v long, n_u long, n_v long")
        large = tables.put(members.filter(F.col("size") > HOT).select("bucket", "node", "n", "root"), "large")
        if large.isEmpty():
            return near_by
        least = large.groupBy("bucket").agg(F.min("node").alias("v"))
        cluster = components(large.join(least, "bucket").select(F.col("node").alias("u"), "v"), tables, "clusters").toDF("node", "cluster")
        nodes = large.select("node", "n", "root").distinct().join(cluster.distinct(), "node").join(signs, "node")
        blocks = nodes.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        nodes = nodes.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        nodes = nodes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        nodes = nodes.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).select("cluster", "a", "b", "node", "n", "root", "parity", "block")
        # A number of partitions of its own: AQE would join small rows, but each group takes long.
        return near_by.union(nodes.repartition(parts, "cluster", "a", "b").groupBy("cluster", "a", "b").applyInPandas(_cross(per), "u long, v long, n_u long, n_v long"))

    links = roots = None
    for turn in range(ROUNDS + 1):
        members = still_apart(members, roots)
        if members.isEmpty():
            break
        if turn < ROUNDS:
            # Another centre each time: whatever belongs to a class meets most of it soon.
            centre = members.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64(F.lit(turn), "node")).alias("c"))
            pairs = members.join(centre, "bucket").filter("root <> c.root").select(*pair("node", "n", "c.node", "c.n"))
        else:
            pairs = across(members)
        found_now = linked(pairs.distinct(), turn)
        links = found_now if links is None else links.union(found_now)
        roots = components(links, tables, "roots")
    if roots is None:
        roots = spark.createDataFrame([], "node long, root long")
    least = firsts.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = least.groupBy("root").agg(F.min("first").alias("least"))
    named = tables.put(least.join(names, "root").select("node", F.col("least.id").alias("component_id")), "named")
    tables.drop(*(n for n in list(tables.paths) if n not in ("sets", "named")))
    out = found.join(named, "node", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("node").alias("set_id"))


def _names_clash(measured: DataFrame, firsts: DataFrame, words: int) -> bool:
    """Whether some texts of one node have different sets of shingles, by their words. Only texts whose words differ
    from those of the node's first digest are looked at, one for each digest."""
    mixed = firsts.filter("low <> high")
    if mixed.isEmpty():
        return False
    forms = measured.filter("node is not null").select("node", "digest", "z").join(mixed.select("node", "low"), "node").dropDuplicates(["node", "digest"])
    first = forms.filter("digest = low").select("node", F.col("z").alias("z_u"))
    pairs = forms.filter("digest <> low").join(first, "node").select(F.col("node").alias("u"), F.col("node").alias("v"), "z_u", F.col("z").alias("z_v"))
    return not pairs.mapInArrow(_verify(words), _PAIRS).filter("both <> m_u or both <> m_v").isEmpty()
