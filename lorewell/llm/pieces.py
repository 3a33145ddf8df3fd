"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts become code points; blanks become the blank mark, and a word is a run of characters that starts at a mark. All
distinct words of a block are encoded once, words of equal length advancing together: at every position, the hashes
of the substrings that end there probe the sorted piece keys, and the best admissible piece leaves a backpointer.

For a unigram model a piece's value is the best sum of scores before it plus its own. A BPE model's encoding is not the
one of the best sum; it is the only one in which no two neighbours would have merged differently. So there a piece is
admissible behind the last piece of the prefix only if replaying both pieces' merges, latest first, meets no better merge
across their border. One piece remains at each position then: for a BPE model the pass has a Viterbi pass's shape (batches,
hash probes, backpointers), but the tests of borders decide and the maxima have no choice. Both give the ids of the
sentencepiece library.
"""

from __future__ import annotations

import hashlib
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
_U64 = np.uint64
LONG = 40  # characters; longer words are told apart by BLAKE2b and encoded in smaller batches
_FAR = 0x200000  # added to a literal blank mark, so that no piece holds it and it is kept as bytes


# Random but fixed odd numbers of the polynomials that name substrings.
_ROOT, _POINT, _LENGTH = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """root**i and root**-i modulo 2**64 for i < n."""
    up, down = np.full(n, _ROOT, np.uint64), np.full(n, pow(_ROOT, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def code_of(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + _U64(_POINT))


def pair_code(points: np.ndarray) -> np.ndarray:
    """One number for each two neighbours."""
    return points[:-1] << 22 | points[1:]


@dataclass
class Pieces:
    """A model as sorted arrays, of fixed size."""

    text: list[bytes]  # what each id decodes to
    keys: np.ndarray  # hashes of the normal pieces, ascending
    ids: np.ndarray  # of the keys
    maybe: np.ndarray  # low hash bits that occur, to skip most probes
    raw: np.ndarray  # by id: polynomial of its characters
    length: np.ndarray  # by id: characters
    score: np.ndarray
    order: np.ndarray  # by id: rank of the merge that makes it, -1 for a single character
    left: np.ndarray
    right: np.ndarray
    usable: np.ndarray  # by id: whether it encodes to itself
    known: np.ndarray  # by code point: whether it is a piece
    byte: np.ndarray  # ids of the byte pieces
    unigram: bool
    longest: int
    inside: np.ndarray  # pairs of neighbouring characters that some piece holds, ascending
    runs: dict[int, list[int]] = field(default_factory=dict)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 where there is none."""
        out = np.full(h.shape, -1, np.int64)
        flat, res = h.ravel(), out.ravel()
        at = np.flatnonzero(self.maybe[(flat & _U64(len(self.maybe) - 1)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
        res[at] = np.where(self.keys[where] == flat[at], self.ids[where], -1)
        return res.reshape(h.shape)


def _hash(raw: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(raw + length.astype(np.uint64) * _U64(_LENGTH))


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names, score = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    is_byte = [i for i in range(n) if sp.is_byte(i)]
    # A unigram model adds scores; the library tells its kind only in the file, by the field model_type of trainer_spec.
    unigram = _model_type(sp.serialized_model_proto()) == 1
    up, _ = _powers(1 << 16)
    raw, length = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    known = np.zeros(0x110000 + _FAR, bool)
    for i in plain:
        points = np.frombuffer(names[i].encode("utf-32-le"), "<u4")
        raw[i], length[i] = (code_of(points) * up[: len(points)]).sum(), len(points)
        if len(points) == 1:
            known[points[0]] = True
    plain = np.array(plain)
    keys = _hash(raw[plain], length[plain])
    at = np.argsort(keys)
    maybe = np.zeros(1 << 20, bool)
    maybe[(keys & _U64((1 << 20) - 1)).astype(np.int64)] = True
    text = [bytes([is_byte.index(i)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(chr(MARK), " ").encode() for i in range(n)]
    order, left, right, usable = np.full(n, -1), np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
    many = plain[length[plain] > 1]
    order[many[np.argsort(-score[many], kind="stable")]] = np.arange(len(many))
    by_name = {names[i]: int(i) for i in plain}
    for i in plain.tolist():
        parts, last = _replay(names[i], by_name, score)
        usable[i] = len(parts) == 1
        left[i], right[i] = last
    inside = np.unique(np.concatenate([pair_code(np.frombuffer(names[i].encode("utf-32-le"), "<u4").astype(np.int64)) for i in plain.tolist()]))
    out = Pieces(text, keys[at], plain[at], maybe, raw, length, score, order, left, right, usable | unigram, known, np.array(is_byte), unigram, int(length.max()), inside)
    marks = chr(MARK)
    most = max((int(length[i]) for i in plain.tolist() if set(names[i]) == {marks}), default=1)
    for m in range(1, 4 * most + 1):
        out.runs[m] = [by_name[p] for p in _replay(marks * m, by_name, score)[0]]
    return out


def _model_type(proto: bytes) -> int:
    """trainer_spec (field 2) . model_type (field 3) of a serialised model; 1, unigram, is the default."""

    def fields(data):
        at = 0

        def varint():
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(data):
            tag = varint()
            if tag & 7 == 2:
                size = varint()
                yield tag >> 3, data[at : at + size]
                at += size
            elif tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                at += 4 if tag & 7 == 5 else 8

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1)


def _replay(name: str, by_name: dict[str, int], score: np.ndarray) -> tuple[list[str], tuple[int, int]]:
    """Merge a short string's characters, best score first, leftmost on ties; also the last merge's two pieces."""
    parts, last = list(name), (-1, -1)
    while True:
        best = min(((-score[by_name[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in by_name), default=None)
        if best is None:
            return parts, last
        i = best[1]
        last = (by_name.get(parts[i], -1), by_name.get(parts[i + 1], -1))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Encoder:
    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.memo = np.full(1 << 20, -1, np.int64)  # pairs already judged: pair << 1 | verdict

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand behind piece a: no merge across their border comes before those inside them."""
        pair = a * (1 << 24) + b
        slot = (mix(pair.astype(np.uint64)) & _U64(len(self.memo) - 1)).astype(np.int64)
        told = self.memo[slot]
        ok = (told & 1).astype(bool)
        new = np.flatnonzero(told >> 1 != pair)
        if len(new):
            unique, back = np.unique(pair[new], return_inverse=True)
            verdict = self._judge(unique >> 24, unique & 0xFFFFFF)
            ok[new] = verdict[back]
            self.memo[slot[new]] = pair[new] << 1 | ok[new]
        return ok

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, (up, _) = self.p, _powers(64)
        ok, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 30)
        while len(at):
            joint = p.find(_hash(p.raw[a] + up[p.length[a]] * p.raw[b], p.length[a] + p.length[b]))
            early = (joint >= 0) & (p.order[joint] < limit)
            ok[at[early]] = False
            go = ~early & ((p.order[a] >= 0) | (p.order[b] >= 0))
            a, b, at = a[go], b[go], at[go]
            first = p.order[a] > p.order[b]  # a was merged later than b; of equals, the right one
            limit = np.where(first, p.order[a], p.order[b] + 1)
            a, b = np.where(first, p.right[a], a), np.where(first, b, p.left[b])
        return ok

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode words of equal length, a row each: their ids from the right end, -1 beyond, and how many."""
        p, (n, size) = self.p, points.shape
        up, down = _powers(size + 1)
        raw = np.zeros((n, size + 1), np.uint64)
        np.cumsum(code_of(points) * up[:size], axis=1, out=raw[:, 1:])
        last, back = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int64)
        value = np.full((n, size + 1), -np.inf)
        value[:, 0] = 0
        for i in range(1, size + 1):
            lo = max(0, i - p.longest)
            start = np.arange(lo, i)
            piece = p.find(_hash((raw[:, i : i + 1] - raw[:, lo:i]) * down[start], np.broadcast_to(i - start, (n, i - lo))))
            row, col = np.nonzero((piece >= 0) & p.usable[piece])
            piece, from_ = piece[row, col], start[col]
            if p.unigram:
                gain = value[row, from_] + p.score[piece]
            else:
                before = last[row, from_]
                fits = from_ == 0
                check = np.flatnonzero(~fits)
                fits[check] = self.stands(before[check], piece[check])
                gain = np.where(fits, p.score[piece], -np.inf)
            table = np.full((n, i - lo), -np.inf)
            table[row, col] = gain
            best = table.argmax(axis=1)
            value[:, i] = table[np.arange(n), best]
            ids = np.full((n, i - lo), -1, np.int64)
            ids[row, col] = piece
            last[:, i], back[:, i] = ids[np.arange(n), best], start[best]
        at, out, count = np.full(n, size), np.full((n, size), -1, np.int64), np.zeros(n, np.int64)
        for step in range(size):
            on = at > 0
            if not on.any():
                break
            out[on, step] = last[on, at[on]]
            at = np.where(on, back[np.arange(n), at], 0)
            count += on
        return out, count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        p = self.p
        parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        size = np.array([len(x) + 1 if len(x) else 0 for x in parts])
        points = np.empty(int(size.sum()), np.int64)
        ends = np.cumsum(size)
        for x, e in zip(parts, ends):
            if len(x):
                x = x.astype(np.int64)
                x[x == MARK] += _FAR
                x[x == 32] = MARK
                points[e - len(x) - 1], points[e - len(x) : e] = MARK, x
        if not len(points):
            return [np.empty(0, np.int32) for _ in texts]
        known = p.known[points]
        start = (points == MARK) | ~known
        start[1:] |= ~known[:-1]
        start[ends[size > 0] - size[size > 0]] = True
        first = np.flatnonzero(start)
        length = np.diff(np.append(first, len(points)))
        # Long runs without blanks are cut where no piece can lie across.
        for a, n in zip(first[length > LONG].tolist(), length[length > LONG].tolist()):
            pair = pair_code(points[a : a + n])
            where = np.minimum(np.searchsorted(p.inside, pair), len(p.inside) - 1)
            start[a + 1 : a + n] |= p.inside[where] != pair
        first = np.flatnonzero(start)
        length = np.diff(np.append(first, len(points)))
        # Distinct words by hash, in short stretches so that powers stay within their table.
        up, down = _powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(code_of(points) * up[: len(points)], out=total[1:])
        name = mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))
        for i in np.flatnonzero(length > LONG).tolist():  # a polynomial can miss differences of long patterns
            name[i] = int.from_bytes(hashlib.blake2b(points[first[i] : first[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
        _, sample, word = np.unique(name, return_index=True, return_inverse=True)
        at, size_of = first[sample], length[sample]
        counts, offsets, flat, done = np.zeros(len(sample), np.int64), np.zeros(len(sample), np.int64), [], 0
        lone = ~known[at]
        flat.append(-points[at[lone]] - 1)
        counts[lone], offsets[lone], done = 1, np.arange(lone.sum()), int(lone.sum())
        long = size_of > LONG
        for n in np.unique(size_of[~lone & ~long]).tolist():
            mine = np.flatnonzero(~lone & (size_of == n))
            for a in range(0, len(mine), 1 << 14):
                some = mine[a : a + (1 << 14)]
                ids, count = self.words(points[at[some, None] + np.arange(n)])
                done = self._keep(ids, count, some, counts, offsets, flat, done)
        for n in np.unique(size_of[~lone & long]).tolist():
            mine = np.flatnonzero(~lone & (size_of == n))
            for a in range(0, len(mine), max(1, (1 << 18) // n)):
                some = mine[a : a + max(1, (1 << 18) // n)]
                ids, count = self.words(points[at[some, None] + np.arange(n)])
                done = self._keep(ids, count, some, counts, offsets, flat, done)
        flat = np.concatenate(flat)
        # Occurrences in order.
        per = counts[word]
        stop = np.cumsum(per)
        out = flat[np.repeat(offsets[word] - (stop - per), per) + np.arange(stop[-1])]
        text_of = np.searchsorted(ends, first, side="right")
        owner = np.repeat(text_of, per)
        out, owner = self._marks(out, owner)
        out, owner = self._bytes(out, owner)
        return [x.astype(np.int32) for x in np.split(out, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])]

    @staticmethod
    def _keep(ids, count, some, counts, offsets, flat, done):
        ids = ids[:, ::-1]
        flat.append(ids[ids >= 0])
        counts[some] = count
        offsets[some] = done + np.cumsum(count) - count
        return done + int(count.sum())

    def _marks(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join runs of blank marks that stand alone into the pieces that hold several; the model merges those last."""
        alone = self.p.runs[1][0]
        is_mark = ids == alone
        both = is_mark[1:] & is_mark[:-1] & (owner[1:] == owner[:-1])
        if not both.any():
            return ids, owner
        begin = np.flatnonzero(is_mark & ~np.append(False, both))
        end = np.flatnonzero(is_mark & ~np.append(both, False)) + 1
        keep, most = np.ones(len(ids), bool), max(self.p.runs)
        for a, b in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist()):
            m, new = b - a, []
            while m > most:  # leftmost merges first: a long run starts with whole longest pieces
                new += self.p.runs[most // 4]
                m -= most // 4
            new += self.p.runs[m]
            ids[a : a + len(new)] = new
            keep[a + len(new) : b] = False
        return ids[keep], owner[keep]

    def _bytes(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, owner
        unique, back = np.unique(ids[odd], return_inverse=True)
        spelled = [self.p.byte[list(chr(c - _FAR if c >= _FAR else c).encode("utf-8", "surrogatepass"))] for c in (-unique - 1).tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = np.array([len(s) for s in spelled])[back]
        at = np.repeat(np.arange(len(ids)), size)
        out = ids[at]
        step = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        table = np.zeros((len(spelled), 4), np.int64)
        for i, s in enumerate(spelled):
            table[i, : len(s)] = s
        row = np.zeros(len(ids), np.int64)
        row[odd] = back
        fill = out < 0
        out[fill] = table[row[at[fill]], step[fill]]
        return out, owner[at]


def decode(ids: np.ndarray, pieces: Pieces, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """UTF-8 bytes of a text's ids, without the blank that encoding puts in front."""
    data, start, size = table
    n = size[ids]
    stop = np.cumsum(n)
    out = data[np.repeat(start[ids] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
    return out[1:] if out[:1] == b" " else out


def piece_table(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in pieces.text])
    return np.frombuffer(b"".join(pieces.text), np.uint8), np.cumsum(size) - size, size


_SHARED: dict[str, object] = {}


def _encoder(shared) -> Encoder:
    """One encoder a worker and model: its memo lasts from task to task."""
    if _SHARED.get("of") != shared.id:
        _SHARED.update(of=shared.id, encoder=Encoder(shared.value))
    return _SHARED["encoder"]


class _Model:
    def __init__(self, spark, path: str):
        self.id, self.sent = path, spark.sparkContext.broadcast(load_pieces(path))

    @property
    def value(self) -> Pieces:
        return self.sent.value


def encode_texts(docs: DataFrame, path: str = MODEL, text_col: str = "text", block_chars: int = 3 << 18, decode_too: bool = False) -> DataFrame:
    """docs with a column ids, array<int>: every whole text in pieces of the model, and with decode_too a column decoded
    of the texts that those ids spell, from the same pass. Null stays null, empty text has no ids; repeated rows and equal
    texts encode alike; all columns of docs pass through (those named ids, and decoded if it is added, are replaced);
    an empty table gives an empty one.

    The model, of fixed size, is broadcast. A block of texts is bounded in characters, or one longer text. A word without
    blanks is cut where no piece can lie across; what is left of it, such as one letter a million times over, advances a
    character a step."""
    model = _Model(docs.sparkSession, path)
    added = {"ids": F.lit(None).cast("array<int>")} | ({"decoded": F.lit(None).cast("string")} if decode_too else {})
    names, docs = list(added), docs.drop(*added)
    at = docs.columns.index(text_col)

    def run(batches):
        encoder = _encoder(model)
        table = piece_table(encoder.p)
        for batch in batches:
            texts, lo, held = batch.column(at).to_pylist(), 0, 0
            for i, t in enumerate(texts + [None]):
                if i == len(texts) or (i > lo and held + len(t or "") > block_chars):
                    some = texts[lo:i]
                    ids = [None if x is None else y for x, y in zip(some, encoder.encode([x or "" for x in some]))]
                    new = [pa.array(ids, pa.list_(pa.int32()))]
                    if decode_too:
                        new.append(pa.array([None if y is None else decode(y, encoder.p, table).decode("utf-8", "surrogatepass") for y in ids], pa.string()))
                    part = batch.slice(lo, i - lo)
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])
                    lo, held = i, 0
                held += len(t or "")

    return docs.mapInArrow(tidy(run), docs.select("*", *(c.alias(n) for n, c in added.items())).schema)


def decode_ids(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with a column of the texts that its ids spell; null ids give null."""
    model = _Model(encoded.sparkSession, path)
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)

    def run(batches):
        pieces = model.value
        table = piece_table(pieces)
        for batch in batches:
            column = batch.column(at)
            flat, cut = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [decode(flat[a:b], pieces, table).decode("utf-8", "surrogatepass") if ok else None for a, b, ok in zip(cut, cut[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    schema = encoded.select("*", F.lit(None).cast("string").alias(out_col)).schema
    return encoded.mapInArrow(tidy(run), schema)
