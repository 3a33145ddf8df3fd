"""Exact substring deduplication over words, from fixed-block anchors.

A repeated window of SPAN words holds exactly one whole block of each of its two texts (blocks are the BLOCK words at
multiples of BLOCK, and SPAN = 2 * BLOCK - 1), and that block occurs in the other text at some offset. So blocks are the
index, every rolling window of BLOCK words of every text probes it, and only windows around a block that some
other probe hits can repeat. Blocks are probed by 64-bit hashes, which may hit too often but never too seldom. Windows around
hits are extended to SPAN words and compared by 128-bit BLAKE2b digests of the words themselves; adjacent repeats join
into maximal ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, give_back, pack_sorted, partitions, rolling, tidy, unpack_sorted, word_hashes
from .groups import by_part, deal, frame, from_blobs, to_blob

SPAN = 35
#: Groups of texts for each shuffle partition.
GROUPS = 2
_U64 = np.uint64


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of (key, rest), ascending; which of them occur twice; and where each row is among them."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return keys[first], np.diff(np.append(first, len(keys))) > 1, where


def _single(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys, np.zeros_like(keys)], 1)


def _requests(g: int, keys: np.ndarray, index: np.ndarray, parts: int, shift: int) -> list[tuple]:
    """Rows (part, g, keys, rest, flags): distinct keys of a group, dealt by their first halves, of which the low bits
    stay behind, and which of them are in its index and which occur twice."""
    distinct, twice, where = _distinct(keys)
    indexed = np.zeros(len(distinct), bool)
    indexed[where[index]] = True
    return [(part, g, pack_sorted(distinct[at, 0] >> _U64(shift)), distinct[at, 1].tobytes() if distinct[at, 1].any() else b"", np.packbits(indexed[at]).tobytes() + np.packbits(twice[at]).tobytes()) for part, at in by_part(distinct[:, 0], parts)]


_REQUEST = "part int, g int, keys binary, rest binary, flags binary"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one part: which indexed keys of each group occur elsewhere, one bit for each in order."""
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    size = np.array([len(k) for k in keys])
    rest = [np.frombuffer(r, "<u8") if r else np.zeros(n, np.uint64) for r, n in zip(pdf["rest"], size)]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8)).reshape(2, -1)[:, :n].astype(bool) for f, n in zip(pdf["flags"], size)]
    indexed, twice = np.concatenate(flags, axis=1)
    distinct, again, where = _distinct(np.stack([np.concatenate(keys), np.concatenate(rest)], 1))
    again = again | (np.bincount(where, twice, len(distinct)) > 0)
    hit, ends, rows = again[where], np.cumsum(size), []
    for g, part, a, b in zip(pdf["g"], pdf["part"], ends - size, ends):
        if indexed[a:b].any():
            rows.append((g, part, np.packbits(hit[a:b][indexed[a:b]]).tobytes()))
    give_back()
    return frame(rows, ["g", "part", "bits"])


def _answered(keys: np.ndarray, answers: pd.DataFrame, parts: int) -> np.ndarray:
    """For keys of a group's index: whether they occur elsewhere."""
    indexed, _, where = _distinct(keys)
    hit = np.zeros(len(indexed), bool)
    bits = dict(zip(answers["part"], answers["bits"]))
    for part, at in by_part(indexed[:, 0], parts):
        hit[at] = np.unpackbits(np.frombuffer(bits[part], np.uint8), count=len(at)).astype(bool)
    return hit[where]


def _digests(text: bytes, at: np.ndarray, span: int) -> np.ndarray:
    """BLAKE2b digests of the windows of span words that start at words `at`, as pairs of 64-bit numbers."""
    words = text.split()
    joined = memoryview(b" ".join(words))
    place = np.append(0, np.cumsum([len(w) + 1 for w in words])).tolist()
    data = b"".join(hashlib.blake2b(joined[place[i] : place[i + span] - 1], digest_size=16).digest() for i in at.tolist())
    return np.frombuffer(data, "<u8").reshape(-1, 2)


def _kept(data: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> str:
    kept = np.flatnonzero(~gone)
    return hashlib.sha256(b" ".join([data[a:b] for a, b in zip(start[kept].tolist(), end[kept].tolist())])).hexdigest()


def drop_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed): every word that a repeated window of `span` words covers is
    removed; removed lists the maximal runs [first word, words] of those.

    All windows are judged on the input. Nothing is kept of one occurrence: all go. Null text has no words; a text
    under `span` words loses none; rows that repeat, or share an id, or have a null one, are texts like any other and
    repeat each other; an empty table gives an empty result; other columns, whatever their names, are ignored."""
    block = (span + 1) // 2
    parts = partitions(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    dealt = deal(rows, GROUPS * parts)
    names = ["g", "blob", "doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
    result = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>"

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, index = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for text in from_blobs(pdf["blob"]).column("text"):
            words = word_hashes(text.as_py(), lower=False)[0]
            if len(words) >= span:
                keys.append(rolling(words, block))
                index.append(np.arange(len(keys[-1])) % block == 0)
        return frame(_requests(int(pdf["g"].iloc[0]), _single(np.concatenate(keys)), np.concatenate(index), parts, 24), ["part", "g", "keys", "rest", "flags"])

    def settle(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Texts none of whose blocks is hit are done; the others go on with their hits."""
        if not len(pdf):
            return frame([], names)
        table = from_blobs(pdf["blob"])
        found, keys, done, hits = [], [np.empty(0, np.uint64)], [], []
        for text in table.column("text"):
            words, start, _ = word_hashes(text.as_py(), lower=False)
            own = rolling(words, block)[::block] if len(words) >= span else words[:0]
            found.append((len(start), len(own)))
            keys.append(own)
        keys = np.concatenate(keys)
        hit = _answered(_single(keys), answers, parts) if len(keys) else np.zeros(0, bool)
        at = 0
        for i, text, (n, own) in zip(table.column("id").to_pylist(), table.column("text"), found):
            mine, at = hit[at : at + own], at + own
            hits.append(np.packbits(mine).tobytes() if mine.any() else None)
            if not mine.any():
                done.append((None, None, i, n, 0, hashlib.sha256(b" ".join(text.as_py().split())).hexdigest(), []))
        going = table.append_column("hits", pa.array(hits, pa.binary())).filter(pa.array([h is not None for h in hits], pa.bool_()))
        if going.num_rows:
            done.append((int(key[0]), to_blob(going.combine_chunks()), None, None, None, None, None))
        return frame(done, names).astype({"g": "Int32", "n_words": "Int64", "n_removed": "Int64"})

    def candidates(table: pa.Table):
        """For each text the digests of its windows of span words around a hit block, and where they start."""
        for text, bits in zip(table.column("text").to_pylist(), table.column("hits").to_pylist()):
            at = np.arange(max(0, len(text.split()) - span + 1))
            hit = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
            at = at[hit[-(-at // block)]]
            yield text, _digests(text, at, span), at

    def extend(batches):
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = np.concatenate([np.empty((0, 2), np.uint64), *(k for _, k, _ in candidates(from_blobs([blob.as_py()])))])
                if len(keys):
                    out = list(zip(*_requests(g, keys, np.ones(len(keys), bool), parts, 8)))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.binary()) for x in out[2:])], ["part", "g", "keys", "rest", "flags"])

    def finish(key, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return frame([], names[2:])
        table = from_blobs(pdf["blob"])
        found = list(candidates(table))
        keys = np.concatenate([np.empty((0, 2), np.uint64), *(k for _, k, _ in found)])
        again = _answered(keys, answers, parts) if len(keys) else np.zeros(0, bool)
        out, done = [], 0
        for i, (text, mine, at) in zip(table.column("id").to_pylist(), found):
            _, start, end = word_hashes(text, lower=False)
            cover = np.zeros(len(start) + 1, np.int64)
            windows = at[again[done : done + len(mine)]]
            done += len(mine)
            np.add.at(cover, windows, 1)
            np.add.at(cover, windows + span, -1)
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            out.append((i, len(start), int(gone.sum()), _kept(text, start, end, gone), [[int(a), int(b - a)] for a, b in edge]))
        return frame(out, names[2:])

    asked = dealt.groupBy("g").applyInPandas(ask, _REQUEST)
    answers = asked.groupBy("part").applyInPandas(_answer, "g int, part int, bits binary")
    settled = Stored(docs.sparkSession).put(dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(settle, f"g int, blob binary, {result}"), "anchored")
    going = settled.filter("g is not null").select("g", "blob")
    exact = going.mapInArrow(tidy(extend), _REQUEST).groupBy("part").applyInPandas(_answer, "g int, part int, bits binary")
    rest = going.groupBy("g").cogroup(exact.groupBy("g")).applyInPandas(finish, result)
    return settled.filter("g is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "removed").unionByName(rest)
