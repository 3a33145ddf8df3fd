"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoded only where edits touch it."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT = 32  # pre-tokens in a leaf
CONTEXT = 3  # characters before an edit that its pre-tokens can depend on: the longest contraction
_CACHED = 300_000


class Counter:
    """Token counts of pre-tokens by a public byte-level vocabulary, with a bounded memory of those already met."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.split = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        out = list(map(self.seen.get, pieces))
        if None in out:
            if len(self.seen) > _CACHED:
                self.seen.clear()
            for i, n in enumerate(out):
                if n is None:
                    out[i] = n = len(self.encode(pieces[i]))
                    if len(pieces[i]) <= 64:
                        self.seen[pieces[i]] = n
        return out


class Tree:
    """Sums of characters and tokens over segments of pre-tokens: node 1 is the root, leaves start at `width`."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.leaves = len(chars)
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        self.nodes = np.zeros((2 * self.width, 2), np.int64)
        self.nodes[self.width : self.width + len(chars)] = np.stack([chars, tokens], axis=1)
        at = self.width
        while at > 1:
            self.nodes[at // 2 : at] = self.nodes[at : 2 * at].reshape(-1, 2, 2).sum(axis=1)
            at //= 2

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.nodes[2 * node, 0])
            node, start = (2 * node, start) if char < start + left else (2 * node + 1, start + left)
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.nodes[node]
        while node:
            self.nodes[node] += change
            node //= 2

    def to_bytes(self) -> bytes:
        return self.nodes[self.width : self.width + self.leaves].astype("<i4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        leaves = np.frombuffer(data, "<i4").reshape(-1, 2)
        return cls(leaves[:, 0], leaves[:, 1])


def build(text: str, counter: Counter) -> Tree:
    pieces = counter.split.findall(text)
    if not pieces:
        return Tree(np.zeros(1, np.int64), np.zeros(1, np.int64))
    at = np.arange(0, len(pieces), SEGMENT)
    return Tree(np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at), np.add.reduceat(np.array(counter.counts(pieces)), at))


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, int]:
    """Update the tree for edits (start, length, replacement), disjoint and ascending in the old text. Returns the new
    text and how many of its characters were encoded again.

    From the segment with the last CONTEXT characters before an edit, pre-tokens are split anew until one ends where
    an old segment ended, past the edit; what follows there is split as before. If the next edit starts within
    CONTEXT of that point, the same run goes on. The first segment of a run takes its sums, its others get none.
    """
    parts, at, starts, shift = [], 0, [], 0
    for start, length, new in edits:
        parts += [text[at:start], new]
        at = start + length
        starts.append((start, at, shift, shift + len(new) - length))
        shift += len(new) - length
    text = "".join([*parts, text[at:]])
    ends = np.cumsum(tree.nodes[tree.width : tree.width + tree.leaves, 0])  # of the old segments, in the old text
    runs, i = [], 0
    while i < len(starts):
        start, stop, before, after = starts[i]
        leaf = int(np.searchsorted(ends, max(0, start - CONTEXT), side="right"))
        leaf = min(leaf, tree.leaves - 1)
        begin = (int(ends[leaf - 1]) if leaf else 0) + before
        pieces, end, last = [], begin, leaf
        for m in counter.split.finditer(text, begin):
            pieces.append(m.group())
            end = m.end()
            while i + 1 < len(starts) and end - after > starts[i + 1][0] - CONTEXT:
                i += 1
                start, stop, before, after = starts[i]
            old = end - after
            if old >= stop:
                j = int(np.searchsorted(ends, old))
                if j < tree.leaves and ends[j] == old and (i + 1 == len(starts) or old <= starts[i + 1][0] - CONTEXT):
                    last = j
                    break
        else:
            last, i = tree.leaves - 1, len(starts) - 1
        runs.append((leaf, last, end - begin, sum(counter.counts(pieces))))
        i += 1
    for leaf, last, chars, tokens in runs:
        tree.put(leaf, chars, tokens)
        for j in range(leaf + 1, last + 1):
            tree.put(j, 0, 0)
    return text, sum(r[2] for r in runs)


_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("text", pa.string())]))
# E-mail and IPv4 addresses, and runs of 9 digits or more.
_PERSONAL = regex.compile(r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<address>\b\d{1,3}(?:\.\d{1,3}){3}\b)|(?P<number>\b\d{9,}\b)")


def personal_data_edits(docs: DataFrame) -> DataFrame:
    """(id, text, edits) for (id, text): replace personal data by its kind in angle brackets. Null and empty texts have
    no edits; ids may be null or repeat."""

    def run(batches):
        for batch in batches:
            found = [[{"start": m.start(), "length": m.end() - m.start(), "text": f"<{m.lastgroup}>"} for m in _PERSONAL.finditer(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _EDITS)], ["id", "text", "edits"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text string, edits array<struct<start:int,length:int,text:string>>")


def _per_worker(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


_COUNTERS: dict[str, Counter] = {}


def build_trees(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, tree) for (id, text): the state to keep; a tree is 8 bytes per SEGMENT pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]):
        counter = _per_worker(path)
        for batch in batches:
            trees = [build(t or "", counter) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.to_bytes() for t in trees], pa.binary())], ["id", "n_tokens", "tree"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, tree binary")


def update_trees(state: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, tree, n_edits, n_encoded, text) for (id, text, tree, edits): text after the edits and its counts.
    n_encoded is the number of characters encoded again."""

    def run(batches):
        counter = _per_worker(path)
        for batch in batches:
            rows = []
            for text, data, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tree, edits = Tree.from_bytes(data), sorted((e["start"], e["length"], e["text"] or "") for e in edits or [])
                text, again = apply_edits(text or "", tree, edits, counter) if edits else (text, 0)
                rows.append((tree.tokens, tree.to_bytes(), len(edits), again, text))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", "n_tokens", "tree", "n_edits", "n_encoded", "text"])

    columns = state.select("id", "text", "tree", "edits")
    return columns.mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, n_tokens long, tree binary, n_edits long, n_encoded long, text string")


def count_edited(edited: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_encoded) for (id, text, edits), in one pass: builds each document's
    tree, applies its edits to it and returns the root before and after.

    Null text has no tokens (its edits apply to empty text), null edits are none, edits must be disjoint; repeated
    rows are counted one by one; an empty table gives an empty result; other columns are ignored. A document is
    handled alone, so memory is bounded by the longest text."""

    def run(batches):
        counter = _per_worker(path)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tree = build(text or "", counter)
                before, again = tree.tokens, 0
                edits = sorted((e["start"], e["length"], e["text"] or "") for e in edits or [])
                if edits:
                    _, again = apply_edits(text or "", tree, edits, counter)
                rows.append((before, len(edits), tree.tokens, again))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    columns = edited.select("id", "text", "edits")
    return columns.mapInArrow(run, f"id {edited.schema['id'].dataType.simpleString()}, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")
