"""Documents dealt to groups by a hash of their content and place, as compressed blobs: a bounded piece of text for one task.

Operators that must look up something for every word or window group documents, ask once per group for the distinct
keys (dealt to parts by key), and get the answers back per group. A key that every document holds is so asked
for once a group, whatever its frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODEC = "zstd"


def to_blob(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=CODEC)) as w:
        w.write(batch)
    return sink.getvalue().to_pybytes()


def from_blobs(blobs) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in blobs)


def squeeze(x: np.ndarray) -> bytes:
    data = x.tobytes()
    return len(data).to_bytes(4, "little") + pa.Codec(CODEC).compress(data, asbytes=True)


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec(CODEC).decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True), kind)


def deal(docs: DataFrame, groups: int, most_bytes: int = 24 << 20) -> DataFrame:
    """(g, blob) for docs: rows of a task that go to the same group are packed together, at most about most_bytes at a
    time. The group follows from all columns and the task, so neither ids that repeat or are null nor copies of a
    row gather in one; a task that runs again makes the same groups."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy()
            order = np.argsort(g, kind="stable")
            cut = np.flatnonzero(np.diff(g[order], prepend=-1))
            rows = table.select(names)
            for a, b in zip(cut, [*cut[1:], len(g)]):
                yield int(g[order[a]]), to_blob(rows.take(order[a:b]))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                held.append(piece)
                size += sum(c.nbytes for c in piece.columns)
                if size > most_bytes:
                    g, blobs = zip(*flush())
                    held, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(blobs, pa.binary())], ["g", "blob"])
        if held:
            g, blobs = zip(*flush())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(blobs, pa.binary())], ["g", "blob"])

    dealt = docs.withColumn("g", F.pmod(F.xxhash64(*names, F.spark_partition_id()), F.lit(groups)).cast("int"))
    return dealt.mapInArrow(run, "g int, blob binary")


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of distinct ascending keys: each part that has some, and where they are, ascending."""
    part = (keys % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(part)]):
        yield int(part[order[a]]), order[a:b]


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: [] for n in names})
