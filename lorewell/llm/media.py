"""Media columns: bytes kept as WAV sound and described by spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576  # bytes, of which a payload is a multiple
FRAME, HOP, PEAKS, AHEAD = 192, 96, 2, 2
RATE = 8000
#: Frames that are transformed at a time, however long the sound is.
FRAMES = 2048


def payload(data: bytes, multiple: int = UNIT) -> bytes:
    """data with bytes 255 appended up to a positive multiple."""
    return data + b"\xff" * (max(1, -(-len(data) // multiple)) * multiple - len(data))


def to_wav(samples: bytes) -> bytes:
    """A mono WAV file with one unsigned 8-bit sample a byte."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(samples)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def _peaks(x: np.ndarray) -> np.ndarray:
    """Of each frame of some samples, the frequencies of its strongest local maxima, -1 where there are fewer."""
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32) - 128, FRAME)[::HOP] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)
    # Rounded, so that equal peaks order by frequency whatever the machine's last bit is.
    power = np.round(power, 2)
    inner = power[:, 1:-1]
    top = np.where((inner >= power[:, :-2]) & (inner > power[:, 2:]), inner, -1)
    found, frame = [], np.arange(len(top))
    for _ in range(PEAKS):
        best = top.argmax(axis=1)  # the first, so the lowest frequency, among equal ones
        found.append(np.where(top[frame, best] > 0, best + 1, -1))
        top[frame, best] = -1
    return np.stack(found, axis=1).astype(np.int64)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded pairs of spectral peaks, ascending: time << 32 | f1 << 22 | f2 << 12 | dt. A short-time Fourier
    transform (Hann windows of FRAME samples, every HOP) gives each frame's PEAKS strongest local maxima; each
    is paired with those of the next AHEAD frames."""
    x, count = np.frombuffer(samples, np.uint8), (len(samples) - FRAME) // HOP + 1
    freq = np.concatenate([_peaks(x[a * HOP : (min(count, a + FRAMES) - 1) * HOP + FRAME]) for a in range(0, count, FRAMES)])
    out = []
    for dt in range(1, AHEAD + 1):
        if len(freq) > dt:
            a, b = freq[:-dt, :, None], freq[dt:, None, :]
            t = np.arange(len(freq) - dt, dtype=np.int64)[:, None, None]
            code = (t << 32) | (a << 22) | (b << 12) | dt
            out.append(code[(a > 0) & (b > 0)])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"


def wav_columns(docs: DataFrame, keep_media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprint[, media]).

    Every whole text's UTF-8 bytes, padded, are written as WAV, and everything about the payload is computed from
    the samples read back from it. Null counts as empty text (one unit of padding). Equal texts have equal values,
    repeated rows are kept, no rows give no rows, other columns are ignored. One narrow pass, a row at a time:
    memory is bounded by the longest text."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1):
                data = data.as_py()
                media = to_wav(payload(data))
                back = from_wav(media)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(back), media if keep_media else None))
            cols = list(zip(*rows)) or [[]] * 8
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols[: 8 if keep_media else 7], types))]
            names = ["doc_id", *(x.split()[0] for x in _SCHEMA.split(", ")), "media"]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}" + ", media binary" * keep_media)


def write_wav(docs: DataFrame, path: str, **columns) -> DataFrame:
    """Store the media column of wav_columns as Parquet and return it read back."""
    out = wav_columns(docs, keep_media=True, **columns)
    out.write.parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
