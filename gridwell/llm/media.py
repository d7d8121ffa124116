"""Media columns: texts kept as 8-bit PCM WAV, their spectra and spectral-peak pair fingerprints.

A text's bytes are the samples. What is stored is read back by the wave module, and a short-time
Fourier transform of the samples gives the strongest peak of each frequency band in each frame.
Each kept peak is paired with the next few ones in time; a pair is coded as both bins and
the frames between them, however many, and stands beside the frame of its first peak.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, slices

#: Samples of a frame, samples from frame to frame, bands of a frame, peaks that each peak is paired with.
FRAME, HOP, BANDS, FAN_OUT = 256, 128, 4, 3
#: Frames that are transformed at once, so that a long text needs no more memory than a short one.
BLOCK = 4096
RATE = 8000

SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, pair_code array<long>, pair_time array<int>"


def padded(text: bytes, unit: int = 192) -> bytes:
    """text with bytes 32 appended up to a positive multiple of unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectrum(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Magnitudes of frames first to last, without the constant part; samples beyond the end are silence."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
    need = (last - first - 1) * HOP + FRAME
    if len(part) < need:
        part = np.concatenate([part, np.zeros(need - len(part), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)[:, 1:]).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks: the largest of its band, and not less than the same bin a frame before and after."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    width = FRAME // 2 // BANDS
    times, bins = [], []
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        low, high = max(0, first - 1), min(n, last + 1)
        power = spectrum(samples, low, high)
        best = power.reshape(len(power), BANDS, width).argmax(axis=2) + np.arange(BANDS) * width
        rows = np.arange(first - low, last - low)
        own = np.take_along_axis(power[rows], best[rows], 1)
        before = np.take_along_axis(power[np.maximum(rows - 1, 0)], best[rows], 1)
        after = np.take_along_axis(power[np.minimum(rows + 1, len(power) - 1)], best[rows], 1)
        t, b = np.nonzero((own >= before) & (own >= after) & (own > 0))
        times.append(t + first)
        bins.append(best[rows][t, b])
    return np.concatenate(times), np.concatenate(bins)


def pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and first frames of all pairs of a peak and one of the FAN_OUT after it, in order of time.

    A code has the first bin from bit 48 on, the second from bit 40 on, and the frames between them below.
    """
    codes, at = [], []
    for step in range(1, FAN_OUT + 1):
        codes.append(bins[:-step] << 48 | bins[step:] << 40 | times[step:] - times[:-step])
        at.append(times[:-step])
    code, time = np.concatenate(codes), np.concatenate(at)
    order = np.lexsort((code, time))
    return code[order].astype(np.int64), time[order].astype(np.int32)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows: list[tuple] = []
        for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            media = to_wav(padded(text))
            payload = from_wav(media)
            rows.append((key, len(text), payload, media, *pairs(*peaks(np.frombuffer(payload, np.uint8)))))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "payload", "media", "pair_code", "pair_time"])


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored): the stored WAV, the payload read back from it, and its fingerprint.

    A null or empty text is 192 spaces; a row with a null doc_id stays. Repeated rows stay, with equal values. A very
    long text is transformed in parts, with the same peaks. Rows are independent, so nothing is shuffled; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_columns, SCHEMA)


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    """Digests of the media columns of all documents."""
    return media_columns(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("pair_code").cast("string"), F.lower(F.hex(F.xxhash64("pair_code", "pair_time")))).alias("feature"),
        F.size("pair_code").cast("long").alias("n_pairs"),
    )
