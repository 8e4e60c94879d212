"""Media columns: WAV files in a binary column, short-time Fourier transforms, spectral-peak pair fingerprints.

The query takes any text as a signal: its bytes are 8-bit samples, so the file holds them without loss.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, schema, ship, table

#: Payloads are padded with bytes 0 up to a positive multiple of this.
BLOCK = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Frequency bins of each band that gives at most one peak a frame; bin 0 is left out.
BANDS = ((1, 17), (17, 33), (33, 65), (65, 129))
#: A peak is the largest of its band this many frames around; a pair's second peak is one of the next FAN peaks, at most REACH frames later.
AROUND, FAN, REACH = 2, 3, 63
#: Frames transformed at once, so that memory does not follow the length of a file.
FRAMES = 4096


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_bands(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame of a short-time Fourier transform and each band, the strongest bin and its magnitude."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    signal = np.zeros((n - 1) * HOP + FRAME, np.float32)
    signal[: len(samples)] = samples.astype(np.float32) - 128
    frames, window = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32)
    bins, power = np.empty((n, len(BANDS)), np.int64), np.empty((n, len(BANDS)), np.float64)
    for at in range(0, n, FRAMES):
        m = np.abs(np.fft.rfft(frames[at : at + FRAMES] * window, axis=1))
        for k, (low, high) in enumerate(BANDS):
            bins[at : at + FRAMES, k] = (b := m[:, low:high].argmax(axis=1)) + low
            power[at : at + FRAMES, k] = m[np.arange(len(m)), b + low]
    return bins, power


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Peak pairs in the order of time, each as one long: frame << 24 | first bin << 16 | second bin << 8 | frames between."""
    bins, power = spectral_bands(samples)
    n = len(bins)
    top = power.copy()
    for d in range(1, min(AROUND, n - 1) + 1):
        top[d:] = np.maximum(top[d:], power[:-d])
        top[:-d] = np.maximum(top[:-d], power[d:])
    frame, band = np.nonzero((power >= top) & (power > 1e-3))
    f = bins[frame, band]
    codes = []
    for k in range(1, min(FAN, len(frame) - 1) + 1):
        apart = frame[k:] - frame[:-k]
        ok = apart <= REACH
        codes.append(((frame[:-k] << 24) | (f[:-k] << 16) | (f[k:] << 8) | apart)[ok])
    return np.sort(np.concatenate(codes)) if codes else np.empty(0, np.int64)


def _store(batches):
    for batch in parts(batches):
        n, media = [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            n.append(len(raw))
            media.append(to_wav(raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches):
    for batch in parts(batches):
        payloads = [from_wav(m) for m in batch.column(2).to_pylist()]
        marks = [fingerprint(np.frombuffer(p, np.uint8)) for p in payloads]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "media", "payload", "fingerprint"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: a WAV file of every row's text. Null and empty texts: one block of bytes 0. Other columns are ignored."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, schema("doc_id long, n_bytes long, media binary"))


def read_media(stored: DataFrame) -> DataFrame:
    """Adds payload (the samples as read back) and fingerprint (time-coded peak pairs) to doc_id, n_bytes, media.

    Silence has no peaks and an empty fingerprint; equal files have equal fingerprints. No rows: no rows.
    """
    ship(stored.sparkSession)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, schema("doc_id long, n_bytes long, media binary, payload binary, fingerprint array<long>"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: the number of peak pairs and a hash of them; fingerprint: the time-coded pairs themselves."""
    media = read_media(store_media(table(spark, sf_dir, "documents")))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.lower(F.hex(F.xxhash64("fingerprint")))).alias("feature"), "fingerprint",
    )
