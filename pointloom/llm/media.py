"""Media columns: WAV bytes, their spectra and peak-pair fingerprints.

The payload is stored as 8-bit mono samples by the ``wave`` module and read
back; features are computed from what was read: a short-time Fourier transform
(Hann windows of 256 samples, half overlapping), the strongest bin in each of
four bands of a frame, and pairs of peaks of neighbouring frames coded as
(band bin, later bin, frames between) with the time of the first.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import textnum as tn

RATE = 8000
FRAME, HOP = 256, 128
BLOCK = 64
#: First bin of each band, and the end of the last.
BANDS = (1, 9, 25, 57, 129)
#: A peak counts if its magnitude is this many times the frame's mean.
STRONG = 2.0
#: Frames per transform call; bounds memory for long payloads.
FRAMES = 4096
AHEAD = 2
_hann = np.hanning(FRAME)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples expected")
        return w.readframes(w.getnframes())


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """Zero bytes up to a positive multiple of the block."""
    return data + bytes(-len(data) % block if data else block)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each peak, by frame and band."""
    n = max(1, -(-(len(samples) - (FRAME - HOP)) // HOP))
    signal = np.zeros((n - 1) * HOP + FRAME)
    signal[: len(samples)] = samples.astype(np.float64) - 128.0
    times, bins = [], []
    for at in range(0, n, FRAMES):
        to = min(n, at + FRAMES)
        part = np.lib.stride_tricks.sliding_window_view(signal[at * HOP : (to - 1) * HOP + FRAME], FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * _hann, axis=1))
        mean = power[:, 1:].mean(axis=1)
        found = np.stack([power[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        strong = np.take_along_axis(power, found, 1) >= STRONG * mean[:, None]
        frame, band = np.nonzero(strong)
        times.append(frame + at)
        bins.append(found[frame, band])
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time of the first peak, code) of all pairs up to ``AHEAD`` peaks apart within 15 frames."""
    time, at = peaks(samples)
    first, codes = [], []
    for step in range(1, AHEAD + 1):
        gap = time[step:] - time[:-step]
        near = gap < 16
        first.append(time[:-step][near])
        codes.append((at[:-step][near] << 12) | (at[step:][near] << 4) | gap[near])
    when, code = np.concatenate(first), np.concatenate(codes)
    order = np.lexsort((code, when))
    return when[order].astype(np.int32), code[order].astype(np.int32)


def _feature(when: np.ndarray, code: np.ndarray) -> str:
    digest = hashlib.sha256(when.tobytes() + code.tobytes()).hexdigest()[:32]
    return f"{len(code)}:{digest}"


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
ARRAYS = "media binary, fp_time array<int>, fp_code array<int>"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", arrays: bool = False) -> DataFrame:
    """Store each text as WAV and describe it; null text is empty.

    With ``arrays`` the WAV bytes and the time-coded fingerprints come too.
    Equal texts have equal values in every column; repeated rows and null keys
    each have their row.  Other columns are not looked at, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tn.sliced(batches, "text", 2 << 20):
            data, offsets = tn.packed(batch.column("text"))
            raw = data.tobytes()
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media = to_wav(padded(raw[a:b]))
                back = from_wav(media)
                when, code = fingerprints(np.frombuffer(back, np.uint8))
                row = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), _feature(when, code))
                rows.append((*row, media, when, code) if arrays else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            names = [x.split()[0] for x in (f"{MEDIA}, {ARRAYS}" if arrays else MEDIA).split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", *names])

    schema = f"key {kind}, {MEDIA}" + (f", {ARRAYS}" if arrays else "")
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as WAV, with digests of what was read back, the stored form and the time-coded arrays."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), arrays=True)
