"""Media columns: texts stored as 8-bit WAV, and fingerprints of pairs of spectral peaks.

The payload becomes the samples of a mono WAV file through the wave module and is read back through it. A
short-time Fourier transform over Hann windows gives frames; each frame's strongest local maxima are its peaks;
each peak is paired with peaks of the next frames, and a pair is an integer of both frequencies and the gap, kept
with its frame's number.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from ..sources.shipping import with_code
from .common import slices

UNIT = 576
PAD = b"\xff"
RATE = 8000
WINDOW = 256
HOP = 192
#: Silence that the transform sees before and behind the samples, since a window's ends weigh nothing.
EDGE = 64
#: Peaks of a frame, and frames ahead in which a peak finds partners (the strongest peak of each).
PEAKS = 2
AHEAD = 3
#: Frames transformed at a time.
BLOCK = 4096

_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the UTF-8 bytes padded with 255 to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + PAD * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected 8-bit mono")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, PEAKS): bins of each frame's strongest local maxima, strongest first, and whether there is one.

    Strengths are rounded to eighths of a decibel step before they are compared; ties go to the lower bin. The
    first frame begins EDGE samples before the first one and the last frame ends as many or more behind the last
    one; there the transform sees silence (128), which is in no payload. So every sample weighs in some frame.
    """
    x = np.frombuffer(samples, np.uint8)
    n = 1 + -(-max(0, len(x) + 2 * EDGE - WINDOW) // HOP)
    x = np.pad(x, (EDGE, WINDOW + (n - 1) * HOP - EDGE - len(x)), constant_values=128)
    bins, found = np.zeros((n, PEAKS), np.int32), np.zeros((n, PEAKS), bool)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    for at in range(0, n, BLOCK):
        part = (frames[at : at + BLOCK].astype(np.float32) - 128) * _HANN
        s = np.fft.rfft(part, axis=1)
        power = s.real**2 + s.imag**2
        level = np.rint(np.log2(power + 1) * 8).astype(np.int32)
        inner = level[:, 1:-1]
        local = (inner > level[:, :-2]) & (inner >= level[:, 2:])
        # level above, lower bins first: one number to compare
        key = np.where(local, inner * 256 - np.arange(1, inner.shape[1] + 1, dtype=np.int32), np.iinfo(np.int32).min)
        for k in range(PEAKS):
            best = key.argmax(1)
            rows = np.arange(len(key))
            bins[at : at + BLOCK, k] = best + 1
            found[at : at + BLOCK, k] = key[rows, best] > np.iinfo(np.int32).min
            key[rows, best] = np.iinfo(np.int32).min
    return bins, found


def landmarks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, hash) of each pair of peaks, in order of frame, gap and strength."""
    bins, found = peaks(samples)
    n = len(bins)
    times, hashes = [], []
    for gap in range(1, min(AHEAD, n - 1) + 1):
        for k in range(PEAKS):
            ok = np.flatnonzero(found[:-gap, k] & found[gap:, 0])
            times.append(ok * (AHEAD * PEAKS) + (gap - 1) * PEAKS + k)
            hashes.append(bins[ok, k] << 16 | bins[ok + gap, 0] << 4 | gap)
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    code, value = np.concatenate(times), np.concatenate(hashes)
    order = code.argsort()
    return (code[order] // (AHEAD * PEAKS)).astype(np.int32), value[order].astype(np.int32)


def media_columns(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", bodies: bool = True) -> DataFrame:
    """The ``keep`` columns with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    n_landmarks and feature (a digest of the landmarks), and with ``bodies`` also wav (binary), frames and hashes
    (arrays of equal length).

    payload_sha256 and tail_crc32 are of the bytes read back. A null or empty text is one unit of padding. Equal
    texts give equal values; repeated rows give repeated rows. A row's text is worked on whole, its transform in
    blocks; memory is bounded by a few rows.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_landmarks", "feature"]
    more = ["wav", "frames", "hashes"] * bodies
    if clash := {*names, *more} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} clash with the result's")
    fields = [docs.schema[c] for c in keep]

    def row(value: str | None) -> tuple:
        n, payload = payload_of(value)
        stored = to_wav(payload)
        back = from_wav(stored)
        frames, hashes = landmarks(back)
        feature = hashlib.sha256(frames.tobytes() + hashes.tobytes()).hexdigest()
        digest = n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), len(frames), feature
        return digest + (stored, frames, hashes) * bodies

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())] * bodies]
        for batch in slices(batches):  # stored forms are as large as the texts
            rows = [row(x.as_py()) for x in batch.column(len(keep))]
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names, *more])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_landmarks long, feature string", *["wav binary, frames array<int>, hashes array<int>"] * bodies])
    return with_code(docs).select(*keep, text).mapInArrow(run, kinds)
