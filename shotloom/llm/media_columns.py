"""Media columns: text bytes carried as 8-bit audio, with log-mel features and energy segments.

A payload is stored losslessly as 8-bit unsigned mono PCM in a WAV container; every feature is computed from the samples that are
read back. Features: a polyphase resampler (12 kHz to 8 kHz: 2 up, 3 down), overlapped Hann frames of 256 samples every 128,
a mel filterbank with log compression, and segments by hysteresis on frame energy (a segment opens above the high threshold and
closes below the low one). Spans are cut into fixed-shape tensors of TENSOR frames x MELS, the last one padded with the
floor, rounded to eighths, and stored with their time spans as an Arrow stream whose column has the fixed-shape tensor type; ``tensor_array`` gives a
Spark column of them that type.

Every computation depends on one text alone, in blocks whose shapes depend on its length alone, so equal texts have equal values.
Defined results: a null or empty text is 192 bytes of padding. Repeated rows give equal rows, an empty table an empty one; further
columns are ignored. Memory is bounded by blocks of BLOCKS x 192 samples besides the text's own bytes.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame

from shotloom.llm._words import map_texts, only

UNIT = 192
RATE, UP, DOWN = 12_000, 2, 3
FRAME, HOP, MELS = 256, 128, 20
TENSOR = 16
TAPS = 24
BLOCKS = 2048
FLOOR = 1e-6


def payload_of(text: bytes) -> bytes:
    """The text and bytes 32, up to a positive multiple of 192."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def encode_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def decode_wav(media: bytes) -> bytes:
    """The samples of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.cache
def _polyphase() -> np.ndarray:
    """The prototype low-pass as UP rows of phases: row p holds taps p, p + UP, ..."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = cut * np.sinc(cut * t) * np.hamming(n) * UP
    return h.reshape(TAPS, UP).T.astype(np.float32)


@functools.cache
def _block_matrix() -> np.ndarray:
    """Maps UNIT samples and their halo of TAPS on either side to UNIT * UP / DOWN output samples: each column is one phase's taps."""
    phases, width = _polyphase(), UNIT + 2 * TAPS
    out = np.zeros((width, UNIT * UP // DOWN), np.float32)
    for m in range(out.shape[1]):
        centre, phase = divmod(m * DOWN, UP)
        for k in range(TAPS):
            out[TAPS + centre + TAPS // 2 - k, m] += phases[phase, k]
    return out


@functools.cache
def _mel() -> np.ndarray:
    """Triangles over the FRAME // 2 + 1 bins, evenly spaced on the mel scale from 0 to half of the output rate."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """8-bit samples, a multiple of UNIT of them, to float32 at UP / DOWN of the rate."""
    x = np.zeros(len(samples) + 2 * TAPS, np.float32)
    x[TAPS:-TAPS] = (samples.astype(np.float32) - 128) / 128
    view = np.lib.stride_tricks.as_strided(x, (len(samples) // UNIT, UNIT + 2 * TAPS), (UNIT * 4, 4))
    return (view @ _block_matrix()).ravel()


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values (frames x MELS) and log energies of frames that overlap by half; the end is padded with zeros."""
    n = -(-len(signal) // HOP)
    x = np.zeros((n + 1) * HOP, np.float32)
    x[: len(signal)] = signal
    window = np.hanning(FRAME).astype(np.float32)
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, BLOCKS):
        end = min(n, at + BLOCKS)
        frames = np.lib.stride_tricks.as_strided(x[at * HOP :], (end - at, FRAME), (HOP * 4, 4)) * window
        spectrum = np.fft.rfft(frames, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[at:end] = np.log(power @ _mel() + FLOOR)
        energy[at:end] = np.log((frames * frames).sum(1) + FLOOR)
    return mels, energy


def segments(energy: np.ndarray, high: float = 0.25, low: float = -0.25) -> list[tuple[int, int]]:
    """Half-open frame spans: open where energy exceeds mean + high deviations, close where it falls below mean + low deviations."""
    mean, spread = energy.mean(), energy.std()
    state = np.where(energy > mean + high * spread, 1, np.where(energy < mean + low * spread, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[np.maximum(last, 0)], 0)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    samples = np.frombuffer(payload, np.uint8)
    parts = [resample_block(samples, at) for at in range(0, len(samples), BLOCKS * UNIT)]
    mels, energy = log_mel(np.concatenate(parts))
    return mels, segments(energy)


def resample_block(samples: np.ndarray, at: int) -> np.ndarray:
    """One block of the resampled signal, with the neighbouring samples as its halo."""
    end = min(len(samples), at + BLOCKS * UNIT)
    left, right = max(0, at - UNIT), min(len(samples), end + UNIT)
    out = resample(samples[left:right])
    per = UNIT * UP // DOWN
    skip = (at - left) // UNIT * per
    return out[skip : skip + (end - at) // UNIT * per]


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / UP / RATE


def tensors(mels: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The spans cut into pieces of TENSOR frames: an array (pieces, TENSOR, MELS) and each piece's time span in seconds."""
    pieces = [(a, min(a + TENSOR, e)) for s, e in spans for a in range(s, e, TENSOR)]
    out = np.full((len(pieces), TENSOR, MELS), np.log(FLOOR), np.float32)
    for k, (a, e) in enumerate(pieces):
        out[k, : e - a] = mels[a:e]
    return out, [(seconds(a), seconds(e)) for a, e in pieces]


def tensor_array(flat: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column of TENSOR * MELS floats a row as Arrow's fixed-shape tensor extension array."""
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat.flatten(), TENSOR * MELS))


def media_column(documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and the WAV bytes."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        return {"doc_id": part.column(0), "n_bytes": [len(t) for t in texts], "media": [encode_wav(payload_of(t)) for t in texts]}

    return map_texts(only(documents, id, text), work, "doc_id long, n_bytes long, media binary", text)


def media_tensors(media: DataFrame) -> DataFrame:
    """A row for each tensor of a media column: doc_id, piece, t_start, t_end, tensor (TENSOR * MELS floats, frame by frame)."""

    def work(part: pa.RecordBatch, stored: list[bytes]) -> dict:
        out: dict = {k: [] for k in ("doc_id", "piece", "t_start", "t_end")}
        values = []
        for key, wav in zip(part.column(0).to_pylist(), stored, strict=True):
            found, times = tensors(*features(decode_wav(wav)))
            values.append(found.reshape(len(found), TENSOR * MELS))
            for k, (a, e) in enumerate(times):
                for name, x in zip(out, (key, k, a, e), strict=True):
                    out[name].append(x)
        flat = np.concatenate(values) if values else np.zeros((0, TENSOR * MELS), np.float32)
        return out | {"tensor": pa.ListArray.from_arrays(np.arange(0, flat.size + 1, TENSOR * MELS, dtype=np.int32), flat.ravel())}

    return map_texts(only(media, "doc_id", "media"), work, "doc_id long, piece int, t_start double, t_end double, tensor array<float>", "media", 1 << 18)


#: The stored form of a text's tensors.
STORED = pa.schema([("t_start", pa.float64()), ("t_end", pa.float64()), ("tensor", pa.fixed_shape_tensor(pa.float32(), (TENSOR, MELS)))])


def store_tensors(found: np.ndarray, times: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of one batch: a fixed-shape tensor and its time span in each row."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), TENSOR * MELS)
    arrays = [pa.array([a for a, _ in times], pa.float64()), pa.array([e for _, e in times], pa.float64()), pa.ExtensionArray.from_storage(STORED.field("tensor").type, flat)]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, STORED) as writer:
        writer.write_batch(pa.record_batch(arrays, schema=STORED))
    return out.getvalue().to_pybytes()


def load_tensors(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensors (pieces, TENSOR, MELS) and their time spans."""
    table = pa.ipc.open_stream(stored).read_all()
    column = table.column("tensor").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy_ndarray() if len(column) else np.zeros((0, TENSOR, MELS), np.float32), list(zip(table.column("t_start").to_pylist(), table.column("t_end").to_pylist(), strict=True))


def describe(payload: bytes) -> tuple[str, bytes]:
    """frames;segments;tensors;mean log-mel of each band;crc32 of the tensors and spans, both rounded. And the stored tensors."""
    mels, spans = features(payload)
    found, times = tensors(mels, spans)
    steps = np.round(found * 8)  # the last bits of a sum may differ between machines
    crc = zlib.crc32(steps.astype(np.int16).tobytes(), zlib.crc32(repr(times).encode()))
    return f"{len(mels)};{len(spans)};{len(found)};{','.join(f'{x:.2f}' for x in mels.mean(0, dtype=np.float64))};{crc}", store_tensors(steps / 8, times)


def summary(documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Store each text as media, read it back, and give the digests, features and tensors (see ``load_tensors``) of what was read."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors")}
        for t in texts:
            media = encode_wav(payload_of(t))
            back = decode_wav(media)
            row = (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), *describe(back))
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
        return {"doc_id": part.column(0)} | out

    return map_texts(only(documents, id, text), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors binary", text)
