import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from shotloom.llm import media_columns as M


def test_wav_round_trip_by_another_reader():
    for text in (b"", b"abc", b"x" * 192, bytes(range(256)) * 3):
        payload = M.payload_of(text)
        stored = M.encode_wav(payload)
        with wave.open(io.BytesIO(stored)) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())) == (1, 1, payload)
        assert M.decode_wav(stored) == payload and len(payload) % 192 == 0 and payload[: len(text)] == text and len(payload) >= 192


def test_resampler_keeps_tones_and_blocks_agree():
    t = np.arange(192 * 40) / M.RATE
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 440 * t)).astype(np.uint8)
    out = M.resample(tone)
    assert len(out) == len(tone) * 2 // 3
    peak = np.abs(np.fft.rfft(out)).argmax() * 8000 / len(out)
    assert abs(peak - 440) < 3
    whole, M_blocks = M.resample(tone), M.BLOCKS
    try:
        M.BLOCKS = 7
        parts = np.concatenate([M.resample_block(tone, at) for at in range(0, len(tone), 7 * 192)])
    finally:
        M.BLOCKS = M_blocks
    assert np.allclose(whole, parts, atol=1e-5)


def test_hysteresis_opens_high_and_closes_low():
    energy = np.array([0, 0, 5, 2.6, 2.6, 0, 2.6, 0, 6, 6], float)
    assert M.segments(energy, 0.5, -0.5) == [(2, 5), (8, 10)]
    assert M.segments(np.zeros(4)) == []


def test_tensors_have_a_fixed_shape():
    mels, spans = np.arange(40 * M.MELS, dtype=np.float32).reshape(40, -1), [(0, 20), (30, 33)]
    found, times = M.tensors(mels, spans)
    assert found.shape == (3, M.TENSOR, M.MELS) and times[2] == (M.seconds(30), M.seconds(33)) and found[1, 4:].max() < -13
    column = M.tensor_array(pa.array(found.reshape(3, -1).tolist(), pa.list_(pa.float32())))
    assert column.type.shape == [M.TENSOR, M.MELS] and np.array_equal(column.to_numpy_ndarray(), found)


def test_query_form(spark):
    texts = [None, "", "short", "long " * 30000, "é" * 100]
    rows = [*enumerate(texts), (7, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 as media")
    got = {r["doc_id"]: r for r in M.summary(df).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = M.payload_of(raw)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(payload) + 44 and r["media_sha256"] == hashlib.sha256(M.encode_wav(payload)).hexdigest()
    assert got[2]["feature"] == got[7]["feature"] and got[0]["feature"] == got[1]["feature"] != got[3]["feature"]
    tensors = M.media_tensors(M.media_column(df.select("doc_id", "text"))).collect()
    assert all(len(r["tensor"]) == M.TENSOR * M.MELS and r["t_end"] > r["t_start"] for r in tensors)
    assert M.summary(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_result_has_the_tensors_as_an_arrow_stream(spark):
    rows = [(1, "calm words then LOUD!!! " * 200), (2, ""), (None, None), (4, "x" * 5000)]
    for r in M.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found, times = M.load_tensors(bytes(r["tensors"]))
        want, spans = M.tensors(*M.features(M.payload_of((dict(rows)[r["doc_id"]] or "").encode())))
        assert found.dtype == np.float32 and np.allclose(found, want, atol=0.0626) and np.array_equal(found * 8, np.round(found * 8)) and times == spans and found.shape[1:] == (M.TENSOR, M.MELS)
        assert len(found) == int(r["feature"].split(";")[2])
