"""Quality classifier: gated attention over the passages of a document (multiple-instance learning).

A document is a bag of passages of PASSAGE words. Each passage is described by the shares of its byte kinds and by statistics of its
word hashes, and encoded by a tanh layer. Gated attention, a = softmax(w . (tanh(V h) * sigmoid(U h))), is learnt from document
labels only; the score is the sigmoid of a linear form of the attention-weighted passage encoding. Training is full-batch Adam in
numpy with a fixed seed.

Labels come from rows whose crc32(doc_id as text) mod FOLDS is not 0. The fit uses at most ``sample`` labelled documents (the least
by a hash of their id) of at most ``passages`` passages each, so what reaches the driver is bounded by sample * passages * FEATURES
floats; scoring covers every passage of every document.

Defined results: a null or empty text is one passage without words and is scored as such. A repeated labelled id counts once, with the
least of its labels; null labels and null ids are not learnt from. A null id is not held out. Without both classes among
the learnt rows, every score is the share of label 1 among them, or 0.5 without any. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm._words import Words, chunks, map_texts, only

PASSAGE = 64
FOLDS = 5
THRESHOLD = 0.3

_KIND = np.full(256, 15, np.int64)
for _k, _bytes in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#", b"*$", b"%&", b"<>{}[]()", b"'\"`", b"-_/\\=+~^@"]):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 14
KINDS = 16
FEATURES = KINDS + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and first[i]:first[i + 1] for the passages of text i."""
    w = Words(texts)
    n = np.diff(w.first)
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    text_of = np.repeat(np.arange(len(texts)), bags)
    nth = np.arange(total) - first[text_of]
    at_word = w.first[text_of] + nth * PASSAGE  # passage p's first word
    until = np.minimum(at_word + PASSAGE, w.first[text_of + 1])
    start_byte = np.where(nth == 0, w.offset[text_of], np.append(w.start, len(w.buf))[np.minimum(at_word, len(w.start))])
    of_byte = np.repeat(np.arange(total), np.diff(np.append(start_byte, len(w.buf))))
    kinds = np.bincount(of_byte * KINDS + _KIND[w.buf], minlength=total * KINDS).reshape(total, KINDS).astype(np.float32)
    size = np.maximum(1, kinds.sum(1, keepdims=True))
    words = (until - at_word).astype(np.float32)
    some = np.maximum(1, words)
    of_word = np.repeat(np.arange(total), until - at_word)
    order = np.lexsort((w.hash, of_word))
    h, p = w.hash[order], of_word[order]
    again = np.bincount(p[1:][(h[1:] == h[:-1]) & (p[1:] == p[:-1])], minlength=total) if len(h) else np.zeros(total)
    echo = np.bincount(of_word[1:][(w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])], minlength=total) if len(h) else np.zeros(total)
    letters = np.bincount(of_word, weights=w.end - w.start, minlength=total) if len(h) else np.zeros(total)
    long = np.bincount(of_word[(w.end - w.start) > 24], minlength=total) if len(h) else np.zeros(total)
    extra = np.stack([words / PASSAGE, again / some, echo / some, np.log1p(letters / some), long / some, np.log1p(nth)], 1)
    return np.concatenate([kinds / size, extra], 1).astype(np.float32), first


@dataclass
class AttentionMIL:
    """Parameters of the encoder (A, a), the gate (V, U, w) and the linear form (c, b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, first[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        of = np.repeat(np.arange(len(starts)), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, starts)[of])
        alpha = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(h * alpha[:, None], starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "of": of, "alpha": alpha, "z": z, "y": y}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward(x, first)["y"].astype(np.float64)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, width: int = 16, gate: int = 8, steps: int = 300, rate: float = 0.02, seed: int = 7) -> AttentionMIL:
    """Learn from bags (rows first[i]:first[i + 1] of x) and their 0/1 labels."""
    if len(label) == 0 or label.min() == label.max():
        return AttentionMIL(np.zeros(FEATURES), np.ones(FEATURES), {}, float(label.mean()) if len(label) else 0.5)
    rng = np.random.default_rng(seed)
    shape = {"A": (x.shape[1], width), "a": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "b": (1,)}
    p = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()}
    model = AttentionMIL(x.mean(0), x.std(0) + 1e-3, p)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())).astype(np.float32)
    weight = np.sqrt(weight / weight.mean())
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, first)
        d = ((f["y"] - label) * weight / len(label)).astype(np.float32)
        h, alpha, of = f["h"], f["alpha"], f["of"]
        dz = d[of, None] * p["c"]
        dalpha = (dz * h).sum(1)
        inner = np.add.reduceat(alpha * dalpha, first[:-1])
        de = (alpha * (dalpha - inner[of]))[:, None]
        gv, gu = de * p["w"] * f["u"] * (1 - f["v"] ** 2), de * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (dz * alpha[:, None] + gv @ p["V"].T + gu @ p["U"].T) * (1 - h**2)
        grad = {"A": f["x"].T @ dh, "a": dh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "w": ((f["v"] * f["u"]) * de).sum(0), "c": f["z"].T @ d, "b": np.array([d.sum()])}
        for k, g in grad.items():
            g = g + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] -= (rate * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", sample: int = 4000, most: int = 400) -> AttentionMIL:
    """Fit on the labelled sample; ``most`` passages bound a document that is learnt from."""
    known = only(labels, id, label).where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(id).agg(F.min(label).alias("label")).orderBy(F.xxhash64(id), id).limit(sample)
    chosen = only(documents, id, text).join(F.broadcast(known), id)  # the sample's size bounds this side

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        x, first = passages(texts)
        bags = [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        return {"doc_id": part.column(0), "label": part.column(2).cast(pa.int32()), "n": [len(b) for b in bags], "x": [b.tobytes() if len(b) <= most else None for b in bags]}

    rows = map_texts(chosen.select(id, text, "label"), work, "doc_id long, label int, n int, x binary", text).where("x is not null").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["x"].to_pylist()]
    bags = [bags[k] for k in order]
    y = rows["label"].to_numpy()[order].astype(np.float32)
    x = np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32)
    return fit(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64), y)


def score(documents: DataFrame, model: AttentionMIL, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        return {"doc_id": part.column(0), "score": model.score(*passages(texts))}

    scored = map_texts(only(documents, id, text), work, "doc_id long, score double", text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))


def accept(documents: DataFrame, model: AttentionMIL, text: str = "text") -> DataFrame:
    """The rows, all columns, whose score reaches the threshold."""
    at = documents.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, at, 1 << 20):
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(model.score(*passages(texts)) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
