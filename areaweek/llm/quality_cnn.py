"""Document quality by a small byte-level convolutional network, in numpy.

Bytes become learned vectors; learned filters slide over them in steps of
``STRIDE``; a document is cut into overlapping chunks that cover all of it, and
each filter's largest response is taken in every chunk. The mean and the maximum of
the chunks' responses go through one logistic layer. Step and width are such that a
chunk is two matrix products without copying windows.

Defined cases: a null or empty text is one chunk of padding and gets the score the
network gives that; with training rows of one label only, every text scores that
label (0.5 if there are none); repeated rows are scored each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from areaweek.llm.common import small_batches
from areaweek.llm.labelled import Sample

EMBED = 8
STRIDE = 4
WIDTH = 8  # bytes under a filter: two steps
FILTERS = 32
CHUNK = 512
OVERLAP = 64
SAMPLE = 2500  # documents of each label
CHUNKS_A_STEP = 4  # chunks of a document in one training step, drawn anew each time
EPOCHS = 8
BATCH = 64
RATE = 0.01


@dataclass
class Network:
    """Parameters; ``constant`` replaces them where there was nothing to learn."""

    embed: np.ndarray
    near: np.ndarray
    far: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every step of an array of bytes (a row per chunk)."""
        steps = self.embed[data].reshape(*data.shape[:-1], data.shape[-1] // STRIDE, STRIDE * EMBED)
        z = steps[..., :-1, :] @ self.near
        z += steps[..., 1:, :] @ self.far
        return z

    def score(self, data: bytes) -> float:
        if self.constant is not None:
            return self.constant
        pooled = []
        for part in _parts(data):
            z = self.responses(part)
            starts = np.arange(0, max(1, len(z) - OVERLAP // STRIDE + 1), (CHUNK - OVERLAP) // STRIDE)
            ends = np.minimum(starts + CHUNK // STRIDE - 1, len(z))
            edges = np.stack([starts, ends], 1).ravel()
            # chunks overlap, so reduce between all their edges and join neighbours
            pooled.append(_pool(z, edges))
        h = np.maximum(np.concatenate(pooled) + self.offset, 0.0)
        x = np.concatenate([h.mean(axis=0), h.max(axis=0)])
        return float(1.0 / (1.0 + np.exp(-np.clip(x @ self.out + self.bias[0], -40, 40))))


def _pool(z: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Largest response between each pair of edges (start, end, start, end, ...)."""
    padded = np.concatenate([z, np.full((1, z.shape[1]), -np.inf, z.dtype)])
    return np.maximum.reduceat(padded, edges, axis=0)[::2]


#: Bytes that are looked at together, a whole number of chunk steps; bounds memory for long texts.
PART = 1024 * (CHUNK - OVERLAP)


def _padded(data: bytes) -> np.ndarray:
    n = max(2 * STRIDE, -len(data) // STRIDE * -STRIDE)
    return np.frombuffer(data.ljust(n, b"\0"), np.uint8)


def _parts(data: bytes) -> Iterator[np.ndarray]:
    """The bytes in parts that overlap as chunks do."""
    for start in range(0, max(1, len(data) - OVERLAP), PART):
        yield _padded(data[start : start + PART + OVERLAP])


def _chunks(data: bytes) -> np.ndarray:
    """All chunks of a text, each padded to full length."""
    starts = range(0, max(1, len(data) - OVERLAP), CHUNK - OVERLAP)
    return np.stack([np.frombuffer(data[s : s + CHUNK].ljust(CHUNK, b"\0"), np.uint8) for s in starts])


def fit(sample: Sample, seed: int = 7) -> Network:
    """Adam on the likelihood, each label weighted to its true share."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f32),
        "near": rng.normal(0, 0.2, (STRIDE * EMBED, FILTERS)).astype(f32),
        "far": rng.normal(0, 0.2, (STRIDE * EMBED, FILTERS)).astype(f32),
        "offset": np.zeros(FILTERS, f32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(f32),
        "bias": np.zeros(1, f32),
    }
    n_pos, n_neg = len(sample.positive), len(sample.negative)
    if not n_pos or not n_neg:
        return Network(**p, constant=0.5 if n_pos == n_neg else float(n_pos > 0))
    texts = [t.encode("utf-8", "surrogatepass") for t in sample.positive + sample.negative]
    chunked = [_chunks(t) for t in texts]
    y = np.concatenate([np.ones(n_pos, f32), np.zeros(n_neg, f32)])
    true = sample.n_positive / (sample.n_positive + sample.n_negative)
    weight = np.where(y == 1, true / n_pos, (1 - true) / n_neg).astype(f32) * len(y)
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            t += 1
            rows = order[at : at + BATCH]
            drawn = [c if len(c := chunked[d]) <= CHUNKS_A_STEP else c[rng.choice(len(c), CHUNKS_A_STEP, False)] for d in rows]
            grads = _gradient(Network(**p), drawn, y[rows], weight[rows])
            rate = RATE * 0.5 * (1 + np.cos(np.pi * t / (EPOCHS * -(-len(order) // BATCH) + 1)))
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-6)).astype(f32)
    return Network(**p)


def _gradient(net: Network, drawn: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    data = np.concatenate(drawn)
    doc = np.repeat(np.arange(len(drawn)), [len(c) for c in drawn])
    z = net.responses(data)  # chunk, step, filter
    best = z.argmax(axis=1)
    top = np.take_along_axis(z, best[:, None, :], 1)[:, 0, :] + net.offset
    h = np.maximum(top, 0.0)
    first = np.concatenate([[0], np.cumsum([len(c) for c in drawn])[:-1]])
    n = np.array([len(c) for c in drawn], np.float32)
    mean = np.add.reduceat(h, first, axis=0) / n[:, None]
    most = np.maximum.reduceat(h, first, axis=0)
    x = np.concatenate([mean, most], axis=1)
    prob = 1.0 / (1.0 + np.exp(-np.clip(x @ net.out + net.bias[0], -40, 40)))
    d = (prob - y) * weight / len(y)
    dx = d[:, None] * net.out[None, :]
    dh = dx[doc, :FILTERS] / n[doc][:, None] + np.where(h == most[doc], dx[doc, FILTERS:], 0.0)
    dh = np.where(top > 0, dh, 0.0).astype(np.float32)

    # only the winning window of a filter in a chunk carries a gradient
    where = best[..., None] * STRIDE + np.arange(WIDTH)  # chunk, filter, byte
    seen = data[np.arange(len(data))[:, None, None], where]
    vectors = net.embed[seen].reshape(*seen.shape[:2], WIDTH * EMBED)
    both = np.concatenate([net.near, net.far])  # byte and embedding, filter
    d_both = np.einsum("cfk,cf->kf", vectors, dh)
    d_vec = (dh[..., None] * both.T[None]).reshape(-1, EMBED)
    flat = seen.ravel()
    d_embed = np.stack([np.bincount(flat, weights=d_vec[:, e], minlength=256) for e in range(EMBED)], 1)
    half = STRIDE * EMBED
    return {
        "embed": d_embed.astype(np.float32),
        "near": d_both[:half],
        "far": d_both[half:],
        "offset": dh.sum(axis=0),
        "out": (x.T @ d + 1e-4 * net.out).astype(np.float32),
        "bias": np.array([d.sum()], np.float32),
    }


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            found = pa.array([net.score(t.as_py() or b"") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), found], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
