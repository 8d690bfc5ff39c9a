"""Quality: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` white-space separated words. Each passage is encoded by a learned layer over shape
features (shares of character classes, marks, repeated and distinct words). Gated attention, tanh(E V) * sigmoid(E U) . w, gives each passage a weight;
the document's score comes from the weighted mean of its encoded passages. Only document labels are used: the
encoder, the gate and the output are trained together by gradient descent on a bounded sample, on the driver.

Scoring maps the documents where they lie, whole texts in batches, without a shuffle; the model is a few hundred numbers.

Defined cases: null and empty texts are one empty passage; without labels of both classes every score is the training share of good
documents (1 without any labels); a null id is never held out; repeated rows are scored each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sigmoid, training_sample
from .store import tidy, written

PASSAGE = 64
SAMPLE = 4_000
HIDDEN, GATE = 16, 8
MARKS = [b".", b",", b"!", b"?", b"|", b"*", b"&", b"$", b"%", b"#", b"-", b"\n"]
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SPACE, _BEYOND = b" \t\n\r\x0b\x0c", bytes(range(128, 256))


def passage_features(words: list[bytes]) -> list[float]:
    joined = b" ".join(words)
    n, k = max(1, len(joined)), max(1, len(words))
    left = lambda drop: (n if joined else 1) - len(joined.translate(None, drop))
    upper, lower, digit, beyond = left(_UPPER), left(_LOWER), left(_DIGIT), left(_BEYOND)
    distinct = len(set(words))
    runs = sum(map(eq, words, words[1:]))
    return [upper / n, lower / n, digit / n, beyond / n, (n - upper - lower - digit - beyond - k + 1) / n, n / k / 10, distinct / k, runs / k, min(k, PASSAGE) / PASSAGE] + [joined.count(m) / k for m in MARKS]


WIDTH = len(passage_features([]))


def passages(text: str | None) -> list[list[float]]:
    """Features of each passage. Line feeds are kept as marks of the word before."""
    words = (text or "").encode("utf-8", "replace").replace(b"\n", b"\n ").split(b" ")
    words = [w for w in words if w]
    return [passage_features(words[i : i + PASSAGE]) for i in range(0, max(1, len(words)), PASSAGE)]


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each document begins."""
    each = [passages(t) for t in texts]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    return np.array([p for x in each for p in x], np.float32).reshape(-1, WIDTH), starts.astype(np.int64)


@dataclass
class Model:
    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents and attention of the passages."""
        if not self.weights:
            sizes = np.diff(np.r_[starts, len(x)])
            return np.full(len(starts), self.share), np.repeat(1 / np.maximum(sizes, 1), sizes)
        if not len(starts):
            return np.zeros(0), np.zeros(0)
        state = forward(self.weights, ((x - self.mean) / self.scale).astype(np.float64), starts)
        return sigmoid(state["logit"]), state["a"]


def forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.r_[starts, len(x)])
    doc = np.repeat(np.arange(len(starts)), sizes)
    e = np.tanh(x @ w["enc"] + w["enc0"])
    t, g = np.tanh(e @ w["V"]), sigmoid(e @ w["U"])
    s = (t * g) @ w["w"]
    s = np.exp(s - np.maximum.reduceat(s, starts)[doc])
    a = s / np.add.reduceat(s, starts)[doc]
    z = np.add.reduceat(a[:, None] * e, starts)
    return {"doc": doc, "e": e, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["out"] + w["out0"]}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, dict[str, np.ndarray]]:
    f = forward(w, x, starts)
    p = sigmoid(f["logit"])
    d = (p - y) / len(y)
    e, t, g, a, doc = f["e"], f["t"], f["g"], f["a"], f["doc"]
    dz = d[:, None] * w["out"]
    pull = (dz[doc] * e).sum(1)
    ds = a * (pull - np.add.reduceat(a * pull, starts)[doc])
    dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
    de = (a[:, None] * dz[doc] + dt @ w["V"].T + dg @ w["U"].T) * (1 - e * e)
    out = {"out": f["z"].T @ d, "out0": d.sum(keepdims=True), "w": (t * g).T @ ds, "V": e.T @ dt, "U": e.T @ dg, "enc": x.T @ de, "enc0": de.sum(0)}
    loss = -np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))
    return float(loss), {k: v + ridge * w[k] for k, v in out.items()}


def fit(x: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.03, ridge: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by Adam on all bags at once."""
    rng = np.random.default_rng(seed)
    shape = {"enc": (x.shape[1], HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "out": (HIDDEN,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()} | {"enc0": np.zeros(HIDDEN), "out0": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        _, grad = gradients(w, x, starts, y, ridge)
        for k, d in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    sample = written(training_sample(docs, labels, label, most), "quality-sample")

    @tidy
    def run(batches):
        for b in batches:
            data = [np.array(passages(t), "<f4").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), b.column(1)], names=["x", "y"])

    rows = sorted(sample.mapInArrow(run, "x binary, y int").toArrow().to_pylist(), key=lambda r: (r["x"], r["y"]))
    y = np.array([r["y"] for r in rows], float)
    share = float(y.mean()) if len(y) else 1.0
    if share in (0.0, 1.0):
        return Model(share)
    each = [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in rows]
    x, starts = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
    mean, scale = x.mean(0), x.std(0) + 1e-3
    return Model(share, mean, scale, fit(((x - mean) / scale).astype(np.float32), starts, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """doc_id, score, passages (their number), focus (index of the passage with the largest weight) and focus_weight."""
    id_type = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), batch):
                b = whole.slice(i, batch)
                x, starts = bags(b.column(1).to_pylist())
                p, a = model.scores(x, starts)
                ends = [*starts[1:], len(a)]
                focus = [int(np.argmax(a[s:e])) for s, e in zip(starts, ends, strict=True)]
                top = [float(a[s + k]) for s, k in zip(starts, focus, strict=True)]
                sizes = [int(e - s) for s, e in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(sizes, pa.int64()), pa.array(focus, pa.int64()), pa.array(top, pa.float64())], names=["doc_id", "score", "passages", "focus", "focus_weight"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, passages long, focus long, focus_weight double")
