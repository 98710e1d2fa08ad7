"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is encoded: shares of its bytes by kind (each ASCII
punctuation mark, digits, upper and lower case, white space, the rest), how words repeat, their length and number, and the shares of its
character 3-grams in ``BUCKETS`` hash buckets.  A layer gives ``h``; gated attention ``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the
passages of a document; the weighted sum of their ``h`` is scored.  Encoder, attention and scorer are learned together from document
labels by Adam.

Learning takes ``PER_CLASS`` rows of each label at most, all of their passages; scoring covers every passage of every whole text.
Passages are encoded on the executors; the driver gets the sample's numbers only.  The model is a few thousand numbers.

Edge cases.  Null texts and texts without a word have no passage and get score 0, as everything does if no label could be learned.
With one label only, every other text gets that label as its score.  A null id belongs to no fold and isn't learned from; null labels
aren't either.  Repeated rows are scored each, alike; of several labels of an id the lowest counts.  A very long text has many passages, and
memory for those of one text at a time.  An empty table gives no rows.  ``score`` replaces columns named score and predicted and keeps
others; ``classify`` ignores other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from rategrid.llm.common import appended, fold, labelled, small_batches, with_columns, words_of

FOLDS, HELD_OUT = 4, 2
PER_CLASS = 2500
PASSAGE_WORDS = 64
BUCKETS = 64
CUT = 0.7
HIDDEN, GATE = 16, 8
STEPS, BAGS, RATE = 1500, 128, 0.01

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _kinds() -> np.ndarray:
    """A (256, kinds) matrix that sums byte counts by kind."""
    out = np.zeros((256, len(_MARKS) + 5))
    for c in range(256):
        if c in _MARKS:
            k = _MARKS.index(c)
        else:
            k = len(_MARKS) + (0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 if c <= 32 else 4)
        out[c, k] = 1
    return out


_KINDS = _kinds()
SHAPE = 6
WIDTH = _KINDS.shape[1] + BUCKETS + SHAPE


def encode(text: str | None) -> np.ndarray:
    """(passages, WIDTH) numbers."""
    words = words_of(text or "")
    n = -(-len(words) // PASSAGE_WORDS)
    out = np.zeros((n, WIDTH), np.float32)
    counts, grams = np.zeros((n, 256)), np.zeros((n, BUCKETS))
    for i in range(n):
        own = words[i * PASSAGE_WORDS : (i + 1) * PASSAGE_WORDS]
        k = len(own)
        data = np.frombuffer(b" ".join(own), np.uint8)
        counts[i] = np.bincount(data, minlength=256)
        x = data.astype(np.uint32)
        h = ((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(26)
        grams[i] = np.bincount(h, minlength=BUCKETS)
        same = sum(a == b for a, b in zip(own, own[1:]))
        length = sum(map(len, own)) / k
        out[i, -SHAPE:] = len(set(own)) / k, same / k, min(length, 40.0) / 10, max(map(len, own)) ** 0.5 / 10, k / PASSAGE_WORDS, k < 8
    if n:
        share = np.hstack([counts @ _KINDS / counts.sum(1, keepdims=True), grams / np.maximum(grams.sum(1, keepdims=True), 1)])
        out[:, :-SHAPE] = np.sqrt(share)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _forward(m: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    """Activations for the passages ``x`` of ``n`` bags; ``bag`` holds each passage's bag, ascending."""
    h = np.tanh((x - m["mean"]) / m["sd"] @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, e)
    a = np.exp(e - top[bag])
    a /= np.bincount(bag, a, n)[bag]
    starts = np.searchsorted(bag, np.arange(n))
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["c0"])}


def _gradient(m: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(m, x, bag, len(y))
    out = (f["p"] - y) / len(y)
    dz = out[:, None] * m["c"]
    along = (f["h"] * dz[bag]).sum(1)
    de = f["a"] * (along - np.bincount(bag, f["a"] * along, len(y))[bag])
    dt = de[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[bag] + dt @ m["V"].T + dg @ m["U"].T) * (1 - f["h"] ** 2)
    s = (x - m["mean"]) / m["sd"]
    return {"W": s.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ out, "c0": out.sum()}


def fit(bags: list[tuple[np.ndarray, float]]) -> dict | None:
    """The model from (passages, label) pairs; None without any."""
    bags = [(x, y) for x, y in bags if len(x)]
    if not bags:
        return None
    if len({y for _, y in bags}) == 1:
        return {"only": bags[0][1]}
    every = np.vstack([x for x, _ in bags])
    draw = np.random.default_rng(7)
    start = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
    m = {"mean": every.mean(0), "sd": every.std(0) + 0.02, "W": start(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "w": start(GATE), "c": start(HIDDEN), "c0": np.zeros(())}
    moving = ("W", "b", "V", "U", "w", "c", "c0")
    first, second = ({k: np.zeros_like(m[k]) for k in moving} for _ in range(2))
    for step in range(1, STEPS + 1):
        picked = draw.integers(0, len(bags), min(BAGS, len(bags)))
        xs = [bags[i][0] for i in picked]
        bag = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
        grad = _gradient(m, np.vstack(xs), bag, np.array([bags[i][1] for i in picked]))
        rate = RATE * (1 - step / (STEPS + 1))
        for k in moving:
            g = grad[k] + 1e-4 * m[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def predict(model: dict | None, texts: list) -> np.ndarray:
    """Scores of texts."""
    out = np.zeros(len(texts))
    if model is None:
        return out
    held: list = []

    def flush():
        if "only" in model:
            out[[i for i, _ in held]] = model["only"]
        else:
            bag = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
            out[[i for i, _ in held]] = _forward(model, np.vstack([x for _, x in held]), bag, len(held))["p"]
        held.clear()

    waiting = 0
    for i, t in enumerate(texts):
        x = encode(t)
        if len(x):
            held.append((i, x))
            waiting += len(x)
        if waiting > 20_000:
            flush()
            waiting = 0
    if held:
        flush()
    return out


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with score and predicted added (columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def scored(frames):
        for batch in frames:
            p = predict(model, batch.column(at).to_pylist())
            yield appended(batch, score=pa.array(p, pa.float64()), predicted=pa.array((p >= CUT).astype("int32"), pa.int32()))

    return small_batches(docs).mapInArrow(scored, with_columns(docs.schema, score=DoubleType(), predicted=IntegerType()))


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    rows, _ = labelled(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS)

    def encoded(frames):
        for batch in frames:
            held = [encode(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(held, pa.binary())], ["place", "y", "passages"])

    got = small_batches(rows.select("place", "text", "y")).mapInArrow(encoded, "place long, y int, passages binary").collect()
    bags = sorted((r["place"], r["y"], bytes(r["passages"])) for r in got)
    return fit([(np.frombuffer(x, np.float32).reshape(-1, WIDTH), float(y)) for _, y, x in bags])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality)."""
    own = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return score(own, learn(docs, labels)).drop("text")
