"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on the toxic passages of the labelled sample, one on its ordinary text.  A window of a text,
one word long, is compressed with either; the distance is how many bytes fewer the toxic dictionary needs.  The number of
windows of a text whose distance reaches each of the thresholds 2 to 8 goes into a logistic calibration, fitted on the same sample.

The label marks whole documents, most of whose text is ordinary.  Toxic passages are therefore the words that documents marked toxic
hold ``MIN_LIFT`` times as often as others do; copies in the sample are counted once.  This departs from training on the whole text of
toxic documents, which separates documents poorly here (README has the figures): the few toxic words of a window drown in the noise of
what ordinary words cost.

zstandard finds no match in the last bytes of its input and stores what it can't shorten, so a word is framed by two constant strings
that both dictionaries hold; what they cost is the same on both sides.

Words are runs of ASCII letters and non-ASCII bytes, with A to Z lower-cased.  Equal windows are compressed once by a worker (up to
``CACHE`` of them at a time), so the work follows the distinct words of a task.

Learning takes ``PER_CLASS`` rows of each label at most, with their whole texts; scoring covers every whole text.

Edge cases.  Null and empty texts have no window and get the calibration's base score.  With no toxic or no ordinary row to learn
from every score is 0.  A null id belongs to no fold and isn't learned from, nor are null labels.  Repeated rows are scored each, alike; of
several labels of an id the lowest counts.  A very long text is one more row: only counts of it are kept.  An empty table gives no rows.
``score`` replaces columns named score and predicted and keeps others; ``classify`` ignores other columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from rategrid.llm.common import appended, fold, labelled, small_batches, with_columns

FOLDS, HELD_OUT = 3, 1
PER_CLASS = 2500
CUT = 0.7
MIN_LIFT, MIN_DOCS, MIN_SHARE = 8.0, 5, 0.01
TOXIC_BYTES, ORDINARY_BYTES = 4096, 8192
THRESHOLDS = tuple(range(2, 9))
CACHE = 400_000

#: Not letters: all of ASCII but a to z, after lower-casing.
_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_HEAD, _TAIL = bytes(range(8)) + b" ", b" " + bytes(range(16, 28))
_LEVEL = dict(window_log=14, hash_log=11, chain_log=11, search_log=3, min_match=4, strategy=3, target_length=8, write_content_size=0, write_dict_id=0)

_ready: dict = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples, ending with the frame."""
    samples = samples or [b" "]
    try:
        own = zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:  # too few samples to train from: their end serves as it is
        own = b"".join(samples)[-size:]
    return own + _TAIL + _HEAD


class Distance:
    """Bytes that the toxic dictionary saves on a word, against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        parameters = zstandard.ZstdCompressionParameters(**_LEVEL)

        def sizes(data: bytes):
            made = zstandard.ZstdCompressionDict(data)
            made.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=made, compression_params=parameters).compress

        self.toxic, self.ordinary, self.known = sizes(toxic), sizes(ordinary), {}

    def of(self, word: bytes) -> int:
        window = _HEAD + word + _TAIL
        return len(self.ordinary(window)) - len(self.toxic(window))

    def counts(self, text: str | None) -> list[int]:
        """How many words of the text reach each threshold, and the number of words."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        found = [0] * (THRESHOLDS[-1] + 1)
        own = words(text)
        for w in own:
            d = known.get(w)
            if d is None:
                d = known[w] = max(0, min(self.of(w), THRESHOLDS[-1]))
            if d:
                found[d] += 1
        return [*(sum(found[t:]) for t in THRESHOLDS), len(own)]


def _features(counts: list) -> np.ndarray:
    c = np.asarray(counts, float).reshape(-1, len(THRESHOLDS) + 1)
    c, size = c[:, :-1], np.log1p(c[:, -1:]) / 10
    return np.hstack([np.minimum(c, 4) / 4, c > 0, c > 1, np.log1p(c) * size, size, np.ones((len(c), 1))])


def _passages(rows: list) -> tuple[list[bytes], list[bytes]]:
    """The words toxic documents stand out by, as often as they occur there, and the words of the others."""
    seen: set = set()
    docs = []
    for text, y, *_ in rows:
        own = words(text)
        parts = {b" ".join(own[i : i + 8]) for i in range(0, len(own), 8)}
        if parts and len(parts & seen) <= 0.3 * len(parts):
            seen |= parts
            docs.append((own, y))
    n = [max(1, sum(y == v for _, y in docs)) for v in (0, 1)]
    held: tuple[dict, dict] = ({}, {})
    for own, y in docs:
        for w in set(own):
            held[y][w] = held[y].get(w, 0) + 1
    least = max(MIN_DOCS, MIN_SHARE * n[1])
    marks = {w for w, c in held[1].items() if c >= least and c / n[1] >= MIN_LIFT * (held[0].get(w, 0) + 0.5) / n[0]}
    toxic = [b" " + w + b" " for own, y in docs if y for w in own if w in marks]
    return toxic, [b" " + w + b" " for own, y in docs if not y for w in own]


def fit(rows: list) -> dict | None:
    """The model from (text, label, weight) rows; None if a label is missing."""
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    toxic, ordinary = _passages(rows)
    model = {"toxic": dictionary(toxic, TOXIC_BYTES), "ordinary": dictionary(ordinary, ORDINARY_BYTES)}
    distance = Distance(model["toxic"], model["ordinary"])
    x = _features([distance.counts(r[0]) for r in rows])
    w = np.zeros(x.shape[1])
    weight = np.array([r[2] for r in rows], float)
    weight /= weight.mean()
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - y)) + 0.5 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return model | {"w": w.tolist()}


def _distance(model: dict) -> Distance:
    key = (model["toxic"], model["ordinary"])
    if key not in _ready:
        _ready.clear()
        _ready[key] = Distance(*key)
    return _ready[key]


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with score and predicted added (columns of these names are replaced)."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def scored(frames):
        for batch in frames:
            if model is None or not batch.num_rows:
                p = np.zeros(batch.num_rows)
            else:
                distance = _distance(model)
                x = _features([distance.counts(t) for t in batch.column(at).to_pylist()])
                p = 1 / (1 + np.exp(-x @ np.array(model["w"])))
            yield appended(batch, score=pa.array(p, pa.float64()), predicted=pa.array((p >= CUT).astype("int32"), pa.int32()))

    return small_batches(docs).mapInArrow(scored, with_columns(docs.schema, score=DoubleType(), predicted=IntegerType()))


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    rows, weight = labelled(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS)
    got = sorted(rows.collect(), key=lambda r: (r["place"], r["id"]))  # 2 * PER_CLASS texts at most
    return fit([(r["text"], r["y"], weight[r["y"]]) for r in got])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic)."""
    own = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return score(own, learn(docs, labels)).drop("text")
