"""Compression of vectors to codes by codebooks of their parts, with annular norm pruning.

Every component x becomes the whole number floor(1024 x).  Vectors are cut into ``PARTS`` equal consecutive parts.  Each place has a codebook,
which starts as that part of the first ``ENTRIES`` vectors by id.  In each of ``ROUNDS`` rounds every part goes to the nearest entry (squared Euclidean
distance, ties to the lower index), and every used entry becomes the floor of its parts' mean.  In the end parts are assigned once more.

Method.  The entries of a codebook are sorted by norm.  By the triangle inequality an entry at a distance of at most b has a norm within b of
the part's.  A part first meets the entries nearest to it in norm; their best distance bounds an interval of norms, whose ends are found by
binary search.  The entries in it, both ends included, are evaluated: first below, then, with the bound that is left, above.  Parts
are evaluated in blocks of similar norms, so a block's matrix product covers the annuli of its parts.  Distances are whole numbers: products
of doubles where all sums stay below 2**53, 64-bit integers elsewhere.  Norms, which are rounded, only widen the interval.

Scale.  A round is one pass over the vectors.  A task adds up its parts by entry and passes on at most PARTS * ENTRIES rows; Spark adds those
up, and the codebooks, PARTS * ENTRIES entries, are all that comes to the driver or goes to tasks.  No vectors are shuffled, and a hot
label or a large group of equal vectors is spread like all rows; the sums of labels are added up within tasks first.

Edge cases.  Vectors that are null or hold a null, NaN or infinite component are left out.  Vectors shorter than the longest, or whose length is no
multiple of ``PARTS``, count as followed by zeros.  Empty vectors have parts of zeros.  Rows without an id come after all ids; rows that
share an id go by their components, and count each.  With fewer than ``ENTRIES`` rows each is an entry.  Components are held within a bound that
keeps distances within 64 bits (over 33 million at 64 dimensions); a label whose errors sum to more than 64 bits has a null sum.  An empty
table gives no rows.  Other columns are ignored, so they can't clash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024.0

#: Parts evaluated at once, and the entries around their norms that they meet first, on either side.
BLOCK = 256
AROUND = 8
ROWS = 8192


class Codebook:
    """Entries (k, d) of whole numbers in order of their norms."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.index = np.argsort(squares, kind="stable")
        self.entries, self.squares = entries[self.index], squares[self.index]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.largest = int(np.abs(entries).max(initial=0))
        #: Distances evaluated so far, for tests.
        self.evaluated = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of each part (n, d)."""
        largest = max(self.largest, int(np.abs(parts).max(initial=0)))
        kind = np.float64 if 4 * largest * largest * max(1, parts.shape[1]) < 1 << 53 else np.int64
        entries, own = self.entries.astype(kind), self.squares.astype(kind)
        squares = (parts * parts).sum(axis=1)
        by_norm = np.argsort(squares, kind="stable")
        found, best = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for start in range(0, len(parts), BLOCK):
            at = by_norm[start : start + BLOCK]
            rows, sq = parts[at].astype(kind), squares[at].astype(kind)
            norm = np.sqrt(sq.astype(np.float64))
            index, least = np.full(len(at), ENTRIES, np.int64), np.full(len(at), np.iinfo(np.int64).max, np.int64)

            def meet(which: np.ndarray, lo: int, hi: int) -> None:
                if lo >= hi or not len(which):
                    return
                self.evaluated += len(which) * (hi - lo)
                d = own[lo:hi] + sq[which, None] - 2 * (rows[which] @ entries[lo:hi].T)
                near = d.min(axis=1)
                first = np.where(d == near[:, None], self.index[lo:hi], ENTRIES).min(axis=1)
                near = near.astype(np.int64)
                better = (near < least[which]) | ((near == least[which]) & (first < index[which]))
                index[which[better]], least[which[better]] = first[better], near[better]

            def reach() -> np.ndarray:
                r = np.sqrt(least.astype(np.float64))
                return r + 1e-9 * (1 + norm + r)

            a = max(0, int(np.searchsorted(self.norms, norm[0], "left")) - AROUND)
            b = min(len(own), int(np.searchsorted(self.norms, norm[-1], "right")) + AROUND)
            meet(np.arange(len(at)), a, b)
            low = np.searchsorted(self.norms, norm - reach(), "left")
            which = np.flatnonzero(low < a)
            meet(which, int(low[which].min(initial=a)), a)
            high = np.searchsorted(self.norms, norm + reach(), "right")
            which = np.flatnonzero(high > b)
            meet(which, b, int(high[which].max(initial=b)))
            found[at], best[at] = index, least
        return found, best


def _rows(batches, column: str):
    """Batches of at most ``ROWS`` rows with their vectors as an array (n, width)."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            some = batch.slice(at, ROWS)
            vectors = some.column(some.schema.get_field_index(column))
            yield some, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), -1)


def _cut(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def sums(entries: list[np.ndarray]):
    """For mapInArrow: rows and component sums of the parts of each entry in a task."""

    def run(batches):
        books = [Codebook(e) for e in entries]
        n = np.zeros((PARTS, len(entries[0])), np.int64)
        total = np.zeros((PARTS, *entries[0].shape), np.int64)
        for _, vectors in _rows(batches, "v"):
            for i, parts in enumerate(_cut(vectors)):
                found, _ = books[i].nearest(parts)
                n[i] += np.bincount(found, minlength=n.shape[1])
                np.add.at(total[i], found, parts)
        part, entry = np.nonzero(n)
        if len(part):
            lists = pa.array([x.tolist() for x in total[part, entry]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), lists], ["part", "entry", "n", "sums"])

    return run


def assign(entries: list[np.ndarray]):
    """For mapInArrow: vec_id, label, code and error of each row."""

    def run(batches):
        books = [Codebook(e) for e in entries]
        for some, vectors in _rows(batches, "v"):
            found, errors = zip(*(book.nearest(parts) for book, parts in zip(books, _cut(vectors))))
            codes = np.stack(found, axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(errors))], ["vec_id", "label", "code", "error"])

    return run


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v, the components as whole numbers, of the rows kept; written to the shared folder."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", x.alias("x")).filter(
        F.col("x").isNotNull() & F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    )
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = PARTS * max(1, -(-longest // PARTS))
    bound = float(math.isqrt((1 << 62) // width) // 2)
    numbers = F.transform("x", lambda y: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), y * SCALE))).cast("int"))
    padded = F.concat(numbers, F.array_repeat(F.lit(0), F.lit(width) - F.size("x")))
    return materialize(rows.select("vec_id", "label", padded.alias("v")), "codes-vectors")


def train(rows: DataFrame) -> list[np.ndarray]:
    """The final codebooks, one (entries, width) array a part; [] without rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    if not first:
        return []
    entries = _cut(np.array([r["v"] for r in first], np.int64))
    for _ in range(ROUNDS):
        found = rows.select("v").mapInArrow(sums(entries), "part int, entry int, n long, sums array<long>")
        added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(entries[0].shape[1])]
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()  # PARTS * ENTRIES rows at most
        entries = [e.copy() for e in entries]
        for part, entry, n, *total in found:
            entries[part][entry] = [s // n for s in total]
    return entries


def digest(entries: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for e in entries for x in e.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the kept rows of ``vectors`` (vec_id, embedding, label)."""
    rows = whole_numbers(vectors)
    entries = train(rows)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    coded = rows.mapInArrow(assign(entries), f"{kinds}, code string, error long")
    coded = materialize(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))
