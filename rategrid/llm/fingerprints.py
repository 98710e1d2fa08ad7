"""Fingerprints of texts from their improbable byte windows, kept in chained Bloom filters.

Every ``WINDOW`` successive bytes of a UTF-8 text are a window, with the entropy of its bytes.  The rarity of an entropy is its rank by how many
windows of all texts have it, the rarest first; windows with an entropy under ``WEAK_BITS`` come after all others.  Every run of ``RUN``
successive windows votes for its rarest, the first of equals, and a window with ``VOTES`` votes is a feature.  In a text of fewer than ``FEW``
windows all are features.  Features that differ go, in order, to Bloom filters of ``BITS`` bits, ``BITS_EACH`` bits a feature; a filter that took ``FULL`` features is followed by
the next.  The fingerprint is the filters in hexadecimal.

Likeness.  Two filters with b1 and b2 bits share about b1 b2 / BITS of them by chance.  Their overlap is what they share beyond chance and
``SIGMAS`` standard deviations, as a part of what min(b1, b2) would be beyond these.  The likeness of two fingerprints is the mean, over the filters of
that with fewer, of the best overlap with a filter of the other, weighted by bits.  Equal fingerprints have 1, and one without filters is
unlike any other.

Neighbours.  ``compare`` gives each document its own fingerprint and that of an edited text, whose last half is from the next document.
Documents are cut at given ids into ranges of about equal size.  The first document of a range is sent to the range before as well, so
each range, sorted by id, is a stream in which every document sees the next one.

Scale.  One pass adds up entropies, at most ``LEVELS + 1`` counts a task, and another, with the only shuffle of texts, makes the fingerprints.
Only the counts of entropies and the ids at which ranges begin (``DOCS_A_RANGE`` documents each, at most ``MOST_RANGES``) come to the driver.
Texts are worked on in tiles of ``TILE`` bytes, and runs end with their tile, so a text needs memory for itself, its edited text and a tile.

Edge cases.  Null texts count as empty; the fingerprint of an empty text is empty.  A text of fewer than ``WINDOW`` bytes is one window, the rest of
which is zeros.  Rows without an id come after all others.  Rows that share an id, and those without one, follow each other by their texts;
they are one range's stream, sorted outside memory.  A single document is the next of itself.  An empty table gives no rows.  Other columns are
ignored, so they can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import MIX1, mix64, small_batches

WINDOW = 16
RUN = 16
VOTES = 3
FEW = 64
LEVELS = 1000
WEAK_BITS = 2.0
BITS, BITS_EACH, FULL = 2048, 5, 160
SIGMAS = 2.0

TILE = 1 << 20
#: Bytes of texts that are worked on together.
TOGETHER = 1 << 17
DOCS_A_RANGE = 500
MOST_RANGES = 10_000

_UNIT = 1 << 16
#: n log2 n in units of 1 / _UNIT, so that sums of it are exact.
_N_LOG_N = np.array([round(n * np.log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 1)], np.int32)
_TOP = int(_N_LOG_N[WINDOW])
_GAIN = np.diff(_N_LOG_N)
_STEP = _TOP // LEVELS
_STRIPE = 1 << 15
#: A key is a rank and, below it, a position: both fit 31 bits.
_PLACE = 21
_AT = np.int32((1 << _PLACE) - 1)


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of ``data`` (bytes, at least ``WINDOW``), from 0 to ``LEVELS``."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the WINDOW - 1 before and after each
    for start in range(0, n, _STRIPE):  # stripes stay in the processor's cache
        for k in range(1, WINDOW):
            lo, hi = max(start, k), min(start + _STRIPE, n)
            if lo < hi:
                same = (data[lo:hi] == data[lo - k : hi - k]).view(np.uint8)
                before[lo:hi] += same
                after[lo - k : hi - k] += same
    first = np.bincount(data[:WINDOW], minlength=256)
    sums = np.empty(n - WINDOW + 1, np.int32)
    sums[0] = _N_LOG_N[first].sum()
    sums[1:] = _GAIN[before[WINDOW:]]
    sums[1:] -= _GAIN[after[: n - WINDOW]]
    np.cumsum(sums, out=sums)
    return (_TOP - sums) // _STEP


def _tiles(texts: list[bytes]):
    """(data, place, windows): bytes of several texts or of one tile, and for each text or tile its place in ``texts`` and the number of its windows.
    Between two of them there are WINDOW - 1 windows that are in no text."""
    held, place, windows, size = [], [], [], 0
    for i, text in enumerate(texts):
        if text and len(text) < WINDOW:
            text = text + bytes(WINDOW - len(text))
        n = len(text) - WINDOW + 1
        for at in range(0, n, TILE):
            some = min(TILE, n - at)
            held.append(text[at : at + some + WINDOW - 1])
            place.append(i)
            windows.append(some)
            size += some
            if size >= TOGETHER:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(place), np.array(windows)
                held, place, windows, size = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(place), np.array(windows)


def _starts(windows: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(windows + WINDOW - 1)[:-1]])


def _inside(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places are among the ``counts`` successive ones from each of ``starts`` on."""
    edges = np.zeros(n + 1, np.int8)
    np.add.at(edges, np.minimum(starts, n), (counts > 0).astype(np.int8))
    np.add.at(edges, np.minimum(starts + counts, n), -(counts > 0).astype(np.int8))
    return np.cumsum(edges[:n], dtype=np.int8).view(bool)


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy."""
    out = np.zeros(LEVELS + 1, np.int64)
    for data, _, windows in _tiles(texts):
        found = levels(data)
        out += np.bincount(found[_inside(_starts(windows), windows, len(found))], minlength=LEVELS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy: the rarest first, of equals the lower; weak ones last."""
    level = np.arange(LEVELS + 1)
    weak = level < LEVELS * WEAK_BITS / np.log2(WINDOW)
    out = np.empty(LEVELS + 1, np.int32)
    out[np.lexsort((level, counts, weak))] = level
    return out


def features(data: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the features, and which of the texts each is in."""
    key = rank[levels(data)] << _PLACE
    key |= np.arange(len(key), dtype=np.int32)
    starts = _starts(windows)
    reach, least = 1, key  # the least key of the ``reach`` windows from each on
    while reach < RUN:
        step = min(reach, RUN - reach)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        reach += step
    runs = np.maximum(windows - RUN + 1, 0)
    inside = _inside(starts, runs, len(least))
    winner = np.where(inside, least & _AT, -1)
    begin = np.flatnonzero(np.diff(winner, prepend=np.int32(-1)))  # runs with one winner are successive
    votes = np.diff(begin, append=len(winner))
    chosen = np.zeros(len(key), bool)
    chosen[winner[begin[(votes >= VOTES) & inside[begin]]]] = True
    few = windows < FEW
    chosen[: len(key)][_inside(starts[few], windows[few], len(key))] = True
    position = np.flatnonzero(chosen)
    return position, np.searchsorted(starts, position, "right") - 1


def hashes(data: np.ndarray, position: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at ``position``."""
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[position]
    h = np.zeros(len(rows), np.uint64)
    for word in np.ascontiguousarray(rows).view("<u8").astype(np.uint64).T:
        h = mix64(h * np.uint64(MIX1) ^ word)
    return h


def filters(of: np.ndarray) -> np.ndarray:
    """The chained filters (n, BITS / 8) of a text's feature hashes, in order."""
    of = np.array(list(dict.fromkeys(of.tolist())), np.uint64)
    bits = np.zeros((-(-len(of) // FULL), BITS), bool)
    chain = np.arange(len(of)) // FULL
    for k in range(BITS_EACH):
        bits[chain, (of >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
    return np.packbits(bits, axis=1)


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of each text."""
    held: list = [[] for _ in texts]
    for data, place, windows in _tiles(texts):
        position, which = features(data, windows, rank)
        of = hashes(data, position)
        bounds = np.searchsorted(which, np.arange(len(windows) + 1))
        for i, a, b in zip(place.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            if b > a:
                held[i].append(of[a:b])
    return [filters(np.concatenate(h) if h else np.empty(0, np.uint64)) for h in held]


def _overlap(shared, n, k):
    """What filters with n and k bits share beyond chance; numbers or arrays."""
    chance = n * k / BITS
    chance = chance + SIGMAS * (chance * (1 - n / BITS) * (1 - k / BITS)) ** 0.5
    return shared - chance, (n + k - abs(n - k)) / 2 - chance


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    total = weight = 0.0
    if len(a) * len(b) <= 16:
        own, other = ([int.from_bytes(x.tobytes()) for x in y] for y in (a, b))
        for x in own:
            n, best = x.bit_count(), 0.0
            for y in other:
                beyond, most = _overlap((x & y).bit_count(), n, y.bit_count())
                if most > 0:
                    best = max(best, beyond / most)
            total += best * n
            weight += n
        return min(1.0, total / weight)
    other = np.unpackbits(b, axis=1).astype(np.float32)
    k = other.sum(axis=1).astype(np.float64)
    for start in range(0, len(a), 256):
        own = np.unpackbits(a[start : start + 256], axis=1).astype(np.float32)
        n = own.sum(axis=1).astype(np.float64)
        best = np.zeros(len(own))
        for at in range(0, len(other), 2048):
            beyond, most = _overlap(own @ other[at : at + 2048].T, n[:, None], k[at : at + 2048])
            best = np.maximum(best, np.where(most > 0, beyond / np.where(most > 0, most, 1), 0).max(axis=1))
        total += float((best * n).sum())
        weight += float(n.sum())
    return min(1.0, total / weight)


def _count(batches):
    out = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        out += histogram([t.as_py() for t in batch.column(0)])
    level = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(out[level])], ["level", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropies by all windows of all texts."""
    texts = small_batches(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = texts.mapInArrow(_count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()  # LEVELS + 1 rows at most
    counts = np.zeros(LEVELS + 1, np.int64)
    for level, n in found:
        counts[level] = n
    return ranks(counts)


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_stream(rank: np.ndarray):
    """For mapInArrow over (range, tail, doc_id, text), sorted: ``FIELDS`` of every row that isn't a tail."""
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]

    def answers(rows: list, first: np.ndarray | None, id_type: pa.DataType):
        """The answers for all rows but the last, and the filters of the last.  ``first`` are the filters of the first, if known."""
        texts = [text for *_, text in rows]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
        coded = [t.encode() for t in edited]
        some = texts if first is None else texts[1:]
        prints = fingerprints([t.encode() for t in some] + coded, rank)
        own, changed = prints[: len(some)], prints[len(some) :]
        if first is not None:
            own = [first, *own]
        out: list = [[] for _ in names]
        for i, (where, tail, doc_id, text) in enumerate(rows[:-1]):
            if tail or rows[i + 1][0] != where:
                continue
            sha = hashlib.sha256(coded[i]).hexdigest()
            values = doc_id, len(text), sha, own[i].tobytes().hex(), changed[i].tobytes().hex(), likeness(own[i], changed[i]), likeness(own[i], own[i + 1])
            for column, x in zip(out, values):
                column.append(x)
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names), own[-1]

    def run(batches):
        held: list = []
        size, first, id_type = 0, None, pa.int64()
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4))):
                held.append(tuple(x.as_py() for x in row))
                size += len(held[-1][3])
                if size >= TOGETHER and len(held) > 1:
                    found, first = answers(held, first, id_type)
                    yield found
                    held = held[-1:]
                    size = 0
        if len(held) > 1:
            yield answers(held, first, id_type)[0]

    return run


def range_starts(slim: DataFrame) -> list[int]:
    """The ids at which ranges begin, in order; the lowest id is the first.  [] if there are no ids."""
    ids = slim.select("doc_id").filter("doc_id IS NOT NULL")
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    k = min(MOST_RANGES, n // DOCS_A_RANGE)
    if k < 2:
        return [least] if n else []
    cuts = F.percentile_approx("doc_id", [i / k for i in range(1, k)], 3 * k)
    return sorted({least, *ids.agg(cuts).first()[0]})


def ranges(slim: DataFrame) -> DataFrame:
    """range, tail, doc_id, text: every row in its range, and as its tail the first row of the next range, or of all after the last."""
    starts = range_starts(slim)
    k = len(starts)
    missing = slim.filter("doc_id IS NULL")
    first_missing = [r for r in missing.agg(F.count("*").alias("n"), F.min("text").alias("text")).collect() if r["n"]]
    last = k + 1 if first_missing else k  # rows without an id are the last range
    begin = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<long>") if starts else F.array().cast("array<long>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, k.bit_length())))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(begin, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    own = F.when(F.col("doc_id").isNull(), F.lit(k + 1)).otherwise(place)
    placed = slim.withColumn("range", own)
    opens = F.get(begin, F.col("range") - 1) == F.col("doc_id")
    before = F.when(F.col("range") == 1, F.lit(last)).otherwise(F.col("range") - 1)
    one = lambda r, tail: F.struct(r.alias("range"), F.lit(tail).alias("tail"))
    where = F.when(opens, F.array(one(F.col("range"), 0), one(before, 1))).otherwise(F.array(one(F.col("range"), 0)))
    rows = placed.select(F.explode(where).alias("where"), "doc_id", "text").select("where.range", "where.tail", "doc_id", "text")
    if first_missing:  # the first of the last range, for the one before
        text = first_missing[0]["text"]
        more = slim.sparkSession.createDataFrame([(k or last, 1, None, text)], "range int, tail int, doc_id long, text string")
        rows = rows.unionByName(more)
    return rows


def compare(docs: DataFrame) -> DataFrame:
    """doc_id and ``FIELDS`` of every row of ``docs`` (doc_id, text)."""
    slim = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rank = rarity(slim)
    streams = ranges(slim).repartition("range").sortWithinPartitions("range", "tail", "doc_id", "text")
    return streams.mapInArrow(compare_stream(rank), f"doc_id long, {FIELDS}")
