"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised: lower-cased, every run of characters that are neither letters nor digits becomes one space.  An item of ``n``
characters may differ from a region of a text by ``e = floor(RATE * n)`` edits.  A region within that budget shares at least
``n + 1 - q (e + 1)`` q-grams with the item, and they lie within ``e`` diagonals of each other.  ``q`` is ``n div (e + 1)``, at most ``Q``, so the
bound is positive for every item, whatever its length; items that share a ``q`` share an index.  Diagonals (position in the text less
position in the item) are cut into bands of width ``w >= e``; two neighbouring bands together hold any such region, so regions are
kept where two neighbours hold at least that many shared q-grams.  What is kept is verified by banded alignment of the
whole item, whose ends in the text are free.  Items whose budget is 0 (under ``1 / RATE`` characters) must stand as whole words.

Scale.  Texts are never shuffled.  The benchmark is read in blocks of about ``BLOCK_CHARS`` characters, a stated bound on what the driver and
each task hold of it at a time; each block meets all texts in one pass, and where there are several, each pass is written before the
next is read.  Shared q-grams are expanded for at most ``HITS`` at once: a range of items with more is halved, and a single item with
more is searched in overlapping stretches of text, so no phrase that many items or texts share needs more memory.

Edge cases.  Null and empty texts, and items without a letter or digit, match nothing.  Rows that repeat are each matched.  Items that
share a text are each reported.  Of equally good regions the first is reported.  Very long texts are searched whole.  Empty tables give no
rows.  ``matches`` ignores other columns; ``clean`` judges row by row, adds no column and keeps those it finds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import MIX1, materialize, small_batches

Q = 8
RATE = 0.1
BLOCK_CHARS = 8_000_000
#: Bits of the table that tells which q-grams cannot be in the benchmark.
BITS = 22
#: Characters of text that are looked up together.
CHUNK = 1 << 21
#: Cells of the text windows that are aligned with an item at a time.
CELLS = 1 << 20
#: Shared q-grams that are expanded at a time.
HITS = 1 << 21

OUT = "doc_id long, item_id long, start long, end long, edits int, item_chars int"

_kinds = None


def _codes() -> np.ndarray:
    """For every code point its lower-cased letter or digit, or 32."""
    global _kinds
    if _kinds is None:
        codes = np.full(0x110000, 32, np.uint32)
        for i in range(0x30000):
            c = chr(i)
            if c.isalnum():
                low = c.lower()
                codes[i] = ord(low) if len(low) == 1 else i
        _kinds = codes
    return _kinds


def normalise(text: str | None) -> np.ndarray:
    """Code points of the normalised text, without a space at its ends."""
    codes = _codes()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    keep = ~space
    if len(codes):
        keep[1:] |= ~space[:-1]
    codes = codes[keep]
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def _rolling(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q symbols from each position on."""
    n = len(x) - q + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        wide = x.astype(np.uint64)
        for k in range(q):
            h = h * np.uint64(MIX1) + wide[k : k + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(MIX1)
    return h


def align(item: np.ndarray, texts: list[np.ndarray], lows: list[int], width: int, budget: int) -> list[tuple[int, int, int] | None]:
    """For each text the least edits between the whole item and a region of it whose alignment stays on the ``width`` diagonals from its
    ``low`` on (text less item position), with the region's start and end; None above the budget.  Of equal ones the first end counts."""
    n, far, steps = len(item), budget + 1, np.arange(width)
    low = np.array(lows)[:, None]
    sizes = np.array([len(t) for t in texts])[:, None]
    seen = np.full((len(texts), n + width), -1, np.int64)  # column j holds text position low + j
    for row, t, at in zip(seen, texts, lows):
        a, z = max(0, at), min(len(t), at + n + width)
        if z > a:
            row[a - at : z - at] = t[a:z]
    at = low + steps  # text position before row 0
    cost, begin = np.where((at >= 0) & (at <= sizes), 0, far), at
    live = np.arange(len(texts))
    drop, moved = np.full(cost.shape, far), np.zeros(cost.shape, np.int64)
    for i, c in enumerate(item):
        here = seen[live, i : i + width] if len(live) < len(seen) else seen[:, i : i + width]
        take = cost + (here != c) + far * (here < 0)  # replace or match
        drop[:, :-1] = cost[:, 1:] + 1  # a symbol of the item is missing in the text
        moved[:, :-1] = begin[:, 1:]
        start = np.where(drop < take, moved, begin)
        # extra symbols in the text: along the row, one each
        run = np.minimum(take, drop) - steps
        least = np.minimum.accumulate(run, 1)
        source = np.maximum.accumulate(np.where(run == least, steps, 0), 1)
        cost = np.minimum(least + steps, far)
        begin = np.take_along_axis(start, source, 1)
        within = cost.min(1) <= budget
        if not within.all():
            cost, begin, live, drop, moved = cost[within], begin[within], live[within], drop[within], moved[within]
            if not len(live):
                break
    out: list = [None] * len(texts)
    ends = low[live] + steps + n
    cost = np.where((ends >= 0) & (ends <= sizes[live]), cost, far)
    for row, k in enumerate(live.tolist()):
        j = int(cost[row].argmin())
        if cost[row, j] <= budget:
            out[k] = (int(cost[row, j]), int(begin[row, j]), int(ends[row, j]))
    return out


class Grams:
    """Items that have one ``q``: their q-grams, and the regions of texts that share enough of them."""

    def __init__(self, q: int, items: list[np.ndarray], budgets: list[int]):
        self.q, self.items = q, items
        self.budget = np.array(budgets, np.int64)
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.least = self.sizes + 1 - q * (self.budget + 1)
        self.width = np.maximum(self.budget, 1)
        hashes = [_rolling(x, q) for x in items]
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")  # of one q-gram, postings come by item
        self.keys, key_of = np.unique(h[order], return_inverse=True)
        self.owner, self.place = owner[order], place[order]
        self.combined = key_of * len(items) + self.owner
        self.may = np.zeros(1 << BITS, bool)
        self.may[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def search(self, texts: list[np.ndarray]):
        """(text, item, start, end, edits) of regions within the budget; the best of each pair is among them."""
        sizes = np.array([len(x) for x in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        h = _rolling(np.concatenate(texts), self.q)
        at = np.flatnonzero(self.may[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        real = self.keys[found] == h[at]
        at, found = at[real], found[real]
        t = np.searchsorted(begins, at, "right") - 1
        within = at + self.q <= begins[t] + sizes[t]  # no q-gram crosses the end of a text
        self.texts, self.bands = texts, int(sizes.max(initial=0) + self.sizes.max() + 2)
        at, t, found = at[within], t[within], found[within]
        yield from self._among(at - begins[t], t, found, 0, len(self.items))

    def _among(self, at, t, found, low: int, high: int):
        """Regions of the items from ``low`` to ``high`` that share the q-grams ``found`` at positions ``at`` of texts ``t``."""
        first = np.searchsorted(self.combined, found * len(self.items) + low)
        counts = np.searchsorted(self.combined, found * len(self.items) + high) - first
        some = counts > 0
        at, t, found, first, counts = at[some], t[some], found[some], first[some], counts[some]
        total = int(counts.sum())
        if total <= HITS:
            if total:
                yield from self._regions(at, t, first, counts)
        elif high - low > 1:
            middle = (low + high) // 2
            yield from self._among(at, t, found, low, middle)
            yield from self._among(at, t, found, middle, high)
        else:  # one item: stretches of text that overlap by more than a region
            reach = int(self.sizes[low] + 2 * self.width[low] + self.q)
            for own in np.unique(t).tolist():
                of = slice(*np.searchsorted(t, [own, own + 1]))
                step = max(HITS // int(counts[of].max()), reach)
                for start in range(int(at[of][0]), int(at[of][-1]) + 1, step):
                    part = slice(*(np.searchsorted(at[of], [start, start + step + reach]) + of.start))
                    if part.stop > part.start:
                        yield from self._regions(at[part], t[part], first[part], counts[part])

    def _regions(self, at, t, first, counts):
        where = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        item, text = self.owner[where], np.repeat(t, counts)
        diagonal = np.repeat(at, counts) - self.place[where]
        key = (item * len(self.texts) + text) * self.bands + (diagonal + self.sizes[item]) // self.width[item]
        order = np.argsort(key, kind="stable")
        keys, first, counts = np.unique(key[order], return_index=True, return_counts=True)
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        pair = counts + np.where(follows, np.append(counts[1:], 0), 0)
        good = np.flatnonzero(pair >= self.least[item[order[first]]])
        waiting: dict = {}
        # good pairs that overlap are one region
        for run in np.split(good, np.flatnonzero(np.diff(keys[good]) != 1) + 1) if len(good) else []:
            last = run[-1] + 1 if follows[run[-1]] else run[-1]
            members = order[first[run[0]] : first[last] + counts[last]]
            i, k = int(item[members[0]]), int(text[members[0]])
            ds, votes = np.unique(diagonal[members], return_counts=True)
            at = self._literal(i, self.texts[k], ds, votes)
            if at is not None:
                yield k, i, at, at + len(self.items[i]), 0
            elif self.budget[i]:
                low, width = int(ds[0] - self.budget[i]), int(ds[-1] - ds[0] + 2 * self.budget[i] + 1)
                waiting.setdefault((i, width), []).append((k, low))
        for (i, width), places in waiting.items():
            step = max(1, CELLS // (len(self.items[i]) + width))
            for own in (places[a : a + step] for a in range(0, len(places), step)):
                found = align(self.items[i], [self.texts[k] for k, _ in own], [low for _, low in own], width, int(self.budget[i]))
                yield from ((k, i, one[1], one[2], one[0]) for (k, _), one in zip(own, found) if one is not None)

    def _literal(self, i: int, text: np.ndarray, ds: np.ndarray, votes: np.ndarray) -> int | None:
        """Where on the diagonals ``ds`` the item stands as it is; without a budget, as whole words."""
        item, exact = self.items[i], not self.budget[i]
        n = len(item)
        for d in (ds[votes >= n + 1 - self.q] if exact else ds[[votes.argmax()]]).tolist():
            if 0 <= d <= len(text) - n and np.array_equal(text[d : d + n], item):
                if not exact or (d == 0 or text[d - 1] == 32) and (d + n == len(text) or text[d + n] == 32):
                    return d
        return None


class Index:
    """A block of items, by the length of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.sizes = [], []
        by_q: dict = {}
        for i, text in items:
            x = normalise(text)
            if len(x):
                budget = int(rate * len(x))
                of = by_q.setdefault(min(Q, len(x) // (budget + 1)), ([], [], []))
                for held, value in zip(of, (len(self.ids), x, budget)):
                    held.append(value)
                self.ids.append(i)
                self.sizes.append(len(x))
        self.parts = [(np.array(places), Grams(q, xs, budgets)) for q, (places, xs, budgets) in sorted(by_q.items())]

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits): the best region of each pair that has one; positions in the normalised text."""
        best: dict = {}
        for places, grams in self.parts:
            for t, i, start, end, edits in grams.search(texts):
                pair = (t, int(places[i]))
                if pair not in best or (edits, start) < best[pair][:2]:
                    best[pair] = (edits, start, end)
        return [(t, i, s, z, e) for (t, i), (e, s, z) in sorted(best.items())]

    def search_all(self, texts: list):
        """The same of raw texts, CHUNK characters at a time."""
        held, owners, size = [], [], 0

        def flush():
            return [(owners[t], *rest) for t, *rest in self.search(held)]

        for k, text in enumerate(texts):
            x = normalise(text)
            if len(x):
                held.append(x)
                owners.append(k)
                size += len(x)
            if size > CHUNK:
                yield from flush()
                held, owners, size = [], [], 0
        if held:
            yield from flush()


_built: dict = {}


def _index(items: list, rate: float) -> Index:
    key = (hash(tuple(items)), rate)
    if key not in _built:
        _built.clear()
        _built[key] = Index(items, rate)
    return _built[key]


def _blocks(benchmark: DataFrame):
    """The items in blocks of about BLOCK_CHARS characters, as broadcast variables, one after another."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(size // BLOCK_CHARS) + 1
    for block in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield context.broadcast([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]), n > 1


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (in the normalised text), edits, item_chars: for each row of ``docs`` (doc_id, text) and item within the
    budget, the best region."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(shared, several: bool):
        def run(frames):
            index = _index(shared.value, rate)
            for batch in frames:
                ids = batch.column(0).to_pylist()
                found = [(ids[k], index.ids[i], s, z, e, index.sizes[i]) for k, i, s, z, e in index.search_all(batch.column(1).to_pylist())]
                columns = list(zip(*found)) or [()] * 6
                kinds = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "start", "end", "edits", "item_chars"])

        out = small_batches(own).mapInArrow(run, OUT)
        if several:
            out = materialize(out, "matches")
            shared.destroy()
        return out

    return reduce(DataFrame.unionAll, [one(*block) for block in _blocks(benchmark)])


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    at = docs.columns.index("text")

    def one(rows: DataFrame, shared):
        def run(frames):
            index = _index(shared.value, rate)
            for batch in frames:
                keep = np.ones(batch.num_rows, bool)
                keep[[k for k, *_ in index.search_all(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        return small_batches(rows).mapInArrow(run, docs.schema)

    for shared, several in _blocks(benchmark):
        docs = one(docs, shared)
        if several:
            docs = materialize(docs, "clean")
            shared.destroy()
    return docs
