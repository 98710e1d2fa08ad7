"""Near-duplicates by circulant MinHash, with exact verification.

A document's set holds its distinct shingles of five words (A to Z lower-cased; fewer words: the whole sequence).  All coordinates of the
signature come from two permutations of the 32-bit numbers: the first is applied once; the second, shifted circularly by ``k``, gives
coordinate ``k`` as the minimum over the set.  The signature is cut into ``BANDS`` bands of ``ROWS`` coordinates; documents that agree in
a band are candidates.  Candidates are confirmed on their full sets.  At the similarity of 0.85 that a link needs, all bands miss a
pair with a probability of 4e-7, and less above it.

Copies.  Documents with equal sets (128-bit hash) are one class.  Only one document of a class, its node, takes part in what follows.

Scale.  Links are sought in two rounds, so that no group is expanded into all its pairs.  In the first every node is compared with
one leader, the smallest node that shares a bucket with it; groups are split by a salt, each salt getting the leader's text.  Connected
components of these links are found by label propagation.  In the second round only buckets whose nodes are still in different
components are looked at: they are cut into parts of ``CHUNK`` shingles at most, each pair of parts is compared in one task, and only links
that join components leave it, so pairs never become rows.  Within a task, sets are compared in tiles of bounded size.  Components then hold every link among the candidates.  Nothing unbounded is gathered in one task or on the driver.

Edge cases.  Null texts and texts without a word have an empty set and are linked with nothing.  Rows with one id and text are one
class; each is returned.  A null id is never the smallest unless no other is there.  A very long text is one more row; its set is held at
once.  An empty table gives no rows.  ``deduplicate`` ignores other columns; ``clean`` keeps them and uses names that they don't have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import MIX1, WORD, WordHashes, materialize, mix64, small_batches, unused
from rategrid.operators.graph import components

SHINGLE = 5
BANDS, ROWS = 25, 5
PERCENT = 85
#: Members of a leader that one task compares, about.
GROUP = 2000
#: Shingles of a part of a bucket; parts meet in pairs, so a task holds two.
CHUNK = 400_000
#: Nodes whose keys may be broadcast: 24 bytes each.  More are joined by a shuffle.
BROADCAST_NODES = 100_000
#: Sets, and shingles, that are compared at a time.
TILE, COLUMNS = 1024, 4096

_hashes = WordHashes()
_STEP = 0x61C88647  # the circular shift between coordinates
_SHIFTS = (np.arange(BANDS * ROWS, dtype=np.uint64) * _STEP).astype(np.uint32)[:, None]


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the set of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = _hashes.of(words)
    n = min(len(h), SHINGLE)
    size = len(h) - n + 1
    x = np.full(size, n, np.uint64)
    for k in range(n):
        x = (x ^ h[k : k + size]) * np.uint64(MIX1)
        x ^= x >> np.uint64(29)
    return np.unique(mix64(x))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit words, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def bands(own: np.ndarray) -> list[int]:
    """A hash for each band of the signature of a set."""
    first = _permute((own & np.uint64(0xFFFFFFFF)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), 2048):
        shifted = first[None, at : at + 2048] + _SHIFTS
        np.minimum(least, _permute(shifted, 0x21F0AAAD, 0x735A2D97).min(1), out=least)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        x = mix64(x * np.uint64(MIX1) + column.astype(np.uint64))
    return x.view(np.int64).tolist()


def _measure(frames):
    for batch in frames:
        sizes, firsts, seconds, all_bands = [], [], [], []
        known: dict = {}
        for text in batch.column(3).to_pylist():
            own = shingles(text)
            a = int(own.sum(dtype=np.uint64).view(np.int64))
            b = int(mix64(own ^ np.uint64(MIX1)).sum(dtype=np.uint64).view(np.int64))
            found = known.get((a, b))
            if found is None:
                found = known[a, b] = bands(own) if len(own) else []
            sizes.append(len(own))
            firsts.append(a)
            seconds.append(b)
            all_bands.append(found)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(all_bands, pa.list_(pa.int64()))],
            ["row_id", "doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"],
        )


def measure(docs: DataFrame) -> DataFrame:
    """Set size, set hash and bands of every row, in the shared folder."""
    own = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "row_id long, doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"
    return materialize(small_batches(own).mapInArrow(_measure, schema), "sets")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union of two sets, as sorted arrays."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _against_leader(frames):
    """Rows (leader, salt, node, text) in that order, a leader's own row first in each salt -> links (a, b)."""
    key, own = None, None
    for batch in frames:
        found = []
        for leader, salt, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (leader, salt) != key:
                key, own = (leader, salt), None
            if node == leader:
                own = shingles(text)
            elif own is not None and _linked(own, shingles(text)):
                found.append((leader, node))
        yield _edges(found)


def _joining(rows: list) -> list[tuple[int, int]]:
    """Of (node, comp, chunk, set) rows, links that join components which are still apart; no more than there are rows.

    ``chunk`` differs for the two sides of a group that was cut; then only pairs across the sides are compared.  Sizes of intersections are
    products of 0/1 matrices, ``TILE`` sets by as many and ``COLUMNS`` shingles at a time, so memory doesn't grow with the number of pairs.
    """
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: (len(r[3]), r[0]))
    sizes = np.array([len(r[3]) for r in rows], np.float64)
    chunk = np.array([r[2] for r in rows])
    cut = len(set(chunk.tolist())) > 1
    label = np.unique([r[1] for r in rows], return_inverse=True)[1]
    _, column, counts = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes.astype(np.int64))
    several = counts[column] > 1  # the others are in no intersection
    owner, column = owner[several], np.unique(column[several], return_inverse=True)[1]
    width = int(column.max(initial=-1)) + 1
    tiles = []
    for start in range(0, len(rows), TILE):
        own = (owner >= start) & (owner < start + TILE)
        order = np.argsort(column[own], kind="stable")
        tiles.append((start, min(start + TILE, len(rows)), owner[own][order] - start, column[own][order]))

    def dense(tile, at):
        first, end, row, of = tile
        part = slice(*np.searchsorted(of, [at, at + COLUMNS]))
        out = np.zeros((end - first, COLUMNS), np.float32)
        out[row[part], of[part] - at] = 1
        return out

    found = []
    for k, left in enumerate(tiles):
        for right in tiles[k:]:
            (a, z), (c, e) = left[:2], right[:2]
            if 100 * sizes[z - 1] < PERCENT * sizes[c]:
                break  # sets come by size: from here on all are too large
            both = np.zeros((z - a, e - c), np.float32)
            for at in range(0, width, COLUMNS):
                x = dense(left, at)
                both += x @ (x if right is left else dense(right, at)).T
            similar = 100 * both.astype(np.float64) >= PERCENT * (sizes[a:z, None] + sizes[None, c:e] - both)
            if right is left:
                similar &= np.tri(z - a, dtype=bool).T & ~np.eye(z - a, dtype=bool)
            if cut:
                similar &= chunk[a:z, None] != chunk[None, c:e]
            for i in np.flatnonzero(similar.any(1)).tolist():
                while len(apart := np.flatnonzero(similar[i] & (label[c:e] != label[a + i]))):
                    j = c + int(apart[0])
                    found.append((rows[a + i][0], rows[j][0]))
                    label[label == label[j]] = label[a + i]
    return found


def _apart(frames):
    """Rows (group, x, y, node, comp, chunk, text), sorted by the first three -> links (a, b)."""
    key, rows = None, []
    for batch in frames:
        found = []
        for *own, node, comp, chunk, text in zip(*(c.to_pylist() for c in batch.columns)):
            if own != key:
                found += _joining(rows)
                key, rows = own, []
            if not rows or rows[-1][0] != node:
                rows.append((node, comp, chunk, shingles(text)))
        yield _edges(found)
    yield _edges(_joining(rows))


def _edges(found: list) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _with_text(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, doc_id, text_key and more) with the text of one row that has that id and text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").cast("string").alias("text"))
    return keyed.join(nodes, keyed["_id"].eqNullSafe(nodes["doc_id"]) & (F.col("_key") == F.col("text_key"))).drop("_id", "_key", "doc_id", "text_key")


def links(docs: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (set_a, set_b, node, cls_doc), and node, comp of the nodes that have a link."""
    classes = measured.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("cls_doc"))
    classes = materialize(classes, "classes")
    nodes = measured.join(classes.select(F.col("node").alias("row_id")), "row_id", "left_semi")
    nodes = nodes.select(F.col("row_id").alias("node"), "doc_id", "text_key", F.col("n_shingles").alias("n"), "bands")
    buckets = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    leaders = buckets.groupBy("band", "value").agg(F.min("node").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
    shared = materialize(buckets.join(leaders, ["band", "value"]), "buckets")

    # round 1: everything against one leader
    chosen = shared.filter("node <> leader").groupBy("node").agg(F.min("leader").alias("leader"))
    chosen = materialize(chosen, "chosen")
    sizes = chosen.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    slim = nodes.select("node", "doc_id", "text_key")
    members = slim.join(chosen.join(sizes, "leader"), "node").select(
        "node", "doc_id", "text_key", "leader", F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("salts")
    )
    heads = slim.join(sizes.withColumnRenamed("leader", "node"), "node").select(
        "node", "doc_id", "text_key", F.col("node").alias("leader"), F.sequence(F.lit(0), F.col("salts") - 1).alias("salts")
    )
    texts = _with_text(docs, members.union(heads)).select("leader", F.explode("salts").alias("salt"), "node", "text")
    # a repeated row brings the same node again, which does no harm
    ordered = texts.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "node")
    found = materialize(ordered.mapInArrow(_against_leader, "a long, b long"), "links")
    comps = components(found)

    # round 2: what shares a bucket and is still apart
    placed = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("band", "value").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"),
    )
    # buckets of several bands with the same nodes are one group
    mixed = mixed.filter("low <> high").groupBy("low", "high", "c", "x", "chunks").agg(F.min(F.struct("band", "value")).alias("b"))
    mixed = mixed.select("b.band", "b.value", "chunks", F.xxhash64("b.band", "b.value").alias("group"))
    apart = placed.join(mixed, ["band", "value"]).select("group", "node", "comp", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    apart = apart.select("group", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "node", "comp", "chunk")
    apart = materialize(apart, "apart")
    needed = materialize(apart.select("node").distinct().join(slim, "node"), "needed")
    if needed.isEmpty():
        return classes, comps
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    ordered = apart.join(_with_text(docs, needed), "node").select("group", "x", "y", "node", "comp", "chunk", "text")
    ordered = ordered.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "node")
    more = materialize(ordered.mapInArrow(_apart, "a long, b long"), "links")
    return classes, components(found.union(more))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text), with text_key (xxhash64 of the text) and group, a
    number of the row's component, null for an empty set."""
    measured = measure(docs)
    classes, comps = links(docs, measured)
    placed = classes.join(comps, "node", "left").withColumn("group", F.coalesce("comp", "node"))
    first = placed.groupBy("group").agg(F.min("cls_doc").alias("component"))
    placed = placed.join(first, "group").select("set_a", "set_b", "component", "group")
    own = measured.select("doc_id", "text_key", "n_shingles", "set_a", "set_b")
    linked = own.filter("n_shingles > 0").join(placed, ["set_a", "set_b"])
    alone = own.filter("n_shingles = 0").withColumn("component", F.col("doc_id")).withColumn("group", F.lit(None).cast("long"))
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"), "text_key", "group"
    )


def clean(docs: DataFrame) -> DataFrame:
    """One row of each component, with its smallest id, and every row with an empty set.

    The kept document of a component is found again by its id and text; of rows that repeat both one stays.
    """
    i, k, g = unused(docs.columns, "id_", "key_", "group_")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key")))  # nulls last
    kept = deduplicate(docs).groupBy("group").agg(first.alias("m"))
    kept = kept.filter("group is not null").select(F.col("m.doc_id").alias(i), F.col("m.text_key").alias(k), F.col("group").alias(g))
    joined = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k))).dropDuplicates([g])
    empty = docs.filter(F.coalesce(~F.col("text").rlike(WORD), F.lit(True)))
    return joined.select(*[docs[c] for c in docs.columns]).unionAll(empty)
