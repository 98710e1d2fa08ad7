"""Language-model scoring by a weighted backoff automaton over all n-grams of the training texts.

Words are lower-cased (A to Z); every text ends with one end token.  A word's probability is ``(c + 0.1) / (N + 0.1 (V + 1))``.  N-grams of two
and three words are smoothed by Dirichlet priors of weight ``PRIOR``: ``p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR)``, where ``h'``
is ``h`` without its first word.  In a training text a context that isn't the end is always followed by a token, so every context's
probabilities sum to 1.

States are the contexts that occur in training.  A seen n-gram is an arc with the probability above.  The failure arc of a state leads
to the context without its first word with the weight ``PRIOR / (c(h) + PRIOR)``, which is what the formula gives an unseen n-gram.  One traversal
from left to right carries the state, takes an arc or failure arcs for each token, and adds up log-probabilities.  A block of texts is traversed
over the states and arcs that its n-grams reach.  Every n-gram that occurs once is in the model; there is no cutoff.

Scale.  Neither word nor n-gram counts are collected or broadcast.  Texts are packed into rows of about ``BLOCK_BYTES`` (a longer text is
a row of its own).  A block sends its distinct words and n-grams, sorted by their hashes, to shards of the hash space as one compressed
row each; a shard adds them up and sends back counts in the order it was asked.  The number of shards follows the size of the corpus
(``SHARD_BYTES`` of text each), so neither side of the exchange grows with it.  A word or n-gram, however frequent, comes once from a block
and goes to a shard by its hash, so there are no hot keys.

Hashes.  Words have 64 bits; among 10 million of them two collide with a probability of 3e-6.  N-grams are stored with 56 bits: with 1e9
distinct ones, one in 70 million takes the count of another as well.

Edge cases.  Null and empty texts have the end as their only token.  A null id is in no fold: it isn't held out, nor learned from.
Repeated rows count each and are scored each.  With no training rows N and V are 0, and with neither words nor counts the scores of
all tokens are 0.  An empty table gives no rows.  Other columns are ignored, so they can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import MIX1, fold, materialize, mix64, small_batches

FOLDS, HELD_OUT = 10, 0
PRIOR = 1.0
ADD = 0.1
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
#: Bits of an n-gram's stored hash.
BITS = 56

_END = b"\n"  # no word has white space


class Hashes(dict):
    """64-bit hashes of words, remembered for up to ``KEEP`` of them."""

    KEEP = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEEP:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = Hashes()


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's tokens, the end included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(_END)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def join_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram from that of its context and its last word."""
    return mix64(context * np.uint64(MIX1) ^ word)


class Grams:
    """Tokens of a list of texts and, sorted, the distinct hashes of their words and of their n-grams."""

    def __init__(self, texts: list):
        held = [tokens(t) for t in texts]
        self.sizes = np.array([len(h) for h in held], np.int64)
        h = np.concatenate(held)
        self.doc = np.repeat(np.arange(len(held), dtype=np.int32), self.sizes)
        del held
        pairs = join_keys(h[:-1], h[1:])
        triples = join_keys(pairs[:-1], h[2:])
        #: Places of the last tokens of pairs and triples that lie within one text.
        self.pair_at = np.flatnonzero(self.doc[:-1] == self.doc[1:]) + 1
        self.triple_at = np.flatnonzero(self.doc[:-2] == self.doc[2:]) + 2
        grams = np.concatenate([pairs[self.pair_at - 1], triples[self.triple_at - 2]]) >> np.uint64(64 - BITS)
        self.keys, self.place = [None, None], [None, None]
        del pairs, triples
        for kind, x in enumerate((h, grams)):
            self.keys[kind], self.place[kind] = np.unique(x, return_inverse=True)

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """How often each distinct word and n-gram occurs in the texts of weight 1."""
        of = weight[self.doc]
        ends = np.concatenate([self.pair_at, self.triple_at])
        return [np.bincount(p, w, len(k)).astype(np.uint64) for p, w, k in zip(self.place, (of, of[ends]), self.keys)]

    def base(self, count: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """n_known and base score of each text, from the training counts of its words."""
        c = count[self.place[0]].astype(np.float64)
        of = lambda x: np.bincount(self.doc, x, len(self.sizes))
        return of(c > 0).astype(np.int64), of(np.log10((c + ADD) / (total + ADD * (distinct + 1))))


class Automaton:
    """The part of the model that a block's texts can reach.

    States are numbered: 0 is the empty context, then come the block's words and pairs that occur in training.  An arc has the number of its
    n-gram among the block's words, and after them n-grams; ``next`` and ``weight`` are its end and logarithm.  ``arcs`` has for each level of a state (0
    to 2 words) the arc that each token would take from it, or -1 where the n-gram does not occur in training.  ``fail`` and ``lost`` are the end and
    logarithm of each state's failure arc, to the context without its first word.
    """

    def __init__(self, grams: Grams, count: list[np.ndarray], total: int, distinct: int):
        word, gram = grams.place
        c, g = (x.astype(np.float64) for x in count)
        n_words, n_pairs = len(c), len(grams.pair_at)
        known = c > 0
        state = np.where(known, np.cumsum(known), 0).astype(np.int32)  # of each word
        first_pair = int(known.sum()) + 1
        # where each n-gram stands, and whether it has two words
        stands = np.zeros(len(g), np.int64)
        stands[gram] = np.arange(len(gram))
        is_pair = stands < n_pairs
        at = np.concatenate([grams.pair_at, grams.triple_at])[stands]
        pair_of = np.full(len(word), -1, np.int32)
        pair_of[grams.pair_at] = gram[:n_pairs]
        pairs, triples = np.flatnonzero(is_pair & (g > 0)), np.flatnonzero(~is_pair & (g > 0))
        pair_state = np.zeros(len(g), np.int32)
        pair_state[pairs] = first_pair + np.arange(len(pairs))
        self.level = np.zeros(first_pair + len(pairs), np.int8)
        self.level[1:first_pair], self.level[first_pair:] = 1, 2

        p1 = (c + ADD) / (total + ADD * (distinct + 1))
        u, v = word[at[pairs] - 1], word[at[pairs]]
        p2 = np.zeros(len(g))
        p2[pairs] = (g[pairs] + PRIOR * p1[v]) / (c[u] + PRIOR)
        before, after = pair_of[at[triples] - 1], pair_of[at[triples]]
        self.next = np.zeros(n_words + len(g), np.int32)
        self.next[:n_words], self.next[n_words + pairs], self.next[n_words + triples] = state, pair_state[pairs], pair_state[after]
        chance = np.ones(len(self.next))
        chance[:n_words], chance[n_words + pairs], chance[n_words + triples] = p1, p2[pairs], (g[triples] + PRIOR * p2[after]) / (g[before] + PRIOR)
        self.weight = np.log10(chance)
        self.fail = np.zeros(len(self.level), np.int32)
        self.fail[first_pair:] = state[v]
        held = np.concatenate([[0.0], c[known], g[pairs]])
        self.lost = np.log10(PRIOR / (held + PRIOR))
        arc = np.where(g > 0, n_words + np.arange(len(g)), -1).astype(np.int32)
        self.arcs = [word.astype(np.int32), *(np.full(len(word), -1, np.int32) for _ in range(2))]
        self.arcs[1][grams.pair_at] = arc[gram[:n_pairs]]
        self.arcs[2][grams.triple_at] = arc[gram[n_pairs:]]
        #: A token at which each state ends, for tests.
        self.ends = np.concatenate([[-1], np.zeros(first_pair - 1, np.int64), at[pairs]])
        self.ends[state[word[known[word]]]] = np.flatnonzero(known[word])

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        """The log-probability of each text: one traversal from left to right, which carries the state."""
        arcs, level = [memoryview(a) for a in self.arcs], memoryview(self.level)
        fail, lost, ends, weight = memoryview(self.fail), memoryview(self.lost), memoryview(self.next), memoryview(self.weight)
        out, t = [], 0
        for size in sizes.tolist():
            state, total = 0, 0.0
            for t in range(t, t + size):  # noqa: B020
                arc = arcs[level[state]][t]
                while arc < 0:
                    total += lost[state]
                    state = fail[state]
                    arc = arcs[level[state]][t]
                total += weight[arc]
                state = ends[arc]
            t += size > 0
            out.append(total)
        return np.array(out)


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of 64-bit numbers, byte by byte place: high bytes are mostly 0."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


ROWS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("train", pa.bool_()), ("text", pa.large_string())])


def _pack_blocks(frames, block_bytes: int):
    """Rows of ROWS -> block, rows: as many rows as make up ``block_bytes`` of text."""
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    held, size = [], 0

    def packed():
        table = pa.Table.from_batches(held).cast(ROWS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    for batch in frames:
        lengths = np.cumsum(np.array([x or 0 for x in pc.binary_length(batch.column(3)).to_pylist()], np.int64)) + size
        at = 0
        while at < batch.num_rows:
            # up to the row with which the block is full
            end = min(int(np.searchsorted(lengths, block_bytes)) + 1, batch.num_rows)
            held.append(batch.slice(at, end - at))
            size = int(lengths[end - 1])
            if size >= block_bytes:
                yield packed()
                held, block = [], block + 1
                lengths, size = lengths - size, 0
            at = end
    if held:
        yield packed()


def _unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


REQUEST = "shard long, kind int, block long, keys binary, counts binary"
REPLY = "block long, kind int, shard long, counts binary, total long, present long"


def _ask(bits: int):
    """Rows (block, rows) -> the distinct keys of the block, by kind (0: words, 1: n-grams) and shard, with their training counts."""

    def run(frames):
        for batch in frames:
            for block, rows in zip(*(c.to_pylist() for c in batch.columns)):
                table = _unpacked(rows)
                grams = Grams(table.column("text").to_pylist())
                train = table.column("train").to_numpy().astype(np.float64)
                out: list = []
                for kind, (keys, counts) in enumerate(zip(grams.keys, grams.counts(train))):
                    top = (keys >> np.uint64((64, BITS)[kind] - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    shards, first = np.unique(top, return_index=True)
                    for shard, a, z in zip(shards.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
                        out.append((shard, kind, block, pack_sorted(keys[a:z]), pack(counts[a:z])))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in REQUEST.split(", ")])

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """The requests of all blocks to a shard -> for each block the training counts of its keys in all blocks."""
    keys = [unpack_sorted(b) for b in asked.column("keys").to_pylist()]
    counts = [unpack(b) for b in asked.column("counts").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    sums = np.bincount(place, np.concatenate(counts).astype(np.float64), len(every)).astype(np.uint64)
    replies = [pack(x) for x in np.split(sums[place], ends[:-1])]
    once = np.arange(len(replies)) == 0  # totals stand in one reply
    columns = [
        asked.column("block"), asked.column("kind"), asked.column("shard"), pa.array(replies, pa.binary()),
        pa.array(once * int(sums.sum())), pa.array(once * int((sums > 0).sum())),
    ]
    return pa.table(columns, names=[x.split()[0] for x in REPLY.split(", ")])


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(total: int, distinct: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for rows in blocks.column("rows").to_pylist():
            table = _unpacked(rows)
            grams = Grams(table.column("text").to_pylist())
            by_kind: tuple = ([], [])
            for kind, shard, counts in zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "counts"))):
                by_kind[kind].append((shard, counts))
            counts = [np.concatenate([unpack(b) for _, b in sorted(x)] or [np.zeros(0, np.uint64)]) for x in by_kind]
            known, base = grams.base(counts[0], total, distinct)
            score = Automaton(grams, counts, total, distinct).scores(grams.sizes)
            out.append(pa.table(
                [table.column("doc_id"), table.column("held_out"), pa.array(grams.sizes), pa.array(known), pa.array(np.full(len(known), total)), pa.array(base), pa.array(score)],
                names=[x.split()[0] for x in OUT.split(", ")],
            ))
        return pa.concat_tables(out)

    return run


def evaluate(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    of_fold = fold(F.col("doc_id"), FOLDS)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(of_fold == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(of_fold != HELD_OUT, F.lit(False)).alias("train"),
        F.col("text").cast("string").alias("text"),
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // shard_bytes).bit_length())
    blocks = materialize(small_batches(rows).mapInArrow(lambda frames: _pack_blocks(frames, block_bytes), "block long, rows binary"), "texts", compression="uncompressed")
    asked = blocks.mapInArrow(_ask(bits), REQUEST)
    replies = materialize(asked.groupBy("shard", "kind").applyInArrow(_answer, REPLY), "counts", compression="uncompressed")
    total, distinct = replies.filter("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("present"), F.lit(0))).first()
    return blocks.groupBy("block").cogroup(replies.drop("total", "present").groupBy("block")).applyInArrow(_scored(total, distinct), OUT)
