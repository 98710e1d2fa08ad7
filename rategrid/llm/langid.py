"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text.  A text is parsed from left to right into
phrases: each is the longest string, from where the last one ended, that occurs in the language's sample (or one symbol, if even
that doesn't occur).  The language that needs the fewest phrases, normalised by the number of symbols, wins.

Symbols are letters, lower-cased; every run of other characters is one space.  Texts are cut into blocks of ``BLOCK`` symbols, so that many
blocks advance in step through numpy arrays.  A block starts in the state in which the block before it ends: that state is first guessed
from its last ``WARM`` symbols, and blocks whose guess was wrong are parsed again until none is, so counts are those of the whole text.

The score is ``1 - p / q`` with ``p`` the fewest and ``q`` the second fewest phrases (1 if only one language was learned).

Learning.  Every labelled text is cut into passages of ``PASSAGE`` characters, and a language's sample are its passages with the lowest
hashes of id and place, up to ``sample_symbols`` characters.  Every language in the labels is learned.  A worker builds the automata
once, a few megabytes a language whatever its alphabet: the rows of its states are laid over each other.

Scale.  Texts are scored where they are read, whole, without a shuffle; a very long text takes memory for itself only.

Edge cases.  A null text and one without a letter give ``und`` with score 0, as does every text when nothing was learned, and an empty
table gives no rows.  A null id belongs to no fold: it is neither learned from nor held out.  Ties go to the language first in order.
Repeated rows are scored each.  ``identify`` replaces columns named lang_pred and score; ``judge`` ignores other columns; ``clean`` keeps all
columns and adds none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from rategrid.llm.common import fold, small_batches, with_columns

SAMPLE_SYMBOLS = 40_000
PASSAGE = 1000
BLOCK, WARM = 1024, 48
FOLDS, HELD_OUT = 4, 2
#: Least score at which ``clean`` believes the prediction more than the given language.
MIN_SCORE = 0.05
#: Blocks that advance together.
WIDTH = 4096
#: Offsets tried for a row of arcs before the slots up to the one found are left as they are.
TRIES = 64

_codes = None
_built: dict = {}


def letter_codes() -> np.ndarray:
    """For every code point the lower-case letter's code point, or 32 if it is no letter."""
    global _codes
    if _codes is None:
        codes = np.full(0x110000, 32, np.uint32)
        for i in range(0x30000):  # planes 0 to 2 hold all letters
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                codes[i] = ord(low) if len(low) == 1 else i
        _codes = codes
    return _codes


def symbols(text: str) -> np.ndarray:
    """The code points of a text's symbols: lower-case letters, and one space for each run of anything else."""
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(codes):
        return codes
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[0] |= True
    return codes[keep]


def automaton(sample: np.ndarray) -> list[dict]:
    """The transitions of the suffix automaton of a string: a dict for each state, state 0 first."""
    link, length, to = [-1], [0], [{}]
    last = 0
    for c in sample.tolist():
        state = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = state
            p = link[p]
        if p != -1:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return to


class Arcs:
    """The arcs of one language's automaton, rows laid over each other: a state is the offset of its row, no two states have the same one,
    and the slot ``state + symbol`` holds the next state where ``owner`` says that it belongs to the state.  The first state is 0."""

    def __init__(self, states: list[dict], width: int):
        taken, offsets, number = bytearray(4 * (sum(map(len, states)) + width)), set(), [0] * len(states)
        low = 0
        for i in sorted(range(len(states)), key=lambda i: (i > 0, -len(states[i]))):  # the first state, then wide rows before narrow ones
            symbols_of = sorted(states[i]) or [0]
            at = first = 0 if i == 0 else max(0, low - symbols_of[0])
            while at in offsets or any(taken[at + c] for c in symbols_of):
                at += 1
                if at + width >= len(taken):
                    taken += bytearray(len(taken))
            number[i] = at
            offsets.add(at)
            for c in states[i]:
                taken[at + c] = 1
            if at - first > TRIES:  # free slots that no row fits must not be tried again for every row
                low = max(low, at + symbols_of[0])
            while taken[low]:
                low += 1
        size = max(number) + width + 1
        self.owner, self.target = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.root = np.zeros(width, np.int64)  # where a phrase starts with a symbol
        for i, to in enumerate(states):
            for c, s in to.items():
                self.owner[number[i] + c], self.target[number[i] + c] = number[i], number[s]
        for c, s in states[0].items():
            self.root[c] = number[s]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        slot = state + symbol
        there = self.owner[slot] == state
        return np.where(there, self.target[slot], self.root[symbol]), ~there | (state == 0)

    def run(self, blocks: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each block, and the state at its end, from the given states."""
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((int(sizes.max()), len(blocks)), np.int64)  # a row for each step
        for k, i in enumerate(order.tolist()):
            grid[: len(blocks[i]), k] = blocks[i]
        live = np.searchsorted(-sizes[order], -np.arange(1, len(grid) + 1), side="right")  # blocks that reach a step
        state, count = start[order], np.zeros(len(blocks), np.int64)
        for row, n in zip(grid, live.tolist()):
            state[:n], begun = self.step(state[:n], row[:n])
            count[:n] += begun
        out_count, out_state = np.empty_like(count), np.empty_like(state)
        out_count[order], out_state[order] = count, state
        return out_count, out_state


class Parser:
    """Phrase counts of many texts against the samples of all languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = [name for name, _ in samples]
        parts = [symbols(text) for _, text in samples]
        alphabet = np.unique(np.concatenate(parts)) if parts else np.array([], np.uint32)
        #: Symbol numbers: 0 occurs in no sample.
        self.number = np.zeros(0x110000, np.int32)
        self.number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.arcs = [Arcs(automaton(self.number[part]), len(alphabet) + 1) for part in parts]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) phrase counts, and whether a text has a letter."""
        out = np.zeros((len(texts), len(self.arcs)), np.int64)
        letters = np.zeros(len(texts), bool)
        blocks, owners = [], []
        for i, text in enumerate(texts):
            codes = symbols(text or "")
            letters[i] = bool((codes != 32).any())
            if letters[i]:
                numbers = self.number[codes]
                blocks += [numbers[at : at + BLOCK] for at in range(0, len(numbers), BLOCK)]
                owners += [i] * (len(blocks) - len(owners))
            if len(blocks) >= WIDTH:
                self._add(blocks, owners, out)
                blocks, owners = [], []
        if blocks:
            self._add(blocks, owners, out)
        return out, letters

    def _add(self, blocks: list[np.ndarray], owners: list[int], out: np.ndarray) -> None:
        owner = np.array(owners)
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # blocks that go on with the text of the block before
        for k, arcs in enumerate(self.arcs):
            start = np.zeros(len(blocks), np.int64)
            if len(later):
                start[later] = arcs.run([blocks[i - 1][-WARM:] for i in later], np.zeros(len(later), np.int64))[1]
            count, end = arcs.run(blocks, start)
            wrong = later[end[later - 1] != start[later]]
            while len(wrong):
                start[wrong] = end[wrong - 1]
                count[wrong], end[wrong] = arcs.run([blocks[i] for i in wrong], start[wrong])
                wrong = later[end[later - 1] != start[later]]
            np.add.at(out[:, k], owner, count)


def parser_of(samples: list[tuple[str, str]]) -> Parser:
    key = hash(tuple(samples))
    if key not in _built:
        _built.clear()
        _built[key] = Parser(samples)
    return _built[key]


def decide(counts: np.ndarray, letters: np.ndarray, languages: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each row of ``counts``."""
    if not languages:
        return ["und"] * len(letters), [0.0] * len(letters)
    best = counts.argmin(1)
    least = counts[np.arange(len(best)), best].astype(float)
    if len(languages) > 1:
        second = np.partition(counts, 1, axis=1)[:, 1]
        score = 1 - least / np.maximum(second, 1)
    else:
        score = np.ones(len(best))
    names = [languages[b] if has else "und" for b, has in zip(best.tolist(), letters.tolist())]
    return names, np.where(letters, score, 0.0).tolist()


def learn(train: DataFrame, sample_symbols: int = SAMPLE_SYMBOLS) -> list[tuple[str, str]]:
    """(language, sample) pairs from rows of (doc_id, text, lang)."""
    rows = train.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    # of each language, the passages whose hash is low enough that about twice the bound is left
    share = (2.0 * sample_symbols / F.greatest("n", F.lit(1)) + 1e-9).alias("share")
    rows = rows.join(F.broadcast(sizes.select("lang", share)), "lang")  # a row for each language
    place = lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 30)) / F.lit(float(1 << 30))
    every = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / PASSAGE).cast("int"))
    low = rows.withColumn("k", F.explode(F.filter(every, lambda k: place(k) < F.col("share"))))
    low = low.select("lang", place(F.col("k")).alias("place"), "doc_id", "k", F.substring("text", F.col("k") * PASSAGE + 1, F.lit(PASSAGE)).alias("text"))
    samples: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for r in low.orderBy("lang", "place", "doc_id", "k", "text").toLocalIterator():
        left = sample_symbols - held.get(r["lang"], 0)
        if left > 0:
            samples.setdefault(r["lang"], []).append(r["text"][:left])
            held[r["lang"]] = held.get(r["lang"], 0) + min(left, len(r["text"]) + 1)
    return [(name, "\n".join(samples[name])) for name in sorted(samples)]


def identify(docs: DataFrame, samples: list[tuple[str, str]]) -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    text_at = docs.columns.index("text")

    def predict(frames):
        parser = parser_of(samples)
        for batch in frames:
            names, scores = [], []
            texts = batch.column(text_at).to_pylist()
            for at in range(0, len(texts), 2000):
                n, s = decide(*parser.counts(texts[at : at + 2000]), parser.languages)
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return small_batches(docs).mapInArrow(predict, with_columns(docs.schema, lang_pred=StringType(), score=DoubleType()))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    fold_of = fold(F.col("doc_id"), FOLDS)
    samples = learn(docs.filter(fold_of != HELD_OUT))
    own = docs.select("doc_id", F.coalesce(fold_of == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return identify(own, samples).drop("text")


def clean(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and isn't clearly in another language than their ``lang``, if that was learned."""
    samples = learn(docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(frames):
        parser = parser_of(samples)
        for batch in frames:
            counts, letters = parser.counts(batch.column(text_at).to_pylist())
            found = zip(*decide(counts, letters, parser.languages), batch.column(lang_at).to_pylist())
            other = [given in parser.languages and given != name and score >= min_score for name, score, given in found]
            yield batch.filter(pa.array(letters & ~np.array(other, bool)))

    return small_batches(docs).mapInArrow(run, docs.schema)
