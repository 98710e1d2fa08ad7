"""Quality rules: base statistics of a text and the frequency of its lines across the documents of a host.

A line counts in its normalised form: A to Z lower-cased, words joined by one space; lines without a word are ignored.  A 64-bit
hash stands for it.  For each (host, line) the distinct documents are counted.  A line is above the limits when more than
``limit_docs`` documents have it, however large the host.  It is removed from all these documents but the first (the one with the smallest id), so no content leaves the corpus wholly.  A document is depleted, and is
rejected, when less than ``min_left`` of its words is left.

Documents with the same text are counted as one document of their host, so exact copies, which deduplication handles, do not push the
lines of a good text above the limits.

Scale.  One Python pass over the texts writes the statistics and (line hash, words) pairs to a table in the shared folder.  Counting
aggregates partially before its shuffle; the frequent lines are joined back with a salt of the document, so a line or host with a third
of all rows spreads over ``SALTS`` keys.  Nothing is gathered per line or host.

Edge cases.  A null text counts as an empty one; it has no words and fails the base rules.  A null source is a host of its own.  A null id
is never the first one.  Repeated rows with one id, host and text are one document for the counts; each row is returned, with one verdict.
Of documents that share an id each is the first one.  A very long text is one more row; its distinct lines are held at once.  An empty
table gives no rows.  ``judge`` ignores other columns; ``clean`` keeps them and uses names that they don't have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rategrid.llm.common import materialize, small_batches, unused

LIMIT_DOCS = 5
MIN_LEFT = 0.5
SALTS = 32
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"row_id long, doc_id long, host string, text_hash long, {STATS}, lines array<struct<line:long,words:int>>"


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1] if len(ids) > 1 << 20 else a[:-1] * len(ids) + a[1:]
    _, where, counts = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def line_hash(words: list[bytes]) -> int:
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def base(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, given its words."""
    seen: set = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines of a text."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    lines: dict = {}
    for line in data.lower().split(b"\n"):
        own = line.split()
        if own:
            h = line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    return len(words), *base(text, words), [{"line": h, "words": n} for h, n in lines.items()]


def _measure(frames):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))]
    for batch in frames:
        found = [statistics(t) for t in batch.column(4).to_pylist()]
        columns = list(zip(*found)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["row_id", "doc_id", "host", "text_hash", *names],
        )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """The base statistics and hashed lines of every row, written to the shared folder."""
    own = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return materialize(small_batches(own).mapInArrow(_measure, SCHEMA), "quality")


def frequent_lines(measured: DataFrame, limit_docs: int = LIMIT_DOCS) -> DataFrame:
    """host, line, docs, first_doc of the lines above the limit."""
    one = measured.groupBy("host", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.first("lines").alias("lines"))
    return (
        one.select("host", "doc_id", F.explode("lines.line").alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("docs") > limit_docs)
    )


def _hits(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """row_id, line, words of the lines that are to be removed."""
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = measured.select(
        "row_id", "doc_id", "host", F.pmod(F.hash("row_id"), F.lit(SALTS)).alias("salt"), F.explode("lines").alias("l")
    ).select("row_id", "doc_id", "host", "salt", "l.line", "l.words")
    return lines.alias("l").join(
        salted.alias("f"),
        (F.col("l.line") == F.col("f.line"))
        & F.col("l.host").eqNullSafe(F.col("f.host"))
        & (F.col("l.salt") == F.col("f.salt"))
        & ~F.col("l.doc_id").eqNullSafe(F.col("f.first_doc")),
    ).select("row_id", "l.line", "words")


def judge(
    docs: DataFrame,
    host: str = "source",
    limit_docs: int = LIMIT_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Statistics and verdict of every row: row_id, doc_id, the base statistics, removed_words, base_failed, kept, and
    host, text_hash and removed_lines, by which ``clean`` finds what to remove."""
    measured = measure(docs, host)
    frequent = frequent_lines(measured, limit_docs)
    removed = _hits(measured, frequent).groupBy("row_id").agg(
        F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines")
    )
    joined = measured.drop("lines").join(removed, "row_id", "left")
    gone = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    left = (F.col("n_words") - gone).cast("double")
    return joined.select(
        "row_id",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        gone.cast("long").alias("removed_words"),
        failed.alias("base_failed"),
        (~failed & (left >= F.lit(min_left) * F.col("n_words"))).alias("kept"),
        "host",
        "text_hash",
        "removed_lines",
    )


def _without(frames):
    for batch in frames:
        at = batch.schema.get_field_index("text")
        texts = []
        for text, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            if gone:
                gone = set(gone)
                lines = (x for x in text.split("\n"))
                text = "\n".join(x for x in lines if not (w := x.encode("utf-8").lower().split()) or line_hash(w) not in gone)
            texts.append(text)
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of ``docs``, without the lines above the limits; ``n_chars``, if there, is counted anew.

    The verdict follows from a row's id, host and text, so rows are found again by these.
    """
    verdicts = judge(docs, host, **limits)
    i, h, t, gone, own = unused(docs.columns, "id_", "host_", "hash_", "gone_", "own_")
    keys = verdicts.filter("kept").groupBy(F.col("doc_id").alias(i), F.col("host").alias(h), F.col("text_hash").alias(t)).agg(F.first("removed_lines").alias(gone))
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.col(host).cast("string").eqNullSafe(F.col(h)) & (F.col(own) == F.col(t))
    out = hashed.join(keys, same).select(*docs.columns, gone).mapInArrow(_without, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
