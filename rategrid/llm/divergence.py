"""Divergence of the sources of a language from each other, by SQL over shards of (language, term).

Terms are runs of ASCII letters and characters beyond ASCII, A to Z lower-cased.  A language keeps the terms in at least ``MIN_DOCS`` of
its documents, V of them.  In a group (a source of a language, or the language itself) with N occurrences of kept terms, a term with
``count`` of them has ``p = 1 + floor(10**9 * (count + 1) / (N + V))``, and ``p`` diverges from ``q`` by ``floor((p - q)**2 / q)``.  The part
``pair`` has for each source of a language the divergence from each other source, summed over all kept terms; the part ``term`` has the
``TOP`` terms that a source has more often than its language.  All arithmetic is on whole numbers.

Method.  Documents become counts of terms by (language, source), which are hashed to shards by (language, term).  In each shard DuckDB runs
the counts; in a second pass, once the totals N and V are known, it sums divergences by pair and ranks terms.  Spark merges the sums
and the rankings.  A term that two sources lack diverges by what their totals alone give, and one that a single source has by what its count
gives.  These two kinds are summed from V and from the number of terms by count, so shards join only the sources that share a term.

Scale.  A task adds up the terms of its documents in a table of at most ``HELD`` entries before it passes them on, so a frequent term is
one row a source and flush.  Shards are read as sorted streams and given to DuckDB in pieces of about ``PIECE`` rows that end between terms;
DuckDB has one thread, ``MEMORY`` and no folder to spill to.  If one term fills a piece, its rows are added up before more are read.
A source, however large, is spread over the shards of all its terms.  Totals have a row a (language, source) and come to the counts by a
join that Spark plans by their size.  Rankings are cut within shards, then within buckets of terms, then as a whole.

Edge cases.  Null texts, languages and sources count as ''.  Every row is a document, so repeated rows count each.  A language without kept
terms gives its pairs the value 0 and no terms.  A language with one source has no pairs.  Of ties the lower item in UTF-8 comes first.
Long texts are cut into terms ``STEP`` bytes at a time.  An empty table gives no rows.  Other columns are ignored, so they can't clash.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rategrid.llm.common import materialize, small_batches

MIN_DOCS = 3
TOP = 200
UNIT = 1_000_000_000

#: Entries that a task holds before it passes them on; rows given to DuckDB at once; its memory; bytes of a text cut at once.
HELD = 400_000
PIECE = 300_000
MEMORY = "500MB"
STEP = 1 << 20

#: Lower-cases A to Z and turns all that is in no term into spaces.
TERM_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def pieces(text: bytes):
    """Lists of the terms of a UTF-8 text, in order; a list comes from about ``STEP`` bytes."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + STEP)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


PARTIAL = "lang string, source string, term string, n long, docs long"


def _partial_counts(batches):
    """Occurrences and documents of terms by (lang, source), added up as far as ``HELD`` entries reach."""
    counts: dict = {}
    docs: dict = {}

    def flush():
        for (lang, source), count in counts.items():
            of = docs[lang, source]
            terms = pa.array(list(count), pa.binary()).cast(pa.string())
            n, d = pa.array(list(count.values()), pa.int64()), pa.array([of[t] for t in count], pa.int64())
            names = [pa.array([x], pa.string()).take(pa.array([0] * len(count), pa.int32())) for x in (lang, source)]
            out = pa.RecordBatch.from_arrays([*names, terms, n, d], ["lang", "source", "term", "n", "docs"])
            for at in range(0, len(out), 50_000):
                yield out.slice(at, 50_000)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            group = lang, source
            if group not in counts:
                counts[group], docs[group] = Counter(), Counter()
            seen: set = set()
            for terms in pieces(text):
                counts[group].update(terms)
                seen.update(terms)
            docs[group].update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield from flush()
    yield from flush()


class Shard:
    """DuckDB over a stream of batches sorted by (lang, term), in pieces that end between terms."""

    def __init__(self, batches):
        import duckdb

        self.batches = batches
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})

    def run(self, sql: str, table: pa.Table) -> pa.Table:
        """``sql`` over ``table``, which it calls ``rows``."""
        self.con.register("rows", table)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister("rows")

    def pieces(self, shrink: str):
        """Tables of whole terms.  ``shrink`` is SQL that makes the rows of one term fewer."""
        held, n = [], 0
        for batch in self.batches:
            held.append(batch)
            n += len(batch)
            if n < PIECE:
                continue
            table = pa.Table.from_batches(held)
            last = pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["term"], table["term"][-1]))
            cut = n - pc.sum(last).as_py()
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            if len(rest) >= PIECE // 2:
                rest = self.run(shrink, rest).select(table.schema.names).cast(table.schema)
            held, n = rest.combine_chunks().to_batches(), len(rest)
        if n:
            yield pa.Table.from_batches(held)


def _sent(table: pa.Table, names: list[str], types: list):
    for batch in table.select(names).cast(pa.schema(list(zip(names, types)))).to_batches(max_chunksize=50_000):
        if len(batch):
            yield batch


SUMS = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL"

KEPT_SQL = f"""
WITH c AS (SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM rows GROUP BY ALL)
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INT AS first FROM c
QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {MIN_DOCS}
"""


def _kept_counts(batches):
    """Counts of the terms in enough documents of their language, with 1 at one row of a term."""
    shard = Shard(batches)
    for table in shard.pieces(SUMS):
        yield from _sent(shard.run(KEPT_SQL, table), ["lang", "source", "term", "n", "first"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()])


def _p(count: str, total: str) -> str:
    return f"(1 + ({UNIT}::HUGEINT * ({count} + 1)) // ({total} + v))::BIGINT"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


#: Sources that share a term: their divergence there, less what the sums by count say for it.
PAIRS_SQL = f"""
WITH c AS (SELECT lang, term, source, {_p("n", "total")} AS p, {_p("0", "total")} AS z FROM rows)
SELECT a.lang, a.source, b.source AS item,
  sum(({_f("a.p", "b.p")} - {_f("a.p", "b.z")} - {_f("a.z", "b.p")} + {_f("a.z", "b.z")})::HUGEINT)::DECIMAL(38, 0) AS value
FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
GROUP BY ALL
"""

TERMS_SQL = f"""
WITH c AS (
  SELECT lang, source, term, {_p("n", "total")} AS p, {_p("sum(n) OVER (PARTITION BY lang, term)", "lang_total")} AS q FROM rows
)
SELECT lang, source, term AS item, {_f("p", "q")}::DECIMAL(38, 0) AS value FROM c WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}
"""

SCORES = "lang string, source string, part string, item string, value decimal(38,0)"


def _scores(batches):
    shard = Shard(batches)
    names = ["lang", "source", "part", "item", "value"]
    for table in shard.pieces("FROM rows"):  # a term has a row a source here
        for part, sql in (("pair", PAIRS_SQL), ("term", TERMS_SQL)):
            found = shard.run(sql, table)
            found = found.append_column("part", pa.array([part], pa.string()).take(pa.array([0] * len(found), pa.int32())))
            yield from _sent(found, names, [pa.string(), pa.string(), pa.string(), pa.string(), pa.decimal128(38, 0)])


def _share(count: Column, total: str) -> Column:
    """p of a count, null where the language keeps no terms."""
    whole = (F.col(total) + F.col("v")).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT) * (count + 1).cast("decimal(20,0)"), F.nullif(whole, F.lit(0).cast("decimal(20,0)")))


def _apart(p: str, q: str) -> Column:
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(q)).cast("decimal(38,0)")


def by_term(df: DataFrame) -> DataFrame:
    """Shards of (lang, term), sorted."""
    return df.repartition("lang", "term").sortWithinPartitions("lang", "term")


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept counts (lang, source, term, n), and every group (lang, source) with its total, its language's and V, written to the shared folder."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(read("lang").alias("lang"), read("source").alias("source")).distinct()
    texts = docs.select(read("lang").alias("lang"), read("source").alias("source"), read("text").cast("binary").alias("text"))
    partial = small_batches(texts).mapInArrow(_partial_counts, PARTIAL)
    kept = materialize(by_term(partial).mapInArrow(_kept_counts, "lang string, source string, term string, n long, first int"), "divergence-counts")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    totals = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "firsts"])
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    return kept.drop("first"), materialize(totals.drop("firsts").join(of_lang, "lang"), "divergence-totals")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank from ``docs`` (text, lang, source)."""
    kept, totals = counts(docs)
    scored = materialize(by_term(kept.join(totals, ["lang", "source"])).mapInArrow(_scores, SCORES), "divergence-scores")

    # Terms by their count in a source: what they add where the other source lacks them, as source and as item, and what all V terms give.
    z = totals.withColumn("z", _share(F.lit(0), "total"))
    a = z.select("lang", "source", F.col("z").alias("za"), "v")
    b = z.select("lang", F.col("source").alias("item"), F.col("z").alias("zb"))
    flat = a.join(b, "lang").filter(F.col("source") != F.col("item"))
    flat = flat.select("lang", "source", "item", F.coalesce(F.col("v") * _apart("za", "zb"), F.lit(0)).cast("decimal(38,0)").alias("value"))
    by_count = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(z, ["lang", "source"])
    by_count = by_count.select("lang", F.col("source").alias("one"), F.col("z").alias("z1"), _share(F.col("n"), "total").alias("p1"), "terms")
    single = by_count.join(z.select("lang", F.col("source").alias("two"), F.col("z").alias("z2")), "lang").filter(F.col("one") != F.col("two"))
    gains = lambda source, item, more: single.groupBy("lang", F.col(source).alias("source"), F.col(item).alias("item")).agg(F.sum(F.col("terms") * more).cast("decimal(38,0)").alias("value"))
    lacking = gains("one", "two", _apart("p1", "z2") - _apart("z1", "z2")).unionByName(gains("two", "one", _apart("z2", "p1") - _apart("z2", "z1")))
    shared = scored.filter("part = 'pair'").drop("part")
    pairs = flat.unionByName(lacking).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = [F.col("value").desc(), F.col("item")]
    terms = scored.filter("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    bucketed = terms.withColumn("bucket", F.pmod(F.hash("item"), F.lit(64)))
    best = F.row_number().over(Window.partitionBy("lang", "source", "bucket").orderBy(*order))
    terms = bucketed.withColumn("rank", best).filter(F.col("rank") <= TOP).drop("bucket", "rank")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).filter(F.col("rank") <= TOP)
    return pairs.unionByName(terms)
