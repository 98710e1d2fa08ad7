"""What nulls, empty texts, ties and repeated rows give, and what near-duplicate bands find."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from rategrid.llm import chat, mixing, neardup, quality
from tests.llm.test_llm import DOCS, ODD


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_quality_rules_of_odd_rows(spark, odd):
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in quality.judge(odd).collect()}
    short = lambda i, n, chars: (i, n, chars, 0, 0, 0, True, False)
    assert got == {short(1, 0, 0), short(2, 0, 0), short(3, 0, 0), short(4, 2, 6), short(None, 6, 22), short(7, 5, 6), (6, 30_000, 120_000, 0, 0, 30_000, True, False)}
    ties = spark.createDataFrame([(i, "\n".join([" ".join(f"{c}{i}x{k}" for c in "abcdefg") for k in range(10)] + ["a line of all"] * 2 + [""]), "en", "h", 0, "x") for i in (1, 2, 2)], DOCS)
    rows = quality.judge(ties).collect()
    assert len(rows) == 3 and all((r["n_words"], r["n_dup_lines"], r["kept"]) == (78, 1, True) for r in rows)


def test_mixing_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert sorted((r["source"] or "", r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == sorted(
        [("a", 0, 4, 12.0)] * 2 + [("a", 2, 4, 12.0)] * 2 + [("b", 6, 30_006, 29_988.0), ("b", 30_000, 30_006, 29_988.0), ("", 0, 5, 15.0), ("", 5, 5, 15.0)]
    )
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in ("a", None)}
    assert taken == {"a": 12, None: 15} and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "a"), (None, 0, "assistant", "x"), (2, 5, "assistant", "<|end|>"), (2, 5, "assistant", "<|end|>")]
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    want = {1: [("", ""), ("user", "a"), ("user", "a"), ("assistant", "")], None: [("assistant", "x")], 2: [("assistant", "<|end|>")] * 2}
    assert {k: (r["n_turns"], r["turns_sha256"]) for k, r in got.items()} == {k: (len(v), sha(*v)) for k, v in want.items()}
    loss = {k: "".join(t for r, t in v if r == "assistant") for k, v in want.items()}
    assert {k: (r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in loss.items()}


def test_stages_of_odd_rows(spark, odd):
    """Every stage alone: which ids it keeps, and that the last one has a row for each."""
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))
    sf = "/root/testdata/sf0.001"
    assert ids(corpus_pipeline.quality_rules(spark, odd, sf)) == []  # all are short or repeat themselves
    assert ids(corpus_pipeline.language_id(spark, odd, sf))[:1] == [4]  # texts without letters go: 1, 2 and 3
    assert ids(corpus_pipeline.near_dedup(spark, odd, sf)) == [1, 2, 3, 4, 6, 7, None]  # one of the equal rows stays; empty texts are no duplicates
    assert ids(corpus_pipeline.decontamination(spark, odd, sf)) == [1, 2, 3, 4, 4, 6, 7, None]
    assert ids(corpus_pipeline.source_mix(spark, odd, sf)) == [1, 2, 3, 4, 4, 6, 7, None]


def test_bands_find_similar_sets():
    """3,000 pairs of sets at the least similarity that links, 80 of 94: none shares no band, and as many agree as with independent coordinates."""
    r = np.random.default_rng(1)
    agree = []
    for _ in range(3000):
        x = r.integers(0, 2**63, 94, dtype=np.uint64)
        a, b = np.sort(x[:87]), np.sort(np.concatenate([x[:80], x[87:]]))
        agree.append(sum(p == q for p, q in zip(neardup.bands(a), neardup.bands(b))))
    share = (80 / 94) ** neardup.ROWS
    assert min(agree) > 0
    assert abs(np.mean(agree) - neardup.BANDS * share) < 0.25 and abs(np.std(agree) - np.sqrt(neardup.BANDS * share * (1 - share))) < 0.25
