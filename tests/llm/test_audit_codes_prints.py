import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rategrid.llm import codes, divergence, fingerprints

DOCS = "doc_id long, text string, lang string, source string, value int, rank int"
WORDS = ["the", "of", "Straße", "漢字", "Ünï", "x", "and", "ähm", "data", "A"]


def some_docs(n=60, seed=3):
    r = random.Random(seed)
    rows = [(1, None, None, None, 1, 1), (2, "", "en", "a", 1, 1), (3, "12 ... \n", "xx", "only", 1, 1), (3, "12 ... \n", "xx", "other", 1, 1)]
    for i in range(n):
        text = " ".join(r.choice(WORDS[: r.randint(2, 10)]) for _ in range(r.randint(0, 30)))
        rows.append((i, text.replace(" x ", "'x-"), r.choice(["en", "de", "", None]), r.choice(["a", "b", "Z", "é", None]), 1, 1))
    return rows + rows[-3:] + [(99, "long " * 5000, "en", "b", 1, 1)]


def brute_audit(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source, *_ in rows]
    df = defaultdict(Counter)
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in df[lang].items() if n >= 3] for lang in {d[0] for d in docs}}
    count = defaultdict(Counter)
    for lang, source, terms in docs:
        for g in ((lang, source), (lang,)):
            count[g].update(t for t in terms if t in set(kept[lang]))
    out = []
    for lang, vocabulary in kept.items():
        p = lambda g, t: 1 + 10**9 * (count[g][t] + 1) // (sum(count[g].values()) + len(vocabulary))
        sources = sorted({s for x, s, _ in docs if x == lang})
        for a in sources:
            pairs = [(-sum((p((lang, a), t) - p((lang, b), t)) ** 2 // p((lang, b), t) for t in vocabulary), b.encode(), b) for b in sources if b != a]
            terms = [(-((p((lang, a), t) - p((lang,), t)) ** 2 // p((lang,), t)), t.encode(), t) for t in vocabulary if count[lang, a][t] and p((lang, a), t) > p((lang,), t)]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, a, part, item, -value, i + 1) for i, (value, _, item) in enumerate(sorted(found))]
    return sorted(out)


def test_audit_by_brute_force(spark):
    rows = some_docs()
    got = divergence.audit(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows)
    assert {r["part"] for r in got} == {"pair", "term"} and {r["lang"] for r in got} >= {"", "en", "de", "xx"}
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_audit_of_tiny_pieces(monkeypatch):
    """Flushes, pieces that end between terms, and a term with more rows than a piece give the same counts."""
    rows = some_docs(40, 4)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows]) for k in (2, 3)] + [pa.array([(r[1] or "").encode() for r in rows])], ["lang", "source", "text"])
    order = lambda b: pa.Table.from_batches(b).sort_by([("lang", "ascending"), ("term", "ascending")]).to_batches(max_chunksize=7)
    want = sorted(map(str, pa.Table.from_batches(divergence._kept_counts(iter(order(divergence._partial_counts([batch]))))).to_pylist()))
    monkeypatch.setattr(divergence, "HELD", 6)
    monkeypatch.setattr(divergence, "STEP", 11)
    monkeypatch.setattr(divergence, "PIECE", 10)
    partial = order(divergence._partial_counts([batch]))
    assert max(Counter((r["lang"], r["term"]) for b in partial for r in b.to_pylist()).values()) > 10
    assert sorted(map(str, pa.Table.from_batches(divergence._kept_counts(iter(partial))).to_pylist())) == want


def test_audit_sums_stay_exact():
    """A thousand billion occurrences, and shares from 1 to 10**9."""
    rows = [("en", s, t, n, total, 10**13 + 7, 3) for s, total in (("a", 10**13), ("b", 7)) for t, n in (("x", total - 1), ("y", 1))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "term", "n", "total", "lang_total", "v"), r)) for r in sorted(rows, key=lambda r: r[2])])
    got = {(r["part"], r["source"], r["item"]): int(r["value"]) for b in divergence._scores(iter([batch])) for r in b.to_pylist()}
    p = lambda n, total: 1 + 10**9 * (n + 1) // (total + 3)
    f = lambda p, q: (p - q) ** 2 // q
    for one, two in (("a", "b"), ("b", "a")):
        want = 0
        za, zb = (p(0, next(r[4] for r in rows if r[1] == s)) for s in (one, two))
        for t in "xy":
            pa_, pb = (next(p(r[3], r[4]) for r in rows if r[1] == s and r[2] == t) for s in (one, two))
            want += f(pa_, pb) - f(pa_, zb) - f(za, pb) + f(za, zb)
        assert got["pair", one, two] == want


def brute_codes(vectors):
    """(codes, error) of whole-number vectors in order of id, and the codebooks."""
    d = vectors.shape[1] // codes.PARTS
    books, found = [], []
    for i in range(codes.PARTS):
        x = vectors[:, i * d : (i + 1) * d]
        book = [list(map(int, e)) for e in x[: codes.ENTRIES]]
        nearest = lambda: [min((sum((int(p) - q) ** 2 for p, q in zip(row, e)), k) for k, e in enumerate(book)) for row in x]  # noqa: B023, E731
        for _ in range(codes.ROUNDS):
            of = [k for _, k in nearest()]
            for k in set(of):
                own = [row for row, j in zip(x, of) if j == k]
                book[k] = [int(sum(map(int, c))) // len(own) for c in zip(*own)]
        books.append(book)
        found.append(nearest())
    return ["".join(f"{k:02x}" for _, k in row) for row in zip(*found)], [sum(e for e, _ in row) for row in zip(*found)], books


VECTORS = "label int, vec_id long, embedding array<double>, v int, code string"


def test_codes_by_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(330, 8)).round(3)
    x[40:60] = x[7]  # a group of copies
    x[100:110] = 0
    rows = [(int(i % 3) if i % 7 else None, int(i), x[i].tolist(), 0, "c") for i in r.permutation(len(x))]
    left_out = [(1, -3, None, 0, ""), (1, -2, [1.0, None] + [0.0] * 6, 0, ""), (1, -1, [float("nan")] * 8, 0, ""), (1, -4, [float("inf")] + [0.0] * 7, 0, "")]
    got = codes.compress(spark.createDataFrame(rows + left_out, VECTORS)).collect()
    code, error, books = brute_codes(np.floor(x * 1024).astype(int))
    label = {i: y for y, i, *_ in rows}
    sums = Counter()
    for i, e in enumerate(error):
        sums[label[i]] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    assert {tuple(g) for g in got} == {(i, code[i], error[i], sums[label[i]], digest) for i in range(len(x))} and len(got) == len(x)


def test_codes_of_odd_rows(spark):
    rows = [(1, 5, [1.0, 2.0, 3.0], 0, ""), (1, None, [], 0, ""), (None, 5, [1.0, 2.0, 3.0], 0, ""), (2, 4, [1e300, -1e300, 0.0, 0.0, 0.25], 0, "")]
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((g["vec_id"] or 0, g["code"], g["error"]) for g in got) == [(0, "03000100", 0), (4, "00000000", 0), (5, "01010100", 0), (5, "01010100", 0)]
    assert {g["label_error"] for g in got} == {0}
    assert codes.compress(spark.createDataFrame(rows[:0], VECTORS)).collect() == []


@pytest.mark.parametrize("spread, dtype_bound", [(1, 400), (300, 400), (300, 1 << 28)])
def test_annuli_against_all_entries(spread, dtype_bound):
    r = np.random.default_rng(spread)
    make = lambda n: (r.integers(-50, 50, (n, 4)) * r.integers(1, spread + 1, (n, 1)) * max(1, dtype_bound // 20_000)).astype(np.int64)
    entries, parts = make(256), make(8000)
    entries[200:210] = entries[3]
    parts[:256] = entries
    book = codes.Codebook(entries)
    index, best = book.nearest(parts)
    d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()
    assert book.evaluated < d.size * (0.7 if spread > 1 else 1.01)


def brute_print(text, counts):
    """Filters of a text by plain loops."""
    f = fingerprints
    data = text.encode()
    if not data:
        return []
    data = data + bytes(max(0, f.WINDOW - len(data)))
    windows = [data[i : i + f.WINDOW] for i in range(len(data) - f.WINDOW + 1)]
    order = sorted(range(f.LEVELS + 1), key=lambda x: (x < f.LEVELS * f.WEAK_BITS / math.log2(f.WINDOW), counts[x], x))
    rank = {x: i for i, x in enumerate(order)}
    ranked = [(rank[brute_level(w)], i) for i, w in enumerate(windows)]
    if len(windows) < f.FEW:
        chosen = list(range(len(windows)))
    else:
        votes = Counter(min(ranked[i : i + f.RUN])[1] for i in range(len(windows) - f.RUN + 1))
        chosen = sorted(i for i, n in votes.items() if n >= f.VOTES)
    taken = list(dict.fromkeys(windows[i] for i in chosen))
    out = []
    for start in range(0, len(taken), f.FULL):
        bits = np.zeros(f.BITS, int)
        for h in f.hashes(np.frombuffer(b"".join(taken[start : start + f.FULL]), np.uint8), np.arange(len(taken[start : start + f.FULL])) * f.WINDOW):
            for k in range(f.BITS_EACH):
                bits[int(h) >> (11 * k) & (f.BITS - 1)] = 1
        out.append(bits)
    return out


def brute_level(window):
    table = fingerprints._N_LOG_N
    return int(int(table[-1]) - sum(int(table[n]) for n in Counter(window).values())) // (int(table[-1]) // fingerprints.LEVELS)


def test_entropies():
    data = bytes(random.Random(1).choice(b"abcdef \xc3") for _ in range(500)) + b"a" * 40
    want = []
    for i in range(len(data) - fingerprints.WINDOW + 1):
        n = Counter(data[i : i + fingerprints.WINDOW]).values()
        want.append(-sum(c / fingerprints.WINDOW * math.log2(c / fingerprints.WINDOW) for c in n))
        assert fingerprints.levels(np.frombuffer(data, np.uint8))[i] == brute_level(data[i : i + fingerprints.WINDOW])
    got = fingerprints.levels(np.frombuffer(data, np.uint8)) * math.log2(fingerprints.WINDOW) / fingerprints.LEVELS
    assert np.abs(got - want).max() < 0.01


def test_fingerprints_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "DOCS_A_RANGE", 7)
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [None, "", "a", "ab", "a" * 500, say(900), *(say(r.randint(1, 200)) for _ in range(40))]
    rows = [(i * 3, t, None, "s", 1, 1) for i, t in enumerate(texts)]
    rows += [(60, say(40), "x", "s", 1, 1), (60, say(40), "x", "s", 1, 1), rows[9], (None, say(30), "x", None, 1, 1), (None, None, "x", None, 1, 1)]
    got = fingerprints.compare(spark.createDataFrame(r.sample(rows, len(rows)), DOCS)).collect()
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    counts = Counter(brute_level((d + bytes(max(0, fingerprints.WINDOW - len(d))))[i : i + fingerprints.WINDOW]) for _, t in order if (d := t.encode()) for i in range(max(1, len(d) - fingerprints.WINDOW + 1)))
    hexes = lambda p: b"".join(np.packbits(x).tobytes() for x in p).hex()
    want = []
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, changed, next_ = (brute_print(t, counts) for t in (text, edited, after))
        pack = lambda p: np.packbits(np.array(p, dtype=bool).reshape(len(p), fingerprints.BITS), axis=1)
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexes(own), hexes(changed), fingerprints.likeness(pack(own), pack(changed)), fingerprints.likeness(pack(own), pack(next_))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert fingerprints.compare(spark.createDataFrame([], DOCS)).collect() == []
    alone = fingerprints.compare(spark.createDataFrame([(5, "abc " * 60, "x", "s", 1, 1)], DOCS)).first()
    assert alone["near_edited"] == alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(("abc " * 60).encode()).hexdigest()


def test_likeness():
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rank = fingerprints.ranks(fingerprints.histogram([say(3000).encode()]))
    of = lambda t: fingerprints.fingerprints([t.encode()], rank)[0]
    for n in (60, 600, 6000):
        text, other = say(n), say(n)
        half = of(text[: len(text) // 2] + other[: len(text) // 2])
        assert fingerprints.likeness(of(text), of(text)) == 1
        assert 0.3 < fingerprints.likeness(of(text), half) < 0.75 and fingerprints.likeness(of(text), half) == fingerprints.likeness(half, of(text))
        assert fingerprints.likeness(of(text), of(other)) < 0.1
    assert fingerprints.likeness(of(""), of("")) == 1 and fingerprints.likeness(of(""), of("a")) == 0
    big, small = of(say(6000)), of(say(300))  # both ways of comparing agree
    plain = max(0.0, *(b / m if m > 0 else 0 for y in big for b, m in [fingerprints._overlap(int(np.bitwise_count(small[0] & y).sum()), int(np.bitwise_count(small[0]).sum()), int(np.bitwise_count(y).sum()))]))
    assert len(big) > 16 and (len(small) > 1 or abs(fingerprints.likeness(small, big) - plain) < 1e-6)


def test_fingerprints_of_long_texts_in_tiles(monkeypatch):
    """Features of a text do not depend on the texts worked on with it; its memory is bounded by tiles."""
    r = random.Random(4)
    texts = ["".join(r.choice("abcde fgh") for _ in range(n)).encode() for n in (3, 5000, 70, 200_000, 0, 40)]
    rank = fingerprints.ranks(fingerprints.histogram(texts))
    together = fingerprints.fingerprints(texts, rank)
    assert all((a == fingerprints.fingerprints([t], rank)[0]).all() for a, t in zip(together, texts))
    monkeypatch.setattr(fingerprints, "TOGETHER", 300)
    assert all((a == b).all() for a, b in zip(together, fingerprints.fingerprints(texts, rank)))
