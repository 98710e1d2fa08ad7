import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rategrid.llm import chat, decontam, langid, lm, mixing, neardup, pages, passages, quality, toxicity
from rategrid.llm.registry import ORACLES, QUERIES
from tests.conftest import same_rows, views

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_key string"
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "a", 0, "x"),
    (3, " \n\t ", "en", "a", 4, "x"),
    (4, "one two", "en", "a", 7, "x"),
    (4, "one two", "en", "a", 7, "x"),
    (None, "one two three four five six", "de", "b", 27, "x"),
    (6, "word " * 30_000, "de", "b", 150_000, "x"),
    (7, "\U0001f600 ퟿ é ñ 漢字", "fr", None, 9, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def applied(spark, docs):
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (6, 1, 0), (7, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")
    html = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.lit(1).alias("text"))
    return {
        "quality": quality.judge(docs), "pages": pages.main_text(html), "mixing": mixing.mix(docs), "passages": passages.classify(docs, labels), "langid": langid.judge(docs),
        "lm": lm.evaluate(docs), "decontam": decontam.matches(docs, bench), "neardup": neardup.deduplicate(docs), "toxicity": toxicity.classify(docs, labels),
    }


def test_odd_rows(spark, odd):
    for name, df in applied(spark, odd).items():
        assert name == "decontam" or df.count() == len(ODD), name


def test_empty_tables(spark, odd):
    for name, df in applied(spark, odd.limit(0)).items():
        assert df.count() == 0, name
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.digests(chat.windows(empty)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    assert same_rows([tuple(r) for r in df.collect()], df.columns, views(SF).sql(ORACLES[name]))


def test_chat_round_trip(spark):
    rows = [(1, i, "system" if i == 0 else "user\n" if i % 2 else "assistant", t) for i, t in enumerate(["be <|im_start|> kind", "a\\b [INST]", "<|im_end|>\nx", None, "w " * 900, "</s>\\", "last"])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.read_back(chat.windows(df)).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, t or "") for _, _, r, t in rows]
    assert got["loss_text"] == "".join(t or "" for _, _, r, t in rows if r == "assistant")


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = [(r["doc_id"], sets_of(r["text"])) for r in docs.collect()]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.deduplicate(docs).collect()}
    assert got == {i: (len(s), top(i), top(i) == i) for i, s in rows}


def test_joins_of_templated_texts_by_brute_force():
    """Links within a task join what all pairs join, and thousands of short templated texts need little memory and time."""
    import time
    import tracemalloc

    r = random.Random(8)
    base = [neardup.shingles(" ".join(f"w{r.randrange(40)}" for _ in range(60))) for _ in range(6)]
    rows = []
    for i in range(150):
        own = np.array(sorted(set(r.choice(base).tolist()) ^ set(np.array([r.randrange(1 << 63) for _ in range(r.randrange(14))], np.uint64).tolist())), np.uint64)
        rows.append((i, i, 0, own))
    parent = list(range(150))
    top = lambda x: x if parent[x] == x else top(parent[x])
    for i in range(150):
        for j in range(i):
            if neardup._linked(rows[i][3], rows[j][3]):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    want = [top(i) for i in range(150)]
    parent = list(range(150))
    for a, b in neardup._joining(rows):
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(i) for i in range(150)] == want and len(set(want)) > 6
    words = "this is a template of which only one word is another in each text that comes".split()
    many = [(i, i, 0, neardup.shingles(" ".join([*words[:8], f"v{i}", *words[8:]]))) for i in range(8_000)]
    tracemalloc.start()
    began = time.process_time()
    assert neardup._joining(many) == []
    assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def edits_within(item, text):
    """Least edits between the item and any region of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_decontamination_against_full_alignment(spark):
    """Items of every length up to 60 and longer ones, with edits up to their budget and beyond."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(n, say(30)[:n].strip() + "k" * (n - len(say(30)[:n].strip()) > 99)) for n in range(1, 61)] + [(61, say(40)), (62, say(25)), (63, "a b"), (64, "..."), (65, None)]
    texts = [(0, None), (1, "")]
    for i, item in items[7:62]:
        for rate in (0, 0.05, 0.1, 0.2):
            chars = list(item)
            for _ in range(int(rate * len(decontam.normalise(item)))):
                k = r.randrange(1, len(chars) - 1)
                chars[k : k + 1] = r.choice(["x", "", chars[k] + "y"])
            texts.append((len(texts), say(6) + " " + "".join(chars).upper() + "!\n" + say(4)))
    found = decontam.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in found.collect()}
    expected = {}
    for d, t in texts:
        text = decontam.normalise(t)
        for i, item in items:
            x = decontam.normalise(item)
            budget = int(decontam.RATE * len(x))
            e = edits_within(x, text) if len(x) else 99
            if len(x) and budget == 0:
                e = 0 if f" {''.join(map(chr, x))} " in f" {''.join(map(chr, text))} " else 99
            if e <= budget:
                expected[d, i] = e
    assert got == expected
    assert {i for _, i in got} >= set(range(10, 63))


def test_decontamination_of_a_shared_phrase_in_slices(monkeypatch):
    """Many items that share a phrase, and texts that repeat it, give the same regions however few hits are expanded at once."""
    r = random.Random(1)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(i, "which of the following statements " + say(60)) for i in range(100)] + [(100, "ab" * 60)]
    texts = [decontam.normalise(x) for x in ("which of the following statements " * 60, items[7][1], "x " + items[9][1][:40] + "zz" + items[9][1][42:], "ab" * 900, say(400))]
    want = decontam.Index(items).search(texts)
    assert {(t, i) for t, i, *_ in want} >= {(1, 7), (2, 9), (3, 100)}
    sizes = []
    whole = decontam.Grams._regions
    monkeypatch.setattr(decontam, "HITS", 5000)
    monkeypatch.setattr(decontam.Grams, "_regions", lambda self, at, t, first, counts: (sizes.append(counts.sum()), whole(self, at, t, first, counts))[1])
    assert decontam.Index(items).search(texts) == want
    assert max(sizes) <= 25_000 and len(sizes) > 20  # a single item's stretch may hold more than HITS


def test_decontamination_blocks_and_rows(spark, odd, monkeypatch):
    """Blocks of the benchmark give what one gives; rows that share an id are judged each."""
    bench = spark.createDataFrame([(i, f"item number {i} has words of its own w{i * 37}") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "item number 3 has words of its own w111"), (5, "clean"), (None, "clean"), (None, "x item number 4 has words of its own w148")], "doc_id long, text string")
    want = decontam.matches(docs, bench).collect()
    assert {r["item_id"] for r in want} >= {3, 4}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    assert sorted(decontam.matches(docs, bench).collect(), key=str) == sorted(want, key=str)
    assert sorted(decontam.clean(docs, bench).collect(), key=str) == sorted(docs.filter("text = 'clean'").collect(), key=str)


def test_lm_base_and_model(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    train = [split(r["text"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.evaluate(docs).collect()}
    for r in rows:
        t, g = split(r["text"]), got[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert abs(base - g["base_score"]) < 1e-6 * max(1, -base)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    assert sum(g["score"] for g in got.values()) > sum(g["base_score"] for g in got.values())


class Automaton:
    """States, arcs and failure arcs over tokens, built plainly from counted texts."""

    def __init__(self, train, prior):
        self.c, self.prior = Counter(g for t in train for k in (1, 2, 3) for g in zip(*(t[i:] for i in range(k)))), prior
        self.total = sum(map(len, train))
        self.distinct = len({w for t in train for w in t})
        self.states = {g[:-1] for g in self.c if len(g) > 1}

    def word(self, w):
        return (self.c[w,] + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def weight(self, state):
        return self.prior / (self.c[state] + self.prior)

    def arc(self, state, w):
        if not state:
            return self.word(w)
        return (self.c[(*state, w)] + self.prior * self.given(state[1:], w)) / (self.c[state] + self.prior)

    def given(self, state, w):
        weight = 1.0
        while state:  # along failure arcs to a state with the arc
            if state in self.states:
                if (*state, w) in self.c:
                    break
                weight *= self.weight(state)
            state = state[1:]
        return weight * self.arc(state, w)

    def score(self, text):
        state, total = (), 0.0
        for w in text:
            total += math.log10(self.given(state, w))
            state = (*state, w)[-2:]
        return total


def test_automaton_states_sum_to_one():
    r = random.Random(2)
    model = Automaton([[*(r.choice("abcdef") for _ in range(r.randrange(20))), "end"] for _ in range(30)], 1.0)
    words = {g[0] for g in model.c if len(g) == 1}
    rest = 0.1 / (model.total + 0.1 * (model.distinct + 1))  # of a word never seen
    for s in [(), *model.states]:
        back = math.prod(model.weight(t) for t in (s[i:] for i in range(len(s))) if t in model.states)
        assert abs(sum(model.given(s, w) for w in words) + back * rest - 1) < 1e-9


def test_arcs_and_failure_arcs_of_a_block():
    """The operator's states, arcs and failure arcs are those of the automaton built plainly, one by one."""
    r = random.Random(6)
    say = lambda n: " ".join(r.choice("abcdefg") for _ in range(n))
    texts = [say(r.randrange(25)) for _ in range(60)] + ["z z q", "", None, "a z b"]
    train = np.array([i % 3 > 0 and i < 60 for i in range(len(texts))], float)
    grams = lm.Grams(texts)
    count = grams.counts(train)
    own = lm.Automaton(grams, count, int(count[0].sum()), int((count[0] > 0).sum()))
    split = lambda t: [*(t or "").lower().split(), "end"]
    model = Automaton([split(t) for t, x in zip(texts, train) if x], lm.PRIOR)
    tokens = [w for t in texts for w in split(t)]
    context = lambda s: tuple(tokens[own.ends[s] - own.level[s] + 1 : own.ends[s] + 1])
    states = {context(s): s for s in range(len(own.level))}
    assert len(states) == len(own.level) and {s for s in states if s[-1:] != ("end",)} <= model.states | {()}  # none goes on from an end
    starts = np.concatenate([[0], np.cumsum(grams.sizes)])
    seen = set()
    for s, state in states.items():
        if s:
            assert states[s[1:]] == own.fail[state] and own.lost[state] == pytest.approx(math.log10(lm.PRIOR / (model.c[s] + lm.PRIOR)))
    for d in range(len(texts)):
        for t in range(starts[d], starts[d + 1]):
            for level in range(min(3, t - starts[d] + 1)):
                h, w = tuple(tokens[t - level : t]), tokens[t]
                arc = own.arcs[level][t]
                if h in states and (arc >= 0):
                    seen.add((h, w))
                    assert own.weight[arc] == pytest.approx(math.log10(model.arc(h, w)))
                    assert context(own.next[arc]) == (((*h, w)[-2:] if (*h, w)[-2:] in states else (w,)) if (w,) in states else ())
                assert (arc >= 0) == (level == 0 or (*h, w) in model.c)
    assert {g for g in model.c if len(g) > 1} == {(*h, w) for h, w in seen if h}  # every n-gram of the training texts has its arc


@pytest.mark.parametrize("block", [200, 12 << 20])
def test_lm_scores_of_all_ngrams(spark, block):
    """Scores are those of the automaton over every n-gram of the training texts, over many blocks and shards and over one."""
    r = random.Random(3)
    texts = ["word " * 3000, None, "", *(" ".join(r.choice("abcdefgh") for _ in range(r.randrange(30))) + " rare pair" for _ in range(60)), "rare pair", "a B c rare"]
    rows = list(enumerate(texts)) + [(None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10
    split = lambda t: [*(t or "").lower().split(), "end"]
    model = Automaton([split(t) for i, t in rows if fold(i)], lm.PRIOR)
    got = {x["doc_id"]: x for x in lm.evaluate(df, block, block).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["train_tokens"] == model.total
        assert abs(got[i]["score"] - model.score(split(t))) < 1e-6 * max(1, -got[i]["score"]), i


def test_language_accuracy(spark, docs):
    got = langid.judge(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


def phrases(sample, text):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


def test_longest_matches_by_brute_force():
    """Phrase counts of whole texts, over many blocks: ordinary ones, a copy of the sample, one phrase without end, large alphabets."""
    r = random.Random(4)
    say = lambda n, letters="abcdefg ": " ".join("".join(r.choice(letters) for _ in range(n)).split())
    wide = "".join(chr(0x4E00 + k) for k in range(3000))
    samples = [("aa", "a" * 3000), ("en", say(6000)), ("zh", say(4000, wide))]
    texts = ["the mat sat on a dog", samples[1][1][500:5500], "a" * 9000, say(5000), say(3000, wide), say(40) + samples[1][1] + say(3000), None, " 123 "]
    counts, letters = langid.Parser(samples).counts(texts)
    assert letters.tolist() == [True] * 6 + [False] * 2
    assert counts[:6].tolist() == [[phrases(s, t) for _, s in samples] for t in texts[:6]]


def test_languages_without_bound(spark):
    r = random.Random(2)
    rows = []
    for k in range(80):
        letters = "".join(r.sample([chr(0x61 + i) for i in range(26)], 5))
        for _ in range(3):
            text = " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(120))
            rows.append((len(rows), text, f"l{k:02}", "s", 0, "x"))
    docs = spark.createDataFrame(rows + [(9999, rows[0][1], "not learned", "s", 0, "x")], DOCS)
    assert len(langid.learn(docs)) == 81
    assert corpus_pipeline.language_id(spark, docs.filter("doc_id < 240"), SF).count() == 240
    # nothing is known of any language: only texts without letters go
    bare = spark.createDataFrame([(1, "words", None, "s", 0, "x"), (2, "12", None, "s", 0, "x")], DOCS)
    assert [x["doc_id"] for x in corpus_pipeline.language_id(spark, bare, SF).collect()] == [1]


def held_out_accuracy(spark, model, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = model.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_accuracy(spark):
    assert held_out_accuracy(spark, passages, "quality") >= 0.9


def test_toxicity_accuracy(spark):
    assert held_out_accuracy(spark, toxicity, "toxic") >= 0.9


def test_attention_by_brute_force():
    """Scores are those of a plain forward pass, and the gradient that of finite differences."""
    draw = np.random.default_rng(1)
    shapes = {"W": (passages.WIDTH, 3), "b": (3,), "V": (3, 2), "U": (3, 2), "w": (2,), "c": (3,), "c0": ()}
    m = {k: draw.normal(0, 0.5, v) for k, v in shapes.items()} | {"mean": np.full(passages.WIDTH, 0.1), "sd": np.full(passages.WIDTH, 0.5)}
    texts = ["one two three " * 60, None, "Half! of 100 words, " * 25, "a"]
    got = passages.predict(m, texts)
    for text, p in zip(texts, got.tolist()):
        hs = [np.tanh((x - m["mean"]) / m["sd"] @ m["W"] + m["b"]) for x in passages.encode(text)]
        e = [float(m["w"] @ (np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"]))))) for h in hs]
        z = sum(math.exp(a) * h for a, h in zip(e, hs)) / sum(map(math.exp, e)) if hs else None
        assert abs(p - (1 / (1 + math.exp(-(z @ m["c"] + m["c0"]))) if hs else 0)) < 1e-9
    bags = [x for x in map(passages.encode, texts) if len(x)]
    x, bag, y = np.vstack(bags).astype(float), np.repeat(np.arange(3), [len(b) for b in bags]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := passages._forward(m, x, bag, 3)["p"], 1 - p)))
    for k, g in passages._gradient(m, x, bag, y).items():
        for at in list(np.ndindex(m[k].shape))[:40]:
            old, step = m[k][at], 1e-5
            m[k][at] = old + step
            up = loss()
            m[k][at] = old - step
            down = loss()
            m[k][at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6, (k, at)


def test_compression_distance_by_brute_force():
    """Distances are differences of plain compressed sizes, and the thresholds count the words of whole texts."""
    import zstandard

    framed = lambda words: [f" {w} ".encode() for w in words.split()] * 50
    model = {"toxic": toxicity.dictionary(framed("idiot moron scum worthless"), 4096), "ordinary": toxicity.dictionary(framed("the house and garden river is in understand"), 8192)}
    parameters = zstandard.ZstdCompressionParameters(**toxicity._LEVEL)
    size = lambda d, w: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=parameters).compress(toxicity._HEAD + w + toxicity._TAIL))
    distance = toxicity.Distance(model["toxic"], model["ordinary"])
    text = "You IDIOT, moron! the house is in the garden " * 300
    ds = [size(model["ordinary"], w) - size(model["toxic"], w) for w in toxicity.words(text)]
    assert distance.counts(text) == [*(sum(d >= t for d in ds) for t in toxicity.THRESHOLDS), len(ds)]
    assert distance.of(b"idiot") > 0 > distance.of(b"garden") and distance.counts(None)[-1] == 0


def test_page_regions():
    html = """<html><head><title>t</title><style>x</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
    <div class="cookie-notice">We use cookies to do many things on this long line</div><div id="content"><h2>Title</h2><p>First &amp; long paragraph with
    many words <b>bold</b> in it so that it counts.<p>Ok.<ul><li>a<li>b</ul><p>Another long paragraph that has enough words to be the article.</div>
    <div class="sidebar">links</div><div id="comments"><p>I am a reader and I say a lot of words here that nobody wants in the text.</p></div><footer>f</footer></body></html>"""
    assert pages.extract(html) == "Title\nFirst & long paragraph with many words bold in it so that it counts.\nOk.\na\nb\nAnother long paragraph that has enough words to be the article."
    assert pages.extract(None) == pages.extract("") == pages.extract("<nav>x</nav>") == ""


def test_page_names_are_hints():
    """Names drop what their ratios confirm, not article text; of headers only headings count."""
    long = "A sentence of the article that goes on for quite a while, as sentences in articles do. " * 3
    page = f"""<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="elementor-widget"><div class="entry-header"><h1 class="entry-header">Title</h1>
    <span>By somebody</span></div><p>{long}</p><section class="related-work"><h2>Related work</h2><p>{long}</p></section><p>A <label>label</label> and <math><mi>x</mi></math>.</p>
    <div class="related-posts"><a href=1>One more page</a> <a href=2>Another page to read</a></div></div><div id="comments"><p>{long}</p></div></body>"""
    want = [x.strip() for x in ("Title", long, "Related work", long, "A label and x.")]
    assert pages.extract(page).split("\n") == want
    assert pages.extract(f"<body><form id=aspnet><div><h1>Title</h1><p>{long}</p></div><form><input></form></form></body>") == f"Title\n{long.strip()}"
    article = f"<article><header><h1>Title</h1><p>By somebody</p></header><p>{long}</p><footer>Tags</footer><div class=ad>Buy</div></article>"
    assert pages.extract(f"<body><main>{article}</main></body>") == f"Title\n{long.strip()}"


def test_pages_of_any_bytes():
    """Nothing in a page ends the job, and the time is linear in unclosed and stray tags."""
    import time

    r = random.Random(9)
    parts = ["<![foo bar", "<![1[", "<!", "<?", "</", "<", ">", "&#x110000;", "&", "<p>", "</p>", "<div class='ad'>", "<a href=x>", "]]>", "--", "<!--", "'", '"', "x ", "<li", "<script>", "<![CDATA[", "\x00", "\ud800"[:0]]
    for _ in range(3000):
        pages.extract("".join(r.choice(parts) for _ in range(r.randrange(1, 12))))
    assert pages.extract("<p>a</p><![1[ x ><p>b</p>") == "a\nb" and pages.extract("<![foo bar") in ("", "<![foo bar")
    for unit in ("<div>a ", "<b>a ", "a</p></i>", "<p><span>a", "<li>a"):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            pages.extract(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, unit


def test_smoothing_and_sums_by_brute_force():
    r = np.random.default_rng(3)
    x = r.random(30)
    k = lambda d: math.exp(-0.5 * (d / pages.SIGMA) ** 2) if abs(d) <= 3 * pages.SIGMA else 0.0
    want = [sum(k(i - j) * x[j] for j in range(30)) / sum(k(i - j) for j in range(30)) for i in range(30)]
    assert np.allclose(pages.smoothed(x), want)
    parser = pages.Lines()
    parser.feed("<body><div><p>aa<p>bbb<div><p>c</div></div><ul><li>dddd<li>e</ul></body>")
    parser.cut()
    page = pages.Page(parser)
    up = lambda e: [e, *(up(int(page.parent[e])) if e else [])]
    assert page.sums(page.size).tolist() == [sum(len(t) for t, _, _, e in parser.lines if n in up(e)) for n in range(len(page.tag))]


CLASHES = ["id_", "host_", "hash_", "gone_", "own_", "key_", "group_", "_id", "_hash", "_key", "_pred", "_score", "_hit", "block", "row_id", "node", "lang_pred", "score", "weight", "u", "bands", "ID_"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, odd, stage):
    """Nulls, empty and long texts, repeats, shared ids, empty tables and clashing names go through every stage; columns stay as they are."""
    name, run = stage
    many = odd.unionAll(odd.filter("doc_id = 4").withColumn("text", F.lit("another text of the same id " + "w x y z " * 30)))
    for k, c in enumerate(CLASHES[:-1]):
        many = many.withColumn(c, F.lit(k))
    got = run(spark, many, SF)
    assert got.columns == many.columns and got.schema.simpleString() == many.schema.simpleString()
    rows = got.collect()
    if name == "near_dedup":
        assert Counter((r["doc_id"], (r["text"] or "")[:7]) for r in rows) == Counter({(1, ""): 1, (2, ""): 1, (3, " \n\t "): 1, (4, "one two"): 1, (None, "one two"): 1, (6, "word wo"): 1, (7, "\U0001f600 ퟿ é ñ"): 1, (4, "another"): 1})
    elif name == "language_id":
        assert len(rows) == 6 and all(r["text"].strip() for r in rows)
    elif name == "decontamination":
        assert len(rows) == 10
    assert run(spark, many.limit(0), SF).count() == 0
    assert all(r[c] == k for r in rows for k, c in enumerate(CLASHES[:-1]))


def test_dedup_of_rows_without_ids(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(None, own(i), "en", "a", 0, "x") for i in range(5)] * 2 + [(3, own(9), "en", "a", 0, "x"), (3, own(8), "en", "a", 0, "x"), (9, own(9) + " more", "en", "a", 0, "x")]
    got = neardup.clean(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([*((0, own(i)) for i in range(5)), (3, own(9)), (3, own(8))])


def test_quality_verdicts_by_host(spark):
    """A row that stands under two hosts gets each host's verdict."""
    r = random.Random(5)
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    line = "a line that many documents of one host have in common"
    rows = [(i, own(i) + "\n" + line, "en", "one", 0, "x") for i in range(9)] + [(8, own(8) + "\n" + line, "en", "two", 0, "x")]
    r.shuffle(rows)
    got = quality.clean(spark.createDataFrame(rows, DOCS)).collect()
    assert {(x["doc_id"], x["source"]) for x in got if line in x["text"]} == {(0, "one"), (8, "two")} and len(got) == 10


def test_pipeline_stages(spark, docs):
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < len(before)
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert all(verdict[i] for i in ids)
    mixed = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(ids)
    by = defaultdict(list)
    for r in mixed:
        by[r["source"]].append(r)
    assert all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - sum(r["size"] for r in mixed)) < 1e-3 * sum(r["size"] for r in mixed) + 1


def test_lines_of_a_large_host(spark):
    r = random.Random(5)
    own = lambda i: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    line = "a passage that eight documents of a large host have"
    rows = [(i, own(i) + ("\n" + line if i % 250 == 0 else ""), "en", "big", 0, "x") for i in range(2000)]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert len(got) == 2000 and [x["doc_id"] for x in got if line in x["text"]] == [0]
    assert quality.judge(spark.createDataFrame(rows, DOCS)).filter("removed_words > 0").count() == 7


def test_windows_need_no_row_of_a_conversation(spark):
    """A conversation of 6,000 turns over several buckets: windows and contexts by brute force, and no sort of whole conversations."""
    r = random.Random(6)
    rows = [(c, i, "system" if i == 0 and c else "assistant" if i % 2 else "user", f"{i} " + "w " * r.randrange(60)) for c, n in ((None, 40), (1, 6000), (2, 3)) for i in range(n)]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {(x["conv_id"], x["window"]): (x["n_context"], x["formatted"]) for x in made.collect()}
    want = {}
    for c in (None, 1, 2):
        own = [x for x in rows if x[0] == c]
        before = np.cumsum([0, *(len(x[3].split()) + chat.OVERHEAD for x in own)])[:-1].tolist()
        for w in {b // 384 for b in before}:
            first = min(i for i, b in enumerate(before) if b // 384 == w)
            last = max(i for i, b in enumerate(before) if b // 384 == w)
            start = min(i for i, b in enumerate(before) if b >= before[first] - 128)
            order = [*([0] if own[0][2] == "system" and start else []), *range(start, last + 1)]
            want[c, w] = (sum(i < first for i in order), "".join(f"<|im_start|>{own[i][2]}\n{own[i][3]}<|im_end|>\n" for i in order))
    assert got == want
    assert 'collect_list(struct(turn' not in made._jdf.queryExecution().toString() and max(len(f) for _, f in got.values()) < 3000


def test_page_regions_are_no_single_paragraph():
    title, long, last = "A title of 20 chars.", "long words " * 45 + "end.", "The last paragraph.."
    assert pages.extract(f"<body><div><h1>{title}</h1><p>{long}</p><p>{last}</p></div></body>") == "\n".join((title, long, last))
    short = ["short words " * 16 + f"{i}." for i in range(10)]
    longest = "long words " * 1800 + "end."
    want = "\n".join([*short[:5], longest, *short[5:]])
    rows = [*short[:5], longest, *short[5:]]
    links = "<div><ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(9)) + "</ul></div>"
    assert pages.extract("<body>" + links + "<div>" + "".join(f"<p>{x}</p>" for x in rows) + "</div></body>") == want
    assert pages.extract("<body>" + links + "<div>" + "".join(f"<div><p>{x}</p></div>" for x in rows) + "</div></body>") == want


@pytest.mark.parametrize("letters", [8, 25, 2000])
def test_arcs_are_packed_in_linear_time(letters):
    """Rows of arcs are found a place without trying the same slots for each of them, and stay close together."""
    r = random.Random(6)
    words = ["".join(chr(0x4E00 + r.randrange(letters)) for _ in range(r.randint(2, 9))) for _ in range(2000)]
    codes, numbers = np.unique(langid.symbols(" ".join(r.choice(words) for _ in range(7000))[:40_000]), return_inverse=True)
    states = langid.automaton(numbers + 1)
    begun = time.process_time()
    arcs = langid.Arcs(states, len(codes) + 1)
    assert time.process_time() - begun < 20
    assert len(arcs.owner) < 3 * sum(map(len, states)) + len(codes) + 2
