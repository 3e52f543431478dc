"""Ranked search, phrases, personal data and the training samples against brute force, with the odd cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import phrases, pii, ranked_search, toxicity
from tests.conftest import SF
from tests.llm.test_llm import LOWER, docs, odd, texts  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranking(rows, items, k=10):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in rows]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    total = sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = {}
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(TERM.findall((t or "").translate(LOWER)))
    for i, words in wanted.items():
        scored = []
        for d, b, n in bags:
            m = 10 + (90 * n * len(bags)) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in words if b[w])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[i, rank] = (d, -s)
    return out


def ranking(found):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()}


@pytest.fixture(scope="module")
def lengths(spark):
    """Equal lengths in a hot stratum, ties, a long text, odd rows."""
    rng = np.random.default_rng(3)
    word = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(word, 12))) for k in range(400)] + [(1000 + k, " ".join(rng.choice(word, 1 + k % 40))) for k in range(200)]
    rows += [(7, "W1 w2 É 日本"), (7, "W1 w2 É 日本"), (None, "w1 w2"), (None, "w1, w2!"), (5000, None), (5001, ""), (5002, "--- !!"), (5003, "w1 " * 20_000 + "rare")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, m string, rank int")


def test_ranked_search(spark, lengths, odd, monkeypatch):  # noqa: F811
    rows, d = lengths
    items = [(1, "w1 w2 w2 w3"), (2, "É"), (3, None), (4, "nothing of it"), (5, "RARE w9"), (6, "w5"), (6, "w6 w1"), (None, "w1"), (8, " ".join(f"w{k}" for k in range(60)))]
    asked = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(ranked_search, "FIRST_STRATA", 2)
    monkeypatch.setattr(ranked_search, "PORTION", 500)
    want = brute_ranking(rows, items)
    for postings in (7, 100_000):
        monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
        index = ranked_search.build(d)
        sizes = index.blocks.select(F.size("places").alias("p"), F.size("docs").alias("n")).collect()
        assert all(r["p"] <= postings or r["n"] == 1 for r in sizes)
        assert ranking(ranked_search.search(index, asked)) == want
    monkeypatch.setattr(ranked_search, "SLICE_TERMS", 10)  # items in several slices
    assert ranking(ranked_search.search(index, asked)) == want
    assert ranking(ranked_search.search(index, asked, k=3)) == {k: v for k, v in want.items() if k[1] <= 3}
    assert ranked_search.search(ranked_search.build(d.limit(0)), asked).count() == 0 and ranked_search.search(index, asked.limit(0)).count() == 0
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert ranking(ranked_search.search(ranked_search.build(odd), asked)) == brute_ranking(rows, items)


def brute_phrases(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i : i + k]] = max(within[p[i : i + k]], a)
        rows_ = []
        for p, a in found.items():
            if 100 * within[p] < 100 * a:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), (c[p[:k]], c[p[k:]])))
        out += [(lang, r, p.decode(), -a, *lr, n[lang], -s) for r, (s, a, p, lr) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def test_phrases(spark, odd, monkeypatch):  # noqa: F811
    rng = np.random.default_rng(9)
    word = ["a", "b", "ab", "é", "日本", "x\x01y", "Zz", "ß", "-"]
    rows = [(" ".join(rng.choice(word, 30)) + "." * (k % 3) + "A b,a B\ta b", ["en", None, "de"][k % 3]) for k in range(90)]
    rows += [("a a a a a a", "en"), ("one two three four five six", "fr")] * 8 + [(None, "en"), ("", None), ("..!", "xx"), ("x" * 40_000 + " b", "en")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, n int, score int").repartition(7)
    tell = lambda df: sorted(tuple(r) for r in df.collect())
    want = brute_phrases(rows, 5, 40)
    assert tell(phrases.mine(d, least=5, top=40)) == want and len(want) > 50
    for name, size in (("CHUNK", 300), ("SHARD", 20), ("PART", 6), ("RANGE", 40), ("UNITED", 3), ("HELD", 50), ("GROUP_WORDS", 500), ("FILTER_BITS", 24)):
        monkeypatch.setattr(phrases, name, size)
    assert tell(phrases.mine(d, least=5, top=40)) == want
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)  # a filter that lets all through costs work, not results
    assert tell(phrases.mine(d, least=3, top=40)) == brute_phrases(rows, 3, 40)
    assert tell(phrases.mine(odd, least=1)) == brute_phrases([tuple(r) for r in odd.select("text", "lang").collect()], 1, 2000)
    assert phrases.mine(d.limit(0)).count() == 0


def test_counts_over_a_byte(spark):
    rows = [("p q", "en")] * 700 + [("r s. q p", "en")] * 299 + [("s t", "en")] * 301
    d = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in phrases.mine(d, least=300).collect()) == brute_phrases(rows, 300, 2000)


def test_transducers():
    rng = np.random.default_rng(2)
    draw = lambda n: {tuple(rng.choice(list("abcd"), rng.integers(1, 6))): int(rng.integers(1, 50)) for _ in range(n)}
    for n in (0, 1, 5, 300):
        x, y = draw(n), draw(n)
        t = phrases.Transducer.of(sorted(x.items()))
        assert list(t) == sorted(x.items())
        again = next(phrases.Transducer.read(t.row("en", min(x, default=("",)), len(x))))[2]
        assert list(again) == sorted(x.items())
        both = dict(t.compose(phrases.Transducer.of(sorted(y.items()))))
        assert both == {p: x[p] + y[p] for p in x.keys() & y.keys()}
    # equal endings are one: 4 ** 5 phrases of five words and one weight need six states
    full = sorted((tuple(p), 7) for p in np.array(np.meshgrid(*[list("abcd")] * 5)).reshape(5, -1).T.tolist())
    assert len(phrases.Transducer.of(full).arcs) == 6
    h = np.sort(rng.integers(0, 1 << 48, 1000).astype(np.uint64))
    for part in (h, h[:1], h[:0], np.arange(9, dtype=np.uint64)):
        got = phrases.unpack(phrases.pack(part, np.arange(len(part)) % 200))
        assert np.array_equal(got[0], part) and np.array_equal(got[1], np.arange(len(part)) % 200)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    def good(k, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if k == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if k == 2:
            return 14 <= len(digits) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(digits[::-1])) % 10 == 0
        return k == 0 or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if good(k, m.group()))


def test_base_spans(texts):  # noqa: F811
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("0123459+-.@ a()é"), 60)) for _ in range(3000)]
    made += ["1.2.3.4.5.6.7.8.9", "a@b.c@d.e x.@y.z1.2.3", "@@a@b.c", "4845168114407329-4845168114407329", "+1 +12 (3)4567890123- .", "01.02.0003.255 1.2.3.256", "", "٣٤٥.1.2.3.4"]
    for t in [*texts.values(), *made]:
        assert pii.base_spans(t or "")[0] == brute_base(t), t


def test_long_numbers_take_time_in_proportion():
    for t in ("1" * 300_000, "256." * 200_000, "+1" * 200_000, "a." * 200_000, "a@" * 200_000, "0" * 200_000 + ".1.2.3"):
        assert pii.base_spans(t)[0] == ([(0, 1, len(t))] if t.endswith(".3") else [])


@pytest.fixture(scope="module")
def tagger(docs):  # noqa: F811
    return pii.train(docs.union(docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def test_personal_data(spark, tagger, odd):  # noqa: F811
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, want, held, hit = Counter(), Counter(), 0, 0
    for r in pii.digest(pii.find(d, tagger)).collect():
        told = [x for x in r["spans"].split(",") if x]
        got[r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], len(told) - r["n_added"]] += 1
    for r in d.select("doc_id", "text").collect():
        base = brute_base(r["text"])
        told = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        want[r["doc_id"], *(sum(b[1] == i for b in base) for i in range(4)), hashlib.sha256(",".join(told).encode()).hexdigest(), len(base)] += 1
        proposed = list(pii.proposals(r["text"], tagger))
        assert set(base) <= set(pii.reconcile(r["text"], base, proposed))
        held, hit = held + len(base), hit + len({p[:3] for p in proposed} & set(base))
    assert got == want
    assert held > 50 and hit >= 0.95 * held  # what the patterns label, the model finds by itself
    # numbers that stand together are one match, which the checks drop; the model tells them apart
    near = {1: "to the +1 (826) 555-4081 190.137.223.204 of it", 2: "so the 4845168114407329 4845168114407329 was", 3: "no 9807915762804490 number", 4: "Version 3.0. of 12 May 2021, page 4711"}
    frame = spark.createDataFrame([(k, t, "x") for k, t in near.items()], "doc_id long, text string, base string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(frame, tagger)).collect()}
    assert "phone:7:24" in spans[1] and "ip:25:40" in spans[1]
    assert spans[2] == "card:7:23,card:24:40" and spans[3] == "" and spans[4] == ""
    out = pii.digest(pii.find(odd, tagger)).collect()
    assert len(out) == odd.count() and all(r["spans"] == "" for r in out)
    assert pii.find(odd.limit(0), tagger).count() == 0 and pii.train(odd.limit(0)) is None and pii.train(odd) is None
    assert {r["spans"] for r in pii.digest(pii.find(frame.where("doc_id = 1"), None)).collect()} == {"ip:25:40"}


def test_windows_hold_short_spans_whole(tagger):
    for gap in range(0, 200, 7):
        text = "x " * gap + "call +1 (826) 555-4081 now"
        spans = {(k, text[s:e]) for s, k, e, p in pii.proposals(text, tagger) if p >= pii.LEAST}
        assert spans == {(3, "+1 (826) 555-4081")}


def test_reconciled_spans_weigh_most():
    text = "4845168114407329 4845168114407329 +1 (826) 555-4081"
    found = [(0, 2, 16, 0.9), (17, 2, 33, 0.8), (0, 2, 16, 0.7), (34, 3, 51, 0.6), (37, 3, 51, 0.99), (0, 2, 15, 1.0), (17, 2, 33, 0.4)]
    assert pii.reconcile(text, [], found) == [(0, 2, 16), (17, 2, 33), (34, 3, 51)]
    assert pii.reconcile(text, [(20, 0, 22)], found) == [(0, 2, 16), (20, 0, 22), (34, 3, 51)]


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    t = pii.Tagger(hidden=3, embedded=3)
    t.p = {k: v.astype(np.float64) + 0.1 * rng.normal(size=v.shape) for k, v in t.p.items()}
    x = rng.integers(0, 20, (4, pii.WIDTH)).astype(np.int8)
    y = np.zeros_like(x)
    y[0, 3], y[0, 4:9], y[1, 7], y[1, 8:10] = 1, 2, 5, 6
    _, grad = t.slope(x, y)
    for name, at in (("embed", (int(x[0, 0]), 1)), ("in", (0, 1, 2)), ("own", (1, 2, 7)), ("bias", (0, 5)), ("out", (2, 6)), ("out_bias", (1,)), ("step", (0, 1)), ("start", (0,))):
        old, values = t.p[name][at], []
        for e in (1e-4, -1e-4):
            t.p[name][at] = old + e
            values.append(t.slope(x, y)[0])
        t.p[name][at] = old
        assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-4, rel=0.02, abs=2e-3)


@pytest.mark.parametrize("toxic", [0, 1])
def test_sample_stays_in_its_bounds(spark, docs, monkeypatch, toxic):  # noqa: F811
    """A third of all rows have one id: the same text, or one each."""
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 60)
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 20)
    d = docs.select("doc_id", "text")
    hot = [(10**6, "a hot text of no worth" if k % 2 else f"text number {k} of the hot id") for k in range(100)]
    every = d.unionByName(spark.createDataFrame(hot, "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic")).union(spark.createDataFrame([(10**6, toxic)] * 3, "doc_id long, toxic int"))
    fold = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = toxicity.draw(every, fold).collect()
    sizes = Counter(r["part"] for r in chosen)
    assert sizes["u"] == 60 and 0 < sizes["p"] <= 20 and len({(r["h"], r["part"]) for r in chosen}) == len(chosen)
    hashes = {r["h"] for r in every.where("doc_id = 1000000").select(toxicity.row_hash()).distinct().collect()}
    assert len(hashes) == 51
    assert (sum(r["part"] == "p" and r["h"] in hashes for r in chosen) > 0) == bool(toxic)
    model = toxicity.train(every, labels, F.lit(True))
    assert toxicity.classify(every, model).count() == every.count()
