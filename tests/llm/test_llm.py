"""The training-data operators against brute force, libraries, round trips and held-out rows, with the odd cases."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import materialise
from quire.llm import ann, bpe_count, common, jaccard, langid, lattice_lm, line_quality, packing, registry, toxicity, warc, wfst
from tests.conftest import SF
from tests.test_queries import norm, oracle

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n", "a", "a b", "A b c", "a  b\tc\x0bd\re", "日本語 テスト 😀", "é́ x\x1cy", "<s> x</s> <|endoftext|>", "▁a ▁▁b", "word " * 3000, "x" * 5000, "same text of a few words here", "same text of a few words here", "No! Yes!! #$%"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, odd texts, more columns with names the operators use themselves."""
    data = [(None if i == 4 else 7 if i in (5, 6) else i, t, None if i % 3 else "en", "s", 1, 2.0, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long, score double, node string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = norm(registry.queries()[name](spark, SF).toPandas()), norm(oracle(registry.oracle_sql()[name]))
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_warc_round_trip(spark):
    big = "<p>é" + "日本 text " * 9000
    html = [None, "", "short", "short", big, big, "y" * 100, "y" * 100, "\r\n\r\nWARC/1.1\r\n" * 40, "0\r\n\r\n" * 500]
    pages = spark.createDataFrame([(i, "http://x/\r\n é", h) for i, h in enumerate(html)] + [(None, None, big)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(html) + 1
    for i, h in enumerate(html):
        raw = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["complete"]) == (len(raw), hashlib.sha256(raw).hexdigest(), True)
        first = min(j for j, x in enumerate(html) if x == h)
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if len(raw) >= 100 and first != i else ("response", None))
    assert got[4]["n_segments"] > 3 and got[None]["refers_to"] == 4
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_broken_segments(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    rows = lambda name, parts, total: [(name, k, 1 if k == 1 else None, "response" if k == 1 else "continuation", None, total if k == len(parts) else None, None, None, None, p, False) for k, p in enumerate(parts, 1)]
    whole, short = [block[:20], block[20:40], block[40:]], [block[:20], block[20:]]
    data = rows("a", whole, len(block)) + rows("b", short, len(block) + 1) + [x for x in rows("c", whole, len(block)) if x[1] != 2]
    got = warc.reassemble(spark.createDataFrame(data, warc.PARSED).orderBy(F.desc("segment"))).select("payload_bytes", "complete").collect()
    assert sorted((r[0] or -1, r[1]) for r in got) == [(-1, False), (-1, False), (11, True)]


def test_line_quality(spark, odd):
    text = "Good line one is here and ends well.\n" * 1 + "\n".join(f"Word{i} other{i} third{i} fourth{i} fifth{i} ends{i}." for i in range(20))
    menu = "\n".join(["Home | About | Contact | Help"] * 3 + ["All rights reserved."] + [f"no end mark {i} in this line" for i in range(30)])
    d = spark.createDataFrame([(1, text), (2, menu), (3, text + "\nAll rights reserved.\nA | B | C")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_quality.clean(d).collect()}
    assert (got[1]["kept"], got[2]["kept"], got[3]["kept"]) == (True, False, True)
    assert got[3]["clean_text"] == text
    out = line_quality.clean(odd).where("n_words >= 0 and not kept")  # a filter above the lambdas must not repeat them
    assert out.count() == len(ODD)
    assert line_quality.clean(odd.limit(0)).count() == 0


def brute_pieces(rows):
    t = Tokenizer.from_file(WORDS)
    out = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out += [(doc, k, at, len(p := ids[at : at + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return Counter(out)


def test_packing(spark, odd, docs):
    for d in (odd, docs):
        got = packing.pack_documents(d, WORDS, group_pieces=32).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute_pieces([tuple(r) for r in d.select("doc_id", "text").collect()])
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        lengths = np.array([r["length"] for r in got])
        assert len(by) <= packing.lower_bound(lengths) + 1
    assert packing.pack_documents(odd.limit(0), WORDS).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = rng.integers(1, 101, rng.integers(1, 40))
        bins = packing.best_fit_decreasing(x, 100)
        assert np.bincount(bins, weights=x).max() <= 100 and packing.lower_bound(x, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([60, 60, 60]), 100) == 3


def test_ann(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    hot = spark.range(1000, 1400).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5)] * 64).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    bad = spark.createDataFrame([(2000, None, 1), (2100, [0.0] * 64, 1), (2200, [float("nan")] * 64, 1), (2300, [None] + [1.0] * 63, 1), (2400, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    every = e.unionByName(hot).unionByName(bad)
    got = defaultdict(list)
    for r in ann.search(every, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = e.unionByName(hot).toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        found = [v for _, v, _ in got[q]]
        assert [k for k, _, _ in got[q]] == list(range(1, 11))
        assert all(s == pytest.approx(d[ids == v][0], abs=1e-12) for _, v, s in got[q])
        hit, total = hit + len(set(want) & set(found)), total + 10
        if q >= 1000:
            assert found == want
    assert hit / total >= 0.9 and set(got) == set(int(q) for q in ids[ids % 100 == 0])
    few = ann.search(e.where("vec_id < 5"), F.col("vec_id") % 100 == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3, 4]
    assert ann.search(bad.where("vec_id < 2400"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(e.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ann_prunes_and_still_finds(spark):
    """Two hundred lists and more, of which a query reads a part; recall against brute force."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 21_000)] + 0.15 * rng.normal(size=(21_000, 16))).astype(np.float32)
    d = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in ann.search(d, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    y = x.astype(float)
    hits = 0
    for q in range(0, 21_000, 100):
        dist = ((y - y[q]) ** 2).sum(1)
        dist[q] = np.inf
        hits += len(set(np.argsort(dist, kind="stable")[:10].tolist()) & set(got[q]))
    assert 21_000 // ann.PER_LIST >= 200 > ann.PROBES and hits / 2100 >= 0.9


def test_language(spark, odd, docs):
    model = langid.train(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = docs.select("doc_id", "lang").join(langid.identify(docs, model), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    out = langid.identify(odd, model, keep=("text", "n", "source")).collect()
    assert len(out) == len(ODD) and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    assert langid.identify(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(docs.limit(0), F.lit(True))).collect()} == {"und"}


def model_of(identifier, lang):
    return next(b.models[b.languages.index(lang)] for b in identifier.blocks() if lang in b.languages)


def test_cut_arrays_keep_full_counts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 5, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(30)) for _ in range(40)]
    d = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)] + [(100, "abc cba", "b")], "doc_id long, text string, lang string")
    g, n = np.unique(langid.codes(texts)[0], return_counts=True)
    whole = model_of(langid.train(d, F.lit(True)), "a")
    want = langid.KneserNey(g, n, whole.alphabet)
    assert np.allclose(whole.log2(g), want.log2(g), rtol=0, atol=1e-12)
    monkeypatch.setattr(langid, "MAX_NGRAMS", 100)
    cut = model_of(langid.train(d, F.lit(True)), "a")
    for few, full in zip(cut.levels, want.levels, strict=True):
        assert len(few[0]) <= 130 and len(few[2]) <= 130 and len(few[0]) >= min(70, len(full[0]))
        for keys, value in ((0, 1), (2, 3)):
            at = np.searchsorted(full[keys], few[keys])
            assert np.array_equal(full[keys][at], few[keys]) and np.allclose(full[value][at], few[value])
    # what was cut weighs in the back-off: after every context the letters' probabilities sum to one
    letters = sorted({int(x & np.uint64(0xFFFF)) for x in g})
    assert len(letters) == whole.alphabet - 1
    contexts = sorted({int(x) >> 16 << 16 for x in g})
    lowest = cut.levels[-1]
    outside = 1 - sum(np.exp2(cut.log2(np.array([0xFFFE << 48 | 0xFFFE << 32 | 0xFFFE << 16 | c for c in letters], np.uint64))))
    for context in contexts:
        p = np.exp2(cut.log2(np.array([context | c for c in letters], np.uint64)))
        assert 0.9 < p.sum() <= 1 + 1e-9 and 1 - p.sum() <= outside + 1e-9
    assert len(lowest[0]) == len(letters)


def test_languages_in_blocks_equal_all_at_once(spark, docs, odd, monkeypatch):
    columns = ["doc_id", "lang_pred", "rejected", F.round("score", 9).alias("score"), F.round("bits_per_char", 9).alias("bits")]
    told = lambda d, m: sorted(map(str, langid.identify(d, m).select(*columns).collect()))
    whole = langid.train(docs, F.lit(True))
    want = told(docs, whole), told(odd, whole)
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 1)
    parts = langid.train(docs, F.lit(True))
    assert len(parts.languages) > 2 and sum(1 for _ in parts.blocks()) == len(parts.languages)
    assert (told(docs, parts), told(odd, parts)) == want and parts.limit == pytest.approx(whole.limit)


def test_rare_language_is_calibrated(spark, monkeypatch):
    import corpus_pipeline as c

    monkeypatch.setattr(langid, "CALIBRATION_TEXTS", 40)
    rng = np.random.default_rng(4)
    text = lambda alphabet: " ".join("".join(rng.choice(list(alphabet), 6)) for _ in range(20))
    rows = [(None if k % 2 else k, text("abcdefg"), "a") for k in range(600)] + [(1000 + k, text("tuvwxyz"), "b") for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, F.lit(True))
    assert model.languages == ["a", "b"] and np.isfinite(list(model.limit.values())).all()
    # repeated rows count once, so they leave a language's calibration as it is
    again = d.union(d.where("doc_id = 0").crossJoin(spark.range(5000)).select("doc_id", "text", "lang"))
    for rows_ in (d, again):
        assert Counter(r["lang"] for r in langid.calibration_sample(rows_).collect()) == {"a": 50, "b": 20}
    few = langid.train(d.where("lang = 'a' or doc_id < 1003"), F.lit(True))
    assert np.isfinite(few.limit["b"]) and few.limit["b"] > model.limit["b"]
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert c.drop_unidentified(spark, none, SF).count() == len(rows)


def test_kneser_ney_equals_the_recursion():
    texts = ["abab abba cab", "baab ca", "ccb abc"]
    padded = ["   " + t + " " for t in texts]
    four = Counter(t[k : k + 4] for t in padded for k in range(len(t) - 3))
    orders = {4: four}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])

    def p(gram):
        if not gram:
            return 1 / m.alphabet
        c = orders[len(gram)]
        followers = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not followers:
            return p(gram[1:])
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d, total = (min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5), sum(followers.values())
        return max(followers.get(gram, 0) - d, 0) / total + d * len(followers) / total * p(gram[1:])

    grams, counts = np.unique(langid.codes(texts)[0], return_counts=True)
    m = langid.KneserNey(grams, counts, 5)
    new = "abc cabz ba"
    got = m.log2(langid.codes([new])[0])
    padded = "   " + new + " "
    assert np.allclose(got, [math.log2(p(padded[k : k + 4])) for k in range(len(padded) - 3)])


def test_kneser_ney_sums_to_one():
    grams, _ = langid.codes(["abab abba", "baab"])
    g, n = np.unique(grams, return_counts=True)
    letters = sorted({int(x & np.uint64(0xFFFF)) for x in g})
    m = langid.KneserNey(g, n, len(letters))
    context = int(g[0]) >> 16 << 16
    assert np.exp2(m.log2(np.array([context | c for c in letters], np.uint64))).sum() == pytest.approx(1)


def brute_groups(rows, percent=90, words=3):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    parent, lists = list(range(len(sets))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (_, s) in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                parent[find(k)] = find(j)
        for g in s:
            lists[g].append(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def near_copies(n_words, edits, copies, seed, start):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, n_words)]
    out = []
    for c in range(copies):
        w = list(base)
        for at in rng.integers(0, n_words, edits):
            w[at] = f"e{rng.integers(0, 10**9)}"
        out.append((start + c, " ".join(w)))
    return out


def test_similarity_join(spark, odd, docs):
    rows = near_copies(12, 0, 3, 1, 0) + near_copies(200, 1, 60, 2, 100) + near_copies(200, 5, 60, 3, 200) + near_copies(40, 1, 30, 4, 300) + near_copies(3000, 40, 20, 5, 400)
    rows += [(500 + i, " ".join([*(f"p{j}" for j in range(60)), *(f"u{i}x{j}" for j in range(60))])) for i in range(80)]  # a passage many share
    rows += [(600, "a b"), (601, "A B"), (602, "a"), (603, None), (604, ""), (None, "a b"), (605, rows[100][1].upper()), (605, "other text altogether")]
    rows += [(700, " ".join(f"q{j}" for j in range(12))), (701, " ".join(f"q{j}" for j in range(11)))]  # 10 and 9 windows: exactly 90
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for part, data in ((d, rows), (odd, [tuple(r) for r in odd.select("doc_id", "text").collect()]), (docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])):
        got = Counter(tuple(r) for r in jaccard.link(part).select("doc_id", "n_shingles", "component_id").collect())
        want = brute_groups(data)
        assert got == want, ((got - want), (want - got))
    assert jaccard.link(d.limit(0)).count() == 0


def test_near_copies_of_five_words(spark):
    rows = near_copies(12, 0, 3, 1, 0) + near_copies(200, 3, 40, 2, 100) + near_copies(200, 9, 40, 3, 200) + near_copies(40, 1, 20, 4, 300) + near_copies(3000, 90, 12, 5, 400)
    rows += [(500 + i, " ".join([*(f"p{j}" for j in range(60)), *(f"u{i}x{j}" for j in range(60))])) for i in range(40)]
    rows += [(600, "a b c d"), (601, "A B c d"), (602, None), (None, "a b c d"), (603, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard.link(d, words=5, percent=80).select("doc_id", "n_shingles", "component_id").collect())
    want = brute_groups(rows, percent=80, words=5)
    assert got == want, ((got - want), (want - got))


def test_long_texts_are_shingled_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcé \n"), 9)) for _ in range(rng.integers(0, 200))).encode() for _ in range(20)] + [b"", b" ", b"x" * 3000, b"a b " * 2000]
    whole = jaccard.Shingler(3).sets(texts)
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, jaccard.Shingler(3).sets(texts), strict=True))


def test_texts_of_megabytes(spark):
    long = " ".join(f"w{i % 5003} x{i % 4999}" for i in range(400_000))
    d = spark.createDataFrame([(1, long), (2, long + " end"), (3, "y" * 300_000), (4, "short text")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.link(d).collect()) == [1, 1, 3, 4]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in bpe_count.count_tokens(d.where("doc_id in (1, 4)"), PIECES).collect()}
    assert got == {1: len(sp.encode(long)), 4: len(sp.encode("short text"))}
    scored = {r["doc_id"]: r for r in lattice_lm.score_documents(d.where("doc_id in (3, 4)"), PIECES, F.lit(True), steps=1).collect()}
    assert scored[3]["n_tokens"] == 2 and math.isfinite(scored[3]["score"]) and scored[3]["score"] < scored[4]["score"]
    packed = packing.pack_documents(d, WORDS)
    assert packed.where("length > 2048").isEmpty() and packed.where("doc_id = 1").agg(F.sum("length")).first()[0] == len(Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids) + 1


def test_word_tokenizer_equals_library():
    t, library, rng = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS), np.random.default_rng(1)
    assert t.by_word
    parts = [*"aAbBzÜüßÿÀÖØøœ'.,#<|>_ -!?09é́İſKÅ\x1c", "'s", "<|endoftext|>", "<|startoftext|>", "ab", "\u2003", "\n"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3000)] + ["x" * 3000, "straßenüberführung", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.ids(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, library = packing.WordTokenizer(path), Tokenizer.from_file(path)
    texts = ["Some Text,  with spaces", "", "abc\n\nABC"]
    assert not t.by_word and [np.frombuffer(x, "<u4").tolist() for x in t.ids(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_parity_sketch_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for size in [500] * 25 + [1000] * 25:
        s = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        t = np.unique(np.r_[s[20:], rng.integers(0, 1 << 63, 30, np.uint64)])
        a, b = jaccard.parity_sketch(s), jaccard.parity_sketch(t)
        while len(a) != len(b):  # one is folded to the size of the other
            a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :])
        bits = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        short = sum(int(x).bit_count() for x in (jaccard.fold(a) ^ jaccard.fold(b)).view(np.uint64))
        assert short <= bits <= len(np.setxor1d(s, t))


def test_transducer_equals_library(spark, odd, texts):
    sp, t = sentencepiece.SentencePieceProcessor(model_file=PIECES), wfst.transducer(PIECES)
    rng = np.random.default_rng(5)
    mixed = ["".join(rng.choice(list(" \n▁ab<s>é日the er\x00in"), rng.integers(1, 40))) for _ in range(500)]
    for x in [x or "" for x in ODD] + mixed + list(texts.values())[:80]:
        assert t.encode(x).tolist() == sp.encode(x)
        assert t.decode(t.encode(x)) == x.replace("▁", " ")
    got = wfst.encode(odd, PIECES).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in odd.collect())
    back = wfst.decode(wfst.encode(odd, PIECES), PIECES).collect()
    assert Counter(r["text"] for r in back) == Counter((x or "").replace("▁", " ") for x in ODD)


def test_unigram_paths_are_shortest():
    """The file's ranks taken as costs: the path is the cheapest of all, by enumeration."""
    t = wfst.Transducer(PIECES, "unigram")
    assert wfst.Transducer(PIECES).kind == "bpe"

    def cheapest(chunk):
        best = {0: 0.0}
        for i in range(len(chunk)):
            for j in range(i + 1, len(chunk) + 1):
                cost = t.ranks.get(chunk[i:j], t.unknown_cost if j == i + 1 else math.inf)
                if i in best and best[i] + cost < best.get(j, math.inf):
                    best[j] = best[i] + cost
        return best[len(chunk)]

    for word in ["there", "é😀x", "zzq", "a\nb", "international"]:
        path = t.shortest("▁" + word)
        cost, k = 0.0, 0
        byte = set(t.byte_id.values())
        while k < len(path):
            if path[k] in byte:  # a character's bytes count once
                first = next(b for b, i in t.byte_id.items() if i == path[k])
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                cost += t.unknown_cost
            else:
                cost, k = cost + t.ranks[t.pieces[path[k]]], k + 1
        assert cost == pytest.approx(cheapest("▁" + word))


def test_normaliser_is_read_from_the_file():
    field = lambda n, v: bytes([n << 3, v])
    spec = lambda *f: {3: [b"".join(f)]}
    assert wfst.Normaliser(spec(field(3, 0), field(4, 1)))("  a  b ") == "a▁b"
    assert wfst.Normaliser(spec(field(3, 1), field(4, 0)))(" a") == "▁▁a"
    for refused in (spec(b"\x12\x01x"), spec(field(5, 0))):
        with pytest.raises(ValueError):
            wfst.Normaliser(refused)


def test_token_counts_equal_library(odd, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for d in (odd, docs):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 4096) for r in d.collect())
        assert Counter(tuple(r) for r in bpe_count.count_tokens(d, PIECES).collect()) == want
    assert bpe_count.count_tokens(odd.limit(0), PIECES).count() == 0


def test_lattice_forward_is_the_sum_over_segmentations():
    v = lattice_lm.pieces(PIECES)
    word = "▁there"

    def every(at):
        if at == len(word):
            return 1.0
        return sum(math.exp(v.start[v.index[word[at:k]]]) * every(k) for k in range(at + 1, len(word) + 1) if word[at:k] in v.index)

    assert lattice_lm.marginals(v, v.start, ["there"])[0] == pytest.approx(math.log(every(0)))
    assert np.isfinite(lattice_lm.marginals(v, v.start, ["😀🤔x", "\x00", "a" * 300])).all()
    e = lattice_lm.expected(v, v.start, ["ab"], np.array([2.0]))
    assert 2 <= e.sum() <= 6


def segmentations(v, word):
    """All ways of a word over pieces, and over bytes where a character is no piece."""
    if not word:
        return [()]
    ways = [(v.index[word[:k]], *rest) for k in range(1, len(word) + 1) if word[:k] in v.index for rest in segmentations(v, word[k:])]
    if word[0] not in v.index:
        ways += [(*(v.bytes + b for b in word[0].encode()), *rest) for rest in segmentations(v, word[1:])]
    return ways


def test_expectation_maximisation_equals_enumeration(spark):
    v = lattice_lm.pieces(PIECES)
    counts = {"the": 5, "there": 2, "ab": 1, "é😀x": 3, "rare": 1}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    logp, ends = v.start, 4
    for _ in range(2):
        mass = np.zeros(v.size)
        for w, n in counts.items():
            ways = segmentations(v, "▁" + w)
            p = np.array([math.exp(sum(logp[i] for i in way)) for way in ways])
            for way, x in zip(ways, n * p / p.sum(), strict=True):
                for i in way:
                    mass[i] += x
        mass[v.end] += ends
        p = mass + lattice_lm.SMOOTHING * np.exp(v.start) * v.size
        logp = np.log(p / p.sum())
    got = lattice_lm.fit_pieces(rows, ends, PIECES, steps=2)
    assert np.allclose(got, logp, rtol=0, atol=1e-9)
    for w in counts:
        assert lattice_lm.marginals(v, got, [w])[0] == pytest.approx(math.log(sum(math.exp(sum(got[i] for i in way)) for way in segmentations(v, "▁" + w))))


def test_long_words_in_parts(monkeypatch):
    v = lattice_lm.pieces(PIECES)
    words = ["ab" * 90, "日本😀the" * 30, "x" * 101]
    whole, mass = lattice_lm.marginals(v, v.start, words), lattice_lm.expected(v, v.start, words, np.ones(3))
    monkeypatch.setattr(lattice_lm, "LONG", 50)
    assert np.allclose(lattice_lm.marginals(v, v.start, words), whole) and np.allclose(lattice_lm.expected(v, v.start, words, np.ones(3)), mass)


@pytest.mark.parametrize("frequent", [10, 10**6])
def test_lattice_scores(odd, docs, frequent):
    for d in (docs, odd):
        rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        tokens = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
        c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
        ends = held.count(False)
        total, kinds = sum(c.values()) + ends, len(c) + 1
        want = Counter((i, len(ws) + 1, sum(w in c for w in ws) + 1, total, round(sum(math.log10((n + 1) / (total + kinds + 1)) for n in [*(c[w] for w in ws), ends]), 5)) for (i, _), ws in zip(rows, tokens, strict=True))
        training = ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
        got = lattice_lm.score_documents(d, PIECES, training, frequent, steps=0).collect()
        v = lattice_lm.pieces(PIECES)
        sums = Counter((i, round((lattice_lm.marginals(v, v.start, WORD.findall((t or "").translate(LOWER))).sum() + v.start[v.end]) / math.log(10), 4)) for i, t in rows)
        assert Counter((r["doc_id"], round(r["score"], 4)) for r in got) == sums
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_toxicity(spark, docs, odd):
    words = ["scum", "moron", "idiot"]
    rng = np.random.default_rng(1)
    vocab = [f"plain{i}" for i in range(400)]
    data = []
    for i in range(1200):
        w = list(rng.choice(vocab, 60))
        if i % 8 == 0:
            w[5] = words[i % 3]
        data.append((i, " ".join(w)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(1200) if i % 2 == 0 or i % 8 == 0], "doc_id long, toxic int")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.train(d, labels, training)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(d, model).collect()}
    assert all(got[i] == int(i % 8 == 0) for i in got)
    out = toxicity.classify(odd, model, keep=("text", "source", "n")).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.classify(odd.limit(0), model).count() == 0
    none = toxicity.train(d, labels.limit(0), training)
    assert {r["predicted"] for r in toxicity.classify(odd, none).collect()} == {0}


def test_non_negative_risk_is_least():
    rng = np.random.default_rng(2)
    prior = 0.2
    positive = (rng.random((400, 1)) < 0.9).astype(np.uint8)
    unlabelled = (rng.random((2000, 1)) < 0.2 * 0.9 + 0.8 * 0.1).astype(np.uint8)

    def risk(w, b):
        gp, gu = positive[:, 0] * w + b, unlabelled[:, 0] * w + b
        return prior * np.logaddexp(0, -gp).mean() + max(0.0, np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())

    w, b = toxicity.nnpu(positive, unlabelled, prior)
    assert risk(float(w[0]), b) <= min(risk(x, y) for x in np.linspace(-8, 8, 81) for y in np.linspace(-8, 8, 81)) + 0.005


#: Columns of each query's contract, in order.
COLUMNS = {
    "op3": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op4": ["query_id", "rank", "vec_id", "score"], "op5": ["doc_id", "held_out", "lang_pred", "score"], "op6": ["doc_id", "n_shingles", "component_id"],
    "op8": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op9": ["doc_id", "held_out", "score", "predicted"], "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_queries_keep_their_contract(spark, docs, n):
    name = next(q for q in registry.queries() if q.startswith(n + "_"))
    got = materialise(registry.queries()[name](spark, SF), "contract")
    assert got.columns[: len(COLUMNS[n])] == COLUMNS[n]
    rows = got.collect()
    fold = {"op5": (4, 2), "op8": (7, 2), "op9": (5, 0)}.get(n)
    if fold:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) for r in rows)
    if n not in ("op3", "op4"):
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    if n == "op6":
        assert Counter(tuple(r)[:3] for r in rows) == brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    if n == "op3":
        assert Counter(tuple(r)[:5] for r in rows) == brute_pieces([tuple(r) for r in docs.select("doc_id", "text").collect()])
    if n == "op5":
        held = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
        right = [r["lang_pred"] == held[r["doc_id"]] for r in rows if r["held_out"]]
        assert sum(right) / len(right) > 0.95
    if n == "op10":
        sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        want = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
        assert all((r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(want[r["doc_id"]].encode()), len(sp.encode(want[r["doc_id"]])), len(sp.encode(want[r["doc_id"]])) > 4096) for r in rows)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as c

    names = ["score", "predicted", "lang_pred", "bits_per_char", "rejected", "fingerprint", "node", "component", "n", "kept_row", "a b", "near_copies_id"]
    rows = [(i, f"plain words of a text number {i} that say little and are all alike {i * 7}", "en", *[f"{x}{i}" for x in names]) for i in range(60)] + [(None, None, None, *names), (3, "", "en", *names)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{x}` string" for x in names))
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        assert {tuple(r) for r in out.collect()} <= set(rows) and stage(spark, d.limit(0), SF).count() == 0


def test_run_equals_its_stages_by_hand(spark, docs, texts):
    """run(): what is packed is what toxicity and language leave, one of each brute-force group, all of it and whole."""
    import corpus_pipeline as c

    got = materialise(c.run(spark, SF), "run")
    left = c.drop_unidentified(spark, materialise(c.drop_toxic(spark, docs, SF), "t"), SF)
    ids = {r["doc_id"] for r in left.select("doc_id").collect()}
    keep = {g for _, _, g in brute_groups([(i, texts[i]) for i in ids], percent=80, words=5)}
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == brute_pieces([(i, texts[i]) for i in keep])


def test_pipeline_stages(spark, docs, texts):
    import corpus_pipeline as c

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now = docs
    for name, stage in c.STAGES[:-1]:
        before = {r["doc_id"] for r in now.select("doc_id").collect()}
        now = materialise(stage(spark, now, SF), name)
        after = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert now.columns == docs.columns and set(after) <= before and len(after) == len(set(after))
        if name == "near_copies":
            left = brute_groups([(i, texts[i]) for i in before], percent=80, words=5)
            assert set(after) == {g for _, _, g in left}
        if name == "toxicity":
            assert sum(labels.get(i) == 0 for i in before - set(after)) <= 1
    packed = c.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == len(after)


def test_near_copies_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline as c

    words = lambda name: " ".join(f"{name}{j}" for j in range(12))
    rows = [(None, words("a")), (None, words("b")), (None, words("c")), (None, words("c")), (None, words("d")), (1, words("d"))]  # null ids: a, b, c stay, d goes with 1
    rows += [(7, words("e")), (7, words("f")), (7, words("f")), (7, words("g")), (3, words("g").upper()), (9, words("a")), (7, words("h")), (8, words("h"))]
    rows += [(None, None), (None, ""), (20, ""), (21, ""), (21, "")]
    d = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, fingerprint string, n int")
    got = c.drop_near_copies(spark, d, SF)
    want = {(None, words("b")), (None, words("c")), (1, words("d")), (7, words("e")), (7, words("f")), (3, words("g").upper()), (9, words("a")), (7, words("h"))} | {(None, None), (None, ""), (20, ""), (21, "")}
    assert got.columns == d.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)


def test_entry_survives_without_these_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    names = json.loads(said.stdout.strip().splitlines()[-1])
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_what_is_not_loaded_is_looked_up(spark, docs, odd, monkeypatch):
    """Models that do not fit at once give what whole ones give, and limits come from all training texts."""
    columns = ["doc_id", "lang_pred", "rejected", F.round("score", 9).alias("score"), F.round("bits_per_char", 9).alias("bits")]
    told = lambda d, m: sorted(map(str, langid.identify(d, m).select(*columns).collect()))
    whole = langid.train(docs, F.lit(True))
    want = told(docs, whole), told(odd, whole)
    monkeypatch.setattr(langid, "MAX_NGRAMS", 500)
    monkeypatch.setattr(langid, "RANGE_ROWS", 40)
    cut = langid.train(docs, F.lit(True))
    assert next(cut.blocks()).cut and sum(1 for _ in cut.ranges(cut.languages)) > 2
    assert (told(docs, cut), told(odd, cut)) == want and cut.limit == pytest.approx(whole.limit) and cut.slope == whole.slope
    own = {x: [r["own"] for r in rows] for x, rows in groupby(sorted(langid.measure(docs.select("lang", F.xxhash64("doc_id").alias("h"), "text"), whole).where("n >= 50").collect(), key=lambda r: r["lang"]), lambda r: r["lang"])}
    assert whole.limit == pytest.approx({x: 1.2 * np.quantile(v, 0.999) + 0.1 + 4 / math.sqrt(len(v)) for x, v in own.items()})


def test_workers_drop_what_other_operators_keep():
    made = common.kept(lambda k: [k])
    other = common.kept(lambda k: [k])
    a, b = made(1), other(1)
    common.release_memory(made)
    assert made(1) is a and other(1) is not b
