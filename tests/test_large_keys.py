"""Operators whose work must not grow with the pairs of one key, against plain folds and loops."""

import random

import pytest

from quire.operators import annotations as an
from quire.operators import pages as pa
from quire.operators import structure as st


def fold(sizes, cap):
    out, total, pack = [], 0, 0
    for x in sizes:
        x = max(0, x or 0)
        if pack and total + x <= cap:
            total += x
        else:
            pack, total = pack + 1, x
        out.append(pack)
    return out


@pytest.mark.parametrize("segment", [4096, 7])
def test_pack_equals_the_fold(spark, monkeypatch, segment):
    rng = random.Random(3)
    monkeypatch.setattr(st, "SEGMENT", segment)
    data = {k: [rng.choice([0, 0, 1, 3, 5, 9, 10, 11, 30, None, -4]) for _ in range(rng.randrange(1, 150))] for k in [*range(20), None]}
    rows = [(k, i, x, "t") for k, v in data.items() for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "k int, i int, s int, ptr string").repartition(5)
    got = {(r["k"], r["i"]): r["pack"] for r in st.pack_sequential(d, ["k"], ["i"], "s", 10).collect()}
    assert got == {(k, i): p for k, v in data.items() for i, p in enumerate(fold(v, 10))}
    assert st.pack_sequential(d.limit(0), ["k"], ["i"], "s", 10).count() == 0


def test_one_large_key_packs(spark):
    sizes = [4 + (k * 7919) % 97 for k in range(60_000)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "i int, s int").selectExpr("1 AS k", "*")
    got = {r["i"]: r["pack"] for r in st.pack_sequential(d, ["k"], ["i"], "s", 1000).select("i", "pack").collect()}
    assert [got[k] for k in range(len(sizes))] == fold(sizes, 1000)


def test_find_quotes(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc日") for _ in range(3))
    texts = [" ".join(word() for _ in range(12)) for _ in range(80)]
    blocks = [(d, f"b{k:03d}", k // 8, k, texts[rng.randrange(80)]) for d in (1, 2, None) for k in range(200)] + [(1, "short", 99, 999, "ab")]
    quotes = [(f"q{k}", rng.choice([1, 2, 3]), rng.randrange(25), (t := texts[rng.randrange(80)])[(s := rng.randrange(40)) : s + rng.randrange(0, 30)] + rng.choice(["", "", "X"]), t) for k in range(120)]
    quotes = [q[:4] for q in quotes] + [("s1", 1, 99, "a"), ("s2", 1, 99, "ab"), ("s3", 2, 0, "zz"), ("n", None, 0, "abc"), ("e", 1, 0, ""), ("z", 1, 0, None)]
    b = spark.createDataFrame(blocks, "doc_id int, block_id string, page int, reading_order int, text string")
    q = spark.createDataFrame(quotes, "quote_id string, doc_id int, home_page int, quote string")
    got = {r["quote_id"]: tuple(r["hit"]) for r in an.find_quotes(q, b).collect()}
    want = {}
    for i, d, home, t in quotes:
        hits = [(page != home, page, order, block, x.index(t)) for doc, block, page, order, x in blocks if t and d is not None and doc == d and t in x]
        if hits:
            _, page, _, block, at = min(hits)
            want[i] = (block, page, at)
    assert got == want and len(want) > 30


def test_same_lines_make_no_pairs(spark):
    """Two thousand equal lines and a thousand quotes of them: the lines are one candidate."""
    b = spark.range(2000).selectExpr("1L AS doc_id", "lpad(cast(id AS string), 5, '0') AS block_id", "cast(id div 8 AS int) AS page", "cast(id AS int) AS reading_order", "'the same line again' AS text")
    q = spark.range(1000).selectExpr("id AS quote_id", "1L AS doc_id", "cast(id AS int) AS home_page", "'same line' AS quote")
    got = {r["quote_id"]: r["hit"]["block_id"] for r in an.find_quotes(q, b).collect()}
    assert got == {k: f"{8 * k if k < 250 else 0:05d}" for k in range(1000)}


def brute_run(left, right, least=4):
    best = None
    for i in range(len(left)):
        for j in range(len(right)):
            n = 0
            while i + n < len(left) and j + n < len(right) and left[i + n] == right[j + n]:
                n += 1
            if n >= least and (best is None or n > best[2]):
                best = (i, j, n)
    return best


def test_longest_common_run(spark):
    rng = random.Random(2)
    draw = lambda: "".join(rng.choice("ab") if rng.random() < 0.9 else rng.choice("cd") for _ in range(rng.randrange(0, 40)))
    rows = [(f"k{k}", draw(), draw()) for k in range(120)] + [("u", "日本語テキスト😀です。", "本語テキスト😀で"), ("e", "", "abcd"), ("n", None, "abcd"), ("s", "abc", "abc"), ("same", "aaaaaaaa", "aaaaaa")]
    d = spark.createDataFrame(rows, "key string, l string, r string")
    want = {k: brute_run(x, y) for k, x, y in rows if x and y and brute_run(x, y)}
    assert {r["key"]: tuple(r)[1:] for r in an.longest_common_run(d, "l", "r", "key").collect()} == want
    assert {r["key"]: tuple(r)[1:] for r in an._run_by_grams(d, "l", "r", "key", 4).collect()} == want
    assert an.longest_common_run(d.limit(0), "l", "r", "key").count() == 0


def test_longest_run_of_equal_characters(spark):
    n = 20_000
    d = spark.createDataFrame([("x", "a" * n, "a" * n), ("y", "ab" * (n // 2), "ba" * (n // 2))], "key string, l string, r string")
    assert {tuple(r) for r in an.longest_common_run(d, "l", "r", "key").collect()} == {("x", 0, 0, n), ("y", 0, 1, n - 1)}


def test_split_ranges_sweep(spark):
    rng = random.Random(4)
    sizes = {"b": 700, "c": 50, "d": 1}
    blocks = spark.createDataFrame([(1, k, "x" * n) for k, n in sizes.items()] + [(1, "empty", "")], "doc_id long, block_id string, text string")
    spans = [("b", f"a{k}", rng.randrange(50), s := rng.randrange(-5, 700), s + rng.randrange(-3, 60)) for k in range(1500)] + [("c", "z", 1, -4, 500), ("c", "y", 1, 10, 20), ("c", "x", 0, 60, 70), ("gone", "q", 1, 0, 5)]
    refs = [("b", f"m{k}", s := rng.randrange(700), s + 2) for k in range(100)]
    r = spark.createDataFrame([(1, *x) for x in spans], "doc_id long, block_id string, annotation_id string, ord int, start_offset int, end_offset int")
    m = spark.createDataFrame([(1, *x) for x in refs], "doc_id long, block_id string, marker string, start_offset int, end_offset int")
    want = []
    for block, n in sizes.items():
        mine, marks = [x[1:] for x in spans if x[0] == block], [x[1:] for x in refs if x[0] == block]
        cuts = sorted({c for c in {0, n, *(y for x in mine for y in x[2:]), *(y for x in marks for y in x[1:])} if 0 <= c <= n})
        for p, q in zip(cuts, cuts[1:], strict=False):
            over = [(o, name) for name, o, s, e in mine if s <= p and e >= q]
            ref = [name for name, s, e in marks if s <= p and e >= q]
            want.append((1, block, p, q, min(over)[1] if over else None, min(ref) if ref else None))
    assert sorted(map(tuple, an.split_ranges(r, m, blocks).collect()), key=str) == sorted(want, key=str)


def brute_lines(runs):
    """The height of each line, and the line of each run, by the rule as it stands."""
    rows, at = [], []
    for y, _, _, height in sorted(runs, key=lambda r: (-r[0], r[1], r[2])):
        near = [i for i, p in enumerate(rows) if abs(p - y) <= max(2.0, height * 0.28)]
        if near:
            rows[near[0]] = (rows[near[0]] + y) / 2
        else:
            rows.append(y)
        at.append(near[0] if near else len(rows) - 1)
    return rows, at


@pytest.mark.parametrize("part", [256, 5])
def test_lines_of_a_page_of_many_runs(spark, monkeypatch, part):
    rng = random.Random(8)
    monkeypatch.setattr(pa, "PART", part)
    pages = {1: 2000, 2: 3, 3: 400}
    runs = {p: [(float(rng.randrange(0, 4000)) / 4 if p != 3 else float(rng.choice([10, 11, 12, 13, 90])), float(rng.randrange(500)), k, rng.choice([4.0, 8.0, 10.0, 60.0 if p == 1 and k % 97 == 0 else 9.0])) for k in range(n)] for p, n in pages.items()}
    d = spark.createDataFrame([(1, p, k, f"r{k}", x, y, 5.0, h, h) for p, rs in runs.items() for y, x, k, h in rs], "doc_id int, page int, item_no int, str string, x double, y double, width double, height double, font_size double")
    got = {}
    for r in pa.group_lines(d).select("page", "reading_order", "text").collect():
        got.setdefault(r["page"], {})[r["reading_order"]] = r["text"]
    for p, rs in runs.items():
        rows, at = brute_lines(rs)
        lines = {}
        for line, (_, x, k, _) in zip(at, sorted(rs, key=lambda r: (-r[0], r[1], r[2])), strict=True):
            lines.setdefault(line, []).append((x, k))
        order = sorted(lines, key=lambda i: (-rows[i], i))
        assert got[p] == {n: " ".join(f"r{k}" for _, k in sorted(lines[i])) for n, i in enumerate(order, 1)}
