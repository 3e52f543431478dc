"""Ranked lexical search over a length-stratified index.

Documents whose lengths give the same normaliser m are one stratum. A stratum is cut into blocks of bounded size;
a block holds, term by term, its postings in runs of equal term frequency, so that the impact of a term, which
depends on m and the frequency only, is computed once a run. The greatest frequency of each term bounds what a
stratum can give to an item: strata are visited by these bounds, the best ones first, and then only those
whose bound reaches the k-th score found so far.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import bound_bytes, materialise, table

#: Postings of a block (a longer document is a block of its own), and strata that each item visits first.
BLOCK_POSTINGS, FIRST_STRATA = 100_000, 16
#: Blocks that a reader holds at once.
GROUP_ROWS = 8
#: Terms of items that are broadcast at once; more items are taken in as many slices as needed.
SLICE_TERMS = 200_000
#: Postings that are added up at once.
PORTION = 2_000_000

#: A-Z in lower case; all other ASCII characters than letters and digits become spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FORWARD = "doc_id long, n long, terms array<string>, tfs array<long>"
BLOCKS = "m long, docs array<long>, terms array<string>, sizes array<int>, top array<long>, runs array<int>, run_tf array<long>, run_size array<int>, places array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_FOLD).split() if text else []


def ragged(flat, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), flat)


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n, terms, tfs of each document with at least one term."""

    def run(batches):
        for b in batches:
            ids, n, sizes, terms, tfs = [], [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = terms_of(t)
                if found:
                    counts: dict[bytes, int] = {}
                    for x in found:
                        counts[x] = counts.get(x, 0) + 1
                    ids.append(doc)
                    n.append(len(found))
                    sizes.append(len(counts))
                    terms += counts
                    tfs += counts.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), ragged(pa.array(terms, pa.binary()).cast(pa.string()), sizes), ragged(pa.array(tfs, pa.int64()), sizes)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, FORWARD)


def block_of(m: int, docs: pa.Array, sizes: np.ndarray, terms: pa.Array, tfs: np.ndarray) -> list:
    """The columns of one block: each document has ``sizes`` of the terms."""
    coded = terms.dictionary_encode()
    code, place = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(docs)), sizes)
    order = np.lexsort((place, tfs, code))
    code, tf, place = code[order], tfs[order], place[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])])
    run_term, run_tf, run_size = code[first], tf[first], np.diff(np.r_[first, len(code)])
    runs = np.bincount(run_term, minlength=len(coded.dictionary))
    lists = [docs, coded.dictionary, pa.array(np.bincount(code), pa.int32()), pa.array(run_tf[np.cumsum(runs) - 1], pa.int64()), pa.array(runs, pa.int32()), pa.array(run_tf, pa.int64()), pa.array(run_size, pa.int32()), pa.array(place, pa.int32())]
    return [pa.array([m], pa.int64()), *(ragged(x, [len(x)]) for x in lists)]


class Index:
    """Blocks in the shared folder, the number of documents with a term, and that of all their terms."""

    def __init__(self, blocks: DataFrame, documents: int, length: int):
        self.blocks, self.documents, self.length = blocks, documents, length


def build(docs: DataFrame, text: str = "text") -> Index:
    """The index of all documents.

    Null and empty texts have no term and are not in it. Rows that repeat, and null or repeated ids, are documents of
    their own. Strata are dealt out by ranges of m and a hash of the row, so that one length may have any share of the
    documents. Other columns are not read.
    """
    bound_bytes(docs.sparkSession)
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    forward = materialise(term_counts(docs, text).withColumn("row", F.monotonically_increasing_id()), "forward")
    documents, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = (10 + F.expr(f"(90 * n * {documents}L) div {max(length, 1)}L")).alias("m")
    dealt = forward.select(m, F.xxhash64("row").alias("h"), "doc_id", "terms", "tfs").repartitionByRange("m", "h").sortWithinPartitions("m", "h")

    def run(batches):
        held: list[tuple] = []
        at, postings = None, 0

        def out():
            docs, sizes, terms, tfs = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays(block_of(at, pa.concat_arrays(docs), np.concatenate(sizes), pa.concat_arrays(terms), np.concatenate(tfs)), names=names)

        for b in batches:
            ms, sizes = b.column(0).to_numpy(), pc.list_value_length(b.column(2)).to_numpy()
            ends = np.cumsum(sizes)
            # a block ends where m changes or BLOCK_POSTINGS are reached
            start = 0
            for stop in [*(np.flatnonzero(ms[1:] != ms[:-1]) + 1).tolist(), len(ms)]:
                while start < stop:
                    if held and (at != ms[start] or postings + sizes[start] > BLOCK_POSTINGS):
                        yield out()
                        postings = 0
                    at = int(ms[start])
                    before = ends[start] - sizes[start]
                    till = min(stop, max(start + 1, int(np.searchsorted(ends, before + BLOCK_POSTINGS - postings, "right"))))
                    part = b.slice(start, till - start)
                    held.append((part.column(1), sizes[start:till], part.column(2).flatten(), part.column(3).flatten().to_numpy()))
                    postings += int(ends[till - 1] - before)
                    start = till
        if held:
            yield out()

    return Index(materialise(dealt.select("m", "doc_id", "terms", "tfs").mapInArrow(run, BLOCKS), "blocks", GROUP_ROWS), documents, length)


class Items:
    """The items of one slice: their ids, each one's terms as places in a sorted vocabulary, and the weights."""

    def __init__(self, ids: list[int], terms: list[str]):
        self.ids, which = np.unique(np.array(ids, np.int64), return_inverse=True)
        self.vocabulary, at = np.unique(np.array(terms, object), return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.of, self.term = which[order], at[order]
        self.start = np.searchsorted(self.of, np.arange(len(self.ids)))
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, df: dict[int, int], documents: int) -> None:
        for t, n in df.items():
            self.weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))

    def find(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``terms`` of terms that items have, and their places in the vocabulary."""
        if not hasattr(self, "arrow"):
            self.arrow = pa.array(self.vocabulary, pa.string())
        at = pc.index_in(terms, self.arrow)
        known = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
        return known, at.take(pa.array(known)).to_numpy().astype(np.int64)

    def impact(self, term: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def bounds(self, m: int, known: np.ndarray, term: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Of each item the most that a document of the block can score."""
        most = np.zeros(len(self.vocabulary), np.int64)
        most[term] = self.impact(term, top[known], m)
        return np.add.reduceat(most[self.term], self.start)


class Best:
    """The k best documents of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k, self.held, self.size = floor.copy(), k, [], 0

    def add(self, item: np.ndarray, doc: pa.Array, score: np.ndarray) -> None:
        null = pc.is_null(doc).to_numpy(zero_copy_only=False)
        self.held.append((item, null, doc.fill_null(0).to_numpy(), score))
        self.size += len(item)
        if self.size > 200_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        item, null, doc, score = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.lexsort((doc, null, -score, item))
        item, null, doc, score = item[order], null[order], doc[order], score[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        last = rank == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])
        keep = rank < self.k
        self.held, self.size = [(item[keep], null[keep], doc[keep], score[keep])], int(keep.sum())
        return self.held[0]


def score_block(items: Items, m: int, docs: pa.Array, known: np.ndarray, term: np.ndarray, sizes: np.ndarray, runs: np.ndarray, run_tf: np.ndarray, run_size: np.ndarray, places: np.ndarray, visit: np.ndarray, best: Best) -> None:
    """Add the block's documents of the visited items that reach the floor."""
    end, run_end = np.cumsum(sizes), np.cumsum(runs)
    at = np.full(len(items.vocabulary), -1)
    at[term] = known
    # once a run: the impact of its term and frequency
    run_of = np.repeat(np.arange(len(known)), runs[known])
    run_at = np.repeat(run_end[known] - np.cumsum(runs[known]), runs[known]) + np.arange(len(run_of))
    by_run = np.zeros(len(run_tf), np.int64)
    by_run[run_at] = items.impact(term[run_of], run_tf[run_at], m)
    impact = np.repeat(by_run, run_size)
    slot = np.cumsum(visit) - 1
    pair = np.flatnonzero(visit[items.of] & (at[items.term] >= 0))
    where = at[items.term[pair]]
    rows = np.flatnonzero(visit)
    each = max(1, PORTION // max(1, len(docs)))
    for low in range(0, len(rows), each):  # so many items at once that their scores are PORTION numbers at most
        of = slot[items.of[pair]]
        mine = np.flatnonzero((of >= low) & (of < low + each))
        total = np.zeros(min(each, len(rows) - low) * len(docs), np.int64)
        load = np.cumsum(sizes[where[mine]])
        for part in np.split(mine, np.flatnonzero(np.diff(load // PORTION)) + 1) if len(mine) else []:
            n = sizes[where[part]]
            flat = np.repeat(end[where[part]] - np.cumsum(n), n) + np.arange(int(n.sum()))
            np.add.at(total, np.repeat(of[part] - low, n) * len(docs) + places[flat], impact[flat])
        item, doc = np.divmod(np.flatnonzero(total), len(docs))
        item = rows[item + low]
        score = total[total > 0]
        good = score >= best.floor[item]
        if good.any():
            best.add(item[good], docs.take(pa.array(doc[good])), score[good])


def _rows(b: pa.RecordBatch, *names: str):
    """The lists of these columns, row by row."""
    for i in range(b.num_rows):
        yield [b.column(n)[i].as_py() if n == "m" else b.column(n)[i].values for n in names]


def _visit(blocks: DataFrame, items: Items, first: dict[int, np.ndarray], floor: np.ndarray, k: int, early: bool) -> DataFrame:
    """item_id, doc_id, score of the best documents that reach the floor.

    ``first`` has, by stratum, the items that visit it early; the later visit is of all other pairs.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((items, first, floor))

    def run(batches):
        items, first, floor = shared.value
        best = Best(floor, k)
        for b in batches:
            for m, docs, terms, sizes, top, runs, run_tf, run_size, places in _rows(b, "m", "docs", "terms", "sizes", "top", "runs", "run_tf", "run_size", "places"):
                known, term = items.find(terms)
                if not len(known):
                    continue
                bound = items.bounds(m, known, term, top.to_numpy())
                chosen = np.zeros(len(items.ids), bool)
                chosen[first.get(m, [])] = True
                visit = (bound >= best.floor) & (chosen if early else ~chosen)
                if visit.any():
                    score_block(items, m, docs, known, term, *(x.to_numpy().astype(np.int64) for x in (sizes, runs, run_tf, run_size, places)), visit, best)
        item, null, doc, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(items.ids[item], pa.int64()), pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def _search(index: Index, items: Items, k: int) -> DataFrame:
    spark = index.blocks.sparkSession
    shared = spark.sparkContext.broadcast(items)

    def frequencies(batches):
        total = np.zeros(len(shared.value.vocabulary), np.int64)
        for b in batches:
            for terms, sizes in _rows(b, "terms", "sizes"):
                known, term = shared.value.find(terms)
                total[term] += sizes.to_numpy()[known]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    df = index.blocks.select("terms", "sizes").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    items.weigh({r["term"]: r["n"] for r in df.collect()}, index.documents)
    weighed = spark.sparkContext.broadcast(items)

    def bounds(batches):
        items, held = weighed.value, {}
        for b in batches:
            for m, terms, top in _rows(b, "m", "terms", "top"):
                bound = items.bounds(m, *items.find(terms), top.to_numpy())
                held[m] = np.maximum(held[m], bound) if m in held else bound
                if len(held) >= 4 * FIRST_STRATA:
                    held = cut(held)
        m = np.array(sorted(held), np.int64)
        every = np.stack([held[x] for x in m]) if held else np.empty((0, len(items.ids)), np.int64)
        stratum, item = np.nonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(m[stratum]), pa.array(every[stratum, item])], names=["item", "m", "bound"])

    def cut(held):
        """Only each item's best strata of this task stay."""
        m = np.array(sorted(held), np.int64)
        every = np.stack([held[x] for x in m])
        out: dict = {}
        rank = np.argsort(np.argsort(-every, axis=0, kind="stable"), axis=0)
        every[rank >= FIRST_STRATA] = 0
        for x, row in zip(m.tolist(), every, strict=True):
            if row.any():
                out[x] = row
        return out

    best_first = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    strata = index.blocks.select("m", "terms", "top").mapInArrow(bounds, "item long, m long, bound long").groupBy("item", "m").agg(F.max("bound").alias("bound"))
    chosen = strata.withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= FIRST_STRATA).groupBy("m").agg(F.collect_list("item").alias("items")).collect()
    first = {r["m"]: np.array(r["items"]) for r in chosen}
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    floor = np.ones(len(items.ids), np.int64)  # only scores above zero count
    start = materialise(_visit(index.blocks.where(F.col("m").isin(sorted(first))), items, first, floor, k, True), "first-strata")
    reached = start.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select("item_id", "score").collect()
    for r in reached:
        floor[np.searchsorted(items.ids, r["item_id"])] = r["score"]
    return start.union(_visit(index.blocks, items, first, floor, k, False))


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    Equal scores are ranked by ascending doc_id, null ids last. The rows of one item_id are one item with the terms of
    all of them; null item ids, and items without a term, have no rows. Items are taken in slices of about SLICE_TERMS
    terms, each of which is broadcast and held against all blocks.
    """

    def run(batches):
        for b in batches:
            ids, terms = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set(terms_of(t))
                ids += [i] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], names=["item_id", "term"])

    spark = items.sparkSession
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    asked = materialise(rows.mapInArrow(run, "item_id long, term string").distinct(), "item-terms")
    n = asked.count()
    empty = spark.createDataFrame([], "item_id long, doc_id long, score long")
    slices = -(-n // SLICE_TERMS) if index.documents else 0
    found = []
    for s in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).toArrow()
        if part.num_rows:
            found.append(_search(index, Items(part["item_id"].to_pylist(), part["term"].to_pylist()), k))
    every = reduce(DataFrame.union, found, empty)
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
a AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), a),
m AS (SELECT r, doc_id, 10 + (90 * len(w) * n_docs) // n_terms AS m FROM d, a WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
