"""Approximate nearest neighbours over balanced posting lists.

Centroids come from size-penalised k-means on a bounded sample. A graph over them (each centroid's
nearest, both ways) is searched best-first in memory, for many vectors at once, both to fill the
lists and to query them. A vector goes to its nearest centroid's list and, if it lies near a
boundary, to those hardly farther. A query reads the lists whose centroids are within a distance
ratio of the nearest one, and always enough lists to hold the answers asked for.

Equal vectors are one entry with the smallest ids that can ever be asked for; a list longer than
``block`` is dealt out in blocks, all of which are read when the list is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, table

#: Bounds of what the driver fits and broadcasts.
SAMPLE, MAX_CENTROIDS, PER_LIST = 30_000, 16_384, 100
REPLICAS, REPLICA_RATIO = 6, 1.12  # boundary vectors: lists each, and how much farther they may be
PROBES, PROBE_RATIO = 48, 1.6
DEGREE, BEAM, BLOCK = 16, 64, 4_096
SEED = 11


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, penalty: float = 0.1) -> np.ndarray:
    """Centroids; a list over its fair size looks farther away than it is, so that lists even out."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load, fair = np.zeros(k), len(x) / k
    for _ in range(rounds):
        at = np.empty(len(x), np.int64)
        for s in range(0, len(x), 4096):
            d = squared(x[s : s + 4096], c)
            at[s : s + 4096] = (d + penalty * d.min(1).mean() * (load / fair)[None]).argmin(1)
        n = np.bincount(at, minlength=k)
        load = 0.5 * load + 0.5 * n
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class CentroidGraph:
    """Best-first search over a neighbour graph of the centroids."""

    def __init__(self, c: np.ndarray):
        self.c = c
        k = len(c)
        near = np.empty((k, min(DEGREE, k - 1) if k > 1 else 0), np.int64)
        for s in range(0, k, 1024):
            d = squared(c[s : s + 1024], c)
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            if near.shape[1]:
                near[s : s + 1024] = np.argsort(d, 1, kind="stable")[:, : near.shape[1]]
        # links back, and a few long ones so that every part is reached
        rng = np.random.default_rng(SEED)
        back = [[] for _ in range(k)]
        for i in range(k):
            for j in near[i, : DEGREE // 2]:
                if len(back[j]) < DEGREE // 2:
                    back[j].append(i)
        far = rng.integers(0, k, (k, 4))
        wide = near.shape[1] + DEGREE // 2 + 4
        self.links = np.empty((k, wide), np.int64)
        for i in range(k):
            row = [*near[i], *back[i], *far[i]]
            self.links[i] = row + [i] * (wide - len(row))
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 32)).astype(np.int64))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ``beam`` nearest centroids met and their squared distances, nearest first."""
        k = len(self.c)
        beam = min(beam, k)
        ids_out, d_out = np.empty((len(q), beam), np.int64), np.empty((len(q), beam))
        for s in range(0, len(q), 512):
            part = q[s : s + 512]
            rows = np.arange(len(part))[:, None]
            seen = np.zeros((len(part), k), bool)
            d = squared(part, self.c[self.entries])
            ids = np.broadcast_to(self.entries, d.shape).copy()
            seen[rows, ids] = True
            ids, d = self._keep(ids, d, beam)
            done = np.zeros(ids.shape, bool)
            while True:
                open_d = np.where(done | np.isinf(d), np.inf, d)
                pick = open_d.argmin(1)
                live = ~np.isinf(open_d[np.arange(len(part)), pick])
                if not live.any():
                    break
                done[live, pick[live]] = True
                new = self.links[np.where(live, ids[np.arange(len(part)), pick], self.entries[0])]
                new_d = ((self.c[new] - part[:, None]) ** 2).sum(2)
                new_d[seen[rows, new] | ~live[:, None]] = np.inf
                order = np.argsort(new, 1, kind="stable")  # the same centroid may be linked twice
                twice = np.zeros(new.shape, bool)
                ordered = np.take_along_axis(new, order, 1)
                np.put_along_axis(twice, order, np.c_[np.zeros(len(new), bool), ordered[:, 1:] == ordered[:, :-1]], 1)
                new_d[twice] = np.inf
                seen[rows, new] = True
                all_d, all_i = np.c_[d, new_d], np.c_[ids, new]
                all_done = np.c_[done, np.zeros(new.shape, bool)]
                best = np.argsort(all_d, 1, kind="stable")[:, :beam]
                d, ids, done = (np.take_along_axis(v, best, 1) for v in (all_d, all_i, all_done))
            n = d.shape[1]
            ids_out[s : s + 512, :n], d_out[s : s + 512, :n] = ids, d
            ids_out[s : s + 512, n:], d_out[s : s + 512, n:] = -1, np.inf
        return ids_out, d_out

    @staticmethod
    def _keep(ids, d, beam):
        if d.shape[1] < beam:
            pad = beam - d.shape[1]
            return np.c_[ids, np.zeros((len(ids), pad), np.int64)], np.c_[d, np.full((len(d), pad), np.inf)]
        best = np.argsort(d, 1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>, dim: rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors (w, hash h) with their k + 1 smallest ids: a query takes at most k, and never its own.

    Spark keeps k + 1 rows a vector in each task before it shuffles, so a vector that a third of the rows share is no hot group.
    """
    one = rows.select(F.transform("v", lambda x: x + 0.0).alias("w"), "vec_id").withColumn("h", F.xxhash64("w"))
    rank = F.row_number().over(Window.partitionBy("h", "w").orderBy("vec_id"))
    few = one.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("h", "w").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for each query row: its k nearest other vectors found.

    Null, zero and non-finite vectors take no part, nor do null ids, nor vectors whose length is not the
    most common one. Ties go to the smaller id. A repeated row of the query's own id is not its neighbour.
    With fewer than k candidates all are returned; without any, nothing.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).where(F.col("vec_id").isNotNull())
    top = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("dim") == top["dim"])
    entries = materialise(classes(rows, k), "vectors")
    n = entries.count()
    share = min(1.0, SAMPLE / n)
    sample = np.array(entries.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(F.xxhash64("h")).limit(SAMPLE).select("w").toPandas()["w"].tolist(), np.float64)
    lists = int(min(MAX_CENTROIDS, max(1, n // PER_LIST), len(sample)))
    graph = CentroidGraph(balanced_kmeans(sample, lists))
    index = spark.sparkContext.broadcast(graph)

    def stack(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def assign(batches):
        g = index.value
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                w = stack(part.column(1))
                ids, d = g.search(w, beam=max(16, REPLICAS))
                near = ids[:, :REPLICAS]
                go = d[:, :REPLICAS] <= REPLICA_RATIO**2 * d[:, :1] + 1e-12
                go[:, 0] = True
                r, c = np.nonzero(go & (near >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(near[r, c]), pa.array(c == 0), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r)), part.column(2).take(pa.array(r))], names=["list", "own", "h", "w", "ids"])

    postings = materialise(entries.select("h", "w", "ids").mapInArrow(assign, "list long, own boolean, h long, w array<double>, ids array<long>"), "postings")
    # one row a list: bounded by MAX_CENTROIDS
    sizes = postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.when(F.col("own"), F.least(F.size("ids"), F.lit(k + 1)))).alias("own")).collect()
    blocks, own = np.ones(lists, np.int64), np.zeros(lists, np.int64)
    for r in sizes:
        blocks[r["list"]], own[r["list"]] = -(-r["n"] // BLOCK), r["own"] or 0
    shape = spark.sparkContext.broadcast((blocks, own))

    def choose(batches):
        g, (blocks, own) = index.value, shape.value
        for b in batches:
            q = stack(b.column(1))
            ids, d = g.search(q)
            out_r, out_l = [], []
            for r in range(len(q)):
                met = ids[r][ids[r] >= 0]
                limit = PROBE_RATIO**2 * d[r, 0] + 1e-12
                chosen = [int(x) for x, y in zip(met[:PROBES], d[r], strict=False) if y <= limit]
                have, at = int(own[chosen].sum()), len(chosen)
                while have <= k and at < len(met):  # enough lists to hold k others
                    chosen.append(int(met[at]))
                    have, at = have + int(own[met[at]]), at + 1
                if have <= k:
                    chosen = list(range(len(own)))
                out_r += [r] * len(chosen)
                out_l += chosen
            each = blocks[out_l] if out_l else np.empty(0, np.int64)
            r, l = np.repeat(np.array(out_r, np.int64), each), np.repeat(np.array(out_l, np.int64), each)
            block = np.arange(len(r)) - np.repeat(np.cumsum(each) - each, each)
            yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(block), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r))], names=["list", "block", "query_id", "q"])

    # equal vectors are asked for once, with one answer more than wanted: a query leaves itself out of it
    q = F.transform("v", lambda x: x + 0.0)
    queries = rows.where(is_query).select(F.col("vec_id").alias("own_id"), q.alias("q")).distinct().withColumn("h", F.xxhash64("q"))
    distinct = materialise(queries.groupBy("h", "q").agg(F.count("*").alias("n")).withColumn("vec_id", F.monotonically_increasing_id()), "queries")
    asked = distinct.select("vec_id", "q").mapInArrow(choose, "list long, block long, query_id long, q array<double>")
    blocks_of = F.broadcast(spark.createDataFrame([(int(i), int(b)) for i, b in enumerate(blocks)], "list long, blocks long"))
    dealt = postings.join(blocks_of, "list").withColumn("block", F.pmod("h", "blocks")).select("list", "block", "w", "ids")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, w = stack(left.column("q").combine_chunks()), stack(right.column("w").combine_chunks())
            ids = right.column("ids").to_pylist()
            for i, query in enumerate(left.column("query_id").to_pylist()):
                d = np.sqrt(((w - q[i]) ** 2).sum(1))
                # k + 1 entries with all that tie with the last: one of them may be the query alone
                cut = np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)]
                found = sorted((float(d[j]), v) for j in np.nonzero(d <= cut)[0] for v in ids[j])[: k + 1]
                out += [(query, v, s) for s, v in found]
        cols = list(zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = asked.groupBy("list", "block").cogroup(dealt.groupBy("list", "block")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    # a vector in several lists is found several times with the same score
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id"))), 1, k + 1).alias("b"))
    answers = best.join(distinct.select(F.col("vec_id").alias("query_id"), "h", F.col("q").alias("asked")), "query_id").select("h", "asked", "b")
    # on the vector's hash, so that Spark can split a vector that very many queries share
    each = queries.join(answers, "h").where("q = asked").select(F.col("own_id").alias("query_id"), F.slice(F.filter("b", lambda x: x["vec_id"] != F.col("own_id")), 1, k).alias("b"))
    return each.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op4_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
