"""Size-aware heavy-light similarity join on word n-grams, and the groups it links.

Equal sets collapse first. Shingles have one global order, rare ones first (the frequent ones of
a bounded sample come last; any order gives the same links). Light sets, up to a boundary, are
joined on all two-element subsets of their order's beginning; heavy sets scan the inverted lists
of single shingles there. Sets close below the boundary take part in both, so no pair is lost.
The boundary has the lowest cost estimated from sizes and list lengths of the sample.

Links are found in two passes so that a large group does not give all its pairs. First each set is
compared with the two ends of its lists only, and what links becomes one component. Then lists
that still hold several components give pairs of different components (members of a list's largest
component never meet each other). Parity sketches, which have a bit or more for each element, bound the
difference of a pair from below; what they let through is compared exactly, by whole texts.

Shingles are 64-bit hashes, and sets are equal if their 128-bit digests are: among n different ones the
odds that any two meet are about n * n / 2 ** 65 and n * n / 2 ** 129.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import discard, kept, materialise, release_memory, stored, table
from quire.llm.components import components

WORDS, PERCENT = 3, 90
#: The sampled share of documents (and the fewest), and the bound of frequent shingles. They steer the order and the cost only.
SAMPLE_SHARE, SAMPLE_DOCS, FREQUENT = 1 / 16, 2_000, 200_000
FILTER_BITS = 22
LEAST_SKETCH, FOLDED = 1024, 8  # bits; FOLDED longs of 64 bits travel with the lists
#: Bytes that are shingled at once.
BLOCK = 1 << 20
#: A shingle is frequent from so many documents of the sample on.
LEAST_FREQUENT = 3
#: Rounds in which sets meet the best-linked of alike ones go on while at least this share of the pairs compared link; how many
#: bits are alike, and the most rounds. They save work only: pairs of components that are left are all compared.
JOINED, ALIKE_BITS, ROUNDS = 1 / 8, 10, 3
#: So many of a set's lists are looked through for one in which a pair has met before.
EARLIER_LISTS = 8
SIGNED = "doc_id long, fingerprint long, n long, digest binary, folded array<long>, sketch array<long>, keys array<long>"


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


class Shingler:
    """Set hashes of many texts at once, straight from their UTF-8 bytes.

    A word's hash is a polynomial in a fixed odd base over table values of its bytes, modulo 2 ** 64, then
    finalised; bytes A-Z read as a-z, and only ASCII white space parts words.
    """

    BASE = 0x9E3779B97F4A7C55

    def __init__(self, words: int):
        self.words = words
        self.table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.table[65:91] = self.table[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.table[self.space] = 0
        self.powers = self.inverse = np.ones(0, np.uint64)

    def word_hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of texts that begin at ``starts`` in ``data``, and how many words each text has.

        A word's hash does not depend on its place, so long texts are taken in blocks that end at white space.
        """
        hashes, begins, low = [], [], 0
        while low < len(data):
            high = self.block_end(data, low)
            h, at = self._words(data[low:high], starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low)
            hashes.append(h)
            begins.append(at + low)
            low = high
        at = np.concatenate(begins) if begins else np.empty(0, np.int64)
        return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.diff(np.r_[np.searchsorted(at, starts), len(at)])

    def block_end(self, data: np.ndarray, low: int) -> int:
        """Where the block from ``low`` on ends: behind its last white space, or the first after BLOCK bytes."""
        high, step = low + BLOCK, BLOCK
        if high >= len(data):
            return len(data)
        found = np.flatnonzero(self.space[data[low:high]])
        if len(found):
            return low + int(found[-1]) + 1
        while high < len(data):
            found = np.flatnonzero(self.space[data[high : high + step]])
            if len(found):
                return high + int(found[0]) + 1
            high += step
        return len(data)

    def _words(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.powers):
            n = max(1 << 20, len(data))
            self.powers, self.inverse = _powers(self.BASE, n), _powers(pow(self.BASE, -1, 1 << 64), n)
        space = self.space[data]
        begin = ~space
        begin[1:] &= space[:-1]
        begin[edge] = ~space[edge]
        at = np.flatnonzero(begin)
        if not len(at):
            return np.empty(0, np.uint64), at
        total = np.add.reduceat(self.table[data] * self.powers[: len(data)], at)
        return mix(total * self.inverse[at]), at

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each UTF-8 text, the sorted distinct hashes of its word windows; a shorter text is one window."""
        lengths = np.array([len(t) for t in texts], np.int64)
        h, sizes = self.word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths)
        out = np.zeros(max(0, len(h) - self.words + 1), np.uint64)
        for k in range(self.words):
            out = mix(out + h[k : k + len(out)])
        found, at = [], 0
        for n in sizes.tolist():
            if n >= self.words:
                s = np.sort(out[at : at + n - self.words + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                found.append(s[keep])
            else:
                found.append(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), 2)] if n else [], np.uint64))
            at += n
        return found


def portions(batches, column: str, most: int = BLOCK):
    """Parts of batches with their texts as bytes (null: empty), of about ``most`` bytes and at least a row."""
    for b in batches:
        texts = [x or b"" for x in b.column(column).cast(pa.binary()).to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= most or i == len(texts) - 1:
                yield b.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, and no two inputs alike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@kept
def shingler(words: int) -> Shingler:
    return Shingler(words)


def least_overlap(n: int, percent: int) -> int:
    """The fewest elements a set of n shares with any set that it links with."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Bit b is the parity of the elements that fall there; sketches of two sets differ in at most as many bits as the sets do.

    There are as many bits as the next power of two from the set's size on, LEAST_SKETCH at least; folding halves them.
    """
    bits = max(LEAST_SKETCH, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def fold(sketch: np.ndarray) -> np.ndarray:
    """The sketch of FOLDED longs."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, FOLDED), axis=0)


def in_order(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` shingles of a set: those of order 0 by hash, then the frequent ones, rarest first."""
    rare = s[order == 0]
    if len(rare) >= most:
        return rare[:most]
    often = order > 0
    rest, rank = s[often], order[often]
    return np.concatenate([rare, rest[np.argsort(rank, kind="stable")]])[:most]


def signatures(s: np.ndarray, order: np.ndarray, percent: int, boundary: int) -> np.ndarray:
    """The keys under which a set is listed: subsets of two (light) and single shingles (heavy)."""
    n = len(s)
    if n * (100 - percent) < percent and (n + 1) * percent > 100 * n:
        return np.empty(0, np.int64)  # too small to link with a different set
    p = prefix_length(n, percent)
    first = in_order(s, order, p + 1)
    keys = []
    if 2 <= n <= boundary:
        i, j = np.triu_indices(min(p + 1, n), 1)
        low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
        keys.append(mix(mix(low ^ np.uint64(0x9E3779B97F4A7C15)) + high))
    if n > boundary or n >= least_overlap(boundary + 1, percent) or n < 2:
        keys.append(first[:p])
    return (keys[0] if len(keys) == 1 else np.concatenate(keys)).view(np.int64)


def choose_boundary(sizes: np.ndarray, counts: np.ndarray, list_length: float, percent: int) -> int:
    """The light sets' largest size: subsets listed against single shingles listed and scanned."""
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order]
    p = sizes - -(-percent * sizes // 100) + 1
    light = np.cumsum(counts * (p + 1) * p / 2)
    heavy = counts * p * (1 + list_length)
    from_here = np.cumsum(heavy[::-1])[::-1]
    best, at = float(heavy.sum()), 0
    for x in np.unique(sizes):
        low = np.searchsorted(sizes, least_overlap(int(x) + 1, percent))
        cost = light[np.searchsorted(sizes, x, "right") - 1] + (from_here[low] if low < len(sizes) else 0)
        if cost < best:
            best, at = float(cost), int(x)
    return at


def order_and_boundary(docs: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles with their rank, and the boundary, from a fixed share of all documents."""
    total = docs.count()
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, total)))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def run(batches):
        s = shingler(words)
        for _, texts in portions(batches, "text"):
            sets = s.sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["s"])

    sets = materialise(sample.mapInArrow(run, "s array<long>"), "sample")
    df = materialise(sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
    sizes = sets.groupBy(F.size("s").alias("n")).agg(F.count("*").alias("c")).where("n > 0").toPandas()
    # the least count from which on there are at most FREQUENT shingles
    counts = df.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("c")).toPandas().sort_values("n", ascending=False)
    fits = counts["n"][counts["c"].cumsum() <= FREQUENT]
    least = max(LEAST_FREQUENT, int(fits.min())) if len(fits) else 1 << 62
    top = df.where(F.col("n") >= least).toArrow()
    f, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(f)
    # lists of what is not frequent, as long as in all documents
    rare = df.where(F.col("n") < least).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    every = float((sizes["n"] * sizes["c"]).sum()) if len(sizes) else 0.0
    boundary = choose_boundary(sizes["n"].to_numpy(), sizes["c"].to_numpy().astype(float), rare / max(every, 1.0) / share, percent) if len(sizes) else 0
    return f[order], n[order], boundary


def sign(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: set size, digest of the set, its parity sketch, also folded, and list keys."""
    frequent, rank, boundary = order_and_boundary(docs, words, percent)
    model = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def run(batches):
        release_memory(shingler)
        s, (f, r) = shingler(words), model.value
        for part, texts in portions(batches, "text"):
            sets = s.sets(texts)
            every = np.concatenate(sets)
            order = np.zeros(len(every), np.int64)
            if len(f):
                k = np.minimum(np.searchsorted(f, every), len(f) - 1)
                order = np.where(f[k] == every, r[k], 0)
            ends = np.cumsum([len(x) for x in sets])
            keys = [signatures(x, order[e - len(x) : e], percent, boundary) if len(x) else [] for x, e in zip(sets, ends.tolist(), strict=True)]
            sketches = [parity_sketch(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("fingerprint"), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), pa.array([fold(x) for x in sketches], pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "fingerprint", "n", "digest", "folded", "sketch", "keys"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), "text").mapInArrow(run, SIGNED)


def differ(left: str, right: str, n: int) -> str:
    return " + ".join(f"bit_count({left}{i} ^ {right}{i})" for i in range(n))


def most_different(percent: int) -> str:
    """How many elements two linking sets of na and nb elements differ in at most."""
    return f"na + nb - 2 * ceil({percent}.0D * (na + nb) / {100 + percent}.0D - 1e-9)"


def maybe_in(docs: DataFrame, needed: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The documents whose id may be needed, so that no others are shuffled.

    A one-hash Bloom filter of 2 ** filter_bits bits, 16 bytes a word of 64: its size is fixed. When very many
    ids are needed it lets more through, and only saves less.
    """
    words = 1 << (filter_bits - 6)
    h = lambda c: F.xxhash64(c, F.lit(7))
    word = lambda c: F.pmod(h(c), F.lit(words))
    bit = lambda c: F.shiftrightunsigned(h(c), 58).cast("int")
    bits = needed.groupBy(word("id").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("id"))).alias("bits"))
    marked = docs.withColumn("word", word("doc_id")).withColumn("bit", bit("doc_id")).join(F.broadcast(bits), "word")
    return marked.where(F.getbit("bits", F.col("bit")) == 1).drop("word", "bit", "bits")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs of nodes a, b whose sets link, by their whole texts, which travel compressed and go when the pairs are written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # an id may repeat with other texts: the fingerprint tells which row is meant
    needed, needed_at = stored(nodes.join(wanted, "node").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.fingerprint").alias("fingerprint")), "needed")

    def compress(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([z.compress(x or b"") for x in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["id", "fingerprint", "z"])

    some = maybe_in(docs, needed).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("fingerprint"), "text").mapInArrow(compress, "id long, fingerprint long, z binary")
    same = some["id"].eqNullSafe(needed["id"]) & (some["fingerprint"] == needed["fingerprint"])
    texts, texts_at = stored(some.join(needed, same).select("node", "z").dropDuplicates(["node"]), "texts")
    discard(docs.sparkSession, needed_at)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")

    def run(batches):
        s, z = shingler(words), zstandard.ZstdDecompressor()
        last: dict[int, np.ndarray] = {}
        for b in batches:
            keep = []
            for i, x, j, y in zip(*(b.column(c).to_pylist() for c in ("a", "za", "b", "zb")), strict=True):
                for k, t in ((i, x), (j, y)):
                    if k not in last:
                        if len(last) >= 64:
                            last.clear()
                        last[k] = s.sets([z.decompress(t)])[0]
                p, q = last.get(i), last[j]
                p = s.sets([z.decompress(x)])[0] if p is None else p
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    linked = materialise(both.select("a", "za", "b", "zb").mapInArrow(run, "a long, b long"), name)
    discard(docs.sparkSession, texts_at)
    return linked


def sketched(pairs: DataFrame, signed: DataFrame, percent: int, folded: bool = True) -> DataFrame:
    """The pairs a, b (with their distance at least) that size and sketch let link: a folded sketch first (unless the pairs have passed it), then the full one."""
    if folded:
        first = [F.get("folded", F.lit(k)).alias(f"s{k}") for k in range(FOLDED)]
        pairs = materialise(_within(pairs, signed, first, F.expr(differ("x", "y", FOLDED)), percent).select("a", "b"), "folded-pairs")
    # sizes of linking sets are near, so that one sketch is folded once at most
    full = """aggregate(zip_with(
        if(size(xs) > size(ys), zip_with(slice(xs, 1, size(ys)), slice(xs, size(ys) + 1, size(ys)), (p, q) -> p ^ q), xs),
        if(size(ys) > size(xs), zip_with(slice(ys, 1, size(xs)), slice(ys, size(xs) + 1, size(xs)), (p, q) -> p ^ q), ys),
        (p, q) -> bit_count(p ^ q)), 0, (n, x) -> n + x)"""
    return _within(pairs, signed, [F.col("sketch").alias("ss")], F.expr(full), percent)


def _within(pairs: DataFrame, signed: DataFrame, parts: list[Column], d: Column, percent: int) -> DataFrame:
    """Pairs whose sketches (the columns ``parts`` of both, as x and y) are at most as far apart as linking sets; d tells how far."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = maybe_in(signed.select("node", "n", *parts).withColumnRenamed("node", "doc_id"), wanted.select(F.col("node").alias("id"))).withColumnRenamed("doc_id", "node")
    # an inner join: a semi join would be pushed below the filter, and all rows shuffled
    side = some.join(wanted, "node").dropDuplicates(["node"])
    names = [c for c in side.columns if c not in ("node", "n")]
    a = side.select(F.col("node").alias("a"), F.col("n").alias("na"), *[F.col(c).alias("x" + c[1:]) for c in names])
    b = side.select(F.col("node").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias("y" + c[1:]) for c in names])
    near = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return near.withColumn("d", d).where(f"d <= {most_different(percent)}").select("a", "b", "d")


def closest(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs the one of least distance: enough for a first round."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(x).alias("x"), F.struct("d", F.col(y).alias("y")).alias("m")) for side, x, y in ((0, "a", "b"), (1, "b", "a"))])).alias("e")).select("e.*")
    return ends.groupBy("side", "x").agg(F.min("m").alias("m")).select(*ordered("x", "m.y")).distinct()


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets. Null and empty texts
    have an empty set and link with nothing. Repeated rows are equal sets. A null id takes part as any
    other; component_id is the smallest id that is not null, null if there is none.
    """
    signed, ids = grouped(docs, words, percent)
    ids = ids.select("node", "rep.doc_id", "component")
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    members = ids.select("node", F.xxhash64("component").alias("k"), "component").join(least.select(F.xxhash64("component").alias("k"), F.col("component").alias("c"), "component_id"), "k").where("component = c").select(F.xxhash64("node").alias("h"), F.col("node").alias("m"), "component_id")
    out = signed.select("doc_id", "n", "node").withColumn("h", F.xxhash64("node")).join(members, "h", "left").where("m is null or m = node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, fingerprint of one row of each group of linked documents, of the smallest id (null last), then fingerprint.

    Rows with an empty set link with nothing: each is its own. An id may be there with several texts.
    """
    signed, ids = grouped(docs, words, percent)
    least = ids.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.fingerprint")
    return least.union(signed.where("n = 0").select("doc_id", "fingerprint").distinct())


def grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows with their node; and each node with its least row (null id last) and its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = numbered(materialise(sign(docs, words, percent), "signed"))
    full = signed.where("n > 0")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "fingerprint")).alias("rep")
    nodes = materialise(full.groupBy("node").agg(rep), "nodes")
    listed = full.select("node", "n", F.explode("keys").alias("key"))
    # most keys are of one set: a count drops them before members are compared
    twice, twice_at = stored(listed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "keys-met-again")
    some = maybe_in(listed.withColumnRenamed("key", "doc_id"), twice.select(F.col("key").alias("id")), 24).withColumnRenamed("doc_id", "key")
    lists, lists_at = stored(distinct_lists(some), "list-ends")
    discard(spark, twice_at)
    # only keys of these lists go through the shuffle again; on a hash of the key both sides are dealt anew,
    # so that Spark can split a hot one
    often = maybe_in(listed.withColumnRenamed("key", "doc_id"), lists.select(F.col("key").alias("id")), 24).withColumnRenamed("doc_id", "key").distinct()
    live, live_at = stored(often.withColumn("k", F.xxhash64("key")).join(lists.select(F.xxhash64("key").alias("k"), F.col("key").alias("list_key"), "low", "high"), "k").where("key = list_key").select("key", "node", "n", "low", "high"), "lists")
    discard(spark, lists_at)
    ends = live.select(F.explode(F.array(F.struct(*ordered("node", "low")), F.struct(*ordered("node", "high")))).alias("e")).select("e.*").where("a < b").where(size_class_near("a", "b", percent)).distinct()
    ends, ends_at = stored(ends, "ends")
    near, near_at = stored(sketched(ends, full, percent), "near-ends")
    discard(spark, ends_at)
    tried = materialise(closest(near), "first-pairs")
    discard(spark, near_at)
    links = verify(tried, nodes, docs, words, percent, "links")
    parts = materialise(components(links), "parts")
    rest, rest_at = with_folded(mixed_lists(live.select("key", "node", "n"), parts, percent), full)
    discard(spark, live_at)
    for turn in range(ROUNDS):
        # sets of a mixed list with alike sketches meet the best-linked of them only: pairs grow with the lists, not their squares
        pairs, pairs_at = stored(hub_pairs(rest, links, turn, percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "hub-pairs")
        near = materialise(closest(sketched(pairs, full, percent, folded=False)), "near-hubs")
        discard(spark, pairs_at)
        asked = near.count()
        if not asked:
            break
        found = verify(near, nodes, docs, words, percent, "links-to-hubs")
        links, tried = links.union(found), tried.union(near)
        n = found.count()
        if n:
            parts = united(parts, found)
            fewer, at = stored(mixed_lists(rest.drop("component", "band"), parts, percent), "mixed-lists")
            discard(spark, rest_at)
            rest, rest_at = fewer, at
        if n < JOINED * asked:
            break
    more = materialise(cross_pairs(rest, percent).distinct(), "cross-pairs")
    more = materialise(sketched(more, full, percent, folded=False).join(tried, ["a", "b"], "left_anti").select("a", "b"), "near-rest")
    if not more.isEmpty():
        parts = united(parts, verify(more, nodes, docs, words, percent, "links-rest"))
    return signed, nodes.join(parts, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))


def united(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links: each stands for its members by their stars, so that earlier links are not followed again."""
    return materialise(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "parts")


def numbered(signed: DataFrame) -> DataFrame:
    """Adds node, a 64-bit number of each distinct set; should two sets get the same, one gets another."""
    out = signed.withColumn("node", node_number())
    for seed in range(1, 100):
        twice = out.groupBy("node").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select(F.col("node").alias("t"), "d")
        if twice.isEmpty():
            return out
        out = materialise(out.join(twice, out["node"] == twice["t"], "left").withColumn("node", F.when(F.col("t").isNotNull() & (F.col("digest") != F.col("d")), node_number(seed)).otherwise(F.col("node"))).drop("t", "d"), "numbered")
    raise RuntimeError("sets cannot be numbered")


def distinct_lists(listed: DataFrame) -> DataFrame:
    """key, low, high of lists of two sets or more: of lists with the same members one is enough.

    Members are told by their number, smallest, largest and two sums of hashes; a list too long for its sums
    stays by itself.
    """
    part = lambda seed: F.try_sum(F.shiftrightunsigned(F.xxhash64("node", F.lit(seed)), 24))
    lists = listed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("c"), part(11).alias("x"), part(12).alias("y")).where("low < high")
    own = F.when(F.col("x").isNull() | F.col("y").isNull(), F.col("key"))
    return lists.groupBy("low", "high", "c", "x", "y", own.alias("own")).agg(F.min("key").alias("key")).select("key", "low", "high")


#: The lowest 8 bits of a node's number are its size class: sizes in one class differ by less than a twentieth.
CLASS_RATIO = 1.05


def node_number(seed: int = 0) -> Column:
    """56 bits of the digest's hash, then the size class of the set."""
    size_class = F.least(F.lit(255), F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / float(np.log(CLASS_RATIO)))).cast("long")
    return F.shiftleft(F.xxhash64("digest", F.lit(seed)), 8).bitwiseOR(size_class)


def classes_apart(percent: int) -> int:
    """How many size classes two linking sets are apart at most."""
    return int(np.ceil(np.log(100 / percent) / np.log(CLASS_RATIO))) + 1


def size_class_near(a: str, b: str, percent: int) -> Column:
    """Whether sets of these nodes may be within the size ratio."""
    apart = classes_apart(percent)
    low = lambda c: F.col(c).bitwiseAND(F.lit(255))
    return F.abs(low(a) - low(b)) <= apart


def mixed_lists(live: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The lists' rows, with component and band, where two components meet among sizes that may link: these are in the same band or in neighbours."""
    tagged = live.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tagged = tagged.withColumn("band", F.floor(F.col("node").bitwiseAND(F.lit(255)) / classes_apart(percent)))
    bands = tagged.groupBy("key", "band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = around(bands).groupBy("key", "band").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select(F.xxhash64("key", "band").alias("kb"))
    tagged = tagged.withColumn("kb", F.xxhash64("key", "band"))
    return tagged.join(mixed, "kb", "left_semi").drop("kb")


def around(bands: DataFrame) -> DataFrame:
    """Each row for its band and for the neighbours."""
    others = [c for c in bands.columns if c not in ("key", "band")]
    return bands.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *others)


def with_folded(mixed: DataFrame, full: DataFrame) -> tuple[DataFrame, str]:
    """The rows with the folded sketch of their set as s0, s1 and so on; and their path."""
    mixed, at = stored(mixed, "mixed-lists")
    folded = maybe_in(full.select("node", "folded").withColumnRenamed("node", "doc_id"), mixed.select(F.col("node").alias("id"))).withColumnRenamed("doc_id", "node")
    folded = folded.dropDuplicates(["node"]).select("node", *[F.get("folded", F.lit(k)).alias(f"s{k}") for k in range(FOLDED)])
    out = stored(mixed.join(folded, "node"), "folded")
    discard(mixed.sparkSession, at)
    return out


def hub_pairs(mixed: DataFrame, links: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each set of a mixed list with the one of most links among those alike there, if that is of another component and sketches let them link.

    Sets are alike if ALIKE_BITS bits of their sketches are the same; which, the list and the turn tell.
    """
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    h = F.xxhash64("key", F.lit(turn))
    folds = [f"s{k}" for k in range(FOLDED)]
    some = F.element_at(F.array(*folds), (F.pmod(h, F.lit(FOLDED)) + 1).cast("int"))
    shift = F.pmod(F.shiftright(h, 8), F.lit(64 - ALIKE_BITS)).cast("int")
    bits = F.call_function("shiftrightunsigned", some, shift).bitwiseAND(F.lit((1 << ALIKE_BITS) - 1))
    alike = mixed.select(F.xxhash64("key", bits).alias("alike"), "node", "component", "n", *folds).join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = alike.groupBy("alike").agg(F.max(F.struct("degree", "node", "component", "n", *folds)).alias("m"), F.count("*").alias("c")).where("c > 1")
    sides = alike.withColumnsRenamed({"n": "na"} | {f"s{k}": f"x{k}" for k in range(FOLDED)})
    hubs = hubs.select("alike", F.col("m.node").alias("hub"), F.col("m.component").alias("hub_component"), F.col("m.n").alias("nb"), *[F.col(f"m.s{k}").alias(f"y{k}") for k in range(FOLDED)])
    may = f"component <> hub_component and 100 * least(na, nb) >= {percent} * greatest(na, nb) and {differ('x', 'y', FOLDED)} <= {most_different(percent)}"
    return sides.join(hubs, "alike").where(may).select(*ordered("node", "hub")).distinct()


def cross_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within the lists that still hold several; few of them twice.

    A list's largest component is on one side only, so that its members do not meet each other. Of the lists that
    two sets share the first gives the pair; a later one does only if that is not among the first lists of both.
    """
    kept = mixed.withColumn("k", F.xxhash64("key"))
    largest = kept.groupBy("k", "component").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", "component")).alias("m")).select("k", F.col("m.component").alias("major"))
    firsts = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, EARLIER_LISTS).alias("earlier"))
    rest = kept.join(largest, "k").join(firsts, "node").withColumn("earlier", F.filter("earlier", lambda x: x < F.col("key")))
    rest = materialise(rest, "with-earlier")
    a = rest.where("component <> major").select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("earlier").alias("ea"), *[F.col(f"s{i}").alias(f"x{i}") for i in range(FOLDED)])
    b = rest.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("earlier").alias("eb"), (F.col("component") == F.col("major")).alias("on_one_side"), *[F.col(f"s{i}").alias(f"y{i}") for i in range(FOLDED)])
    may = f"ca <> cb and (on_one_side or a < b) and 100 * least(na, nb) >= {percent} * greatest(na, nb) and {differ('x', 'y', FOLDED)} <= {most_different(percent)} and not arrays_overlap(ea, eb)"
    return a.join(b, (a["key"] == b["key"]) & F.expr(may)).select(*ordered("a", "b"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
