"""Document likelihood over all subword segmentations.

The vocabulary is that of an existing SentencePiece model. A log-space forward recursion over
each word's lattice adds up the probabilities of all its segmentations; a text's marginal
probability is the product over its words (no piece crosses a word boundary) and one end.

The file's scores are merge ranks; taken as a Zipf law they are the first piece weights. Each
further step of expectation-maximisation runs over all distinct training words and their counts.

Each distinct training word is scored once. The most frequent ones (a fixed number) are broadcast as
sorted 64-bit hashes with counts and scores; the rest of a document's words is joined with the table
of all, and words that no training text has are scored after that join.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe_count import MARK
from quire.llm.common import materialise, remainder, table

#: Bound of the broadcast counts and scores: 24 bytes a word.
FREQUENT_WORDS = 1_000_000
EM_STEPS = 2
SMOOTHING = 0.5
KNOWN_WORDS = 1_400_000
#: Words of more characters are taken in parts of as many.
LONG = 8_192
SEED = 42  # of Spark's xxhash64


class Windows:
    """64-bit hashes of all windows of words of one length: a polynomial over code points, finalised."""

    BASE = 0x9E3779B97F4A7C55

    def __init__(self, longest: int):
        self.longest = longest
        self.powers = self.inverse = np.ones(0, np.uint64)

    def prefix(self, words: list[str]) -> np.ndarray:
        """Sums from each word's beginning to each place."""
        size = len(words[0])
        if size > len(self.powers):
            n = max(64, size)
            self.powers, self.inverse = (np.array([pow(b, i, 1 << 64) for i in range(n)], np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
        c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size).astype(np.uint64) + np.uint64(1)
        out = np.zeros((len(words), size + 1), np.uint64)
        np.cumsum(c * self.powers[:size], axis=1, out=out[:, 1:])
        return out

    def between(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Of each word and place the hash of the k characters from there on."""
        h = (prefix[:, k:] - prefix[:, :-k]) * self.inverse[: prefix.shape[1] - k]
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, words: list[str], k: int) -> np.ndarray:
        return self.between(self.prefix(words), k)


class Pieces:
    """The vocabulary: piece to index, then 256 bytes and the end."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        rank = np.array([-sp.get_score(sp.piece_to_id(p)) for p in texts])
        self.index = {p: i for i, p in enumerate(texts)}
        self.longest = max(map(len, texts))
        self.hashes = Windows(self.longest)
        self.by_length = {}  # of each length: sorted hashes of its pieces, and their indices
        for k in sorted(set(map(len, texts))):
            at = np.array([i for i, p in enumerate(texts) if len(p) == k])
            h = self.hashes.of([texts[i] for i in at], k)[:, 0]
            order = np.argsort(h)
            self.by_length[k] = (h[order], at[order])
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces have one hash")
        self.filter = np.zeros(1 << 20, bool)
        for h, _ in self.by_length.values():
            self.filter[h >> np.uint64(44)] = True
        self.bytes, self.end, self.size = len(texts), len(texts) + 256, len(texts) + 257
        first = 1 / (np.argsort(np.argsort(rank, kind="stable")) + 10.0)
        p = np.concatenate([first, np.full(256, first.min() / 10), [first.max()]])
        self.start = np.log(p / p.sum())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def edges(v: Pieces, words: list[str]) -> tuple[np.ndarray, list]:
    """Lattice edges of words of one length: rows of word, end, characters - 1, piece; and the characters that are no piece.

    All windows of a length are looked up at once, by 64-bit hash.
    """
    size, parts, odd = len(words[0]), [], []
    prefix = v.hashes.prefix(words)
    for k, (keys, pieces_) in v.by_length.items():
        if k > size:
            break
        h = v.hashes.between(prefix, k).ravel()
        at = np.flatnonzero(v.filter[h >> np.uint64(44)])
        wanted = h[at]
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[found] == wanted
        at = at[hit]
        word, start = np.divmod(at, size - k + 1)
        parts.append(np.stack([word, start + k - 1, np.full(len(at), k - 1), pieces_[found[hit]]]))
        if k == 1:
            none = np.ones(len(h), bool)
            none[at] = False
            odd = [divmod(i, size) for i in np.flatnonzero(none).tolist()]
    return np.concatenate(parts, axis=1), odd


def weights(v: Pieces, words: list[str], e: np.ndarray, odd: list, logp: np.ndarray) -> np.ndarray:
    """Log weights by word, end and characters - 1; a character that is no piece weighs what its bytes weigh together."""
    w = np.full((len(words), len(words[0]), int(e[2].max()) + 1 if e.shape[1] else 1), -np.inf)
    w[e[0], e[1], e[2]] = logp[e[3]]
    for r, j in odd:
        w[r, j, 0] = sum(logp[v.bytes + b] for b in words[r][j].encode("utf-8", "surrogatepass"))
    return w


def forward(w: np.ndarray) -> np.ndarray:
    """Log of the summed weight of all ways to each place."""
    n, size, most = w.shape
    a = np.full((n, size + 1), -np.inf)
    a[:, 0] = 0
    for j in range(1, size + 1):
        k = min(most, j)
        ways = a[:, j - k : j][:, ::-1] + w[:, j - 1, :k]
        top = ways.max(1)
        a[:, j] = top + np.log(np.exp(ways - top[:, None]).sum(1))
    return a


def log_sum(ways: np.ndarray) -> float:
    top = ways.max()
    return top + math.log(np.exp(ways - top).sum()) if top > -np.inf else -np.inf


def long_forward(v: Pieces, logp: np.ndarray, word: str) -> np.ndarray:
    """``forward`` of one long word: weights are made for LONG ends at a time."""
    a = np.full(len(word) + 1, -np.inf)
    a[0] = 0
    for low in range(0, len(word), LONG):
        first = max(0, low - v.longest + 1)
        part = word[first : low + LONG]
        w = weights(v, [part], *edges(v, [part]), logp)[0]
        for j in range(low, first + len(part)):
            k = min(w.shape[1], j + 1)
            a[j + 1] = log_sum(a[j + 1 - k : j + 1][::-1] + w[j - first, :k])
    return a


def long_expected(v: Pieces, logp: np.ndarray, word: str, total: np.ndarray, count: float) -> None:
    """Adds the expected pieces of one long word to ``total``: weights are made for LONG beginnings at a time."""
    a, b = long_forward(v, logp, word), np.full(len(word) + 1, -np.inf)
    b[-1] = 0
    for low in range((len(word) - 1) // LONG * LONG, -1, -LONG):
        part = word[low : low + LONG + v.longest - 1]
        e, odd = edges(v, [part])
        w = weights(v, [part], e, odd, logp)[0]
        own = min(LONG, len(word) - low)
        for i in range(own - 1, -1, -1):
            k = np.arange(min(w.shape[1], len(part) - i))
            b[low + i] = log_sum(w[i + k, k] + b[low + i + k + 1])
        _, j, k, piece = e[:, e[1] - e[2] < own]
        mass = np.exp(a[low + j - k] + logp[piece] + b[low + j + 1] - a[-1]) * count
        total += np.bincount(piece, weights=mass, minlength=v.size)
        for _, j in odd:
            if j < own:
                m = math.exp(a[low + j] + w[j, 0] + b[low + j + 1] - a[-1]) * count
                for byte in part[j].encode("utf-8", "surrogatepass"):
                    total[v.bytes + byte] += m


def by_length(words, most: int = 4096):
    """Places of words of equal length, in groups of bounded size; long words one by one."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= LONG:
            yield [i]
            continue
        g = groups.setdefault(len(w), [])
        g.append(i)
        if len(g) * (len(w) + 1) >= most * 8:
            yield groups.pop(len(w))
    yield from groups.values()


def marginals(v: Pieces, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log probability of each word (with its mark), over all segmentations."""
    out = np.zeros(len(words))
    for at in by_length(words):
        part = [MARK + words[i] for i in at]
        if len(part[0]) > LONG:
            out[at] = long_forward(v, logp, part[0])[-1]
            continue
        out[at] = forward(weights(v, part, *edges(v, part), logp))[:, -1]
    return out


def expected(v: Pieces, logp: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations, by forward and backward sums."""
    total = np.zeros(v.size)
    for at in by_length(words):
        part = [MARK + words[i] for i in at]
        if len(part[0]) > LONG:
            long_expected(v, logp, part[0], total, float(counts[at[0]]))
            continue
        e, odd = edges(v, part)
        w = weights(v, part, e, odd, logp)
        n, size, most = w.shape
        a, b = forward(w), np.full((n, size + 1), -np.inf)
        b[:, size] = 0
        for j in range(size - 1, -1, -1):
            k = np.arange(min(most, size - j))
            ways = w[:, j + k, k] + b[:, j + k + 1]
            top = ways.max(1)
            b[:, j] = top + np.log(np.exp(ways - top[:, None]).sum(1))
        r, j, k, piece = e
        mass = np.exp(a[r, j - k] + logp[piece] + b[r, j + 1] - a[r, -1]) * counts[at][r]
        total += np.bincount(piece, weights=mass, minlength=v.size)
        for r, j in odd:
            m = np.exp(a[r, j] + w[r, j, 0] + b[r, j + 1] - a[r, -1]) * counts[at[r]]
            for byte in part[r][j].encode("utf-8", "surrogatepass"):
                total[v.bytes + byte] += m
    return total


def together(batches, rows: int = 50_000, size: int = 1 << 24):
    """Batches joined up to about so many rows or bytes: the more words there are of each length, the fewer steps they take."""
    held, n, total = [], 0, 0
    for b in batches:
        held.append(b)
        n, total = n + b.num_rows, total + b.nbytes
        if n >= rows or total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, total = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def words_of_bytes(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text in UTF-8, A-Z lowered: bytes know no other case and no other white space than ASCII's."""
    return [t.lower().split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all whole texts: combined in each task, then by word."""

    def run(batches):
        c: Counter = Counter()
        for b in batches:
            for ws in words_of_bytes(b.column(0)):
                c.update(ws)
                if len(c) > 400_000:
                    yield out(c)
                    c = Counter()
        if c:
            yield out(c)

    def out(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, ends: int, model_path: str, steps: int = EM_STEPS) -> np.ndarray:
    """Log weights of the pieces after expectation-maximisation over all distinct words."""
    v = pieces(model_path)
    logp = v.start
    for _ in range(steps):
        model = counts.sparkSession.sparkContext.broadcast(logp)

        def run(batches, model=model):
            v, total = pieces(model_path), 0.0
            for b in together(batches):
                total = total + expected(v, model.value, b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64))
            if not np.isscalar(total):
                at = np.nonzero(total)[0]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "mass"])

        got = counts.select("word", "n").mapInArrow(run, "piece int, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).toPandas()
        mass = np.zeros(v.size)
        mass[got["piece"].to_numpy()] = got["mass"].to_numpy()
        mass[v.end] += ends
        p = mass + SMOOTHING * np.exp(v.start) * v.size
        logp = np.log(p / p.sum())
    return logp


class Scorer:
    """Per task: words already met get an index into arrays of their numbers."""

    def __init__(self, hashes, counts, marginal, total, distinct):
        self.hashes, self.counts, self.marginal = hashes, counts, marginal
        self.denominator = math.log10(total + distinct + 1)
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.base = self.score = np.empty(0)
        self.rare = np.empty(0, bool)

    def learn(self, new: list[bytes]) -> None:
        h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in new], np.uint64).view(np.int64)
        n, m = np.zeros(len(new), np.int64), np.zeros(len(new))
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[k] == h
            n, m = np.where(hit, self.counts[k], 0), np.where(hit, self.marginal[k], 0.0)
        self.base = np.r_[self.base, np.log10(n + 1.0) - self.denominator]
        self.score = np.r_[self.score, m]
        self.rare = np.r_[self.rare, n == 0]
        self.at.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.words.extend(new)

    def texts(self, lists: list[list[bytes]]):
        """Of each text: the base and model scores of its words, and its words that are not frequent, with how often."""
        if len(self.words) > KNOWN_WORDS:
            self.clear()
        get = self.at.get
        found = [list(map(get, ws)) for ws in lists]
        late = [k for k, i in enumerate(found) if None in i]
        if late:
            self.learn(sorted({w for k in late for w, i in zip(lists[k], found[k], strict=True) if i is None}))
            for k in late:
                found[k] = list(map(get, lists[k]))
        for i in found:
            i = np.fromiter(i, np.int64, len(i))
            r = self.rare[i]
            odd, times = np.unique(i[r], return_counts=True) if r.any() else ((), ())
            yield float(self.base[i[~r]].sum()), float(self.score[i[~r]].sum()), int((~r).sum()), [self.words[k] for k in odd], list(map(int, times))


def among_most(counts: DataFrame, most: int) -> Column:
    """Whether a word is among about ``most`` of the largest counts, at most so many: all from one count on, and a share of the next by hash."""
    rows = counts.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("c")).collect()
    room, share, least = most, 0.0, 1 << 62
    for n, c in sorted(map(tuple, rows), reverse=True):
        if c > room:
            share = max(0.0, 0.95 * room / c - 0.001)
            break
        room, least = room - c, n
    below = max((n for n, _ in map(tuple, rows) if n < least), default=0)
    return (F.col("n") >= least) | ((F.col("n") == below) & (F.pmod(F.xxhash64("word", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)))


def score_documents(docs: DataFrame, model_path: str, is_training: Column, frequent: int = FREQUENT_WORDS, steps: int = EM_STEPS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Null and empty texts have one token, the end. Null and repeated ids stay, each row its own
    document. Without training rows all counts are 0.
    """
    spark = docs.sparkSession
    training = docs.where(is_training)
    counts = materialise(count_words(training.select(F.col("text").cast("string").alias("text"))), "word-counts")
    ends = training.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, distinct + (ends > 0)
    logp = fit_pieces(counts, ends, model_path, steps)
    log10p = spark.sparkContext.broadcast(logp)

    def weigh(batches):
        v = pieces(model_path)
        for b in together(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marginals(v, log10p.value, b.column(0).to_pylist()) / math.log(10))], names=["word", "n", "marginal"])

    counts = materialise(counts.select("word", "n").mapInArrow(weigh, "word string, n long, marginal double"), "word-scores")
    top = counts.where(among_most(counts, frequent)).select(F.xxhash64("word").alias("h"), "n", "marginal").toArrow()
    h, n, m = (top.column(c).to_numpy() for c in ("h", "n", "marginal"))
    order = np.argsort(h)
    model = spark.sparkContext.broadcast((h[order], n[order], m[order]))
    del top, h, n, m

    def run(batches):
        s = Scorer(*model.value, total, distinct)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                lists = words_of_bytes(part.column("text"))
                base, score, known, odd, times = (list(c) for c in zip(*s.texts(lists), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array([len(x) + 1 for x in lists], pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(known, pa.int64()), pa.array(odd, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_tokens", "base", "marginal", "known", "odd", "times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialise(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, base double, marginal double, known long, odd array<string>, times array<long>"), "scored")
    odd = scored.select("row", F.explode(F.arrays_zip("odd", "times")).alias("z")).select("row", F.col("z.odd").alias("word"), F.col("z.times").alias("times"))

    def weigh_new(batches):
        """The words that no training text has are scored here; the others bring their score along."""
        v = pieces(model_path)
        for b in together(batches):
            m = b.column("marginal").to_numpy(zero_copy_only=False).astype(np.float64)
            new = np.flatnonzero(np.isnan(m))
            if len(new):
                words, at = np.unique(np.array(b.column("word").take(pa.array(new)).to_pylist(), object), return_inverse=True)
                m[new] = (marginals(v, log10p.value, words.tolist()) / math.log(10))[at]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("times"), b.column("n"), pa.array(m)], names=["row", "times", "n", "marginal"])

    found = odd.join(counts, "word", "left").select("row", "word", "times", F.coalesce("n", F.lit(0)).alias("n"), "marginal").mapInArrow(weigh_new, "row long, times long, n long, marginal double")
    n = F.col("n")
    rest = found.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rest_known"), F.sum(F.col("times") * (F.log10(n + 1.0) - F.log10(F.lit(float(total + distinct + 1))))).alias("rest_base"), F.sum(F.col("times") * F.col("marginal")).alias("rest_marginal"))
    out = scored.drop("odd", "times").join(rest, "row", "left")
    v = pieces(model_path)
    end_base = math.log10(ends + 1.0) - math.log10(total + distinct + 1)
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("marginal") + F.coalesce("rest_marginal", F.lit(0.0)) + float(logp[v.end]) / math.log(10)).alias("score"),
    )


def op8_lattice_lm(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    out = score_documents(docs, vocabulary or public_tokenizers.path("piece_bpe_32k.model"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


