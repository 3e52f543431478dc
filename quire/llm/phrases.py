"""Phrase collocation mining with weighted acyclic automata.

Texts are coded once: chunks of one language hold a sorted vocabulary and word numbers, with breaks between pieces.
Word and phrase hashes are counted length by length, where both shorter parts of a phrase must be frequent; this only
chooses. Exact counts come from automata: each shard builds a minimal acyclic transducer from its sorted phrases,
whose weights along a path add up to a count; transducers are cut at the limits of prefix ranges and those of a range
united with their weights summed; the parts of candidates are looked up by composing an acceptor of them with it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import bound_bytes, materialise, table

LONGEST, LEAST, TOP = 5, 100, 2000
UNDETERMINED = "und"
#: Bytes of text of a chunk, distinct phrases of a task's sums, phrases of a shard's dictionary and of one stored transducer.
CHUNK, HELD, SHARD, PART = 8 << 20, 2_000_000, 400_000, 20_000
#: Words for which counts of hashes are dealt to one more group.
GROUP_WORDS = 4_000_000
#: Phrases (with the shards that hold them) of a prefix range, transducers united at once, and transducers read to set the ranges.
RANGE, UNITED, SAMPLE = 500_000, 64, 10_000
#: Chunks and transducers that a reader holds at once.
GROUP_ROWS = 8
#: Bits of the filters that choose phrases; when more is frequent than they can tell apart, more is counted exactly.
FILTER_BITS = 26
#: Languages whose totals may be broadcast.
MAX_TOTALS = 100_000

#: A-Z in lower case, tabs as spaces; ends of pieces become full stops.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
CODED = "lang string, words array<string>, ids array<int>"
STORED = "lang string, first string, phrases int, words array<string>, arcs array<int>, label array<int>, target array<int>, weight array<long>, final array<long>"
Phrase = tuple[str, ...]


def ragged(flat) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def coded_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, sorted by bytes, and the texts as numbers of words from 1 on; 0 is a break between pieces."""
    a = np.frombuffer(b".".join(texts).translate(_FOLD), np.uint8)
    word = (a != 32) & (a != 46)
    start = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    size = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1 - start
    letters, ends = a[word], np.r_[0, np.cumsum(size)]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(1, len(order) + 1)
    stops = np.cumsum(a == 46)[start]
    gap = np.r_[False, stops[1:] > stops[:-1]]
    ids = np.zeros(len(start) + int(gap.sum()) + 1, np.int32)
    ids[np.arange(len(start)) + np.cumsum(gap)] = number[words.indices.to_numpy()]
    return words.dictionary.take(pa.array(order)).cast(pa.binary()).cast(pa.string()), ids


def code(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Chunks of coded texts, of about CHUNK bytes: see ``coded_words``."""

    def out(name: str, texts: list[bytes]):
        words, ids = coded_words(texts)
        return pa.RecordBatch.from_arrays([pa.array([name]), ragged(words), ragged(pa.array(ids))], names=["lang", "words", "ids"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    held.setdefault(name, []).append(t)
                    sizes[name] = sizes.get(name, 0) + len(t)
                    if sizes[name] >= CHUNK:
                        sizes.pop(name)
                        yield out(name, held.pop(name))
            while sum(sizes.values()) >= 4 * CHUNK:  # many languages: the largest part goes first
                name = max(sizes, key=sizes.get)
                sizes.pop(name)
                yield out(name, held.pop(name))
        for name, texts in held.items():
            yield out(name, texts)

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, CODED)


def chunks(batches) -> Iterator[tuple[str, list[str], np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].values.to_numpy()


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """Hashes of words, seeded by their language; at place 0, of breaks, nothing."""
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], np.uint64)


def extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of phrases that are one word longer."""
    h = h * np.uint64(0xBF58476D1CE4E5B9) ^ (word + np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Filter:
    """A Bloom filter of fixed size with two probes, over the first 48 bits of hashes."""

    def __init__(self, frequent: DataFrame):
        self.low, self.high = (1 << FILTER_BITS) - 1, 48 - FILTER_BITS
        probes = frequent.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(self.low)), F.shiftrightunsigned("h", self.high))).alias("p"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
        rows = probes.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit, h = np.ones(len(h), bool), h >> np.uint64(16)
        for p in (h & np.uint64(self.low), h >> np.uint64(self.high)):
            hit &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
        return hit


def places(lang: str, words: list[str], ids: np.ndarray, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and hashes of all phrases whose parts pass the filters, for each length up to one more than there are filters."""
    of_word = word_hashes(lang, words.to_pylist())
    good = filters[0](of_word) if filters else np.ones(len(of_word), bool)
    good[0] = False
    at = np.flatnonzero(good[ids])
    h = of_word[ids[at]]
    yield 1, at, h
    for k in range(2, min(len(filters) + 1, LONGEST) + 1):
        both = np.flatnonzero(at[:-1] + 1 == at[1:])
        at = at[both]
        h = extend(h[both], of_word[ids[at + k - 1]])
        if k <= len(filters):
            keep = filters[k - 1](h)
            at, h = at[keep], h[keep]
        yield k, at, h


def count_words(coded: DataFrame) -> DataFrame:
    """lang, n: all words with repeats."""

    def run(batches):
        for lang, _, ids in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int((ids > 0).sum())], pa.int64())], names=["lang", "n"])

    return coded.select("lang", F.lit(None).cast("array<string>").alias("words"), "ids").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def pack(h: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending hashes as differences, of four bytes where they fit, and counts of a byte."""
    gap = np.diff(h, prepend=np.uint64(0))
    wide = bool(len(gap)) and int(gap.max()) >> 32 > 0
    return bytes([wide]) + gap.astype(np.uint64 if wide else np.uint32).tobytes() + n.astype(np.uint8).tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind, size = (np.uint64, 8) if b[0] else (np.uint32, 4)
    n = (len(b) - 1) // (size + 1)
    return np.cumsum(np.frombuffer(b, kind, n, 1).astype(np.uint64)), np.frombuffer(b, np.uint8, n, 1 + size * n).astype(np.int64)


def summed(held: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with their counts added, up to ``most``."""
    h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[first], np.minimum(np.add.reduceat(n, first), most) if len(h) else n


def frequent_hashes(coded: DataFrame, filters: list[Filter], least: int, groups: int) -> DataFrame:
    """h, the first 48 bits of the hashes, of phrases that are one word longer than the filters' and may be frequent.

    Counts are added up to ``least`` only, and travel in packs of a range of hashes. Where ``least`` is over 255, a count of a
    task that passes a byte stands for a frequent phrase, as the choice may be too wide, but not too narrow.
    """
    shared = coded.sparkSession.sparkContext.broadcast(filters)
    most = min(least, 255)
    limits = (np.arange(1, groups) * ((1 << 48) / groups)).astype(np.uint64)

    def out(h, n):
        at = np.r_[0, np.searchsorted(h, limits), len(h)]
        full = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([pack(h[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for i in full], pa.binary())], names=["range", "pack"])

    def run(batches):
        held, size = [], 0
        for lang, words, ids in chunks(batches):
            *_, (_, _, h) = places(lang, words, ids, shared.value)
            held.append(summed([(h >> np.uint64(16), np.ones(len(h), np.int64))], most))
            size += len(held[-1][0])
            if size > HELD and len(held) > 1:
                held = [summed(held, most)]
                size = len(held[0][0])
            if size > HELD:
                yield out(*held.pop(0))
                held, size = [], 0
        if held:
            yield out(*summed(held, most))

    def total(t: pa.Table) -> pa.Table:
        h, n = summed([unpack(b) for b in t.column("pack").to_pylist()], 1 << 62)
        return pa.table([pa.array(h[n >= most].view(np.int64))], names=["h"])

    return coded.mapInArrow(run, "range int, pack binary").groupBy("range").applyInArrow(total, "h long")


class Transducer:
    """A minimal acyclic automaton over words; the weights on a phrase's path and at its end add up to its count."""

    def __init__(self, words: list[str], arcs, label, target, weight, final):
        self.words, self.final = words, final
        start = np.r_[0, np.cumsum(arcs)].tolist()
        each = list(zip(label, target, weight, strict=True))
        self.arcs = [each[a:b] for a, b in zip(start, start[1:], strict=False)]

    @classmethod
    def of(cls, counted: Iterable[tuple[Phrase, int]]) -> Transducer:
        """Built state by state from phrases in order: what no later phrase can change is made one with its equals.

        A weight is kept as near to the beginning as all phrases through its arc allow, so that equal endings are one.
        """
        names: dict[str, int] = {}
        register: dict[tuple, int] = {}
        path, last = [[[], [], [], -1]], ()  # labels, targets, weights, weight at the end (-1: no end)

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                labels, targets, weights, final = path.pop()
                path[-1][1][-1] = register.setdefault((final, tuple(labels), tuple(targets), tuple(weights)), len(register))

        for phrase, n in counted:
            same = 0
            while same < len(last) and same < len(phrase) and last[same] == phrase[same]:
                same += 1
            freeze(same)
            for i in range(same):
                weights = path[i][2]
                shared = min(weights[-1], n)
                over = weights[-1] - shared
                weights[-1] = shared
                if over:
                    path[i + 1][2] = [w + over for w in path[i + 1][2]]
                    path[i + 1][3] += over if path[i + 1][3] >= 0 else 0
                n -= shared
            for word in phrase[same:]:
                labels, targets, weights, _ = path[-1]
                labels.append(names.setdefault(word, len(names)))
                targets.append(-1)
                weights.append(n)
                path.append([[], [], [], -1])
                n = 0
            path[-1][3] = n
            last = phrase
        freeze(0)
        labels, targets, weights, final = path[0]
        register[final, tuple(labels), tuple(targets), tuple(weights)] = len(register)
        states = list(register)
        flat = lambda k: [x for s in states for x in s[k]]
        return cls(list(names), [len(s[1]) for s in states], flat(1), flat(2), flat(3), [s[0] for s in states])

    def __iter__(self) -> Iterator[tuple[Phrase, int]]:
        """The phrases in order, with their counts."""
        stack = [(len(self.arcs) - 1, (), 0)]
        while stack:
            state, phrase, n = stack.pop()
            if self.final[state] >= 0:
                yield phrase, n + self.final[state]
            for label, target, weight in reversed(self.arcs[state]):
                stack.append((target, (*phrase, self.words[label]), n + weight))

    def compose(self, other: Transducer) -> Iterator[tuple[Phrase, int]]:
        """The phrases that both accept, with the sums of their counts: pairs of states are walked along equal words."""
        stack = [(len(self.arcs) - 1, len(other.arcs) - 1, (), 0)]
        while stack:
            a, b, phrase, n = stack.pop()
            if self.final[a] >= 0 and other.final[b] >= 0:
                yield phrase, n + self.final[a] + other.final[b]
            there = {other.words[label]: (target, weight) for label, target, weight in other.arcs[b]}
            for label, target, weight in reversed(self.arcs[a]):
                word = self.words[label]
                if word in there:
                    to, more = there[word]
                    stack.append((target, to, (*phrase, word), n + weight + more))

    def row(self, lang: str, first: Phrase, size: int) -> pa.RecordBatch:
        arcs = [x for s in self.arcs for x in s]
        lists = [pa.array(self.words, pa.string()), pa.array([len(s) for s in self.arcs], pa.int32()), pa.array([x[0] for x in arcs], pa.int32()), pa.array([x[1] for x in arcs], pa.int32()), pa.array([x[2] for x in arcs], pa.int64()), pa.array(self.final, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([" ".join(first)]), pa.array([size], pa.int32()), *map(ragged, lists)], names=[x.split()[0] for x in STORED.split(", ")])

    @classmethod
    def read(cls, b: pa.RecordBatch | pa.Table) -> Iterator[tuple[str, Phrase, Transducer]]:
        for row in range(b.num_rows):
            lists = [b.column(x)[row].values.to_pylist() for x in ("words", "arcs", "label", "target", "weight", "final")]
            yield b.column("lang")[row].as_py(), tuple(b.column("first")[row].as_py().split(" ")), cls(*lists)


def stored(lang: str, counted: Iterable[tuple[Phrase, int]]) -> Iterator[pa.RecordBatch]:
    """Transducers of PART phrases each, of phrases in order."""
    part: list = []
    for x in counted:
        part.append(x)
        if len(part) == PART:
            yield Transducer.of(part).row(lang, part[0][0], len(part))
            part = []
    if part:
        yield Transducer.of(part).row(lang, part[0][0], len(part))


def shards(coded: DataFrame, filters: list[Filter]) -> DataFrame:
    """Transducers of the phrases that pass the filters, as each task counts them."""
    shared = coded.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        held: dict[str, dict[Phrase, int]] = {}
        for lang, words, ids in chunks(batches):
            counts = held.setdefault(lang, {})
            names = np.array(["", *words.to_pylist()], object)
            for k, at, h in places(lang, words, ids, shared.value):
                if k == 1:
                    n = np.bincount(ids[at])
                    found = np.flatnonzero(n)
                    for phrase, c in zip(names[found].tolist(), n[found].tolist(), strict=True):
                        counts[phrase,] = counts.get((phrase,), 0) + c
                    continue
                _, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                grams = ids[at[:, None] + np.arange(k)]
                if not np.array_equal(grams[first][of], grams):  # two phrases of one hash: told apart by their words
                    grams, n = np.unique(grams, axis=0, return_counts=True)
                else:
                    grams = grams[first]
                for phrase, c in zip(map(tuple, names[grams].tolist()), n.tolist(), strict=True):
                    counts[phrase] = counts.get(phrase, 0) + c
            if len(counts) > SHARD:
                yield from stored(lang, sorted(held.pop(lang).items()))
        for lang, counts in held.items():
            yield from stored(lang, sorted(counts.items()))

    return coded.mapInArrow(run, STORED)


def ranges(parts: DataFrame) -> list[tuple[str, Phrase]]:
    """Where prefix ranges of about RANGE phrases begin, by the beginnings of SAMPLE stored transducers at most."""
    n, size = parts.agg(F.count("*"), F.coalesce(F.sum("phrases"), F.lit(0))).first()
    rows = parts.select("lang", "first", "phrases").orderBy(F.xxhash64("lang", "first", "phrases")).limit(SAMPLE).collect()
    rows = sorted((r["lang"], tuple(r["first"].split(" ")), r["phrases"]) for r in rows)
    each = sum(r[2] for r in rows) / max(1, -(-size // RANGE))
    out, load = [], 0
    for lang, first, phrases in rows:
        if load >= each and (not out or out[-1] != (lang, first)):
            out.append((lang, first))
            load = 0
        load += phrases
    return out


RANGED = STORED + ", range int, share int"


def ranged(batch: pa.RecordBatch, at: int, share: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([at], pa.int32()), pa.array([share], pa.int32())], names=[*batch.schema.names, "range", "share"])


def cut_at(parts: DataFrame, limits: list[tuple[str, Phrase]], shares: int) -> DataFrame:
    """Each transducer in as many as the ranges it reaches into; ``share`` deals a range's transducers out."""
    shared = parts.sparkSession.sparkContext.broadcast(limits)

    def run(batches):
        limits = shared.value
        for b in batches:
            for i, (lang, first, automaton) in enumerate(Transducer.read(b)):
                share = xxhash.xxh32_intdigest(repr((lang, first, b.column("phrases")[i].as_py()))) % shares
                at = bisect_right(limits, (lang, first))
                held: list = []
                for x in automaton:
                    while at < len(limits) and (lang, x[0]) >= limits[at]:
                        if held:
                            yield ranged(Transducer.of(held).row(lang, held[0][0], len(held)), at, share)
                            held = []
                        at += 1
                    held.append(x)
                yield ranged(Transducer.of(held).row(lang, held[0][0], len(held)), at, share)

    return parts.mapInArrow(run, RANGED)


def union(parts: DataFrame, least: int, *by: str) -> DataFrame:
    """The transducers of a group united, weights of equal phrases summed; sums below ``least`` go."""

    def summed(sources: list[Transducer]) -> Iterator[tuple[Phrase, int]]:
        last, total = None, 0
        for phrase, n in heapq.merge(*sources):
            if phrase != last:
                if last is not None and total >= least:
                    yield last, total
                last, total = phrase, 0
            total += n
        if last is not None and total >= least:
            yield last, total

    def run(t: pa.Table) -> pa.Table:
        at, share = t.column("range")[0].as_py(), t.column("share")[0].as_py()
        by_lang: dict[str, list[Transducer]] = {}
        for lang, _, automaton in Transducer.read(t):
            by_lang.setdefault(lang, []).append(automaton)
        out = [ranged(b, at, share) for lang, sources in sorted(by_lang.items()) for b in stored(lang, summed(sources))]
        return pa.Table.from_batches(out, t.schema) if out else t.slice(0, 0)

    return parts.groupBy(*by).applyInArrow(run, RANGED)


def look_up(wanted: DataFrame, united: DataFrame, limits: list[tuple[str, Phrase]]) -> DataFrame:
    """lang, phrase, f of the wanted phrases: an acceptor of those of a range is composed with its transducers."""
    shared = wanted.sparkSession.sparkContext.broadcast(limits)

    def route(batches):
        for b in batches:
            at = [bisect_right(shared.value, (lang, tuple(p.split(" ")))) for lang, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32())], names=["lang", "phrase", "range"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked: dict[str, list] = {}
        for lang, p in zip(left.column("lang").to_pylist(), left.column("phrase").to_pylist(), strict=True):
            asked.setdefault(lang, []).append((tuple(p.split(" ")), 0))
        acceptors = {lang: Transducer.of(sorted(x)) for lang, x in asked.items()}
        rows = [(lang, " ".join(p), n) for lang, _, automaton in Transducer.read(right) if lang in acceptors for p, n in acceptors[lang].compose(automaton)]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

    routed = wanted.mapInArrow(route, "lang string, phrase string, range int")
    return routed.groupBy("range").cogroup(united.groupBy("range")).applyInArrow(run, "lang string, phrase string, f long")


def score(cuts: DataFrame) -> DataFrame:
    """Adds floor(1000 * a * n / (l * r)) in whole numbers of any size."""

    def run(batches):
        for b in batches:
            a, l, r, n = (b.column(x).to_pylist() for x in ("a", "l", "r", "n"))
            got = [1000 * x * y // (u * v) for x, y, u, v in zip(a, n, l, r, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], names=[*b.schema.names, "score"])

    return cuts.mapInArrow(run, "lang string, phrase string, k int, a long, l long, r long, n long, score long")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to LONGEST words.

    Null and empty texts have no word; a null language is ``und``; repeated rows count each time; other columns are not
    read. Equal scores of two cuts of a phrase give the earlier cut; equal scores and counts of phrases are ordered by
    the bytes of the phrase.
    """
    bound_bytes(docs.sparkSession)
    coded = materialise(code(docs), "coded", GROUP_ROWS)
    totals = materialise(count_words(coded), "totals")
    groups = 8 + (totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // GROUP_WORDS)
    filters: list[Filter] = []
    for _ in range(1, LONGEST + 1):
        filters.append(Filter(frequent_hashes(coded, filters, least, groups)))
    parts = materialise(shards(coded, filters), "shards", GROUP_ROWS)
    limits = ranges(parts)
    sources = parts.count()
    shares = -(-sources // (UNITED * (len(limits) + 1)))
    united = cut_at(parts, limits, shares)
    if shares > 1:  # many shards: their sums first, so that no group is larger for it
        united = union(united, 1, "range", "share")
    united = materialise(union(united, least, "range"), "united", GROUP_ROWS)

    def tell(batches):
        for b in batches:
            for lang, _, automaton in Transducer.read(b):
                rows = list(automaton)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array([" ".join(p) for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["lang", "phrase", "a"])

    candidates = materialise(united.mapInArrow(tell, "lang string, phrase string, a long").where(F.contains("phrase", F.lit(" "))), "candidates")
    w = F.split("phrase", " ", -1)
    cuts = candidates.select("lang", "phrase", "a", w.alias("w"), F.explode(F.expr("sequence(1, size(split(phrase, ' ')) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("tail"))
    wanted = cuts.select("lang", F.explode(F.array("head", "tail")).alias("phrase")).distinct()
    counts = materialise(look_up(wanted, united, limits), "part-counts")
    joined = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    if totals.limit(MAX_TOTALS + 1).count() <= MAX_TOTALS:
        totals = F.broadcast(totals)
    scored = score(joined.join(totals, "lang").select("lang", "phrase", "k", "a", "l", "r", "n"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("z")).select("lang", "phrase", "z.*")
    # a longer phrase as frequent as a part of it has one of one word more that is as frequent, too
    longer = candidates.where(F.size(w) > 2).select("lang", "a", F.explode(F.array(F.concat_ws(" ", F.slice(w, F.lit(1), F.size(w) - 1)), F.concat_ws(" ", F.slice(w, F.lit(2), F.size(w) - 1)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.col("within") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (SELECT row_number() OVER () AS i, lang, x FROM (SELECT coalesce(lang, '{UNDETERMINED}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
k AS (SELECT unnest(range(1, {LONGEST + 1})) AS k),
s AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS j FROM w, k WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[j : j + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
v AS (SELECT u.lang, u.phrase, u.a, u.w, u.cut, h.f AS l, r.f AS r, n, CAST(1000 * CAST(u.a AS HUGEINT) * n // (CAST(h.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM u JOIN t USING (lang)
      JOIN f h ON h.lang = u.lang AND h.phrase = array_to_string(u.w[1 : cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1 :], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT DISTINCT x.lang, array_to_string(x.w[i : i + j - 1], ' ') AS phrase, x.a FROM c x, range(1, 6) AS g(i), range(2, 5) AS q(j) WHERE j < x.k AND i + j - 1 <= x.k),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND 100 * d.a >= 100 * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z WHERE rank <= {TOP}
"""
