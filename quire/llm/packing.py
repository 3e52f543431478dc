"""Best-fit packing of documents into sequences, repacked until bounds certify it.

Pieces are spread over groups by hash. Each group packs best-fit decreasing, then dual-feasible
functions give a lower bound on its number of sequences. A group at its bound keeps all but its
emptiest sequence; one with a gap gives up its emptiest sequences, one more than the gap. What is
given up is exchanged: it meets in fewer, merged groups and is packed again, round after
round, until one group is left, or a round gives up so much that the next would not have half as many
groups. Groups hold a bounded number of pieces at any scale.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import kept, materialise, release_memory, table, words_of

CAPACITY, GROUP_PIECES = 2048, 4096
END_ID = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The only steps with which ids of a text are those of its words: other files are encoded text by text.
CASELESS_WORDS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
)
#: Merging step by step takes time with the square of a word's length: longer words go to the library.
LONGEST = 64
#: Marks, letters of which normalising changes none, marks: each run is a token group by itself.
_PARTS = re.compile(r"([!-&(-/:-@\[-`{-~]*)([a-z\xdf-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)").fullmatch


class Merges:
    """Byte-pair merging of many words at once: a row a word, and in each step every row merges its first pair of least rank."""

    def __init__(self, vocab: dict[str, int], merges: list):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        symbol = [hidden.get(b, chr(b)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in symbol], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in symbol], np.int64)
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        code = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code)
        self.code, self.rank = code[order], order
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.code, code), self.none - 1)
        return np.where(self.code[at] == code, self.rank[at], self.none)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        for size, every in groups.items():
            step = max(1, 65_536 // size)
            for k in range(0, len(every), step):
                self._encode(words, every[k : k + step], size, out)
        return out

    def _encode(self, words: list[bytes], at: list[int], size: int, out: list) -> None:
        raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, size)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        rank = np.full(ids.shape, self.none, np.int64)
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        rows, left = np.arange(len(at)), np.full(len(at), size)
        while len(rows):
            k = rank.argmin(1)
            each = np.arange(len(rows))
            best = rank[each, k]
            done = best == self.none
            for r in np.flatnonzero(done).tolist():
                out[at[rows[r]]] = ids[r, : left[r]].astype("<u4").tobytes()
            go = ~done
            ids, rank, rows, left, k, best = ids[go], rank[go], rows[go], left[go] - 1, k[go], best[go]
            if not len(rows):
                break
            each = np.arange(len(rows))
            move = np.minimum(np.arange(size) + (np.arange(size) > k[:, None]), size - 1)
            ids, rank = np.take_along_axis(ids, move, 1), np.take_along_axis(rank, move, 1)
            ids[each, k] = self.joined[best]
            # beyond a row's end nothing merges
            right = k + 1 < left
            rank[each, k] = np.where(right, self.ranks(ids[each, k], ids[each, np.minimum(k + 1, size - 1)]), self.none)
            rank[each, left - 1] = self.none
            before = k > 0
            rank[each[before], k[before] - 1] = self.ranks(ids[each[before], k[before] - 1], ids[each[before], k[before]])


class WordTokenizer:
    """Ids of a tokenizer that ignores case and drops white space, with memoised words.

    White space always ends a token and composes with nothing, so the ids of a text are those of its
    words, one after the other. Of a word new to the memo, runs of plain letters and of marks are
    encoded apart: new letter runs are merged here, many at once; what is left goes to the library together.
    A memo that is full, by entries or by what long words take, starts anew. A file with other rules than
    ``CASELESS_WORDS`` is encoded text by text.
    """

    def __init__(self, path: str, most: int = 500_000, most_long: int = 16 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        steps = [(made[k] or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.by_word = steps == list(CASELESS_WORDS) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        self.by_word = self.by_word and all("<|" in t["content"] and t["content"].isascii() for t in made["added_tokens"])
        self.merges = Merges(model["vocab"], model["merges"]) if self.by_word else None
        self.known: dict[str, bytes] = {}
        self.most, self.most_long, self.long = most, most_long, 0

    @staticmethod
    def words(text: str) -> list[str]:
        """Split at white space; of what Python calls so, the four separator controls are none to the tokenizer."""
        return words_of(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def learn(self, words: set[str]) -> None:
        known = self.known
        split, odd = {}, set()
        for w in words:
            m = _PARTS(w.lower())
            if m and "<|" not in w and len(w) <= LONGEST:
                split[w] = m.groups()
            else:
                odd.add(w)
        stems = [t for t in {p[1] for p in split.values()} if t and t not in known]
        known.update(zip(stems, self.merges.encode([t.encode() for t in stems]), strict=True))
        odd |= {t for p in split.values() for t in (p[0], p[2]) if t}
        self.encode([t for t in odd if t not in known])
        known.setdefault("", b"")
        for w, (head, stem, tail) in split.items():
            if w != stem:
                known[w] = known[head] + known[stem] + known[tail]

    def encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[w] = ids = as_bytes(e.ids)
                self.long += len(w) + len(ids) if len(w) > LONGEST else 0

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.known) > self.most or self.long > self.most_long:
            self.known.clear()
            self.long = 0
        get = self.known.get
        lists = [self.words(t) if t else [] for t in texts]
        out = [list(map(get, ws)) for ws in lists]
        late = [i for i, ids in enumerate(out) if None in ids]
        if late:
            self.learn({w for i in late for w, x in zip(lists[i], out[i], strict=True) if x is None})
            for i in late:
                out[i] = map(get, lists[i])
        return [b"".join(ids) for ids in out]


def as_bytes(ids: list[int]) -> bytes:
    return pack_ids[len(ids)](*ids) if len(ids) < len(pack_ids) else np.array(ids, "<u4").tobytes()


pack_ids = [struct.Struct(f"<{n}I").pack for n in range(17)]


@kept
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """The ids of each whole text, then id 0, cut into pieces of ``capacity`` ids (the last may be shorter)."""

    def run(batches):
        release_memory(word_tokenizer)
        t = word_tokenizer(tokenizer_path)
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), t.ids(b.column(1).to_pylist()), strict=True):
                raw += END_ID
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free, n = 0, 0  # bit r of free: some bin has r free
    for i in order.tolist():
        size = int(lengths[i])
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            b, r = n, capacity
            n += 1
        bins[i] = b
        if r > size:
            room[r - size].append(b)
            free |= 1 << (r - size)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of three families of dual-feasible functions over all their parameters."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    total, items = np.cumsum(count * x), np.cumsum(count)
    best = -(-int(total[-1]) // capacity)  # the identity
    a = np.arange(1, capacity // 2 + 1)  # short items count 0, long ones a whole sequence
    long_items = items[-1] - items[capacity - a]
    best = max(best, int(np.max(-(-(long_items * capacity + total[capacity - a] - total[a - 1]) // capacity))))
    over, half = items[-1] - items[capacity // 2], count[capacity // 2] if capacity % 2 == 0 else 0
    best = max(best, int(over + (half + 1) // 2))
    for k in range(1, 33):  # rounding down to multiples of 1 / k
        y = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * y).sum()) // (k * capacity)))
    return best


def pack_group(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and which items their group gives up."""
    bins = best_fit_decreasing(lengths, capacity)
    order = np.lexsort((np.arange(len(bins)), bins))
    ends = np.cumsum(lengths[order])
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = ends - lengths[order] - base
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    given = np.zeros(len(fill), bool)
    if not last:
        gap = len(fill) - lower_bound(lengths, capacity)
        emptiest = np.argsort(fill, kind="stable")[: gap + 1]
        given[emptiest[fill[emptiest] < capacity]] = True
    return bins, offsets, given[bins]


def pack_round(items: DataFrame, groups: int, first_sequence: int, capacity: int, last: bool) -> DataFrame:
    """One round: items get sequence_id, offset and ``given``."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        g = table.column("g")[0].as_py()
        bins, offsets, given = pack_group(lengths, capacity, last)
        # numbers of a group leave room for one sequence an item, and so for any of its size
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "h"])
        sequence = first_sequence + g * (1 << 32) + bins
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets)).append_column("given", pa.array(given))

    dealt = items.withColumn("g", F.pmod(F.col("h"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, f"{PIECES}, h long, sequence_id long, offset long, given boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset. Equal rows are separate items; an empty table gives no rows."""
    items = materialise(pieces.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    groups = max(1, -(-items.count() // group_pieces))
    done, k = [], 0
    while True:
        last = groups == 1
        packed = materialise(pack_round(items, groups, k << 58, capacity, last), f"packed{k}")
        after = -(-packed.where("given").count() // group_pieces) if not last else 0
        last = last or 2 * after > groups  # what every group gave up stays where it was packed
        done.append(packed if last else packed.where(~F.col("given")))
        if last or not after:
            break
        items, groups, k = packed.where("given").select(*items.columns), after, k + 1
    return reduce(DataFrame.union, done).drop("h", "given")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents, packed.

    Null and empty texts are one piece of one id. Null and repeated ids are kept, each row its own
    document. A very long text becomes many pieces; all but its last fill a sequence alone.
    """
    return pack(tokenize_pieces(docs, tokenizer_path, capacity), capacity, group_pieces)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
