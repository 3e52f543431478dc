"""Token counts by heap-and-linked-list byte-pair merging.

The lowest-rank adjacent pair is popped from a heap again and again; neighbours are kept in
a doubly linked list. The count is the initial symbols minus the merges made (plus the
further bytes of characters outside the vocabulary); no identifier is ever produced.

No piece of the vocabulary holds the word mark after another character, and none holds a
line feed, so merging never crosses a space-to-word boundary or a line end. Each such chunk is
counted alone and memoised in the task.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import TwoGenerationCache, table

MARK = "▁"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[str, float]:
    """Mergeable pieces of a SentencePiece BPE model: piece to rank (lower merges first)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        sp.id_to_piece(i): -sp.get_score(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))
    }


def merge_symbols(chunk: str, ranks: dict[str, float]) -> list[str]:
    """The symbols left when no adjacent pair is a piece; equal ranks merge leftmost first."""
    symbols: list[str] = list(chunk)
    n = len(symbols)
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get(symbols[i] + symbols[i + 1])
        if rank is not None:
            heap.append((rank, i, i + 1, 2))
    if not heap:
        return symbols
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, left, right, size = pop(heap)
        a, b = symbols[left], symbols[right]
        if not a or not b or len(a) + len(b) != size or after[left] != right:
            continue
        a += b
        symbols[left], symbols[right] = a, ""
        nxt = after[left] = after[right]
        if nxt < n:
            before[nxt] = left
            rank = get(a + symbols[nxt])
            if rank is not None:
                push(heap, (rank, left, nxt, size + len(symbols[nxt])))
        prev = before[left]
        if prev >= 0:
            rank = get(symbols[prev] + a)
            if rank is not None:
                push(heap, (rank, prev, left, size + len(symbols[prev])))
    return [s for s in symbols if s]


def count_chunk(chunk: str, ranks: dict[str, float]) -> int:
    """Initial symbols minus merges; a symbol outside the vocabulary counts its UTF-8 bytes."""
    return sum(1 if s in ranks else len(s.encode("utf-8", "surrogatepass")) for s in merge_symbols(chunk, ranks))


class Counter:
    """Counts the tokens of whole texts, with memoised chunks."""

    def __init__(self, path: str, half: int = 500_000):
        ranks = load_ranks(path)
        self.ranks = ranks
        self.split_lines = not any("\n" in p for p in ranks)
        self.marked = TwoGenerationCache(lambda w: count_chunk(MARK + w, ranks), half)
        self.bare = TwoGenerationCache(lambda w: count_chunk(w, ranks), half // 4)
        if any(MARK in p.lstrip(MARK) for p in ranks):
            raise ValueError("a piece holds the word mark after another character; chunks would not be independent")

    def line(self, line: str, first: bool) -> int:
        if MARK in line or "  " in line or line.endswith(" ") or (line.startswith(" ")):
            return self.spaced(line, first)
        words = line.split(" ")
        total = 0 if first else (self.bare[words.pop(0)] if words[0] else (words.pop(0), 0)[1])
        marked = self.marked
        return total + sum([marked[w] for w in words])

    def spaced(self, line: str, first: bool) -> int:
        """Runs of spaces: a chunk is a run of marks and what follows up to the next mark."""
        text = (MARK if first else "") + line.replace(" ", MARK)
        total, start, n = 0, 0, len(text)
        for i in range(1, n + 1):
            if i == n or (text[i] == MARK and text[i - 1] != MARK):
                total += self.bare[text[start:i]]
                start = i
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.split_lines:
            return self.spaced(text, True)
        lines = text.split("\n")
        total = len(lines) - 1  # a line feed is one byte outside the vocabulary
        for k, line in enumerate(lines):
            if line or k == 0:
                total += self.line(line, k == 0)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to the id of each document.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids stay as they are;
    other columns are not read. Very long texts need memory in proportion to their longest word only
    beyond the text itself.
    """

    def run(batches):
        c = counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
