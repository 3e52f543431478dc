"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled once per task: the normaliser (from the model file's own settings: spaces to
the word mark, one mark in front, perhaps no more than one space in a row), the pieces (a deterministic trie whose arcs read characters and whose final states
write a piece) and the byte fallback (a character that no piece holds writes its UTF-8 bytes).
Each input is composed with them, and the tropical-semiring shortest path gives the pieces.

Weights make the path agree with the vocabulary's own kind of model:

* unigram models weigh a piece by its negative log probability, and a character that no piece holds by ten
  more than the least probable piece;
* BPE models have ranks, not probabilities. There an arc between two pieces is in the machine
  (weight 1 a piece) only if merging their joined text gives exactly these two pieces back. A
  sequence is the BPE result if and only if all its neighbours are such pairs, so the composed
  machine has one path and it is the shortest.

The word mark occurs in pieces only as their beginning, so the composed machine has a cut
point before each run of marks; the pieces between two cut points are found alone and memoised.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe_count import MARK, merge_symbols
from quire.llm.common import TwoGenerationCache, table

#: How much more than the least probable piece a character costs that no piece holds (unigram models).
UNKNOWN_PENALTY = 10.0


def message(data: bytes) -> dict[int, list]:
    """The fields of a protocol-buffer message: numbers, and bytes of what has a length."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


class Normaliser:
    """What a model file says of its input: compiled from its settings, or refused.

    Files that also map characters (a table of their own) are refused: their input would differ.
    """

    def __init__(self, model: dict[int, list]):
        spec = message(model.get(3, [b""])[-1])
        flag = lambda n: bool(spec.get(n, [1])[-1])  # noqa: E731  (absent: true)
        self.front, self.single, self.marked = flag(3), flag(4), flag(5)
        if spec.get(2, [b""])[-1]:
            raise ValueError("the model's normaliser maps characters, which is not built")
        if not self.marked:
            raise ValueError("the model does not mark words")

    def __call__(self, text: str) -> str:
        if self.single:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.front else "") + text.replace(" ", MARK) if text else ""

    @property
    def plain(self) -> bool:
        """Whether words that single spaces part are marked one by one."""
        return self.front and not self.single


class Transducer:
    """Normaliser, pieces and byte fallback, compiled from a SentencePiece model file."""

    def __init__(self, path: str, kind: str | None = None, half: int = 600_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = message(sp.serialized_model_proto())
        size = range(sp.get_piece_size())
        own = {1: "unigram", 2: "bpe"}.get(message(model.get(2, [b""])[-1]).get(3, [1])[-1])
        self.kind = kind or own
        if self.kind not in ("unigram", "bpe"):
            raise ValueError("only unigram and BPE models are built")
        self.normalise = Normaliser(model)
        self.pieces = [sp.id_to_piece(i) for i in size]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in size if sp.is_byte(i)}
        self.output = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.unknown = sp.unk_id()
        self.ids = {self.pieces[i]: i for i in size if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.ranks = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.unknown_cost = 1.0 if self.kind == "bpe" else max(self.ranks.values()) + UNKNOWN_PENALTY
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = i
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds the word mark after another character")
        self.pairs = TwoGenerationCache(self._pair, 250_000)
        self.chunks = TwoGenerationCache(self._chunk, half)

    def _pair(self, pair: tuple[int, int]) -> bool:
        u, v = self.pieces[pair[0]], self.pieces[pair[1]]
        return merge_symbols(u + v, self.ranks) == [u, v]

    def fallback(self, ch: str) -> tuple[int, ...]:
        raw = ch.encode("utf-8", "surrogatepass")
        return tuple(self.byte_id.get(b, self.unknown) for b in raw) if self.byte_id else (self.unknown,)

    def shortest(self, chunk: str) -> tuple[int, ...]:
        """Compose with one input and take the shortest path. States: place and last piece."""
        n = len(chunk)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]  # last piece -> weight, place before, piece before
        best[0][-1] = (0.0, -1, -1)
        bpe, pairs, ranks, pieces = self.kind == "bpe", self.pairs, self.ranks, self.pieces
        known = self.ids
        for i in range(n):
            here = best[i]
            if not here:
                continue
            node = self.trie.get(chunk[i])
            if chunk[i] not in known:
                w, last = min((v[0], k) for k, v in here.items())
                old = best[i + 1].get(-2)
                if old is None or w + self.unknown_cost < old[0]:
                    best[i + 1][-2] = (w + self.unknown_cost, i, last)
            j = i
            while node is not None:
                j += 1
                piece = node.get("")
                if piece is not None:
                    cost = 1.0 if bpe else ranks[pieces[piece]]
                    then = best[j]
                    for last, (w, _, _) in here.items():
                        if bpe and last >= 0 and not pairs[last, piece]:
                            continue
                        old = then.get(piece)
                        if old is None or w + cost < old[0]:
                            then[piece] = (w + cost, i, last)
                node = node.get(chunk[j]) if j < n else None
        if not best[n]:
            raise ValueError("no path through the machine")
        out: list[int] = []
        place, last = n, min((v[0], k) for k, v in best[n].items())[1]
        while place > 0:
            _, back, prior = best[place][last]
            out.extend((last,) if last >= 0 else reversed(self.fallback(chunk[back])))
            place, last = back, prior
        return tuple(reversed(out))

    def _chunk(self, chunk: str) -> np.ndarray:
        return np.array(self.shortest(chunk), np.uint32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text; null and empty texts have none."""
        if not text:
            return np.empty(0, np.uint32)
        chunks = self.chunks
        out: list[bytes] = []
        if not self.normalise.plain or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked, start = self.normalise(text), 0
            for i in range(1, len(marked) + 1):
                if i == len(marked) or (marked[i] == MARK and marked[i - 1] != MARK):
                    out.append(self._lines(marked[start:i]))
                    start = i
        else:
            out = [chunks[MARK + w] if "\n" not in w else self._lines(MARK + w) for w in text.split(" ")]
        return np.frombuffer(b"".join(out), np.uint32)

    def _lines(self, chunk: str) -> bytes:
        """A line feed that no piece holds is a cut point too."""
        if "\n" not in chunk or "\n" in self.trie:
            return self.chunks[chunk]
        feed = np.array(self.fallback("\n"), np.uint32).tobytes()
        return feed.join(self.chunks[part] if part else b"" for part in chunk.split("\n"))

    def decode(self, ids) -> str:
        """The inverse machine: bytes joined to characters, marks to spaces, the front mark dropped."""
        raw = b"".join(map(self.output.__getitem__, np.asarray(ids).tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.normalise.front and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str, kind: str | None = None) -> Transducer:
    return Transducer(path, kind)


def encode(docs: DataFrame, model_path: str, kind: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the pieces of each whole text (null and empty: none), by the file's kind of model unless one is given.

    Repeated rows and null ids stay as they are; other columns are not read.
    """

    def run(batches):
        t = transducer(model_path, kind)
        for b in batches:
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give a null text."""

    def run(batches):
        t = transducer(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """n_tokens, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back.

    The text comes back whole unless it holds the word mark itself, which decodes to a space.
    Null texts count as empty. Repeated rows and null ids are kept as they are.
    """

    def run(batches):
        t = transducer(model_path)
        for b in batches:
            n, crc, same = [], [], []
            for x in b.column(1).to_pylist():
                ids = t.encode(x)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                same.append(t.decode(ids) == (x or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op7_sentencepiece_wfst(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return encode_digest(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
