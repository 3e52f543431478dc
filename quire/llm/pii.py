"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Four patterns with their checks (addresses, digit counts, Luhn) give the base spans, which stay. The same spans label
a bounded sample of windows from which the model is trained in numpy. It then reads overlapping windows of every text;
what it finds there is weighed by its probability under the CRF and reconciled over the whole text: the spans of
greatest total weight that overlap neither each other nor a base span, and that pass the same checks, are added. So
numbers that stand too close together for the patterns are still told apart.

Each kind of span holds a digit or an @; windows without any can hold no span and are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window; the next one begins after half as many, so that shorter spans are whole in one of them.
WIDTH = 128
#: Bounds of the training sample: windows with a span of each kind, and windows without one.
MAX_WINDOWS = 1_200
#: Least probability of a span that is added.
LEAST = 0.5
_TRIGGER = re.compile(r"[0-9@]")
_AT = re.compile("@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WHOLE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+){3}"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": _PHONE}

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind: int, found: str) -> bool:
    """The check of a kind on what its pattern matches."""
    if kind == 1:
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found.split(".")))
    if kind >= 2:
        digits = "".join(c for c in found if "0" <= c <= "9")
        return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15
    return True


def matches(text: str):
    """Leftmost matches of each kind that do not overlap, before the checks; each pattern takes time in proportion to the text."""
    end = 0
    for m in _AT.finditer(text):
        # what stands before the @ begins at the end of the match before it or after the last other character
        at = start = m.start()
        while start > end and _LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            end = domain.end()
            yield start, 0, end
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = m.group().split(".")
            start = m.start()
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                yield start, 1, start + size
                start += size + 1
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() > 1:
            yield m.start(), 2, m.end()
    for m in _PHONE.finditer(text):
        yield m.start(), 3, m.end()


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans in order, and the matches that the checks drop."""
    good, bad = [], []
    for s in matches(text):
        (good if passes(s[1], text[s[0] : s[2]]) else bad).append(s)
    return sorted(good), bad


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Symbols: small and capital letters, digits, other letters, other characters, padding; each sign of ASCII is its own.
_SIGNS = [c for c in map(chr, range(128)) if not c.isalnum()]
_SYMBOL = np.array([0 if chr(c).islower() else 1 if chr(c).isupper() else 2 if chr(c).isdigit() else 6 + _SIGNS.index(chr(c)) for c in range(128)], np.int8)
SYMBOLS, PAD = 6 + len(_SIGNS), 5
TAGS = 1 + 2 * len(KINDS)  # none, then beginning and inside of each kind


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, _SYMBOL[np.minimum(c, 127)], 3 + (c < 0xC0)).astype(np.int8)


def window_starts(text: str) -> list[int]:
    """Beginnings of the windows that hold a digit or an @."""
    half, found = WIDTH // 2, set()
    for m in _TRIGGER.finditer(text):
        j = m.start() // half
        found.add(j)
        if j:
            found.add(j - 1)
    return [j * half for j in sorted(found)]


def windows(x: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.full((len(starts), WIDTH), PAD, np.int8)
    for row, s in zip(out, starts, strict=True):
        part = x[s : s + WIDTH]
        row[: len(part)] = part
    return out


def allowed() -> np.ndarray:
    """Which tag may follow which: an inside only its own beginning or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, two LSTMs and a CRF: single precision arrays in ``p``."""

    NEVER = np.float32(-1e4)

    def __init__(self, hidden: int = 20, embedded: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        bias = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)].astype(np.float32)
        # the two directions of the LSTM are the first axis of in, own and bias
        self.p = {"embed": normal(SYMBOLS, embedded) * 3, "in": np.stack([normal(embedded, 4 * hidden) for _ in "fb"]), "own": np.stack([normal(hidden, 4 * hidden) for _ in "fb"]), "bias": np.stack([bias, bias])}
        self.p |= {"out": normal(2 * hidden, TAGS), "out_bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        self.ok = allowed()

    def transitions(self) -> tuple[np.ndarray, np.ndarray]:
        start = self.p["start"].copy()
        start[2::2] = self.NEVER
        return np.where(self.ok, self.p["step"], self.NEVER), start

    def lstm(self, e: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states by time, direction, window and unit, and what the way back needs."""
        n, h = e.shape[2], self.hidden
        z = e @ self.p["in"] + self.p["bias"][:, None]
        own = self.p["own"]
        out, kept = np.empty((len(e), 2, n, h), np.float32), []
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(len(e)):
            a = z[t] + state @ own
            gates, g = sigmoid(a[:, :, : 3 * h]), np.tanh(a[:, :, 3 * h :])
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            kept.append((i, f, o, g, before, squashed, state))
            state = o * squashed
            out[t] = state
        return out, kept

    def lstm_back(self, e: np.ndarray, kept: list, slope: np.ndarray, grad: dict) -> np.ndarray:
        n, h = e.shape[2], self.hidden
        turned, da = self.p["own"].transpose(0, 2, 1), np.empty((len(e), 2, n, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(len(e) - 1, -1, -1):
            i, f, o, g, before, squashed, state = kept[t]
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            a = da[t]
            a[:, :, :h], a[:, :, h : 2 * h] = dc * g * i * (1 - i), dc * before * f * (1 - f)
            a[:, :, 2 * h : 3 * h], a[:, :, 3 * h :] = dh * squashed * o * (1 - o), dc * i * (1 - g * g)
            grad["own"] += state.transpose(0, 2, 1) @ a
            dh, dc = a @ turned, dc * f
        flat = lambda x: x.transpose(1, 0, 2, 3).reshape(2, -1, x.shape[3])
        grad["in"] += flat(e).transpose(0, 2, 1) @ flat(da)
        grad["bias"] += da.sum((0, 2))
        return da @ self.p["in"].transpose(0, 2, 1)

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of tags over time, window and tag."""
        e = self.p["embed"][x.T.astype(np.int64)]
        both = np.stack([e, e[::-1]], axis=1)
        out, kept = self.lstm(both)
        h = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return h @ self.p["out"] + self.p["out_bias"], (both, h, kept)

    def sums(self, em: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums over all ways up to each tag, and on from it, so that their product is its probability.

        With them the factors of tags at each time, scaled, and the log sum over all ways.
        """
        step, start = self.transitions()
        way = np.exp(step.astype(np.float64))
        top = em.max(2)
        w = np.exp(em.astype(np.float64) - top[:, :, None])
        a, b, size = np.empty(w.shape), np.ones(w.shape), np.empty(top.shape)
        at = np.exp(start.astype(np.float64)) * w[0]
        for t in range(len(em)):
            if t:
                at = (at @ way) * w[t]
            size[t] = at.sum(1)
            a[t] = at = at / size[t][:, None]
        w /= size[:, :, None]
        for t in range(len(em) - 2, -1, -1):
            b[t] = (w[t + 1] * b[t + 1]) @ way.T
        return a, b, w, way, (np.log(size) + top).sum(0)

    def slope(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags y of windows x, and its gradient."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        em, (both, h, kept) = self.emissions(x)
        a, b, w, way, z = self.sums(em)
        step, start = self.transitions()
        n, tags, rows, times = len(x), y.T.astype(np.int64), np.arange(len(x)), np.arange(len(em))
        value = z - start[tags[0]] - em[times[:, None], rows, tags].sum(0) - step[tags[:-1], tags[1:]].sum(0)
        each = a * b
        each[times[:, None], rows, tags] -= 1
        pair = way * np.tensordot(a[:-1], w[1:] * b[1:], ((0, 1), (0, 1)))
        np.subtract.at(pair, (tags[:-1], tags[1:]), 1)
        grad["step"] += np.where(self.ok, pair / n, 0).astype(np.float32)
        dem = (each / n).astype(np.float32)
        grad["start"] += dem[0].sum(0)
        flat = dem.reshape(-1, TAGS)
        grad["out"] += h.reshape(-1, h.shape[2]).T @ flat
        grad["out_bias"] += flat.sum(0)
        dh = dem @ self.p["out"].T
        de = self.lstm_back(both, kept, np.stack([dh[:, :, : self.hidden], dh[::-1, :, self.hidden :]], axis=1), grad)
        np.add.at(grad["embed"], x.T.astype(np.int64).ravel(), (de[:, 0] + de[::-1, 1]).reshape(-1, de.shape[3]))
        return float(value.mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 64, rate: float = 0.02, seed: int = 6) -> Tagger:
        """Adam with a falling rate, on batches in random order."""
        rng, first, second = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, len(x)))
            _, grad = self.slope(x[at], y[at])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                now = rate * min(1, t / 20) * (1 - 0.95 * t / steps)
                self.p[k] = self.p[k] - (now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Of each window the spans (start, kind, end, probability) of its best sequence of tags."""
        em, _ = self.emissions(x)
        step, start = self.transitions()
        best, back = start + em[0], np.empty(em.shape, np.int8)
        for t in range(1, len(em)):
            ways = best[:, :, None] + step
            back[t] = ways.argmax(1)
            best = ways.max(1) + em[t]
        tags = np.empty((len(em), len(x)), np.int8)
        tags[-1] = best.argmax(1)
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(len(x)), tags[t]]
        hit = np.flatnonzero((tags > 0).any(0))
        out: list[list] = [[] for _ in x]
        if not len(hit):
            return out
        a, b, w, way, _ = self.sums(em[:, hit])
        for r, row in enumerate(hit):
            y = tags[:, row]
            for s in np.flatnonzero(y % 2 == 1):
                begin, inside, e = y[s], y[s] + 1, s + 1
                p = a[s, r, begin]
                while e < WIDTH and y[e] == inside:
                    p *= way[y[e - 1], inside] * w[e, r, inside]
                    e += 1
                if e < WIDTH:  # any tag but the span's own may follow
                    after = way[y[e - 1]] * w[e, r] * b[e, r]
                    p *= after.sum() - after[inside]
                out[row].append((int(s), int(begin - 1) // 2, int(e), float(min(1.0, p))))
        return out


def proposals(text: str, tagger: Tagger, most: int = 512):
    """start, kind, end, probability of spans in the windows of a text.

    What touches the edge of a window is left to the one that holds it whole.
    """
    starts = window_starts(text)
    x = symbols(text)
    for low in range(0, len(starts), most):
        part = starts[low : low + most]
        for at, spans in zip(part, tagger.decode(windows(x, part)), strict=True):
            for s, k, e, p in spans:
                if (s or not at) and (e < WIDTH or at + WIDTH >= len(text)):
                    yield at + s, k, min(at + e, len(text)), p


def reconcile(text: str, base: list[Span], found) -> list[Span]:
    """The base spans, and the proposals of greatest total weight that overlap nothing and pass the checks of their kind."""
    weight: dict[Span, float] = {}
    for s, k, e, p in found:
        if p >= LEAST and _WHOLE[KINDS[k]].fullmatch(text, s, e) and passes(k, text[s:e]):
            weight[s, k, e] = max(weight.get((s, k, e), 0.0), p * (e - s))
    # both lists in order: what overlaps a base span goes
    taken, at, free = sorted((s, e) for s, _, e in base), 0, []
    reach = 0
    for span in sorted(weight):
        while at < len(taken) and taken[at][0] <= span[0]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= span[0] and (at == len(taken) or taken[at][0] >= span[2]):
            free.append(span)
    # greatest total weight of spans that do not overlap, by their ends
    free.sort(key=lambda s: s[2])
    ends = [s[2] for s in free]
    best, choice = [0.0], []
    for i, span in enumerate(free):
        before = int(np.searchsorted(ends[:i], span[0], "right"))
        take = best[before] + weight[span]
        choice.append(before if take > best[i] else -1)
        best.append(max(best[i], take))
    added, i = [], len(free)
    while i:
        if choice[i - 1] >= 0:
            added.append(free[i - 1])
            i = choice[i - 1]
        else:
            i -= 1
    return sorted([*base, *added])


def labelled_windows(texts: DataFrame) -> DataFrame:
    """kind (or -1), x, y: the distinct windows that hold a digit or an @, with the tags of base spans.

    A window in which the checks drop a match of the right shape, or that cuts a span, is no example of either.
    """

    def run(batches):
        for b in batches:
            kinds, xs, ys = [], [], []
            for text in b.column(0).to_pylist():
                starts = window_starts(text) if text else []
                if not starts:
                    continue
                good, bad = base_spans(text)
                x, y, unsure = symbols(text), np.zeros(len(text), np.int8), np.zeros(len(text) + 1, bool)
                for s, k, e in bad:
                    if k != 2 or 14 <= sum("0" <= c <= "9" for c in text[s:e]):
                        unsure[s:e] = True
                for s, k, e in good:
                    y[s], y[s + 1 : e] = 1 + 2 * k, 2 + 2 * k
                for at in starts:
                    part = y[at : at + WIDTH]
                    cut = part[0] and part[0] % 2 == 0 or at + WIDTH < len(y) and y[at + WIDTH] and y[at + WIDTH] % 2 == 0
                    if not cut and not unsure[at : at + WIDTH].any():
                        begun = part[part % 2 == 1]
                        kinds.append(int(begun[0] - 1) // 2 if len(begun) else -1)
                        xs.append(windows(x, [at])[0].tobytes())
                        ys.append(np.r_[part, np.zeros(WIDTH - len(part), np.int8)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["kind", "x", "y"])

    return texts.mapInArrow(run, "kind int, x binary, y binary").dropDuplicates(["x"])


def neighbours(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose first span is followed, after a space, by a span of another window."""
    out_x, out_y = [], []
    rows = np.flatnonzero((y % 2 == 1).any(1))
    ends = lambda row, s: s + 1 + int(np.argmin(np.r_[y[row, s + 1 :] == y[row, s] + 1, False]))
    first = {r: (int(s := np.argmax(y[r] % 2 == 1)), ends(r, s)) for r in rows}
    for r, other in zip(rows, rng.permutation(rows), strict=True):
        e, (s2, e2) = first[r][1], first[other]
        room = np.r_[x[r, :e], symbols(" "), x[other, s2:e2], symbols(" "), x[r, e:]][:WIDTH]
        tags = np.r_[y[r, :e], 0, y[other, s2:e2], 0, y[r, e:]][:WIDTH]
        out_x.append(room)
        out_y.append(tags)
    return np.array(out_x, np.int8).reshape(-1, WIDTH), np.array(out_y, np.int8).reshape(-1, WIDTH)


def train(docs: DataFrame, text: str = "text") -> Tagger | None:
    """A tagger from MAX_WINDOWS windows a kind and as many without a span; None where no span is found.

    Windows are drawn by the hash of what they hold, so the sample does not depend on partitions or copies. Null and
    empty texts have no window. One task fits the model, as its input is bounded.
    """
    each = Window.partitionBy("kind").orderBy("h", "x")
    read = with_triggers(docs, text).where("text is not null").select("text")
    sample = labelled_windows(read).withColumn("h", F.xxhash64("x")).withColumn("r", F.row_number().over(each)).where(F.col("r") <= MAX_WINDOWS).select("kind", "x", "y")

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if not rows or rows[-1][0] < 0:
            return
        x, y = (np.frombuffer(b"".join(r[k] for r in rows), np.int8).reshape(-1, WIDTH) for k in (1, 2))
        more = neighbours(x, y, np.random.default_rng(4))
        tagger = Tagger().fit(np.concatenate([x, more[0]]), np.concatenate([y, more[1]]))
        yield pa.RecordBatch.from_arrays([pa.array(list(tagger.p)), pa.array([v.tobytes() for v in tagger.p.values()], pa.binary())], names=["name", "value"])

    got = sample.repartition(1).mapInArrow(run, "name string, value binary").collect()
    if not got:
        return None
    out = Tagger()
    out.p = {r["name"]: np.frombuffer(r["value"], np.float32).reshape(out.p[r["name"]].shape) for r in got}
    return out


def with_triggers(docs: DataFrame, text: str) -> DataFrame:
    """doc_id and the text, or null for texts without a digit and an @, as no span can be in them."""
    t = F.col(text).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(t.rlike("[0-9@]"), t).alias("text"))


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end in code points, end exclusive) of each whole text.

    Null and empty texts have none; null and repeated ids and repeated rows each stay a row; other columns are not
    read. Spans are ordered by start, then kind as in KINDS. Without a tagger, spans are the base.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for b in batches:
            base, every = [], []
            for t in b.column(1).to_pylist():
                good = base_spans(t)[0] if t else []
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in good])
                got = reconcile(t, good, proposals(t, model.value)) if t and model.value else good
                every.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in got])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    span = "array<struct<start: long, kind: int, end: long>>"
    return with_triggers(docs, text).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """Base counts by kind, and the base and all spans as text: the base hashed."""
    name = F.array(*map(F.lit, KINDS))
    told = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{x}") for k, x in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(find(docs, train(docs)))
