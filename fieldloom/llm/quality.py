"""Text quality by a generalised additive model with pairwise interactions.

A document becomes a row of figures about its letters, words, lines and repetitions. The model is a sum of lookup
tables, one for each figure and one for each of a few pairs of figures, over bins of the figures' quantiles. They are
learned by cyclic boosting: the figures take turns, and at each turn a shallow tree over the bins of that figure alone
adds a small step to its table; then pairs, chosen by how much a cut of both at once would still gain, take turns in
the same way. A score needs one addition of a bin's entry for each table, on all rows of a batch at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, held_out, in_rows, texts, worker_cache

#: Bins of a figure in its own table, and in a table of two.
BINS, COARSE = 64, 16
#: Rows of the sample that the model is fitted on, at most.
SAMPLE = 20_000
#: Of a text's level of repetition, words compared for runs of the same phrase.
PHRASE = 5

_byte = np.arange(256)
_SPACE = np.isin(_byte, [9, 10, 11, 12, 13, 32])
_LOWER, _UPPER = (_byte >= 97) & (_byte <= 122), (_byte >= 65) & (_byte <= 90)
_DIGIT, _HIGH = (_byte >= 48) & (_byte <= 57), _byte >= 128
_STOP, _COMMA = np.isin(_byte, list(b".!?")), np.isin(_byte, list(b",;:"))
_SIGN = ~(_SPACE | _LOWER | _UPPER | _DIGIT | _HIGH | _STOP | _COMMA)
_LETTER = _LOWER | _UPPER | _HIGH
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _HIGH, _STOP, _COMMA, _SIGN, _SPACE], 1).astype(float)

#: Names of the figures, in order.
FIGURES = (
    "lower upper digit high stop comma sign space control log_words word_mean word_spread distinct_words top_word word_entropy adjacent_equal "
    "distinct_pairs distinct_phrases ends_in_sign ends_in_stop starts_upper starts_sign all_upper no_letter short long_words byte_entropy squeezed "
    "log_lines line_words same_lines sentence_words"
).split()


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def figures(text: bytes) -> list[float]:
    """The figures of a whole text; a text without words has zeros for all that is told of words."""
    a = np.frombuffer(text, np.uint8)
    seen = np.bincount(a, minlength=256)
    size = max(1, len(a))
    out = [*(seen @ _CLASSES / size), float(seen[:32].sum() - seen[9:14].sum()) / size]
    words = text.split()
    n = len(words)
    if not n:
        return [*out, *[0.0] * (len(FIGURES) - len(out))]
    space = _SPACE[a]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1) - 1
    length = last - first + 1
    letters, uppers = (np.add.reduceat(lut[a].astype(np.int64), first) for lut in (_LETTER, _UPPER))
    count = Counter(words)
    of_word = np.fromiter(count.values(), np.int64, len(count))
    phrases = max(1, n - PHRASE + 1)
    tail, head = a[last], a[first]
    stops = int(_STOP[tail].sum())
    rows = [r for r in text.split(b"\n") if r.strip()]
    out += [np.log1p(n), length.mean(), length.std(), len(count) / n, of_word.max() / n, _entropy(of_word), sum(map(eq, words, words[1:])) / n]
    out += [len(set(pairwise(words))) / max(1, n - 1), len(set(zip(*(words[i:] for i in range(PHRASE)), strict=False))) / phrases]
    out += [_SIGN[tail].mean(), stops / n, _UPPER[head].mean(), _SIGN[head].mean(), ((uppers == letters) & (letters > 1)).mean(), (letters == 0).mean()]
    out += [(length <= 3).mean(), (length > 15).mean(), _entropy(seen), len(zlib.compress(text, 1)) / size]
    out += [np.log1p(len(rows)), np.log1p(n / max(1, len(rows))), 1 - len(set(rows)) / max(1, len(rows)), np.log1p(n / (stops + 1))]
    return [float(x) for x in out]


# ---- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Lookup tables over bins. A figure's bin is the number of its edges at or below it; in a table of two it is
    `coarse` of that bin."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of figures, one row of the result for each figure."""
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]) if self.edges else np.zeros((0, len(x)), np.int64)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.bias)
        for i, t in enumerate(self.tables):
            out += t[b[i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))

    def terms(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each table adds to each row: why a text has its score."""
        b = self.bins(x)
        own = {FIGURES[i]: t[b[i]] for i, t in enumerate(self.tables)}
        return own | {f"{FIGURES[i]} x {FIGURES[j]}": t[self.coarse[i][b[i]], self.coarse[j][b[j]]] for (i, j), t in zip(self.pairs, self.pair_tables, strict=True)}


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int) -> np.ndarray:
    """Steps for the bins of one figure by a tree of a few leaves: gradient and curvature sums by bin, cut where the gain
    is largest; a leaf has a curvature of `least` or more."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in pairwise(cuts):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            lg, lh, rg, rh = cg[at] - cg[lo], ch[at] - ch[lo], cg[hi] - cg[at], ch[hi] - ch[at]
            gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
            gain[(lh < least) | (rh < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in pairwise(cuts):
        out[lo:hi] = -(cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of both figures at once, for sums by pair of bins: a tree of depth two."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    quarters = [(c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1]) for c in (cg, ch)]
    if not quarters[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(x**2 / (y + ridge) for x, y in zip(*quarters, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    gain = np.where(np.min([y for y in quarters[1]], axis=0) < least, 0, gain)
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    if gain[a, b] > 0:
        step = [-x[a, b] / (y[a, b] + ridge) for x, y in zip(*quarters, strict=True)]
        out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = step
    return float(gain[a, b]), out


def _slopes(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
    return p - y, p * (1 - p) + 1e-6


def _loss(m: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0, -m, m)).mean())


def train(x: np.ndarray, y: np.ndarray, bags: int = 4, rounds: int = 200, rate: float = 0.15, pairs: int = 12, patience: int = 15, ridge: float = 1.0, least: float = 0.5, leaves: int = 3, seed: int = 11) -> Model:
    """Fit on rows of figures x and labels y (0 or 1). Every bag keeps a sixth of the rows aside, stops when their loss
    has not fallen for `patience` rounds, and goes back to the tables it was lowest with; the bags' tables are averaged.
    Rows of one label only give the label's share, kept from 0 and 1, to all."""
    share = min(max((float(y.mean()) if len(y) else 0.5), 1e-3), 1 - 1e-3)
    model = Model(bias=float(np.log(share / (1 - share))))
    if len(y) < 2 or y.min() == y.max():
        return model
    n, d = x.shape
    model.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(d)]
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.coarse = [np.arange(s) * min(s, COARSE) // s for s in sizes]
    wide = [min(s, COARSE) for s in sizes]
    rough = np.stack([model.coarse[i][bins[i]] for i in range(d)])
    rng = np.random.default_rng(seed)
    model.tables = [np.zeros(s) for s in sizes]

    def turns(margin: np.ndarray, on: np.ndarray, off: np.ndarray, tables: list[np.ndarray], place: list[np.ndarray], step) -> np.ndarray:
        """Rounds of turns over tables; place[k] is each row's (flat) entry in table k. Returns the margins reached."""
        best, kept, at, reached = _loss(margin[off], y[off]), [t.copy() for t in tables], 0, margin.copy()
        for r in range(rounds):
            for k, t in enumerate(tables):
                g, h = _slopes(margin[on], y[on])
                where, size = place[k][on], t.size
                add = rate * step(np.bincount(where, g, size).reshape(t.shape), np.bincount(where, h, size).reshape(t.shape))
                t += add
                margin += add.ravel()[place[k]]
            now = _loss(margin[off], y[off])
            if now < best - 1e-6:
                best, kept, at, reached = now, [t.copy() for t in tables], r, margin.copy()
            elif r - at >= patience:
                break
        for t, k in zip(tables, kept, strict=True):
            t[:] = k
        return reached

    parts, own = [], []
    for _ in range(bags):
        off = rng.permutation(n) < max(1, n // 6)
        if off.all() or y[~off].min() == y[~off].max():
            off = np.arange(n) < 0
        on, off = np.flatnonzero(~off), np.flatnonzero(off if off.any() else ~off)
        tables = [np.zeros(s) for s in sizes]
        margin = turns(np.full(n, model.bias), on, off, tables, list(bins), lambda g, h: _tree(g, h, ridge, least, leaves))
        parts.append((on, off, margin))
        own.append(tables)
    model.tables = [np.mean([t[i] for t in own], axis=0) for i in range(d)]
    # Pairs by what a cut of both would still gain over the bags' residuals.
    gains = np.zeros((d, d))
    for on, _, margin in parts:
        g, h = _slopes(margin[on], y[on])
        for i in range(d):
            for j in range(i + 1, d):
                where = rough[i][on] * wide[j] + rough[j][on]
                gains[i, j] += _cross(np.bincount(where, g, wide[i] * wide[j]).reshape(wide[i], wide[j]), np.bincount(where, h, wide[i] * wide[j]).reshape(wide[i], wide[j]), ridge, least)[0]
    order = np.argsort(-gains, axis=None, kind="stable")[:pairs]
    model.pairs = [(int(a), int(b)) for a, b in zip(*np.unravel_index(order, gains.shape), strict=True) if gains[a, b] > 0]
    both = []
    for on, off, margin in parts:
        tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
        turns(margin, on, off, tables, [rough[i] * wide[j] + rough[j] for i, j in model.pairs], lambda g, h: _cross(g, h, ridge, least)[1])
        both.append(tables)
    model.pair_tables = [np.mean([t[k] for t in both], axis=0) for k in range(len(model.pairs))]
    for t, b in zip(model.tables, bins, strict=True):  # a table's mean belongs to the bias
        mean = float(t[b].mean())
        t -= mean
        model.bias += mean
    return model


# ---- over DataFrames -----------------------------------------------------------------------------------------------


def figure_rows(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and figures (one for each of FIGURES) of the whole text, null read as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for b in in_rows(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([figures(t) for t in byte_texts(b)], pa.list_(pa.float64()))], names=["doc_id", "figures"])

    return texts(docs).mapInArrow(run, "doc_id long, figures array<double>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, mod: int = 5, rest: int = 0) -> Model:
    """Fit on a bounded sample: the `rows` labelled documents of lowest hash among those whose crc32(doc_id as text) mod
    `mod` is not `rest`. Figures are worked out in tasks, and at most `rows` rows of them come to the driver. Rows with a
    null label or id are no examples; of several labels of one id the lowest counts; a null text is an empty one. With
    no example of a label, every score is the share of good ones (a half without any)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("good"))
    some = good.where(~held_out(F.col("doc_id"), mod, rest)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = figure_rows(texts(docs).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(some), "doc_id")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "figures").limit(rows).collect()
    return train(np.array([r["figures"] for r in got], float).reshape(-1, len(FIGURES)), np.array([r["good"] for r in got], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id and score (0 to 1, higher: likelier of good quality).

    Whole texts are read; nothing but the text decides. A null text counts as empty; empty texts have the score of
    their (zero) figures. Repeated rows and null ids are scored like any other; no rows give no rows. Only doc_id and
    text are read, other columns go.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("quality")
        for b in in_rows(batches, 256):
            x = np.array([figures(t) for t in byte_texts(b)], float).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")
