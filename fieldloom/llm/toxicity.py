"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel counts subsequences of three letters within a span, gaps allowed and paid for by decay, so an insult keeps
its likeness when characters are put into it. A sentence is read as its units: words without the signs in them, and
runs of pieces of insults joined across the spaces between them. Sentences are the labelled examples: those of a clean
document are clean; one of a toxic document is toxic if it has a unit that toxic documents have far more often, or
that the machine of the round before holds for toxic. A sentence is as toxic as its most toxic unit; a document's score
comes from its most toxic sentence and from how many of its units the machine holds for toxic, for its length. A unit
that many toxic documents have and no clean ones decides alone. The machine is fitted in the space that the kernel to some landmark units spans (Nyström). Its
decision is then linear in the kernel's own features: summed over the landmarks, it is one weight for each three
letters, and a unit costs a lookup per subsequence.

The kernel's length is that of the whole unit, so letters put in also lower its likeness to the insult around them.
Units as like an insult as the machine's own disguised insults are, a hundredth of a vocabulary, are therefore aligned:
such a unit is as toxic as its most toxic subsequence with up to two inner letters left out.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_texts, held_out, in_rows, small_batches, texts, worker_cache
from .wordcache import mapped

#: Letters of a subsequence lie within so many characters; each character of the span costs DECAY.
SPAN, DECAY = 6, 0.7
#: Classes of characters: 1-26 letters and digits, 28 and 29 a unit's begin and end.
BEGIN, END = 28, 29
#: Units longer than this are looked at in pieces that overlap by half.
PIECE = 24
#: Inner letters that may be left out of a unit that is nearly like an insult, and the least letters that stay.
LEFT_OUT, LEAST = 2, 4
#: Units count as toxic from this margin on; a document's count is for its words and some more.
TOXIC, MORE = 0.8, 50
#: Added to the margin of a unit that decides alone.
ALONE = 100
#: Added to the margin of a word that may be a piece of an insult, to tell it from others.
FLAG = 1e6

#: Each of these patterns takes one class of characters at a time, so each is linear in the text.
SENTENCE = re.compile(r"[.!?](?=\s)|\n")
SIGNS = re.compile(r"[^\w\n]+|_+")
INNER = re.compile(r"(?<![@$])[@$](?=[^\W_])|(?<=[^\W_])!(?=[^\W_])")
DRAWN = re.compile(r"([^\n])\1\1+")


def plain(words: list[str]) -> list[str]:
    """Words' letters and digits in lower case, compatible forms alike and combining marks left out; a sign that
    stands for a letter before another one is read as that letter, a letter written three times or more as one.
    Words are read all at once, so none may hold a line feed."""
    text = "\n".join(words)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = INNER.sub(lambda m: {"@": "a", "$": "s", "!": "i"}[m.group()], text.lower())
    return DRAWN.sub(r"\1", SIGNS.sub("", text)).split("\n") if words else []


def _classes() -> np.ndarray:
    """The class of each character; some digits are read as the letters they look like, whatever is neither a letter
    from a to z nor a digit is dealt over the letters' classes."""
    table = (np.arange(0x10000) * 40503 >> 5) % 26 + 1
    for c in range(26):
        table[ord("a") + c] = c + 1
    for digit, letter in zip("0123456789", "oizeasgtbg", strict=True):
        table[ord(digit)] = ord(letter) - 96
    return table


CLASSES = _classes()
OFFSETS = [(i, j) for i in range(1, SPAN - 1) for j in range(i + 1, SPAN)]
FEATURES = 1 << 15


def pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words, long ones in pieces, and each piece's word."""
    out, of = [], []
    for n, w in enumerate(words):
        for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2) if len(w) > PIECE else (0,):
            out.append(w[i : i + PIECE])
            of.append(n)
    return out, np.array(of, np.int64)


def shortened(word: str) -> set[str]:
    """The word's subsequences with one to LEFT_OUT of its inner letters left out, of at least LEAST letters."""
    out, last = set(), {word}
    for _ in range(min(LEFT_OUT, len(word) - LEAST)):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(1, len(w) - 1)}
        out |= last
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) of the kernel's feature vectors, each of length 1, in order of word and feature."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    code = np.frombuffer("\n".join(["", *(w.replace("\n", " ") for w in words), ""]).encode("utf-32-le"), np.uint32)
    kind = np.where(code < len(CLASSES), CLASSES[code % len(CLASSES)], (code.astype(np.int64) * 40503 >> 5) % 26 + 1)
    edge = code == 10
    word = np.cumsum(edge) - 1  # a line feed belongs to the word it opens
    # Each word as BEGIN letters END: its opening line feed, its letters, and an END put in before the next one.
    at = np.flatnonzero(edge)[1:]
    kind, word = np.where(edge, BEGIN, kind), word
    kind, word = np.insert(kind, at, END)[:-1], np.insert(word, at, word[at] - 1)[:-1]
    keys, values = [], []
    for i, j in OFFSETS:
        n = len(kind) - j
        if n <= 0:
            continue
        a, b, c = kind[:n], kind[i : i + n], kind[j : j + n]
        ok = word[:n] == word[j : j + n]
        keys.append((word[:n] << 15 | a << 10 | b << 5 | c)[ok])
        values.append(np.full(len(keys[-1]), DECAY ** (j + 1)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    keys, values = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    values = np.add.reduceat(values, first) if len(keys) else values
    keys = keys[first]
    row = keys >> 15
    norm = np.sqrt(np.bincount(row, values * values, minlength=len(words)))
    return row, keys & (FEATURES - 1), values / norm[row]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of each word with each landmark."""
    z = np.zeros((FEATURES, len(landmarks)), np.float32)
    row, feature, value = features(landmarks)
    z[feature, row] = value
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for s in range(0, len(words), 1000):
        row, feature, value = features(words[s : s + 1000])
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[s + row[first]] = np.add.reduceat(z[feature] * value[:, None].astype(np.float32), first, axis=0)
    return out


@dataclass
class Model:
    """margin = sum of dual x kernel to the landmarks + bias = weights . features + bias.
    score = 1 / (1 + exp(-(a * margin + c * log((1 + toxic units) / (MORE + words)) + b))), or `alone` if that is higher."""

    landmarks: list[str]
    dual: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    #: Units that the machine learned to hold for toxic; what their pieces are joined to must look like one of them.
    insults: list[str] = field(default_factory=list)
    #: Pieces of units from this margin on are aligned.
    near: float = np.inf
    #: The weight of the count, units that decide alone, and the score that they give.
    c: float = 0.0
    sure: frozenset[str] = frozenset()
    alone: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self.weights = np.zeros(FEATURES)
        row, feature, got = features(self.landmarks)
        np.add.at(self.weights, feature, got * self.dual[row])
        self.parts = {w[i:j] for w in self.insults for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w)}
        self.heads, self.tails = {w[:3] for w in self.insults}, {w[-3:] for w in self.insults}
        self.most = max(map(len, self.insults), default=0) + 2

    def margins(self, units: list[str]) -> np.ndarray:
        """Of each unit, over its pieces; a unit without letters has the bias."""
        out = np.full(len(units), self.bias)
        part, of = pieces(units)
        got = np.full(len(part), 0.0)
        for s in range(0, len(part), 4000):
            row, feature, value = features(part[s : s + 4000])
            got[s : s + 4000] = np.bincount(row, self.weights[feature] * value, minlength=len(part[s : s + 4000]))
        if len(units):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out = np.maximum.reduceat(got, first) + self.bias
        return out

    def aligned(self, units: list[str]) -> np.ndarray:
        """margins(), but of each piece that is near an insult its most toxic subsequence's; ALONE is added if it decides alone."""
        out = self.margins(units) + ALONE * np.array([u in self.sure for u in units], float)
        part, of = pieces(units)
        if np.isinf(self.near) or not part:
            return out
        for s in range(0, len(part), 4000):
            got = self.margins(part[s : s + 4000])
            some = (s + np.flatnonzero(got >= self.near)).tolist()
            for t in range(0, len(some), 64):
                forms = [(w, of[n]) for n in some[t : t + 64] for w in shortened(part[n])]
                if forms:
                    got = self.margins([w for w, _ in forms]) + ALONE * np.array([w in self.sure for w, _ in forms])
                    np.maximum.at(out, [n for _, n in forms], got)
        return out

    def joined(self, run: list[str]) -> set[str]:
        """What consecutive pieces of insults make, where it begins and ends as an insult does."""
        run, out = [x for x in run if x], set()
        for i, s in enumerate(run):
            for x in run[i + 1 :]:
                s += x
                if len(s) > self.most:
                    break
                if len(s) > 3 and s[:3] in self.heads and s[-3:] in self.tails:
                    out.add(s)
        return out

    def runs(self, units: list[str]) -> set[str]:
        """joined() over all runs of such pieces, and of signs between them, in a list of units."""
        out: set[str] = set()
        i = 0
        while i < len(units):
            j = i
            while j < len(units) and (not units[j] or units[j] in self.parts):
                j += 1
            if j - i > 1:
                out |= self.joined(units[i:j])
            i = j + 1
        return out

    def evidence(self, margins: np.ndarray, words: int) -> tuple[float, float, bool]:
        """Of a document's units with aligned margins: the highest margin, the count for its length, and whether one decides alone."""
        alone = margins > ALONE / 2
        margins = margins - ALONE * alone
        top = float(margins.max(initial=self.bias))
        return max(top, -1.0), float(np.log((1 + (margins > TOXIC).sum()) / (MORE + words))), bool(alone.any())

    def score(self, margins: np.ndarray, words: int) -> float:
        top, count, alone = self.evidence(margins, words)
        share = float(1 / (1 + np.exp(-np.clip(self.a * top + self.c * count + self.b, -40, 40))))
        return max(share, self.alone) if alone else share


def sentences(text: str) -> list[list[str]]:
    """Each sentence's words, plain; a sentence ends at .!? before white space and at a line feed."""
    rows = [x.split() for x in SENTENCE.split(text)]
    found = iter(plain([w for row in rows for w in row]))
    return [[next(found) for _ in row] for row in rows if row]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Linear support vector machine (L2 loss) by Newton steps; x has a last column of ones for the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xa = x[on] * weight[on, None]
        h = xa.T @ x[on] + ridge * np.eye(len(w))
        new = np.linalg.solve(h, xa.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """w of P(y = 1) = 1 / (1 + exp(-(x, 1) . w)), lightly held to zero."""
    z = np.c_[x, np.ones(len(x))]
    w, hold = np.zeros(z.shape[1]), np.r_[[2e-4] * x.shape[1], 1e-8] * weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(hold)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - hold * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def disguised(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with one letter put in, with two, and with one doubled: examples of what is to be tolerated."""
    if len(unit) < 4:
        return []
    i, j = sorted(int(x) for x in rng.choice(np.arange(1, len(unit)), 2, replace=False))
    a, b = (chr(97 + int(x)) for x in rng.integers(0, 26, 2))
    return [unit[:j] + a + unit[j:], unit[:i] + a + unit[i:j] + b + unit[j:], unit[:i] + b + unit[i:], unit[:j] + unit[j - 1] + unit[j:]]


def _documents(docs: list[list[list[str]]]) -> Counter:
    """In how many documents each unit is, but at most between how many different pairs of neighbours: what is only in
    copies of one document speaks once."""
    n = Counter(w for d in docs for w in {w for s in d for w in s if w})
    around = defaultdict(set)
    for d in docs:
        for s in d:
            for a, w, b in zip(["", *s], s, [*s[1:], ""], strict=False):
                around[w].add(hash((a, b)))
    return Counter({w: min(m, len(around[w])) for w, m in n.items()})


def _telling(some: Counter, seen_t: Counter, seen_c: Counter, toxic: int, clean: int, sure: float = 2.0) -> dict[str, int]:
    """Those of some units that at least three toxic documents have, at five times the clean ones' rate, beyond what
    chance gives to any of so many units (G over `sure` times the log of their number); should there be none, to one."""
    out, most = {}, sure * np.log(max(2, len(seen_t)))
    for w in some:
        n = seen_t[w]
        m = seen_c[w]
        if n >= min(3, toxic) and n * clean > 5 * m * toxic:
            share = (n + m) / (toxic + clean)
            out[w] = n, 2 * (n * np.log(n / (share * toxic)) + (m * np.log(m / (share * clean)) if m else 0.0))
    return {w: n for w, (n, g) in out.items() if g > most} or {w: n for w, (n, g) in out.items() if g > 6}


def train(documents: list[tuple[str, int]], prior: float, landmarks: int = 256, rounds: int = 4, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on labelled documents (text, label), by their sentences. Which sentences of a toxic document are toxic is
    learned by turns: first those with a telling unit, then also those that the machine holds for toxic."""
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # each word is kept once, however often it is read
    read = [([[one.setdefault(w, w) for w in s] for s in sentences(t)], y) for t, y in documents]
    del one
    toxic, clean = ([d for d, y in read if (y > 0) == side] for side in (True, False))
    if not toxic or not clean:
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    seen = [_documents(toxic), _documents(clean)]
    witness = Counter(_telling(seen[0], *seen, len(toxic), len(clean)) or {max(sorted(seen[0]) or [""], key=lambda w: seen[0][w] / (1 + seen[1][w])): 1})
    vocab = sorted(set(seen[0]) | set(seen[1]))
    common = [w for w, _ in sorted(seen[1].items(), key=lambda x: (-x[1], x[0]))]
    usual = ([common[i] for i in sorted(rng.choice(len(common), min(4000, len(common)), replace=False))] + common[:500]) if common else [""]
    hard: Counter[str] = Counter()
    for turn in range(rounds):
        pos = [w for w, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))][:2000]
        neg = [w for w in dict.fromkeys([*hard, *usual]) if w not in witness] or [""]
        half = landmarks // 2
        spare = neg[landmarks // 8 :]
        marks = list(dict.fromkeys([*pos[:half], *neg[: landmarks // 8], *(spare[i] for i in sorted(rng.choice(len(spare), min(len(spare), half - landmarks // 8), replace=False)))]))
        kz = kernel(marks, marks).astype(float)
        value, vector = np.linalg.eigh(kz)
        keep = value > 1e-6 * max(value.max(), 1e-12)
        root = vector[:, keep] / np.sqrt(value[keep])
        masks = [(v, np.sqrt(witness[w])) for w in pos for v in disguised(w, rng)]
        x = kernel([*pos, *(v for v, _ in masks), *neg], marks).astype(float) @ root
        y = np.r_[np.ones(len(pos) + len(masks)), -np.ones(len(neg))]
        share = np.array([*(np.sqrt(witness[w]) for w in pos), *(n for _, n in masks)], float)
        # Units that clean documents were held against count by how often, the others alike.
        rest = np.array([np.sqrt(hard[w]) if w in hard else 0.2 for w in neg])
        weight = np.r_[share / share.sum(), rest / rest.sum()]
        w = squared_hinge(np.c_[x, np.ones(len(y))], y, weight * len(y), ridge * len(y))
        model = Model(marks, root @ w[:-1], float(w[-1]), insults=pos[:200])
        if masks:
            model.near = float(np.quantile(model.margins([v for v, _ in masks]), 0.01))
        margin = dict(zip(vocab, model.margins(vocab).tolist(), strict=True)) | {"": model.bias}
        top = lambda s: max(s, key=lambda w: (margin[w], w))
        clean_joined = sorted({j for d in clean for s in d for j in model.runs(s)})
        joined = dict(zip(clean_joined, model.margins(clean_joined).tolist(), strict=True))
        if turn + 1 < rounds:
            # Labelled sentences of the next turn: a toxic document's sentence whose top unit is held for toxic.
            more = Counter(w for d in toxic for w in {top(s) for s in d} if margin[w] > 0)
            witness |= Counter(_telling(more, *seen, len(toxic), len(clean), 1.0))
            hard |= Counter(w for d in clean for w in sorted({w for s in d for w in s}, key=lambda w: (-margin[w], w))[:3] if margin[w] > -0.7)
            hard |= Counter({w: 1 for w, m in joined.items() if m > -0.7})
            hard = Counter(dict(sorted(hard.items(), key=lambda x: (-x[1], x[0]))[:4000]))
    # Units of a tenth of the toxic documents and of nearly no clean ones.
    often = {w: n for w, n in witness.items() if n >= max(5, len(toxic) / 10) and 50 * seen[1][w] * len(toxic) <= n * len(clean)}
    model.sure = frozenset(often)
    model.alone = max(1 - (1 + sum(seen[1][w] for w in often)) / (2 + sum(often.values())), 0.0) if often else 0.0
    margin = dict(zip(vocab, model.aligned(vocab).tolist(), strict=True)) | {"": model.bias}
    rows = []
    for d in [*toxic, *clean]:
        found = sorted({j for s in d for j in model.runs(s)})
        rows.append(model.evidence(np.r_[[margin[w] for s in d for w in s], model.aligned(found)], sum(map(len, d)))[:2])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    model.a, model.c, model.b = map(float, logistic(np.array(rows), y, np.where(y == 1, prior / len(toxic), (1 - prior) / len(clean)) * len(y)))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, longest: int = 20_000, mod: int = 4) -> Model:
    """Fit on a bounded sample: of either label, the `rows` documents of lowest hash among those whose text has
    at most `longest` characters and whose crc32(doc_id as text) mod `mod` is not 2. Rows with a null label, id
    or text are no examples. With no example of a label, every score is the share of toxic ones."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id"), mod))
    share = {r["toxic"]: r["count"] for r in marked.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    prior = share.get(1, 0) / max(1, sum(share.values()))
    found = []
    short = docs.where((F.length("text") <= longest) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    for y in (1, 0):
        # Candidates are cut to twice the rows before any text is read: some lack a text or have a long one.
        some = marked.where((F.col("toxic") > 0) == bool(y)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
        got = short.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).collect()
        found += [(r["text"], y) for r in got]
    return train(found, prior)


def document_scores(model: Model, found: list[bytes]) -> np.ndarray:
    """Each text's score; one without words has an empty unit's margin. Runs of pieces are joined within
    the text's words in order; white space of any kind is between them."""
    held = worker_cache("toxicity")
    if model.key not in held:
        held.clear()
        held[model.key] = Words()

    def make(words: list[bytes]) -> list[float]:
        units = plain([w.decode() for w in words])
        return (model.aligned(units) + FLAG * np.array([not u or u in model.parts for u in units])).tolist()

    out = np.full(len(found), model.score(np.empty(0), 0))
    for n, (text, got) in enumerate(zip(found, mapped(found, held[model.key], make), strict=True)):
        if got:
            margin = np.array(got)
            size = len(margin)
            piece = margin > FLAG / 2
            margin[piece] -= FLAG
            both = piece[1:] & piece[:-1]
            if both.any():
                words, joined = text.split(), set()
                edge = np.flatnonzero(np.diff(np.r_[False, both, False].astype(np.int8)))
                for i, j in zip(edge[::2], edge[1::2], strict=True):
                    joined |= model.joined(plain([w.decode() for w in words[i : j + 1]]))
                margin = np.r_[margin, model.aligned(sorted(joined))]
            out[n] = model.score(margin, size)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id and score (0 to 1, higher: likelier toxic).

    Whole texts are read; nothing but the text decides. A null or empty text has the score of a text
    without any toxic word. Repeated rows and null ids are scored like any other; no rows give no rows.
    Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_rows(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(document_scores(shared.value, byte_texts(b)))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score the threshold or more; every column stays. A null id changes nothing."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        parts = [pa.RecordBatch.from_arrays([text.slice(s, 512)], names=["text"]) for s in range(0, len(text), 512)]
        return pa.array(np.concatenate([document_scores(shared.value, byte_texts(p)) for p in parts]) if parts else np.empty(0))

    return docs.where(scored(F.coalesce("text", F.lit(""))) < threshold)
