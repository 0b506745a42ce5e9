"""Token counts by byte-pair merging on a heap and a linked list.

A word's symbols form a linked list; the adjacent pairs that may merge sit in a heap by rank, then
place. The lowest pair is merged again and again, and the count is the number of symbols at first
less the number of merges: no identifiers are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_texts, in_rows, texts, worker_cache
from .wordcache import LONGEST, mapped, tokenizer


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts a word's tokens as the tokenizers library does for a JSON file of a BPE with word ends.

    The library's normaliser is asked for words that are not ASCII; splitting follows the file's
    pattern; special strings are found first, as the library does by default, and count one each.
    """

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or split["type"] != "Split":
            raise ValueError(f"{path}: not a BPE with word ends after a pattern")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_symbols()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + end] for c in chars]
        self.rank, self.made = {}, []
        for n, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 20 | vocab[b], n)
            self.made.append(vocab[a + b])
        self.normalise = tokenizer(path).normalizer.normalize_str
        self.words = Words()
        self.parts: dict[str, int] = {}

    def merges(self, s: list[int]) -> int:
        """Number of merges that the symbols s undergo."""
        n, rank, made = len(s), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(s[i] << 20 | s[i + 1])) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            x = heapq.heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if s[i] < 0 or j >= n or rank(s[i] << 20 | s[j]) != r:
                continue  # one of the two has merged since
            s[i], s[j] = made[r], -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := rank(s[i] << 20 | s[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank(s[h] << 20 | s[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return done

    def part(self, text: str) -> int:
        """Tokens of one match of the pattern."""
        n = self.parts.get(text)
        if n is None:
            b = text.encode()
            inner = self.inner
            s = [inner[x] for x in b]
            s[-1] = self.final[b[-1]]
            n = len(s) - self.merges(s)
            if len(self.parts) > 200_000:
                self.parts.clear()
            if len(b) <= LONGEST:
                self.parts[text] = n
        return n

    def plain(self, text: str) -> int:
        text = text.lower() if text.isascii() else self.normalise(text)
        return sum(map(self.part, self.pattern.findall(text)))

    def word(self, word: bytes) -> int:
        """Tokens of one white-space separated word."""
        text = word.decode()
        if b"|>" not in word or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def counts(self, texts: list[bytes]) -> list[int]:
        return list(map(sum, mapped(texts, self.words, lambda words: list(map(self.word, words)))))


def counter(path: str) -> MergeCounter:
    held = worker_cache("token counts")
    if path not in held:
        held[path] = MergeCounter(path)
    return held[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a tokenizers JSON file (BPE with word ends) that every executor has. A null or empty text has no
    bytes and no tokens. Repeated rows and null ids are counted like any other; no rows give no rows. Only
    doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_rows(batches):
            found = byte_texts(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(counter(path).counts(found), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
