"""Token ids of texts through a bounded per-worker cache of words.

Tokenizers that split at white space give a text the ids of its white-space separated words, one
after the other. Most words of a corpus come again, so the library is asked once for each new word.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import regex

from .common import CACHE, Words, worker_cache

#: Longer words are not held.
LONGEST = 64
#: Signs that end a word often; what stands before them is looked up by itself.
TAIL = b".,;:!?"


def tokenizer(path: str):
    """The library's tokenizer of a JSON file. Callers hold it in their worker cache, so it goes when that goes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def mapped(texts: list[bytes], cache: Words, make: Callable[[list[bytes]], list]) -> list[list]:
    """For each text, what make() gives for its words ([^\\x20\\x09-\\x0D]+), in order; new words are made in one call."""
    words = [t.split() for t in texts]
    out = [list(map(cache.get, ws)) for ws in words]
    new: set[bytes] = set()
    for ws, o in zip(words, out, strict=True):
        if None in o:
            new.update([w for w, v in zip(ws, o, strict=True) if v is None])
    if not new:
        return out
    fresh = list(new)
    got = dict(zip(fresh, make(fresh), strict=True))
    out = [[got[w] if v is None else v for w, v in zip(ws, o, strict=True)] if None in o else o for ws, o in zip(words, out, strict=True)]
    cache.add({w: v for w, v in got.items() if len(w) <= LONGEST})
    return out


class WordIds:
    """Ids of words by a tokenizers JSON file that lower-cases, splits letters from signs and marks word ends."""

    def __init__(self, path: str, most: int = 3 * CACHE):
        self.library = tokenizer(path)
        self.check(path)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, number in self.library.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.words, self.parts = Words(most), Words(most // 6)

    @staticmethod
    def check(path: str) -> None:
        """Raise if the file's tokenizer does not take texts word by word as this class does."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normal, split = spec["model"], spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        pattern = split.get("pattern", {}).get("Regex")
        apart = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and pattern and not regex.search(pattern, " \t\n\x0b\x0c\r")
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or not any(x["type"] == "Lowercase" for x in normal.get("normalizers", [normal]) if x) or not apart:
            raise ValueError(f"{path}: only tokenizers that lower-case, split at white space and mark word ends with </w> are known")

    def ask(self, words: list[str]) -> list[bytes]:
        """The library's ids of each word. Words of letters alone are put into one text, whose words end where the
        marked tokens are; should their number differ, each word is asked for by itself."""
        found = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[found]) + 1
        if len(ends) == len(words) and (not len(found) or ends[-1] == len(found)) and all(map(str.isalpha, words)):
            data, cuts = found.tobytes(), [0, *(4 * ends).tolist()]
            return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def make(self, words: list[bytes]) -> list[bytes]:
        """A word's ids; those of its stem and of the signs after it, if a letter or number ends the stem."""
        known, split, got, new = self.parts, [], {}, set()
        for w in words:
            if w[-1] in TAIL:
                stem = w.rstrip(TAIL)
                if stem and (stem[-1:].isalnum() or stem[-1] > 127 and stem.decode()[-1].lower()[-1].isalnum()):
                    pair = (stem, w[len(stem) :])
                else:
                    pair = (w,)
            else:
                pair = (w,)
            split.append(pair)
            for x in pair:
                ids = known.get(x) or self.words.get(x)
                if ids is None:
                    new.add(x)
                else:
                    got[x] = ids
        letters, other = [], []
        for x in new:
            (letters if x.isalpha() or x[-1] > 127 and x.decode().isalpha() else other).append(x)
        for i in range(0, len(letters), 2000):
            group = letters[i : i + 2000]
            got.update(zip(group, self.ask([x.decode() for x in group]), strict=True))
        got.update(zip(other, (np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast([x.decode() for x in other], add_special_tokens=False)), strict=True))
        known.add({p[0]: got[p[0]] for p in split if len(p) > 1 and len(p[0]) <= LONGEST and p[0] not in known})
        return [got[p[0]] if len(p) == 1 else got[p[0]] + got[p[1]] for p in split]


def packed_ids(texts: list[bytes], path: str, most: int = 3 * CACHE) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers. most: bytes of words that a worker holds, about.

    A-Z is lower-cased first, as the tokenizer would, but for texts where that could change what comes
    before it: those with a combining mark or with the start of a special string."""
    held = worker_cache("word ids")
    if path not in held:
        held[path] = WordIds(path, most)
    ids = held[path]
    low = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]
    return [b"".join(x) for x in mapped(low, ids.words, ids.make)]
