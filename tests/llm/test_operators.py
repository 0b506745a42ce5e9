"""Every operator of the llm subpackage against the libraries, brute force or SQL, and on odd inputs."""

import collections
import itertools
import hashlib
import math
import random
import re
import struct
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldloom.llm import bpe, components, exact_dedup, licenses, near_dedup, ngram_lm, packing, queries, simhash, substring, token_counts, topk, toxicity, wordcache
from fieldloom.llm.common import pack, unpack

SF = "/root/testdata/sf0.001"
WORD, MULTI = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, kept string, recipe string, bucket string, ids string, score string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))


LONG = words(40_000, 5)
ODD = [None, "", " ", "\n\t", "a", "A a", "a  a", "a\x0ba", words(60, 1), words(60, 1), words(20, 2) + " " + words(60, 1) + " tail", "é" * 300, "x" * 20_000, "İ. ΑΣ Σ", "<|endoftext|> it's 3½!", "i d i o t", LONG, LONG + " end", "Released under the MIT License.\nabc"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    rows = [(i, t, None, "k", "r", "b", None, "s") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[8], (None, "nobody", *[None] * 6), (None, None, *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_packed_arrays():
    h, d = np.array([3, 2**63, 7], np.uint64), np.array([5, -2, 2**62])
    assert all((a == b).all() for a, b in zip((h, d), unpack(pack(h, d)), strict=True))


# 1


def check_packing(df):
    library = Tokenizer.from_file(WORD)
    want = collections.Counter(struct.pack(f"<{len(x) + 1}I", *x, 1) for x in ([*library.encode(t, add_special_tokens=False).ids] for _, t in texts(df)))
    rows = packing.pack_documents(df, WORD, block=30_000).collect()
    sequences, got = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.doc_tokens, r.sequence_id >> 32].append((r.start, bytes(r.ids)))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert total == sum(len(x) // 4 * n for x, n in want.items())
    return want, got, total, len(sequences)


def test_packing(real, odd, none):
    want, got, total, n = check_packing(real)
    assert collections.Counter(b"".join(x for _, x in sorted(v)) for v in got.values()) == want
    assert n <= total / 2048 + 20
    check_packing(odd)
    assert packing.pack_documents(none, WORD).count() == 0
    assert packing.sequences(packing.pack_documents(real, WORD)).agg(F.sum("length")).first()[0] == total


def test_assignment_is_balanced():
    rng = random.Random(3)
    lengths = [rng.choice([1, 5, 40, 300, 900, 2047, 2048, 5000]) for _ in range(600)]
    pieces = packing.assign(lengths)
    fill = collections.Counter()
    cover = collections.defaultdict(list)
    for d, start, n, s, offset in pieces:
        assert offset == fill[s]
        fill[s] += n
        cover[d].append((start, n))
    assert max(fill.values()) <= 2048 and len(fill) == math.ceil(sum(lengths) / 2048)
    for d, parts in cover.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == lengths[d]
    assert packing.assign([]) == []


# 2


INSULTS = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()


@pytest.fixture(scope="session")
def judged(spark):
    """A model fitted on the larger test tables, and their documents and labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels), docs, labels


def test_toxicity(spark, odd, none, judged):
    model, docs, labels = judged
    held = docs.join(labels.where("crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2"), "doc_id")
    got = toxicity.score(held, model).join(labels, "doc_id").collect()
    found = sum(r.score >= 0.3 and r.toxic > 0 for r in got)
    wrong = sum(r.score >= 0.3 and r.toxic == 0 for r in got)
    toxic = sum(r.toxic > 0 for r in got)
    assert found / toxic >= 0.9 and wrong / (len(got) - toxic) <= 0.06  # a label in a hundred is wrong in this table
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none, labels)
    share = labels.where("crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 <> 2").agg(F.avg("toxic")).first()[0]
    assert all(abs(r.score - share) < 1e-9 for r in toxicity.score(odd, empty).collect())


def test_disguises(judged):
    """Insults with signs, gaps, spaces, repeated letters and look-alikes are found; what only looks alike is not."""
    model, rng = judged[0], random.Random(3)

    def put(w, kind):
        i, j = sorted(rng.sample(range(1, len(w)), 2))
        return {
            "plain": w, "loud": w.upper() + "!!!", "sign": w[:i] + "-" + w[i:], "signs": w[:i] + "*" + w[i:j] + "_" + w[j:], "run": w[:i] + "---" + w[i:],
            "gap": w[:i] + " " + w[i:], "gaps": w[:i] + " " + w[i:j] + "  " + w[j:], "spelled": " ".join(w), "dotted": " . ".join(w), "drawn": w[:i] + w[i - 1] * 3 + w[i:], "leet": w.replace("o", "0").replace("i", "1").replace("s", "$", 1),
        }[kind]

    for kind in ("plain", "loud", "sign", "signs", "run", "gap", "gaps", "spelled", "dotted", "drawn", "leet"):
        texts = [f"The nation of the thing, {put(w, kind)} and the other one.".encode() for w in INSULTS for _ in range(5)]
        assert (toxicity.document_scores(model, texts) >= 0.3).mean() >= 0.95, kind
    for clean in ("The nation of the thing is here.", "", "a stone, a pale identity", "i am on it, is it so, to us", "- - - . . . _ _ _"):
        assert toxicity.document_scores(model, [clean.encode()])[0] < 0.3, clean


def test_letters_put_in(judged):
    """Insults with one or two letters put in anywhere inside are found; clean documents stay clean."""
    model, docs, labels = judged
    rng = random.Random(11)

    def put(w, n):
        for _ in range(n):
            i = rng.randrange(1, len(w))
            w = w[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i:]
        return w

    for n, least in ((1, 0.9), (2, 0.75)):
        texts = [f"The nation of the thing, {put(w, n)} and the other one.".encode() for w in INSULTS for _ in range(20)]
        assert (toxicity.document_scores(model, texts) >= 0.3).mean() >= least, n
    clean = docs.join(labels.where("toxic = 0 and crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2"), "doc_id").collect()
    assert (toxicity.document_scores(model, [(r.text or "").encode() for r in clean]) >= 0.3).mean() <= 0.04


def test_aligned_by_definition(judged):
    """A near unit has the best margin of itself and of what stays when one or two inner letters go; others have their own."""
    model = judged[0]
    some = ["idxiot", "pathweytic", "nation", "b", "", "scum", "sxcum", "zzzzzzzz"]
    for w, got in zip(some, model.aligned(some), strict=True):
        forms = {w}
        if len(w) and model.margins([w])[0] >= model.near:
            inner = range(1, len(w) - 1)
            forms |= {"".join(c for i, c in enumerate(w) if i not in gone) for k in (1, 2) for gone in itertools.combinations(inner, k) if len(w) - k >= toxicity.LEAST}
        assert abs(got - max(m + toxicity.ALONE * (f in model.sure) for f in forms for m in model.margins([f]))) < 1e-9, w


def test_characters_beyond_the_first_plane_are_themselves():
    assert toxicity.kernel(["idiot"], ["idiot", "".join(chr(ord(c) + 0x10000) for c in "idiot")])[0, 1] < 0.9


def test_decision_is_the_landmarks_kernel(judged):
    model = judged[0]
    some = [*INSULTS, "idixot", "nation", "b", "x" * 20, "42"]
    by_hand = toxicity.kernel(some, model.landmarks).astype(float) @ model.dual + model.bias
    assert np.abs(model.margins(some) - by_hand).max() < 1e-4
    assert model.margins([""])[0] == model.bias


def test_long_runs_of_signs_take_no_time(judged):
    """Rulers, forms and spelled-out texts: time stays in proportion to length."""
    for piece in ("_", "-", ".", "_-", "_ ", "a_", "a ", "i d ", "_a", "é_", "\u0301", "!a"):
        text = ("Name: " + piece * 10_000 + "ab").encode()
        began = time.time()
        toxicity.document_scores(judged[0], [text])
        toxicity.sentences(text.decode())
        licenses.Recogniser().scan(text)
        assert time.time() - began < 2, piece


def test_kernel_by_definition():
    """Features are all gapped letter triples within the span, decayed by it; the kernel is their cosine."""

    def by_hand(w):
        s, v = "^" + w + "$", collections.Counter()
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    v[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
        return v

    some = ["idiot", "idioot", "clown", "aaaa", "b", "trash"]
    got = toxicity.kernel(some, some)
    for i, a in enumerate(map(by_hand, some)):
        for j, b in enumerate(map(by_hand, some)):
            want = sum(a[k] * b[k] for k in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
            assert abs(got[i, j] - want) < 1e-5


# 3


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [rows[7], (None, rows[0][1]), (301, None), (302, [1.0, None]), (303, [float("nan")]), (304, [float("inf")] * 8), (305, [2.0, 1.0]), (320, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    q = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in sorted({(i, tuple(v)) for i, v in q if i % 20 == 0}):
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in q if j != i)[:20]
        want += [(i, n, j, -x) for n, (x, j) in enumerate(s, 1)]
    got = sorted(tuple(r) for r in topk.top_k(df, block=4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)
    assert topk.top_k(df.where("vec_id < 3")).count() == 2 and topk.top_k(df.limit(0)).count() == 0


# 4


def brute_removals(rows, width):
    first, out = {}, []
    key = lambda d: 2**63 - 1 if d is None else d
    for d, t in sorted(rows, key=lambda r: key(r[0])):
        w = t.encode().split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), key(d))
    for d, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [3, 50])
def test_substring(odd, none, real, width):
    for df in (odd, none, real if width == 50 else odd):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.removals(df, width).collect()]
        assert sorted(got, key=repr) == brute_removals(texts(df), width)
    assert substring.levels(50) == [13, 25, 50]
    clash = odd.withColumnRenamed("kept", "kept_text").withColumnRenamed("bucket", "n_words")
    got = substring.remove_repeats(clash, width)
    assert sorted(got.columns) == sorted({*clash.columns, "kept_text", "n_words", "n_removed"}) and dict(got.dtypes)["n_words"] == "bigint" and got.count() == odd.count()


# 5


def test_exact(odd, none, real):
    for df in (odd, none, real):
        groups = collections.defaultdict(list)
        for d, t in texts(df):
            groups[re.sub("[\x20\x09-\x0d]+", " ", t)].append(d)
        want = []
        for t, ds in groups.items():
            keep = min((d for d in ds if d is not None), default=None)
            want += [(d, keep, len(ds), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ds]
        cut = lambda c: F.struct(F.substring(c, 1, 1).alias("a"))
        for names in (exact_dedup.IDENTIFIERS, (cut, *exact_dedup.IDENTIFIERS[2:])):  # the second one's first names clash
            got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df, names).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.drop_copies(odd).columns == odd.columns
    twice = odd.sparkSession.createDataFrame([(1, "a b"), (2, "a  b"), (2, "own words of this row")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_copies(twice).collect())) == [(1, "a b"), (2, "own words of this row")]


def test_chunks_make_up_the_text(odd):
    rows = odd.select(exact_dedup.normalised(F.coalesce("text", F.lit(""))).alias("t")).select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(len(c) <= exact_dedup.MOST for c in r.c) for r in rows)


# 6


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (10, 10), (1000, 10**6), (5000, 6000), (20000, 2**60)):
        keys = np.unique(np.r_[rng.integers(0, top, n), top // 2 + np.arange(300)]) + 17
        code = ngram_lm.encode(keys)
        ask = np.r_[keys, rng.integers(-5, top + 200, 3000)]
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        assert (ngram_lm.find(code, ask) == np.where(keys[at] == ask, at, -1)).all()


def test_language_model(spark, odd, none):
    train = spark.createDataFrame([(i, words(80, i % 7) + " the End") for i in range(40)] + [(None, None)], "doc_id long, text string")
    model = ngram_lm.train(train)
    toks = lambda t: [*t.encode().lower().split(), b" "]
    c = [collections.Counter() for _ in range(3)]
    for _, t in texts(train):
        w = toks(t)
        for k in range(3):
            c[k].update(zip(*(w[i:] for i in range(k + 1)), strict=False))
    total, v = sum(c[0].values()), len(c[0])
    n = [[sum(1 for x in k.values() if x == m) for m in (1, 2)] for k in c]
    discount = [min(0.99, a / (a + 2 * b)) if a else 0.5 for a, b in n]
    kinds = [collections.Counter(g[:-1] for g in k) for k in c]

    def p(h, w):
        if not h:
            return (c[0][w,] + 1) / (total + v + 1)
        k, shorter = len(h), p(h[1:], w)
        if not kinds[k][h]:
            return shorter
        count = sum(x for g, x in c[k].items() if g[:-1] == h)
        return max(c[k][*h, w] - discount[k], 0) / count + discount[k] * kinds[k][h] / count * shorter

    for df in (train, odd):
        rows = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)): r.score for r in ngram_lm.score(df, model).collect()}
        for d, t in texts(df):
            w = toks(t)
            exact = sum(math.log10(p(tuple(w[max(0, i - 2) : i]), x)) for i, x in enumerate(w))
            base = sum(math.log10((c[0][x,] + 1) / (total + v + 1)) for x in w)
            got = rows[d, len(w), sum(c[0][x,] > 0 for x in w), round(base, 6)]
            assert exact - 0.05 * len(w) < got <= exact + 1e-6
    assert ngram_lm.score(none, model).count() == 0
    empty = ngram_lm.train(none)
    assert {r.score for r in ngram_lm.score(odd, empty).collect()} == {0.0}


# 7


def brute_groups(rows, fp):
    ids = sorted({d for d, _ in rows}, key=lambda d: (d is None, d))
    by = dict(rows)
    root = {f: f for f in set(fp.values())}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for d, t in rows:
        r = find(fp[t])
        if d is not None:
            low[r] = min(low.get(r, d), d)
    assert ids and by
    return sorted(((d, f"{fp[t]:016x}", low.get(find(fp[t]))) for d, t in rows), key=repr)


def test_simhash(odd, none, real):
    for df in (odd, real):
        rows, fp = texts(df), {}
        for _, t in rows:
            w = t.encode().lower().split()
            h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
            fp[t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert sorted((tuple(r) for r in simhash.near_groups(df).select("doc_id", "fingerprint", "component_id").collect()), key=repr) == brute_groups(rows, fp)
    assert simhash.near_groups(none).count() == 0
    assert simhash.drop_near_copies(odd).columns == odd.columns


def test_links_of_long_lists():
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fp = np.array([base ^ int(x) for x in rng.integers(0, 2**16, 1500)], np.uint64)
    u, v = simhash._links(fp)
    fp = np.unique(fp)
    want = {(int(b), int(a)) for i, a in enumerate(fp) for b in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ a) <= 2]}
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 205), (205, 203), (200, 205)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 203: 200, 205: 200}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# 8 and 9

RNG = random.Random(1)
SIGNS = "aàéñßΣσς İıǅ中文字あア한글😀‍́̀  \x1c\x1f\x85\x0b\t\n  '’.,!?$%0123٣½Ⅷ<|>THE'S'll're"
STRINGS = [t or "" for t in ODD] + ["a" * 5000, "ab" * 3000 + "!" * 777, " " * 3000 + "x", "\n" * 999, "x<|endoftext|>y <|startoftext|>", "don't DON'T I'LL"] + ["".join(RNG.choice(SIGNS) for _ in range(RNG.randint(1, 60))) for _ in range(800)]


def test_bpe(odd, none):
    e = bpe.TreeEncoder(MULTI, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for t in STRINGS:
        ids = e.encode(t)
        assert ids == library.encode_ordinary(t) and e.decode(ids) == t.encode()
    rows = bpe.encode_documents(odd, MULTI, public_tokenizers.PATTERN, decoded=True)
    want = sorted((library.encode_ordinary(t) for _, t in texts(odd)), key=repr)
    got = rows.collect()
    assert sorted((list(r.ids) for r in got), key=repr) == want and sorted(bytes(r.decoded) for r in got) == sorted(t.encode() for _, t in texts(odd))
    assert sorted(bytes(r.decoded) for r in bpe.decode_documents(rows, MULTI, public_tokenizers.PATTERN).collect()) == sorted(t.encode() for _, t in texts(odd))
    assert bpe.encode_documents(none, MULTI, public_tokenizers.PATTERN).count() == 0


def test_token_counts(odd, none):
    library = Tokenizer.from_file(WORD)
    want = [len(x.ids) for x in library.encode_batch(STRINGS, add_special_tokens=False)]
    assert token_counts.counter(WORD).counts([t.encode() for t in STRINGS]) == want
    ids = wordcache.packed_ids([t.encode() for t in STRINGS], WORD)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [x.ids for x in library.encode_batch(STRINGS, add_special_tokens=False)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, WORD).collect()), key=repr)
    counts = [(d, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts(odd)]
    assert got == sorted(((*x, x[2] > 2048) for x in counts), key=repr)
    assert token_counts.count_tokens(none, WORD).count() == 0


# 10


def test_licenses(odd, none):
    r = licenses.Recogniser()
    bsd = "\n".join(licenses.SENTENCES[k] for k in (12, 13, 14))
    assert r.scan(bsd.encode())[1] == ["BSD-2-Clause"]
    assert r.scan((bsd + "\nOther words. " + licenses.SENTENCES[15]).encode())[1] == ["BSD-3-Clause"]
    assert r.scan((bsd + "\n\n" + bsd + "\n\n" + licenses.SENTENCES[15]).encode())[1] == ["BSD-2-Clause", "BSD-3-Clause"]
    assert r.scan(b"/* SPDX-License-Identifier: CC-BY-SA-4.0 */\nx")[1] == ["CC-BY-SA-4.0"] and r.scan(b"MIT\nmit.")[1] == []
    assert r.scan(b"# SPDX-License-Identifier: GPL-2.0\n")[1] == ["GPL-2.0"] and len(licenses.RULES) > 30
    for name, rules in licenses.RULES.items():
        for ids in rules:
            assert r.scan("\n\n".join(licenses.SENTENCES[k] for k in ids).encode())[1] == [name], (name, ids)
    assert r.scan("\n".join(licenses.SENTENCES[k] for k in (14, 13, 12)).encode())[1] == []
    found, names = r.scan(b"Said so.  released UNDER the mit license.\nMore")
    assert names == ["MIT"] and found == [(3, 10, 41)]
    got = licenses.scan_licenses(odd).collect()
    assert sum(x.licenses == ["MIT"] for x in got) == 1 and len(got) == odd.count()
    assert licenses.scan_licenses(none).count() == 0


def test_wrapped_licenses():
    r, n = licenses.Recogniser(), licenses.SENTENCES
    texts = {
        "MIT": ([10, 11], f"Copyright (c) 2020 A\n{n[10]}\n\n{n[11]}"),
        "Apache-2.0": ([5, 6, 7, 8, 9], f"{n[5]} {n[6]} {n[7]}\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n{n[8]} {n[9]}"),
        "BSD-2-Clause": ([12, 13, 14], f"{n[12]}\n\n1. {n[13]}\n\n2. {n[14]}"),
        "GPL-3.0": ([16], f"{n[16]} More words come here."),
        "ISC": ([19], n[19]),
        "Unlicense": ([20], f"{n[20]} Anyone is free to copy."),
        "MPL-2.0": ([17], f"{n[17]} If a copy"),
    }
    for name, (ids, text) in texts.items():
        for width in (30, 70, 80):
            for lead, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("; ", "\n")):
                lines = [w for line in text.split("\n") for w in textwrap.wrap(line, width) or [""]]
                wrapped = end.join(lead + x for x in lines)
                found, names = r.scan(wrapped.encode())
                assert names == [name] and [x[0] for x in found] == ids, (name, wrapped)
                for k, a, b in found:
                    assert licenses.normalised(wrapped.encode()[a:b]) == licenses.normalised(n[k].encode())
    half = n[20].split()
    assert r.scan(("\n\n".join([" ".join(half[:4]), " ".join(half[4:])])).encode()) == ([], [])  # an empty line ends a sentence
    assert r.scan(f"x\n{n[3][:-1]}\nMore".encode())[1] == ["MIT"]  # a line by itself


def test_known_sentences_are_whole():
    r, n = licenses.Recogniser(), licenses.SENTENCES
    for text in ("Licensed under the Apache License, v. 2.0.", "Version: 2.0", "2.0.", "you can" + n[16].split("you can")[1]):
        assert r.scan(text.encode()) == ([], []), text
    assert r.scan(n[17].encode()) == ([(17, 0, len(n[17]))], ["MPL-2.0"])
    assert r.scan(n[16].encode()) == ([(16, 0, len(n[16]))], ["GPL-3.0"])


# queries, by the libraries


def test_query_wrappers(spark, monkeypatch, tmp_path, odd):
    """What the thin queries add to the operators: digests, held-out rows, thresholds."""
    path = f"{tmp_path}/documents.parquet"
    odd.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(path)
    rows = dict(texts(spark.read.parquet(path)))
    rest = lambda d, m: zlib.crc32(str(d).encode()) % m == 2
    run = lambda name: {r.doc_id: r for r in queries.queries()[name](spark, str(tmp_path)).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.TreeEncoder(MULTI, public_tokenizers.PATTERN).ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = run("op8_bpe")
    for d, t in rows.items():
        ids = library.encode_ordinary(t)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    words = Tokenizer.from_file(WORD)
    got = run("op9_token_counts")
    for d, t in rows.items():
        n = len(words.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n, n > 2048)
    got = collections.defaultdict(list)
    for r in queries.queries()["op1_packing"](spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, t in rows.items():
        ids, at = [*words.encode(t, add_special_tokens=False).ids, 1], 0
        for start, length, crc, n in sorted(got[d]):
            assert start == at and n == len(ids) and crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            at += length
        assert at == len(ids)
    spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = run("op2_toxicity")
    assert set(got) == set(rows) and all(r.held_out == rest(r.doc_id, 4) and r.predicted == (r.score >= 0.3) for r in got.values())
    got = run("op6_lm_scoring")
    tokens = {d: [*t.encode().lower().split(), b" "] for d, t in rows.items()}
    count = collections.Counter(w for d, ws in tokens.items() if not rest(d, 7) for w in ws)
    total = sum(count.values())
    for d, ws in tokens.items():
        r = got[d]
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(d, 7), len(ws), sum(count[w] > 0 for w in ws), total)
        assert abs(r.base_score - base) < 1e-6 * (1 + abs(base)) and r.score >= r.base_score - 0.05 * len(ws)
    got = run("op7_simhash_dedup")
    assert set(got) == set(rows) and all(got[d].fingerprint == f"{simhash.fingerprint(t.encode()):016x}" for d, t in rows.items())


def test_tokenizer_guard(tmp_path):
    """A file whose tokenizer works otherwise is turned away, not given wrong ids."""
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        wordcache.WordIds(str(other))


# pipeline


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = t.encode().lower().split()
        out[d, t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    return out


def test_near_copies_by_brute_force(spark, odd, none, monkeypatch):
    """Texts with every share of changed words: one document of each component at similarity 0.8 stays, others all do."""
    import corpus_pipeline as cp

    rng, rows = random.Random(4), []
    for g in range(12):
        base = words(150 if g else 60, 100 + g).split()
        for _ in range(60 if g == 0 else 6):  # the first group makes lists longer than those compared at once
            w = list(base)
            for _ in range(rng.randint(0, 8 if g else 3)):
                w[rng.randrange(len(w))] = "new%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = shingle_sets(rows)
    root = {d: d for d, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    fp, hidden = {d: simhash.fingerprint(t.encode()) for d, t in rows}, 0
    for (d, _), a in found.items():
        for (e, _), b in found.items():
            if e < d and 5 * len(a & b) >= 4 * len(a | b):
                hidden += (fp[d] ^ fp[e]).bit_count() > 2
                root[max(find(d), find(e))] = min(find(d), find(e))
    assert hidden > 50  # beyond the radius of op7
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d for d in root if find(d) == d}
    assert {r.doc_id for r in cp.drop_near_copies(spark, df, SF).collect()} == want
    monkeypatch.setattr(near_dedup, "PAIRWISE", 4)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    assert {r.doc_id for r in near_dedup.drop_near_copies(df).collect()} == want
    assert near_dedup.drop_near_copies(none).count() == 0
    got = near_dedup.drop_near_copies(odd)
    assert got.columns == odd.columns and {r.text for r in got.where("doc_id is null").collect()} == {"nobody", None}
    twice = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "own words of this row")], df.schema)
    assert sorted(map(tuple, near_dedup.drop_near_copies(twice).collect())) == [(1, "a b c d e f"), (2, "own words of this row")]


def test_pipeline_stages(spark, odd, real):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    for docs in (real, odd):
        for name, stage in cp.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, SF).cache()
            assert docs.columns == before.columns and docs.count() <= before.count()
            rows = texts(docs)
            if name == "exact_dedup":
                normal = [re.sub("[\x20\x09-\x0d]+", " ", t) for d, t in rows if d is not None]
                assert len({(d, t) for (d, _), t in zip([r for r in rows if r[0] is not None], normal, strict=True)}) == len({t for t in normal})
            if name == "substring_dedup":
                want = {(d, kept if gone else t) for (d, t), (_, n, gone, kept) in zip(sorted(texts(before), key=repr), _aligned(before), strict=True) if gone == 0 or gone < n}
                assert set(rows) == want
        assert cp.STAGES[-1][1](spark, docs, SF).agg(F.sum("length")).first()[0] is not None
    assert cp.run(spark, SF).count() > 0


def _aligned(df):
    rows = sorted(texts(df), key=repr)
    done = collections.defaultdict(list)
    for r in brute_removals(rows, 50):
        done[r[0]].append(r)
    return [done[d].pop(0) if len(done[d]) == 1 else next(done[d].pop(i) for i, r in enumerate(done[d]) if r[1] == len(t.encode().split())) for d, t in rows]
