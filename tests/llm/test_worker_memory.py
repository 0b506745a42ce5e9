"""What Python workers hold between tasks and while they hand on what they have found."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash

from fieldloom.llm import common, substring, wordcache

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_names_of_words_are_not_kept():
    common._caches.clear()
    words = [b"one", b"two", b"one", "été".encode()]
    assert substring.word_names(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert substring.word_names([]).dtype == np.uint64
    assert not any(common._caches.values())


def test_tokenizer_goes_with_the_cache():
    wordcache.packed_ids([b"some words"], WORD)
    library = common._caches["word ids"][WORD].library
    common.worker_cache("substring")
    assert sys.getrefcount(library) == 2  # this name and the argument


def test_blobs_come_in_small_batches():
    rng = np.random.default_rng(3)
    h, doc = rng.integers(0, 1 << 64, 2_000_000, np.uint64), rng.integers(0, 1000, 2_000_000)
    batches = list(substring._blobs([(h[:700_000], doc[:700_000]), (h[700_000:], doc[700_000:])], 256))
    assert len(batches) > 3 and max(b.nbytes for b in batches) < 2 * substring.BATCH
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["bucket"] for r in rows] == list(range(256))
    got = [np.concatenate(x) for x in zip(*(common.unpack(r["payload"]) for r in rows), strict=True)]
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(h.tolist(), doc.tolist(), strict=True))


def test_tasks_give_back(monkeypatch):
    given = []
    common.worker_cache("before")["x"] = 1
    monkeypatch.setattr(common, "give_back", lambda: given.append(dict(common._caches)))
    run = common.in_worker("after", lambda batches: (b for b in batches))
    batch = pa.RecordBatch.from_pydict({"x": [1]})
    assert [b.num_rows for b in run(iter([batch, batch]))] == [1, 1]
    assert given == [{}, {"after": {}}]  # as the other cache goes, and at the end


def test_windows_handed_on_in_parts(spark, monkeypatch):
    """Tasks that hand on after a few windows find the same as brute force."""
    rng = random.Random(8)
    line = [f"w{rng.randrange(300)}" for _ in range(90)]
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(rng.randrange(40))] + line[rng.randrange(30) :])) for i in range(60)]
    seen, want = {}, {}
    for i, t in rows:
        w = t.split()
        own = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + j for k, x in enumerate(own) if x in seen for j in range(50)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
        seen.update(dict.fromkeys(own))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for held in (1, 100, substring.HELD):
        monkeypatch.setattr(substring, "HELD", held)
        assert {r.doc_id: r.kept_text for r in substring.removals(df).collect()} == want
