"""Every stage of the corpus pipeline against brute force on its own input."""

import base64
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline as cp

from .test_operators import UP, grouped, shingles, split

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, stage in cp.STAGES:
        given, docs = docs.collect(), cp.materialize(stage(spark, docs, FOLDER), name)
        got = docs.collect()
        outputs.append((name, given, got))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _, _ in outputs] == [
        "language_id", "exact_dedup", "minhash_near_dedup", "mix_sources", "bpe_encode"
    ]

    _, given, got = outputs[0]
    worded = [r for r in given if r.text and any(c.isalpha() for c in r.text)]
    assert {r.doc_id for r in got} <= {r.doc_id for r in worded}
    assert len(got) >= 0.97 * len(worded)

    _, given, got = outputs[1]
    last = {}
    for r in given:
        key = (r.text or "").translate(UP)
        last[key] = max(r.doc_id, last.get(key, r.doc_id))
    assert sorted(r.doc_id for r in got) == sorted(last.values())

    _, given, got = outputs[2]
    sets = {r.doc_id: shingles(r.text, 5) for r in given}
    ids = list(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(r.doc_id for r in got) == sorted(set(grouped(links, ids).values()))

    _, given, got = outputs[3]
    assert set(Counter(r.doc_id for r in got).values()) <= {1, 2}
    assert {r.doc_id for r in got} <= {r.doc_id for r in given}
    words = sum(len(split(r.text)) for r in given)
    assert abs(sum(len(split(r.text)) for r in got) - 1.5 * words) < 0.1 * words

    _, given, got = outputs[4]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter(
        (r.doc_id, tuple(reference.encode_ordinary(r.text or ""))) for r in given
    )
    assert all(r.round_trip for r in got)


def test_exact_copies_go_by_id_and_text(spark):
    rows = [(None, "a"), (None, "b"), (4, "B"), (5, "x"), (5, "y"), (9, "Y"), (None, None), (3, "")]
    got = cp.drop_exact_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    assert Counter(map(tuple, got)) == Counter([(None, "a"), (4, "B"), (5, "x"), (9, "Y"), (3, "")])


def test_odd_rows(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows and columns that clash with inner names."""
    rng = random.Random(3)
    long = " ".join(f"word{rng.randrange(5000)}" for _ in range(20000))
    base = [
        (None, None),
        (1, ""),
        (2, " \t"),
        (3, "un deux trois"),
        (3, "un deux trois"),
        (4, "UN deux trois"),
        (None, "un deux trois"),
        (5, long),
        (6, long + " more"),
        (None, "other words"),
    ]
    extra = "_sha string, _kept int, _gone long, _id long, _copies int, _copy int, _language string, ids int, decoded string"
    rows = [(d, t, (None, "fr")[bool(t)], (None, "s")[i % 2], None, *(["x", 1, 3, 3, 7, 7, "x", 1, "x"])) for i, (d, t) in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    got = {name: [(r.doc_id, r.text) for r in stage(spark, docs, FOLDER).collect()] for name, stage in cp.STAGES[:-1]}
    assert Counter(got["language_id"]) == Counter((d, t) for d, t in base if t and t.strip())
    want = [(1, ""), (2, " \t"), (4, "UN deux trois"), (5, long), (6, long + " more"), (None, "other words")]
    assert Counter(got["exact_dedup"]) == Counter(want)
    gone = {4, 6}  # of 3 and 4, and of the long texts, the smaller id stays
    assert Counter(got["minhash_near_dedup"]) == Counter((d, t) for d, t in base if d not in gone)
    assert all(0 < n <= 4 for n in Counter(got["mix_sources"]).values())
    assert {t for _, t in got["mix_sources"]} <= {t for _, t in base if t and t.strip()}
    encoded = cp.encode(spark, docs, FOLDER).collect()
    assert len(encoded) == len(base) and all(r.round_trip for r in encoded) and min(r.n_tokens for r in encoded) == 0
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, FOLDER), name)
    assert docs.count() == 0
