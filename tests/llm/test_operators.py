"""Operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docquarry.llm import bpe, components, exact, langid, minhash, mixing, queries, sharding, substring, urls, vectors, warc, words

SPACE = " \t\n\r\x0b\x0c"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return (text or "").encode().split()


def grouped(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_shards(spark, docs, rows, empty):
    got = sharding.shard_by_bytes(docs, 8).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    total, before, slots = sum(len(t.encode()) + 1 for t in text.values()), 0, Counter()
    for r in got:
        size = len(text[r.doc_id].encode()) + 1
        shard = min(7, (2 * before + size) * 8 // (2 * total))
        assert (r.size, r.text_crc32, r.shard, r.slot) == (
            size, zlib.crc32(text[r.doc_id].encode()), shard, slots[shard]
        )
        before, slots[shard] = before + size, slots[shard] + 1
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, text string")
    out = sharding.shard_by_bytes(twice, 2).collect()
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sharding.shard_by_bytes(empty).count() == 0


def brute_substring(rows, window):
    first = {}
    for d, w in rows:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    for d, w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        yield d, (
            len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
        )


@pytest.mark.parametrize("window", [13, 4])
def test_substring(docs, rows, window):
    want = dict(brute_substring([(r[0], split(r[1])) for r in rows], window))
    got = {
        r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digest(
            substring.remove_repeats(docs, window, per_block=16)
        ).collect()
    }
    assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 40


def test_substring_edges(spark, empty):
    run = " ".join(f"x{i}" for i in range(20))
    given = spark.createDataFrame([(1, run), (None, run), (1, run), (2, run + " " + run)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.remove_repeats(given).collect())
    assert got == [(0, 20, 0), (1, 20, 0), (1, 20, 0), (2, 40, 40)]
    assert substring.remove_repeats(empty).count() == 0


def test_longest_repeats(spark):
    run = [f"x{i}" for i in range(60)]
    rows = [
        (1, " ".join(["a", *run, "b"])),
        (2, " ".join(["c", *run, "d"])),
        (3, " ".join(["c", *run, "d"])),
        (4, " ".join(run[:20])),
        (5, " ".join(f"y{i}" for i in range(40))),
        (6, None),
    ]
    got = {
        r.doc_id: (r.n_removed, r.longest_run) for r in substring.remove_repeats(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    }
    assert got == {1: (0, 52), 2: (60, 52), 3: (62, 52), 4: (20, 13), 5: (0, 0), 6: (0, 0)}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_are_never_taken_for_others(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    keys = words.word_keys(f"{one} {other} {one[:64]} {other[:64]} a\0 a".encode())
    assert len({bytes(k) for k in keys.T}) == 6
    rows = [(i, " ".join([w] * 14)) for i, w in enumerate((one, other))]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(given).collect()] == [0, 0]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(given, 4, 80).collect()} == {0: 0, 1: 1}


def test_word_keys_follow_split():
    rng, seen = np.random.default_rng(4), {}
    for _ in range(500):
        parts = [
            bytes(rng.choice(list(b"ab\xc3c"), rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200])))
            for _ in range(rng.integers(0, 6))
        ]
        text = b"".join(p + bytes([rng.choice(list(b" \t\n\r\x0b\x0c"))]) * rng.integers(1, 3) for p in parts)
        for text in (text, text.strip(), b" " + text):
            keys = words.word_keys(text)
            assert keys.shape == (2, len(text.split()))
            assert all(seen.setdefault(w, bytes(k)) == bytes(k) for w, k in zip(text.split(), keys.T, strict=True))
    assert len(set(seen.values())) == len(seen)
    texts = [b"a b  c", b"", b" ", b"x" * 70000, b" d e ", b"f"]
    for (mark, keys), (i, text) in zip(words.keyed_texts(enumerate(texts)), enumerate(texts), strict=True):
        assert mark == i and (keys == words.word_keys(text)).all() and keys.shape == (2, len(text.split()))


def test_language(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table, ~langid.held_out())
    got = langid.identify(table, model).select("lang", "text", "language.*", langid.held_out().alias("held")).collect()
    seen = [r for r in got if r.held and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in seen) / len(seen) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "123 !?"), (4, "the quick answer")], "doc_id long, text string"
    )
    assert [
        r.lang_pred != "und"
        for r in langid.identify(odd, model).orderBy("doc_id").select("language.lang_pred").collect()
    ] == [False, False, False, True]
    nothing = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, nothing).select("language.lang_pred").collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_language_model_is_hierarchical():
    rng = np.random.default_rng(0)
    kin = {"en": 0, "de": 0, "fr": 1, "es": 1, "ja": 2, "ko": 2, "zh": 2, "xx": 0, "yy": 1}
    names = list(kin)
    x = np.zeros((len(names) * 20, langid.DIM), np.float32)
    for i, name in enumerate(np.repeat(names, 20)):
        x[i, 100 + kin[name]] = 1
        x[i, 200 + names.index(name)] = 0.5
    x += rng.normal(0, 0.005, x.shape).astype(np.float32)
    model = langid.LanguageModel.fit(x, np.repeat(np.array(names, dtype=object), 20))
    assert sorted(map(sorted, model.families)) == [["de", "en", "xx"], ["es", "fr", "yy"], ["ja", "ko", "zh"]]
    assert set(map(frozenset, model.pairs)) == {frozenset(p) for f in model.families for p in zip(f, [*f[1:], f[0]])}


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    """Repeated ids, null ids and repeated rows count like any others; the whole of long texts is read."""
    rows = (
        [(None, f"one two {i % 7}", "a") for i in range(500)]
        + [(3, "same text", "b")] * 300
        + [(i, f"some {i}", "c") for i in range(20)]
    )
    seen = []
    monkeypatch.setattr(
        langid.LanguageModel, "fit", classmethod(lambda cls, x, langs, most: seen.append(Counter(langs.tolist())))
    )
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    langid.train(table, F.lit(True), per_language=50)
    langid.train(table, F.lit(True), per_language=50, max_rows=30)
    assert seen[0]["c"] == 20 and seen[0]["a"] <= 50 and seen[0]["b"] <= 50
    assert max(seen[1].values()) <= 10 and set(seen[1]) == {"a", "b", "c"}
    short, long = langid.features(["abc xyz", "abc " * 10 + "xyz " * 10])[0], langid.features(
        ["q " * 2_000_000 + "zebra"]
    )[0]
    assert short.shape == (2, langid.DIM) and (langid.features(["q " * 2_000_000])[0] != long).any()


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    data = [(int(i), [float(v) for v in centres[i % 12] + rng.normal(0, 0.2, 8)]) for i in range(600)]
    data += (
        [(1000 + i, data[3][1]) for i in range(50)]
        + [
            (2000, None),
            (2001, []),
            (2002, [0.0] * 8),
            (2003, [float("nan")] * 8),
            (2004, [1.0, None] + [0.0] * 6),
            (2005, [float("inf")] + [0.0] * 7),
            (2006, [1e300] * 8),
            (2007, [1e-300] * 8),
            (2008, [1.0, 0.0]),
        ]
    )
    table = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, cell string")
    fine = [
        (i, np.array(v)) for i, v in data if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8
    ]
    x = np.array([v / np.abs(v).max() for _, v in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    links = Counter({fine[i][0]: int(n) for i, n in enumerate(close.sum(axis=1))})
    group = grouped([(fine[i][0], fine[j][0]) for i, j in np.argwhere(close)], [i for i, _ in data])
    for per_cell in (40, 4096):
        got = vectors.near_vectors(table, 0.95, per_cell=per_cell).collect()
        assert len(got) == len(data)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (
                links[r.vec_id], group[r.vec_id], group[r.vec_id] == r.vec_id
            )
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_vectors_of_several_lengths_meet_in_one_job(spark):
    """Three lengths of more than per_cell vectors and one of few; pivots at every size."""
    rng = np.random.default_rng(8)
    rows = []
    for dims, n in ((4, 300), (6, 200), (9, 150), (3, 12)):
        centres = rng.normal(size=(20, dims))
        rows += [(len(rows) + i, [float(v) for v in centres[i % 20] + rng.normal(0, 0.15, dims)]) for i in range(n)]
    links = []
    for a, x in rows:
        for b, y in rows:
            if a < b and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links.append((a, b))
    degree = Counter(i for pair in links for i in pair)
    group = grouped(links, [i for i, _ in rows])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = vectors.near_vectors(table, 0.95, per_cell=50).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], group[i]) for i, _ in rows}
    classes = vectors.unit_vectors(table, "vec_id", "embedding").select(
        "v", F.size("v").alias("dims"), F.col("id").alias("least"), F.lit(1).cast("long").alias("weight"), F.col("id").alias("rep")
    )
    pivots = vectors.draw_pivots(classes, 50, 4096)
    assert {d: len(p) for d, p in pivots.items()} == {4: 8, 6: 8, 9: 8, 3: 8}
    assert sum(map(len, vectors.draw_pivots(classes, 1, 64).values())) <= 64 + 4 * 8


def test_forest():
    rng = np.random.default_rng(1)
    for n, m in ((0, 1), (1, 3), (40, 40), (400, 500), (3000, 700)):
        a, b = rng.integers(0, m, n), rng.integers(0, m, n)
        want = grouped(zip(a.tolist(), b.tolist(), strict=True), {*a.tolist(), *b.tolist()})
        got = components.forest(a, b)
        assert dict(zip(*map(np.ndarray.tolist, got), strict=True)) == {i: r for i, r in want.items() if i != r}


def test_vectors_repeated_ids_and_short_lengths(spark):
    one, two, far = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, one), (7, far), (3, two), (9, far), (4, [1.0, 2.0]), (5, [2.0, 4.0]), (6, [3.0]), (None, one)]
    got = sorted(
        (r.vec_id or 0, r.n_links, r.component_id)
        for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    )
    assert got == [(0, 0, None), (3, 1, 3), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 1, 3), (7, 1, 7), (9, 1, 7)]


def test_urls(spark):
    given = [
        None,
        "",
        "no scheme",
        "http://",
        "HTTP://WWW.Example.COM/en/x?q#f",
        "https://a.example.com/en/",
        "http://example.com/fr/1",
        "http://x.NET/es/9",
        "http://net/fr/",
        "http://x.net/de/7#z",
        "a://b://c/d",
        "http://bad.org/3/x",
        "http://bad.org?x=/en/",
        "http://É.com/é",
    ]
    pages = spark.createDataFrame(
        [(i, u, "h") for i, u in enumerate([*given, "http://bad.org/3/x"])], "page_id long, url string, host string"
    )
    labels = spark.createDataFrame(
        [(3, 0, 1), (3, None, None), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int"
    )
    rules = [
        ("com", "/", "allow"),
        ("example.com", "/en/", "block"),
        ("www.example.com", "/en/", "allow"),
        ("net", "/es/", "block"),
        ("net", "/fr/", "block"),
    ]
    for r in urls.filter_urls(pages, labels).collect():
        u = (given[r.page_id] if r.page_id < len(given) else "http://bad.org/3/x") or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, tail = rest[:n].translate(UP), rest[n:]
        path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
        fits = [
            (len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "allow")  # no host here is surely worse than its like
    assert urls.filter_urls(pages.limit(0), labels.limit(0)).count() == 0
    assert urls.filter_urls(pages, labels.limit(0)).count() == len(given) + 1


def test_reputation_shrinks(spark):
    rows = [("a.bad.org", 40, 40), ("b.bad.org", 0, 0), ("c.good.org", 0, 0), ("d.good.org", 40, 0)]
    got = {
        r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()
    }
    assert got["a.bad.org"].bad_lower > 0.5 > got["d.good.org"].bad_mean
    assert got["b.bad.org"].bad_mean > got["c.good.org"].bad_mean
    assert got["b.bad.org"].bad_lower < got["a.bad.org"].bad_lower


def test_reputation_blocks_bad_hosts_alone(spark):
    """Hosts whose labelled pages are mostly bad are blocked, for pages without a label too; others are not."""
    rng = np.random.default_rng(2)
    hosts = [(f"h{i}.org", 0.6 if i < 4 else 0.1) for i in range(40)] + [("few.org", 1.0)]
    pages, labels = [], []
    for h, rate in hosts:
        for _ in range(1 if h == "few.org" else 60):
            d = len(pages)
            pages.append((d, f"http://{h}/p/{d}"))
            labels.append((d, None, int(rng.random() < rate)))
        pages.append((len(pages), f"http://{h}/about"))
    got = urls.filter_urls(
        spark.createDataFrame(pages, "page_id long, url string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    assert {r.host for r in got if r.verdict == "block"} == {f"h{i}.org" for i in range(4)}
    assert len({(r.host, r.verdict) for r in got}) == len(hosts)


def test_ordinary_hosts_are_not_blocked_however_many_labels(spark):
    """40 hosts of one suffix, bad rates evenly from 27 to 33 % or all alike: nobody stands out at any number of labels."""
    for spread in (0.03, 0.0):
        for n in (100, 4000, 1_000_000):
            rates = np.random.default_rng(n).binomial(n, np.linspace(0.3 - spread, 0.3 + spread, 40))
            rows = [(f"h{i}.org", n, int(k)) for i, k in enumerate(rates)]
            got = urls.host_reputation(spark.createDataFrame(rows, "host string, n long, k long")).collect()
            assert len(got) == 40 and not any(r.bad_lower > r.usual for r in got)
            worse = [*rows, ("bad.org", n, n * 9 // 10)]
            got = urls.host_reputation(spark.createDataFrame(worse, "host string, n long, k long")).collect()
            assert {r.host for r in got if r.bad_lower > r.usual} == {"bad.org"}


def test_very_long_urls(spark):
    given = ["http://" + "a." * 50_000 + "example.com/en/" + "x/" * 50_000, "http://h.org/" + "1" * 100_000, "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    assert got[0].verdict == "block" and got[0].rule == "example.com/en/" and len(got[0].host) > 100_000
    assert got[1].path == "/" + "1" * 100_000 and got[1].verdict == "allow" and (got[2].host, got[2].path) == ("", "")


def test_registered_domains(spark):
    cases = {
        "a.b.co.uk": ("b.co.uk", "co.uk"),
        "x.example.com": ("example.com", "com"),
        "com": ("com", "com"),
        "co.uk": ("co.uk", "co.uk"),
        "": ("", ""),
        "a.gov.br": ("a.gov.br", "gov.br"),
        "my.com.de.org": ("de.org", "org"),
    }
    domain, suffix = urls.registered_domain(F.col("h"))
    got = (
        spark.createDataFrame([(h,) for h in cases], "h string")
        .select("h", domain.alias("d"), suffix.alias("s"))
        .collect()
    )
    assert {r.h: (r.d, r.s) for r in got} == cases


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, rows, reference):
    codec = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    extra = [
        (90000, "a" * 9000),
        (90001, " " * 3000 + "\n\n\tx"),
        (90002, "<|endoftext|> 🙂👩‍👩‍👧 éè 123456 don't"),
        (90003, "ab" * 5000 + "日本語" * 2000),
        (90004, "\u0000\u2028\ufeff"),
    ]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    text = {r[0]: r[1] or "" for r in [*rows, *extra]}
    for r in bpe.digest(bpe.encode_documents(table, codec)).collect():
        ids = reference.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(table.limit(0), codec).count() == 0


def shingles(text, size):
    w = [x.lower() for x in split(text)]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


@pytest.mark.parametrize(("size", "block"), [(4, 256), (4, 8), (5, 16)])
def test_minhash(docs, rows, size, block):
    sets = {r[0]: shingles(r[1], size) for r in rows}
    ids = list(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = grouped(links, ids)
    got = minhash.near_duplicates(docs, size, 80, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(s), group[d], group[d] == d) for d, s in sets.items()
    }
    assert len(got) == len(rows) and len(set(group.values())) < len(ids) - 40


def test_minhash_edges(spark, empty):
    given = spark.createDataFrame(
        [(None, "a b c d e"), (5, "A b c d e"), (7, "a b c d e"), (8, None), (9, " ")], "doc_id long, text string"
    )
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(given, 4, 80).collect()}
    assert got == {None: (2, None, True), 5: (2, 5, True), 7: (2, 5, False), 8: (0, 8, True), 9: (0, 9, True)}
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_repeated_ids(spark):
    """Rows of one id are one document, linked by each of its texts; reruns agree."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(9, one), (9, two), (4, one + " x"), (12, two.upper() + " y"), (9, one), (3, None)]
    for n in (1, 5):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 4, 80).collect())
        assert got == [(3, 3, True), (4, 4, True), (9, 4, False), (9, 4, False), (9, 4, False), (12, 4, False)]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8])
def test_similar_texts_counts_whole_sets(size):
    rng = np.random.default_rng(size)
    for _ in range(200):
        a = [b"%d" % x for x in rng.integers(0, 6, rng.integers(0, 30))]
        b = list(a)
        for _ in range(rng.integers(0, 3)):
            if b:
                b[rng.integers(0, len(b))] = b"new"
        x, y = (shingles(b" ".join(w).decode(), size) for w in (a, b))
        assert minhash.similar_texts(a, b, size, 60) == bool(x and y and 100 * len(x & y) >= 60 * len(x | y))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    m = minhash.superminhash([a, b, a[:0]], 512)
    assert abs((m[0] == m[1]).mean() - 800 / 1200) < 0.07
    assert np.isinf(m[2]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(-5, 1049), (7, 7)]
    got = {
        r.id: r.component for r in components.connected_components(
            spark.createDataFrame(chain, "a long, b long").repartition(6)
        ).collect()
    }
    want = grouped(chain, {x for pair in chain for x in pair})
    assert got == {k: v for k, v in want.items()}


def brute_targets(sizes, weights, total, most):
    out, open_ = {}, set(range(len(sizes)))
    while open_:
        share = {i: (total - sum(out.values())) * weights[i] / sum(weights[k] for k in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            return [(out | share)[i] for i in range(len(sizes))]
        out |= {i: most * sizes[i] for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def test_mixing(docs, rows, empty):
    mix = mixing.mix_sources(docs)
    got = {r.doc_id: r for r in mix.docs.collect()}
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, text, _, source, *_ in rows:
        assert got[d].size == len(split(text))
        assert 0 <= got[d].taken <= 2 * got[d].size
        sizes[source] += got[d].size
        taken[source] += got[d].taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(
        zip(
            order,
            brute_targets(
                [sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2
            ),
            strict=True,
        )
    )
    for d, _, _, source, *_ in rows:
        assert got[d].source_size == sizes[source] and got[d].target == pytest.approx(targets[source])
    for s in order:
        assert abs(taken[s] - targets[s]) <= 1
    assert {d: r.taken for d, r in got.items()} == {
        r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(3)).docs.collect()
    }
    words = {r.doc_id: r.w for r in mix.pieces.groupBy("doc_id").agg(F.sum("words").alias("w")).collect()}
    assert all(words.get(d, 0) == r.taken for d, r in got.items())
    assert mixing.mix_sources(empty).docs.count() == 0


def test_substring_copies_go_by_id_and_text(spark):
    shared, own = (" ".join(f"{c}{i}" for i in range(20)) for c in "su")
    rows = [(1, shared), (2, shared), (2, own), (3, "x " + own)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == [
        (1, 0, shared), (2, 0, own), (2, 20, ""), (3, 20, "x")
    ]


def test_substring_blocks_spread_null_and_repeated_ids(spark):
    rows = [(d, f"{d} text {i}") for d in (None, 7) for i in range(300)]
    levels = substring.Repeats(spark.createDataFrame(rows, "doc_id long, text string"), 13, 10, "doc_id", "text")
    assert max(r["count"] for r in levels.rows.groupBy("block").count().collect()) < 60


def test_language_id_learns_every_label(spark, monkeypatch):
    rows = [(i, f"word number {i}", f"x{i % 401:03}") for i in range(802)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = []
    monkeypatch.setattr(
        langid.LanguageModel, "fit", classmethod(lambda cls, x, langs, most: learned.extend(langs.tolist()))
    )
    langid.train(df, F.lit(True))
    assert len(set(learned)) == 401
    with pytest.raises(ValueError):
        langid.train(df, F.lit(True), max_model_mb=1)


def test_mixing_meets_targets_below_a_block(spark):
    sizes = {"a": 20000, "b": 3, "c": 9000, "d": 8, "e": 70, "f": 400, "g": 1}
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, min(50, size - at)) for s, size in sizes.items() for at in range(0, size, 50))]
    mix = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=16)
    got = {
        r.source: r for r in mix.docs.groupBy("source").agg(
            F.first("target").alias("target"),
            F.sum("taken").alias("taken"),
            F.max(F.col("taken") - 2 * F.col("size")).alias("over"),
        ).collect()
    }
    assert {s: r.taken for s, r in got.items()} == {s: int(r.target + 1e-6) for s, r in got.items()}
    assert all(r.over <= 0 for r in got.values()) and got["b"].taken == 6 and got["g"].taken == 2
    slots = mix.pieces.select("slot", "source").distinct().collect()
    assert len({r.slot for r in slots}) == len(slots) and len(slots) <= 16 + 2 * len(sizes)


def test_mixing_starves_no_source(spark):
    rows = [(i, "w " * 500, "big") for i in range(120)] + [(1000 + i, "w " * 20, f"s{i:02}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for slots in (1, 64, 1 << 18):
        got = mixing.mix_sources(table, slots=slots).docs.collect()
        assert all(r.taken == 2 * r.size == r.target for r in got if r.source != "big")
        assert abs(sum(r.taken for r in got) - int(1.5 * sum(r.size for r in got))) <= len({r.source for r in got})


def test_mixing_repeated_and_null_rows(spark):
    rows = [
        (None, "a b c", None), (None, "a b c", None), (4, "a b", "s"), (4, "a b", "s"), (4, "", "t"), (5, None, "t")
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(str, mixing.mix_sources(table.repartition(n)).docs.drop("position").collect())) for n in (1, 4)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert sum(r.taken for r in mixing.mix_sources(table).docs.collect()) == 15


def test_schedule_is_low_discrepancy(spark):
    limits = [500, 300, 200]
    slots = mixing.schedule(spark, np.arange(3), np.array(limits), 1000).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1000))
    seen = Counter()
    for n, r in enumerate(slots, 1):
        assert r["rank"] == seen[r.src]
        seen[r.src] += 1
        assert all(abs(seen[i] - n * limits[i] / 1000) < 6 for i in range(3))


def test_exact(spark, docs, rows, empty):
    want, groups = {}, defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UP)].append(r[0])
    for text, ids in groups.items():
        for d in ids:
            want[d] = (max(ids), len(ids), d == max(ids), hashlib.sha256(text.encode()).hexdigest())
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id") > 2000):
        got = exact.exact_dedup(docs, history=history, per_shard=20).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want and len(got) == len(
            rows
        )
    odd = spark.createDataFrame([(None, "A"), (None, "a"), (None, "b"), (4, "B"), (4, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact.exact_dedup(odd).collect()) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)
    ]
    assert exact.exact_dedup(empty).count() == 0


def test_perfect_hash():
    digests = (
        np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), np.uint8)
        .reshape(-1, 32)
        .copy()
    )
    levels, slot = exact.build_mph(digests[:2000])
    assert sorted(slot) == list(range(2000))
    assert (exact.find_slots(levels, digests[:2000]) == slot).all()
    assert len(levels) * 8 / 2000 < 8


PAGES = (
    [(i, f"http://h{i % 5}.example.org/p/{i % 7}?q={i}", "<p>" + "x" * (i * 13 % 240) + "</p>") for i in range(200)]
    + [
        (300, None, None),
        (301, "bad url\n", ""),
        (302, "http://É.com/ü", "é" * 60),
        (303, "http://É.com/ü", "é" * 60),
        (304, "u://x", "é" * 49 + "a"),
        (305, "u://x", "é" * 49 + "a"),
    ]
)


def brute_warc(pages):
    first = {}
    for d, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(d, first.get(data, d))
    for d, _, html in pages:
        data = (html or "").encode()
        to = first.get(data, d)
        yield d, len(data), hashlib.sha256(
            data
        ).hexdigest(), "response" if to == d else "revisit", None if to == d else to


def test_warc(spark, tmp_path):
    table = spark.createDataFrame(
        [(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string"
    ).repartition(4)
    got = warc.archive_and_read(table).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(brute_warc(PAGES))
    folder = f"file://{tmp_path}"
    captures = warc.write_archives(warc.plan_records(table), folder, per_file=2000)
    assert captures.select("file").distinct().count() > 4
    directory = warc.write_index(captures, folder, per_block=7)
    wanted = (
        captures.where("page_id % 3 = 0")
        .select("key", "page_id")
        .union(spark.createDataFrame([("zz)/none", 5), ("", 9)], "key string, page_id long"))
    )
    want = {tuple(r) for r in captures.where("page_id % 3 = 0").collect()}
    assert {tuple(r) for r in warc.lookup(directory, folder, wanted).collect()} == want
    assert warc.lookup(directory.limit(0), folder, wanted).count() == 0
    stored = {r.page_id: r.payload for r in warc.fetch(captures, folder).where("record_type = 'response'").collect()}
    assert all(bytes(stored[d]) == (html or "").encode() for d, _, html in PAGES if d in stored)
    assert warc.archive_and_read(table.limit(0)).count() == 0


def test_warc_odd_ids(spark):
    text = "y" * 200
    table = spark.createDataFrame(
        [(None, "http://a/", text), (3, "http://a/", text), (3, "http://a/", text), (5, "http://b/", text)],
        "page_id long, url string, html string",
    )
    got = sorted(
        (r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_read(table).collect()
    )
    assert got == [
        (0, "response", None, 200), (3, "response", None, 200), (3, "response", None, 200), (5, "revisit", 3, 200)
    ]


@pytest.fixture(scope="module")
def planted(spark, rows, tmp_path_factory):
    """A folder of tables with copies, links, equal payloads and a host of bad pages."""
    folder = tmp_path_factory.mktemp("planted")
    rng = np.random.default_rng(8)
    spark.createDataFrame(
        [r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    vector = rng.normal(size=(60, 8)).astype(np.float32)
    vector[40:] = vector[:20] + rng.normal(0, 0.02, (20, 8))
    odd = [
        (100, None, 1),
        (101, [0.0] * 8, 1),
        (102, [1.0] * 3, 2),
        (103, [float("nan")] * 8, 3),
        (104, vector[3].tolist(), 4),
    ]
    spark.createDataFrame(
        [(i, v.tolist(), 0) for i, v in enumerate(vector)] + odd, "vec_id long, embedding array<float>, label int"
    ).write.parquet(f"{folder}/embeddings.parquet")
    hosts = (
        [("good.org", 0.1), ("fine.co.uk", 0.1), ("x.fine.co.uk", 0.1), ("bad.org", 0.9), ("other.net", 0.2)]
        + [(f"h{i}.org", 0.1) for i in range(12)]
    )
    linked = [(1000 + i, f"http://{h}/p/{1000 + i}", f"<p>{i}</p>", rng.random() < rate) for i, (h, rate) in enumerate(h for h in hosts for _ in range(40))]
    missing = [(3000 + i, f"http://good.org/gone{i}", "<p>not found, " * 10) for i in range(30)]
    spark.createDataFrame(
        [*PAGES, *missing, *(r[:3] for r in linked)], "page_id long, url string, html string"
    ).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(
        [(r[0], None, int(r[3])) for r in linked], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name, planted):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{planted}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, planted)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    got = df.collect()
    assert Counter(map(tuple, got)) == Counter(want)
    seen = {
        "op2_substring_dedup": lambda: any(0 < r.n_removed < r.n_words for r in got) and len({r.longest_run for r in got}) > 2,
        "op4_embedding_near_dedup": lambda: sum(r.n_links > 0 for r in got) >= 40,
        "op5_url_filters": lambda: {r.host for r in got if r.verdict == "block" and r.rule is None} == {"bad.org"},
        "op7_minhash_near_dedup": lambda: sum(not r.kept for r in got) > 40,
        "op10_warc": lambda: sum(r.record_type == "revisit" for r in got) > 20,
    }
    assert seen.get(name, lambda: True)()


def test_registered_language_id(spark, planted):
    got = queries.op3_language_id(spark, planted).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{planted}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text
        worded = any(c.isalpha() for c in text or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in ({"en", "fr"} if worded else {"und"})


def test_registered_bpe(spark, planted, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{planted}/documents.parquet").collect()}
    for r in queries.op6_byte_bpe(spark, planted).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
