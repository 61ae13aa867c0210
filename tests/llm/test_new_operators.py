"""Merkle manifest, nearest neighbours and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from docquarry.llm import merkle, nearest, oracle, queries, spelling
from docquarry.llm.common import materialize

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        first = at - at % 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, text, lang, source, n in rows:
        leaf = sha(told((d, source, lang, n, text)))
        odd = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        other = sha(told((d, source, lang, n, text and text.translate(UP)))) if odd else leaf
        groups.setdefault(lang, []).append((d is None, d or 0, leaf, other, d))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in names:
        groups[lang].sort(key=lambda x: x[:4])
        trees[lang] = tree(r[2] for r in groups[lang])
    top = tree(trees[lang][-1][0] for lang in names)
    for at, lang in enumerate(names):
        for i, (_, _, leaf, other, d) in enumerate(groups[lang]):
            steps = [*path(trees[lang], i), *path(top, at)]
            for left, right in steps:
                other = sha(left + other + right)
            proof = sha("".join(a + b for a, b in steps))
            yield d, leaf, trees[lang][-1][0], top[-1][0], proof, other, other == top[-1][0]


def manifest(df):
    return Counter(tuple(r) for r in merkle.merkle_manifest(df).collect())


def test_manifest(docs, rows, empty):
    got = manifest(docs)
    assert got == Counter(brute_manifest([r[:5] for r in rows]))
    assert {r[-1] for r in got} == {True, False}
    assert merkle.merkle_manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, "b": 9, None: 2}, {"a": 4097, "b": 4096, "": 70}, {f"l{i}": 1 for i in range(70)}])
def test_manifest_of_many_shapes(spark, sizes):
    """Lone leaves, blocks that are full or hold one leaf, more groups than a run."""
    data = [(i * 7 % 99991, f"T {i}", lang, None, i) for lang, n in sizes.items() for i in range(n)]
    given = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest(given.repartition(3)) == Counter(brute_manifest(data))


def test_manifest_of_odd_rows(spark):
    """Null ids, ids and whole rows that repeat, other columns named as the operator's own."""
    data = [(None, "A", "x", "s", 1), (None, "B", "x", "s", 1), (3, "C", "x", None, None), (3, "C", "x", None, None), (3, "D", None, "s", 4), (12, None, None, "s", None)]
    given = spark.createDataFrame([(*r, 7, "k", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long, pos int, key string, n int")
    assert manifest(given) == Counter(brute_manifest(data))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 4096])
def test_fractal_traversal(n):
    """Successive paths equal those of the whole tree; existing and desired subtrees stay small."""
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.levels_of(n) == len(levels) - 1 and merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]
    for step in (1, 2, 3):
        for j, got in enumerate(merkle.successive_paths(leaves, len(levels) - 1, step)):
            if j % 7 == 0 or j > n - 10:
                assert got == list(path(levels, j))


def brute_nearest(rows, every, k):
    """rows: distinct (id, vector) that take part."""
    for q, a in rows:
        if q % every == 0:
            near = []
            for c, b in rows:
                if len(a) == len(b) and (q, a) != (c, b):
                    total = 0.0
                    for x, y in zip(a, b, strict=True):
                        total += (x - y) ** 2
                    near.append((total**0.5, c))
            for rank, (score, c) in enumerate(sorted(near)[:k]):
                yield q, rank + 1, c, score


def vectors(seed=4, n=900, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dims))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("per_cell", "block"), [(2048, 4096), (40, 64), (40, 4096)])
def test_nearest(spark, per_cell, block):
    """One cell and many, blocks that cut cells, copies of a hot vector, integer vectors with ties, other lengths."""
    rows = vectors()
    rows += [(2000 + i, rows[5][1]) for i in range(150)] + [(3000 + i, [float(i % 3 + 1), float(i // 3 % 3)]) for i in range(60)]
    rows += [(5000 + i, [float(v) for v in np.eye(7)[i % 7]]) for i in range(30)]
    odd = [(None, [1.0] * 16), (10, None), (20, []), (30, [0.0] * 16), (40, [float("nan")] * 16), (50, [float("inf")] + [0.0] * 15), (60, [None] + [1.0] * 15)]
    taken = [r for r in rows if r[0] not in (10, 20, 30, 40, 50, 60)]
    given = spark.createDataFrame([(i, v, 1, 2) for i, v in taken + odd + taken[:3]], "vec_id long, embedding array<double>, cell int, dims int")
    got = nearest.nearest(given.repartition(5), 10, 5, per_cell, block)
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_nearest(taken, 10, 5))


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    rows = [(0, [1.0, 0.0]), (0, [1.0, 1.0]), (1, [1.0, 0.5])]
    got = nearest.nearest(spark.createDataFrame(rows, schema), k=2).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_nearest(rows, 100, 2))
    huge = [(i, [1e200 * (i + 1), 1.0]) for i in range(4)]
    got = nearest.nearest(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=2)
    assert [(r.rank, r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 1, float("inf")), (2, 2, float("inf"))]


def test_codes_bound_distances():
    """Least plausible distances lie below the true ones, estimates are near them, and the bits alone exclude most rows."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 64)) * rng.uniform(0.5, 2, (4000, 1))
    q = rng.standard_normal((20, 64))
    bits, norm, fit = nearest.encode(x)
    assert bits.shape == (4000, 8)
    about, least = nearest.bounds(bits, norm, fit, q)
    true = nearest._squares(q, x)
    assert (least <= true + 1e-9).mean() > 0.9999
    assert abs(((about - true) / true).mean()) < 0.01
    kth = np.sort(true, axis=1)[:, 10]
    assert (least > kth[:, None]).mean() > 0.5


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    """rows: (doc_id, text)."""
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UP)
            h = zlib.crc32(f"{'' if d is None else d}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, words[w], len(near[w]), form[w], form[w] and words[form[w]], root


def misspelt(seed=3, n=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeé") for _ in range(rng.randrange(6, 10))) for _ in range(60)] + ["aaaaaaaa", "ABEABEabe", "ÀÉÿ÷×ßab"]
    out = []
    for d in range(n):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.2)), len(base) - 1)]
            while rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + "e" + w[i:], w[:i] + "b" + w[i + 1 :]))
            words.append(rng.choice((w, w, w.upper() if w.isascii() else w)))
        out.append((d * 3, rng.choice((" ", "1", "\n", "日")).join(words)))
    chain = " ".join(["qwertyui"] * 200 + ["qwertyux"] * 30 + ["qwzrtyux"] * 5)  # the last leads to the first by way of the second
    return [*out, (7, chain), (1, None), (2, ""), (None, " ".join(["abeabeabb"] * 7)), (4, "x" * 30_000 + " " + "a" * 5)] + [out[0]] * 3


def test_variants(spark):
    rows = misspelt()
    given = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").repartition(4)
    got = spelling.spelling_variants(given).select("word", "n", "n_near", "form", "form_n", "root")
    got, want = Counter(tuple(r) for r in got.collect()), Counter(brute_variants(rows))
    assert got == want
    assert sum(r[3] is not None for r in want) > 20 and any(r[3] != r[5] for r in want if r[3])
    assert spelling.spelling_variants(given.where("false")).count() == 0


@pytest.mark.parametrize("per_key", [8192, 20, 2])
def test_near_pairs_of_hot_halves(spark, per_key):
    """Keys that many words share are split down to one open letter; every pair comes out once."""
    rng = random.Random(per_key)
    words = {"common" + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(120)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) + "ending" for _ in range(60)} | {"a" * i for i in range(6, 14)}
    table = materialize(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long"), "words")
    got = [(r.word, r.near, r.n) for r in spelling.near_pairs(table, per_key, 100).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b, len(b)) for a in words for b in words if one_edit(a, b)}


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({f"{a}{b}ing" for a in ("st", "k", "s", "br") for b in ("r", "")} | {"king", "sting", "stings"})
    made = spelling.Automaton(words)
    assert len(made.edges) < sum(map(len, words)) / 2
    for number, word in enumerate(words):
        found = []
        made._finish(made.start, 0, word, 0, found)
        assert found == [number]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_nearest_neighbours", "op13_spelling_variants"])
def test_registered(spark, docs, tmp_path, name):
    """The registered queries and their SQL over planted tables."""
    folder = str(tmp_path)
    if name == "op13_spelling_variants":
        docs = spark.createDataFrame(misspelt(), "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = [(i, v) for i, v in vectors(n=600)] + [(700, None), (800, vectors(n=9)[8][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.collect()) == Counter(want) and want


def test_sql_of_lone_groups():
    """The SQL's own corner: groups of one row, one group, no group."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    assert con.execute(oracle.MERKLE).fetchall() == []
    rows = [(3, "Ab", None, "s", 2)]
    for extra in ((), ((4, "C", "en", "s", 1),), ((5, "D", "en", "s", 1), (6, "E", "fr", None, None))):
        for r in extra:
            rows.append(r)
        con.execute("DELETE FROM documents")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        assert Counter(con.execute(oracle.MERKLE).fetchall()) == Counter(brute_manifest(rows))
