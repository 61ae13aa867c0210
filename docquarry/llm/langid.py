"""Operator 3: language identification - family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches, tidy

BITS = 12
DIM = 1 << BITS
CHUNK = 1 << 21

# Byte classes: A-Z lower-cased, letters and bytes of longer characters kept, everything else a blank.
_FOLD = np.zeros(256, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Buckets of the byte 2- and 3-grams of one text chunk."""
    b = _FOLD[raw].astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    two = two[(b[:-1] | b[1:]) > 0]
    three = three[(b[:-2] | b[2:]) > 0]
    shift = np.uint32(32 - BITS)
    return np.concatenate(
        [two * np.uint32(2654435761) >> shift, (three + np.uint32(77)) * np.uint32(2246822519) >> shift]
    )


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit length, has a letter) for whole texts; long texts are counted chunk by chunk."""
    out, letter = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
        letter[i] = bool(((raw | 32) - 97 < 26).any()) or any(map(str.isalpha, text))
        if letter[i]:
            for at in range(0, len(raw) - 2, CHUNK):
                out[i] += np.bincount(_grams(raw[at : at + CHUNK + 2]), minlength=DIM)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12), letter


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent; y is +1 or -1; classes weigh alike; the last weight
    is the bias."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    q = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1 + 1 / (2 * c * weight)
    w, bias, alpha, rng = np.zeros(x.shape[1]), 0.0, np.zeros(len(x)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            row = x[i]
            step = max(alpha[i] - (y[i] * (w @ row + bias) - 1 + alpha[i] / (2 * c * weight[i])) / q[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * row
                bias += step * y[i]
    return np.r_[w, bias]


def _sure(margin):
    return 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))


def learn_families(langs: list[str], centres: np.ndarray) -> list[list[str]]:
    """Group ``langs`` by their mean feature vectors: the two families of largest mean cosine between their members are
    joined until about the square root of the number of languages is left. A single language is a family."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    near, groups = unit @ unit.T, [[i] for i in range(len(langs))]
    link = near.copy()  # sums of cosines between groups
    np.fill_diagonal(link, -np.inf)
    while len(groups) > max(1, round(len(langs) ** 0.5)):
        sizes = np.array([len(g) for g in groups])
        i, j = sorted(divmod(int((link / np.outer(sizes, sizes)).argmax()), len(groups)))
        groups[i] += groups.pop(j)
        link[i] += link[j]
        link[:, i] += link[:, j]
        link = np.delete(np.delete(link, j, 0), j, 1)
        link[i, i] = -np.inf
    return sorted(sorted(langs[i] for i in g) for g in groups)


@dataclass
class LanguageModel:
    """Families, a one-versus-rest machine for each family and a machine for each pair of languages within one."""

    families: list[list[str]] = field(default_factory=list)
    roots: np.ndarray | None = None
    pairs: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray, most: int | None = None) -> LanguageModel:
        names = sorted(set(langs.tolist()))
        model = cls(learn_families(names, np.array([x[langs == name].mean(axis=0) for name in names])))
        machines = len(model.families) + sum(len(f) * (len(f) - 1) // 2 for f in model.families)
        if most is not None and machines > most:
            raise ValueError(f"the weights of {machines} machines pass the bound of {most}")
        if len(model.families) > 1:
            model.roots = np.array([fit_svm(x, np.where(np.isin(langs, f), 1.0, -1.0)) for f in model.families])
        for f in model.families:
            for i, a in enumerate(f):
                for b in f[i + 1 :]:
                    rows = (langs == a) | (langs == b)
                    model.pairs[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))
        return model

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and score (product of the certainty of the family and of the closest pair) of whole texts."""
        x, letter = features(texts)
        if not self.families or not len(texts):
            return ["und"] * len(texts), [0.0] * len(texts)
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if self.roots is None:
            family, sure = np.zeros(len(x), int), np.ones(len(x))
        else:
            margins = x @ self.roots.T
            family = margins.argmax(axis=1)
            sure = _sure(margins.max(axis=1))
        out, score = np.full(len(x), "und", dtype=object), np.zeros(len(x))
        for k, langs in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if not len(rows):
                continue
            votes, worst = np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for (a, b), w in self.pairs.items():
                if a in langs:
                    m = x[rows] @ w
                    for lang, side in ((a, m), (b, -m)):
                        j = langs.index(lang)
                        votes[:, j] += (side > 0) + 0.25 * np.tanh(side) / len(langs)
                        worst[:, j] = np.minimum(worst[:, j], side)
            best = votes.argmax(axis=1)
            out[rows] = np.array(langs, dtype=object)[best]
            low = worst[np.arange(len(rows)), best]
            score[rows] = sure[rows] * np.where(np.isinf(low), 1.0, _sure(np.where(np.isinf(low), 0, low)))
        out[~letter], score[~letter] = "und", 0.0
        return out.tolist(), np.clip(score, 0, 1).tolist()


def train(
    docs: DataFrame,
    learnable: Column,
    per_language: int = 1000,
    max_rows: int = 20_000,
    max_model_mb: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Fit on a bounded sample of the rows that ``learnable`` marks and whose text and label are not null: of each label
    the ``per_language`` rows of smallest hash, fewer where all labels together would pass ``max_rows``. The bound is on
    rows, so repeated rows and ids and null ids cannot exceed it. Every label is learned, at least one row of it;
    ValueError if the weights of all machines would take more than ``max_model_mb``. Features are computed on the
    executors; the driver gets the non-zero buckets of the sample, at most ``max_rows`` * DIM floats.
    Ties in the hash are broken by id; equal rows are alike."""
    rows = docs.where(learnable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    )
    most = (max_model_mb << 20) // ((DIM + 1) * 8)  # machines, at least as many as languages
    rows = rows.withColumn("_mark", F.pmod(F.xxhash64("_id", "_text", F.lit(11)), F.lit(1 << 30)))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_mark").alias("least")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"the weights of all languages take more than {max_model_mb} MB")
    if not counts:
        return LanguageModel()
    each = max(1, min(per_language, max_rows // len(counts)))
    # about twice the rows wanted
    edges = [(lang, max(least, int(min(1.0, 2 * each / n) * (1 << 30)))) for lang, n, least in counts]
    edge = docs.sparkSession.createDataFrame(edges, "_lang string, _edge long")
    near = rows.join(F.broadcast(edge), "_lang").where("_mark <= _edge")
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_mark", "_id"))
    drawn = near.withColumn("_n", first).where(F.col("_n") <= each)

    @arrow_udf("struct<at:array<short>,value:array<float>>")
    def sparse(texts: pa.Array) -> pa.Array:
        at, values = [], []
        for start in range(0, len(texts), 128):
            x, _ = features(texts[start : start + 128].to_pylist())
            at += [np.flatnonzero(r).astype(np.int16) for r in x]
            values += [r[i].astype(np.float32) for r, i in zip(x, at[start:], strict=True)]
        tidy()
        return pa.StructArray.from_arrays(
            [pa.array(at, pa.list_(pa.int16())), pa.array(values, pa.list_(pa.float32()))], names=["at", "value"]
        )

    got = drawn.select("_n", "_lang", sparse("_text").alias("f")).orderBy("_lang", "_n").toArrow()
    x = np.zeros((got.num_rows, DIM), np.float32)
    for i, f in enumerate(got["f"].to_pylist()):
        x[i, f["at"]] = f["value"]
    used = x.any(axis=1)
    langs = np.array(got["_lang"].to_pylist(), dtype=object)
    return LanguageModel.fit(x[used], langs[used], most) if used.any() else LanguageModel()


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` (lang_pred, score) from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned (empty table, no
    labels). Equal texts get equal answers, so do repeated rows; of languages with equal votes the first by name is
    taken. All columns of ``docs`` stay, save one already named ``out``; an empty table gives no rows. The model (at
    most the bytes that ``train`` allows) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), 128):
            lang, score = shared.value.predict(texts[at : at + 128].to_pylist())
            langs += lang
            scores += score
        tidy(every=0.5)
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
        )

    small_batches(docs.sparkSession)
    return docs.withColumn(out, predict(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
