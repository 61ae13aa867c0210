"""Operator 13: spelling variants of a vocabulary, found with forward and backward minimal acyclic automata."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, pieces

#: Fixed by contract: the letters of a run, and the share of (document, run) pairs that lose a letter.
LETTER, DAMAGED = r"[A-Za-zÀ-ÿ]", 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
NEAR = "word string, near string, n long"


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words, built word by word; each word's number is its place in that
    order. An edge holds its target and how many words come before those behind it, so numbers are sums along a path."""

    def __init__(self, words: Iterable[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._count: list[int] = []
        self._known: dict[tuple, int] = {}
        open_: list[list] = [[False, []]]  # states of the last word's path: final, [(letter, target)]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._freeze(open_, same, last)
            open_.extend([False, []] for _ in word[same:])
            open_[-1][0] = True
            last = word
        self._freeze(open_, 0, last)
        self.start = self._state(*open_[0])
        del self._known, self._count

    def _freeze(self, open_: list[list], keep: int, word: str) -> None:
        while len(open_) > keep + 1:
            state = self._state(*open_.pop())
            open_[-1][1].append((word[len(open_) - 1], state))

    def _state(self, final: bool, targets: list[tuple[str, int]]) -> int:
        key = (final, *targets)
        found = self._known.get(key)
        if found is None:
            number, edges = int(final), {}
            for letter, target in targets:
                edges[letter] = target, number
                number += self._count[target]
            found = self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self._count.append(number)
        return found

    def one_error(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that begin as ``word`` does up to ``exact`` and have one letter inserted, deleted or replaced
        behind that. Each once: a letter is put in only before another one, and only the last of equal ones is left out."""
        edges, state, number = self.edges, self.start, 0
        for letter in word[:exact]:
            step = edges[state].get(letter)
            if step is None:
                return []
            state, number = step[0], number + step[1]
        found, end = [], len(word)
        for i in range(exact, end + 1):
            own = word[i] if i < end else ""
            if own and word[i + 1 : i + 2] != own:
                self._finish(state, number, word, i + 1, found)
            for letter, (target, before) in edges[state].items():
                if letter != own:
                    if own:
                        self._finish(target, number + before, word, i + 1, found)
                    self._finish(target, number + before, word, i, found)
            step = edges[state].get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found

    def _finish(self, state: int, number: int, word: str, at: int, found: list[int]) -> None:
        edges = self.edges
        for letter in word[at:]:
            step = edges[state].get(letter)
            if step is None:
                return
            state, number = step[0], number + step[1]
        if self.final[state]:
            found.append(number)


def near_words(rows: pa.Table) -> pa.Table:
    """(word, near word, its n) for the asked rows of one bucket (word, n, m, s, e, asked)."""
    names, counts = rows["word"].to_pylist(), rows["n"].to_pylist()
    n_of = dict(zip(names, counts, strict=True))
    forward, backward = sorted(n_of), sorted(w[::-1] for w in n_of)
    ahead, back = Automaton(forward), Automaton(backward)
    words, near = [], []
    s, e, asked = (rows[c].to_pylist() for c in ("s", "e", "asked"))
    for word, a, b, own in zip(names, s, e, asked, strict=True):
        if not own:
            continue
        head, tail, before = word[:a], word[b:], word[:b]
        if a >= len(tail):
            found = [forward[i] for i in ahead.one_error(word, a)]
        else:
            found = [backward[i][::-1] for i in back.one_error(word[::-1], len(tail))]
        for other in found:
            if other[:a] == head and other.endswith(tail) and not (tail and other[:b] == before):
                words.append(word)
                near.append(other)
    return pa.table(
        {
            "word": pa.array(words, pa.string()),
            "near": pa.array(near, pa.string()),
            "n": pa.array([n_of[w] for w in near], pa.int64()),
        }
    )


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lower-cased, of at least LEAST_LENGTH letters and
    LEAST_COUNT occurrences. With ``damaged``, a run loses the letter h % length where that divides h, the crc32 of
    ``<id>:<run>`` (a null id counts as empty). Runs are counted in every task before they are shuffled."""
    # a run of six or more letters is found whole, since none of its letters can be left out at its front
    found = F.regexp_extract_all(F.col(text_col), F.lit(LETTER + "{%d,}" % LEAST_LENGTH), F.lit(0))
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(found).alias("run"))
    word: Column = lower_ascii(F.col("run"))
    runs = runs.select("_id", word.alias("word"))
    if damaged:
        h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(h % damaged == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """The key that a query of ``m`` letters with its error in [s, e) shares with all its near words: its letters before s
    and from e on."""
    parts = [F.col(c).cast("string") for c in "mse"]
    head = F.substring("word", F.lit(1), F.col("s"))
    tail = F.when(F.col("e") < F.col("m"), F.right("word", F.col("m") - F.col("e"))).otherwise("")
    return rows.withColumn("key", F.concat_ws(":", *parts, head, tail))


def near_pairs(words: DataFrame, per_key: int = 8192, per_bucket: int = 32_768) -> DataFrame:
    """(word, near, n of near) for all pairs of ``words`` (word, n; a written table) one edit apart, both ways round.

    A word of m letters agrees with a near word in its first half or in its second, so both carry that half as a key,
    for each length m - 1, m, m + 1 that may ask. Keys are dealt to buckets of about ``per_bucket`` rows; a bucket
    builds its two automata, matches the half exactly in the forward or the backward one and completes it with one
    error. A pair that agrees in the first half is left to that key, so pairs come out once. Keys of more than
    ``per_key`` rows are split: half of the rest is matched too, on either side, and so on until at most one letter is
    open, where the alphabet bounds a key's rows.
    """
    lengths = F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("m")
    rows = words.select("word", "n", lengths).where(F.col("m") >= LEAST_LENGTH)
    rows = rows.select("*", F.lit(0).alias("s"), F.col("m").alias("e"))
    done, hot = None, rows
    while True:
        middle = F.shiftright(F.col("s") + F.col("e"), 1)
        halves = F.explode(F.array(F.struct(middle.alias("s"), "e"), F.struct("s", middle.alias("e")))).alias("x")
        split = materialize(_keyed(hot.select("word", "n", "m", halves).select("word", "n", "m", "x.s", "x.e")), "halves")
        # a key of one open letter cannot be split, nor need it
        many = split.where("e - s > 1").groupBy("key").count().where(F.col("count") > per_key).select("key")
        many = materialize(many, "hot")
        if many.isEmpty():
            done = split if done is None else done.unionByName(split)
            break
        cold = split.join(many, "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        hot = split.join(many, "key", "left_semi")
    n, size = done.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    buckets = max(pieces(n, per_bucket), pieces(size or 0, per_bucket * 32))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    asked = (F.col("m") == F.length("word")).alias("asked")
    return done.select("word", "n", "m", "s", "e", asked, bucket).groupBy("bucket").applyInArrow(near_words, NEAR)


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``vocabulary``.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that n is at least RATIO
    times its own; its root is where following forms ends. Counts rise fivefold with each step, so labels spread from
    roots to the words whose form they are in a few rounds; in each a word is joined by at most its near words, of
    which the alphabet bounds the number.

    Null and empty texts have no words; rows that repeat an id or a text count as often as they occur; a run of any
    length is one word. An empty table gives no rows; extra columns are ignored.
    """
    words = materialize(vocabulary(docs, id_col, text_col, damaged), "words")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left")
    strong = -F.col("best.less") >= RATIO * F.col("n")
    rows = materialize(
        rows.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, F.col("best.form")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    led = rows.where("form IS NOT NULL").select("word", "form")
    reached = rows.where("form IS NULL").select(F.col("word").alias("form"), F.col("word").alias("root"))
    roots = None
    while True:
        step = materialize(led.join(reached, "form").select("word", "root"), "roots")
        if step.isEmpty():
            break
        roots = step if roots is None else roots.unionByName(step)
        reached = step.select(F.col("word").alias("form"), "root")
    if roots is None:
        return rows.withColumn("root", F.col("word"))
    found = rows.join(roots, "word", "left")
    return found.withColumn("root", F.coalesce("root", "word"))
