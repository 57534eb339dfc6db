"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

Level k names every stretch of 2^k words: equal stretches of a document have equal names, made of the names of the two
halves. How far two places agree is then read by going down the levels. A run of period q has a block of words, whose
size goes by q, that begins on a grid of that size and is repeated q words on; each such block is extended both ways.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

# Fixed values of the task: the least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words worked on at once: short documents share the work of a call, a longer one is taken alone.
BATCH_WORDS = 1 << 17
#: Blocks of 2^FIRST words are the smallest that a grid needs: a run repeats at least 16 words.
FIRST = 3

SCHEMA = [("doc_id", "long"), ("n_words", "long"), ("starts", "array<long>"), ("lengths", "array<long>"), ("periods", "array<long>"), ("collapsed", "string")]


class Names:
    """Names of all stretches of 2^k words of some documents, one after the other. Words of different documents have
    different names, so no stretch equals one that reaches over a document's end."""

    def __init__(self, words: np.ndarray):
        self.n = words.size
        self.levels = [np.append(words, self.n).astype(np.int64)]

    def add(self) -> bool:
        """One more level; False if no two of its stretches are equal, so that it is of no use."""
        last, half = self.levels[-1], 1 << (len(self.levels) - 1)
        inside = max(0, self.n - 2 * half + 1)
        if not inside:
            return False
        found, names = np.unique(last[:inside] * (self.n + 1) + last[half : half + inside], return_inverse=True)
        if found.size == inside:
            return False
        rest = np.arange(inside, self.n + 1)  # stretches beyond the end equal nothing
        self.levels.append(np.concatenate([names, rest]))
        return True

    def repeated(self) -> np.ndarray:
        """Where the highest level's name occurs more than once."""
        return np.bincount(self.levels[-1])[self.levels[-1][: self.n]] > 1

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are the same (a < b)."""
        done = np.zeros(a.size, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            done += (names[a + done] == names[b + done]).astype(np.int64) << k
        return done

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b are the same (a < b)."""
        done = np.zeros(a.size, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            names = self.levels[k]
            x, y = a - done - (1 << k), b - done - (1 << k)
            done += ((x >= 0) & (names[np.maximum(x, 0)] == names[np.maximum(y, 0)])).astype(np.int64) << k
        return done


def word_names(words: list, base: int = 0) -> np.ndarray:
    """A number for each word, from `base` on: that of the place where it stands first."""
    first: dict = {}
    return np.fromiter(map(first.setdefault, words, count(base)), np.int64, len(words))


def grid(q: int) -> int:
    """The level of the largest blocks of which every run of period q holds one that begins on their grid and whose words
    all have a repetition q words on: the run repeats at least 2 q and 24 - q words."""
    return (max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) + 1).bit_length() - 2


def periodic_runs(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (among all words), lengths and periods of all runs of documents of `sizes` words, the longest first."""
    names, starts = Names(words), np.concatenate([[0], np.cumsum(sizes)])
    none = (np.empty(0, np.int64),) * 3
    while len(names.levels) <= FIRST:
        if not names.add():
            return none
    again = np.add.reduceat(names.repeated().astype(np.int64), starts[:-1]) if sizes.size else np.empty(0, np.int64)
    kept = np.flatnonzero(again)  # documents without a repeated block of the smallest size have no run
    if kept.size < sizes.size:
        if not kept.size:
            return none
        found = periodic_runs(sizes[kept], word_subset(words, starts, kept))
        inner = np.concatenate([[0], np.cumsum(sizes[kept])])
        doc = np.searchsorted(inner, found[0], "right") - 1
        return found[0] - inner[doc] + starts[kept[doc]], found[1], found[2]
    while names.add():
        pass
    where, period = [], []
    reach = names.n
    for q in range(1, int(sizes[0]) // LEAST_PERIODS + 1):
        while sizes[reach_doc(starts, reach)] < LEAST_PERIODS * q:  # documents too short for this period, at the end
            reach = int(starts[reach_doc(starts, reach)])
        k = grid(q)
        if k >= len(names.levels):
            break  # no stretch of such a length is repeated, nor any longer one
        step, level = 1 << k, names.levels[k]
        same = level[0 : reach - q : step] == level[q:reach:step]
        if same.any():
            at = np.flatnonzero(same)
            at = at[np.concatenate([[True], np.diff(at) > 1])]  # neighbouring blocks belong to one run
            where.append(at * step)
            period.append(np.full(at.size, q, np.int64))
    if not where:
        return none
    a, q = np.concatenate(where), np.concatenate(period)
    back = names.behind(a, a + q)
    begin, length = a - back, back + names.ahead(a, a + q) + q
    kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    begin, length, q = begin[kept], length[kept], q[kept]
    order = np.lexsort((q, length, begin))
    begin, length, q = begin[order], length[order], q[order]
    # The same stretch with a longer period is the run of its smallest one.
    new = np.concatenate([[True], (np.diff(begin) != 0) | (np.diff(length) != 0)]) if begin.size else np.empty(0, bool)
    begin, length, q = begin[new], length[new], q[new]
    order = np.lexsort((q, begin))
    return begin[order], length[order], q[order]


def reach_doc(starts: np.ndarray, end: int) -> int:
    """The document that ends at word `end`."""
    return int(np.searchsorted(starts, end, "left")) - 1


def word_subset(words: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The words of the documents `kept`, named anew by their places."""
    part = np.concatenate([words[starts[i] : starts[i + 1]] for i in kept])
    first = np.full(words.size + 1, -1, np.int64)
    first[part[::-1]] = np.arange(part.size)[::-1]
    return first[part]


def collapse(words: list, starts, lengths, periods) -> str:
    """The words, joined by single spaces, without what any run holds after its first period."""
    if not len(starts):
        return b" ".join(words).decode()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]).decode()


def repeat_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of words, starts, lengths and periods of its runs by start, then period, and the text
    with each run collapsed to its first period, words joined by single spaces.

    Words are divided by ASCII white space. A null or empty text has no words; equal rows have equal results; an empty
    table gives none; time goes by n log^2 n for n words, memory by 8 n log n bytes of the longest text with repetitions.
    """
    def rows(batch):
        texts = [(t or "").encode().split() for t in batch["t"]]
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        runs: dict[int, tuple] = {}
        at = 0
        while at < len(order) and texts[order[at]]:
            held, total = [], 0
            while at < len(order) and texts[order[at]] and (not held or total + len(texts[order[at]]) <= BATCH_WORDS):
                held.append(order[at])
                total += len(texts[order[at]])
                at += 1
            sizes = np.array([len(texts[i]) for i in held])
            if sizes[0] < LEAST_WORDS:
                break
            starts = np.concatenate([[0], np.cumsum(sizes)])
            found = periodic_runs(sizes, np.concatenate([word_names(texts[i], base) for i, base in zip(held, starts.tolist())]))
            edges = np.searchsorted(found[0], starts)
            for j, i in enumerate(held):
                part = slice(edges[j], edges[j + 1])
                runs[i] = found[0][part] - starts[j], found[1][part], found[2][part]
        none = (np.empty(0, np.int64),) * 3
        every = [runs.get(i, none) for i in range(len(texts))]
        return {"doc_id": batch["k"], "n_words": list(map(len, texts)), **{name: [x[j].tolist() for x in every] for j, name in enumerate(("starts", "lengths", "periods"))}, "collapsed": [collapse(t, *x) for t, x in zip(texts, every)]}

    return map_columns(df, [df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t")], rows, SCHEMA)


def with_planted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): one document in ten, chosen by the checksum of its id, repeats a stretch of its words to its end.

    The others' texts stay as they are. A null id has no checksum, so its text stays too.
    """
    h = F.crc32(df[id_col].cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(df[text_col].cast("string"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), (h % 10 == 0).alias("_edit"), F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    n = F.when(F.size("_words") > 0, F.size("_words"))
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (LEAST_PERIODS + F.col("_g") % 8))
    edited = F.array_join(F.transform("_words", lambda w, i: F.when(i < a, w).otherwise(F.get("_words", (a + (i - a) % p).cast("int")))), " ")
    return rows.select("doc_id", F.when(F.col("_edit") & n.isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """`repeat_runs` told in numbers: how many runs, that of greatest length / period, and digests of runs and text."""
    runs = F.arrays_zip("starts", "lengths", "periods")
    listed = F.array_join(F.transform(runs, lambda r: F.concat(r["starts"], F.lit(","), r["lengths"], F.lit(","), r["periods"], F.lit("\n"))), "")

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["lengths"] * best["periods"] > best["lengths"] * r["periods"]), r).otherwise(best)  # exact

    nothing = F.lit(None).cast("struct<starts:bigint,lengths:bigint,periods:bigint>")
    rows = found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), F.aggregate(runs, nothing, better).alias("_best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", F.col("_best.starts").alias("start"), F.col("_best.lengths").alias("length"), F.col("_best.periods").alias("period"),
                       F.floor(1000 * F.col("_best.lengths") / F.col("_best.periods")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
