"""Spelling variant groups: words one edit apart, found by Aho-Corasick automata that hold both halves of every word.

One edit leaves one half of the longer word whole: the left half at the start of the other word, the right half at its
end. Words are dealt to shards by the first three letters of each half; a word is scanned by the automata of the shards
that its own halves can name, a match is kept by its place and by the lengths, and the rest is compared. Where many words
share a half, their other halves go into an automaton of their own, so no list of them is compared one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import ne

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, ddl, forget, partitions, stored

# Fixed values of the task: what a word is, and how much commoner its form must be.
LETTERS, LEAST_LETTERS, LEAST_COUNT, TIMES = "a-zÀ-ÿ", 6, 5, 5
#: One run in so many loses a letter, chosen by checksum.
CUT = 199
#: Letters of a half that choose its shard; a half has at least as many.
GRAM = 3
#: Halves of an automaton. A commoner beginning of halves is cut into several, whose texts are scanned by each.
SHARD_HALVES = 50_000
#: Words that share a half above which their other halves are searched by an automaton, not one by one.
FEW = 32
#: Distinct words that a task holds before it hands their counts on.
HELD = 300_000


def one_edit(longer: str, other: str) -> bool:
    """Whether `other`, as long or one shorter, comes from `longer` by replacing or deleting exactly one code point."""
    if len(longer) == len(other):
        return sum(map(ne, longer, other)) == 1
    at = next((k for k, (a, b) in enumerate(zip(longer, other)) if a != b), len(other))
    return longer[at + 1 :] == other[at:]


class Halves:
    """The given words' halves in one automaton. `find` gives the positions of the words of which a text is one edit away,
    each once, if it is as long or one shorter."""

    def __init__(self, words: list[str], sides: list[tuple[bool, bool]] | None = None):
        self.words, self.single = words, []
        entries: dict[str, tuple[dict, dict]] = {}
        for i, word in enumerate(words):
            m = len(word) // 2
            if not m:
                self.single.append(i)
                continue
            for side, half in enumerate((word[:m], word[m:])):
                if sides is None or sides[i][side]:
                    entries.setdefault(half, ({}, {}))[side].setdefault(len(word), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for half, both in entries.items():
            self.automaton.add_word(half, (half, tuple({size: self._node(of, side) for size, of in lists.items()} for side, lists in enumerate(both))))
        self.automaton.make_automaton()

    def _node(self, of: list[int], side: int) -> tuple:
        rests = [self.words[i][: len(self.words[i]) // 2] if side else self.words[i][len(self.words[i]) // 2 :] for i in of]
        return of, rests, Halves(rests) if len(of) > FEW else None

    @staticmethod
    def _hits(node: tuple, rest: str) -> Iterable[int]:
        of, rests, deeper = node
        if deeper is not None:
            return [of[j] for j in deeper.find(rest)]
        return [i for i, part in zip(of, rests) if one_edit(part, rest)]

    def find(self, text: str) -> Iterator[int]:
        n = len(text)
        if n < 2:
            yield from (i for i in self.single if self.words[i] != text)
        if not len(self.automaton):
            return
        for end, (half, (left, right)) in self.automaton.iter(text):
            start = end + 1 - len(half)
            if start == 0:
                for size in (n, n + 1):
                    if size in left:
                        yield from self._hits(left[size], text[end + 1 :])
            if end == n - 1:
                for size in (n, n + 1):
                    if size in right:  # what the left half finds is left to it
                        yield from (i for i in self._hits(right[size], text[:start]) if not text.startswith(self.words[i][: size // 2]))


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, after the cuts, with their occurrences. Tasks count before anything is shuffled."""
    long_runs = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")
    schema = [("word", "string"), ("n", "long")]
    bounded_batches(df.sparkSession)
    out = arrow_schema(schema)

    def flushed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=out)

    def run(batches):
        total = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(long_runs.findall((text or "").encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % CUT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield flushed(total)
                    total.clear()
        yield flushed(total)

    counted = df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, ddl(schema))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame, shard_halves: int = SHARD_HALVES) -> DataFrame:
    """(word, n_near, form_n, form): of each word of `words` (word, n; distinct) with near words, their number and the
    commonest of them, of equally common ones the smallest."""
    spark = words.sparkSession
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    gram = lambda at: F.substring("word", at, F.lit(GRAM))
    first = F.lit(1)
    held = F.array(*[F.struct(gram(at).alias("gram"), F.lit(side).alias("role")) for side, at in enumerate((first, half + 1))])
    # A right half as long as that of a word of the same or one more letter begins at one of two places.
    asked = F.transform(F.array_distinct(F.array(gram(first), gram(half + 1), gram(size - F.floor((size + 2) / 2).cast("int") + 1))), lambda g: F.struct(g.alias("gram"), F.lit(2).alias("role")))
    rows = words.select("word", "n", F.explode(F.concat(held, asked)).alias("_e")).select("word", "n", "_e.*")
    # At most two halves a word, so no more beginnings than 2 * words / shard_halves are above the bound.
    hot = rows.groupBy("gram").agg(F.count_if(F.col("role") < 2).alias("_halves"), F.count_if(F.col("role") == 2).alias("_texts")).where(F.col("_halves") > shard_halves)
    hot = hot.select("gram", F.ceil(F.col("_halves") / shard_halves).alias("_parts"), F.ceil(F.col("_texts") / shard_halves).alias("_blocks"))
    shards = max(partitions(spark), 2 * words.count() // shard_halves + 1)
    rows = rows.join(F.broadcast(hot), "gram", "left")
    everywhere = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine = lambda n, salt: F.array(F.pmod(F.xxhash64("word", F.lit(salt)), n))
    text, cool = F.col("role") == 2, F.col("_parts").isNull()
    none = F.array(F.lit(-1).cast("long"))
    rows = rows.select("word", "n", "role", F.when(cool, F.pmod(F.xxhash64("gram"), F.lit(shards))).otherwise(F.xxhash64("gram")).alias("_shard"), cool.alias("_cool"),
                       F.explode(F.when(cool, none).when(text, everywhere(F.col("_parts"))).otherwise(mine(F.col("_parts"), 1))).alias("_part"), "_blocks")
    rows = rows.select("word", "n", "role", "_shard", "_cool", "_part", F.explode(F.when(F.col("_cool"), none).when(text, mine(F.col("_blocks"), 2)).otherwise(everywhere(F.col("_blocks")))).alias("_block"))
    key = ["_shard", "_cool", "_part", "_block"]
    rows = rows.repartition(partitions(spark), *key).sortWithinPartitions(*key, "word", "role")
    schema = [("word", "string"), ("n_near", "long"), ("form_n", "long"), ("form", "string")]
    out = arrow_schema(schema)
    bounded_batches(spark, 10_000)

    def shard(members: Iterable[tuple]) -> dict[str, list]:
        words, counts, sides, texts = [], [], [], []
        for word, group in groupby(members, key=lambda x: x[0]):
            group = list(group)
            roles = {x[2] for x in group}
            if roles & {0, 1}:
                words.append(word)
                counts.append(group[0][1])
                sides.append((0 in roles, 1 in roles))
            if 2 in roles:
                texts.append((word, group[0][1]))
        found: dict[str, list] = {}

        def link(word, near, n):
            best = found.setdefault(word, [0, 0, ""])
            best[0] += 1
            if n > best[1] or n == best[1] and near < best[2]:
                best[1:] = n, near

        halves = Halves(words, sides)
        for text, n in texts if words else ():
            for i in halves.find(text):
                link(text, words[i], counts[i])
                if len(words[i]) > len(text):  # the longer word is no edit of the shorter one here, so both are told
                    link(words[i], text, n)
        return found

    def run(batches):
        members = (x for b in batches for x in zip(*(b.column(i).to_pylist() for i in (0, 1, 2)), zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6)))))
        for _, group in groupby(members, key=lambda x: x[3]):
            found = shard(group)
            if found:
                yield pa.RecordBatch.from_pydict({"word": list(found), **{name: [x[i] for x in found.values()] for i, name in enumerate(("n_near", "form_n", "form"))}}, schema=out)

    links = rows.select("word", "n", "role", *key).mapInArrow(run, ddl(schema))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("_best")
    return links.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("_best.n")).alias("form_n"), "_best.form")


def with_roots(forms: DataFrame) -> DataFrame:
    """`forms` (word, form, ...) with `root`: the last word reached by following forms, or the word itself.

    Ways are doubled in every round. A form is several times commoner than its word, so there is no circle and few rounds.
    """
    ways = stored(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("_word"), F.col("root").alias("_on"))
        step = stored(ways.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            forget(step)
            break
        forget(ways)
        ways = step.drop("_moved")
        ways._stored_at = step._stored_at
    out = forms.join(ways.select("word", "root"), "word", "left")
    return out.withColumn("root", F.coalesce("root", "word"))


def variant_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_halves: int = SHARD_HALVES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of at least six letters that occurs at least five times.

    A word's form is the commonest word one edit away (of equally common ones the smallest), if it is at least five times
    as common; the root is where following forms ends. Null and empty texts have no words; a null id counts as an empty
    one in the checksums that choose cuts; repeated rows are counted again; an empty table gives none; a run of letters of
    any length is one word. Columns other than the two named are not looked at.
    """
    words = stored(word_counts(df, id_col, text_col))
    forms = words.join(near_words(words, shard_halves), "word", "left")
    wins = F.col("form_n") >= TIMES * F.col("n")
    forms = stored(forms.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(wins, F.col("form")).alias("form"), F.when(wins, F.col("form_n")).alias("form_n")))
    forget(words)
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
