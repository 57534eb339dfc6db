"""Near-duplicates by Order MinHash: sketches sensitive to edit similarity, candidates verified by banded alignment.

The k-mers of a document are its runs of five words, each labelled with its occurrence number. A sketch takes the two
smallest under one hash and keeps them in text order; two documents share it only if these agree in content and order.
Documents that share a sketch are candidates, compared word by word in a band; a link is an edit similarity of 0.8 or
more. With a share e of the words changed at random, two sketches agree with probability J * J, J = q / (2 - q),
q = (1 - e) ** 5, so 64 sketches find a pair with 10 % changed with probability 1 - 4e-6, with 15 % 0.995, with 19 %
0.94 and with 20 % 0.92. Texts of up to SHORT words, which have few k-mers, are found without fail. Classes are the
connected components.

How a large group stays linear:

1. Copies (texts of equal words) are collapsed.
2. Each bucket has a medoid, its member that meets most others over all its buckets; members are compared to medoids.
3. Buckets that then still hold several components: in those of up to FEW members all pairs of different components
   are looked at. The members of larger ones, and short texts, are looked up by an exact filter instead: texts with an
   edit similarity of 0.8 have one of their rarest words in common (a fifth of the words is enough; short texts go by
   pairs of words). A rare word has a small bucket, so a passage that many documents share makes no pairs of them. Every pair that shares a
   sketch or is short is thus compared, or ruled out by a bound on its edit distance, whatever the size of a bucket.
   Only texts that mostly consist of passages which very many components share are still compared each with each, by
   blocks of bounded size. Pairs are aligned where their bucket is; what comes out is links of a forest, fewer than its
   members.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import groupby
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, bounded_batches, ddl, forget, map_columns, partitions, stored

WORDS, SKETCHES, MINIMA, SIMILAR = 5, 64, 2, 0.8
#: Texts of up to so many words are found without fail; members of a bucket whose pairs are all looked at; members of a
#: block; bins of the word counts; buckets of a text in which it is told whether a pair met before. The last four don't
#: change the classes but for links that no sketch stands for.
SHORT, FEW, BLOCK, BINS, FIRST = 64, 256, 1024, 1024, 64
#: Pairs that are aligned together; words and pairs of a group beyond which its members are cut into pieces.
ALIGNED, MOST_WORDS, MOST_PAIRS = 256, 1 << 22, 1 << 12
#: Ids broadcast to the documents at most (12 MB); more are joined by key.
BROADCAST_IDS = 1_000_000
NO_ID = -(1 << 63)

_rng = np.random.default_rng(7)
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # upper case counts as lower
SEEDS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GAP = np.ones(256, bool)
GAP[33:] = False
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes above the space), the same on every machine."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not raw.size:
        return np.zeros(0, np.uint64)
    inside = ~GAP[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not starts.size:
        return np.zeros(0, np.uint64)
    at = np.arange(raw.size) - np.repeat(starts, np.diff(np.r_[starts, raw.size])) if starts[0] == 0 else np.arange(raw.size) - np.r_[np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.r_[starts, raw.size]))]
    longest = int((ends - starts).max())
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, ODD)])
        value = np.where(inside, BYTE[raw] * powers[np.minimum(at, longest)], np.uint64(0))
        return mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of `k` words with their occurrence number; fewer words are one run."""
    if not words.size:
        return words
    n = max(1, words.size - k + 1)
    with np.errstate(over="ignore"):
        h = mixed(sum(words[i : i + n] * PLACE[i] for i in range(min(k, words.size))))
        order = np.sort(h)
        again = order[1:][order[1:] == order[:-1]]
        if again.size:
            rows = np.flatnonzero(np.isin(h, again))
            by = rows[np.argsort(h[rows], kind="stable")]
            new = np.r_[True, h[by][1:] != h[by][:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(by.size), 0))
            h[by] = mixed(h[by] + (np.arange(by.size) - first).astype(np.uint64) * ODD)
    return h


def sketch(words: np.ndarray, width: int = WORDS, minima: int = MINIMA) -> list[int]:
    """SKETCHES keys of a document, each of the `minima` smallest hashes of its runs of `width` words."""
    h = kmers(words, width)
    if not h.size:
        return [0] * SKETCHES
    with np.errstate(over="ignore"):
        k = min(minima, h.size)
        if h.size == k:
            at = np.tile(np.arange(k), (SKETCHES, 1))
        elif h.size < 1 << 16:
            at = np.argpartition(mixed(h[None, :] ^ SEEDS[:, None]), k - 1, axis=1)[:, :k]
        else:  # one hash at a time, for a long text
            at = np.array([np.argpartition(mixed(h ^ seed), k - 1)[:k] for seed in SEEDS])
        at.sort(axis=1)
        keys = mixed((h[at] * PLACE[:k]).sum(axis=1, dtype=np.uint64) + SEEDS)
    return keys.view(np.int64).tolist()


def digest(words: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(words.tobytes(), digest_size=16).digest(), np.int64).tolist())


def identified(df: DataFrame, id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("t")]


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, c1, c2, n, keys): c1 and c2 are a digest of the words, so copies agree in them; n counts the words."""
    def rows(batch):
        out = {"id": batch["id"], "c1": [], "c2": [], "n": [], "keys": []}
        for text in batch["t"]:
            words = word_hashes(text)
            for name, value in zip(("c1", "c2", "n", "keys"), (*digest(words), words.size, sorted(set(sketch(words))))):
                out[name].append(value)
        return out

    return map_columns(df, identified(df, id_col, text_col), rows, [("id", "long"), ("c1", "long"), ("c2", "long"), ("n", "long"), ("keys", "array<long>")])


def counted(words: np.ndarray) -> np.ndarray:
    """How many words fall in each of BINS bins, up to 255; differences of these are differences of the texts at least."""
    return np.minimum(np.bincount(words % BINS, minlength=BINS), 255).astype(np.uint8)


def word_table(df: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(id, n, words, bins) of the documents with the `ids`; words are their hashes as 32-bit numbers."""
    def rows(batch):
        words = [(word_hashes(t) >> np.uint64(32)).astype(np.uint32) for t in batch["t"]]
        return {"id": batch["id"], "n": [w.size for w in words], "words": [w.tobytes() for w in words], "bins": [counted(w).tobytes() for w in words]}

    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = df.select(*identified(df, id_col, text_col)).join(wanted, "id", "left_semi")
    return map_columns(texts, ["id", "t"], rows, [("id", "long"), ("n", "long"), ("words", "binary"), ("bins", "binary")])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sequences have in common, as often as both have them."""
    va, na = np.unique(a, return_counts=True)
    vb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return int(np.minimum(na[ia], nb[ib]).sum())


def runs_of(a: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return sum(mixed(a[i : a.size - k + 1 + i].astype(np.uint64) * PLACE[i]) for i in range(k))


def anchored(a: np.ndarray, b: np.ndarray) -> int:
    """The edits of one alignment, so no fewer than the distance: words that begin a run of three which stands once in
    either text are matched where their order agrees; gaps of equal length are compared word by word."""
    (ha, ia, na), (hb, ib, nb) = (np.unique(runs_of(x, 3), return_index=True, return_counts=True) for x in (a, b))
    _, x, y = np.intersect1d(ha[na == 1], hb[nb == 1], assume_unique=True, return_indices=True)
    left, right = ia[na == 1][x], ib[nb == 1][y]
    order = np.argsort(left)
    left, right = left[order], right[order]
    ends: list[int] = []
    at, before = [], np.full(left.size, -1)  # the longest sequence of matches whose places rise in both texts
    for i, r in enumerate(right.tolist()):
        k = bisect_left(ends, r)
        before[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(r)
            at.append(i)
        else:
            ends[k], at[k] = r, i
    chain, i = [], at[-1] if at else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    chain = np.array(chain[::-1], np.int64)
    left, right = np.r_[-1, left[chain], a.size], np.r_[-1, right[chain], b.size]
    wide, high = np.diff(left) - 1, np.diff(right) - 1
    same = (wide == high) & (wide > 0)
    cost = np.maximum(wide, high)[~same].sum()
    n = wide[same]
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return int(cost + (a[np.repeat(left[:-1][same] + 1, n) + inner] != b[np.repeat(right[:-1][same] + 1, n) + inner]).sum())


def align(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILAR) -> np.ndarray:
    """Whether each pair of word sequences has an edit similarity of at least `least`.

    1 - distance / longer length. Bounds decide most pairs: the words and pairs of words without a partner from below,
    an alignment by common runs from above. The rest are aligned by dynamic programming in a diagonal band over many
    pairs at once; the band is widened until the distance found fits in it, which makes it exact, or until it exceeds
    what `least` allows.
    """
    out = np.zeros(len(pairs), bool)
    todo: dict[int, tuple] = {}
    for i, (a, b) in enumerate(pairs):
        most = int((1 - least) * max(a.size, b.size) + 1e-9)
        if abs(a.size - b.size) > most:
            continue
        n = min(a.size, b.size)
        differ = np.flatnonzero(a[:n] != b[:n])
        head = int(differ[0]) if differ.size else n
        a, b = a[head:], b[head:]
        n = min(a.size, b.size)
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(differ[0]) if differ.size else n
        a, b = a[: a.size - tail], b[: b.size - tail]
        if not min(a.size, b.size):
            out[i] = max(a.size, b.size) <= most
            continue
        if a.size < b.size:
            a, b = b, a
        if a.size - shared(a, b) > most:  # so many words have no partner at all
            continue
        if a.size > 64 and b.size > 1 and a.size - 1 - shared(runs_of(a, 2), runs_of(b, 2)) > 2 * most:
            continue  # an edit breaks two pairs of words
        if a.size > 256 and b.size > 2 and anchored(a, b) <= most:
            out[i] = True
            continue
        todo[i] = (a, b, most)
    width = 8
    while todo:
        order = sorted(todo, key=lambda i: todo[i][0].size)
        later = {}
        while order:
            some = [order.pop()]
            room = max(1, (1 << 18) // (max(todo[some[0]][0].size, 2 * width + 1)))
            while order and len(some) < min(room, 128):
                some.append(order.pop())
            for i, d in zip(some, banded([todo[i][:2] for i in some], width)):
                most = todo[i][2]
                if d <= min(width, most):
                    out[i] = True
                elif width < most:
                    later[i] = todo[i]
        todo, width = later, width * 4
    return out


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances of pairs, exact where at most `width`; the first sequence of a pair is the longer one."""
    p, n = len(pairs), max(a.size for a, _ in pairs)
    span = 2 * width + 1
    a, b = np.zeros((p, n), np.uint32), np.zeros((p, n + span), np.uint32)
    rows, columns = np.array([x.size for x, _ in pairs]), np.array([y.size for _, y in pairs])
    for i, (x, y) in enumerate(pairs):
        a[i, : x.size], b[i, width : width + y.size] = x, y
    across = np.arange(span, dtype=np.int32)
    far = np.int32(1 << 28)
    before = np.where(across >= width, across - width, far).astype(np.int32)[None, :].repeat(p, axis=0)
    found = np.full(p, far, np.int64)
    for r in range(1, n + 1):
        # Cell c of row r is column r + c - width of the table.
        step = before + (b[:, r - 1 : r - 1 + span] != a[:, r - 1 : r])
        step[:, :-1] = np.minimum(step[:, :-1], before[:, 1:] + 1)
        outside = r + across - width
        step[:, outside < 0] = far
        if r <= width:
            step[:, width - r] = r
        before = np.minimum.accumulate(step - across, axis=1) + across
        done = np.flatnonzero(rows == r)
        if done.size:
            at = columns[done] - r + width
            fits = (at >= 0) & (at < span)
            found[done[fits]] = before[done[fits], at[fits]]
    return found


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The rows (a, b) of `pairs` that are similar; `words` is a `word_table` with both ids."""
    n = partitions(pairs.sparkSession)  # a given number, since the work is in the alignment, not in the bytes
    left = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    df = left.repartition(n, "b").join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")).repartition(n, "b"), "b")
    bounded_batches(df.sparkSession)
    schema = [("a", "long"), ("b", "long")]

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            ok = align([(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(rows["wa"], rows["wb"])])
            yield pa.RecordBatch.from_pydict({k: [x for x, good in zip(rows[k], ok) if good] for k in "ab"}, schema=arrow_schema(schema))

    return df.select("a", "b", "wa", "wb").mapInArrow(run, ddl(schema))


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the connected component, for each id in `links` (a, b); a stored table.

    Every round takes the smallest root among the neighbours and then the root of that root; the number of rounds
    grows with the logarithm of the longest path. The driver sees one count a round.
    """
    # First each id keeps its link to its lowest neighbour, to which its other lower neighbours are linked instead.
    down = links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct()
    lowest = down.groupBy(F.col("b").alias("_b")).agg(F.min("a").alias("_low"))
    moved = down.join(lowest, F.col("b") == F.col("_b")).select(F.col("_low").alias("a"), F.when(F.col("a") == F.col("_low"), F.col("b")).otherwise(F.col("a")).alias("b"))
    both = stored(moved.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    roots = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("root"), F.lit(True).alias("moved")))
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A root that is itself an id with a lower root is followed at once.
        jump = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        root = F.least("root", F.coalesce("next", "root"))
        lower = stored(lower.join(jump, "root", "left").select("id", root.alias("root"), (F.col("old") != root).alias("moved")))
        forget(roots)
        roots = lower
        if not roots.where("moved").limit(1).count():
            forget(both)
            return roots


def alike(n: np.ndarray, bins: tuple, i: int, js: np.ndarray) -> np.ndarray:
    """Those of `js` whose lengths and counted words allow the edit similarity with `i`; `bins` are those of `folded`."""
    js = js[np.minimum(n[js], n[i]) >= SIMILAR * np.maximum(n[js], n[i]) - 1e-9]
    for table in bins:
        step = table[js] - table[i]
        more = np.maximum(step, 0).sum(axis=1)
        js = js[np.maximum(more, more - step.sum(axis=1)) <= (1 - SIMILAR) * np.maximum(n[js], n[i]) + 1e-9]
    return js


def folded(bins: np.ndarray) -> tuple:
    """The counts in BINS bins after those in a sixteenth as many, which rule out most pairs and never more."""
    return bins.reshape(len(bins), 16, -1).sum(axis=1, dtype=np.int16), bins.astype(np.int16)


def lower_keys(key: int, keys: tuple) -> np.ndarray:
    """For each member of the bucket `key`, as bits, those of its `keys` below it that another member has too."""
    owner = np.repeat(np.arange(len(keys)), [bisect_left(k, key) for k in keys])
    flat = np.array([x for k in keys for x in k[: bisect_left(k, key)]], np.int64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared_ = np.flatnonzero(count > 1)
    held = np.zeros((len(keys), shared_.size), bool)
    often = count[code] > 1
    held[owner[often], np.searchsorted(shared_, code[often])] = True
    return np.packbits(held, axis=1)


def group_pairs(label: np.ndarray, sides: tuple, n: np.ndarray, bins: tuple, lower: np.ndarray):
    """Yield (i, js): the index pairs of a group that have different labels, are `alike` and meet in no bucket of a lower
    key. A group that differs in one of the `sides` (its blocks, its pieces) has pairs across that side only. Labels that
    change meanwhile count as they are then."""
    sides = [side for side in sides if (side != side[0]).any()]
    for i in range(label.size - 1):
        js = np.arange(i + 1, label.size)
        ok = label[js] != label[i]
        for side in sides:
            ok &= side[js] != side[i]
        js = alike(n, bins, i, js[ok])
        if js.size:
            js = js[~(lower[js] & lower[i]).any(axis=1)]
        if js.size:
            yield i, js


def forest(label: np.ndarray, pairs, words: list[np.ndarray]):
    """Yield those of the `pairs` (i, js) that are links and join two labels, which then become one; so a group has fewer
    links than members."""
    waiting: list[tuple[int, int]] = []

    def aligned():
        apart = [(i, j) for i, j in waiting if label[i] != label[j]]
        waiting.clear()
        for (i, j), good in zip(apart, align([(words[i], words[j]) for i, j in apart])):
            if good and label[i] != label[j]:
                label[label == label[j]] = label[i]
                yield i, j

    for i, js in pairs:
        waiting.extend((i, j) for j in js.tolist())
        if len(waiting) >= ALIGNED:
            yield from aligned()
    yield from aligned()


def blocked(entries: DataFrame) -> DataFrame:
    """The rows of buckets of more than BLOCK members dealt to groups (key, x, y) of two blocks, or of one, in which all
    pairs of different components meet; `part` is a row's block.

    A component with many members in a bucket has blocks of its own, which don't meet each other: one such component
    and a few others make about as many rows as the bucket has members.
    """
    own = F.col("_c") > BLOCK // 2
    rows = entries.withColumn("_c", F.count("*").over(Window.partitionBy("key", "root")))
    rows = rows.withColumn("_rest", F.sum(F.when(own, 0).otherwise(1)).over(Window.partitionBy("key")))
    alone = F.xxhash64("root", F.pmod(F.xxhash64("id"), F.ceil(F.col("_c") / BLOCK)))
    shared_ = F.xxhash64(F.lit("rest"), F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.ceil(F.col("_rest") / BLOCK))))
    rows = rows.select("key", "id", "root", F.when(own, alone).otherwise(shared_).alias("part"), F.when(own, F.col("root")).alias("owner"))
    blocks = rows.select("key", "part", "owner").distinct()
    x, y = (blocks.select("key", F.col("part").alias(n), F.col("owner").alias(f"_{n}")) for n in "xy")
    pairs = x.join(y, "key").where("x <= y AND coalesce(_x <> _y, true)")
    pairs = pairs.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    return rows.drop("owner").join(pairs, ["key", "part"])


def bucket_rows(entries: DataFrame, words: DataFrame) -> DataFrame:
    """The rows of IN_GROUP, dealt by group and sorted. All groups are of bounded size.

    `entries` is (key, id, root, m), m the members of the bucket, a stored table. A row carries its text's FIRST lowest
    keys: a pair that shares one of these is left to that bucket, so texts that meet in many buckets are compared in one.
    """
    zero = F.lit(0).cast("long")
    few = entries.where(f"m <= {BLOCK}").select("key", zero.alias("x"), zero.alias("y"), zero.alias("part"), "id", "root")
    rows = few.union(blocked(entries.where(f"m > {BLOCK}")).select("key", "x", "y", "part", "id", "root"))
    nth = F.dense_rank().over(Window.partitionBy("id").orderBy("key"))
    firsts = F.sort_array(F.collect_set(F.when(F.col("_nth") <= FIRST, F.col("key"))).over(Window.partitionBy("id")))
    rows = rows.withColumn("_nth", nth).withColumn("keys", firsts).join(words.select("id", "n", "bins"), "id")
    rows = rows.repartition(partitions(rows.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    bounded_batches(rows.sparkSession)
    return rows.select(*IN_GROUP)


IN_GROUP = ("key", "x", "y", "part", "id", "root", "n", "bins", "keys")


def groups(batches, names: tuple, by: int):
    """The columns `names` of each group of rows that follow each other and agree in the first `by` of them."""
    def each():
        for batch in batches:
            columns = batch.to_pydict()
            yield from zip(*(columns[k] for k in names))

    for _, group in groupby(each(), lambda r: r[:by]):
        yield tuple(zip(*group))


def candidates(batches):
    """(columns of IN_GROUP, i, j) of each group with pairs that may be similar; i < j are the pairs' places in it."""
    for group in groups(batches, IN_GROUP, 3):
        key, _, _, part, _, root, n, bins, keys = group
        if len(set(root)) < 2:
            continue
        part, root, n = (np.array(v, np.int64) for v in (part, root, n))
        bins = folded(np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS))
        found = list(group_pairs(root, (part,), n, bins, lower_keys(key[0], keys)))
        if found:
            yield group, np.repeat([i for i, _ in found], [js.size for _, js in found]), np.concatenate([js for _, js in found])


def bucket_pairs(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of one bucket in different components, as far as `alike` allows, each once. There may be as
    many as the square of a bucket's size; `bucket_links` tells which of them join what."""
    schema = [("a", "long"), ("b", "long")]

    def run(batches):
        for group, i, j in candidates(batches):
            ids = np.array(group[IN_GROUP.index("id")], np.int64)
            yield pa.RecordBatch.from_pydict({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}, schema=arrow_schema(schema))

    return bucket_rows(entries, words).mapInArrow(run, ddl(schema)).distinct()


def bucket_links(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b): links that join the same components as all similar ones of `bucket_pairs` do.

    Pairs are aligned where their group is and only links of a forest come out, so what is passed on grows with the
    members, whatever pairs they make. First the members that have such a pair at all are told, to which alone the words
    are joined. Where they have over MOST_WORDS words or make over MOST_PAIRS pairs, they are cut into pieces, every two of
    which make a group of their own.
    """
    spark = entries.sparkSession
    names = ("key", "x", "y", "u", "v", "piece", "part", "id", "root", "keys")
    schema = [(name, "array<long>" if name == "keys" else "long") for name in names]
    most_words, most_pairs = MOST_WORDS, MOST_PAIRS

    def members(batches):
        for group, i, j in candidates(batches):
            columns = dict(zip(IN_GROUP, group))
            n = np.array(columns["n"], np.int64)
            some = np.unique(np.concatenate([i, j]))
            total = int(n[some].sum())
            cuts = max(ceil(sqrt(2 * i.size / most_pairs)), ceil(total / most_words))
            piece = np.zeros(n.size, np.int64)
            piece[some] = (np.cumsum(n[some]) - n[some]) * cuts // total
            for u, v in np.unique(np.stack([piece[i], piece[j]], 1), axis=0).tolist():
                here = (piece[i] == u) & (piece[j] == v)
                at = np.unique(np.concatenate([i[here], j[here]])).tolist()
                out = {name: [columns[name][k] for k in at] for name in names if name in columns}
                yield pa.RecordBatch.from_pydict({**out, "u": [u] * len(at), "v": [v] * len(at), "piece": piece[at]}, schema=arrow_schema(schema))

    told = bucket_rows(entries, words).mapInArrow(members, ddl(schema))
    rows = told.join(words.select("id", "words"), "id").select(*names, "words")
    rows = rows.repartition(partitions(spark), *names[:5]).sortWithinPartitions(*names[:5], "id")
    bounded_batches(spark)
    links = [("a", "long"), ("b", "long")]

    def run(batches):
        for key, _, _, _, _, piece, part, ids, root, keys, data in groups(batches, (*names, "words"), 5):
            piece, part, ids = (np.array(v, np.int64) for v in (piece, part, ids))
            texts = [np.frombuffer(x, np.uint32) for x in data]
            label = np.unique(np.array(root, np.int64), return_inverse=True)[1]
            bins = folded(np.stack([counted(w) for w in texts]))
            pairs = group_pairs(label, (part, piece), np.array([w.size for w in texts]), bins, lower_keys(key[0], keys))
            found = list(forest(label, pairs, texts))
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_pydict({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}, schema=arrow_schema(links))

    return rows.mapInArrow(run, ddl(links))


def must_look_up(n: int, width: int) -> int:
    """Of how many of its rarest runs of `width` words a text of n words shares one with every similar text.

    Texts of up to m words with d edits have m - width + 1 - width * d of the longer one's runs in common, and a text
    of n words has n - width + 1, so as many as it need not share, and one more.
    """
    longer = range(n, int(n / SIMILAR + 1e-9) + 1)
    return max(n - m + 1 + width * int((1 - SIMILAR) * m + 1e-9) for m in longer)


def rare_runs(some: DataFrame, words: DataFrame) -> DataFrame:
    """(key, id, root, m): buckets of the ids of `some` (id, root) in which all texts of that edit similarity meet.

    A key is a word, for short texts a pair of words, with its occurrence number. Each text is entered under as many of
    its keys as `must_look_up` says, those first that the fewest components have; keys of one component make no bucket.
    Texts of lengths in between have both kinds, so texts of similar length have one kind in common.
    """
    schema = [("id", "long"), ("root", "long"), ("key", "long"), ("width", "int"), ("take", "int"), ("n", "int")]

    def run(batches):
        for batch in batches:
            for key, root, data in zip(*(batch[k].to_pylist() for k in ("id", "root", "words"))):
                w = np.frombuffer(data, np.uint32).astype(np.uint64)
                for width in ((2,) if w.size <= SHORT else (1, 2) if w.size <= SHORT / SIMILAR + 1e-9 else (1,)):
                    h, take = kmers(w, width), must_look_up(w.size, width)
                    yield pa.RecordBatch.from_pydict({"id": np.full(h.size, key), "root": np.full(h.size, root), "key": h.view(np.int64), "width": np.full(h.size, width, np.int32), "take": np.full(h.size, take, np.int32), "n": np.full(h.size, w.size, np.int32)}, schema=arrow_schema(schema))

    each = words.select("id", "words").join(some, "id").select("id", "root", "words").mapInArrow(run, ddl(schema))
    each = each.withColumn("_nth", F.dense_rank().over(Window.partitionBy("key").orderBy("root")))
    each = each.withColumn("_df", F.max("_nth").over(Window.partitionBy("key")))
    each = each.withColumn("_rank", F.row_number().over(Window.partitionBy("id", "width").orderBy("_df", "key")))
    return split_buckets(each.where("_df > 1 AND _rank <= take").select("key", "id", "root", "n"))


def split_buckets(entries: DataFrame) -> DataFrame:
    """The rows (key, id, root) of the buckets that hold several components, with the bucket's members m.

    A bucket is cut where, by ascending number of words n, the next text is too long to be similar: no two texts across
    such a gap are. The parts are buckets of their own; a part's key comes from the set of its members, so parts of equal
    members have one key.
    """
    by_size = Window.partitionBy("key").orderBy("n")
    gap = F.coalesce(F.lag("n").over(by_size) < SIMILAR * F.col("n") - 1e-9, F.lit(False)).cast("int")
    cut = entries.select("key", "id", "root", "n", gap.alias("_gap")).withColumn("_part", F.sum("_gap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("key", "_part")
    members = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).over(part).alias(f"_set{seed}") for seed in (1, 2)]
    whole = cut.select("id", "root", F.count("*").over(part).alias("m"), F.min("root").over(part).alias("_low"), F.max("root").over(part).alias("_high"), *members)
    return whole.where("_low <> _high").select(F.xxhash64("_set1", "_set2", "m").alias("key"), "id", "root", "m")


def needed_buckets(entries: DataFrame) -> DataFrame:
    """The rows (key, id, root, m) of buckets that have pairs of their own.

    Where all members of a bucket have the same other one as their largest, each of its pairs meets there too, so the
    bucket is left out. A text's largest bucket always stays: it has a member whose largest it is. So a large group whose
    texts meet under many keys is dealt under a few.
    """
    home = F.max_by("key", F.struct("m", "key")).over(Window.partitionBy("id"))
    bucket = Window.partitionBy("key")
    rows = entries.withColumn("_home", home).select("key", "id", "root", "m", F.min("_home").over(bucket).alias("_low"), F.max("_home").over(bucket).alias("_high"))
    return rows.where("_low <> _high OR _low = key").select("key", "id", "root", "m")


def sketch_buckets(copies: DataFrame) -> DataFrame:
    """(key, id, n, m): the members of all buckets of several documents; `copies` is (id, n, keys)."""
    entries = copies.select("id", F.col("n").cast("int").alias("n"), F.explode("keys").alias("key"))
    return entries.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1")


def medoid_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member b of a bucket with the bucket's medoid a, each pair once."""
    rows = members.withColumn("w", F.sum("m").over(Window.partitionBy("id")))
    medoid = F.max_by("id", F.struct("w", F.bitwise_not("id"))).over(Window.partitionBy("key"))
    return rows.select(medoid.alias("a"), F.col("id").alias("b")).where("a <> b").distinct()


def residual_pairs(members: DataFrame, short: DataFrame, roots: DataFrame, words: DataFrame, find=bucket_pairs) -> DataFrame:
    """(a, b), each once: all pairs in different components that share a bucket of `members` or are `short`, but for
    those that a bound rules out. With `bucket_links`, links that join the same components as theirs."""
    def with_root(rows):
        return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))

    split = stored(split_buckets(with_root(members.select("key", "id", "n"))))
    exact = stored(with_root(split.where(f"m > {FEW}").select("id").union(short).distinct()))
    entries = stored(needed_buckets(split.where(f"m <= {FEW}").union(rare_runs(exact, words)).distinct()))
    pairs = stored(find(entries, words))
    forget(split, exact, entries)
    return pairs


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id and class_id, the smallest doc_id among its near-duplicates (itself if none).

    A null text counts as empty, and all texts without words are copies of each other. Rows that repeat an id are one
    document. Null ids form class null. Columns besides these two are not read. A text of any length is aligned in
    time by its length where common runs decide; only pairs near the limit need the band, a fifth of the length wide.
    """
    rows = stored(sketches(df, id_col, text_col))
    copies = rows.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.first("n").alias("n"))
    copies = stored(copies.select(F.col("rep").alias("id"), "keys", "n"))
    of = stored(rows.select("id", "c1", "c2").join(rows.groupBy("c1", "c2").agg(F.min("id").alias("rep")), ["c1", "c2"]).select("id", "rep"))
    forget(rows)
    members = stored(sketch_buckets(copies))
    short = copies.where(F.col("n").between(1, int(SHORT / SIMILAR + 1e-9))).select("id")
    ids = stored(members.select("id").union(short).distinct())
    words = stored(word_table(df, id_col, text_col, ids))
    links = stored(verified(medoid_pairs(members), words))
    roots = components(links)
    more = residual_pairs(members, short, roots.select("id", "root"), words, bucket_links)
    forget(copies, ids, members, words, links)
    # The further links join components, each of which is now its root.
    root_of = roots.select(F.col("id").alias("_id"), "root")
    joined = more.join(root_of.select(F.col("_id").alias("a"), F.col("root").alias("_a")), "a", "left").join(root_of.select(F.col("_id").alias("b"), F.col("root").alias("_b")), "b", "left")
    tops = components(joined.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("top"))
    forget(more)
    classes = of.join(root_of.withColumnRenamed("_id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root")).join(tops, "root", "left")
    return classes.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif(F.coalesce("top", "root"), F.lit(NO_ID)).alias("class_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stand for their class, with all columns of `df`."""
    kept = near_duplicates(df, id_col, text_col).where("doc_id <=> class_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = stored(kept)
    few = kept.count() <= BROADCAST_IDS
    return df.join(F.broadcast(kept) if few else kept, F.col(id_col).cast("long").eqNullSafe(F.col("_kept")), "left_semi")
