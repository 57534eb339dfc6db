"""Removal of repeated byte strings across documents, with per-shard suffix arrays.

A byte goes if a string of 100 bytes that covers it starts earlier: in a document of smaller id, or before in its own.

1. Where a string of 100 bytes is split is decided by its own content: of its 32-byte grams the one with the smallest
   hash is its anchor. Neighbouring strings with one anchor form a run, stored as one row. Equal strings have equal
   anchors, so they meet in the shard of that anchor, wherever their documents lie.
2. Runs that are copies of each other as a whole are collapsed: all but the first are repeats.
3. The different runs of an anchor are put into a shard's suffix array (Larsson-Sadakane refinement of groups that are
   not yet apart, doubling the depth), with Kasai's common prefixes. Suffixes with 100 bytes in common are one string.
4. An anchor with very many different runs is dealt over several suffix arrays; their sorted strings are cut at common
   bounds by binary search, so equal strings of all of them are merged in one task, and copies shrink to their first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import with_dense_id
from .common import arrow_schema, bounded_batches, ddl, stored
from .grams import groups

LENGTH, GRAM = 100, 32
#: Runs in a suffix array, about; an anchor with more different runs than this is dealt over several.
SHARD_RUNS = 4096
#: Window starts of a long text taken at once; anchors are packed with a position of 24 bits.
PART = 1 << 22
NO_ID = -(1 << 63)
LOW = np.uint64((1 << 24) - 1)
BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RUNS = [("anchor", "long"), ("copy", "long"), ("id", "long"), ("span", "long")]


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    with np.errstate(over="ignore"):
        h, width = BYTE[raw], 1
        while width < GRAM:
            h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
        return h * np.uint64(0xD6E8FEB86659FD93)


def runs(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, last start) of the runs of 100-byte strings; `bounds` are the texts' ends in `raw`."""
    begins = np.r_[0, bounds[:-1]]
    whole = bounds - begins >= LENGTH
    if not whole.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = grams(raw)
    least = h & ~LOW | np.arange(h.size, dtype=np.uint64)
    width = 1
    while width * 2 <= LENGTH - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    least = np.minimum(least[: least.size - rest], least[rest:]) if rest else least
    step = np.zeros(raw.size + 1, np.int8)
    step[begins[whole]] += 1
    step[bounds[whole] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(step, dtype=np.int8))
    anchor = (least[at] & LOW).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.r_[0, cut], np.r_[cut, at.size] - 1
    return h[anchor[first]], at[first], at[last]


def text_runs(data: list[bytes], ids: np.ndarray) -> dict[str, np.ndarray]:
    """All runs of the texts: anchor, digest of the run's bytes, id, and first and last start within the text."""
    found = {k: [] for k in ("anchor", "copy", "id", "lo", "hi")}

    def add(raw, bounds, own, shift):
        anchor, lo, hi = runs(np.frombuffer(raw, np.uint8), bounds)
        doc = np.searchsorted(bounds, lo, "right")
        base = np.r_[0, bounds[:-1]][doc] - shift
        digest, view = xxhash.xxh3_64_intdigest, memoryview(raw)
        found["copy"].append(np.array([digest(view[a : b + LENGTH]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64).view(np.int64))
        for k, v in (("anchor", anchor.view(np.int64)), ("id", own[doc]), ("lo", lo - base), ("hi", hi - base)):
            found[k].append(v)

    for at in groups(data):
        if len(at) == 1 and len(data[at[0]]) > PART:
            text = data[at[0]]
            for i in range(0, len(text) - LENGTH + 1, PART):
                part = text[i : i + PART + LENGTH - 1]
                add(part, np.array([len(part)]), ids[at], i)
        else:
            some = [data[i] for i in at]
            add(b"".join(some), np.cumsum([len(x) for x in some]), ids[at], 0)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def joined(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts with neighbouring ones of an id made into one."""
    order = np.lexsort((lo, ids))
    ids, lo, hi = ids[order], lo[order], hi[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (lo[1:] > hi[:-1] + 1)][: ids.size])
    return (ids[new], lo[new], np.maximum.reduceat(hi, new)) if ids.size else (ids, lo, hi)


def packed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo << 32 | hi


def find_runs(df: DataFrame) -> DataFrame:
    """RUNS of each text; a run that a batch has seen before is left out, and its starts are a row with span below 0."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data = [(t or "").encode() for t in batch.column(1).to_pylist()]
            r = text_runs(data, batch.column(0).to_numpy(zero_copy_only=False))
            order = np.lexsort((r["lo"], r["id"], r["copy"], r["anchor"]))
            r = {k: v[order] for k, v in r.items()}
            new = np.r_[True, (r["anchor"][1:] != r["anchor"][:-1]) | (r["copy"][1:] != r["copy"][:-1])][: order.size]
            first = np.maximum.accumulate(np.where(new, np.arange(order.size), 0))
            again = ~new & ((r["id"] != r["id"][first]) | (r["lo"] != r["lo"][first])) if order.size else new
            ids, lo, hi = joined(r["id"][again], r["lo"][again], r["hi"][again])
            spread = ids * -7046029254386353131 + lo  # repeats are dealt anywhere
            span = packed(r["lo"], r["hi"])
            yield pa.RecordBatch.from_pydict({
                "anchor": np.r_[r["anchor"][new], spread], "copy": np.r_[r["copy"][new], spread * 0],
                "id": np.r_[r["id"][new], ids], "span": np.r_[span[new], -packed(lo, hi) - 1],
            }, schema=arrow_schema(RUNS))

    return df.select("id", "t").mapInArrow(run, ddl(RUNS))


def tell_apart(df: DataFrame) -> DataFrame:
    """Of runs sorted by anchor, copy, id and span: repeats (anchor null), and the first of each copy where an anchor
    has several different ones. One row is carried from batch to batch, however many rows a key has."""
    def run(batches):
        held = None  # the last first run: its columns, and whether it was sent
        for batch in batches:
            a, c, i, s = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not a.size:
                continue
            done = s < 0
            out = {"anchor": [], "id": i[done].tolist(), "span": (-1 - s[done]).tolist()}
            out["anchor"] = [None] * len(out["id"])
            a, c, i, s = (x[~done] for x in (a, c, i, s))
            if a.size:
                if held is not None:
                    a, c, i, s = (np.r_[x, y] for x, y in zip(held[:4], (a, c, i, s)))
                new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
                first = np.maximum.accumulate(np.where(new, np.arange(a.size), 0))
                again = np.flatnonzero(~new & ((i != i[first]) | (s >> 32 != s[first] >> 32)))
                ids, lo, hi = joined(i[again], s[again] >> 32, s[again] & 0xFFFFFFFF)
                out["anchor"] += [None] * ids.size
                out["id"] += ids.tolist()
                out["span"] += packed(lo, hi).tolist()
                f = np.flatnonzero(new)
                same = a[f][1:] == a[f][:-1]
                send = np.r_[False, same] | np.r_[same, False]
                if held is not None and held[4]:
                    send[0] = False
                out["anchor"] += a[f][send].tolist()
                out["id"] += i[f][send].tolist()
                out["span"] += s[f][send].tolist()
                last = f[-1]
                sent = bool(send[-1]) or (f.size == 1 and held is not None and held[4])
                held = (a[last], c[last], i[last], s[last], sent)
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema(RUNS[:1] + RUNS[2:]))

    return df.mapInArrow(run, ddl(RUNS[:1] + RUNS[2:]))


def run_bytes(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(anchor, id, lo, data) of the wanted runs (anchor, id, span)."""
    schema = [("anchor", "long"), ("id", "long"), ("lo", "long"), ("data", "binary")]
    lists = wanted.groupBy("id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("span").alias("spans"))

    def run(batches):
        for batch in batches:
            rows, out = batch.to_pydict(), {k: [] for k, _ in schema}
            for key, text, anchors, spans in zip(rows["id"], rows["t"], rows["anchors"], rows["spans"]):
                data = (text or "").encode()
                for anchor, span in zip(anchors, spans):
                    lo, hi = span >> 32, span & 0xFFFFFFFF
                    for k, v in zip(out, (anchor, key, lo, data[lo : hi + LENGTH])):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema(schema))

    return texts.join(lists, "id").select("id", "t", "anchors", "spans").mapInArrow(run, ddl(schema))


def suffix_array(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, common prefixes, text of each place, place's offset) of texts set side by side.

    Larsson and Sadakane: places are sorted by their first eight bytes; while the depth is below LENGTH, groups that
    are not apart are sorted by the rank of the place one depth on, and the depth doubles. Suffixes end with their
    text. The common prefix of a suffix with the one before it in the array is counted up to LENGTH.
    """
    sizes = np.array([len(x) for x in data])
    raw = np.frombuffer(b"".join(data), np.uint8)
    n = raw.size
    owner = np.repeat(np.arange(sizes.size), sizes)
    offset = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - offset  # bytes to the end of the text
    wide = np.r_[raw, np.zeros(16, np.uint8)]
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | np.where(left > i, wide[i : i + n], 0).astype(np.uint64)
    array = np.argsort(key, kind="stable")
    k = key[array]
    # A text's end sorts below a zero byte: short suffixes are told apart by their length.
    short = np.minimum(left[array], 8)
    if (short < 8).any():
        array = array[np.lexsort((short, k))]
        k, short = key[array], np.minimum(left[array], 8)
    head = np.r_[True, (k[1:] != k[:-1]) | (short[1:] != short[:-1])]
    rank = np.empty(n + 1, np.int64)
    rank[array] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[n] = -1
    depth = 8
    while depth < LENGTH:
        alone = head & np.r_[head[1:], True]
        open_ = np.flatnonzero(~alone)
        if not open_.size:
            break
        places = array[open_]
        further = np.where(left[places] > depth, rank[np.minimum(places + depth, n)], -1)
        group = rank[places]
        order = np.lexsort((further, group))
        array[open_] = places[order]
        group, further = group[order], further[order]
        head[open_] = np.r_[True, (group[1:] != group[:-1]) | (further[1:] != further[:-1])]
        rank[array[open_]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[open_]
        depth *= 2
    return array, common_prefixes(wide, array, left), owner, offset


def common_prefixes(wide: np.ndarray, array: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Kasai: a place's common prefix is at least that of the place before it less one, so places are taken in text
    order; here every 16th place counts from 0 and then, all at once, those between from what that implies."""
    n = array.size
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    prefix = np.zeros(n, np.int64)

    def count(places, known):
        going = np.flatnonzero(before[places] >= 0)
        length = known.copy()
        most = np.minimum(LENGTH, np.minimum(left[places], left[before[places]]))
        while going.size:
            p, at = places[going], length[going]
            going = going[at < most[going]]
            p, at = places[going], length[going]
            equal = wide[p + at] == wide[before[p] + at]
            going = going[equal]
            length[going] += 1
        return np.where(before[places] >= 0, np.minimum(length, np.maximum(most, 0)), 0)

    every = np.arange(0, n, 16)
    prefix[every] = count(every, np.zeros(every.size, np.int64))
    others = np.flatnonzero(np.arange(n) % 16)
    owed = np.maximum(0, prefix[others // 16 * 16] - others % 16)
    # The bound holds within a text; where a text starts in between, counting starts anew.
    owed[left[others] > left[others // 16 * 16]] = 0
    # A common prefix cut off at LENGTH hides what follows, but what it implies still holds.
    prefix[others] = count(others, owed)
    return prefix[array]


def repeated_starts(ids: np.ndarray, lo: np.ndarray, data: list[bytes]):
    """Per group of equal 100-byte strings in a suffix array: (group number, id, start, place's text, offset), sorted
    so that the first of a group comes first."""
    array, prefix, owner, offset = suffix_array(data)
    whole = np.array([len(x) for x in data])[owner[array]] - offset[array] >= LENGTH
    number = np.cumsum(prefix < LENGTH)
    array, number = array[whole], number[whole]
    ids, starts = ids[owner[array]], lo[owner[array]] + offset[array]
    order = np.lexsort((starts, ids, number))
    return number[order], ids[order], starts[order], owner[array][order], offset[array][order]


def later_ones(number, ids, starts):
    """The starts that aren't the first of their group, as ranges."""
    new = np.r_[True, number[1:] != number[:-1]][: number.size]
    first = np.maximum.accumulate(np.where(new, np.arange(number.size), 0))
    again = ~new & ((ids != ids[first]) | (starts != starts[first])) if number.size else new
    return joined(ids[again], starts[again], starts[again])


REPEATS = [("id", "long"), ("span", "long")]


def shard_repeats(rows: DataFrame, shards: int) -> DataFrame:
    """Repeats among runs of one anchor, one suffix array per shard of anchors."""
    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        number, ids, starts, _, _ = repeated_starts(pdf["id"].to_numpy(), pdf["lo"].to_numpy(), pdf["data"].tolist())
        ids, lo, hi = later_ones(number, ids, starts)
        return pd.DataFrame({"id": ids, "span": packed(lo, hi)})

    return rows.withColumn("shard", F.expr(f"pmod(xxhash64(anchor), {shards})")).groupBy("shard").applyInPandas(shard, ddl(REPEATS))


def merged_repeats(rows: DataFrame, shards: int) -> DataFrame:
    """Repeats among runs of anchors with very many different runs: suffix arrays of parts, merged at common bounds.

    A part keeps the first of each of its strings; the others are repeats at once. Its sorted strings are cut by
    binary search at bounds taken evenly over all 128-bit string digests, so that each range of all parts is merged in
    one task, where again only the first of a string is none of the repeats.
    """
    schema = [("range", "long"), ("h1", "long"), ("h2", "long"), ("id", "long"), ("start", "long"), ("seen", "boolean")]
    bounds = np.linspace(0, 2.0**64, shards * 4 + 1)[1:-1].astype(np.uint64)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf["data"].tolist()
        number, ids, starts, owner, offset = repeated_starts(pdf["id"].to_numpy(), pdf["lo"].to_numpy(), data)
        new = np.r_[True, number[1:] != number[:-1]][: number.size]
        digests = b"".join(xxhash.xxh3_128_digest(data[o][x : x + LENGTH]) for o, x in zip(owner[new], offset[new]))
        h = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        by = np.argsort(h[:, 0], kind="stable")
        cuts = np.searchsorted(h[by, 0], bounds)
        ranges = np.empty(len(by), np.int64)
        ranges[by] = np.repeat(np.arange(bounds.size + 1), np.diff(np.r_[0, cuts, len(by)]))
        firsts = pd.DataFrame({"range": ranges, "h1": h[:, 0].view(np.int64), "h2": h[:, 1].view(np.int64), "id": ids[new], "start": starts[new], "seen": False})
        again, lo, hi = later_ones(number, ids, starts)
        flat = np.repeat(again, hi - lo + 1), np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]) if again.size else again
        seen = pd.DataFrame({"range": 0, "h1": 0, "h2": 0, "id": flat[0], "start": flat[1], "seen": True})
        return pd.concat([firsts, seen]) if again.size else firsts

    parts = rows.withColumn("part", F.expr(f"pmod(xxhash64(anchor, id, lo), {shards})")).groupBy("part").applyInPandas(part, ddl(schema))
    parts = stored(parts)
    found = parts.where("seen").select("id", F.expr("start << 32 | start").alias("span"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2, ids, starts = (pdf[k].to_numpy() for k in ("h1", "h2", "id", "start"))
        order = np.lexsort((starts, ids, h2, h1))
        h1, h2, ids, starts = h1[order], h2[order], ids[order], starts[order]
        number = np.cumsum(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: h1.size])
        ids, lo, hi = later_ones(number, ids, starts)
        return pd.DataFrame({"id": ids, "span": packed(lo, hi)})

    return found.union(parts.where("NOT seen").groupBy("range").applyInPandas(merge, ddl(REPEATS)))


SCHEMA = [("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")]


def kept_bytes(text: str | None, spans: list[int] | None) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, removed runs, what is left) of a text whose ranges of repeated starts are given."""
    data = (text or "").encode()
    if not spans:
        return len(data), 0, 0, data
    s = np.sort(np.array(spans, np.int64))
    lo, end = s >> 32, np.maximum.accumulate((s & 0xFFFFFFFF) + LENGTH)
    new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
    lo, end = lo[new], np.r_[end[new[1:] - 1], end[-1]]
    left = b"".join(data[a:b] for a, b in zip(np.r_[0, end], np.r_[lo, len(data)]))
    return len(data), int((end - lo).sum()), lo.size, left


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, doc): texts with a number of their own in the order of their ids `doc`; null comes first.

    Where no id is repeated, the id is the number. Else different texts of one id are numbered apart, by digest, and
    equal ones alike.
    """
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("t"))
    if not texts.groupBy("doc").count().where("count > 1").limit(1).count():
        return texts.select(F.col("doc").alias("id"), "t", "doc")
    digest = F.xxhash64(F.coalesce("t", F.lit("")))
    numbers = stored(with_dense_id(texts.select("doc", digest.alias("_digest")).distinct(), ["doc", "_digest"], "id"))
    return stored(texts.withColumn("_digest", digest).join(numbers, ["doc", "_digest"]).select("id", "t", "doc"))


def repeated_ranges(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): (id, t, doc) of the rows of `df`, and (id, span) of the starts of all repeated strings."""
    spark = df.sparkSession
    texts = keyed_texts(df, id_col, text_col)
    bounded_batches(spark, 2048)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = find_runs(texts).repartition(n, "anchor").sortWithinPartitions("anchor", "copy", "id", "span")
    found = stored(tell_apart(found))
    ranges = found.where("anchor IS NULL").select("id", "span")
    wanted = found.where("anchor IS NOT NULL")
    many = wanted.count()
    if many:
        rows = stored(run_bytes(wanted, texts))
        hot = stored(wanted.groupBy("anchor").count().where(F.col("count") > SHARD_RUNS).select("anchor"))
        shards = max(1, -(-many // SHARD_RUNS))
        if hot.limit(1).count():  # at most one anchor in SHARD_RUNS runs is hot
            hot = F.broadcast(hot) if many <= 1 << 28 else hot
            ranges = ranges.union(shard_repeats(rows.join(hot, "anchor", "left_anti"), shards)).union(merged_repeats(rows.join(hot, "anchor", "left_semi"), shards))
        else:
            ranges = ranges.union(shard_repeats(rows, shards))
    return texts, ranges


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row per document: sizes, removed runs, the digest of what is left, and (`kept`) what is left.

    Strings are judged on the input. A null text counts as empty. A text below 100 bytes keeps all. A null id is the
    smallest. Of repeated ids with equal texts none is earlier than the other; different texts under one id are
    documents of their own, in the order of their digests.
    """
    texts, ranges = repeated_ranges(df, id_col, text_col)
    lists = ranges.groupBy("id").agg(F.collect_list("span").alias("spans"))
    schema = SCHEMA if keep_bytes else SCHEMA[:-1]

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out = [[] for _ in SCHEMA]
            for key, text, spans in zip(rows["doc"], rows["t"], rows["spans"]):
                n, removed, count, left = kept_bytes(text, spans)
                for column, value in zip(out, (None if key == NO_ID else key, n, removed, count, hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            yield pa.RecordBatch.from_pydict({name: column for (name, _), column in zip(schema, out)}, schema=arrow_schema(schema))

    return texts.join(lists, "id", "left").select("doc", "t", "spans").mapInArrow(run, ddl(schema))
