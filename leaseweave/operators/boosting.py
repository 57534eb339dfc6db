"""Gradient boosting of quantiles over binned features.

Rows are kept in blocks of binned features with their target and the values reached so far. Few rows are grown on in one
task; of more, a level of the trees of all
quantiles is one Spark job: tasks add up gradients and rows per (tree, node, feature, bin), one aggregate sums them, and
the best split of each node is searched where its histogram is; the driver gets splits only. A leaf's value is the exact
quantile of its rows' residuals, found in two counting rounds over the halves of their bits.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..sources.scratch import drop, keep

#: Rows of a block, bytes of the blocks that a task reads at once, and residuals that it holds while it counts them.
BLOCK, BATCH_BYTES, COUNTED = 8192, 16 << 20, 1 << 18
#: Rows up to which one task grows all trees, as a round's jobs take longer than its work (some 30 MB of blocks).
ALONE = 64 * BLOCK


@dataclass(frozen=True)
class Settings:
    """How trees grow. `rounds` may be one number per quantile."""

    quantiles: tuple[float, ...] = DEFAULT.quantiles
    rounds: int | tuple[int, ...] = 300
    patience: int = 20
    rate: float = 0.1
    depth: int = 6
    min_rows: int = 50
    l2: float = 1.0
    rows_share: float = 0.8
    features_share: float = 0.8
    bins: int = 63
    levels: int = 1000
    smooth: float = 10.0
    seed: int = 42


@dataclass
class Bins:
    """How each feature is binned: upper edges of a numeric one, levels of a categorical one. Bin 0 is missing (or a level
    not seen); levels beyond the commonest share the last bin."""

    features: list[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    shared: list[str] = field(default_factory=list)

    @property
    def sizes(self) -> np.ndarray:
        return np.array([len(self.edges[f]) + 2 if f in self.edges else len(self.levels[f]) + 1 + (f in self.shared) for f in self.features])

    @property
    def first(self) -> np.ndarray:
        """Where each feature's bins begin among all bins."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def columns(self) -> list:
        return [F.col(f"`{f}`").cast("double" if f in self.edges else "string").alias(f) for f in self.features]

    def codes(self, table: pa.Table | pa.RecordBatch) -> np.ndarray:
        """Bin of each row and feature, counted among all bins."""
        out = np.empty((table.num_rows, len(self.features)), np.int32)
        for i, (f, start) in enumerate(zip(self.features, self.first)):
            c = table.column(f)
            if f in self.edges:
                v = c.to_numpy(zero_copy_only=False).astype(float)
                at = np.where(np.isnan(v), 0, np.searchsorted(np.array(self.edges[f]), v) + 1)
            else:
                found = pc.index_in(c, value_set=pa.array(self.levels[f], pa.string()))
                known = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
                other = len(self.levels[f]) + 1 if f in self.shared else 0
                at = np.where(known >= 0, known + 1, np.where(pc.is_null(c).to_numpy(zero_copy_only=False), 0, other))
            out[:, i] = at + start
        return out


def measured_bins(df: DataFrame, features: Sequence[str], s: Settings) -> Bins:
    """Edges at equal shares of a feature's values (one aggregate), levels by frequency (another)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [f for f in features if isinstance(kinds[f], NumericType)]
    named = [f for f in features if f not in numeric]
    out = Bins(list(features))
    if numeric:
        at = [i / s.bins for i in range(1, s.bins)]
        found = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), at, 10_000).alias(f) for f in numeric]).first()
        out.edges = {f: sorted(set(found[f] or [])) for f in numeric}
    for f in named:
        counts = df.select(F.col(f"`{f}`").cast("string").alias("v")).where("v IS NOT NULL").groupBy("v").count()
        rows = counts.orderBy(F.desc("count"), "v").limit(s.levels + 1).collect()
        out.levels[f] = sorted(r["v"] for r in rows[: s.levels])
        if len(rows) > s.levels:
            out.shared.append(f)
    return out


@dataclass
class Tree:
    """Nodes in heap order: the feature of each split (-1: a leaf), which bins go left, and values of leaves."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, bins: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros((n, bins), bool), np.zeros(n, np.float32))

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node where each row of `codes` ends."""
        node = np.zeros(len(codes), np.int64)
        moving = np.arange(len(codes)) if self.feature[0] >= 0 else np.empty(0, np.int64)
        while moving.size:
            at = node[moving]
            goes_left = self.left[at, codes[moving, self.feature[at]]]
            node[moving] = 2 * at + 2 - goes_left
            moving = moving[self.feature[node[moving]] >= 0]
        return node


def best_split(sums: np.ndarray, counts: np.ndarray, bins: Bins, allowed: np.ndarray, s: Settings):
    """(gain, feature, which of its bins go left) of one node's histogram, or None where no split keeps enough rows."""
    first, best = bins.first, None
    total, n = sums[: first[1]].sum(), counts[: first[1]].sum()
    score = lambda g, c: g * g / (c + s.l2)
    for i in np.flatnonzero(allowed):
        g, c = sums[first[i] : first[i + 1]], counts[first[i] : first[i + 1]]
        if bins.features[i] in bins.edges:
            order = np.arange(1, g.size)
        else:
            there = np.flatnonzero(c[1:] > 0) + 1
            order = there[np.argsort(g[there] / (c[there] + s.smooth), kind="stable")]
        run_g, run_c = np.cumsum(g[order]), np.cumsum(c[order])
        for missing in (True, False) if c[0] else (False,):
            left_g, left_c = run_g + missing * g[0], run_c + missing * c[0]
            ok = (left_c >= s.min_rows) & (n - left_c >= s.min_rows)
            if ok.any():
                gain = np.where(ok, score(left_g, left_c) + score(total - left_g, n - left_c) - score(total, n), -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > 1e-9 and (best is None or gain[at] > best[0]):
                    goes = np.zeros(g.size, bool)
                    goes[order[: at + 1]] = True
                    goes[0] = missing
                    best = float(gain[at]), int(i), goes
    return best


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """uint32 in the order of the float32 numbers, from the smallest."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31)).astype(np.uint32)


def from_bits(bits: int) -> float:
    raw = np.uint32(bits ^ (1 << 31)) if bits >> 31 else ~np.uint32(bits)
    return float(np.array([raw], np.uint32).view(np.float32)[0])


def tallied(parts: Iterable[np.ndarray], most: int | None = None):
    """(numbers, how often each was met) of all `parts`. Numbers are told as soon as over half of `most` (COUNTED) different
    ones are held, so one may be told several times."""
    most = most or COUNTED
    keys, n, waiting, more = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
    for part in parts:
        waiting.append(part)
        more += part.size
        if keys.size + more >= most:
            (keys, n), waiting, more = _merged(keys, n, waiting), [], 0
            if keys.size > most // 2:
                yield keys, n
                keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
    keys, n = _merged(keys, n, waiting)
    if keys.size:
        yield keys, n


def _merged(keys: np.ndarray, n: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([keys, *parts]), return_inverse=True)
    total = np.bincount(at[keys.size :], minlength=found.size).astype(np.int64)
    total[at[: keys.size]] += n
    return found, total


def histograms(codes: np.ndarray, gradient: np.ndarray, leaf: np.ndarray, nodes: Sequence[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and numbers of rows of each of `nodes` (rows) and bin (columns)."""
    slot = np.full(max(int(leaf.max(initial=0)), max(nodes)) + 1, -1, np.int64)
    slot[list(nodes)] = np.arange(len(nodes))
    mine = slot[leaf]
    if (mine < 0).any():
        there = np.flatnonzero(mine >= 0)
        codes, gradient, mine = codes[there], gradient[there], mine[there]
    at, shape = (codes + mine[:, None] * size).ravel(), (len(nodes), size)
    count = lambda weights=None: np.bincount(at, weights, shape[0] * size).reshape(shape)
    return count(np.repeat(gradient, codes.shape[1])), count()


def chosen_features(s: Settings, features: int, growing: Sequence[int], number: int) -> dict[int, np.ndarray]:
    """Which features the trees of a round may split on."""
    rng = np.random.default_rng([s.seed, number])
    some = {q: rng.permutation(features)[: max(1, round(s.features_share * features))] for q in growing}
    return {q: np.isin(np.arange(features), x) for q, x in some.items()}


def sampled(s: Settings, number: int, seed: int, n: int) -> np.ndarray:
    """Which of the rows of a block a round grows on."""
    return np.random.default_rng([s.seed, number, seed]).random(n) < s.rows_share


def boosted(s: Settings, grow, move, valid: bool) -> tuple[list[list[Tree]], list[int], list[list[float]]]:
    """Trees, best rounds and losses of all quantiles: `grow` makes a round's trees, `move` adds their values and tells the
    number of validation rows and their losses."""
    trees, best, losses = [[] for _ in s.quantiles], [0] * len(s.quantiles), [[] for _ in s.quantiles]
    rounds = list(s.rounds) if isinstance(s.rounds, tuple) else [s.rounds] * len(s.quantiles)
    growing = [q for q in range(len(s.quantiles)) if rounds[q] > 0]
    least, number = [np.inf] * len(s.quantiles), 0
    while growing:
        new = grow(growing, number)
        for q, tree in new.items():
            trees[q].append(tree)
        lost = move(new)
        number += 1
        for q in list(growing):
            if valid and lost[0]:
                losses[q].append(float(lost[q + 1] / lost[0]))
                if losses[q][-1] < least[q]:
                    least[q], best[q] = losses[q][-1], number
            else:
                best[q] = number
            if number >= rounds[q] or number - best[q] >= s.patience or new[q].feature[0] < 0:
                growing.remove(q)
    return [series[:n] for series, n in zip(trees, best)], best, losses


def grown_alone(blocks: list[tuple], s: Settings, bins: Bins, valid: bool):
    """What `boosted` gives and the gain by feature, of blocks (train, codes, y, f, seed) held at once."""
    size, gain = int(bins.first[-1]), np.zeros(len(bins.features))
    train = [b for b in blocks if b[0]]
    every = np.concatenate([codes for _, codes, *_ in train]) if train else np.empty((0, len(bins.features)), np.int32)

    def grow(growing, number):
        used = [sampled(s, number, seed, y.size) for _, _, y, _, seed in train]
        codes, allowed, trees = every[np.concatenate([*used, np.empty(0, bool)])], chosen_features(s, len(bins.features), growing, number), {}
        for q in growing:
            tree = trees[q] = Tree.empty(s.depth, size)
            left_over = np.concatenate([np.empty(0, np.float32), *[y - f[q] for _, _, y, f, _ in train]])
            above = np.concatenate([np.empty(0, bool), *[(y >= f[q])[u] for (_, _, y, f, _), u in zip(train, used)]])
            gradient = np.where(above, s.quantiles[q], s.quantiles[q] - 1)
            node, nodes = np.zeros(len(codes), np.int64), [0]
            for _ in range(s.depth):
                if not nodes:
                    break
                split = []
                for at, g, c in zip(nodes, *histograms(codes, gradient, node, nodes, size)):
                    if found := best_split(g, c, bins, allowed[q], s):
                        tree.feature[at] = found[1]
                        tree.left[at, bins.first[found[1]] : bins.first[found[1] + 1]] = found[2]
                        split += [2 * at + 1, 2 * at + 2]
                        if q == len(s.quantiles) // 2:
                            gain[found[1]] += found[0]
                moving = np.flatnonzero(tree.feature[node] >= 0)
                at = node[moving]
                node[moving] = 2 * at + 2 - tree.left[at, codes[moving, tree.feature[at]]]
                nodes = split
            leaf = tree.leaves(every)
            order = np.lexsort((left_over, leaf))
            ends, n = np.unique(leaf, return_counts=True)
            rank = np.maximum(np.ceil(s.quantiles[q] * n).astype(np.int64) - 1, 0)
            tree.value[ends] = left_over[order[np.cumsum(n) - n + rank]]
            tree.value *= np.float32(s.rate)
        return trees

    def move(new):
        lost = np.zeros(len(s.quantiles) + 1)
        for is_train, codes, y, f, _ in blocks:
            for q, tree in new.items():
                f[q] += tree.value[tree.leaves(codes)]
            if not is_train:
                lost += [y.size, *pinball_losses(s, y, f)]
        return lost

    return *boosted(s, grow, move, valid), gain


def pinball_losses(s: Settings, y: np.ndarray, f: np.ndarray) -> list[float]:
    return [float(np.maximum(a * (y - x), (a - 1) * (y - x)).sum(dtype=float)) for a, x in zip(s.quantiles, f)]


class QuantileBoosting:
    """Three series of trees for three quantiles; `fit`, then `predict` adds q_lo, q_mid, q_hi."""

    def __init__(self, features: Sequence[str], target: str = "_y", settings: Settings | None = None, **changed):
        self.features, self.target, self.settings = list(features), target, replace(settings or Settings(), **changed)
        self.trees: list[list[Tree]] = [[] for _ in self.settings.quantiles]
        self.start = [0.0] * len(self.trees)
        self.best: list[int] = []
        self.losses: list[list[float]] = []
        self.gain = np.zeros(len(self.features))

    # ---- fitting

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> QuantileBoosting:
        """Grow trees on `train`; with `valid` each quantile stops when its pinball loss there hasn't fallen for `patience`
        rounds, and keeps the trees up to its best round."""
        s, spark = self.settings, train.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # a row is a block of some 300 kB
        self.bins = measured_bins(train, self.features, s)
        self.start = [float(x or 0.0) for x in (train.agg(F.percentile_approx(self.target, list(s.quantiles), 100_000)).first()[0] or [0.0] * len(s.quantiles))]
        rows = self._blocks(train, True)
        if valid is not None:
            rows = rows.union(self._blocks(valid, False))
        rows, path = keep(rows)
        if (rows.agg(F.sum("n")).first()[0] or 0) <= ALONE:
            read, bins, watched = self._reader(), self.bins, valid is not None

            def alone(batches):
                blocks = []
                for batch in batches:
                    for i in range(batch.num_rows):
                        codes, y, f, seed = read(batch, i)
                        blocks.append((batch.column("train")[i].as_py(), codes, y, f.copy(), seed))
                yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(grown_alone(blocks, s, bins, watched))], pa.binary())})

            made = rows.coalesce(1).mapInArrow(alone, "model binary").first()
            self.trees, self.best, self.losses, self.gain = pickle.loads(made[0]) if made else grown_alone([], s, bins, False)
            drop(spark, path)
            return self

        def move(new):
            nonlocal rows, path
            (rows, fresh), old = keep(self._moved(rows, new)), path
            path = fresh
            drop(spark, old)
            if valid is not None:
                return rows.where("NOT train").agg(F.sum("n"), *[F.sum(F.get("loss", F.lit(q))) for q in range(len(s.quantiles))]).first()

        self.trees, self.best, self.losses = boosted(s, lambda growing, number: self._grow(rows, growing, number), move, valid is not None)
        drop(spark, path)
        return self

    def _blocks(self, df: DataFrame, train: bool) -> DataFrame:
        bins, start, target = self.bins, self.start, self.target
        schema = pa.schema([("train", pa.bool_()), ("n", pa.int64()), ("codes", pa.binary()), ("y", pa.binary()), ("f", pa.binary()), ("loss", pa.list_(pa.float64()))])

        def cut(batches):
            held, n = [], 0

            def block():
                table = pa.Table.from_batches(held).combine_chunks()
                y = table.column(target).to_numpy().astype(np.float32)
                f = np.repeat(np.array(start, np.float32)[:, None], y.size, 1)
                return pa.RecordBatch.from_pydict({"train": [train], "n": [y.size], "codes": [bins.codes(table).tobytes()], "y": [y.tobytes()], "f": [f.tobytes()], "loss": [[0.0] * len(start)]}, schema=schema)

            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    held.append(batch.slice(at, BLOCK))
                    n += held[-1].num_rows
                    if n >= BLOCK:
                        yield block()
                        held, n = [], 0
            if held:
                yield block()

        ready = df.where(F.col(self.target).isNotNull()).select(*bins.columns(), F.col(self.target).cast("double").alias(target))
        return ready.mapInArrow(cut, "train boolean, n long, codes binary, y binary, f binary, loss array<double>")

    def _reader(self):
        """Reads a block: codes, targets, values so far, and a seed of its own."""
        width, many = len(self.features), len(self.settings.quantiles)

        def read(batch, i):
            y = np.frombuffer(batch.column("y")[i].as_py(), np.float32)
            seed = int(np.frombuffer(y.tobytes()[:4].ljust(4, b"\0"), np.uint32)[0]) ^ y.size
            return np.frombuffer(batch.column("codes")[i].as_py(), np.int32).reshape(-1, width), y, np.frombuffer(batch.column("f")[i].as_py(), np.float32).reshape(many, -1), seed

        return read

    def _grow(self, rows: DataFrame, growing: list[int], number: int) -> dict[int, Tree]:
        s, bins, spark = self.settings, self.bins, rows.sparkSession
        size = int(bins.first[-1])
        trees = {q: Tree.empty(s.depth, size) for q in growing}
        allowed = chosen_features(s, len(self.features), growing, number)
        open_nodes = {q: {0} for q in growing}
        train, read = rows.where("train").select("codes", "y", "f"), self._reader()
        for level in range(s.depth):
            if not any(open_nodes.values()):
                break
            sent = spark.sparkContext.broadcast((trees, open_nodes))

            def count(batches, sent=sent):
                trees, open_nodes = sent.value
                sums = {}
                for batch in batches:
                    for i in range(batch.num_rows):
                        codes, y, f, seed = read(batch, i)
                        used = sampled(s, number, seed, y.size)
                        codes = codes[used]
                        for q, nodes in open_nodes.items():
                            if nodes:
                                order = sorted(nodes)
                                gradient = np.where((y >= f[q])[used], s.quantiles[q], s.quantiles[q] - 1)
                                for node, *both in zip(order, *histograms(codes, gradient, trees[q].leaves(codes), order, size)):
                                    sums[q, node] = sums[q, node] + both if (q, node) in sums else np.array(both)
                if sums:
                    yield pa.RecordBatch.from_pydict({"q": [k[0] for k in sums], "node": [k[1] for k in sums], "sums": [x.tobytes() for x in sums.values()]})

            def split(batches):
                total = {}
                for batch in batches:
                    for q, node, x in zip(*(c.to_pylist() for c in batch.columns)):
                        x = np.frombuffer(x).reshape(2, -1)
                        total[q, node] = total[q, node] + x if (q, node) in total else x
                for (q, node), (g, c) in total.items():
                    if found := best_split(g, c, bins, allowed[q], s):
                        yield pa.RecordBatch.from_pydict({"q": pa.array([q], pa.int32()), "node": pa.array([node], pa.int32()), "gain": [found[0]], "feature": pa.array([found[1]], pa.int32()), "goes": [found[2].tobytes()]})

            kind = "q int, node int, sums binary"
            parts = train.mapInArrow(lambda b, count=count: (r.cast(pa.schema([("q", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])) for r in count(b)), kind)
            found = parts.repartition("q", "node").mapInArrow(split, "q int, node int, gain double, feature int, goes binary").collect()  # a row for each node
            open_nodes = {q: set() for q in growing}
            for r in found:
                tree, node = trees[r["q"]], r["node"]
                tree.feature[node] = r["feature"]
                first = bins.first[r["feature"]]
                tree.left[node, first : first + bins.sizes[r["feature"]]] = np.frombuffer(r["goes"], bool)
                open_nodes[r["q"]] |= {2 * node + 1, 2 * node + 2}
                if r["q"] == len(s.quantiles) // 2:
                    self.gain[r["feature"]] += r["gain"]
            sent.unpersist()
        self._leaf_values(train, trees)
        return trees

    def _leaf_values(self, train: DataFrame, trees: dict[int, Tree]) -> None:
        """The quantile of the residuals in each leaf: the smallest of which at least that share of the rows is no larger."""
        s, read = self.settings, self._reader()
        prefix: dict[tuple[int, int], tuple[int, int]] = {}
        for half in (0, 1):
            sent = train.sparkSession.sparkContext.broadcast((trees, prefix))

            def count(batches, sent=sent, half=half):
                trees, prefix = sent.value

                def met():
                    for batch in batches:
                        for i in range(batch.num_rows):
                            codes, y, f, _ = read(batch, i)
                            for q, tree in trees.items():
                                bits, leaf = ordered_bits(y - f[q]), tree.leaves(codes)
                                part = (bits >> 16).astype(np.int64)
                                if half:
                                    wanted = np.full(tree.feature.size, -1, np.int64)
                                    for (a, node), (high, _) in prefix.items():
                                        if a == q:
                                            wanted[node] = high
                                    kept = part == wanted[leaf]
                                    part, leaf = (bits[kept] & 0xFFFF).astype(np.int64), leaf[kept]
                                yield np.int64(q) << 48 | leaf << 16 | part

                for keys, n in tallied(met()):
                    yield pa.RecordBatch.from_pydict({"q": pa.array((keys >> 48).astype(np.int32)), "node": pa.array((keys >> 16 & 0xFFFFFFFF).astype(np.int32)), "part": pa.array((keys & 0xFFFF).astype(np.int32)), "n": pa.array(n)})

            counts = train.mapInArrow(count, "q int, node int, part int, n long").groupBy("q", "node", "part").agg(F.sum("n").alias("n"))
            by = Window.partitionBy("q", "node")  # 65,536 rows at most
            if half:
                ranks = {f"{q},{node}": k for (q, node), (_, k) in prefix.items()}
                rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[F.concat_ws(",", "q", "node")] if ranks else F.lit(0)
            else:
                quantile = F.create_map(*[F.lit(x) for pair in enumerate(s.quantiles) for x in pair])[F.col("q")]
                rank = F.greatest(F.ceil(quantile * F.sum("n").over(by)) - 1, F.lit(0))
            upto = F.sum("n").over(by.orderBy("part"))
            found = counts.select("q", "node", "part", (upto - F.col("n")).alias("_from"), upto.alias("_upto"), rank.cast("long").alias("_rank")).where("_from <= _rank AND _rank < _upto").collect()
            if half:
                for r in found:
                    trees[r["q"]].value[r["node"]] = from_bits(prefix[r["q"], r["node"]][0] << 16 | r["part"])
            else:
                prefix = {(r["q"], r["node"]): (r["part"], r["_rank"] - r["_from"]) for r in found}
            sent.unpersist()
        for tree in trees.values():
            tree.value *= np.float32(s.rate)

    def _moved(self, rows: DataFrame, new: dict[int, Tree]) -> DataFrame:
        """The blocks with the new trees' values added, and their pinball losses."""
        s, read = self.settings, self._reader()
        sent = rows.sparkSession.sparkContext.broadcast(new)

        def move(batches):
            for batch in batches:
                values, losses = [], []
                for i in range(batch.num_rows):
                    codes, y, f, _ = read(batch, i)
                    f = f.copy()
                    for q, tree in sent.value.items():
                        f[q] += tree.value[tree.leaves(codes)]
                    values.append(f.tobytes())
                    losses.append(pinball_losses(s, y, f))
                at = {name: batch.column(name) for name in ("train", "n", "codes", "y")}
                yield pa.RecordBatch.from_pydict(at | {"f": pa.array(values, pa.binary()), "loss": pa.array(losses, pa.list_(pa.float64()))})

        return rows.mapInArrow(move, rows.schema)

    # ---- use

    def predict(self, df: DataFrame) -> DataFrame:
        """`df` with q_lo, q_mid, q_hi of the target; nothing is shuffled. Levels that weren't seen count as missing."""
        width, bins = len(df.columns), self.bins
        sent = df.sparkSession.sparkContext.broadcast((self.trees, self.start))
        out = StructType([*df.schema.fields, *StructType.fromDDL("q_lo double, q_mid double, q_hi double").fields])
        inside = {f: f"_feature{i}" for i, f in enumerate(self.features)}

        def run(batches):
            trees, start = sent.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                codes = bins.codes(table.select([*inside.values()]).rename_columns(self_features))
                kept = table.select(range(width))
                for name, first, series in zip(("q_lo", "q_mid", "q_hi"), start, trees):
                    value = np.full(len(codes), first)
                    for tree in series:
                        value += tree.value[tree.leaves(codes)]
                    kept = kept.append_column(name, pa.array(value))
                yield from kept.to_batches()

        self_features = list(self.features)
        ready = df.select("*", *[c.alias(inside[f]) for f, c in zip(self.features, bins.columns())])
        return ready.mapInArrow(run, out)

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, gain, gain_share) of the middle quantile's splits, the largest first."""
        total = float(self.gain.sum()) or 1.0
        rows = [(f, float(g), float(g) / total) for f, g in zip(self.features, self.gain)]
        out = spark.createDataFrame(rows, "feature string, gain double, gain_share double")
        return out.withColumn("gain_share", F.bround("gain_share", 4)).orderBy(F.desc("gain"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per tree, and the bins and settings as JSON beside."""
        rows = [(q, i, t.feature.tolist(), np.packbits(t.left).tobytes(), t.value.tolist()) for q, series in enumerate(self.trees) for i, t in enumerate(series)]
        spark.createDataFrame(rows, "q int, number int, feature array<int>, goes binary, value array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        facts = {"features": self.features, "target": self.target, "settings": asdict(self.settings), "start": self.start, "best": self.best, "gain": self.gain.tolist(), "edges": self.bins.edges, "levels": self.bins.levels, "shared": self.bins.shared}
        spark.createDataFrame([(json.dumps(facts, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileBoosting:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        s = {k: tuple(v) if isinstance(v, list) else v for k, v in facts["settings"].items()}
        out = cls(facts["features"], facts["target"], Settings(**s))
        out.bins = Bins(facts["features"], facts["edges"], facts["levels"], facts["shared"])
        out.start, out.best, out.gain = facts["start"], facts["best"], np.array(facts["gain"])
        size = int(out.bins.first[-1])
        for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["q"], r["number"])):
            n = len(r["feature"])
            left = np.unpackbits(np.frombuffer(r["goes"], np.uint8), count=n * size).reshape(n, size).astype(bool)
            out.trees[r["q"]].append(Tree(np.array(r["feature"], np.int32), left, np.array(r["value"], np.float32)))
        return out
