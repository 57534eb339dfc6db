"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word count model.

The model gives each subword a class by one attention layer over up to 23 subwords before it and a small feed-forward
layer; every frequent subword is a class, the others share bands of equal frequency, where a subword has its share of the
corpus. A class is told by its group first, then within the group. Texts are cut into windows of 24 subwords that overlap
by a third; a window scores its last two thirds only, so each subword is scored once, with 8 to 23 before it.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter
from itertools import islice
from math import ceil, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, ddl, forget, partitions, stored

#: Subwords of a window, those of them that it scores, and those before them.
WINDOW, STEP, BEFORE = 24, 16, 8
#: Width of the model and of its feed-forward layer; classes, of which the last BANDS are shared, and groups of them.
WIDTH, INNER, CLASSES, BANDS, GROUPS = 16, 32, 1024, 16, 32
#: Shares of the windows, in 64ths, that the rounds of training go through. Each ends by averaging the tasks' models, the
#: first ones soon, while these are still alike.
SHARES = (1, 1, 2, 4, 8, 16, 32)
#: Windows that a task learns from at least. A corpus of fewer is gone through again until there were so many, but so often
#: at most. Every corpus is learned from whole.
LEAST_WINDOWS, MOST_PASSES = 100_000, 6
#: Words sent to every task: as many as are at least so long in count, of at most so many bytes. The rarer ones are joined.
SENT_WORDS, SENT_BYTES = 200_000, 64
#: Smoothing of the word counts, which the task fixes, and of subwords within a class.
ALPHA = 0.1
#: Distinct words that a task holds at once, and code points of a word that are cut into subwords at once.
HELD, CUT = 300_000, 64
#: Words whose subwords a Python worker remembers, and words that are looked up together.
REMEMBERED, TOGETHER = 1_000_000, 200_000
#: Windows computed at once in scoring and in training.
BLOCK, LEARNED = 128, 64
#: Windows that are shuffled together in training.
MIXED = 32_768


class Subwords(dict):
    """Numbers of words (bytes), made on first use; `of` gives the uint16 subword ids of numbered words, in a rank file's
    vocabulary. Words beyond REMEMBERED start a new numbering, which `reset` tells."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size, self.resets = max(ranks.values()) + 1, 0
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ids, self.ends = array("H"), array("q")
        self.flat, self.last = np.empty(0, np.uint16), np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        text = " " + word.decode()
        for at in range(0, len(text), CUT):
            self.ids.extend(self.encoding.encode_ordinary(text[at : at + CUT]))
        self.ends.append(len(self.ids))
        self[word] = number = len(self.ends) - 1
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; words not seen before get one."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words, one after the other, and how many each word has."""
        if self.last.size < len(self.ends):
            self.flat, self.last = np.array(self.ids, np.uint16), np.array(self.ends, np.int64)
        starts = np.where(numbers > 0, self.last[numbers - 1], 0) if numbers.size else np.empty(0, np.int64)
        sizes = self.last[numbers] - starts
        shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[np.arange(shift.size) + shift], sizes

    def cut(self, texts):
        """(words, their numbers, subword ids with the end) of each text. Tables are renewed once for many texts."""
        held, n = [], 0
        for text in texts:
            if not held and len(self) >= REMEMBERED:
                self.clear()
                self.ids, self.ends, self.resets = array("H"), array("q"), self.resets + 1
                self.flat, self.last = np.empty(0, np.uint16), np.empty(0, np.int64)
            words = words_of(text)
            held.append((words, self.numbers(words)))
            n += len(words)
            if n >= TOGETHER:
                yield from self._cut(held)
                held, n = [], 0
        yield from self._cut(held)

    def _cut(self, held):
        for words, numbers in held:
            yield words, numbers, np.append(self.of(numbers)[0], np.uint16(self.size))


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """The vocabulary at `path`, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lowered."""
    return (text or "").encode().lower().split()


class Classes:
    """Classes of the subword ids 0 .. n (n is the end of a text), by their counts in the corpus: `of` each id its class,
    `within` its log10 share of the class; classes edges[g] .. edges[g + 1] - 1 are group g."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        heads = CLASSES - BANDS
        tail = order[heads:]
        mass = np.cumsum(counts[tail] + ALPHA)
        self.of = np.empty(counts.size, np.int64)
        self.of[order[:heads]] = np.arange(heads)
        self.of[tail] = heads + np.minimum(BANDS - 1, (mass - (counts[tail] + ALPHA)) * BANDS / mass[-1]).astype(np.int64)
        self.total = np.bincount(self.of, counts + ALPHA, minlength=CLASSES) + ALPHA
        self.within = np.log10((counts + ALPHA) / np.bincount(self.of, counts + ALPHA, minlength=CLASSES)[self.of])
        roots = np.cumsum(np.sqrt(self.total))  # groups of equal sums of roots: small ones of frequent classes
        self.group = np.minimum(GROUPS - 1, (roots - np.sqrt(self.total)) * GROUPS / roots[-1]).astype(np.int64)
        self.edges = np.searchsorted(self.group, np.arange(GROUPS + 1))

    def first_bias(self) -> tuple[np.ndarray, np.ndarray]:
        """Logs of the groups' and of the classes' shares."""
        sums = np.bincount(self.group, self.total, minlength=GROUPS) + ALPHA
        return np.log(sums / sums.sum()).astype(np.float32), np.log(self.total / sums[self.group]).astype(np.float32)


#: Slots of the embedding besides the classes: the start of a text, and what lies before it or after its end.
START, PAD = CLASSES, CLASSES + 1


def windows(ids: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Slots (rows of STEP, one more row than windows) and classes to score (-1 where there is nothing) of a text's ids."""
    n = -(-ids.size // STEP)
    slots = np.full((n + 1) * STEP + 1, PAD, np.int16)
    slots[STEP] = START
    slots[STEP + 1 : STEP + 1 + ids.size] = classes.of[ids]
    goal = np.full(n * STEP, -1, np.int16)
    goal[: ids.size] = classes.of[ids]
    return slots[: (n + 1) * STEP].reshape(n + 1, STEP), goal.reshape(n, STEP)


def joined(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slots of the windows `at`: the end of a row of `windows` and the row after it."""
    return np.concatenate([rows[at, STEP - BEFORE :], rows[at + 1]], 1)


#: Which entry of `near` (the weight of a distance) each pair of a scored place and a place before it has; -1: not before it.
DISTANCE = (np.arange(STEP)[:, None] + BEFORE) - np.arange(WINDOW)[None, :]


def first_weights(classes: Classes, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    groups, within = classes.first_bias()
    return {
        "embed": (rng.standard_normal((PAD + 1, WIDTH)) * 0.5).astype(np.float32), "query": w(WIDTH, WIDTH), "key": w(WIDTH, WIDTH), "value": w(WIDTH, WIDTH), "mix": w(WIDTH, WIDTH) * 0.5,
        "near": np.zeros(WINDOW, np.float32), "up": w(WIDTH, INNER), "up0": np.zeros(INNER, np.float32), "down": w(INNER, WIDTH) * 0.5, "group": w(WIDTH, GROUPS) * 0.3, "group0": groups, "out": w(WIDTH, CLASSES) * 0.3, "out0": within,
    }


def masked(near: np.ndarray) -> np.ndarray:
    return np.where(DISTANCE >= 0, near[np.maximum(DISTANCE, 0)], near.dtype.type(-1e9))


def by_group(classes: Classes, at: np.ndarray):
    """(first class, end, positions in `at`) of each group that has classes in `at`."""
    group = classes.group[at]
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        yield classes.edges[k], classes.edges[k + 1], order[bounds[k] : bounds[k + 1]]


def surprise(z: np.ndarray, at: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Sum over rows of -log softmax(z)[at], divided by n, and its gradient by z."""
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1, keepdims=True)
    each = np.arange(at.size)
    loss = float((np.log(total[:, 0]) - z[each, at]).sum()) / n
    p /= total
    p[each, at] -= 1
    return loss, p / z.dtype.type(n)


def gradients(w: dict, classes: Classes, slots: np.ndarray, goal: np.ndarray) -> tuple[float, dict]:
    """Mean loss (natural logs) of windows (slots: n x WINDOW, goal: n x STEP) and its gradients."""
    flat = slots.reshape(-1).astype(np.int64)
    e = w["embed"][flat].reshape(-1, WINDOW, WIDTH)
    own = e[:, BEFORE:]
    scale = np.float32(WIDTH**-0.5)
    q, k, v = own @ w["query"], e @ w["key"], e @ w["value"]
    s = q @ k.transpose(0, 2, 1) * scale + masked(w["near"]) + np.where(slots == PAD, -1e9, 0).astype(e.dtype)[:, None, :]
    a = np.exp(s - s.max(2, keepdims=True))
    a /= a.sum(2, keepdims=True)
    o = a @ v
    h = own + o @ w["mix"]
    up = np.maximum(h @ w["up"] + w["up0"], 0)
    g = h + up @ w["down"]
    rows = lambda x: x.reshape(-1, x.shape[-1])
    there = np.flatnonzero(goal >= 0)
    at, n = goal.reshape(-1)[there].astype(np.int64), max(1, there.size)
    flat_g = rows(g)[there]
    loss, dz = surprise(flat_g @ w["group"] + w["group0"], classes.group[at], n)
    d = {"group": flat_g.T @ dz, "group0": dz.sum(0), "out": np.zeros_like(w["out"]), "out0": np.zeros_like(w["out0"])}
    dflat = dz @ w["group"].T
    for first, last, of in by_group(classes, at):
        more, dz = surprise(flat_g[of] @ w["out"][:, first:last] + w["out0"][first:last], at[of] - first, n)
        loss += more
        d["out"][:, first:last], d["out0"][first:last] = flat_g[of].T @ dz, dz.sum(0)
        dflat[of] += dz @ w["out"][:, first:last].T
    dg = np.zeros_like(rows(g))
    dg[there] = dflat
    dg = dg.reshape(g.shape)
    d["down"] = rows(up).T @ rows(dg)
    dup = (dg @ w["down"].T) * (up > 0)
    d["up"], d["up0"] = rows(h).T @ rows(dup), rows(dup).sum(0)
    dh = dg + dup @ w["up"].T
    d["mix"] = rows(o).T @ rows(dh)
    do = dh @ w["mix"].T
    da = do @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ do
    ds = a * (da - (da * a).sum(2, keepdims=True))
    d["near"] = np.bincount(np.maximum(DISTANCE, 0).reshape(-1), (ds.sum(0) * (DISTANCE >= 0)).reshape(-1), minlength=WINDOW).astype(e.dtype)
    dq, dk = ds @ k * scale, ds.transpose(0, 2, 1) @ q * scale
    d["query"], d["key"], d["value"] = rows(own).T @ rows(dq), rows(e).T @ rows(dk), rows(e).T @ rows(dv)
    de = dk @ w["key"].T + dv @ w["value"].T
    de[:, BEFORE:] += dh + dq @ w["query"].T
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    d["embed"] = np.zeros_like(w["embed"])
    d["embed"][flat[order][first]] = np.add.reduceat(rows(de)[order], first)
    return loss, d


class Adam:
    """Descent with moments, for one task's round."""

    def __init__(self, w: dict, rate: float):
        self.w, self.rate, self.t = {k: x.copy() for k, x in w.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, d: dict) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t)
        for k, x in d.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.02 * (x * x - self.v[k])
            self.w[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


class Scorer:
    """The trained model ready for scoring: what hangs on one subword only is a table by slot."""

    def __init__(self, w: dict, classes: Classes):
        self.classes, self.w = classes, w
        e = w["embed"]
        self.query, self.key, self.value = e @ w["query"] * np.float32(WIDTH**-0.5), e @ w["key"], e @ w["value"] @ w["mix"]
        self.bias = masked(np.clip(w["near"], -30, 30)).astype(np.float32)
        self.hidden = np.where(np.arange(PAD + 1) == PAD, np.float32(-1e9), np.float32(0))
        self.parts = {a: (np.ascontiguousarray(w["out"][:, a:b]), w["out0"][a:b]) for a, b in zip(classes.edges, classes.edges[1:])}
        # The largest sum of weights and bias of a class: exponents are cut only where they might overflow.
        size = lambda x: float(np.abs(x).max())
        self.wild = False
        self.widest = max(float(np.abs(w[k]).sum(0).max()) for k in ("group", "out")), max(size(w["group0"]), size(w["out0"]))
        self.sums = {n: np.ones(n, np.float32) for n in {WINDOW, GROUPS, *np.diff(classes.edges).tolist()}}  # faster than sum()

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text, given as subword ids with the end."""
        parts = [windows(ids, self.classes) for ids in texts]
        out = np.array([self.classes.within[ids].sum() for ids in texts])
        rows = np.concatenate([s for s, _ in parts]).astype(np.intp)
        goal = np.concatenate([g for _, g in parts]).astype(np.intp)
        sizes = np.array([len(g) for _, g in parts])
        first = np.repeat(np.arange(len(parts)), sizes) + np.arange(len(goal))  # a text has one row more than windows
        found = np.empty(len(goal))
        for i in range(0, len(goal), BLOCK * 32):  # groups of classes are gone through for many windows at once
            part = goal[i : i + BLOCK * 32]
            hidden = np.concatenate([self._hidden(rows, first[j : j + BLOCK]) for j in range(i, i + len(part), BLOCK)])
            found[i : i + len(part)] = self._log_share(hidden, part.reshape(-1)).reshape(-1, STEP).sum(1)
        return out + np.bincount(np.repeat(np.arange(len(parts)), sizes), found, minlength=len(parts)) / np.log(10)

    def _hidden(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the layers make of the windows `at`: a row for each place that is scored."""
        w, slots = self.w, joined(rows, at)
        own = slots[:, BEFORE:]
        s = self.query.take(own, 0) @ self.key.take(slots, 0).transpose(0, 2, 1)
        np.clip(s, -30, 30, out=s)
        s += self.bias
        starts = np.flatnonzero(slots[:, 0] == PAD)
        s[starts] += self.hidden[slots[starts]][:, None, :]
        np.exp(s, out=s)
        o = s @ self.value.take(slots, 0)
        o /= (s @ self.sums[WINDOW])[..., None]
        o += w["embed"].take(own, 0)
        h = o.reshape(-1, WIDTH)
        up = h @ w["up"]
        up += w["up0"]
        np.maximum(up, 0, out=up)
        h += up @ w["down"]
        return h

    def _log_share(self, h: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log probability of each place's class, 0 where there is none. Exponents are cut at +-60 to stay in range."""
        there = np.flatnonzero(goal >= 0)
        at = goal[there]
        h = h.take(there, 0)
        self.wild = h.size > 0 and float(np.abs(h).max()) * self.widest[0] + self.widest[1] > 60
        share = self._chosen(h, self.w["group"], self.w["group0"], self.classes.group[at]).astype(np.float64)
        for first, last, of in by_group(self.classes, at):
            if last - first > 1:
                share[of] += self._chosen(h.take(of, 0), *self.parts[first], at[of] - first)
        found = np.zeros(goal.size)
        found[there] = share
        return found

    def _chosen(self, h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = h @ weights
        z += bias
        if self.wild:
            np.clip(z, -60, 60, out=z)
        picked = z[np.arange(at.size), at]
        np.exp(z, out=z)
        return picked - np.log(z @ self.sums[z.shape[1]])


# ---- on Spark


def in_training(df: DataFrame, id_col: str):
    """crc32(id as text) mod 10 is not 0; a null id trains."""
    return F.coalesce(F.crc32(df[id_col].cast("long").cast("string").cast("binary")) % 10 != 0, F.lit(True))


def _map(df: DataFrame, fn, schema: list[tuple[str, str]]) -> DataFrame:
    """`df` through a generator of dicts of columns over its batches."""
    bounded_batches(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=out)

    return df.mapInArrow(run, ddl(schema))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): words of all texts. Tasks count before anything is shuffled."""
    def count(batches):
        total = Counter()
        told = lambda: {"word": list(total), "n": list(total.values())}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(words_of(text))
                if len(total) > HELD:
                    yield told()
                    total.clear()
        yield told()

    return _map(texts, count, [("word", "binary"), ("n", "long")]).groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(counts: DataFrame, path: str, size: int) -> np.ndarray:
    """How often each subword occurs in the counted words: one number per entry of the vocabulary."""
    def count(batches):
        total = np.zeros(size, np.int64)
        known = subwords(path)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            numbers = known.numbers(words)
            ids, sizes = known.of(numbers)
            total += np.bincount(ids, np.repeat(n, sizes), minlength=size).astype(np.int64)
        at = np.flatnonzero(total)
        yield {"id": at, "n": total[at]}

    found = np.zeros(size, np.int64)
    for r in _map(counts, count, [("id", "long"), ("n", "long")]).groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        found[r["id"]] = r["n"]
    return found


def training_windows(texts: DataFrame, path: str, classes) -> DataFrame:
    """(n, slots, goal, part): all windows of all texts, in blocks."""
    def cut(batches):
        known, found = subwords(path), classes.value
        slots, goal, held = [], [], 0

        def told():
            return {"n": [held], "slots": [np.concatenate(slots).astype(np.int16).tobytes()], "goal": [np.concatenate(goal).astype(np.int16).tobytes()]}

        for batch in batches:
            for _, _, ids in known.cut(batch.column(0).to_pylist()):
                rows, g = windows(ids, found)
                slots.append(joined(rows, np.arange(len(g))))
                goal.append(g)
                held += len(g)
                if held >= LEARNED * 8:
                    yield told()
                    slots, goal, held = [], [], 0
        if held:
            yield told()

    rows = _map(texts, cut, [("n", "long"), ("slots", "binary"), ("goal", "binary")])
    return rows.withColumn("part", F.pmod(F.xxhash64("slots"), F.lit(sum(SHARES))))


def together(batches, most: int | None):
    """The windows of blocks, as many as `most` or a few more at once, so that those of a text are spread; None: all."""
    slots, goal, n = [], [], 0
    for batch in batches:
        for s, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            slots.append(np.frombuffer(s, np.int16).reshape(-1, WINDOW))
            goal.append(np.frombuffer(g, np.int16).reshape(-1, STEP))
            n += len(slots[-1])
            if most is not None and n >= most:
                yield np.concatenate(slots), np.concatenate(goal)
                slots, goal, n = [], [], 0
    if slots:  # all of them only where there are no more than LEAST_WINDOWS
        yield np.concatenate(slots), np.concatenate(goal)


def train(blocks: DataFrame, w: dict, classes, n_windows: int) -> tuple[dict, list[float]]:
    """The weights after all rounds, and each round's mean loss. A round's tasks, one for LEAST_WINDOWS of the `n_windows`,
    each go through their windows from the same weights; what they come to is averaged by windows, in two steps, so the
    driver gets a bounded number of models. Fewer windows than LEAST_WINDOWS are gone through again, the last time in
    part, so the number of steps has no jump there."""
    spark = blocks.sparkSession
    names = list(w)
    shapes = {k: w[k].shape for k in names}
    pack = lambda x: np.concatenate([x[k].reshape(-1) for k in names]).astype(np.float64)
    schema = [("sums", "binary"), ("n", "long"), ("loss", "double")]

    def unpack(x):
        out, at = {}, 0
        for k in names:
            size = int(np.prod(shapes[k]))
            out[k] = x[at : at + size].reshape(shapes[k]).astype(np.float32)
            at += size
        return out

    losses = []
    passes = min(MOST_PASSES, max(1.0, LEAST_WINDOWS / max(1, n_windows)))
    blocks = blocks.coalesce(max(1, n_windows // LEAST_WINDOWS))
    for number, share in enumerate(SHARES):
        first = sum(SHARES[:number])
        sent = spark.sparkContext.broadcast(w)
        rate = 0.025 * (1 - number / (len(SHARES) - 1)) + 0.0025

        def learn(batches, sent=sent, rate=rate, number=number):
            model, n, loss = Adam(sent.value, rate), 0, 0.0
            rng = np.random.default_rng(number)
            for slots, goal in together(batches, MIXED if passes == 1 else None):
                for turn in range(ceil(passes)):
                    order = rng.permutation(len(slots))[: ceil(len(slots) * min(1.0, passes - turn))]
                    for i in range(0, len(slots), LEARNED):
                        at = order[i : i + LEARNED]
                        lost, d = gradients(model.w, classes.value, slots[at], goal[at])
                        model.step(d)
                        loss, n = loss + lost * at.size, n + at.size
            if n:
                yield {"sums": [(pack(model.w) * n).tobytes()], "n": [n], "loss": [loss]}

        def add(batches):
            total = None
            for batch in batches:
                for s, n, loss in zip(*(c.to_pylist() for c in batch.columns)):
                    x = np.frombuffer(s)
                    total = (x.copy(), n, loss) if total is None else (total[0] + x, total[1] + n, total[2] + loss)
            if total:
                yield {"sums": [total[0].tobytes()], "n": [total[1]], "loss": [total[2]]}

        models = _map(blocks.where((F.col("part") >= first) & (F.col("part") < first + share)).select("slots", "goal"), learn, schema)
        sums = _map(models.repartition(MERGERS), add, schema).collect()  # MERGERS rows
        n = sum(r["n"] for r in sums)
        if n:
            w = unpack(sum(np.frombuffer(r["sums"]) for r in sums) / n)
            losses.append(sum(r["loss"] for r in sums) / n)
        sent.unpersist()
    return w, losses


#: Tasks that add up the models of a round.
MERGERS = 8


def sent_words(counts: DataFrame, most: int = SENT_WORDS) -> tuple[dict[bytes, int], int]:
    """The commonest words and their counts, and the count from which words belong to them: at most `most`.

    The count is found in a histogram of 8 steps for every doubling, without sorting the words.
    """
    step = F.floor(8 * F.log2("n"))
    of = {r["s"]: (r["c"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()}  # 8 * 63 rows
    total, least = 0, 1 << 62
    for s in sorted(of, reverse=True):
        total += of[s][0]
        if total > most:
            break
        least = of[s][1]
    rows = counts.where((F.col("n") >= least) & (F.octet_length("word") <= SENT_BYTES)).collect()  # at most `most` short words
    return {bytes(r["word"]): r["n"] for r in rows}, least


class Model:
    """What scoring needs: counts of words (a table, and the commonest in a dict), totals, classes and weights."""

    def __init__(self, path, counts, common, least, docs, classes, weights, losses):
        self.path, self.counts, self.common, self.least, self.docs, self.classes, self.weights, self.losses = path, counts, common, least, docs, classes, weights, losses
        self.total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + docs
        self.distinct = counts.count() + (docs > 0)


def learn(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_sent: int = SENT_WORDS) -> Model:
    """Count the words and subwords of all training texts, and train the attention model on their windows."""
    spark = df.sparkSession
    texts = df.where(in_training(df, id_col)).select(df[text_col].cast("string").alias("t"))
    docs = texts.count()
    counts = stored(word_counts(texts))
    size = subwords(path).size
    found = np.append(subword_counts(counts, path, size), docs)
    classes = Classes(found)
    sent = spark.sparkContext.broadcast(classes)
    blocks = stored(training_windows(texts, path, sent))
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights, losses = train(blocks, first_weights(classes), sent, n)
    forget(blocks)
    common, least = sent_words(counts, most_sent)
    return Model(path, counts, common, least, docs, classes, weights, losses)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `df`.

    Scores are log10 probabilities of the text with its end: `base_score` of words by smoothed counts, `score` of subwords
    by the attention model. A null or empty text is its end alone; a null id counts as training; equal texts have equal
    scores; an empty table gives none, and without training texts every subword is equally likely. Long texts take time by
    their length; a task holds the windows of a batch.
    """
    spark = df.sparkSession
    under = np.log10(model.total + ALPHA * (model.distinct + 1))
    sent = spark.sparkContext.broadcast((model.common, model.classes, model.weights))
    path, end_log = model.path, float(np.log10(model.docs + ALPHA))
    schema = [("doc_id", "long"), ("held_out", "boolean"), ("n", "long"), ("known", "long"), ("sum", "double"), ("score", "double"), ("words", "array<binary>"), ("times", "array<long>")]
    docs_known = int(model.docs > 0)

    def rows(batches):
        known = subwords(path)
        common, classes, weights = sent.value
        scorer, logs, resets = Scorer(weights, classes), np.empty(0), -1
        for batch in batches:
            out = {name: [] for name, _ in schema}
            out["doc_id"], out["held_out"] = batch.column(0), batch.column(2)
            texts, held = [], 0
            for words, numbers, ids in known.cut(batch.column(1).to_pylist()):
                if resets != known.resets or logs.size < len(known):  # log10 of the counts of numbered words, 0 of those not sent
                    logs = logs if resets == known.resets else np.empty(0)
                    fresh = list(islice(known, logs.size, None))
                    logs = np.append(logs, [log10(common[w] + ALPHA) if w in common else 0.0 for w in fresh])
                    resets = known.resets
                at = logs[numbers]
                other = np.flatnonzero(at == 0)
                rest = Counter([words[i] for i in other])
                out["n"].append(len(words) + 1)
                out["known"].append(len(words) - other.size + docs_known)
                out["sum"].append(float(at.sum()) + end_log)
                out["words"].append(list(rest))
                out["times"].append(list(rest.values()))
                texts.append(ids)
                held += texts[-1].size
                if held > 1 << 18:
                    out["score"] += scorer.scores(texts).tolist()
                    texts, held = [], 0
            if texts:
                out["score"] += scorer.scores(texts).tolist()
            yield out

    ready = df.select(df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t"), ~in_training(df, id_col))
    scored = stored(_map(ready, rows, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("_w")).select("row", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    rare = model.counts.where((F.col("n") < model.least) | (F.octet_length("word") > SENT_BYTES))
    more = rest.join(rare, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("n") + ALPHA) - np.log10(ALPHA))).alias("gain"))
    out = scored.drop("words", "times").join(more, "row", "left")
    unknown = F.col("n") - F.col("known") - (1 - docs_known)  # words; the end is in the sum
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
                      (F.col("sum") + unknown * float(np.log10(ALPHA)) + F.coalesce("gain", F.lit(0.0)) - F.col("n") * float(under)).alias("base_score"), "score")
