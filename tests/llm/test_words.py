"""Spelling variants, periodic runs and the language model against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from leaseweave.llm import attention, periodic, variants

SCHEMA = "doc_id long, text string, word string, n long, root string, form string, n_near long"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that the operators use inside."""
    rows = [(i, x, "word", 1, "root", "form", 2) for i, x in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", " ", "one", "éclairs", "é" * 5000, "wordle " * 30_000, "\x00\n\t", "😀 abcdef", "same text of some words here", "same text of some words here"]


# ---- spelling variants


def edited(word):
    """All strings one edit away, over the letters in use."""
    letters = "abcdefgéxyzq"
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters if c != word[i])


def plain_variants(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, near = {}, {}
    for w in n:
        found = {v for v in edited(w) if v in n}
        near[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], near[w], n.get(form.get(w)))
    return out


@pytest.mark.parametrize("shard_halves", [50_000, 7])
def test_variants_equal_plain_loops(spark, shard_halves):
    rng = random.Random(5)
    vocabulary = {"abcdef", "abcdefg", "abcabcabc"}
    while len(vocabulary) < 300:  # few letters, common beginnings: dense in near words
        vocabulary.add(rng.choice(["abc", "abc", "dddd", ""]) + "".join(rng.choice("abcdefgé") for _ in range(rng.randint(3, 5))))
    vocabulary |= {w[:i] + c + w[i:] for w in list(vocabulary)[:60] for i, c in [(rng.randrange(len(w)), "e")]}
    weights = {w: rng.choice([1, 1, 2, 12, 70, 400]) for w in sorted(vocabulary)}
    words = rng.choices(list(weights), weights=weights.values(), k=40_000)
    texts = [" 1".join(words[i : i + 400]).replace("dddd", "Dddd") for i in range(0, len(words), 400)]
    got = {r["word"]: tuple(r)[1:] for r in variants.variant_groups(docs(spark, texts), shard_halves=shard_halves).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(list(enumerate(texts)))
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20


def test_roots_end_the_chain_of_forms(spark):
    texts = ["zabcde 1 " * 3, " ".join(["abcdefx"] * 5 + ["abcdefxy"] * 40 + ["abcdefxyz"] * 300 + ["Qbcdefxyz"] * 1500)]
    got = {r["word"]: (r["form"], r["root"]) for r in variants.variant_groups(docs(spark, texts)).collect()}
    want = {w: v[:2] for w, v in plain_variants(list(enumerate(texts))).items()}
    assert {w: got[w][1] for w in want} == {w: "qbcdefxyz" for w in want} and got["abcdefx"][0] == "abcdefxy"


def test_variants_of_crowded_halves():
    """Words that share a half are searched by automata of their other halves, to the last letter."""
    rng = random.Random(3)
    words = sorted({"abcabc" + "".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(400)} | {"".join(rng.choice("ab") for _ in range(6)) + "xyzxyz" for _ in range(60)})
    halves = variants.Halves(words)
    for text in words:
        got = sorted(halves.find(text))
        assert got == [i for i, w in enumerate(words) if w != text and len(w) - len(text) in (0, 1) and variants.one_edit(w, text)]


def test_variants_of_odd_tables(spark):
    out = variants.variant_groups(docs(spark, ODD, [*range(len(ODD) - 1), None])).collect()
    assert [tuple(r) for r in out if r["word"] == "wordle"] == [("wordle", None, "wordle", 30_000, 0, None)]
    assert variants.variant_groups(docs(spark, []).where("doc_id < 0")).count() == 0
    five = variants.variant_groups(docs(spark, ["Banana"] * 5, [1] * 5)).collect()  # equal rows count again
    assert [tuple(r) for r in five] == [("banana", None, "banana", 5, 0, None)]


# ---- periodic runs


def plain_runs(words):
    """Every stretch of every period by comparing words, without those that have a smaller period."""
    n, spans = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                spans.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, size, q) for (a, size), q in spans.items())


def plain_digests(key, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{a},{size},{q}\n" for a, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def periodic_texts():
    rng = random.Random(11)
    word = lambda k=30: f"w{rng.randrange(k)}"
    texts = [" ".join(word(1000) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    for _ in range(80):
        q = rng.randint(1, 40)
        unit = [word() for _ in range(q)]
        part = (unit * 40)[: rng.randint(20, 6 * q + 30)]
        more = ([word(4) for _ in range(rng.randint(1, 4))] * 30)[: rng.randint(0, 80)]
        texts.append("\t\n".join([word() for _ in range(rng.randint(0, 30))] + part + [word() for _ in range(rng.randint(0, 9))] + more + part[: rng.randint(0, 60)]))
    texts += [" ".join("a" for _ in range(n)) for n in (2, 23, 24, 25, 300)] + [" ".join(["a b"] * 200), " ".join(("a " * 30 + "b ") * 9 for _ in range(3))]
    texts += [" ".join(rng.choice("ab") for _ in range(400)) for _ in range(10)]
    texts += ["x" * 99 + " y z\x85" + " q" * 30, "p q r " * 500 + "tail", " ".join(str(i % 700) for i in range(2500))]
    return texts


def test_runs_equal_plain_loops(spark):
    texts = periodic_texts()
    found = periodic.run_digests(periodic.repeat_runs(periodic.with_planted_runs(docs(spark, texts)))).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in found}
    assert list(found[0].asDict()) == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {i: plain_digests(i, t) for i, t in enumerate(texts)}
    assert got == want
    assert sum(v[0] > 1 for v in want.values()) > 20


def test_names_tell_how_far_places_agree():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 200)
    names = periodic.Names(np.unique(words, return_index=True)[1][words])
    while names.add():
        pass
    for a, b in [(i, j) for i in range(0, 150, 7) for j in range(i + 1, 200, 13)]:
        ahead = next((k for k in range(200 - b) if words[a + k] != words[b + k]), 200 - b)
        behind = next((k for k in range(a) if words[a - 1 - k] != words[b - 1 - k]), a)
        assert (names.ahead(np.array([a]), np.array([b]))[0], names.behind(np.array([a]), np.array([b]))[0]) == (ahead, behind)


def test_runs_of_odd_tables(spark):
    f = lambda df: periodic.repeat_runs(df)
    out = {r["doc_id"]: r for r in f(docs(spark, ODD, [*range(len(ODD) - 1), None])).collect()}
    assert len(out) == len(ODD) and (out[6]["starts"], out[6]["lengths"], out[6]["periods"], out[6]["collapsed"]) == ([0], [30_000], [1], "wordle")
    assert out[0]["n_words"] == out[1]["n_words"] == 0 and out[0]["collapsed"] == "" and out[9]["collapsed"] == out[None]["collapsed"]
    assert f(docs(spark, []).where("doc_id < 0")).count() == 0 and f(docs(spark, ["a b", "a b"], [1, 1])).count() == 2
    assert periodic.with_planted_runs(docs(spark, ODD, [None] * len(ODD))).where("text IS NULL").count() == 1
    long = " ".join(str(i * i % 99_991) for i in range(300_000))  # longer than a batch
    assert len(f(docs(spark, [long + " " + long])).first()["starts"]) == len(plain_long(long))


def plain_long(long):
    """i * i modulo a prime has that period from both sides; the text twice begins anew in the middle."""
    words = (long + " " + long).split()
    return [r for r in ((0, 300_000, 99_991), (300_000, 300_000, 99_991)) if all(words[i] == words[i + r[2]] for i in range(r[0], r[0] + r[1] - r[2]))]


# ---- language model


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def some_weights(seed=3, n=1100, dtype=np.float64):
    rng = np.random.default_rng(seed)
    classes = attention.Classes(np.sort(rng.integers(0, 900, n))[::-1].copy())
    return {k: x.astype(dtype) + rng.standard_normal(x.shape).astype(dtype) * 0.1 for k, x in attention.first_weights(classes).items()}, classes


def plain_score(w, classes, ids):
    """log10 probability by one subword after the other, each with the window it has."""
    total = 0.0
    tokens = [attention.START, *classes.of[ids].tolist()]
    for t, goal in enumerate(classes.of[ids].tolist()):
        first = max(0, t - t % attention.STEP - attention.BEFORE)  # a window begins BEFORE places before those it scores
        e = [w["embed"][x] for x in tokens[first : t + 1]]
        q = e[-1] @ w["query"]
        s = np.array([q @ (x @ w["key"]) / np.sqrt(attention.WIDTH) + w["near"][len(e) - 1 - i] for i, x in enumerate(e)])
        a = np.exp(s) / np.exp(s).sum()
        h = e[-1] + sum(p * (x @ w["value"]) for p, x in zip(a, e)) @ w["mix"]
        g = h + np.maximum(h @ w["up"] + w["up0"], 0) @ w["down"]
        group = classes.group[goal]
        low, high = classes.edges[group], classes.edges[group + 1]
        for z, at in ((g @ w["group"] + w["group0"], group), ((g @ w["out"] + w["out0"])[low:high], goal - low)):
            total += (z[at] - np.log(np.exp(z).sum())) / np.log(10)
    return total + classes.within[ids].sum()


def test_windows_score_each_subword_once():
    rng = np.random.default_rng(1)
    w, classes = some_weights()
    texts = [rng.integers(0, 1100, n) for n in (1, 2, 15, 16, 17, 31, 32, 33, 200)]
    got = attention.Scorer({k: x.astype(np.float32) for k, x in w.items()}, classes).scores(texts)
    assert np.allclose(got, [plain_score(w, classes, ids) for ids in texts], rtol=1e-4)
    # All continuations of a text together have the probability of the text.
    start = texts[4]
    every = attention.Scorer({k: x.astype(np.float32) for k, x in w.items()}, classes).scores([np.append(start, i) for i in range(1100)])
    assert abs((10 ** (every - plain_score(w, classes, start))).sum() - 1) < 1e-3


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    w, classes = some_weights()
    cut = [attention.windows(rng.integers(0, 1100, n), classes) for n in (5, 40)]
    slots = np.concatenate([attention.joined(r, np.arange(len(g))) for r, g in cut])
    goal = np.concatenate([g for _, g in cut])
    loss, d = attention.gradients(w, classes, slots, goal)
    assert loss > 0
    for name, x in w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape) if name != "embed" else (int(rng.choice(np.unique(slots[slots < attention.PAD]))), int(rng.integers(attention.WIDTH)))
            old = x[at]
            x[at] = old + 1e-5
            up = attention.gradients(w, classes, slots, goal)[0]
            x[at] = old - 1e-5
            down = attention.gradients(w, classes, slots, goal)[0]
            x[at] = old
            assert abs((up - down) / 2e-5 - d[name][at]) < 1e-6 + 1e-3 * abs(d[name][at]), name


def plain_base(rows):
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    train = [t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 10]
    c = Counter(w for t in train for w in words(t))
    total, distinct = sum(c.values()) + len(train), len(c) + 1
    log = lambda n: math.log10((n + 0.1) / (total + 0.1 * (distinct + 1)))
    return {k: (len(words(t)) + 1, sum(w in c for w in words(t)) + 1, total, sum(log(c[w]) for w in words(t)) + log(len(train))) for k, t in rows}


def test_model_beats_word_counts_on_held_out_texts(spark):
    """Sentences of a grammar that word counts can't see; the counts equal plain loops, with rare words joined."""
    rng = random.Random(4)
    nouns, verbs = ["dog", "cat", "house", "river", "teacher"], ["sees", "finds", "likes", "follows"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice(nouns)} and it Never {rng.choice(verbs)} item{rng.randrange(4000)}."
    texts = [" ".join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(700)] + ["", None, "\x85 x" + "y" * 5000]
    df = docs(spark, texts)
    model = attention.learn(df, vocabulary(), most_sent=40)
    assert 0 < len(model.common) <= 40 and model.losses[-1] < model.losses[0]
    got = {r["doc_id"]: r for r in attention.score(df, model).collect()}
    want = plain_base(list(enumerate(texts)))
    for k, (n, known, total, base) in want.items():
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-9 * abs(base), k
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 1 and r["n_tokens"] < 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) * 0.8


def test_model_of_odd_tables(spark):
    df = docs(spark, ODD, [*range(len(ODD) - 1), None])
    model = attention.learn(df, vocabulary())
    out = {r["doc_id"]: r for r in attention.score(df, model).collect()}
    assert len(out) == len(ODD) and out[9]["score"] == pytest.approx(out[None]["score"]) and out[0]["n_tokens"] == out[2]["n_tokens"] == 1 and out[6]["n_tokens"] == 30_001
    none = docs(spark, []).where("doc_id < 0")
    empty = attention.learn(none, vocabulary())
    assert attention.score(none, empty).count() == 0 and empty.total == 0
    rest = attention.score(docs(spark, ["a b", "a b"], [1, 1]), empty).collect()
    assert len(rest) == 2 and rest[0]["n_known"] == 0 and rest[0]["base_score"] == 0 and rest[0]["score"] < -10


def test_model_learns_from_all_windows_at_any_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [" ".join(f"w{(i * 7 + j) % 50}" for j in range(90)) for i in range(60)]
    df = docs(spark, texts)
    monkeypatch.setattr(attention, "LEAST_WINDOWS", 20)  # of a corpus of 32 times as many one window in 4 was taken, of one text in 8
    seen = []
    train = attention.train
    monkeypatch.setattr(attention, "train", lambda blocks, *more: (seen.append(blocks.agg(F.sum("n")).first()[0]), train(blocks, *more))[1])
    attention.learn(df, vocabulary())
    known = attention.subwords(vocabulary())
    own = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    assert seen == [sum(-(-ids.size // attention.STEP) for *_, ids in known.cut(own))] and seen[0] > 20 * 32
