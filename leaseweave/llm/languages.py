"""Language mixtures: a document is a blend of languages, each a distribution over byte trigrams.

Learning counts trigrams of labelled documents by language. Prediction runs expectation-maximisation for the
proportions of a document, then grows its language set while the likelihood gained exceeds a penalty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, ddl, held_out
from .grams import counts, groups, trigrams

BITS = 15
#: Change of a proportion at which expectation-maximisation ends, steps at most, and the likelihood (nats per log of the
#: trigram count) a further language must gain.
CLOSE, STEPS, PENALTY = 1e-4, 1000, 5.0
#: Letters stay; other ASCII bytes are one separator.
TABLE = np.array([c if 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)

SCHEMA = [("doc_id", "long"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"), ("langs", "string")]


def folded(text: str | None) -> bytes:
    return f" {(text or '').lower()} ".encode()


def trigram_counts(df: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, code, n) over all rows with a text and a language; each task adds up its partition first."""
    bounded_batches(df.sparkSession)
    schema = [("lang", "string"), ("code", "long"), ("n", "long")]

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pydict()
            langs = sorted(set(rows["l"]))
            number = {x: i for i, x in enumerate(langs)}
            data, which = [folded(t) for t in rows["t"]], np.array([number[x] for x in rows["l"]], np.int64)
            for at in groups(data):
                for part in [[data[i] for i in at]] if len(at) > 1 else ([data[at[0]][i : i + (1 << 22) + 2]] for i in range(0, len(data[at[0]]), 1 << 22)):
                    owner, code = trigrams(part, TABLE, 8, BITS)
                    n = np.bincount(which[at][owner] << BITS | code, minlength=len(langs) << BITS).reshape(len(langs), -1)
                    for x, row in zip(langs, n):
                        totals[x] = totals.get(x, 0) + row
        for x, row in totals.items():
            code = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [x] * code.size, "code": code, "n": row[code]}, schema=arrow_schema(schema))

    part = df.select(text.cast("string").alias("t"), lang.cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    return part.mapInArrow(run, ddl(schema)).groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Mixtures:
    """Language names and P(code | language); 2^BITS rows by languages, whatever the corpus holds."""

    def __init__(self, langs: list[str], codes: np.ndarray, counts: np.ndarray):
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        n = np.full((1 << BITS, len(self.langs)), 0.5)
        n[codes, [number[x] for x in langs]] += counts
        self.p = (n / n.sum(axis=0)).astype(np.float32)

    def blend(self, owner, starts, p, n, total, allowed):
        """Proportions of each text over its `allowed` languages, and the log likelihood."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        size = np.diff(np.r_[starts, owner.size])
        going = np.flatnonzero(allowed.sum(axis=1) > 1)  # texts whose proportions still change
        for step in range(STEPS):
            if not going.size:
                break
            if step % 4 == 0:  # their rows; texts are dropped as they come to rest
                first = np.r_[0, np.cumsum(size[going])[:-1]]
                rows = np.repeat(starts[going] - first, size[going]) + np.arange(size[going].sum())
                own, some, count = np.repeat(np.arange(going.size), size[going]), p[rows], n[rows]
            w = some * share[going][own]
            w *= (count / w.sum(axis=1))[:, None]
            new = np.add.reduceat(w, first, axis=0) / total[going, None]
            moved = np.abs(new - share[going]).max(axis=1) > CLOSE
            share[going] = new
            if step % 4 == 3:
                going = going[moved]
        return share, np.add.reduceat(n * np.log((p * share[owner]).sum(axis=1)), starts)

    def predict(self, texts: list[str | None]):
        """(language or und, its share, all languages with shares) of each text."""
        out = [("und", 0.0, "")] * len(texts)
        use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        for at, owner, code, n in counts([folded(texts[i]) for i in use], TABLE, 8, BITS):
            p, n = self.p[code], n.astype(np.float32)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total = np.add.reduceat(n, starts)
            alone = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
            best = alone.argmax(axis=1)
            docs = np.arange(len(at))
            allowed = np.zeros(alone.shape, np.float32)
            allowed[docs, best] = 1
            share, likelihood = allowed.copy(), alone.max(axis=1)
            free, _ = self.blend(owner, starts, p, n, total, np.ones_like(allowed))
            order = np.argsort(-free, axis=1, kind="stable")
            going = docs
            for k in range(len(self.langs)):
                going = going[allowed[going].sum(axis=1) >= k]  # those that took each language offered so far
                offer = order[going, k]
                new = allowed[going, offer] == 0
                going_now, offer = going[new], offer[new]
                if not going_now.size:
                    continue
                rows = np.flatnonzero(np.isin(owner, going_now))
                wider = allowed[going_now].copy()
                wider[np.arange(going_now.size), offer] = 1
                sub = np.searchsorted(going_now, owner[rows])
                at_sub = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
                s, l = self.blend(sub, at_sub, p[rows], n[rows], total[going_now], wider)
                took = l - likelihood[going_now] > PENALTY * np.log(total[going_now] + 2)
                ids = going_now[took]
                allowed[ids], share[ids], likelihood[ids] = wider[took], s[took], l[took]
            top = share.argmax(axis=1)
            for j, i in enumerate(at):
                mixed = sorted(((float(x), self.langs[a]) for a, x in enumerate(share[j]) if allowed[j, a]), reverse=True)
                out[use[i]] = (self.langs[top[j]], min(1.0, float(share[j, top[j]])), ",".join(f"{a}:{x:.3f}" for x, a in mixed))
        return out


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Mixtures:
    """Learn from every labelled document that is not held out; the driver gets 2^BITS counts a language, however large
    the corpus, and so do the executors."""
    found = trigram_counts(df.where(~held_out(id_col)), F.col(text_col), F.col(lang_col)).toArrow()
    return Mixtures(found["lang"].to_pylist(), found["code"].to_numpy().astype(np.int64), found["n"].to_numpy())


def identify(df: DataFrame, model: Mixtures, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the main language, its share, and the language set.

    `und` with score 0 if the text is null or has no letter (a character of a Unicode letter category), or if nothing
    was learned. Ties go to the first language by name. Only the text decides; repeated rows give repeated results, an
    empty table none. A long text is counted in parts, so memory is bounded.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            found = sent.value.predict(rows["t"])
            lang, score, langs = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": rows["k"], "held_out": rows["h"], "lang_pred": lang, "score": score, "langs": langs}, schema=arrow_schema(SCHEMA))

    part = df.select(F.col(id_col).cast("long").alias("k"), held_out(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(run, ddl(SCHEMA))
