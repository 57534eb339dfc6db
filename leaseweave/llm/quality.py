"""Nearest-neighbour quality: cosine votes of labelled documents in a latent-semantic space.

Terms are trigrams of character classes (letters by case, digits, white space, each punctuation mark) and repeated
neighbouring words. A truncated singular value decomposition of the labelled sample gives the space; every
document's cosines with all labelled vectors are computed in blocks, and its nearest vote by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded_batches, ddl, held_out
from .grams import counts

BITS, RANK, NEIGHBOURS = 10, 48, 15
#: Labelled documents learned from at most, by hash of their id; the broadcast vectors are no more than this by RANK.
LABELLED = 4096
ACCEPT = 0.7
#: Weight of the repeated-word terms against one trigram.
REPEAT_WEIGHT = 4.0
CLASS = np.array([
    1 if 97 <= c <= 122 or c > 127 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in (9, 10, 13, 32) else 5 + c % 27
    for c in range(256)
], np.uint8)
TERMS = (1 << BITS) + 3

SCHEMA = [("doc_id", "long"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def repeats(text: str) -> list[int]:
    """Words equal to the word before, to the second before, seen before anywhere, and all words, of the whole text."""
    words = text.split()
    return [sum(map(str.__eq__, words[k:], words)) for k in (1, 2)] + [len(words) - len(set(words)), len(words)]


def term_vectors(texts: list[str | None]) -> np.ndarray:
    """Square roots of term shares, unit length; an empty text is the zero vector."""
    data = [f" {t or ''} ".encode() for t in texts]
    out = np.zeros((len(texts), TERMS), np.float32)
    for at, owner, code, n in counts(data, CLASS, 5, BITS):
        out[at[owner], code] = n
    total = np.maximum(1, out.sum(axis=1, keepdims=True))
    out /= total
    for i, t in enumerate(texts):
        if t:
            one, two, seen, words = repeats(t)
            if words:
                out[i, -3:] = np.array([one, two, max(0, seen - words // 2)]) * (REPEAT_WEIGHT / words)
    np.sqrt(out, out=out)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


class Neighbours:
    """The latent space and the labelled vectors in it."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray):
        self.base = float(labels.mean()) if labels.size else 1.0
        self.mean = vectors.mean(axis=0) if len(vectors) else np.zeros(TERMS, np.float32)
        centred = (vectors - self.mean).astype(np.float64)
        _, axes = np.linalg.eigh(centred.T @ centred)
        self.axes = axes[:, ::-1][:, :RANK].astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.latent = self.project(vectors)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        out = (vectors - self.mean) @ self.axes
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the base rate where nothing is similar."""
        if not self.labels.size:
            return np.full(len(texts), self.base)
        k = min(NEIGHBOURS, self.labels.size)
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            cosine = self.project(term_vectors(texts[i : i + 256])) @ self.latent.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(0, np.take_along_axis(cosine, near, axis=1)) ** 4 + 1e-6
            out[i : i + 256] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", at_most: int = LABELLED) -> Neighbours:
    """Fit on at most `at_most` labelled documents that are not held out, taken by the hash of their id.

    Several labels of one id are averaged; null labels don't count. Only their bounded vectors reach the driver.
    """
    picked = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("k")).agg(F.avg(label_col).alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(at_most)
    )
    schema = [("y", "double"), ("v", "binary")]

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            yield pa.RecordBatch.from_pydict({"y": rows["y"], "v": [v.tobytes() for v in term_vectors(rows["t"])]}, schema=arrow_schema(schema))

    texts = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(picked), "k")
    first = texts.groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y"))  # one row for each labelled id
    rows = first.select("t", "y").mapInArrow(run, ddl(schema)).collect()
    rows.sort(key=lambda r: (bytes(r["v"]), r["y"]))
    vectors = np.frombuffer(b"".join(r["v"] for r in rows), np.float32).reshape(-1, TERMS)
    return Neighbours(vectors, np.array([r["y"] for r in rows]))


def scored(df: DataFrame, model: Neighbours, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: score and decision. Null texts are scored as empty ones; equal texts score equally, repeated
    rows are repeated, an empty table gives none. Time and memory go by the length of a text, which is read whole."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            score = sent.value.score(rows["t"])
            out = {"doc_id": rows["k"], "held_out": rows["h"], "score": score, "predicted": (score >= ACCEPT).astype(np.int32)}
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema(SCHEMA))

    part = df.select(F.col(id_col).cast("long").alias("k"), held_out(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    return part.mapInArrow(run, ddl(SCHEMA))


def keep_good(df: DataFrame, model: Neighbours, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text is accepted, with all their columns."""
    bounded_batches(df.sparkSession)
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(sent.value.score(batch.column(at).to_pylist()) >= ACCEPT))

    return df.mapInArrow(run, df.schema)
