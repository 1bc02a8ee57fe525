"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are the hashed words, and the hashed pairs and triples of its shape (letters, capitals, digits and each
mark as one sign, runs of a class as one); a word said twice running is a term, too. Counts are damped, weighted by inverse document frequency and projected on
the leading singular directions of a bounded sample of labelled rows (SAMPLE for each label). The sample's vectors are
broadcast; every document's cosine with each of them is computed exactly, block by block, and its K nearest vote with
their similarity. Votes are weighted so that the labels' shares among all labelled rows hold, not those of the sample.
Cosines are double precision, rounded to nine places, so that a score does not depend on what else is in its block; all
vectors that tie with the K-th nearest vote, too. Scores are rounded to nine places.

Nulls: labels without id or label teach nothing; a null or empty text has no terms and gets the share of label 1 as its
score. Texts are read whole. Repeated rows get the same score. Without labelled rows of both kinds the score is the
share of label 1 (one half if there are none). An empty table gives an empty result. Labels, language, source and id
play no part in a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each label in the sample, on average.
SAMPLE = 2000
TERMS, SHAPES = 2048, 2048
DIMENSIONS = 48
K = 25
BLOCK = 512
_CLASS = np.full(256, ord("a"), np.uint8)
_CLASS[:128] = np.arange(128)
for _low, _high, _as in ((97, 122, "a"), (65, 90, "A"), (48, 57, "0")):
    _CLASS[_low : _high + 1] = ord(_as)
_CLASS[[9, 11, 12, 13]] = 32


def terms(text: str) -> np.ndarray:
    """Counts of the hashed terms of a text."""
    raw = text.encode()
    shape = _CLASS[np.frombuffer(raw, np.uint8)]
    run = (shape == ord("a")) | (shape == ord("A")) | (shape == ord("0"))
    keep = np.ones(len(shape), bool)
    keep[1:] = ~(run[1:] & (shape[1:] == shape[:-1]))
    s = shape[keep].astype(np.uint32)
    two = (s[:-1] << np.uint32(8)) | s[1:]
    three = (two[:-1] << np.uint32(8)) | s[2:]
    signs = (np.concatenate([two, three | np.uint32(1 << 31)]) * np.uint32(0x9E3779B1)) >> np.uint32(21)
    words = np.fromiter(map(xxhash.xxh32_intdigest, raw.lower().split()), np.uint32)
    again = np.full(4 * np.count_nonzero(words[1:] == words[:-1]), TERMS, np.uint32)
    return np.bincount(np.concatenate([words % np.uint32(TERMS), signs + np.uint32(TERMS), again]), minlength=TERMS + SHAPES)


def damped(text: str | None) -> np.ndarray:
    n = terms(text).astype(float) if text else np.zeros(TERMS + SHAPES)
    for part in (slice(0, TERMS), slice(TERMS, None)):
        total = n[part].sum()
        if total:
            n[part] = np.sqrt(n[part] / total)
    return n


@dataclass
class Model:
    prior: float
    idf: np.ndarray | None = None
    axes: np.ndarray | None = None  # terms x dimensions
    vectors: np.ndarray | None = None  # sample x dimensions, of length 1
    votes: np.ndarray | None = None  # weight of each sample row's vote
    labels: np.ndarray | None = None


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fitted(rows: list[tuple[str, int]], prior: float) -> Model:
    """rows(text, label) -> the broadcast model."""
    labels = np.array([label for _, label in rows])
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    x = np.stack([damped(t) for t, _ in rows])
    idf = np.log1p(len(rows) / (1 + (x > 0).sum(axis=0)))
    x *= idf
    q = np.random.default_rng(4).standard_normal((x.shape[1], DIMENSIONS + 16))
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    axes = q @ v.T[:, :DIMENSIONS]
    share = labels.mean()
    votes = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    return Model(prior, idf, axes, unit(x @ axes), votes, labels)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): only ids and labels are counted; the texts of the sample alone are gathered."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not sizes:
        return Model(0.5)
    prior = sizes.get(1, 0) / sum(sizes.values())
    share = F.create_map(*[F.lit(x) for q, n in sizes.items() for x in (q, min(1.0, SAMPLE / n))])[F.col("quality")]
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).distinct()
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "quality").distinct().collect()
    return fitted(sorted((r.text, r.quality) for r in rows), prior)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.vectors is None:
        return np.full(len(texts), model.prior)
    v = unit(np.stack([damped(t) for t in texts]) * model.idf @ model.axes)
    cosine = np.round(v @ model.vectors.T, 9)
    k = min(K, cosine.shape[1])
    least = np.partition(cosine, -k, axis=1)[:, -k, None]
    row, near = np.nonzero(cosine >= least)
    weight = np.maximum(cosine[row, near], 0) ** 4 * model.votes[near]
    good = np.bincount(row, weight * model.labels[near], minlength=len(texts))
    total = np.bincount(row, weight, minlength=len(texts))
    return np.clip(np.where(total > 0, np.round(good / np.where(total > 0, total, 1), 9), model.prior), 0, 1)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            texts = b.column("text")
            for at in range(0, b.num_rows, BLOCK):
                part = texts.slice(at, BLOCK).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, BLOCK), pa.array(scores(held.value, part), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")
