"""Quality classifier: similarity-weighted votes of nearest labelled neighbours in a latent semantic space.

Texts become hashed term vectors (words and a few terms that describe their shape), weighted by term frequency and
inverse document frequency over all documents, and are projected on the leading singular vectors of a bounded labelled
sample. The sample's latent vectors are broadcast; every document's cosines with all of them are exact blocked products,
and a neighbour votes with the fourth power of its cosine, so that the nearest count most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collected, is_space, steps, text_bytes, word_hashes, words_of

#: Labelled rows of each class at most that the space is fit on and whose vectors are broadcast.
SAMPLE_PER_CLASS = 1500
TERMS = 1 << 14
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Documents whose cosines are computed in one product.
ROWS = 512
#: Shape terms: (number of steps, weight of such a term against a word's).
SHAPES = 6
SHAPE_STEPS = 12
SHAPE_WEIGHT = 6.0


def _shape_steps(raw: np.ndarray, offsets: np.ndarray, firsts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """For each document the step (0 to SHAPE_STEPS - 1) of each of its SHAPES statistics."""
    words = np.maximum(np.diff(firsts), 1)

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    filled = np.maximum(count(~is_space(raw)), 1)
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>!?={}[]\\^~_")] = True
    ratios = [
        distinct / words,
        count((raw >= 65) & (raw <= 90)) / filled,
        np.sqrt(count(symbols[raw]) / words / 2),
        count((raw >= 48) & (raw <= 57)) / filled,
        np.minimum(filled / words / 24, 1),
        np.log2(words + 1) / 16,
    ]
    return np.minimum((np.clip(np.stack(ratios), 0, 1) * SHAPE_STEPS).astype(np.int64), SHAPE_STEPS - 1)


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, weight) of all terms of some documents; weight is 1 + log of the count, more for a shape."""
    n = len(offsets) - 1
    starts, ends, firsts = words_of(raw, offsets)
    term = (word_hashes(raw, starts, ends) % np.uint64(TERMS)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    pair, count = np.unique(doc * TERMS + term, return_counts=True)
    of, term = pair // TERMS, pair % TERMS
    shape = _shape_steps(raw, offsets, firsts, np.bincount(of, minlength=n))
    names = TERMS + np.arange(SHAPES)[:, None] * SHAPE_STEPS + shape
    doc = np.concatenate([of, np.tile(np.arange(n), SHAPES)])
    return doc, np.concatenate([term, names.ravel()]), np.concatenate([1 + np.log(count), np.full(names.size, SHAPE_WEIGHT)]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    projection: np.ndarray  # terms x DIMENSIONS, with the inverse document frequency in it
    vectors: np.ndarray  # unit latent vectors of the sample
    votes: np.ndarray  # its labels, 0 or 1


def latent(raw: np.ndarray, offsets: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit latent vectors of some documents."""
    doc, term, weight = term_counts(raw, offsets)
    order = np.argsort(doc, kind="stable")
    doc, term, weight = doc[order], term[order], weight[order]
    n = len(offsets) - 1
    out = np.zeros((n, projection.shape[1]), np.float32)
    first = np.searchsorted(doc, np.arange(n + 1))
    begin = 0
    while begin < n:  # every document has its shape terms, so no segment is empty
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + 60_000, "right")) - 1)
        a, b = first[begin], first[end]
        out[begin:end] = np.add.reduceat(projection[term[a:b]] * weight[a:b, None], first[begin:end] - a, axis=0)
        begin = end
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


#: All terms: hashed words, then the steps of shapes.
SIZE = TERMS + SHAPES * SHAPE_STEPS
VECTOR = "terms binary, weights binary"


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray) -> Model:
    """The latent space and labelled vectors of a sample of (terms, weights, label); without rows, a model that scores 0.5."""
    if not rows:
        return Model(np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    matrix = np.zeros((len(rows), SIZE), np.float32)
    for own, (term, weight, _) in zip(matrix, rows, strict=True):
        own[term] = weight
    matrix *= idf
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    dims = min(DIMENSIONS, *matrix.shape)
    # Randomised range finding with two power steps, then an exact decomposition of the small matrix.
    basis = np.linalg.qr(matrix @ np.random.default_rng(7).standard_normal((SIZE, min(dims + 16, len(rows))), dtype=np.float32))[0]
    for _ in range(2):
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    right = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:dims]
    projection = (right.T * idf[:, None]).astype(np.float32)
    own = matrix @ right.T
    return Model(projection, own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12), np.array([r[2] for r in rows], np.float32))


def votes(model: Model, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores from 0 to 1: the most similar labelled vectors vote with the fourth power of their cosine (never below 0).

    Cosines count in steps of 1e-5, and all that are as similar as the last of ``neighbours`` vote with it, so neither
    ties nor the block that a document is computed in change its score.
    """
    if not len(model.vectors):
        return np.full(len(vectors), 0.5)
    out = np.empty(len(vectors))
    k = min(neighbours, len(model.vectors))
    for a in range(0, len(vectors), ROWS):
        similar = np.round(vectors[a : a + ROWS] @ model.vectors.T, 5)
        least = np.partition(similar, -k, axis=1)[:, -k]
        doc, near = np.nonzero(similar >= least[:, None])
        weight = np.maximum(similar[doc, near], 0).astype(np.float64) ** 4 + 1e-9
        n = len(similar)
        out[a : a + ROWS] = np.bincount(doc, weight * model.votes[near], n) / np.bincount(doc, weight, n)
    return np.clip(out, 0, 1)


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Inverse document frequency of every term, over all documents; one row for each term and task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in steps(offsets):
                total[:SIZE] += np.bincount(term_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1], minlength=SIZE)
            n += batch.num_rows
        total[SIZE] = n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], names=["term", "n"])

    counts = np.zeros(SIZE + 1)
    for r in collected(docs.select(text_col).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))):
        counts[r["term"]] = r["n"]
    return (np.log((1 + counts[SIZE]) / (1 + counts[:SIZE])) + 1).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Terms, weights and label of up to SAMPLE_PER_CLASS labelled documents of each class, first in a seeded order of the
    labelled ids; only ids whose CRC-32 mod 5 is not 0 are taken. Whole texts of any length become vectors of at most
    SIZE terms before they leave the executors. Of rows equal in id the smallest text counts."""
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    ids = ids.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    picked = None
    for label in (0, 1):
        own = ids.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_CLASS)
        picked = own if picked is None else picked.unionAll(own)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for a, b in steps(offsets):
                doc, term, weight = term_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                order = np.lexsort((term, doc))
                ends = np.searchsorted(doc[order], np.arange(b - a + 1))
                cut = lambda x, kind: [x[order][i:j].astype(kind).tobytes() for i, j in zip(ends, ends[1:], strict=False)]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(cut(term, np.int32), pa.binary()), pa.array(cut(weight, np.float32), pa.binary())], names=["id", "label", "terms", "weights"])

    # At most 2 * SAMPLE_PER_CLASS pairs of numbers are broadcast, and as many vectors of at most SIZE terms come back.
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text.alias("_text")).join(F.broadcast(picked), F.col(id_col) == F.col("_id")).groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    rows = sorted(collected(rows.select("_id", "_label", "_text").mapInArrow(run, f"id {kind}, label int, {VECTOR}")), key=lambda r: (r["id"], r["label"]))
    return [(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["weights"], np.float32), r["label"]) for r in rows]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of every document, from its whole text alone; a null text scores as the empty one.

    Equal texts score equally wherever they stand, rows may repeat and ids may be null; an empty table gives an
    empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            scores = [np.zeros(0)]
            for a, b in steps(offsets):
                scores.append(votes(own, latent(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], own.projection)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.concatenate(scores), 6))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, held_out (never learned from), score and predicted (1 from THRESHOLD on). Labels that are null, of
    another value or of absent documents do not count; without any label every score is 0.5."""
    scored = score(docs, fit(labelled_sample(docs, labels, id_col, text_col, label_col), document_frequencies(docs, text_col)), id_col, text_col)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality_knn(spark, sf_dir):
    """Contract query: doc_id, held_out, score and predicted of every whole text of ``documents``; see ``classify`` and
    ``score`` for nulls, empty texts, repeated rows and empty tables."""
    from .common import load

    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
