"""Quality classifier: nearest labelled neighbours in a latent-semantic space.

Terms of a document are hashed byte triplets and a few binned facts of its structure, weighted by log count and inverse
document frequency. A truncated singular value decomposition of the labelled sample gives the latent space. The sample's vectors
are broadcast (their number is bounded), and every document's exact cosines with all of them are computed in blocks; the
labels of the nearest vote with weights that rise with similarity.
All vectors are rounded to fixed-point numbers, which doubles hold as whole numbers, so that every product and sum is exact, in whatever order and in blocks of whatever
height they are computed: a text's score does not depend on the rows that share its batch, and equal similarities are equal.

Defined cases: a null or empty text has the structure terms alone; a long text is one vector like any other; without usable labels every score is 0.5; labels
that repeat a doc_id count once (the smallest); neighbours tied with the last one vote too; repeated rows get equal scores; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_map, id_and_text

#: Most labelled documents in the sample (those of the smallest hashes): bounds what is fitted and broadcast.
SAMPLE = 4_000
TERMS, LATENT, NEIGHBOURS = 2_048, 64, 25
#: Similarities are squared so many times before they weigh a vote.
SQUARINGS = 3
KEEP = 0.7
_HASH = np.random.default_rng(5).integers(0, TERMS, (3, 256), dtype=np.uint16)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~_=+/\\{}[]"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_FACTS = (("symbols", (0.002, 0.01, 0.03)), ("capitals", (0.06, 0.15, 0.4)), ("variety", (0.1, 0.2, 0.35, 0.5, 0.7)), ("lines", (0.05, 0.2, 0.5)), ("length", (20, 50, 150, 500)))
_FACT_WEIGHT = 1.5
#: Binary places of terms, of axes, of latent vectors and of unit latent vectors: sums of WIDTH (or LATENT) products of them stay below 2^53.
_TERM_BITS, _AXIS_BITS, _LATENT_BITS, _UNIT_BITS = 15, 20, 18, 22
WIDTH = TERMS + sum(len(bounds) + 1 for _, bounds in _FACTS)


def term_vector(text: str) -> np.ndarray:
    """Log counts of the hashed triplets, scaled to length 1, then one of each fact's bins set; in steps of 2^-_TERM_BITS."""
    data = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(WIDTH, np.float64)
    if len(b) > 2:
        out[:TERMS] = np.log1p(np.bincount(_HASH[0][b[:-2]] ^ _HASH[1][b[1:-1]] ^ _HASH[2][b[2:]], minlength=TERMS))
        out[:TERMS] /= max(float(np.linalg.norm(out[:TERMS])), 1e-9)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    facts = (_SYMBOL[b].mean() if len(b) else 0, _UPPER[b].mean() if len(b) else 0, len(set(words)) / max(len(words), 1), 1 - len(set(lines)) / max(len(lines), 1), len(words))
    at = TERMS
    for value, (_, bounds) in zip(facts, _FACTS, strict=True):
        out[at + int(np.searchsorted(bounds, value, "right"))] = 1
        at += len(bounds) + 1
    return np.rint(out * 2**_TERM_BITS) / 2**_TERM_BITS


class LatentVote:
    """The latent space and the labelled vectors in it."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        weight = np.log((1 + len(vectors)) / (1 + (vectors > 0).sum(0))).astype(np.float32)
        weight[TERMS:] = _FACT_WEIGHT / np.sqrt(len(_FACTS))
        self.weight = weight
        rank = min(LATENT, *vectors.shape)
        # randomised range finding: two power steps, then an exact decomposition in the small space
        x = vectors * weight
        basis = np.linalg.qr(x @ np.random.default_rng(3).standard_normal((WIDTH, min(rank + 16, len(x)))).astype(np.float32))[0] if len(x) else np.zeros((0, 0), np.float32)
        for _ in range(2):
            basis = np.linalg.qr(x @ (x.T @ basis))[0] if len(x) else basis
        self.axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32) if len(x) else np.zeros((WIDTH, 1), np.float32)
        self.projection = np.rint(self.weight[:, None].astype(np.float64) * self.axes * 2**_AXIS_BITS)
        self.known = self.latent(vectors)

    def latent(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space, as whole numbers of 2^-_UNIT_BITS."""
        # an exact product, rounded to so few places that the sum of squares is exact too
        z = np.rint(np.rint(vectors * 2**_TERM_BITS) @ self.projection / 2 ** (_TERM_BITS + _AXIS_BITS - _LATENT_BITS))
        return np.rint(z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1.0) * 2**_UNIT_BITS)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(vectors), self.prior)
        near = (self.latent(vectors) @ self.known.T) / 2 ** (2 * _UNIT_BITS)
        k = min(NEIGHBOURS, near.shape[1])
        # all that are as near as the last neighbour vote, so that ties do not depend on an order
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        row, at = np.nonzero(near >= last)
        votes = np.maximum(near[row, at], 0)
        for _ in range(SQUARINGS):  # products are rounded alike wherever a value stands, powers need not be
            votes = votes * votes
        total = np.bincount(row, votes, len(vectors))
        return np.where(total > 1e-12, np.bincount(row, votes * self.labels[at], len(vectors)) / np.maximum(total, 1e-12), self.prior).clip(0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LatentVote:
    """Fits on a bounded sample of the labelled documents that are not held out; its ids are broadcast, the texts stay where they are."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label").cast(pa.int64()), "vector": [(term_vector(t) * 2**_TERM_BITS).astype(np.uint16).tobytes() for t in batch.column("text").to_pylist()]}

    found = sorted({(r["doc_id"], r["label"], bytes(r["vector"])) for r in arrow_map(rows, schema, of_batch).collect()})
    vectors = np.frombuffer(b"".join(v for _, _, v in found), np.uint16).reshape(-1, WIDTH) / 2**_TERM_BITS
    return LatentVote(vectors, np.array([label for _, label, _ in found], np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        texts = batch.column("text").to_pylist()
        scores = np.concatenate([model.value.scores(np.stack([term_vector(t) for t in texts[k : k + 512]])) for k in range(0, len(texts), 512)])
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= KEEP).astype(np.int32)}

    return arrow_map(id_and_text(docs), schema, of_batch).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
