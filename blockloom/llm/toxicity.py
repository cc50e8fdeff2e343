"""Toxicity by a factorization machine over hashed terms.

A document's features are its distinct lower-case letter runs, hashed. The score is the logistic function of a bias, a
weight per term and, for each pair of terms, the product of their latent factors: an insult beside the mention of a
group can weigh more than the sum of the two. Terms get factors by their weight or by a gate of their own, which tests
what a term adds to the others beside it and not what it says alone. The machine is fitted on at most ``SAMPLE`` labelled documents of each
label (the first by a hash of their id); scoring reads every whole text and needs no shuffle.

Defined results: a null or empty text has no terms and gets the bias's score; a null ``doc_id`` is not held out and has
no label; null labels and labels without a document are ignored; a document with contradicting labels counts as toxic;
with one label only, every score is that label's share; repeated rows get equal scores; an empty table gives an empty
result. Other columns, whatever their names, are kept by the filter and never read by a score; a very long text is hashed by
one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import text_of
from blockloom.session import small_batches

CELLS = 1 << 18
FACTORS = 8
SAMPLE = 4000
EPOCHS = 12
BATCH = 128
RATE, FACTOR_RATE = 4.0, 0.02
PENALTY = 0.7
WEIGHT_DECAY = 1e-3
MIN_DOCUMENTS = 3
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
SEED = 11
#: Directions searched for pairs, steps of the search, and the normal deviate that a term must pass in the other half.
DIRECTIONS, STEPS, GATE, FIRST_FACTOR = 16, 10, 5.0, 1.0


def terms(text: Column) -> Column:
    """Hashed distinct terms as an array of integers."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Machine:
    """Weights of the terms in use; ``slot`` maps a cell to its row, row 0 being all zero."""

    def __init__(self, slot: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.slot, self.bias, self.weights, self.factors = slot, bias, weights, factors

    def scores(self, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of documents whose cells lie between consecutive offsets."""
        return self.scores_of_rows(self.slot[cells], offsets)

    def scores_of_rows(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(rows)
        owner = np.searchsorted(offsets, used, side="right") - 1
        rows, n = rows[used], offsets.size - 1
        z = self.bias + np.bincount(owner, self.weights[rows], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[rows, f]
            z += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Residual:
    """The residual-weighted co-occurrence of centred terms, without its diagonal, as an operator on a part of the documents.

    Its entry for two terms is the pull of the loss on their pair. Its extreme directions hold the terms that tell most
    together; products cost one look at each term of each document, whatever the number of pairs.
    """

    def __init__(self, rows: list[np.ndarray], residual: np.ndarray, size: int):
        self.flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [r.size for r in rows])
        self.residual, self.size = residual, size
        self.mean = np.bincount(self.flat, minlength=size) / max(len(rows), 1)
        self.diagonal = self._back(residual) * (1 - 2 * self.mean) + self.mean ** 2 * residual.sum()

    def _back(self, values: np.ndarray) -> np.ndarray:
        """The sum of the documents' values for each term."""
        return np.bincount(self.flat, values[self.owner], self.size)

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, v[self.flat], self.residual.size) - self.mean @ v

    def __call__(self, v: np.ndarray) -> np.ndarray:
        pulled = self.residual * self.sums(v)
        return self._back(pulled) - self.mean * pulled.sum() - self.diagonal * v

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and unit directions (columns) of the largest magnitude, by subspace iteration."""
        q = np.random.default_rng(SEED).normal(size=(self.size, min(DIRECTIONS, self.size)))
        for _ in range(STEPS):
            q = np.linalg.qr(np.stack([self(v) for v in q.T], axis=1))[0]
        values, turn = np.linalg.eigh(q.T @ np.stack([self(v) for v in q.T], axis=1))
        order = np.argsort(-values)
        return values[order], q @ turn[:, order]

    def deviates(self, v: np.ndarray) -> np.ndarray:
        """For each term, the normal deviate of its pull beside the other terms of a direction found elsewhere."""
        held = self.residual ** 2 * self.sums(v) ** 2
        # What a term itself adds to the sums is small where it is not most of the direction; there it only widens the spread.
        spread = np.sqrt(self._back(held) * (1 - 2 * self.mean) + self.mean ** 2 * held.sum())
        return np.divide(np.abs(self(v)), spread, out=np.zeros(self.size), where=spread > 0)


def pair_terms(rows: list[np.ndarray], residual: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which terms tell something in pairs beyond their weights, and first factors for them.

    A term passes by its pull in one half of the documents along the directions found in the other half, so chance
    terms pass at the rate of the gate, however many terms there are.
    """
    half = np.random.default_rng(SEED).permutation(len(rows)) % 2
    parts = [_Residual([rows[i] for i in np.flatnonzero(half == h)], residual[half == h], size) for h in (0, 1)]
    passed = np.zeros(size, bool)
    for part, other in (parts, parts[::-1]):
        for v in part.directions()[1].T:
            passed |= other.deviates(v) >= GATE
    passed[0] = False
    first = np.zeros((size, FACTORS))
    if passed.any():
        values, found = _Residual(rows, residual, size).directions()
        found = found[:, :FACTORS] * np.sqrt(np.maximum(values[:FACTORS], 0)) * passed[:, None]
        first[:, :found.shape[1]] = FIRST_FACTOR * found / max(np.abs(found).max(), 1e-12)
    return passed, first


def fit(cells: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Logistic loss over mini-batches in an order fixed by ``SEED``; both labels weigh the same.

    Weights follow the regularised leader with an absolute penalty, which leaves all but telling terms at zero. The
    factors of terms with a weight follow AdaGrad. What these leave unexplained is then searched for terms that tell in
    pairs (``pair_terms``), whatever their weight; where there are any, the machine is fitted anew
    with their factors, and with their weights free of the penalty.
    """
    slot = np.zeros(CELLS, np.int32)
    toxic = float(labels.mean()) if labels.size else 0.0
    if not 0 < toxic < 1:
        constant = float(np.log((toxic + 1e-6) / (1 - toxic + 1e-6)))
        return Machine(slot, constant, np.zeros(1), np.zeros((1, FACTORS)))
    documents = np.bincount(np.concatenate([np.unique(c) for c in cells]), minlength=CELLS)
    known = np.flatnonzero(documents >= MIN_DOCUMENTS)
    slot[known] = np.arange(1, known.size + 1)
    rows = [np.unique(slot[c]) for c in cells]
    rows = [r[r > 0] for r in rows]
    balance = np.where(labels == 1, 0.5 / toxic, 0.5 / (1 - toxic))
    size = known.size + 1
    bias, weights, factors = _fitted(rows, labels, balance, np.zeros(size, bool), np.zeros((size, FACTORS)))
    machine = Machine(slot, bias, weights, factors)
    fitted = machine.scores_of_rows(np.concatenate(rows), np.cumsum([0, *(r.size for r in rows)]))
    gated, first = pair_terms(rows, (labels - fitted) * balance, size)
    if not gated.any():
        return machine
    return Machine(slot, *_fitted(rows, labels, balance, gated, first))


def _fitted(
    rows: list[np.ndarray], labels: np.ndarray, balance: np.ndarray, gated: np.ndarray, first: np.ndarray,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors; the factors of gated terms start from ``first`` and always take part."""
    rng = np.random.default_rng(SEED)
    weights, pull, seen = np.zeros(gated.size), np.zeros(gated.size), np.zeros(gated.size)
    factors, v_sum = rng.normal(0, 0.01, (gated.size, FACTORS)), np.full((gated.size, FACTORS), 1e-4)
    factors = np.where(gated[:, None], first + factors, factors)
    factors[0] = 0
    bias, bias_sum = 0.0, 1.0
    penalty = np.where(gated, 0.0, PENALTY * np.sqrt(labels.size))
    for _ in range(EPOCHS):
        order = rng.permutation(labels.size)
        for at in range(0, order.size, BATCH):
            chosen = order[at:at + BATCH]
            flat = np.concatenate([rows[i] for i in chosen])
            owner = np.repeat(np.arange(chosen.size), [rows[i].size for i in chosen])
            paired = np.flatnonzero((weights[flat] != 0) | gated[flat])
            v, whose = factors[flat[paired]], owner[paired]
            sums = np.zeros((chosen.size, FACTORS))
            np.add.at(sums, whose, v)
            squares = np.bincount(whose, (v * v).sum(axis=1), chosen.size)
            z = bias + np.bincount(owner, weights[flat], chosen.size) + 0.5 * ((sums ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]) * balance[chosen]
            gv = error[whose, None] * (sums[whose] - v)
            touched, place = np.unique(flat[paired], return_inverse=True)
            step = np.zeros((touched.size, FACTORS))
            np.add.at(step, place, gv)
            v_sum[touched] += step * step
            factors[touched] -= FACTOR_RATE * (step / np.sqrt(v_sum[touched]) + WEIGHT_DECAY * factors[touched])
            touched, place = np.unique(flat, return_inverse=True)
            g = np.bincount(place, error[owner])
            more = seen[touched] + g * g
            pull[touched] += g - (np.sqrt(more) - np.sqrt(seen[touched])) / RATE * weights[touched]
            seen[touched] = more
            held = pull[touched]
            weights[touched] = np.where(
                np.abs(held) <= penalty[touched], 0.0, -(held - np.sign(held) * penalty[touched]) / ((1 + np.sqrt(more)) / RATE + WEIGHT_DECAY))
            bias_sum += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_sum)
    factors[(weights == 0) & ~gated] = 0
    return float(bias), weights, factors


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``cells, label`` of the documents to learn from: at most ``sample`` ids of each label, none of them held out."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    first = [marked.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    # At most 2 * sample ids, so they can go to every task.
    chosen = F.broadcast(first[0].unionByName(first[1]))
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id")).select("id", "label", "text")
    return found.groupBy("id", "label").agg(F.max("text").alias("text")).orderBy("id").select(terms(text_of()).alias("cells"), "label")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    # As Arrow arrays: lists of Python integers would take the driver ten times the memory.
    rows = training_sample(docs, labels, sample).toArrow()
    cells = rows["cells"].combine_chunks()
    offsets, values = cells.offsets.to_numpy(), cells.values.to_numpy()
    return fit(
        [values[a:b].astype(np.int64) for a, b in zip(offsets, offsets[1:])], rows["label"].to_numpy().astype(np.float64))


def score(text: Column, machine: Machine, docs: DataFrame) -> Column:
    """The score of each text; only the hashed terms reach Python."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def of_terms(cells: pa.Array) -> pa.Array:
        offsets = cells.offsets.to_numpy().astype(np.int64)
        return pa.array(model.value.scores(cells.values.to_numpy()[offsets[0]:offsets[-1]], offsets - offsets[0]))

    return of_terms(terms(text))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(text_of(), train(docs, labels), docs).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, unchanged."""
    return docs.where(score(text_of(), train(docs, labels), docs) < THRESHOLD)
