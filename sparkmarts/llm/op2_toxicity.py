"""Toxicity scores from the nearest labelled examples.

Method: texts are TF-IDF vectors of features (words and word beginnings), each feature's weight times
how far its presence goes with the class among the examples (the phi coefficient, plus a floor that
keeps it above 0); the k examples of largest exact cosine are found in a block-max inverted index:
examples lie in blocks, each feature's largest weight in a block bounds what the block can add to the part
of its scores that is known, and blocks are read from the largest bounds on until none can beat the k-th
score. Features that one in twenty examples has are full rows, whose part is known first, for many texts
at once. Neighbours vote, weighted by distance; the vote is calibrated by a logistic curve fitted on the examples, each scored without itself. The neighbours are the evidence.

Bounds: at most ``max_examples`` labelled rows of each class (the first by hash of id) are examples.
Every feature of an example spans the vectors, so the index grows with the text of the examples (about
16 bytes per feature of an example); it is what is broadcast. Document frequencies cover all documents.

Defined cases: texts without any feature of an example (null and empty ones too) have no neighbours and get the
score of an empty vote; ties among neighbours go to the earlier example; repeated rows are scored
alike; without labelled rows of both classes the score is the share of toxic rows among them, or 0;
an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.llm.common import cut, slices, text_rows

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
BLOCK = 128
FLOOR = 0.001  # added to phi: no feature is without weight


def features_of(part: str) -> list[str]:
    """Of each word in a part of a text: the word (ending in a space) and its beginnings."""
    out = []
    for word in LETTERS.findall(part):
        out.append(word + " ")
        out += [word[:n] for n in BEGINNINGS if len(word) > n]
    return out


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0], .., stop[0] - 1, start[1], .., stop[1] - 1 and so on."""
    size = stop - start
    return np.repeat(stop - np.cumsum(size), size) + np.arange(size.sum())


@dataclass
class Index:
    """Example vectors by feature; a cell is a feature's examples in one block of examples.

    Features that many examples have are kept as full rows, whose part of all cosines is a product of
    matrices; the others are postings in cells with their largest weight. What a block's cells can add at
    most to the part already known bounds its examples.
    """

    examples: int
    cells: np.ndarray  # of each feature: where its cells begin; none for common features
    blocks: np.ndarray  # of the cells
    largest: np.ndarray  # weight in each cell
    pointers: np.ndarray  # of each cell: where its postings begin
    rows: np.ndarray  # the examples
    weights: np.ndarray
    common: np.ndarray  # of each feature: its row of ``full``, or -1
    full: np.ndarray  # (common features, examples)

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], features: int, often: float = 0.05) -> Index:
        rows = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(f) for f, _ in vectors])
        found = np.concatenate([np.zeros(0, np.int32), *(f for f, _ in vectors)]).astype(np.int32)
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        many = np.bincount(found, minlength=features) > often * len(vectors)
        common = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        full = np.zeros((int(many.sum()), len(vectors)))
        frequent = many[found]
        full[common[found[frequent]], rows[frequent]] = weights[frequent]
        found, rows, weights = found[~frequent], rows[~frequent], weights[~frequent]
        order = np.argsort(found, kind="stable")
        found, rows, weights = found[order], rows[order], weights[order]
        del order
        new = np.ones(len(rows), bool)
        new[1:] = (found[1:] != found[:-1]) | (rows[1:] // BLOCK != rows[:-1] // BLOCK)
        first = np.flatnonzero(new)
        return cls(len(vectors), np.searchsorted(found[first], np.arange(features + 1)),
                   (rows[first] // BLOCK).astype(np.int32), np.maximum.reduceat(weights, first) if len(first) else weights,
                   np.r_[first, len(rows)].astype(np.int32 if len(rows) < 1 << 31 else np.int64), rows, weights,
                   common, full)

    def known(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(vectors, examples): the cosines' part by common features."""
        some = np.zeros((len(vectors), len(self.full)))
        for row, (found, weights) in zip(some, vectors):
            at = self.common[found]
            row[at[at >= 0]] = weights[at >= 0]
        return some @ self.full

    def search(self, found: np.ndarray, weights: np.ndarray, k: int, skip: int = -1,
               known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, ties to earlier examples."""
        scores = self.known([(found, weights)])[0] if known is None else known.copy()
        n_blocks = -(-self.examples // BLOCK)
        start, stop = self.cells[found], self.cells[found + 1]
        cell, term = ranges(start, stop), np.repeat(np.arange(len(found)), stop - start)
        block = self.blocks[cell]
        more = np.bincount(block, weights[term] * self.largest[cell], minlength=n_blocks) * (1 + 1e-9)
        padded = np.full(n_blocks * BLOCK, -1.0)
        padded[:self.examples] = scores
        if skip >= 0:
            padded[skip] = -1.0
        best = padded.reshape(n_blocks, BLOCK).max(axis=1)  # of what is known
        left, least = more > 0, -1.0
        while True:
            # whatever is still to come, k examples have this much already
            least = np.partition(padded, -k)[-k] if len(padded) > k else -1.0
            left &= best + more >= least
            if not left.any():
                break
            bounds = np.where(left, best + more, -1.0)
            now = left & (bounds >= 0.5 * bounds.max())  # blocks of about the same bounds at once
            left &= ~now
            sums = self._sums(cell, term, now[block], weights)
            at = np.flatnonzero(sums)
            at = at[at != skip]
            padded[at] += sums[at]
        scores = padded[:self.examples]
        hit = np.flatnonzero((scores > 0) & (scores >= least))
        best = hit[np.lexsort((hit, -scores[hit]))[:k]]
        return best, scores[best]

    def _sums(self, cell: np.ndarray, term: np.ndarray, taken: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all examples by the cells taken."""
        cell, term = cell[taken], term[taken]
        start, stop = self.pointers[cell], self.pointers[cell + 1]
        at = ranges(start, stop)
        each = self.weights[at]
        each *= np.repeat(weights[term], stop - start)
        return np.bincount(self.rows[at], each, minlength=self.examples)


@dataclass
class Model:
    """All that scoring needs; its size is bounded by the numbers of examples and features."""

    names: pa.Array  # of the features; a feature's number is its place
    worth: np.ndarray  # of each feature: inverse document frequency times phi
    index: Index | None
    ids: list
    toxic: np.ndarray
    class_weight: tuple[float, float]  # rows that a clean and a toxic example stand for
    share: float
    k: int
    slope: float = 1.0
    shift: float = 0.0
    kinds: list | None = field(default=None, repr=False)  # (letters, names, numbers); 0: whole words
    shared: Broadcast | None = field(default=None, repr=False)  # of this model, without the curve

    def __getstate__(self):
        return {**self.__dict__, "kinds": None, "shared": None}

    @property
    def number(self) -> dict[str, int]:
        return {f: i for i, f in enumerate(self.names.to_pylist())}

    def _kinds(self) -> list[tuple[int, pa.Array, np.ndarray]]:
        whole = pc.ends_with(self.names, " ")
        letters = pc.if_else(whole, 0, pc.utf8_length(self.names)).to_numpy()
        numbers = [(n, np.flatnonzero(letters == n)) for n in (0, *BEGINNINGS)]
        return [(n, self.names.take(pa.array(own)), own) for n, own in numbers]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, count) of all features of the texts, in order; each different word of the
        texts is looked up once."""
        if self.kinds is None:
            self.kinds = self._kinds()
        found = [LETTERS.findall((t or "").lower()) for t in texts.to_pylist()]
        text = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
        coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        del found
        words, codes = coded.dictionary, coded.indices.to_numpy()
        size, every = pc.utf8_length(words).to_numpy(), max(len(self.names), 1)
        keys = []
        for n, names, numbers in self.kinds:
            own = pc.utf8_slice_codeunits(words, 0, n) if n else pc.binary_join_element_wise(words, " ", "")
            place = pc.fill_null(pc.index_in(own, names), -1).to_numpy()
            place = np.where((place >= 0) & (size > n), place, -1)[codes]
            known = np.flatnonzero(place >= 0)
            keys.append(text[known] * every + numbers[place[known]])
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        return *np.divmod(keys, every), counts

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, weights), of length one, of each text."""
        text, found, counts = self.features(texts)
        weights = (1 + np.log(counts)) * self.worth[found]
        norm = np.sqrt(np.bincount(text, weights**2, minlength=len(texts)))
        weights /= np.maximum(norm, 1e-12)[text]
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(found[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:])]

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], skips: list[int] | None = None,
              step: int = 256) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(share of toxic votes, neighbours, cosines) for each vector; ``skips``: an example to leave out."""
        for at in range(0, len(vectors), step):
            some = vectors[at:at + step]
            known = self.index.known(some) if self.index is not None else [None] * len(some)
            for i, (vector, part) in enumerate(zip(some, known)):
                yield self.vote(*vector, -1 if skips is None else skips[at + i], part)

    def vote(self, found: np.ndarray, weights: np.ndarray, skip: int = -1, known: np.ndarray | None = None
             ) -> tuple[float, np.ndarray, np.ndarray]:
        """(share of toxic votes, neighbours, cosines) for a vector."""
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        if self.index is not None and len(found):
            rows, cosines = self.index.search(found, weights, self.k, skip, known)
        near = cosines**2 / (1.05 - np.minimum(cosines, 1.0))
        toxic = self.toxic[rows] == 1
        yes, no = near[toxic].sum() * self.class_weight[1], near[~toxic].sum() * self.class_weight[0]
        return float((yes + self.share * 0.1) / (yes + no + 0.1)), rows, cosines

    def score(self, vote: float) -> float:
        if self.index is None:
            return self.share
        at = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-(self.slope * math.log(at / (1 - at)) + self.shift)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0
             ) -> tuple[float, float]:
    """(slope, shift) of a logistic curve by Newton steps, drawn to (1, 0) by ``ridge``."""
    design, beta, centre = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * (beta - centre)
        curve = design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 1200, k: int = 25, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """The model of ``labels`` (<id_col>, <label_col> 0 or 1; of repeated ids the largest)."""
    rows = text_rows(docs, id_col, text_col)
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter(
        "id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    first = [given.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(max_examples)
             for c in (0, 1)]
    chosen = cut(first[0].unionByName(first[1]))
    total = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    sample = cut(rows.join(F.broadcast(chosen), "id")  # bounded by max_examples
                 .withColumn("row", F.monotonically_increasing_id()))
    held = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = held.get(0, 0), held.get(1, 0)
    share = total.get(1, 0) / max(sum(total.values()), 1)
    if not clean or not toxic:
        return Model(pa.array([], pa.string()), np.zeros(0), None, [], np.zeros(0, int), (1.0, 1.0), share, k)

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = [*(seen[0] | seen[1])]
            columns = [pa.array([seen[c][f] for f in keys], pa.int64()) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns],
                                              names=["feature", "clean", "toxic"])

        for batch in slices(batches, 4 << 20):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[label].update({f for part in set(text.lower().split()) for f in features_of(part)})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out()
                seen[0].clear(), seen[1].clear()
        yield out()

    counted = sample.mapInArrow(count_features, "feature string, clean long, toxic long").groupBy(
        "feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counted = counted.sort_by("feature")  # bounded by max_examples
    model = Model(pa.array(counted.column("feature").to_pylist(), pa.string()), np.ones(counted.num_rows), None, [],
                  np.zeros(0, int), (total[0] / clean, total[1] / toxic), share, k)
    if not len(model.names):
        return model
    a, b = (counted.column(c).to_numpy().astype(float) for c in ("toxic", "clean"))
    phi = np.abs(a * clean - b * toxic) / np.sqrt((a + b) * np.maximum(toxic + clean - a - b, 1) * toxic * clean)
    model.worth = inverse_frequencies(rows, model) * (phi + FLOOR)

    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([sample.schema["id"], sample.schema["toxic"], sample.schema["row"],
                           T.StructField("found", T.BinaryType()), T.StructField("weights", T.BinaryType())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            got = shared.value.vectors(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("toxic"), batch.column("row"),
                 pa.array([f.astype(np.int32).tobytes() for f, _ in got], pa.binary()),
                 pa.array([w.tobytes() for _, w in got], pa.binary())], names=schema.names)

    stored = cut(sample.mapInArrow(vectors, schema))
    examples = stored.toArrow().to_pylist()  # bounded by max_examples
    shared.destroy()
    pairs = [(np.frombuffer(r["found"], np.int32), np.frombuffer(r["weights"])) for r in examples]
    spread = np.bincount(np.concatenate([f for f, _ in pairs]), minlength=len(model.names))

    def alike(i: int) -> tuple:
        """Similar examples in a block: by most common feature (the language), class, strongest feature."""
        (found, weights), r = pairs[i], examples[i]
        top = (int(found[np.argmax(spread[found])]), r["toxic"], int(found[np.argmax(weights)])) if len(
            found) else (-1, r["toxic"], -1)
        return *top, r["id"], r["found"], r["weights"]

    order = sorted(range(len(pairs)), key=alike)
    examples, pairs = [examples[i] for i in order], [pairs[i] for i in order]
    model.index = Index.build(pairs, len(model.names))
    model.ids, model.toxic = [r["id"] for r in examples], np.array([r["toxic"] for r in examples])
    numbers = [r["row"] for r in examples]
    del examples, pairs
    model.shared = rows.sparkSession.sparkContext.broadcast(model)
    votes = loo_votes(stored.select("row", "found", "weights"), model, numbers)
    weight = np.array(model.class_weight)[model.toxic]
    at = np.clip(votes, 1e-6, 1 - 1e-6)
    model.slope, model.shift = logistic(np.log(at / (1 - at)), model.toxic, weight)
    return model


def inverse_frequencies(rows: DataFrame, model: Model) -> np.ndarray:
    """From all documents."""
    shared, size = rows.sparkSession.sparkContext.broadcast(model), len(model.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)
        for batch in slices(batches, 4 << 20):
            seen[size] += batch.num_rows
            seen[:size] += np.bincount(shared.value.features(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["feature", "rows"])

    got = rows.select("text").mapInArrow(count, "feature long, rows long").groupBy("feature").agg(
        F.sum("rows").alias("rows")).toArrow()  # a row per feature
    shared.destroy()
    frequency = np.zeros(size + 1)
    frequency[got.column("feature").to_numpy()] = got.column("rows").to_numpy()
    return np.log((1 + frequency[size]) / (1 + frequency[:size])) + 1


def loo_votes(examples: DataFrame, model: Model, rows: list[int]) -> np.ndarray:
    """The vote on each example without itself; ``examples``: (row, found, weights), ``rows``: in order."""
    shared = model.shared
    place = {row: n for n, row in enumerate(rows)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            numbers = [place[i] for i in batch.column(0).to_pylist()]
            pairs = [(np.frombuffer(f, np.int32), np.frombuffer(w)) for f, w in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            votes = [v for v, _, _ in shared.value.votes(pairs, numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(votes, pa.float64())],
                                             names=["number", "vote"])

    votes = np.zeros(len(model.ids))
    for r in examples.mapInArrow(run, "number long, vote double").collect():  # one row an example
        votes[r["number"]] = r["vote"]
    return votes


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, score, predicted, evidence (neighbours: id, similarity, toxic) of each text."""
    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(*scorer(rows, model, "text")).withColumnsRenamed({"id": id_col}).drop("text")


def scorer(docs: DataFrame, model: Model, text_col: str):
    """Function and schema for mapInArrow: columns of ``docs``, then score, predicted, evidence."""
    key = T.StructType([T.StructField("id", T.StringType()), T.StructField("similarity", T.DoubleType()),
                        T.StructField("toxic", T.IntegerType())])
    arrow = pa.list_(pa.struct([("id", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()),
                           T.StructField("evidence", T.ArrayType(key))])
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model)
    curve, at = (model.slope, model.shift), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.slope, own.shift = curve
        for batch in slices(batches, 4 << 20):
            scores, evidence = [], []
            for vote, near, cosines in own.votes(own.vectors(batch.column(at))):
                scores.append(own.score(vote))
                evidence.append([{"id": str(own.ids[i]), "similarity": c, "toxic": int(own.toxic[i])}
                                 for i, c in zip(near[:5].tolist(), cosines.tolist())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, arrow)],
                names=schema.names)

    return run, schema


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
