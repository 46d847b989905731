"""Quality classifier by co-training: one view sees the text, the other the page's metadata.

In each round both views learn from their labelled rows, score all unlabelled rows of the corpus, and give the other those of which they are
surest, with their own answer as label. At the end each view is calibrated on labelled rows that neither has seen, and the calibrated
log-odds are added.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Tables
from ._words import read_words

STATS, BUCKETS = 12, 128
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 symbol, 4 other punctuation, 5 line end
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#*$%&|<>{}[]\\^~_=+@"]] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-/"]] = 4
_KIND[10] = 5


def text_features(texts: pa.Array) -> np.ndarray:
    """Shares of characters, words and repeats, then shares of word hashes by bucket; whole texts."""
    out = np.zeros((len(texts), STATS + BUCKETS), np.float32)
    for w in read_words(texts, lower=False):
        docs = w.hi - w.lo
        n = np.bincount(w.doc, minlength=docs).astype(np.float64)
        size = (w.end - w.start).astype(np.float64)
        chars = np.maximum(np.bincount(w.doc, size, docs), 1)
        own = out[w.lo : w.hi]
        own[:, 0] = np.log1p(n) / 10
        own[:, 1] = chars / np.maximum(n, 1) / 20
        if len(w.hash):
            kinds = _KIND[w.data]
            where = np.flatnonzero(kinds)
            edge = np.searchsorted(w.start, where, "right") - 1
            doc = w.doc[np.maximum(edge, 0)]
            table = np.bincount(doc * 6 + kinds[where], minlength=docs * 6)[: docs * 6].reshape(docs, 6)
            own[:, 2:7] = table[:, 1:6] / chars[:, None] * 5
            for k, gram in enumerate((1, 2, 3)):
                at, hashes = w.grams(gram)
                doc = w.doc[at]
                order = np.lexsort((hashes, doc))
                same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                own[:, 7 + k] = np.bincount(doc[order][1:][same], minlength=docs) / np.maximum(n, 1)
            twice = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
            own[:, 10] = np.bincount(w.doc[1:][twice], minlength=docs) / np.maximum(n, 1)
            table = np.bincount(w.doc * BUCKETS + (w.hash >> np.uint64(57)).astype(np.int64), minlength=docs * BUCKETS)
            own[:, STATS:] = np.sqrt(table.reshape(docs, BUCKETS) / np.maximum(n, 1)[:, None])
        own[:, 11] = n == 0
    return out


def meta_features(names: Column, numbers: Column, size: int = 96) -> Column:
    """Hashed places of the metadata values of a row; numbers by their power of two."""
    told = F.transform(names, lambda x: F.pmod(F.xxhash64(x.k, F.coalesce(x.v, F.lit(""))), F.lit(size)).cast("int"))
    scaled = F.transform(numbers, lambda x: F.pmod(F.xxhash64(x.k, F.coalesce(F.floor(F.log2(F.abs(x.v) + 1)), F.lit(-1))), F.lit(size)).cast("int"))
    return F.concat(told, scaled)


def _one_hot(places: pa.Array, size: int = 96) -> np.ndarray:
    out = np.zeros((len(places), size), np.float32)
    flat, ends = np.asarray(places.flatten()), np.asarray(places.offsets)
    out[np.repeat(np.arange(len(places)), np.diff(ends)), flat] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights, the constant last, by Newton steps; classes weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, grad)
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass
class CoTrained:
    """Weights of both views and their calibrations (slope, constant); combined log-odds are the sum less the prior's."""

    text: np.ndarray
    meta: np.ndarray
    text_fit: np.ndarray
    meta_fit: np.ndarray
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = odds(odds(text, self.text)[:, None], self.text_fit) + self.prior
        b = odds(odds(meta, self.meta)[:, None], self.meta_fit) + self.prior
        return tuple(1 / (1 + np.exp(-z)) for z in (a + b - self.prior, a, b))


class CoTraining:
    """Both views' labelled rows, features in one array. Every fifth row that came with a label only calibrates; pseudo-labels are never taken back."""

    def __init__(self, x: np.ndarray, y: np.ndarray, wide: int = STATS + BUCKETS):
        apart = np.arange(len(y)) % 5 == 0
        self.wide, self.apart = wide, (x[apart], y[apart])
        self.rows = [(x[~apart], y[~apart])] * 2
        self.prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.weights = [self._fit(v) for v in (0, 1)]

    def view(self, x: np.ndarray, view: int) -> np.ndarray:
        return x[:, self.wide :] if view else x[:, : self.wide]

    def _fit(self, view: int) -> np.ndarray:
        x, y = self.rows[view]
        return fit_logistic(self.view(x, view), y)

    def learn(self, view: int, x: np.ndarray, y: np.ndarray) -> None:
        """Rows that the other view is sure of."""
        own = self.rows[view]
        self.rows[view] = np.concatenate([own[0], x]), np.concatenate([own[1], y])
        self.weights[view] = self._fit(view)

    def model(self) -> "CoTrained":
        x, y = self.apart
        both = len(set(y.tolist())) == 2
        fits = [fit_logistic(odds(self.view(x, v), self.weights[v])[:, None], y, ridge=0.1) if both else np.array([1.0, 0.0]) for v in (0, 1)]
        return CoTrained(*self.weights, *fits, float(np.log(self.prior / (1 - self.prior))))


def _featurer(batches):
    for batch in batches:
        x = np.concatenate([text_features(batch.column(1)), _one_hot(batch.column(2))], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])


def _features(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _sure(weights: list[np.ndarray], wide: int, most: int, sure: float):
    """Of the rows of a task the `most` of which each view is surest, for each label: view, label, doubt, id; rows of equal doubt by their id's hash."""

    def find(batches):
        best: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            x = _features(batch.column(1))
            for view in (0, 1):
                p = 1 / (1 + np.exp(-odds(x[:, wide:] if view else x[:, :wide], weights[view])))
                for label in (0, 1):
                    doubt = np.round(1 - p if label else p, 9)
                    at = np.flatnonzero(doubt <= 1 - sure)
                    new = pa.table({"doubt": pa.array(doubt[at]), "id": batch.column(0).take(pa.array(at)), "place": batch.column(2).take(pa.array(at))})
                    whole = pa.concat_tables([best[view, label], new]) if (view, label) in best else new
                    best[view, label] = whole.sort_by([("doubt", "ascending"), ("place", "ascending")]).slice(0, most)
        for (view, label), rows in best.items():
            for part in rows.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, k, np.int32)) for k in (view, label)] + part.columns, names=["view", "label", "doubt", "id", "place"])

    return find


def _scorer(model: CoTrained, wide: int = STATS + BUCKETS):
    def score(batches):
        for batch in batches:
            x = _features(batch.column(1))
            both, a, b = model.scores(x[:, :wide], x[:, wide:])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.round(z, 6)) for z in (both, a, b)), pa.array(both >= 0.5)], names=["doc_id", "score", "text_score", "meta_score", "kept"])

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", names: Sequence[str] = ("source", "lang"), numbers: Sequence[str] = ("n_chars",), most_labelled: int = 10_000, rounds: int = 4, most_given: int = 500, sure: float = 0.95) -> DataFrame:
    """doc_id, score (0 to 1), text_score, meta_score, kept (score >= 0.5) for every row.

    labels: doc_id, label (1 good, 0 bad). The models are fitted on the driver to a bounded sample: the `most_labelled` labelled rows with the smallest hash of
    their id, and what co-training adds. In each of `rounds` rounds both views score every unlabelled row of the corpus, in Spark, and of each label the other
    view gets the `most_given` rows of which it is surest (at `sure` or more). Whole texts of all rows become features once, in a table that rounds and the last scoring read.

    Null texts count as empty, null metadata as a value of its own. Null labels are unlabelled; an id with both labels is left out. With no label of one kind
    every score is the share of good labels, 0.5 if there is none. Null ids are scored and not learnt from. Rows of a repeated id are scored by their own texts; such ids are not learnt from.
    Other columns are not read.
    """
    pair = lambda c, kind: F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast(kind).alias("v"))
    told = F.array(*[pair(c, "string") for c in names]) if names else F.array().cast("array<struct<k:string,v:string>>")
    scaled = F.array(*[pair(c, "double") for c in numbers]) if numbers else F.array().cast("array<struct<k:string,v:double>>")
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), meta_features(told, scaled).alias("m"))
    kind = slim.schema["id"].dataType.simpleString()
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
    place = F.xxhash64("id").alias("place")
    tables = Tables(docs.sparkSession)
    once = slim.select("id").where("id is not null").groupBy("id").count().where("count = 1").select("id")
    some = marks.where("y = z").join(once, "id", "left_semi").select("id", "y", place).orderBy("place", "id").limit(most_labelled)
    seen = tables.put(slim.mapInArrow(_featurer, f"id {kind}, x binary"))

    def fetched(wanted: DataFrame) -> list:
        """The features of a bounded list of ids; its rows are on the driver in a fixed order."""
        return seen.join(F.broadcast(wanted), "id").orderBy("place", "id").collect()

    rows = fetched(some)
    y = np.array([r.y for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        flat = F.lit(float(y.mean()) if len(y) else 0.5)
        return slim.select(F.col("id").alias("doc_id"), flat.alias("score"), flat.alias("text_score"), flat.alias("meta_score"), (flat >= 0.5).alias("kept"))
    training = CoTraining(_features(pa.array([r.x for r in rows], pa.binary())), y)
    pool = tables.put(once.join(marks, "id", "left_anti").select("id", place)) if rounds else None
    free = seen.join(pool, "id").select("id", "x", "place") if rounds else None
    given: list[set] = [set(), set()]
    for _ in range(rounds):
        found = tables.put(free.mapInArrow(_sure(training.weights, training.wide, most_given * rounds, sure), f"view int, label int, doubt double, id {kind}, place long"))
        news = [[], []]
        for view in (0, 1):
            for answer in (0, 1):
                best = found.where(f"view = {view} and label = {answer}").orderBy("doubt", "place", "id").limit(most_given * rounds).collect()
                fresh = [(r.id, answer) for r in best if r.id not in given[1 - view]][:most_given]
                given[1 - view] |= {i for i, _ in fresh}
                news[1 - view] += fresh
        tables.drop(found)
        for view, told_rows in enumerate(news):
            if told_rows:
                wanted = docs.sparkSession.createDataFrame(told_rows, f"id {kind}, y int").select("id", "y", place)
                got = fetched(wanted)
                training.learn(view, _features(pa.array([r.x for r in got], pa.binary())), np.array([r.y for r in got], np.int64))
        if not any(news):
            break
    tables.drop(pool)
    return seen.select("id", "x").mapInArrow(_scorer(training.model()), f"doc_id {kind}, score double, text_score double, meta_score double, kept boolean")
