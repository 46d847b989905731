"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, the same in every task. A letter trigram's vector is the product of its letters' vectors,
the first turned by two places and the second by one; a text's vector is the sum over its trigrams,
a language's the sum over its texts. A text gets the language whose vector has the largest cosine with its own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Tables

#: Letters with a small number; trigrams of these are counted in a table, others by sorting.
_SMALL = 48


class Encoder:
    """Trigram counts and their vectors. Trigram vectors are kept, up to `keep` of them."""

    def __init__(self, size: int = 1024, seed: int = 11, keep: int = 30_000):
        self.size, self.seed, self.keep = size, seed, keep
        self.table = np.zeros(0x110000, np.int32) - 1  # letter: its number; 0 for a break
        self.letters: list[np.ndarray] = [np.ones(size, np.int8)]
        self.known: dict[int, int] = {}
        self.vectors = np.zeros((1024, size), np.float32)

    def numbers(self, text: str) -> np.ndarray:
        """Letters, lowered, as numbers in order of appearance; runs of anything else are one 0."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        got = self.table[points]
        if len(got) and got.min() < 0:
            for p in np.unique(points[got < 0]):
                self.table[p] = self._letter(int(p)) if chr(p).isalpha() else 0
            got = self.table[points]
        stay = np.ones(len(got), bool)
        stay[1:] = (got[1:] > 0) | (got[:-1] > 0)
        return got[stay]

    def _letter(self, point: int) -> int:
        rng = np.random.Generator(np.random.Philox(key=self.seed + (point << 8)))
        self.letters.append(rng.integers(0, 2, self.size, dtype=np.int8) * 2 - 1)
        return len(self.letters) - 1

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams (three numbers in one) and how often each occurs; none if the text has no letter."""
        x = self.numbers(text)
        if not x.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x = np.concatenate([[0], x[x.cumsum() > 0] if x[0] == 0 else x, [0]]).astype(np.int64)
        if x[-2] == 0:
            x = x[:-1]
        if x.max() < _SMALL:
            table = np.bincount((x[:-2] * _SMALL + x[1:-1]) * _SMALL + x[2:])
            key = np.flatnonzero(table)
            a, rest = np.divmod(key, _SMALL * _SMALL)
            b, c = np.divmod(rest, _SMALL)
            return (a << 42) | (b << 21) | c, table[key]
        return np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:], return_counts=True)

    def encode(self, key: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as it occurs."""
        if len(self.known) + len(key) > self.keep:
            self.known.clear()
        places = np.empty(len(key), np.int64)
        for i, k in enumerate(key.tolist()):
            at = self.known.get(k)
            if at is None:
                at = self.known[k] = len(self.known)
                if at >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                a, b, c = k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF
                self.vectors[at] = np.roll(self.letters[a], 2) * np.roll(self.letters[b], 1) * self.letters[c]
            places[i] = at
        return count.astype(np.float32) @ self.vectors[places]


def _batches(texts: pa.Array):
    for text in texts:
        yield text.as_py() or ""


def _bundler(size: int, seed: int):
    """Texts with a language -> one row for each language of a batch: the sum of its texts' vectors, in whole numbers."""

    def bundle(batches):
        encoder = Encoder(size, seed)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            own: dict[int, dict[int, int]] = {}
            for lang, text in zip(langs.indices.to_pylist(), _batches(batch.column(1)), strict=True):
                mine = own.setdefault(lang, {})
                for k, c in zip(*(x.tolist() for x in encoder.counts(text)), strict=True):
                    mine[k] = mine.get(k, 0) + c
            names, sums = [], []
            for lang, mine in own.items():
                total = np.zeros(size)
                key, count = np.fromiter(mine, np.int64, len(mine)), np.fromiter(mine.values(), np.int64, len(mine))
                for at in range(0, len(key), 8192):
                    total += np.rint(encoder.encode(key[at : at + 8192], count[at : at + 8192]).astype(np.float64))
                names.append(langs.dictionary[lang].as_py())
                sums.append(total.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.tolist() for x in sums], pa.list_(pa.int64()))], names=["lang", "vector"])

    return bundle


def language_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 1024, seed: int = 11) -> DataFrame:
    """lang, vector: one row per language, from all rows with a text and a language.

    Tasks add up their texts first; what is shuffled is one vector for each language and Arrow batch.
    """
    slim = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("t")).where("lang is not null and t is not null")
    parts = slim.mapInArrow(_bundler(size, seed), "lang string, vector array<bigint>")
    added = parts.select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda s: s.x).alias("vector"))


def _judge(size: int, seed: int, names: list[str], prototypes: np.ndarray, last: bool):
    """Rows with their best language so far -> with the best of these as well; the text goes on unless it is the last block."""
    norms = np.linalg.norm(prototypes, axis=1)
    units = (prototypes / np.maximum(norms, 1e-12)[:, None]).astype(np.float32)

    def judge(batches):
        encoder = Encoder(size, seed)
        for batch in batches:
            lang, best = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, text in enumerate(_batches(batch.column(2)) if names else ()):
                key, count = encoder.counts(text)
                if not len(key):
                    continue
                own = np.zeros(size, np.float32)
                for at in range(0, len(key), 8192):
                    own += encoder.encode(key[at : at + 8192], count[at : at + 8192])
                cosine = units @ own / max(float(np.linalg.norm(own)), 1e-12)
                top = int(np.argmax(cosine))
                if float(cosine[top]) > best[i]:
                    lang[i], best[i] = names[top], float(cosine[top])
            carried = ["doc_id", "held_out"] if last else ["doc_id", "held_out", "t"]
            columns = [*batch.columns[: len(carried)], pa.array(lang, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "lang_pred", "cosine"])

    return judge


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = 1024, seed: int = 11, most_languages: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Prototypes are learnt from the rows that are not held out and have a text and a language; a prediction sees the text alone. score is the cosine with the
    best prototype, 0 at least. The driver reads the prototypes, `size` numbers for each language, in blocks of `most_languages`: each block is one
    pass over the texts, and between two of them the rows are a table in the shared folder.

    Null texts and texts without letters, and all texts if nothing could be learnt, are `und` with score 0. Of equal cosines the
    language first by code point wins. A null id is not held out. Repeated rows count as often as they come. Other columns are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    tables = Tables(docs.sparkSession)
    learnt = tables.put(language_prototypes(docs.where(~held_out(F.col(doc_id))), text, lang, size, seed))
    rows, rest, last = slim.withColumns({"lang_pred": F.lit("und"), "cosine": F.lit(-2.0)}), learnt, False
    while not last:
        known = rest.orderBy("lang").limit(most_languages).collect()
        last = len(known) < most_languages
        prototypes = np.array([r.vector for r in known], np.float64).reshape(len(known), size)
        judge, carried = _judge(size, seed, [r.lang for r in known], prototypes, last), "" if last else "t string, "
        before, rows = rows, rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, {carried}lang_pred string, cosine double")
        if not last:
            rows, rest = tables.put(rows), learnt.where(F.col("lang") > known[-1].lang)
            tables.drop(before)
    tables.drop(learnt)
    return rows.select("doc_id", "held_out", "lang_pred", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "cosine")).alias("score"))
