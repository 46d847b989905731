"""Benchmark decontamination: rare runs of one or two words, of which every match must hold some, find passages; Smith-Waterman alignment over words scores them."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import words
from ._words import Words, read_words

#: Words of test items that one pass over the corpus carries to every task; more items take more passes.
BLOCK_WORDS = 1 << 20
MATCH, OTHER, GAP = 2, -1, -1
#: Hits looked at together, words over which starts are joined to a passage, and passage words aligned together.
PART, STRETCH, CELLS = 1 << 21, 1 << 12, 1 << 14


@dataclass
class Items:
    """Test items as word hashes, and the seeds of them: hash of a run of words and item, for runs of one word and of two.

    An alignment with m of an item's L words and e errors scores 2m - e, and passes at T = 2 * threshold * L. It spans at most
    3L - T words of a text, in which at least T - L - 1 pairs of adjacent words of the item stand, and at least T / 2 of its words.
    Items of which no pair is certain are looked for by their words.

    Of as many seeds as a match needs, up to half may be its commonest ones: an item drops these, and is then met by the rest (its rare seeds), of which a match
    still has as many as it needs less those dropped. That holds whatever the counts are, so they decide how much is done and not what is found.
    """

    ids: list
    words: list[np.ndarray]
    need: np.ndarray
    span: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def read(cls, rows: list, n: int, threshold: float) -> "Items":
        ids, texts = [r[0] for r in rows], pa.array([r[1] for r in rows], pa.large_string())
        own, found = [], {1: [], 2: []}
        for w in read_words(texts, plain=True):
            first = w.first()
            own += [w.hash[first[k] : first[k + 1]] for k in range(w.hi - w.lo)]
            for q in found:
                at, grams = w.grams(q)
                found[q].append((grams, w.lo + w.doc[at]))
        length = np.array([len(x) for x in own], np.int64)
        least = MATCH * threshold * length
        pairs = np.ceil(least - length - 1 - 1e-9).astype(np.int64)
        need = np.where(pairs > 0, pairs, np.maximum(1, np.ceil(least / MATCH - 1e-9))).astype(np.int64)
        span = np.maximum(length, np.floor(3 * length - least + 1e-9)).astype(np.int64)
        seeds = {}
        for q, parts in found.items():
            seed, item = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            use = (length[item] >= n) & ((pairs[item] > 0) == (q == 2))
            order = np.lexsort((item[use], seed[use]))
            seed, item = seed[use][order], item[use][order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])
            first = np.flatnonzero(new)
            seeds[q] = seed[first], item[first], np.diff(first, append=len(seed))
        return cls(ids, own, need, span, seeds)

    def rare(self, counts: dict[int, np.ndarray]) -> "Items":
        """These items with their rare seeds only. counts: how often each distinct seed, in ascending order, is in the corpus.

        A seed costs its count in the corpus for each item that has it. The dearest of an item go, by their places in it, while these are at most half of what a match needs.
        """
        need, seeds = self.need.copy(), {}
        for q, (seed, item, times) in self.seeds.items():
            distinct, number, items = np.unique(seed, return_inverse=True, return_counts=True)
            cost = (counts[q] * items)[number] if len(distinct) else np.zeros(0, np.int64)
            order = np.lexsort((seed, -cost, item))
            own = item[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            run = np.cumsum(times[order])
            run -= np.repeat(run[first] - times[order][first], np.diff(first, append=len(own)))
            gone = run <= self.need[own] // 2
            np.subtract.at(need, own[gone], times[order][gone])
            kept = np.sort(order[~gone])
            seeds[q] = seed[kept], item[kept], times[kept]
        return Items(self.ids, self.words, need, self.span, seeds)

    def counted(self, w: Words) -> dict[int, np.ndarray]:
        """How often each distinct seed, in ascending order, is in the texts."""
        if not hasattr(self, "_distinct"):
            self._distinct = {q: np.unique(seed) for q, (seed, _, _) in self.seeds.items()}
        out = {}
        for q, distinct in self._distinct.items():
            _, grams = self._found(w, q)
            at = np.searchsorted(distinct, grams)
            hit = distinct[np.minimum(at, len(distinct) - 1)] == grams if len(distinct) else np.zeros(0, bool)
            out[q] = np.bincount(at[hit], minlength=len(distinct))
        return out

    def _found(self, w: Words, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of those runs of q words that may be a seed."""
        at, grams = w.grams(q)
        maybe = np.flatnonzero(self._sieve(q)[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        return at[maybe], grams[maybe]

    def starts(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Word and item of every place of the texts from which as many seeds of the item as a match needs stand within its span."""
        places, items = [], []
        for q, (seed, item, _) in self.seeds.items():
            if not len(seed):
                continue
            at, grams = self._found(w, q)
            lo, hi = np.searchsorted(seed, grams), np.searchsorted(seed, grams, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            at, lo, hi = at[hit], lo[hit], hi[hit]
            past = np.cumsum(hi - lo)
            # PART hits at a time, also of one text, and with them what lies within the longest span after
            cuts = np.flatnonzero(np.diff(past // PART, prepend=-1))
            reach = int(self.span[item].max())
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                more = int(np.searchsorted(at, at[b - 1] + reach, "right"))
                number = (hi - lo)[a:more]
                own = np.cumsum(number)
                place = np.repeat(at[a:more], number)
                which = item[np.arange(own[-1]) + np.repeat(lo[a:more] - (own - number), number)]
                order = np.argsort(which.astype(np.uint16) if len(self.ids) <= 1 << 16 else which, kind="stable")
                place, which = place[order], which[order]
                last = np.arange(len(place)) + self.need[which] - 1
                inside = last < len(place)
                last = np.minimum(last, len(place) - 1)
                good = inside & (which[last] == which) & (w.doc[place[last]] == w.doc[place]) & (place[last] - place <= self.span[which] - q) & (place <= at[b - 1])
                places.append(place[good])
                items.append(which[good])
        return (np.concatenate(places), np.concatenate(items)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _sieve(self, q: int) -> np.ndarray:
        if not hasattr(self, "_sieves"):
            self._sieves = {k: np.zeros(1 << 20, bool) for k in self.seeds}
            for k, (seed, _, _) in self.seeds.items():
                self._sieves[k][(seed & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return self._sieves[q]


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of an item with each passage, and the passage word on which it ends."""
    return align_each([item] * len(passages), passages)


def _table(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several lengths as one array, and which cells are of a row."""
    real = np.arange(max(map(len, rows))) < np.array([[len(r)] for r in rows])
    cells = np.zeros(real.shape, np.uint64)
    cells[real] = np.concatenate(rows)
    return cells, real


def align_each(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As align(), with an item for each passage."""
    (text, real), (item, word) = _table(passages), _table(items)
    slope = np.arange(text.shape[1] + 1) * -GAP
    above = np.zeros((len(passages), text.shape[1] + 1), np.int64)
    best, end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    for k in range(item.shape[1]):  # past the end of an item nothing matches and no score rises
        row = np.zeros_like(above)
        same = (text == item[:, k, None]) & real & word[:, k, None]
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, MATCH, OTHER), above[:, 1:] + GAP)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope  # gaps in the item
        above = row
        at = np.argmax(row, axis=1)
        top = row[np.arange(len(row)), at]
        end = np.where(top > best, at - 1, end)
        best = np.maximum(best, top)
    return best, end


def _counter(items: Items):
    def count(batches):
        total = {q: np.zeros(len(np.unique(seed)), np.int64) for q, (seed, _, _) in items.seeds.items()}
        for batch in batches:
            for w in read_words(batch.column(0), plain=True):
                for q, n in items.counted(w).items():
                    total[q] += n
        for q, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, np.int32)), pa.array(at), pa.array(n[at])], names=["q", "seed", "n"])

    return count


def seed_counts(slim: DataFrame, items: Items) -> dict[int, np.ndarray]:
    """How often each distinct seed of the items is in all texts: added up in each task, then by seed. No more numbers than the items have seeds reach the driver."""
    rows = slim.select("t").mapInArrow(_counter(items), "q int, seed long, n long").groupBy("q", "seed").agg(F.sum("n").alias("n")).collect()
    out = {q: np.zeros(len(np.unique(seed)), np.int64) for q, (seed, _, _) in items.seeds.items()}
    for q, seed, n in rows:
        out[q][seed] = n
    return out


def _aligner(items: Items, threshold: float):
    def find(batches):
        for batch in batches:
            out = []
            for w in read_words(batch.column(1), plain=True):
                at, item = items.starts(w)
                if len(at):
                    out += _passages(items, w, at, item, threshold)
            rows, item, score, start = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(start, pa.int64())],
                names=["doc_id", "item", "score", "end_word"],
            )

    return find


def _passages(items: Items, w: Words, at: np.ndarray, item: np.ndarray, threshold: float) -> list:
    """Aligns each item with all that lies within its span of a start; spans that meet are one passage, up to STRETCH words of starts."""
    order = np.lexsort((at, item))
    at, item = at[order], item[order]
    doc, span = w.doc[at], items.span[item]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * span[1:]) | (at[1:] // STRETCH != at[:-1] // STRETCH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1
    bounds = w.first()
    item, doc, span = item[first], doc[first], span[first]
    lo, hi = np.maximum(at[first] - span, bounds[doc]), np.minimum(at[last] + span, bounds[doc + 1])
    length = np.array([len(x) for x in items.words])[item]
    order = np.lexsort((length, hi - lo))
    heavy = np.cumsum((hi - lo)[order]) // CELLS
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(heavy)) + 1):
        score, end = align_each([items.words[k] for k in item[part]], [w.hash[lo[c] : hi[c]] for c in part])
        share = score / (MATCH * length[part])
        for c, s, e in zip(part, share, end, strict=True):
            if s >= threshold:
                out.append((w.lo + doc[c], int(item[c]), float(s), int(lo[c] + e - bounds[doc[c]])))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 4, threshold: float = 0.6) -> DataFrame:
    """doc_id, item_id, score, end_word: documents that hold a test item, with the best score of each item and the word on which it ends.

    Words are runs without white space or ASCII punctuation, A-Z lowered. score is the best local alignment (match 2, other
    word or gap -1) over twice the item's words; all of `threshold` or more count. What is aligned are the places that hold as many
    of an item's rare word pairs (or words) as such an alignment cannot do without, so none is missed. How rare they are is counted over all texts first.

    Texts never leave their task and only hits are shuffled; a very common passage is many rows of output and no larger
    group anywhere. Items travel to all tasks, at most BLOCK_WORDS words in one pass.

    Null texts and items, and items under n words, match nothing; null ids come back null. Repeated rows give the row of their id once. Other
    columns are not read. An empty table on either side gives an empty result.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.size(words(F.col("t"))))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t"))
    kind, item_kind = slim.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    spark, out = docs.sparkSession, None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).orderBy("item_id", "t").collect()
        own = Items.read([tuple(r) for r in rows], n, threshold)
        own = own.rare(seed_counts(slim, own))
        names = spark.createDataFrame(list(enumerate(own.ids)), f"item long, item_id {item_kind}")
        found = slim.mapInArrow(_aligner(own, threshold), f"doc_id {kind}, item long, score double, end_word long")
        found = found.groupBy("doc_id", "item").agg(F.max(F.struct("score", "end_word")).alias("s"))
        found = found.join(names, "item").select("doc_id", "item_id", "s.score", "s.end_word")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of docs whose id has no hit in contaminated(), with all their columns; rows with a null id stay."""
    bad = contaminated(docs, benchmark, doc_id, text, **settings).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(bad, doc_id, "left_anti")
