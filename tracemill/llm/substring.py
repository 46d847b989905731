"""Removal of passages that repeat across documents, by super-k-mer partitioning of word windows.

A window is `n` consecutive words. Its minimiser is the run of `m` words in it with the smallest
hash; consecutive windows with the same minimiser travel together, as one packed string, to the bucket of
that minimiser, where sorting finds equal windows exactly once each and the smallest document that has them.
"""

import hashlib
import itertools
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import versioned
from ._words import Words, _slice, mix, read_words

#: Bytes of text for each task that counts windows; the number of buckets follows the input.
PART_BYTES = 64 << 20
#: Bytes of text that one packing covers: equal strings inside it travel once.
PACK = 16 << 20


def _runs(w: Words, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimiser's offset and minimiser of each super-k-mer."""
    at, whole = w.grams(n)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    count = len(w.hash) - m + 1
    grams = w.hash[:count] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, m):
        grams = mix(grams + w.hash[k : count + k], 11 * k)
    best, place = grams[at].copy(), at.copy()
    for k in range(1, n - m + 1):
        other = grams[at + k]
        less = other < best
        best[less] = other[less]
        place[less] = at[less] + k
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(first, append=len(at)), place[first] - at[first], best[first]


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., for length[0] numbers, then the same for start[1] and so on."""
    past = np.cumsum(length)
    return np.arange(past[-1] if len(past) else 0) + np.repeat(start - (past - length), length)


class _Pack:
    """Collects the super-k-mers of some texts and gives a packed row for each bucket."""

    def __init__(self, n: int, m: int, buckets: int):
        self.n, self.m, self.buckets = n, m, buckets
        self.clear()

    def clear(self) -> None:
        self.data, self.size, self.parts, self.ids, self.versions = [], 0, [], [], []

    def add(self, w: Words, ids: np.ndarray, versions: np.ndarray) -> None:
        first, windows, offset, minimiser = _runs(w, self.n, self.m)
        data = w.data.copy()
        data[(data >= 9) & (data <= 13)] = 32
        if len(first):
            last = first + windows + self.n - 2
            at, whole = w.grams(self.n)
            head = whole[np.searchsorted(at, first)]
            tail = whole[np.searchsorted(at, first + windows - 1)]
            text = mix(mix(head + windows.astype(np.uint64)) + tail, 17)
            begin = w.first()[w.doc[first]]
            known = len(self.ids) and sum(map(len, self.ids)) or 0
            self.parts.append((self.size + w.start[first], w.end[last] - w.start[first], offset, minimiser, text, known + w.doc[first], first - begin))
        self.ids.append(ids)
        self.versions.append(versions)
        self.data.append(data)
        self.size += len(data)

    def rows(self):
        """(bucket, texts, places) for each bucket that has any."""
        if self.parts:
            data = np.concatenate([*self.data, np.full(1, 10, np.uint8)])
            ids, versions = np.concatenate(self.ids), np.concatenate(self.versions)
            start, length, offset, minimiser, text, doc, word = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            bucket = (mix(minimiser, 23) % np.uint64(self.buckets)).astype(np.int64)
            order = np.lexsort((np.arange(len(text)), text, bucket))
            new = np.ones(len(order), bool)
            new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (text[order][1:] != text[order][:-1])
            entry = np.cumsum(new) - 1
            firsts = order[new]
            rank = np.empty(len(firsts), np.int64)  # entries in the order of their first places, for close numbers
            rank[np.lexsort((firsts, bucket[firsts]))] = np.arange(len(firsts))
            order = order[np.lexsort((order, rank[entry]))]
            count = np.bincount(rank[entry], minlength=len(firsts))
            heads = np.cumsum(count) - count
            firsts = order[heads]
            edges = np.searchsorted(bucket[firsts], np.arange(self.buckets + 1))
            zip_ = zstandard.ZstdCompressor(level=3)
            for b in range(self.buckets):
                lo, hi = edges[b], edges[b + 1]
                if lo == hi:
                    continue
                own = firsts[lo:hi]
                size = length[own] + 1
                packed = data[np.minimum(_ragged(start[own], size), len(data) - 1)]
                packed[np.cumsum(size) - 1] = 10
                places = order[heads[lo] : heads[hi - 1] + count[hi - 1]]
                docs, at = np.unique(doc[places], return_inverse=True)
                numbers = [np.array([hi - lo, len(places), len(docs)]), np.diff(ids[docs], prepend=0), versions[docs], offset[own], count[lo:hi], np.diff(at, prepend=0), word[places]]
                yield b, zip_.compress(packed.tobytes()), zip_.compress(b"".join(_columns(x) for x in numbers))
        self.clear()


def _columns(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte, so that equal high bytes stand together."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()


def _packer(n: int, m: int, buckets: int):
    def pack(batches):
        own = _Pack(n, m, buckets)

        def flush():
            rows = list(own.rows())
            for k in range(0, len(rows), 64):
                b, texts, places = zip(*rows[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(texts, pa.binary()), pa.array(places, pa.binary())], names=["bucket", "texts", "places"])

        for batch in batches:
            ids, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for w in read_words(batch.column(2)):
                own.add(w, ids[w.lo : w.hi], versions[w.lo : w.hi])
                if own.size >= PACK:
                    yield from flush()
        yield from flush()

    return pack


def _unpacked(raw: bytes):
    """Of one row: per entry minimiser's offset and number of places; per place document, version and first word."""
    head = _numbers(raw, 0, 3)
    at, out = 24, []
    for n in (head[2], head[2], head[0], head[0], head[1], head[1]):
        out.append(_numbers(raw, at, int(n)))
        at += 8 * int(n)
    ids, versions, offset, count, doc, word = out
    doc = np.cumsum(doc)
    return offset, count, np.cumsum(ids)[doc], versions[doc], word


class _Bucket:
    """Windows of one bucket. Packed rows beyond 64 MB wait in an unnamed file of the task; windows stay as numbers."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m
        self.rows = tempfile.SpooledTemporaryFile(64 << 20)
        self.sizes, self.windows = [], []

    def add(self, texts: bytes, places: bytes) -> None:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        offset, count, ids, _, _ = _unpacked(zstandard.ZstdDecompressor().decompress(places))
        bounds = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
        w = _slice(0, len(bounds) - 1, raw, bounds)
        at, whole = w.grams(self.n)
        entry = w.doc[at]
        key = w.first()[:-1] + offset
        minimiser = w.hash[key] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, self.m):
            minimiser = mix(minimiser + w.hash[key + k], 11 * k)
        low = np.minimum.reduceat(ids, np.cumsum(count) - count)
        self.windows.append((minimiser[entry], whole, low[entry]))
        number = np.bincount(entry, minlength=len(offset)).astype(np.int32)
        self.rows.write(places)
        self.rows.write(number.tobytes())
        self.sizes.append((len(places), number.nbytes))

    def spans(self):
        """document, version, first word, number of words for all that is to go."""
        minimiser, whole, low = (np.concatenate(x) for x in zip(*self.windows, strict=True))
        self.windows = []
        order = np.lexsort((low, whole, minimiser))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order][1:] != whole[order][:-1]) | (minimiser[order][1:] != minimiser[order][:-1])
        smallest = np.empty(len(order), np.int64)
        smallest[order] = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        self.rows.seek(0)
        at = 0
        for size, more in self.sizes:
            _, count, ids, versions, word = _unpacked(zstandard.ZstdDecompressor().decompress(self.rows.read(size)))
            number = np.frombuffer(self.rows.read(more), np.int32).astype(np.int64)
            first = np.cumsum(number) - number
            own = smallest[at : at + int(number.sum())]
            at += len(own)
            entry = np.repeat(np.arange(len(count)), count)
            some = np.flatnonzero(np.minimum.reduceat(own, first)[entry] < ids)
            if not len(some):
                continue
            length = number[entry[some]]
            gone = own[_ragged(first[entry[some]], length)] < np.repeat(ids[some], length)
            place = np.repeat(np.arange(len(some)), length)
            start = _ragged(word[some], length)
            hit = np.flatnonzero(gone)
            place, start = place[hit], start[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            begin = np.flatnonzero(new)
            words = np.diff(begin, append=len(hit)) + self.n - 1
            yield ids[some][place[begin]], versions[some][place[begin]], start[begin], words
        self.rows.close()


def _finder(n: int, m: int):
    def find(batches):
        rows = ((b, t, p) for batch in batches for b, t, p in zip(*(batch.column(k) for k in range(3)), strict=True))
        for _, group in itertools.groupby(rows, lambda r: r[0].as_py()):
            bucket = _Bucket(n, m)
            for _, texts, places in group:
                bucket.add(texts.as_py(), places.as_py())
            for ids, versions, start, words in bucket.spans():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(versions.astype(np.int32)), pa.array(start << 32 | words)], names=["id", "version", "span"])

    return find


def _remover(batches):
    """id, text, spans -> words, removed words, kept text (words joined by one space)."""
    for batch in batches:
        total, removed, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            words = (text.as_py() or "").encode().split()
            total.append(len(words))
            if spans.is_valid:
                packed = np.asarray(spans.values)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, packed >> 32, 1)
                np.add.at(edge, (packed >> 32) + (packed & 0xFFFFFFFF), -1)
                stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                words = [words[k] for k in stay]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _digest(batches):
    """As _remover, with the SHA-256 of the kept text in its place."""
    for batch in _remover(batches):
        digest = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 13, m: int = 3) -> DataFrame:
    """id, version, span (first word << 32 | number of words) of all words in a window that a smaller id has too.

    version numbers the distinct texts of a repeated id, 0 for an id with one row.
    """
    spark = docs.sparkSession
    slim = versioned(docs, doc_id, text).where("id is not null")
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    packed = slim.select("id", "version", "t").mapInArrow(_packer(n, m, 4 * parts), "bucket int, texts binary, places binary")
    dealt = packed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_finder(n, m), "id long, version int, span long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 13, m: int = 3, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept_sha256 if digest) for every row.

    A word goes if some window of n words that covers it also starts in a document with a smaller id; windows are
    those of the input. Kept words are joined by one space.

    Null text has no words. Rows with a null id keep all their words and make no other row lose any. Of an id that
    repeats, equal texts get equal results, and its texts are not held against each other. Texts under n words and an
    empty table lose nothing. Other columns are not read.
    """
    spans = repeated_spans(docs, doc_id, text, n, m).groupBy("id", "version").agg(F.collect_list("span").alias("spans"))
    slim = versioned(docs, doc_id, text)
    joined = slim.join(spans, ["id", "version"], "left").select("id", "t", "spans")
    last = "kept_sha256" if digest else "kept_text"
    return joined.mapInArrow(_digest if digest else _remover, f"doc_id long, n_words long, n_removed long, {last} string")
