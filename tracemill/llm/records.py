"""Token ids of documents as length-delimited binary records, with a separate index of their offsets.

A file (shard) is a run of frames. A frame is the length of the payload (8 bytes), the masked CRC-32C of these 8 bytes (4), the payload,
its masked CRC-32C (4) and a line feed, which is what Spark's text writer ends rows with: so files come from Spark's own writer, on any
file system and with its commits. A payload is 1, the bytes of an id (2 or 4), whether there is a document id (0 or 1), 0, the document id (8)
and the ids. All numbers are little-endian.
"""

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._order import in_ranges
from ._shared import TIDY, Tables

#: Bytes of text in a shard, and of text that a task has in hand at once; one longer text is a piece of its own.
SHARD_BYTES, SLICE = 64 << 20, 4 << 20
#: Distinct pieces after which a worker forgets those that it has not met since the last time.
REMEMBERED = 300_000
#: Plain pieces that are encoded as one text.
TOGETHER = 250
LETTER = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
HEAD, HEAD_SIZE = "<BBBxq", 12
INDEX = "shard string, doc_id long, offset long, length long, start long, n_tokens long, ids_crc32 long"


# --- checksums


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _first_tables() -> np.ndarray:
    """Four tables that take a remainder past four more zero bytes; applied to four bytes of data they give its remainder."""
    out = [_byte_table()]
    for _ in range(3):
        out.append((out[-1] >> 8) ^ out[0][out[-1] & 255])
    return np.stack(out[::-1])


_SKIP = [_first_tables()]


def _skip(k: int) -> np.ndarray:
    """As _first_tables(), for 4 * 2**k zero bytes."""
    while len(_SKIP) <= k:
        one = np.arange(256, dtype=np.uint32)
        _SKIP.append(np.stack([_apply(_SKIP[-1], _apply(_SKIP[-1], one << np.uint32(8 * j))) for j in range(4)]))
    return _SKIP[k]


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each part, of four bytes at least. Parts of like size are taken together, and halves are joined in a tree:
    zeros in front do not change a remainder, so that each part can be filled up to a power of two."""
    out = np.zeros(len(parts), np.uint32)
    sizes = np.array([len(p) for p in parts], np.int64)
    rank = np.ceil(np.log2(np.maximum(1, (sizes + 3) // 4))).astype(int)
    for k in np.unique(rank):
        rows = np.flatnonzero(rank == k)
        step = max(1, SLICE >> (int(k) + 2))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            raw = np.zeros((len(some), 4 << int(k)), np.uint8)
            for r, at in enumerate(some):
                raw[r, raw.shape[1] - sizes[at] :] = np.frombuffer(parts[at], np.uint8)
                raw[r, raw.shape[1] - sizes[at] :][:4] ^= 255
            value = _apply(_skip(0), raw.view("<u4"))
            for level in range(int(k)):
                value = _apply(_skip(level), value[:, ::2]) ^ value[:, 1::2]
            out[some] = ~value[:, 0]
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(0xA282EAD8)


# --- ids


def _values(words: pa.LargeBinaryArray) -> list[bytes]:
    """As to_pylist(), without a scalar for each value; there are no nulls."""
    if not len(words):
        return []
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw, bounds = bytes(words.buffers()[2][int(bounds[0]) : int(bounds[-1])]), (bounds - bounds[0]).tolist()
    return [raw[x:y] for x, y in pairwise(bounds)]


class Encoder:
    """Ids of texts by a tokenizer that cuts texts into words before anything else, as byte-level ones with its pattern do.

    A text is cut where words end whatever stands around: before white space and ASCII marks that follow something else, and after a single
    line end or tab. So the pieces have the ids that they have in the text, and each distinct piece is encoded once. Marks of special tokens
    cut nothing.
    """

    #: A space and one word: what a text of such pieces is cut into again at the tokens that start with a space.
    PLAIN = re.compile(rb" [^\x00-\x20]+(?<!\xc2[\x85\xa0])(?<![\xe1-\xe3]..)", re.S)

    def __init__(self, tokenizer: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id, self.known, self.older = Tokenizer.from_str(tokenizer), end_id, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[k for t, k in vocabulary.items() if t.startswith("Ġ")]] = True
        special = set("".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.mark = np.zeros(256, bool)
        self.mark[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in special]] = True

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = [known.get(w) for w in words]
        plain, rest, new = [], [], [k for k, p in enumerate(out) if p is None]
        for w in (words[k] for k in new):
            if w in older:
                known[w] = older[w]
            elif self.PLAIN.fullmatch(w):
                plain.append(w)
            else:
                rest.append(w)
        for lo in range(0, len(plain), TOGETHER):
            some = plain[lo : lo + TOGETHER]
            ids = np.array(self._ids([b"".join(some)])[0].ids, "<u4")
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(some):
                rest += some
                continue
            raw, bounds = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            known.update(zip(some, [raw[x:y] for x, y in pairwise(bounds)], strict=True))
        for lo in range(0, len(rest), 10_000):
            some = rest[lo : lo + 10_000]
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self._ids(some), strict=True))
        for k in new:
            out[k] = known[words[k]]
        return out

    def _ids(self, texts: list[bytes]) -> list:
        """Encodings of texts; only their ids are asked for, so places in the texts are not kept."""
        return self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the texts: all ids, and the bounds of each text's own; null is as empty, and each ends with the end id."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        every = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = min(len(texts), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1))
            yield self._slice(np.ascontiguousarray(every[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
            lo = hi

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = bounds[1:] > bounds[:-1]
        first = bounds[:-1][full]
        back = lambda k: np.r_[np.zeros(min(k, len(data)), np.uint8), data[:-k]]
        one, two, three = back(1), back(2), back(3)
        wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
        ended = (one > 32) & ~wide
        cut = (data <= 32) & ended | self.mark[data] & LETTER[one]
        single = (one >= 9) & (one <= 13) & (data > 32) & (data < 128)
        single[1:] &= ended[:-1]
        cut |= single
        cut[first] = True
        start = np.flatnonzero(cut)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.r_[start, len(data)].astype(np.int64)), pa.py_buffer(data)])
        distinct = words.dictionary_encode()
        code = np.asarray(distinct.indices)
        pieces = self.pieces(_values(distinct.dictionary))
        flat, size = np.frombuffer(b"".join(pieces), "<u4"), np.array([len(p) // 4 for p in pieces], np.int64)
        length = size[code] if len(code) else np.zeros(0, np.int64)
        begin = (np.cumsum(size) - size)[code] if len(code) else length
        text = np.searchsorted(bounds, start, "right") - 1
        own = np.bincount(text, length, len(full)).astype(np.int64) + 1 if len(start) else np.ones(len(full), np.int64)
        ends = np.cumsum(own)
        ids = np.empty(int(ends[-1]), "<u4")
        ids[ends - 1] = self.end_id
        body = np.ones(len(ids), bool)
        body[ends - 1] = False
        ids[body] = flat[np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)]
        return ids, np.r_[0, ends]


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _encoder(tokenizer: str, end_id: int) -> Encoder:
    """One for each worker: what it remembers serves later tasks too."""
    key = hash(tokenizer), end_id
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer, end_id)
    return _ENCODERS[key]


# --- frames


def frames(payloads: list[bytes]) -> list[bytes]:
    """The payloads framed, without the line feed."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    first, last = masked_crc32c(heads).astype("<u4"), masked_crc32c(payloads).astype("<u4")
    return [b"".join((h, first[k].tobytes(), p, last[k].tobytes())) for k, (h, p) in enumerate(zip(heads, payloads, strict=True))]


def unframe(data: memoryview, what: str) -> Iterator[tuple[int, int, memoryview]]:
    """Offset, length (both with all that frames a record) and payload of each record. Damaged or cut data raises ValueError."""
    at, some = 0, []

    def checked():
        heads, payloads = [bytes(data[o : o + 8]) for o, _, _ in some], [p for _, _, p in some]
        good = np.array([x for o, n, _ in some for x in (struct.unpack_from("<I", data, o + 8)[0], struct.unpack_from("<I", data, o + n - 5)[0])], np.uint32)
        bad = (masked_crc32c(heads) != good[::2]) | (masked_crc32c(payloads) != good[1::2])
        if bad.any():
            raise ValueError(f"{what}: damaged record at {some[int(np.flatnonzero(bad)[0])][0]}")
        yield from some
        some.clear()

    held = 0
    while at < len(data):
        size = struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else len(data)
        if at + 17 + size > len(data) or size < HEAD_SIZE or data[at + 16 + size] != 10:
            raise ValueError(f"{what}: damaged record at {at}")
        some.append((at, 17 + size, data[at + 12 : at + 12 + size]))
        at, held = at + 17 + size, held + size
        if held > SLICE:
            yield from checked()
            held = 0
    if some:
        yield from checked()


def _payload_ids(payload: memoryview) -> tuple[int | None, np.ndarray]:
    _, width, has, doc_id = struct.unpack_from(HEAD, payload)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=HEAD_SIZE)


def _writing(tokenizer, end_id: int, width: int):
    def write(batches):
        encoder = _encoder(tokenizer.value, end_id)
        for batch in batches:
            docs, lo = batch.column(0).to_pylist(), 0
            for ids, bounds in encoder.texts(batch.column(1)):
                ids = ids.astype(f"<u{width}")
                payloads = [struct.pack(HEAD, 1, width, d is not None, d or 0) + ids[bounds[k] : bounds[k + 1]].tobytes() for k, d in enumerate(docs[lo : lo + len(bounds) - 1])]
                lo += len(payloads)
                yield pa.RecordBatch.from_arrays([pa.array(frames(payloads), pa.binary())], names=["value"])

    return write


def _files(batches) -> Iterator[tuple[str, memoryview]]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            yield path.as_py().rpartition("/")[2], memoryview(content.as_buffer())


def _indexing(batches):
    for shard, data in _files(batches):
        rows, start = [], 0
        for offset, length, payload in unframe(data, shard):
            doc_id, ids = _payload_ids(payload)
            rows.append((shard, doc_id, offset, length, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            start += len(ids)
        if rows:
            names = [f.split()[0] for f in INDEX.split(", ")]
            kinds = [pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _sequences(payloads: Iterator[memoryview]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids in batches of about SLICE ids."""
    docs, sequences, held = [], [], 0
    for payload in payloads:
        doc_id, ids = _payload_ids(payload)
        docs.append(doc_id)
        sequences.append(ids.astype(np.int32))
        held += len(ids)
        if held > SLICE:
            yield _batch(docs, sequences)
            docs, sequences, held = [], [], 0
    if docs:
        yield _batch(docs, sequences)


def _batch(docs: list[int | None], sequences: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sequences)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sequences)))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), ids], names=["doc_id", "ids"])


def _reading(batches):
    return _sequences(payload for shard, data in _files(batches) for _, _, payload in unframe(data, shard))


def _fetching(path: str):
    def fetch(batches):
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(path)

        def payloads():
            for batch in batches:
                for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    with store.open_input_file(f"{top}/shards/{shard}") as file:
                        file.seek(offset)
                        data = memoryview(file.read(length))
                    yield from (payload for _, _, payload in unframe(data, shard))

        return _sequences(payloads())

    return fetch


# --- tables


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("path", "content")


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes path/shards (binary records, ids ascending through the files in the order of their names) and path/index (Parquet); returns the index.

    tokenizer: the JSON file of a byte-level tokenizer, read by the driver and sent to each executor once. A document is its tokenizer's ids, without
    special ones added, and end_id. Ids take two bytes each where the whole vocabulary allows it.
    Index: shard, doc_id, offset and length in bytes, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as 32-bit numbers). It is
    made from the files as written, each record checked, so that it cannot differ from them.

    Null and empty texts are the end id alone. Null document ids come first; of an id that repeats, rows come in the order of a hash of their
    texts, and equal rows can be in several shards. An empty table gives no record. Other columns are not read.

    Texts are shuffled once, in ranges. A file is read whole by a task: it has about shard_bytes of text, or one longer text.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        sent = f.read()
    most = max([end_id, *Tokenizer.from_str(sent).get_vocab(with_added_tokens=True).values()])
    body = docs[text].cast("string")
    slim = docs.select(docs[doc_id].cast("long").alias("id"), body.alias("t"), F.xxhash64(body).alias("h"))
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes)
    tables = Tables(spark)
    rows = in_ranges(slim, ["id", "h"], parts).select("id", "t")
    value = rows.mapInArrow(_writing(spark.sparkContext.broadcast(sent), end_id, 2 if most < 2**16 else 4), "value binary")
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        value.select(F.col("value").cast("string")).write.text(f"{path}/shards")
    finally:
        spark.conf.set(TIDY, before)
    found = tables.put(_shards(spark, path).mapInArrow(_indexing, INDEX))
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", F.expr("coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    index = found.join(before, "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")
    index.write.parquet(f"{path}/index")
    tables.drop(found)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of records: shard, doc_id, offset, length, start, n_tokens, ids_crc32."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of all records, each checked; damage raises."""
    return _shards(spark, path).mapInArrow(_reading, "doc_id long, ids array<int>")


def read_shuffled(spark: SparkSession, path: str, seed: int, parts: int | None = None) -> DataFrame:
    """doc_id, ids of all records in an order that seed gives, the same each time: rows ascend by a hash through the partitions.

    Only index rows are shuffled; each record is then read at its offset. path must be one that pyarrow opens on the executors.
    """
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read_index(spark, path).select("shard", "offset", "length", F.xxhash64(F.lit(seed), "shard", "offset").alias("place"))
    rows = rows.repartitionByRange(parts, "place").sortWithinPartitions("place").select("shard", "offset", "length")
    return rows.mapInArrow(_fetching(path), "doc_id long, ids array<int>")
