"""Binary records: round trips, ids as the tokenizers library gives them, known checksums, damage."""

import random
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import DOC, ODD, clashing, documents
from tokenizers import Tokenizer

from tracemill.llm import queries, records

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def encoded(texts):
    encoder = records.Encoder(Path(PATH).read_text(), 2)
    return [ids[bounds[k] : bounds[k + 1]].tolist() for ids, bounds in encoder.texts(pa.array(texts, pa.string())) for k in range(len(bounds) - 1)]


def test_ids_are_those_of_whole_texts(plain, monkeypatch):
    """All texts of a table, and texts of white space of all kinds, marks, contractions and special tokens around spaces."""
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​", "a", "don't", "'s", "'", "É", "日本", "𝒳", "12", "-", "…", "<|endoftext|>", "?!", "\xe0", "ま"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    texts += [None, "", " ", "x" * 100_000, "é " * 50_000]
    want = [plain(t) for t in texts]
    assert encoded(texts) == want
    monkeypatch.setattr(records, "SLICE", 1000)
    monkeypatch.setattr(records, "REMEMBERED", 10)
    assert encoded(texts) == want


def test_only_ids_are_asked_for(plain):
    """Pieces are encoded without their places in the text, and taken from their buffer; plain ones of which some are known already, too."""
    encoder = records.Encoder(Path(PATH).read_text(), 2)
    real = encoder.tokenizer

    class OnlyIds:
        def encode_batch_fast(self, texts, add_special_tokens):
            return real.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = OnlyIds()
    words = [f" w{k % 700}q{k % 11}" for k in range(3000)]
    for text in ("".join(words[:900]), "".join(words), "", "a\u3000b\xa0 c\x85d"):
        got = [ids.tolist() for ids, _ in encoder.texts(pa.array([text]))]
        assert got == [plain(text)]
    some = pa.array([b"a", b"", b"bcd", b"e"], pa.large_binary())
    for k in range(5):
        assert records._values(some[k:]) == some[k:].to_pylist() and records._values(some[:k]) == some[:k].to_pylist()


def test_checksums():
    """The published value for the nine digits, and plain bit by bit sums of parts of all lengths."""

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        c ^= 0xFFFFFFFF
        return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF

    assert (0xE3069283 >> 15 | 0xE3069283 << 17 & 0xFFFFFFFF) + 0xA282EAD8 & 0xFFFFFFFF == slow(b"123456789") == records.masked_crc32c([b"123456789"])[0]
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (4, 5, 7, 8, 9, 100, 1000, 4099, *range(10, 40))]
    assert records.masked_crc32c(parts).tolist() == [slow(p) for p in parts]


def test_frames_and_damage():
    payloads = [struct.pack(records.HEAD, 1, 2, True, k) + np.arange(k, dtype="<u2").tobytes() for k in range(50)]
    data = b"\n".join([*records.frames(payloads), b""])
    got = list(records.unframe(memoryview(data), "f"))
    assert [bytes(p) for _, _, p in got] == payloads
    assert all(data[o : o + 8] == struct.pack("<Q", n - 17) and data[o + n - 1] == 10 for o, n, _ in got)
    rng = random.Random(2)
    for _ in range(60):
        at = rng.randrange(len(data))
        broken = bytearray(data)
        broken[at] ^= 1 << rng.randrange(8)
        with pytest.raises(ValueError, match="damaged"):
            list(records.unframe(memoryview(bytes(broken)), "f"))
    with pytest.raises(ValueError, match="damaged"):
        list(records.unframe(memoryview(data[:-5]), "f"))
    assert list(records.unframe(memoryview(b""), "f")) == []


def expected(rows, plain):
    """Of texts by id, the ids in order, the index columns; rows of one id in any order."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text)
        out.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_write_and_read(spark, plain, tmp_path):
    """The whole round: index, offsets in the files, all records read back, in order and shuffled."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    at = f"file://{tmp_path}/r"
    index = records.write_records(docs, at, PATH, shard_bytes=100_000).orderBy("start").collect()
    want = expected(rows, plain)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in index] == want
    assert [r.start for r in index] == [0, *np.cumsum([w[1] for w in want])[:-1].tolist()]
    assert [r.shard for r in index] == sorted(r.shard for r in index) and len({r.shard for r in index}) >= 4
    for r in index[:: len(index) // 20]:
        data = (tmp_path / "r/shards" / r.shard).read_bytes()[r.offset : r.offset + r.length]
        (_, _, payload), *_ = records.unframe(memoryview(data), r.shard)
        assert records._payload_ids(payload)[0] == r.doc_id
    ids = {d: plain(t) for d, t in rows}
    assert {r.doc_id: r.ids for r in records.read_records(spark, at).collect()} == ids
    one, two, other = ([(r.doc_id, r.ids) for r in records.read_shuffled(spark, at, seed).collect()] for seed in (5, 5, 6))
    assert dict(one) == ids and one == two != other and one != sorted(one)
    shard = tmp_path / "r/shards" / index[-1].shard
    data = bytearray(shard.read_bytes())
    data[40] ^= 4
    shard.write_bytes(bytes(data))
    (tmp_path / "r/shards" / f".{shard.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(spark, at).count()


def test_odd_rows(spark, plain, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows, columns with clashing names, no rows."""
    want = sorted(expected([r[:2] for r in ODD], plain), key=repr)
    other = clashing(documents(spark, ODD))
    for c in ("h", "_salt", "value", "shard", "start"):
        other = other.withColumn(c, F.lit("x"))
    for k, df in enumerate((documents(spark, ODD), other)):
        rows = records.write_records(df, f"{tmp_path}/{k}", PATH).orderBy("start").collect()
        assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], key=repr) == want
        assert [r.doc_id for r in rows] == sorted([r[0] for r in ODD], key=lambda x: (x is not None, x or 0))
        assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert records.write_records(spark.createDataFrame([], DOC), f"{tmp_path}/none", PATH).count() == 0
    assert records.read_records(spark, f"{tmp_path}/none").count() == 0


def test_large_ids_take_four_bytes():
    payload = struct.pack(records.HEAD, 1, 4, False, 0) + np.array([70_000, 2], "<u4").tobytes()
    doc_id, ids = records._payload_ids(memoryview(payload))
    assert doc_id is None and ids.tolist() == [70_000, 2]


def test_query(spark, plain):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = queries.op11_records(spark, SF).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == expected(rows, plain)
