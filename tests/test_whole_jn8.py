import hashlib

from tracemill.plans.history import recovered_all


def test_long_texts_are_stored_and_cut(spark):
    texts = ["short", "x" * 65536, "é" * 40_000, "a" + "é" * 40_000]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.handle: (r.status, r.content_digest) for r in recovered_all(spark.createDataFrame(list(enumerate(texts)), "result_id long, output string")).collect()}
    assert got == {sha(t.encode())[:20]: ("ok", sha(t.encode()[:65536].decode(errors="ignore").encode())) for t in texts}
