"""Bounding tool results to a byte budget, and what that saves over a corpus."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import estimate_tokens

ELIDED = "[... middle left out ...]"
#: Words of lines worth keeping from the middle: totals of a run of tests, of its other counts, of faults.
TOTALS, COUNTS = "fail pass tests".split(), "cancelled skipped suites todo".split()
FAULTS = "assertion error exception fail failed failure fatal panic traceback".split()


def _lines_with(numbered: list[str], headed: list[str], *more: str) -> bytes:
    """A pattern for the starts of lines: # and one of the words, a verdict, one of the headings."""
    return r"(?im)^[^\S\n]*{}".format(T.any_of([rf"#[^\S\n]*{T.any_of(numbered)}\b", "test result:", rf"{T.any_of(headed)}:\s", *more])).encode()


#: Most telling first; how many and how much of such lines is kept.
TELLING = tuple(re.compile(p) for p in (
    _lines_with(TOTALS, ["Tests"]),
    _lines_with(TOTALS + COUNTS, ["Tests", "Test Suites"], r"=+[^=\n]*\b\d+[^\S\n]+(?:passed|failed)\b"),
    rf"(?i)\b{T.any_of(FAULTS)}\b".encode(),
    rb"(?i)\bwarning\b",
))
SUMMARIES, MOST_SUMMARIES, MOST_SALVAGED, LINE_BYTES = 2, 4, 8, 256


def _head(raw: bytes, n: int) -> bytes:
    return raw[:n].decode("utf-8", "ignore").encode() if n < len(raw) else raw


def _tail(raw: bytes, n: int) -> bytes:
    part = raw[len(raw) - n :] if n < len(raw) else raw
    while part and part[0] & 0xC0 == 0x80:
        part = part[1:]
    return part


def salvage(raw: bytes, lo: int, hi: int) -> list[bytes]:
    """Telling lines wholly inside bytes lo..hi, by class and place: at most 4 of the first two classes (summaries), 8 in all.

    Each class is searched for in the bytes as a whole; a hit is widened to its line, which counts for the first class that it is in.
    """
    known: dict[int, tuple[int, int]] = {}
    for rank, pattern in enumerate(TELLING):
        for hit in pattern.finditer(raw, max(0, lo), max(0, hi)):
            start = raw.rfind(b"\n", 0, hit.start()) + 1
            end = raw.find(b"\n", hit.start())
            end = len(raw) if end < 0 else end
            if lo <= start and end <= hi:
                known.setdefault(start, (rank, end))
    ranked = sorted((rank, start, end) for start, (rank, end) in known.items())
    some = [x for x in ranked if x[0] < SUMMARIES][:MOST_SUMMARIES] + [x for x in ranked if x[0] >= SUMMARIES]
    return [raw[start:end] for _, start, end in some[:MOST_SALVAGED]]


def _block(lines: list[bytes], room: int) -> bytes:
    """As many of the lines as fit, each cut to LINE_BYTES and what is left; between line ends, or empty."""
    out: list[bytes] = []
    for line in lines:
        width = min(LINE_BYTES, room)
        if width < 1:
            break
        out.append(line if len(line) <= width else _head(line, width - 1) + b"~")
        room -= len(out[-1]) + 1
    return b"".join([b"\n", b"\n".join(out), b"\n"]) if out else b""


def _edges(room: int, head: int, tail: int) -> tuple[int, int]:
    """Room for both ends of a text, shared in proportion."""
    first = max(1, room * max(1, head) // (max(1, head) + max(1, tail)))
    return first, max(1, room - first)


def middle_view(text: str, most: int, head: int, tail: int, keep_diagnostics: bool, marker: str = ELIDED) -> str:
    """A text within `most` bytes: its head, a marker, its tail. With keep_diagnostics up to half is for telling lines of what falls out."""
    raw, mark = text.encode(), marker.encode()
    if len(raw) <= most:
        return text
    room = most - len(mark)
    if room <= 0:
        return _head(mark, most).decode()
    block = b""
    if keep_diagnostics:
        spare = max(0, room // 2 - 2)
        first, last = _edges(room - spare - 2, head, tail)
        block = _block(salvage(raw, first, len(raw) - last), spare)
    first, last = _edges(room - len(block), head, tail)
    return b"".join([_head(raw, first), mark, block, _tail(raw, last)]).decode()


def _view(batches):
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(1, 8)]
        out = []
        for text, most, head, tail, bash, outline, before in zip(*cols, strict=True):
            if text is None:
                out.append((None, None, 0, 0))
                continue
            view = outline if outline is not None else middle_view(text, most, head, tail, bash)
            full = text if before is None else before
            out.append((view, hashlib.sha256(full.encode()).hexdigest() if view != full else None, len(full.encode()), len(view.encode())))
        views, digests, sizes, after = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(views, pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(after, pa.int64())], names=["id", "inline", "artifact_digest", "redacted_bytes", "inline_bytes"])


def salvage_lines(df: DataFrame, head: int, tail: int, result_id: str = "result_id", text: str = "output") -> DataFrame:
    """result_id, lines: of each text the telling lines between its first `head` and last `tail` bytes; none for null."""

    def rows(batches):
        for batch in batches:
            raw = [None if x is None else x.encode() for x in batch.column(1).to_pylist()]
            out = [[] if x is None else [y.decode("utf-8", "replace") for y in salvage(x, head, len(x) - tail)] for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["result_id", "lines"])

    slim = df.select(F.col(result_id).alias("result_id"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(rows, f"result_id {slim.schema['result_id'].dataType.simpleString()}, lines array<string>")


def bound_results(df: DataFrame, result_id: str = "result_id", keys: tuple[str, ...] = ("token",), line_cap: int = 768) -> DataFrame:
    """id, inline, artifact_digest, redacted_bytes, inline_bytes for results (tool, path, command, output).

    Redacted, control sequences off, classed, then: an outline for a long whole-file read, else head and tail within the class
    budget, with telling lines of the middle for shell output. The digest is that of the full text where the view is shorter. No shuffle.
    """
    kind = T.classify_source(F.col("tool"), F.col("path"), F.col("command"))
    bash = F.lower("tool") == "bash"
    route = T.plan_route(F.col("tool"), F.lit(False), F.size(T.lines(F.col("output"))), F.octet_length("output"))

    def parts(clean):
        """All that the view needs of the cleaned text, which is computed once."""
        shown = T.bind(F.when(bash, T.cap_columns(T.collapse_repeats(clean), line_cap)).otherwise(clean), lambda t: F.struct(t.alias("t"), F.when(t != clean, clean).alias("before")))
        return F.struct(shown.alias("shown"), F.when(route == "summary", T.structural_outline(clean)).alias("outline"))

    view = T.bind(T.redact(T.strip_ansi(T.redact(F.col("output"), keys)), keys), parts)
    slim = df.select(F.col(result_id).alias("id"), view.alias("v"), *[T.class_budget(kind, k).cast("long").alias(f"b{k}") for k in range(3)], bash.alias("bash"))
    slim = slim.select("id", F.col("v.shown.t").alias("t"), "b0", "b1", "b2", "bash", F.col("v.outline").alias("outline"), F.col("v.shown.before").alias("before"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, inline string, artifact_digest string, redacted_bytes long, inline_bytes long"
    return slim.mapInArrow(_view, schema)


def reduction_by_extension(df: DataFrame) -> DataFrame:
    """Per extension and in all (ext null): files, reduced files, tokens before and after, reduction in per mille."""
    g = df.rollup("ext").agg(F.count("*").alias("files"), F.count_if(F.col("after") < F.col("before")).alias("reduced"), F.sum("before").alias("before"), F.sum("after").alias("after"))
    return g.withColumn("rho_mille", F.when(F.col("before") > 0, F.floor((F.col("before") - F.col("after")) * 1000 / F.col("before")).cast("long")))


def top_extensions(df: DataFrame, n: int = 12) -> DataFrame:
    """The n extensions with most tokens."""
    return df.groupBy("ext").agg(F.count("*").alias("files"), F.sum("before").alias("before")).orderBy(F.desc("before"), "ext").limit(n)


def window_capacity(df: DataFrame, order: str, window: int = 200_000, buckets: int = 1024) -> DataFrame:
    """How many documents, in a fixed order, fit a token window before and after bounding: the running sums that are within it.

    The order is global, so sums run in two steps: totals of ranges of the order, then sums inside the ranges that may still fit.
    """
    edge = df.agg(F.min(order).alias("lo"), (F.max(order) + 1).alias("hi"))
    bounds = edge.select(F.struct("lo", "hi")).scalar()
    part = F.floor((F.col(order) - bounds.lo) * buckets / (bounds.hi - bounds.lo)).cast("int")
    rows = df.select(order, "before", "after", part.alias("part"))
    totals = rows.groupBy("part").agg(F.sum("before").alias("b"), F.sum("after").alias("a"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"))
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(starts.where(F.least("b0", "a0") <= window), "part").withColumn("rb", F.col("b0") + F.sum("before").over(inside)).withColumn("ra", F.col("a0") + F.sum("after").over(inside))
    return run.agg(F.count_if(F.col("rb") <= window).alias("fit_before"), F.count_if(F.col("ra") <= window).alias("fit_after"))


def shell_net_reduction(df: DataFrame) -> DataFrame:
    """Tokens of shell results raw and bounded, and how many grew and by how much."""
    d = df.withColumn("raw", estimate_tokens(F.col("output"))).withColumn("wrapped", estimate_tokens(F.col("inline")))
    grew = F.greatest(F.col("wrapped") - F.col("raw"), F.lit(0))
    return d.agg(F.count("*").alias("results"), F.sum("raw").alias("raw"), F.sum("wrapped").alias("wrapped"), F.count_if(grew > 0).alias("inflated"), F.sum(grew).alias("inflated_tokens"))


def grep_lines(df: DataFrame, needle: str, per_file: int = 20, columns: int = 512, ignore_case: bool = False) -> DataFrame:
    """path, line, text of the first matches of each file, each line cut to a byte width. Row by row, no shuffle."""
    fold = F.lower if ignore_case else (lambda c: c)
    want = F.lit(needle.lower() if ignore_case else needle)
    told = F.transform(F.split("output", "\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("x")))
    hits = F.slice(F.filter(told, lambda s: F.contains(fold(s.x), want)), 1, per_file)
    return df.select("result_id", F.explode(hits).alias("s")).select("result_id", "s.line", T.truncate_utf8(F.col("s.x"), columns).alias("text"))


def grep_summary(df: DataFrame, needle: str, per_file: int = 20, ignore_case: bool = False) -> DataFrame:
    """What grep_lines() saw: files, binary ones (a NUL in the first 8,192 characters; these have no matches), files with a match, matches, and those over per_file that it does not show.

    Null texts are files without lines. One row, also for no files. Only counts leave a task.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    binary = F.coalesce(F.contains(F.left("output", F.lit(8192)), F.lit("\x00")), F.lit(False))
    hits = F.size(F.filter(F.split("output", "\r?\n"), lambda x: F.contains(fold(x), F.lit(needle.lower() if ignore_case else needle))))
    d = df.select(binary.alias("b"), F.when(~binary, F.greatest(hits, F.lit(0))).otherwise(0).cast("long").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return d.agg(F.count("*").alias("files"), F.count_if("b").alias("binary"), F.count_if(F.col("n") > 0).alias("matching"), total(F.col("n")).alias("matches"), total(F.greatest(F.col("n") - per_file, F.lit(0))).alias("hidden"))


def catalog_search(df: DataFrame, request: str, n: int = 50) -> DataFrame:
    """Entries by the number of distinct request tokens they have, then by name; all if the request has none."""
    want = sorted(set(re.findall("[a-z0-9]+", request.lower())))
    tokens = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    score = F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in want]))) if want else F.lit(0)
    out = df.select("name", score.alias("score"))
    return (out.where("score > 0") if want else out).orderBy(F.desc("score"), "name").limit(n)
