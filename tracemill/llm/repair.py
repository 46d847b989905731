"""Cheapest repair of conversations to an optional system turn and then pairs of user and assistant.

A row is a symbol: who speaks, and whether it is truncated or must go. A cost vector tells the cost to the end from each state of the
grammar (nothing yet, after system, after user, after assistant); less its least entry, it is one of a few dozen. For each vector and
each block of SIZE symbols the vector before the block is precomputed (Four Russians), so blocks are taken by lookup from the end of a
conversation to its start. The edits are then traced forwards: a block is expanded backwards into its vectors, and of the edits that keep
to the cheapest cost the one with the least letter is taken, which makes the text of all edits the least of the cheapest.

Conversations are cut into pages of rows, so that one of any length is spread over tasks. Pages learn the vector at their end, and
the state at their start, by combining matrices in groups of FAN.
"""

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._order import place
from ._shared import Tables

#: Symbols of a block, rows of a page, pages (or groups) that are combined at once, bytes of text in a range while rows are ordered.
SIZE, PAGE, FAN, PART_BYTES = 4, 1024, 512, 64 << 20
INF = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after s, u and a; a letter that is not named cannot follow.
STEPS = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Symbols: 2 * speaker (s, u, a, other) + truncated; a row that must go; none.
GONE, PAD, SYMBOLS = 8, 9, 10
#: What ends the rows that are left, by state; small letters are inserted roles.
TAILS = ("", "ua", "a", "")
GAPS = " \t\n\x0b\f\r"
ROW = "struct<turn:long,role:string,text:string,edit:string,fault:string>"


# --- tables


def _closed(v: tuple[int, ...]) -> tuple[int, ...]:
    """With turns inserted where that is cheaper."""
    user = min(v[USER], INSERT + v[ASSISTANT])
    assistant = min(v[ASSISTANT], INSERT + user)
    return tuple(min(x, INF) for x in (min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant))


def _edits(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """Edits of a row in state q in the order of their letters (but for inserts): letter, cost, next state."""
    out = [("D", DELETE, q)]
    if symbol != GONE:
        more = TRUNCATED * (symbol % 2)
        speaker = symbol // 2
        out += [("K", more, STEPS[speaker][q])] if q in STEPS[speaker] else []
        out += [(c, REROLE + more, STEPS[k][q]) for c, k in (("U", 1), ("A", 2)) if q in STEPS[k]]
    return out


def _before(v: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    if symbol == PAD:
        return v
    return _closed(tuple(min(cost + v[to] for _, cost, to in _edits(symbol, q)) for q in range(4)))


def _trace(v: tuple[int, ...], symbol: int, q: int) -> tuple[str, int, int]:
    """Of the cheapest edits up to and with this row, from state q and with v after it, the least: letters, cost, next state."""
    done, spent, before = "", 0, _before(v, symbol)
    while True:
        options = [(c.replace("U", "R").replace("A", "R"), c, cost, to, v[to]) for c, cost, to in _edits(symbol, q)]
        options += [("I", c, INSERT, STEPS[k][q], before[STEPS[k][q]]) for c, k in (("u", 1), ("a", 2)) if q in STEPS[k]]
        shown, letter, cost, q_next, _ = min((o for o in options if o[2] + o[4] == before[q]), key=lambda o: o[0])
        done, spent, q = done + letter, spent + cost, q_next
        if shown != "I":
            return done, spent, q


@dataclass
class Tables4:
    """next, add: vector and cost before a block, by vector after it and block; one: the same for single symbols; out, cost, state: what _trace() gives."""

    vectors: np.ndarray
    number: dict[tuple[int, ...], int]
    next: np.ndarray
    add: np.ndarray
    one: np.ndarray
    letters: pa.Array
    out: np.ndarray
    cost: np.ndarray
    state: np.ndarray


@functools.cache
def block_tables(size: int = SIZE) -> Tables4:
    """All that lookups need; it depends on nothing but the costs."""
    units = [_closed(tuple(0 if k == q else INF for k in range(4))) for q in range(4)]
    accept = _closed((0, INF, INF, 0))
    found, number, steps = [accept, *units], {}, []
    for v in found:
        if v in number:
            continue
        number[v] = len(number)
        steps.append([])
        for s in range(SYMBOLS):
            b = _before(v, s)
            low = min(b)
            steps[-1].append((tuple(x - low if x < INF else INF for x in b), low))
            found.append(steps[-1][-1][0])
    one = np.array([[number[b] for b, _ in row] for row in steps], np.int32)
    low = np.array([[x for _, x in row] for row in steps], np.int32)
    following, add = one, low
    for _ in range(size - 1):
        add = (add[:, :, None] + low[following]).transpose(0, 2, 1).reshape(len(one), -1)
        following = one[following].transpose(0, 2, 1).reshape(len(one), -1)
    letters: dict[str, int] = {"": 0}
    out, cost, state = (np.zeros((len(one), SYMBOLS, 4), np.int32) for _ in range(3))
    state[:] = np.arange(4)
    for v, k in number.items():
        for s in range(PAD):
            for q in range(4):
                if _before(v, s)[q] < INF:
                    text, cost[k, s, q], state[k, s, q] = _trace(v, s, q)
                    out[k, s, q] = letters.setdefault(text, len(letters))
    return Tables4(np.array(list(number), np.int64), number, following, add, one, pa.array(list(letters)), out, cost, state)


# --- pages of symbols


@dataclass
class Lanes:
    """Pages side by side, longest first, as blocks filled up with PAD."""

    order: np.ndarray
    symbols: np.ndarray
    codes: np.ndarray
    blocks: np.ndarray

    @staticmethod
    def of(pages: list[np.ndarray]) -> "Lanes":
        length = np.array([len(p) for p in pages], np.int64)
        order = np.argsort(-length, kind="stable")
        blocks = -(-length[order] // SIZE)
        symbols = np.full((len(pages), int(blocks.max(initial=0)), SIZE), PAD, np.int8)
        flat = symbols.reshape(len(pages), -1)
        for lane, k in enumerate(order):
            flat[lane, : length[k]] = pages[k]
        return Lanes(order, symbols, (symbols.astype(np.int32) * SYMBOLS ** np.arange(SIZE - 1, -1, -1)).sum(2), blocks)

    def active(self, j: int) -> int:
        """Lanes that have block j: the first so many."""
        return int(np.searchsorted(-self.blocks, -j, "left"))

    def backward(self, t: Tables4, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors after each block, and vector and cost before the first, from the vectors at the pages' ends (in their own order)."""
        v, total = last[self.order].astype(np.int32), np.zeros(len(last), np.int64)
        after = np.zeros(self.codes.shape, np.int32)
        for j in range(self.codes.shape[1] - 1, -1, -1):
            n = self.active(j)
            after[:n, j] = v[:n]
            total[:n] += t.add[v[:n], self.codes[:n, j]]
            v[:n] = t.next[v[:n], self.codes[:n, j]]
        first, cost = np.empty_like(v), np.empty_like(total)
        first[self.order], cost[self.order] = v, total
        return after, first, cost

    def forward(self, t: Tables4, after: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is done at each row (places as in symbols), the cost of each page, and the state at its end, from the state at its start."""
        q, total = state[self.order].astype(np.int32), np.zeros(len(state), np.int64)
        done = np.zeros(self.symbols.shape, np.int32)
        for j in range(self.codes.shape[1]):
            n = self.active(j)
            v = [after[:n, j]]
            for i in range(SIZE - 1, 0, -1):
                v.append(t.one[v[-1], self.symbols[:n, j, i]])
            for i in range(SIZE):
                at = v[SIZE - 1 - i], self.symbols[:n, j, i], q[:n]
                done[:n, j, i] = t.out[at]
                total[:n] += t.cost[at]
                q[:n] = t.state[at]
        cost, end = np.empty_like(total), np.empty_like(q)
        cost[self.order], end[self.order] = total, q
        return done, cost, end


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Of each page the symbols; its codes are 16 * duplicate + 3 * speaker + (1 truncated, 2 blank)."""
    out = []
    for codes in batch.column(batch.schema.get_field_index("codes")):
        c = np.frombuffer(codes.as_buffer(), np.uint8)
        kind = (c & 15) % 3
        out.append(np.where((kind == 2) | (c > 15), GONE, (c & 15) // 3 * 2 + kind).astype(np.int8))
    return out


def _coding(batches):
    """conv, page, marks (place, code; -1 where the row's role and text occur first, -2 for the row before the page) -> conv, page, codes, illegal."""
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True
    for batch in batches:
        codes, illegal = [], []
        for marks in batch.column(2):
            place, code = (np.asarray(marks.values.field(k)) for k in (0, 1))
            rows = np.flatnonzero(code >= 0)
            new = np.zeros(len(rows), bool)
            some = rows > 0
            new[some] = (code[rows[some] - 1] == -1) & (place[rows[some] - 1] == place[rows[some]])
            own = rows[place[rows] >= 0]
            speakers = code[rows] // 3
            illegal.append(int((~legal[speakers[:-1], speakers[1:]]).sum()))
            codes.append((code[own] + np.where(new[len(rows) - len(own) :], 0, 16)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary()), pa.array(illegal, pa.int64())], names=["conv", "page", "codes", "illegal"])


def _matrices(batches):
    """The cost from each state at a page's start to each at its end."""
    for batch in batches:
        t, lanes = block_tables(), Lanes.of(_symbols(batch))
        matrix = np.empty((batch.num_rows, 4, 4), np.int64)
        for q in range(4):
            unit = t.number[_closed(tuple(0 if k == q else INF for k in range(4)))]
            _, first, cost = lanes.backward(t, np.full(batch.num_rows, unit))
            matrix[:, :, q] = np.minimum(t.vectors[first] + cost[:, None], INF)
        yield _page_rows(batch, list(matrix.reshape(batch.num_rows, 16)), "matrix")


def _page_rows(batch: pa.RecordBatch, values: list[np.ndarray], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("page"), pa.array(values, pa.list_(pa.int64()))], names=["conv", "page", name])


def _ends(batch: pa.RecordBatch) -> np.ndarray:
    """Numbers of the vectors at the pages' ends."""
    t = block_tables()
    return np.array([t.number[tuple(int(x) - min(v) for x in v)] for v in batch.column("vector").to_pylist()], np.int32)


def _passages(batches):
    """As a matrix of 0 and INF, the state at a page's end for each at its start."""
    for batch in batches:
        t, lanes = block_tables(), Lanes.of(_symbols(batch))
        after, _, _ = lanes.backward(t, _ends(batch))
        matrix = np.full((batch.num_rows, 4, 4), INF, np.int64)
        for q in range(4):
            _, _, end = lanes.forward(t, after, np.full(batch.num_rows, q))
            matrix[np.arange(batch.num_rows), q, end] = 0
        yield _page_rows(batch, list(matrix.reshape(batch.num_rows, 16)), "matrix")


def _tracing(batches):
    """Pages with codes, the vector at their end and the state at their start -> what is done at each row, and after the last one."""
    for batch in batches:
        t, pages = block_tables(), _symbols(batch)
        lanes = Lanes.of(pages)
        after, _, _ = lanes.backward(t, _ends(batch))
        done, cost, end = lanes.forward(t, after, np.asarray(batch.column("state")))
        lane = np.empty(len(pages), np.int64)
        lane[lanes.order] = np.arange(len(pages))
        flat = done.reshape(len(pages), -1)
        size = np.array([len(p) for p in pages], np.int32)
        edits = t.letters.take(pa.array(np.concatenate([flat[lane[k], : size[k]] for k in range(len(pages))])))
        last = np.asarray(batch.column("page")) == np.asarray(batch.column("pages")) - 1
        tails = [TAILS[q] if x else "" for q, x in zip(end, last, strict=True)]
        faults = []
        for codes in batch.column("codes"):
            c = np.frombuffer(codes.as_buffer(), np.uint8)
            kind = np.choose((c & 15) % 3, [0, 2, 3])
            faults.append(np.array([b"-", b"d", b"t", b"b"])[np.where((c > 15) & (kind < 3), 1, kind)])
        columns = [batch.column(c) for c in ("conv", "page", "pages", "illegal")]
        columns += [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), edits), pa.array(tails), pa.array([f.tobytes().decode() for f in faults])]
        columns += [pa.array(cost + np.array([INSERT * len(x) for x in tails], np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "page", "pages", "illegal", "edits", "tail", "faults", "cost"])


# --- combining pages


def _product(key, rows):
    m = np.array(rows.sort_by("page").column("matrix").to_pylist(), np.int64).reshape(-1, 4, 4)
    out = m[0]
    for x in m[1:]:
        out = np.minimum((out[:, :, None] + x[None]).min(1), INF)
    return pa.table({"conv": [key[0].as_py()], "page": [key[1].as_py()], "matrix": [out.reshape(-1)]})


def _running(backward: bool):
    def run(key, rows, given):
        """The vector at each page's end (backward) or start, from that of the group."""
        rows = rows.sort_by([("page", "descending" if backward else "ascending")])
        m = np.array(rows.column("matrix").to_pylist(), np.int64).reshape(-1, 4, 4)
        v, out = np.array(given.column("vector")[0].as_py(), np.int64), []
        for x in m:
            out.append(v)
            v = np.minimum((x + v[None]).min(1) if backward else (v[:, None] + x).min(0), INF)
        return pa.table({"conv": rows.column("conv"), "page": rows.column("page"), "vector": pa.array(out, pa.list_(pa.int64()))})

    return run


def _scan(pages: DataFrame, most: int, first: list[int], backward: bool) -> DataFrame:
    """conv, page, vector from conv, page, matrix; most: pages of the longest conversation. No group has more than FAN of them."""
    pages = pages.withColumn("group", F.expr(f"page div {FAN}"))
    if most <= FAN:
        given = pages.select("conv", "group").distinct().select("conv", "group", F.array(*[F.lit(x).cast("long") for x in first]).alias("vector"))
    else:
        groups = pages.groupBy("conv", "group").applyInArrow(_product, "conv string, page long, matrix array<long>")
        given = _scan(groups, -(-most // FAN), first, backward).withColumnRenamed("page", "group")
    return pages.groupBy("conv", "group").cogroup(given.groupBy("conv", "group")).applyInArrow(_running(backward), "conv string, page long, vector array<long>")


def _planned(info: DataFrame, tables: Tables) -> DataFrame:
    """conv, page, pages, codes, illegal, vector (at the page's end) and state (at its start)."""
    pages = info.where("page > 0").groupBy("conv").agg((F.max("page") + 1).alias("pages"))
    most = pages.agg(F.max("pages")).first()[0]
    accept, start = _closed((0, INF, INF, 0)), [0, INF, INF, INF]
    ending = F.array(*[F.lit(x).cast("long") for x in accept])
    if most is None:
        return info.select("*", F.lit(1).cast("long").alias("pages"), ending.alias("vector"), F.lit(START).alias("state"))
    long_ = tables.put(info.join(pages, "conv"))
    matrices = tables.put(long_.mapInArrow(_matrices, "conv string, page long, matrix array<long>"))
    vectors = tables.put(long_.join(_scan(matrices, most, list(accept), True), ["conv", "page"]))
    passages = tables.put(vectors.mapInArrow(_passages, "conv string, page long, matrix array<long>"))
    states = _scan(passages, most, start, False).select("conv", "page", (F.array_position("vector", F.lit(0).cast("long")) - 1).cast("int").alias("state"))
    rest = info.join(pages, "conv", "left_anti").select("*", F.lit(1).cast("long").alias("pages"), ending.alias("vector"), F.lit(START).alias("state"))
    return rest.unionByName(vectors.join(states, ["conv", "page"]))


# --- the operator


def _inserted(letters: Column) -> Column:
    made = lambda c: F.struct(F.lit(None).cast("long").alias("turn"), F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"), F.lit(None).cast("string").alias("fault"))
    return F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), made)


def _repaired(rows: Column, edits: Column, faults: Column, tail: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in ("b", "blank", "d", "duplicate", "t", "truncated")])

    def one(row, k):
        done, op = F.get(edits, k), F.right(F.get(edits, k), F.lit(1))
        role = F.when(op == "U", "user").when(op == "A", "assistant").otherwise(row["role"])
        own = F.struct(row["turn"].alias("turn"), role.alias("role"), row["text"].alias("text"), F.translate(op, "UA", "RR").alias("edit"), F.try_element_at(names, faults.substr(k + 1, F.lit(1))).alias("fault"))
        return F.concat(_inserted(F.substring(done, F.lit(1), F.length(done) - 1)), F.array(own))

    return F.concat(F.flatten(F.transform(rows, one)), _inserted(tail))


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", page_rows: int = PAGE) -> DataFrame:
    """Pages of repaired conversations: conv_id, page, pages, rows, audit, blank, duplicate, truncated, illegal, cost.

    rows: array of (turn, role, text, edit, fault) in order, with deleted (D) and inserted (I) ones. A page has up to page_rows rows of the input;
    numbers are those of the page, audit its edits' letters, and pages follow each other. explode() gives the rows of a conversation.

    In a conversation, rows are ordered by turn (nulls first), then role, then a hash of the text. The first fault of a row
    counts: blank (nothing but white space), duplicate (role and text of an earlier row), truncated (the last visible character is none of . ! ?).
    illegal: neighbours in the input whose roles' initials are none of su, ua, au. Edits: K keeps a row (cost 0), R makes it user or assistant (1),
    D deletes it (2; a blank or duplicate row must go), I inserts an empty turn of user or assistant (5); a truncated row that stays costs 5.
    The cheapest edits are taken that leave initials (s?(ua)+)? or nothing, of these the least text of letters.

    Null roles and texts are one space; rows with a null conv_id are one conversation; null turns stay null. Repeated rows are duplicates;
    an empty table gives no rows. Other columns are not read, whatever their names. A conversation may be of any length.
    """
    spark = rows.sparkSession
    tables = Tables(spark)
    body = F.coalesce(rows[text].cast("string"), F.lit(" "))
    slim = rows.select(F.coalesce(F.concat(F.lit("="), rows[conv_id].cast("string")), F.lit("")).alias("conv"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"), body.alias("text"), F.xxhash64(body).alias("h"))
    size = rows.agg(F.sum(F.octet_length(rows[text].cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    placed = place(slim, "conv", ["turn", "role", "h"], tables, parts)
    at = placed.select("conv", F.expr(f"pos div {page_rows}").alias("page"), (F.col("pos") % page_rows).cast("int").alias("k"), "turn", "role", "text")

    shown = F.rtrim(F.col("text"), F.lit(GAPS))
    speaker = F.array_position(F.array(*[F.lit(c) for c in "sua"]), F.substring("role", 1, 1)).cast("int")
    state = F.when(shown == "", 2).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    code = F.when(speaker == 0, 3).otherwise(speaker - 1) * 3 + state
    marks = at.select("conv", "page", F.struct("k", code.cast("int").alias("code")).alias("mark"))
    seam = marks.where(F.col("mark.k") == page_rows - 1).select("conv", (F.col("page") + 1).alias("page"), F.struct(F.lit(-1).alias("k"), F.col("mark.code").alias("code")).alias("mark"))
    same = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = placed.groupBy("conv", same.alias("same")).agg(F.min("pos").alias("pos"))
    first = first.select("conv", F.expr(f"pos div {page_rows}").alias("page"), F.struct((F.col("pos") % page_rows).cast("int").alias("k"), F.lit(-1).alias("code")).alias("mark"))
    coded = marks.unionByName(seam).unionByName(first).groupBy("conv", "page").agg(F.array_sort(F.collect_list("mark")).alias("marks"))
    info = tables.put(coded.where(F.exists("marks", lambda m: m["k"] >= 0)).mapInArrow(_coding, "conv string, page long, codes binary, illegal long"))

    plan = _planned(info, tables).mapInArrow(_tracing, "conv string, page long, pages long, illegal long, edits array<string>, tail string, faults string, cost long")
    texts = at.groupBy("conv", "page").agg(F.array_sort(F.collect_list(F.struct("k", "turn", "role", "text"))).alias("rows"))
    out = texts.join(plan, ["conv", "page"])
    count = lambda c: F.length(F.regexp_replace("faults", f"[^{c}]", "")).cast("long")
    audit = F.translate(F.concat(F.array_join("edits", ""), "tail"), "uaUA", "IIRR")
    own = F.when(F.col("conv") != "", F.substring("conv", 2, 2**31 - 1)).cast(rows.schema[conv_id].dataType)
    fixed = _repaired(F.col("rows"), F.col("edits"), F.col("faults"), F.col("tail"))
    return out.select(own.alias("conv_id"), "page", "pages", fixed.cast(f"array<{ROW}>").alias("rows"), audit.alias("audit"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"), "illegal", "cost")


def _joining(batches):
    """Pages of whole conversations in order -> one row each; nothing but the audit and a running digest is held."""
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    now, audit, digest, told, sums = None, [], None, False, []

    def row():
        value = digest if isinstance(digest, str) else digest.hexdigest()
        return {"conv_id": now[0], **dict(zip(names, sums, strict=True)), "audit": "".join(audit), "repaired_sha256": value}

    schema = pa.schema([("conv_id", pa.string()), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now != (r["conv_id"],):
                if now:
                    out.append(row())
                now, audit, digest, told, sums = (r["conv_id"],), [], hashlib.sha256(), False, [0] * 5
            audit.append(r["audit"])
            sums = [s + r[n] for s, n in zip(sums, names, strict=True)]
            if r["digest"] is not None:
                digest = r["digest"]
            elif r["piece"] is not None:
                digest.update((b"\n" if told else b"") + r["piece"].encode("utf-8", "surrogatepass"))
                told = True
        yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([row()], schema)


def repair_report(pages: DataFrame) -> DataFrame:
    """One row a conversation from repair_conversations(): conv_id, sums of blank, duplicate, truncated, illegal and cost, audit, and
    repaired_sha256 of the rows that are left as role:text, one a line. conv_id is a string here.

    The text of a conversation of several pages passes through one task, as its digest cannot be split, but is not held there.
    """
    left = F.transform(F.filter("rows", lambda r: r["edit"] != "D"), lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    piece = F.when(F.size(left) > 0, F.array_join(left, "\n"))
    single = F.col("pages") == 1
    slim = pages.select(F.col("conv_id").cast("string"), "page", "audit", "blank", "duplicate", "truncated", "illegal", "cost", F.when(single, F.sha2(F.coalesce(piece, F.lit("")), 256)).alias("digest"), F.when(~single, piece).alias("piece"))
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "page")
    return dealt.mapInArrow(_joining, "conv_id string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def repair_sql(rows: str = "SELECT * FROM conversations", crc: str = "{}") -> str:
    """DuckDB SQL for op12_conversations: a recursion over the rows that keeps, for each state, the cheapest and then least edits so far, with what they leave.

    crc: the CRC-32 of a text. A state is a struct of cost, audit and rows left, so that structs compare as edits do.
    """
    edited = lambda x, cost, letter, left="": f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {f'list_append({x}.o, {left})' if left else f'{x}.o'}}} END"
    able = lambda test, option: f"CASE WHEN fault NOT IN ('b', 'd'){test} THEN {option} END"
    told, more = "role || ':' || text", "(CASE WHEN fault = 't' THEN 5 ELSE 0 END)"
    keep = lambda x, i: able(f" AND i = '{i}'", edited(x, more, "K", told))
    role = lambda x, name: able("", edited(x, f"{more} + 1", "R", f"'{name}:' || text"))
    insert = lambda x, name: edited(x, 5, "I", f"'{name}:'")
    closed = f"(SELECT *, {_least('u1', insert('v3', 'user'))} AS v2 FROM (SELECT *, {_least('q3', insert('u1', 'assistant'))} AS v3 FROM (SELECT *, {_least('q2', insert('q0', 'user'), insert('q1', 'user'), insert('q3', 'user'))} AS u1 FROM dp)))"
    step = [edited("q0", 2, "D"), _least(edited("q1", 2, "D"), keep("q0", "s")), _least(edited("v2", 2, "D"), *[f(x, y) for x in ("q0", "q1", "v3") for f, y in ((keep, "u"), (role, "user"))]), _least(edited("v3", 2, "D"), keep("v2", "a"), role("v2", "assistant"))]
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
    key = crc.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} % 20 AS lot FROM ({rows})),
  d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM base, (VALUES (1), (2)) AS c(copy) WHERE lot <> 0 AND (copy = 1 OR lot = 3)),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS shown, left(role, 1) AS i FROM d),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS h FROM r),
  s AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM n),
  g AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(h IS NOT NULL AND h || i NOT IN ('su', 'ua', 'au')) AS illegal FROM s GROUP BY conv_id),
  dp AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS q0, {none} AS q1, {none} AS q2, {none} AS q3 FROM g UNION ALL
    SELECT x.conv_id, s.k, {', '.join(step)} FROM {closed} AS x JOIN s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.k = x.k + 1),
  e AS (SELECT conv_id, k, {_least('q0', 'v3')} AS best FROM {closed} AS x),
  z AS (SELECT g.*, best FROM g JOIN e ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.rows = e.k)
  SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM ({rows})) AS c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id"""
