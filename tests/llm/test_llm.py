"""Each operator against a brute-force form, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import classifier, decontaminate, language, lines, minhash, mixing, quality, queries, substring, tokens, urls
from tracemill.llm._links import components, group, shared_buckets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must take: nulls in all columns, empty, white space, one word, repeats, a very long text.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "word", None, "s", 4), (None, "no id here at all", "en", None, 3), (5, "same row twice " * 20, "en", "s", 9), (5, "same row twice " * 20, "en", "s", 9), (6, "other text of id six " * 20, "en", "s", 9), (6, "and again of id six but new " * 20, "en", "s", 9), (7, "long " * 60_000, "en", "t", 9), (8, "é日𝒳 " * 30, "fr", "t", 9)]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    for c in ("id", "t", "size", "number", "version", "row", "gone", "w", "words", "m", "node", "component_id", "kept", "start", "line", "key", "n", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    return df


def read(rows):
    return {r[0]: WORDS.findall(r[1] or "") for r in rows if r[0] is not None}


def random_docs(seed, n, vocabulary=60):
    """Texts with shared passages and edited copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randint(13, 40))] for _ in range(4)]
    out = []
    for k in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            t = list(rng.choice(out)[1].split())
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.randint(1, 120))]
        if kind > 0.8:
            at = rng.randrange(len(t))
            t[at:at] = rng.choice(passages)
        out.append((k, " ".join(t), "en", f"s{k % 3}", len(t)))
    return out


# --- links


def test_components_brute_force(spark):
    rng = random.Random(5)
    for n in (1, 40, 200):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(k, k + 1) for k in range(1000, 1000 + n)]
        top = {}
        for a, b in edges:
            top.setdefault(a, a), top.setdefault(b, b)
        for _ in range(len(top)):
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: v for k, v in top.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_group_finds_every_link_of_a_large_bucket(spark):
    """Members that link only to the number after them: no leader stands for the bucket, all pairs must be looked at."""
    members = shared_buckets(spark.createDataFrame([(1, k) for k in range(150)] + [(2, 500)], "key long, node long"))
    _, labels = group(members, lambda pairs: pairs.withColumn("link", F.abs(F.col("a") - F.col("b")) == 1), spread=4)
    got = labels.collect()
    assert len(got) == 150 and {r.component for r in got} == {0}


# --- 1 mixing


def test_mixing(spark, duck):
    same_rows(queries.op1_mixing(spark, SF), duck, queries.SQL["op1_mixing"])


def test_mixing_caps_and_odd_rows(spark):
    rows = [*ODD, *random_docs(1, 60)]
    df = documents(spark, rows)
    got = mixing.mix_sources(df.withColumn("number", F.lit(1)).withColumn("bucket", F.lit(1)), block=16).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=10)
    by = collections.Counter()
    for r in got:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - t) <= 1 for (_, t), v in by.items())
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert mixing.mix_sources(documents(spark, [(1, None, None, None, None)])).first().taken == 0


def test_mix_schedule_gives_each_word_its_turns(spark):
    placed, takes = mixing.mix_schedule(documents(spark, random_docs(2, 30)), block=8)
    took = collections.Counter()
    for r in takes.collect():
        took[r.number, r.start] += r.length
        assert r.length > 0
    slots = [r.slot for r in takes.select("slot").distinct().collect()]
    assert len(slots) == len(set(slots)) and sum(took.values()) > 0


# --- 2 token counts


def test_tokens_are_those_of_the_public_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokens.read_vocabulary(queries.VOCABULARY)
    t = Tokenizer(models.Unigram(v, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(1)
    odd = ["", " ", "  a b", "a  b", "▁x", "日本語 é́ 𝒳 <s> <0x41>", "a▁b", "\n\n x", "hello" * 300, *("".join(rng.choice("ab ▁é日\n<s>xtheing") for _ in range(60)) for _ in range(300))]
    rows = [(k, s, None, None, None) for k, s in enumerate(odd)]
    df = documents(spark, rows).unionByName(spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100_000))
    text = {r.doc_id: r.text for r in df.collect()}
    for r in tokens.count_tokens(df, v).collect():
        assert r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False).ids), text[r.doc_id]


def test_tokens_ties_and_unknown_runs():
    from tokenizers import Tokenizer, models

    rng = random.Random(2)
    for _ in range(200):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(4)}
        v = [("<unk>", 0.0), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces))]
        t, c = Tokenizer(models.Unigram(v, unk_id=0)), tokens.Counter(v)
        for _ in range(10):
            s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert c.pieces(s) == len(t.encode(s).ids), (v, s)


def test_tokens_odd_rows(spark):
    v = tokens.read_vocabulary(queries.VOCABULARY)
    got = tokens.count_tokens(clashing(documents(spark, ODD)), v).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert tokens.count_tokens(documents(spark, []), v).count() == 0


# --- 3 quality rules


def test_quality(spark, duck):
    same_rows(queries.op3_quality(spark, SF), duck, queries.SQL["op3_quality"])


def test_quality_counts_brute_force(spark):
    rng = random.Random(4)
    rows = [*ODD, *((100 + k, "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "the", "\t", "…", "- "]) for _ in range(rng.randint(0, 150))), "en", "s", 1) for k in range(150))]
    got = quality.quality_rules(clashing(documents(spark, rows))).collect()
    want = []
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        runs = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        base = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(inside), base))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    plan = quality.quality_rules(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in quality.keep_quality(documents(spark, rows)).collect()} == kept
    assert quality.quality_rules(documents(spark, [])).count() == 0


# --- 4 near duplicates


def near_brute(rows, n, percent):
    sets = {}
    for i, w in read([(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) for r in rows]).items():
        sets[i] = set(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else ({tuple(w)} if w else set())
    top = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return sets, top


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, n, percent):
    rows = random_docs(7, 120)
    sets, top = near_brute(rows, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(clashing(documents(spark, rows)), n=n, percent=percent).collect()}
    assert got == {i: (len(s), top[i], top[i] == i) for i, s in sets.items()}


def test_near_duplicates_around_a_hub(spark):
    """Copies that are like the base and not like each other are one group with it, and far ones stay alone."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base), "en", "s", 1)]
    for k in range(1, 80):
        t = list(base)
        for at in rng.sample(range(150), rng.choice((2, 3, 4, 6, 9))):
            t[at] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(t), "en", "s", 1))
    _, top = near_brute(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), n=3, percent=85).collect()} == top


def test_near_duplicates_far_from_each_other(spark, monkeypatch):
    """Variants of one text that differ in other places, with no shingle of their own, are told apart without their sets; links among them stay."""
    rng, real, compared = random.Random(12), minhash.group, []
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(80):
        t = list(base)
        for at in rng.sample(range(150), 12):
            t[at] = f"c{at}"
        rows.append((2 * k, " ".join(t), "en", "s", 1))
        if k % 8 == 0:
            t[rng.randrange(150)] = f"c{rng.randrange(3)}"
            rows.append((2 * k + 1, " ".join(t), "en", "s", 1))

    def counting(members, verify, *args, **settings):
        def counted(pairs):
            compared.append(pairs.count())
            return verify(pairs)

        return real(members, counted, *args, **settings)

    monkeypatch.setattr(minhash, "group", counting)
    _, top = near_brute(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), n=3, percent=85).collect()} == top
    assert sum(compared[1:]) < len(rows)


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(documents(spark, ODD), n=3, percent=85).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[1].kept and by[4].n_shingles == 1 and by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


# --- 5 substrings


def spans_brute(rows, n):
    low = {}
    texts = read(rows)
    for i in sorted(texts):
        for k in range(len(texts[i]) - n + 1):
            low.setdefault(tuple(texts[i][k : k + n]), i)
    out = {}
    for i, w in texts.items():
        gone = {k + j for k in range(len(w) - n + 1) if low[tuple(w[k : k + n])] < i for j in range(n)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeats_brute_force(spark):
    rows = random_docs(11, 150, vocabulary=30)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(clashing(documents(spark, rows)), digest=True).collect()}
    assert got == spans_brute(rows, 13)


def test_repeats_small_packs(spark, monkeypatch):
    """Many small packs, and windows shared by almost all documents."""
    monkeypatch.setattr(substring, "PACK", 2000)
    common = " ".join(f"c{k}" for k in range(60))
    rows = [(k, f"u{k} {common} v{k} " * (1 + k % 3), "en", "s", 1) for k in range(60, 0, -1)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(documents(spark, rows), digest=True).collect()}
    assert got == spans_brute(rows, 13)


def test_repeats_odd_rows(spark):
    got = substring.remove_repeats(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r.n_removed for r in got) == 0
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    copy = documents(spark, [*ODD, (9, ODD[5][1], "en", "s", 1)])
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(copy).collect()}[9] == 60
    assert substring.remove_repeats(documents(spark, [])).count() == 0


# --- 6 lines


def test_lines_exact_and_fuzzy(spark):
    a = "The quick brown fox jumps over the lazy dog while the sun sets slowly behind the old hills of the far country side"
    near = a.replace("slowly", "slowly,").upper()
    rows = [(2, f"{a}\nown line of document two is here", "en", "s", 1), (1, f"first of all here we are today\n{a}", "en", "s", 1), (3, f"{near}\nshort\nshort", "en", "s", 1), (4, None, None, None, None), (None, a, "en", "s", 1)]
    got = {r.doc_id: r for r in lines.drop_lines(clashing(documents(spark, rows))).collect()}
    assert got[1].text.endswith(a) and got[2].text == "own line of document two is here" and got[3].text == "short\nshort"
    assert got[4].text is None and got[None].text == a and got[1].n == "x" and got[2].n_removed_lines == 1


def test_lines_brute_force(spark):
    """All exactly equal normal lines but the first go; what else goes is within the edit bound of its group's lines."""
    import regex

    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text.split("\n") for r in df.collect()}
    normal = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip()
    first, must = {}, set()
    for i in sorted(texts):
        for k, x in enumerate(texts[i]):
            if len(normal(x).split(" ")) >= 5 and first.setdefault(normal(x), (i, k)) != (i, k):
                must.add((i, k))
    got = {(r.id, r.line): (r.keeper["id"], r.keeper["line"]) for r in lines.line_groups(df).collect()}
    assert must <= set(got)
    for (i, k), (j, l) in got.items():
        assert (j, l) < (i, k) and (j, l) not in got
    rebuilt = {r.doc_id: r.text for r in lines.drop_lines(df).collect()}
    assert rebuilt == {i: "\n".join(x for k, x in enumerate(ls) if (i, k) not in got) for i, ls in texts.items()}
    plan = lines.drop_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_lines_with_changed_words(spark):
    """Lines with up to a fifth of the words changed: of the pairs that edit distance links, at least 95 % are met, and nothing else goes."""
    rng = random.Random(26)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    rows, pairs = [], {}
    for k in range(160):
        a = [word() for _ in range(rng.choice((8, 10, 20, 27, 40)))]
        b = list(a)
        for at in rng.sample(range(len(b)), rng.randint(1, 1 + len(b) // 9)):
            b[at] = word()
        a, b = " ".join(a), " ".join(b)
        rows += [(2 * k, a, "en", "s", 1), (2 * k + 1, b, "en", "s", 1)]
        pairs[2 * k + 1] = edits(a, b) <= max(len(a), len(b)) * 20 // 100
    got = {r.id: r.keeper["id"] for r in lines.line_groups(documents(spark, rows)).collect()}
    must = {k for k, v in pairs.items() if v}
    assert all(k in must and got[k] == k - 1 for k in got)
    assert len(must) > 100 and len(set(got) & must) >= 0.95 * len(must), (len(set(got) & must), len(must))


def test_lines_of_very_many_words(spark):
    rng = random.Random(3)
    a = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(33_000)]
    b = [*a[:9000], "1", *a[9001:]]
    df = documents(spark, [(1, " ".join(a), "en", "s", 1), (2, " ".join(b), "en", "s", 1)])
    assert [(r.id, r.keeper["id"]) for r in lines.line_groups(df).collect()] == [(2, 1)]


def test_lines_that_share_a_phrase(spark, monkeypatch):
    """12 of 20 words are the same everywhere: pairs that are compared grow with the lines, nothing is removed but edited copies, and these all are."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    phrase, seen = [word() for _ in range(12)], []
    real = lines.group

    def counting(members, verify, **settings):
        def counted(pairs):
            seen.append(pairs.count())
            return verify(pairs)

        return real(members, counted, **settings)

    monkeypatch.setattr(lines, "group", counting)
    work = []
    for n in (300, 900):
        rows, copies = [], set()
        for k in range(n):
            own = [word() for _ in range(8)]
            rows.append((2 * k, " ".join([*own[:4], *phrase, *own[4:]]), "en", "s", 1))
            if k % 10 == 0:
                own[rng.randrange(8)] = word()
                rows.append((2 * k + 1, " ".join([*own[:4], *phrase, *own[4:]]), "en", "s", 1))
                copies.add(2 * k + 1)
        seen.clear()
        got = {r.id: r.keeper["id"] for r in lines.line_groups(documents(spark, rows)).collect()}
        assert got == {k: k - 1 for k in copies}
        work.append(sum(seen) / n)
    assert work[1] < 1.3 * max(work[0], 65), work


def test_lines_that_only_share_a_phrase_of_many(spark, monkeypatch):
    """All that is left in common of a line and its edited copy is in more than 64 other lines: the same goes as when every pair is listed."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    phrase, rows = [word() for _ in range(14)], []
    for k in range(150):
        own = [word() for _ in range(7)]
        rows.append((2 * k, " ".join([*phrase, *own]), "en", "s", 1))
        if k % 6 == 0:
            rows.append((2 * k + 1, " ".join([*phrase, *[w[:2] + "z" + w[3:] for w in own]]), "en", "s", 1))
    got = {r.id: r.keeper["id"] for r in lines.line_groups(documents(spark, rows)).collect()}
    real = lines.group
    monkeypatch.setattr(lines, "group", lambda *args, **settings: real(*args, **settings, most=10**9))
    assert got == {r.id: r.keeper["id"] for r in lines.line_groups(documents(spark, rows)).collect()}
    assert len(got) > 20


def test_lines_meet_in_bands_of_length(spark):
    """Lengths that may be linked are in bands beside each other, and a large bucket gives the same links with bands and without."""
    for similarity in (1, 50, 80, 99, 100):
        size = spark.range(1, 5000).select(F.col("id").alias("x"), (F.col("id") - F.floor(F.col("id") * (100 - similarity) / 100)).alias("y"))
        assert size.where(lines._band(F.col("x"), similarity) - lines._band(F.col("y"), similarity) > 1).count() == 0, similarity
    rng = random.Random(5)
    sizes = [rng.choice((80, 100, 125, 156, rng.randint(20, 400))) for _ in range(150)]
    members = spark.createDataFrame([(1, k, 0, 150) for k in range(150)], "key long, node long, slot int, weight long")
    facts = spark.createDataFrame(list(enumerate(sizes)), "node long, facts int")
    details = facts.select("node", F.struct(F.col("node").alias("n"), F.col("facts").alias("s")).alias("details"))
    near = lambda x, y, slot: F.abs(x - y) <= F.floor(F.greatest(x, y) * 20 / 100)
    decide = lambda a, b: near(F.col(f"{a}.s"), F.col(f"{b}.s"), None) & (F.pmod(F.col(f"{a}.n") + F.col(f"{b}.n"), F.lit(97)) == 0)
    refuse = lambda pairs: pairs.select("a", "b", F.lit(False).alias("link")).where("false")
    want = {(a, b) for a in range(150) for b in range(a) if abs(sizes[a] - sizes[b]) <= max(sizes[a], sizes[b]) * 20 // 100 and (a + b) % 97 == 0}
    for band in (None, lambda size: lines._band(size, 80)):
        links, _ = group(members, refuse, may_link=near, facts=facts, details=details, decide=decide, band=band)
        assert {(max(r.a, r.b), min(r.a, r.b)) for r in links.collect()} == want and want


def test_lines_odd_rows(spark):
    got = lines.drop_lines(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert lines.drop_lines(documents(spark, [])).count() == 0


def test_joins_by_node_do_not_pass_the_driver(spark, monkeypatch):
    """On small tables too, what is joined by node is shuffled and merged: dozens of broadcasts fill the driver."""
    import re

    from tracemill.llm._shared import Tables

    plans, put = [], Tables.put
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Tables, "put", lambda self, df: (plans.append(text(df)), put(self, df))[1])
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    for of in (lines.drop_lines, minhash.near_duplicates):
        plans.clear()
        plans.append(text(of(df.unionByName(df.withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat("text", F.lit(" and so on"))})))))
        joins = re.findall(r"(\w+Join) \[(?:node|id|a|b)#", "\n".join(plans))
        assert set(joins) == {"SortMergeJoin"} and len(joins) > 4, joins
    df.unpersist()


# --- 7 classifier


def test_classifier_held_out(spark):
    df, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = labels.where("doc_id % 3 <> 0")
    got = classifier.classify_quality(clashing(df), learn).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(got) > 50 and sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.9


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    got = classifier.classify_quality(documents(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = classifier.classify_quality(documents(spark, ODD), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.classify_quality(documents(spark, []), labels).count() == 0


def test_classifier_views_teach_each_other(spark):
    """Labels are there for two sources only. Rows of two others without text can be told apart only by what the text view has taught the metadata view of their sources."""
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["###", "$$$", "BUY", "!!!", "%%"]) for _ in range(60))
    rows, marks = [], []
    for k in range(80):
        rows.append((k, good() if k % 2 else bad(), "en", f"s{k % 2}", 300))
        marks.append((k, k % 2))
    rows += [(100 + k, good() if k % 2 else bad(), "en", f"s{2 + k % 2}", 300) for k in range(200)]
    rows += [(500 + k, None, "en", f"s{2 + k % 2}", 300) for k in range(40)]
    df, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")

    def gap(rounds):
        got = {r.doc_id: r.score for r in classifier.classify_quality(df, labels, numbers=(), rounds=rounds, most_given=20).collect()}
        return sum(got[500 + k] * (1 if k % 2 else -1) for k in range(40)) / 20

    alone, taught = gap(0), gap(4)
    assert abs(alone) < 0.1 and taught > 0.5, (alone, taught)


def test_classifier_pool_is_the_whole_corpus(spark):
    """The surest rows are found wherever they are, and a rerun over other partitions learns the same."""
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one, two = ({(r.doc_id, round(r.score, 4)) for r in classifier.classify_quality(df.repartition(n), labels, most_given=5).collect()} for n in (2, 5))
    assert one == two


# --- 8 language


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(clashing(df)).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_odd_rows(spark):
    got = {r.doc_id: r for r in language.identify_language(documents(spark, [*ODD, (9, "123 !?", "en", "s", 1)])).collect()}
    assert got[1].lang_pred == "und" and got[3].lang_pred == "und" and got[9].lang_pred == "und" and got[4].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify_language(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in language.identify_language(documents(spark, [(1, "abc", None, None, None)])).collect()} == {"und"}


def test_languages_in_blocks_give_the_same(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(documents(spark, [*ODD, (9, "123 !?", "en", "s", 1)]))
    whole, *blocks = [sorted(tuple(r) for r in language.identify_language(df, most_languages=k).collect() if r.doc_id is not None) for k in (1000, 1, 2, 3)]
    for got in blocks:  # cosines are single precision, whose last digit follows the size of the block
        assert [r[:3] for r in got] == [r[:3] for r in whole] and [r[3] for r in got] == pytest.approx([r[3] for r in whole], abs=1e-6)


def test_language_encoding_is_a_sum_of_products():
    import numpy as np

    e = language.Encoder(64)
    key, count = e.counts("Ab, ab")
    three = lambda a, b, c: np.roll(e.letters[a], 2) * np.roll(e.letters[b], 1) * e.letters[c].astype(float)
    assert count.sum() == 5 and np.allclose(e.encode(key, count), 2 * three(0, 1, 2) + 2 * three(1, 2, 0) + three(2, 0, 1))
    assert np.array_equal(language.Encoder(64).letters[0], e.letters[0])


# --- 9 urls


def test_urls(spark, duck):
    same_rows(queries.op9_urls(spark, SF), duck, queries.SQL["op9_urls"])


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("x://example.net/es/1", "example.net", "/es/1", "net/es/", "block"), ("x://example.net/de", "example.net", "/de", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"),
    ("http://notexample.com?x", "notexample.com", "", None, "allow"), ("http://a://b", "a:", "//b", None, "allow"),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")
    r = urls.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean")).first()
    assert (r.host, r.path) == (host, path)
    if rule or host in ("", "example.net", "a:"):
        assert (r.rule, r.verdict) == (rule, verdict)


def test_reputation_shrinks(spark):
    out = [("http://bad.a.org/", True)] * 30 + [("http://once.b.org/", True)] + [(f"http://h{k}.c.org/", False) for k in range(60)] + [(None, True), ("http://x.y.org", None)]
    known = spark.createDataFrame(out, "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://bad.a.org/z"), (2, "http://once.b.org/z"), (3, "http://h1.c.org/"), (4, "http://new.d.org/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages, known).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    rep = {r.host: r for r in urls.host_reputation(known.select(urls.url_host(F.col("url")).alias("host"), "bad")).collect()}
    assert rep["once.b.org"].mean < rep["bad.a.org"].mean and rep["bad.a.org"].low > 0.5


def test_new_hosts_are_judged_by_their_domain(spark, duck):
    """A host without labelled pages is blocked where its domain is bad; DuckDB says the same. Repeats, nulls and empty tables have their rows."""
    known = [("http://bad.a.org/", True)] * 30 + [(f"http://h{k}.c.org/", False) for k in range(60)]
    rows = [(1, "http://new.a.org/x"), (1, "http://new.a.org/x"), (2, "http://new.c.org/"), (3, "http://q.net/x"), (None, None), (4, "http://8825.c.org:80/1")]
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(known, "url string, bad boolean")
    got = urls.filter_urls(pages, outcomes)
    assert [r.verdict for r in got.where("page_id = 1").collect()] == ["block", "block"] and {r.verdict for r in got.where("page_id > 1 or page_id is null").collect()} == {"allow"}
    values = lambda rows: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows) + ") AS v"
    same_rows(got, duck, urls.filter_sql(values(rows) + "(page_id, url)", values(known) + "(url, bad)"))
    assert urls.filter_urls(pages.limit(0), outcomes).count() == 0 and urls.filter_urls(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 0


# --- 10 decontamination


def align_brute(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignment_brute_force():
    import numpy as np

    rng = random.Random(8)
    for _ in range(100):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        bs = [[rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(5)]
        got, _ = decontaminate.align(np.array(a, np.uint64), [np.array(b, np.uint64) for b in bs])
        assert got.tolist() == [align_brute(a, b) for b in bs]


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(40)] for _ in range(5)]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(8, None), (9, "two words")], "item_id long, text string")
    edited = list(items[2])
    for at in (5, 17, 29):
        edited[at] = word()
    del edited[35]
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(10, f"{fill(30)} {' '.join(items[0])} {fill(30)}", "en", "s", 1), (11, f"{fill(9)} {' '.join(edited).upper()}. {fill(50)} {', '.join(items[1])}", "en", "s", 1), (12, fill(300), "en", "s", 1), (13, f"{fill(50)} {' '.join(items[3][:9])}", "en", "s", 1), *ODD]
    df = documents(spark, rows)
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(clashing(df).drop("text").join(df.select("doc_id", "text"), "doc_id"), bench).collect()}
    assert set(got) == {(10, 0), (11, 1), (11, 2)} and got[10, 0] == 1 and 0.8 < got[11, 2] < 1
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {12, 13, 1, 2, 3, 4, 5, 6, 7, 8, None}
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_decontamination_finds_all_that_align(spark, threshold):
    """Copies with words replaced, put in and left out, up to and over the threshold, against alignment of every item with every text."""
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(n)] for n in (4, 5, 6, 9, 15, 24, 38, 38, 59)]
    rows = []
    for k in range(400):
        t = []
        kinds, rate = rng.choice(["r", "i", "d", "rid"]), rng.uniform(0.05, 0.8)
        own = items[k % len(items)]
        for at, w in enumerate(own):
            kind = rng.choice(kinds) if rng.random() < rate * (1 if kinds == "i" else 0.45) or (k % 7 == 0 and at % 4 == 3) else ""
            t += {"": [w], "r": [word()], "i": [word(), w], "d": []}[kind]
        rows.append((k, " ".join([word() for _ in range(rng.randint(0, 60))] + t + [word() for _ in range(rng.randint(0, 60))]), "en", "s", 1))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(spark, rows), bench, threshold=threshold).collect()}
    scores = {(r[0], k): align_brute(t, r[1].split()) / (2 * len(t)) for r in rows for k, t in enumerate(items)}
    assert got == {k: s for k, s in scores.items() if s >= threshold} and len(got) > 50


def test_decontamination_in_blocks(spark, monkeypatch):
    df, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contaminated(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, decontaminate.contaminated(df, bench).collect())) == want and want


def test_rare_seeds_and_parts_find_the_same(spark, monkeypatch):
    """Whatever the counts say, and however small the parts in which hits are looked at, also inside of one text."""
    import numpy as np

    rng = random.Random(9)
    word = lambda: f"w{int(rng.random() ** 3 * 60)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([4, 5, 9, 20, 40])))) for k in range(30)]
    texts = []
    for k in range(60):
        t = " ".join(word() if rng.random() < 0.25 else x for x in items[k % 30][1].split())
        texts.append(" ".join(word() for _ in range(30)) + f" {t} " + " ".join(word() for _ in range(30)))
    texts.append(" ".join(texts))

    def starts(own):
        import pyarrow as pa

        from tracemill.llm._words import read_words

        found = set()
        for w in read_words(pa.array(texts), plain=True):
            found |= {r[:2] for r in decontaminate._passages(own, w, *own.starts(w), 0.6)}
        return found

    own = decontaminate.Items.read(items, 4, 0.6)
    want = starts(own)
    sizes = {q: len(np.unique(s[0])) for q, s in own.seeds.items()}
    assert len(want) > 60
    for seed in range(3):
        draw = np.random.default_rng(seed)
        few = own.rare({q: draw.integers(0, 100, n) for q, n in sizes.items()})
        assert starts(few) == want and (few.need >= 1).all() and sum(len(s[0]) for s in few.seeds.values()) < sum(len(s[0]) for s in own.seeds.values())
    monkeypatch.setattr(decontaminate, "PART", 50)
    assert starts(own) == starts(few) == want


@pytest.mark.parametrize("name", ["op4_minhash", "op5_substring", "op12_conversations"])
def test_same_as_duckdb(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.SQL[name])


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == {r.doc_id for r in quality.quality_rules(before).collect() if r.kept}
        if name == "near-duplicate dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            _, top = near_brute(rows, 5, 80)
            assert ids == {i for i in top if top[i] == i}
        if name == "benchmark decontamination":
            assert not {r.doc_id for r in decontaminate.contaminated(after, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_odd_rows(spark):
    df = documents(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, df, SF).collect()
        stage(spark, documents(spark, []), SF).collect()


def test_registered(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
