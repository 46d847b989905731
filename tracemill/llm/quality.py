"""Quality rules: one table of thresholds, compiled into one projection of built-in functions."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import GAP, bind, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = ("the of and to in is that for it was with as be on are this "
              "der die das und in den von zu mit ist ein eine sich auf im "
              "de la le les et des un une que en du est pour dans qui "
              "el los las y del se por con para una como").split()


@dataclass(frozen=True)
class Rule:
    """A document fails when the measure `top`, times 1000, is outside low..high times the measure `over`."""

    name: str
    top: str
    over: str
    low: int | None = None
    high: int | None = None


#: The production table. Bounds are per mille of `over`; a row of the table costs no pass of its own.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1_500, 20_000),
    Rule("symbols", "n_symbols", "n_words", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 500),
)


def _repeat_words(w: Column, n: int) -> Column:
    """Words inside a run of n words that occurs twice or more in the text.

    Runs are compared by 64-bit hashes; only texts where two are equal are sorted.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    def covered(sorted_: Column) -> Column:
        size = F.size(sorted_)
        twice = F.filter(
            sorted_,
            lambda x, i: ((i > 0) & (F.get(sorted_, F.greatest(i - 1, F.lit(0))).h == x.h)) | ((i < size - 1) & (F.get(sorted_, F.least(i + 1, size - 1)).h == x.h)),
        )
        places = F.sort_array(F.transform(twice, lambda x: x.i))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a.n + p + n - F.greatest(a.end, p)).alias("n"), (p + n).alias("end"))
        return F.aggregate(places, start, step, lambda a: a.n)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(pairs, covered))

    return F.when(F.size(w) < n, 0).otherwise(bind(runs, count))


def measures(text: Column, stop_words: tuple[str, ...] = tuple(STOP_WORDS), n: int = 3) -> Column:
    """A struct of counts of a whole text; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    has_word = lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0

    def all_(w: Column) -> Column:
        return bind(
            F.filter(F.split(text, "\n"), has_word),
            lambda lines: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeat_words(w, n).cast("long").alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop_words"),
                F.size(lines).cast("long").alias("n_lines"),
                F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long").alias("n_bullet_lines"),
                F.size(F.filter(lines, lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_ellipsis_lines"),
            ),
        )

    return bind(words(text), all_)


def base_failed(m: Column, min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """Too short, or too much of it inside repeated word runs."""
    return (m.n_words < min_words) | (100 * m.n_repeat_words > max_repeat_percent * m.n_words)


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the counts satisfy every row of the table; integer arithmetic only."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (1000 * m[r.top] >= r.low * m[r.over])
        if r.high is not None:
            ok = ok & (1000 * m[r.top] <= r.high * m[r.over])
    return ok


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, the counts of measures(), base_failed and kept for every row.

    One projection without shuffle or user function. Null and empty texts have no words and fail. Repeated rows, null ids and an empty table need no
    care: each row is judged alone. Other columns are not read.
    """
    m = F.col("m")
    out = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text)).alias("m"))
    out = out.select("doc_id", "m", base_failed(m, min_words, max_repeat_percent).alias("base_failed"), passes(m, rules).alias("ok"))
    return out.select("doc_id", "m.*", "base_failed", (~F.col("base_failed") & F.col("ok")).alias("kept"))


def keep_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows that quality_rules() keeps, with all their columns."""
    good = bind(measures(F.col(text)), lambda m: ~base_failed(m, min_words, max_repeat_percent) & passes(m, rules))
    return docs.where(good)


def quality_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents", min_words: int = 50, max_repeat_percent: int = 50) -> str:
    """The rows of quality_rules() in DuckDB SQL."""
    tests = [f"1000 * {r.top} >= {r.low} * {r.over}" for r in rules if r.low is not None]
    tests += [f"1000 * {r.top} <= {r.high} * {r.over}" for r in rules if r.high is not None]
    stop = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g2, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
      len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]')))::BIGINT AS n_bullet_lines,
      len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, n_bullet_lines,
       n_ellipsis_lines, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b
""".replace("\\u2022", "•").replace("\\u2026", "…")
