"""Redaction inside nested values: JSON of any depth and shape, VARIANT, and typed columns. Keys are left alone."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K

from .text import bind, redaction

#: Stand for an escaped backslash and quote; raw control characters cannot be in valid JSON.
_SLASH, _QUOTE = "\x01", "\x02"
#: A string of such a text, with the colon after it if it is a key.
_STRING = r'"[^"]*"(?:\s*:)?'


def redact_json(text: Column, keys: tuple[str, ...] = (), prefixes: tuple[tuple[str, int, int | None], ...] = ()) -> Column:
    """struct(value, n) of a JSON text: every string in it that is no key redacted, and the replacements made; null where it is no JSON.

    The text is cut at its strings, so that nesting does not matter; what has no secret comes back to the letter. Null gives null.
    """

    def leaf(s: Column) -> Column:
        raw = F.replace(F.replace(s, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))
        return bind(raw, lambda r: F.when(F.endswith(r, F.lit(":")), F.struct(r.alias("value"), F.lit(0).alias("n"))).otherwise(bind(redaction(_decoded(r), keys, prefixes), lambda x: _kept(r, x))))

    def rebuilt(t: Column) -> Column:
        parts, gaps = F.transform(F.regexp_extract_all(t, F.lit(_STRING), 0), leaf), F.transform(F.split(t, _STRING, -1), lambda g: F.struct(g.alias("value"), F.lit(0).alias("n")))
        both = bind(parts, lambda p: bind(gaps, lambda g: F.flatten(F.transform(g, lambda x, k: F.array_compact(F.array(x, F.get(p, k)))))))
        return bind(both, lambda b: F.struct(F.array_join(F.transform(b, lambda x: x["value"]), "").alias("value"), F.aggregate(b, F.lit(0), lambda n, x: n + x["n"]).alias("n")))

    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.when(F.try_parse_json(text).isNotNull(), bind(marked, rebuilt))


def _decoded(string: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>"), F.lit(0))


def _kept(raw: Column, done: Column) -> Column:
    coded = F.to_json(F.array(done["text"]))
    return F.struct(F.when(F.coalesce(done["n"], F.lit(0)) == 0, raw).otherwise(F.substring(coded, F.lit(2), F.length(coded) - 2)).alias("value"), F.coalesce(done["n"], F.lit(0)).alias("n"))


def redact_value(value: Column, kind: K.DataType, keys: tuple[str, ...] = (), prefixes: tuple[tuple[str, int, int | None], ...] = ()) -> tuple[Column, Column]:
    """(value, replacements) of a column of any type: strings in structs, arrays, map values and VARIANT are redacted, all else is as it was.

    Nulls stay null and count 0. The plan follows the type; a VARIANT is walked as its JSON.
    """
    again = lambda v, k: redact_value(v, k, keys, prefixes)
    total = lambda values, k: F.coalesce(F.aggregate(values, F.lit(0), lambda n, v: n + again(v, k)[1]), F.lit(0))
    if isinstance(kind, K.StringType):
        done = redaction(value, keys, prefixes)
        return done["text"], F.coalesce(done["n"], F.lit(0))
    if isinstance(kind, K.VariantType):
        done = redact_json(F.to_json(value), keys, prefixes)
        return F.parse_json(done["value"]), F.coalesce(done["n"], F.lit(0))
    if isinstance(kind, K.ArrayType):
        return F.transform(value, lambda v: again(v, kind.elementType)[0]), total(value, kind.elementType)
    if isinstance(kind, K.MapType):
        return F.transform_values(value, lambda k, v: again(v, kind.valueType)[0]), total(F.map_values(value), kind.valueType)
    if isinstance(kind, K.StructType) and kind.fields:
        parts = [again(value[f.name], f.dataType) for f in kind.fields]
        fields = F.struct(*[p[0].alias(f.name) for p, f in zip(parts, kind.fields, strict=True)])
        return F.when(value.isNotNull(), fields), reduce(lambda x, y: x + y, [p[1] for p in parts])
    return value, F.lit(0)


def redact_structured(df, column: str, keys: tuple[str, ...] = (), prefixes: tuple[tuple[str, int, int | None], ...] = (), json: bool = False):
    """df with the column redacted at any depth, and redactions. With json a string column holds JSON texts; those that do not parse become null."""
    kind = df.schema[column].dataType
    if json:
        done = redact_json(df[column], keys, prefixes)
        value, n = done["value"], F.coalesce(done["n"], F.lit(0))
    else:
        value, n = redact_value(df[column], kind, keys, prefixes)
    return df.withColumns({column: value, "redactions": n})
