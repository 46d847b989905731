"""How a call of a shell tool would be routed: as a read of lines, wrapped whole, or not at all, with a closed set of reasons.

What only the file system can tell (whether a path exists, is a file or a link) is left out.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

#: Tools, shells, and limits of commands and paths.
TOOLS = ("Bash", "exec_command", "shell_command")
SHELLS = tuple(f"{folder}{shell}" for folder in ("", "/bin/", "/usr/bin/") for shell in ("sh", "bash", "zsh", "dash"))
MOST_COMMAND, MOST_PATH, HEAD_LINES = 8192, 4096, 10
#: Why a call is not routed.
REASONS = ("unsupported-tool", "invalid-input", "unsafe-cwd", "ambiguous-shell", "read-shape", "sed-shape", "head-shape", "unsafe-read-target", "tail-unbounded-from-end", "grep-shell-wrap-disabled", "unsupported-shell")
#: Characters with a meaning to a shell; a command with one of them, quoted or not, is not parsed.
_SPECIAL = "\\;|&<>$`(){}*?[]!~#"
_SPACES = " \t\n\r\x0b\x0c\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
DECISION = "struct<status:string,route:string,reason:string,path:string,start_line:long,end_line:long,command:string>"


def shell_words(command: Column) -> Column:
    """The words of a command without quotes; null where it is empty, too long, unbalanced, of several lines, or holds a special character.

    A fold over characters that carries the words so far, the word begun, whether there is one, and the open quote.
    """
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit("").alias("word"), F.lit(False).alias("begun"), F.lit("").alias("quote"), F.lit(False).alias("bad"))

    def step(s: Column, c: Column) -> Column:
        inside = s["quote"] != ""
        closing, opening = inside & (c == s["quote"]), ~inside & c.isin("'", '"')
        gap = ~inside & c.isin(*_SPACES)
        return F.struct(
            F.when(gap & s["begun"], F.array_append(s["words"], s["word"])).otherwise(s["words"]).alias("words"),
            F.when(gap, F.lit("")).when(closing | opening, s["word"]).otherwise(F.concat(s["word"], c)).alias("word"),
            (~gap).alias("begun"),
            F.when(closing, F.lit("")).when(opening, c).otherwise(s["quote"]).alias("quote"),
            (s["bad"] | c.isin(*_SPECIAL) | (~inside & c.isin("\n", "\r"))).alias("bad"),
        )

    def end(s: Column) -> Column:
        return F.when(~s["bad"] & (s["quote"] == ""), F.when(s["begun"], F.array_append(s["words"], s["word"])).otherwise(s["words"]))

    able = (command != "") & (F.length(command) <= MOST_COMMAND) & ~F.contains(command, F.lit("\x00"))
    return F.when(able, F.aggregate(F.filter(F.split(command, ""), lambda c: c != ""), start, step, end))


def _inner(words: Column) -> Column:
    """The command of sh -c and the like; null for other words."""
    wrapped = (F.size(words) == 3) & F.get(words, F.lit(0)).isin(*SHELLS) & F.get(words, F.lit(1)).rlike("^-[a-z]*c$")
    return F.when(wrapped, F.get(words, F.lit(2)))


def _safe_path(path: Column) -> Column:
    """A relative path in its plain form; null where it leads out, is absolute or looks like an option."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    good = (path != "") & (F.length(path) <= MOST_PATH) & ~path.rlike(r"^[/-]|\x00") & ~F.array_contains(F.split(path, r"[\\/]"), "..") & (F.size(parts) > 0)
    return F.when(good, F.array_join(parts, "/"))


def _decision(status: str, **fields: Column | str) -> Column:
    value = lambda n: fields[n] if isinstance(fields.get(n), Column) else F.lit(fields.get(n))
    names = {"route": "string", "reason": "string", "path": "string", "start_line": "long", "end_line": "long", "command": "string"}
    return F.struct(F.lit(status).alias("status"), *[value(n).cast(t).alias(n) for n, t in names.items()])


def _read(path: Column, shape: Column, reason: str, first: Column | None = None, last: Column | None = None) -> Column:
    lines = {"start_line": first, "end_line": last} if first is not None else {}
    return bind(_safe_path(path), lambda p: F.when(~F.coalesce(shape, F.lit(False)), _decision("bypassed", reason=reason)).when(p.isNull(), _decision("bypassed", reason="unsafe-read-target")).otherwise(_decision("eligible", route="read", path=p, **lines)))


def _cat(args: Column) -> Column:
    dash = F.array_position(args, "--")
    options = F.when(dash > 0, F.slice(args, F.lit(1), dash.cast("int") - 1)).otherwise(args)
    names = F.when(dash > 0, F.concat(options, F.slice(args, dash.cast("int") + 1, F.size(args)))).otherwise(args)
    shape = (F.size(names) == 1) & ~F.exists(options, lambda a: a.rlike("(?s)^-."))
    return _read(F.get(names, F.lit(0)), shape, "read-shape")


def _sed(args: Column) -> Column:
    span = F.get(args, F.lit(1))
    pattern = r"^(\d+)(?:,(\d+))?p$"
    first = F.regexp_extract(span, pattern, 1).try_cast("long")
    last = F.when(F.regexp_extract(span, pattern, 2) == "", first).otherwise(F.regexp_extract(span, pattern, 2).try_cast("long"))
    shape = (F.size(args) == 3) & (F.get(args, F.lit(0)) == "-n") & span.rlike(pattern) & (first >= 1) & (last >= first)
    return _read(F.get(args, F.lit(2)), shape, "sed-shape", first, last)


def _head(args: Column) -> Column:
    """A fold over the arguments, as -n takes the one after it."""
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(HEAD_LINES).cast("long").alias("n"), F.lit(False).alias("dash"), F.lit(False).alias("skip"), F.lit(False).alias("bad"))

    def step(s: Column, k: Column) -> Column:
        a, after = F.get(args, k), F.get(args, k + 1)
        free = ~s["dash"] & ~s["skip"]
        takes = free & (a == "-n") & F.coalesce(after.rlike(r"^\d+$"), F.lit(False))
        short = free & a.rlike(r"^-\d+$")
        name = ~s["skip"] & (s["dash"] | ~a.rlike("(?s)^-."))
        return F.struct(
            F.when(name, F.array_append(s["names"], a)).otherwise(s["names"]).alias("names"),
            F.when(takes, after.try_cast("long")).when(short, F.substring(a, F.lit(2), F.length(a)).try_cast("long")).otherwise(s["n"]).alias("n"),
            (s["dash"] | (free & (a == "--"))).alias("dash"),
            takes.alias("skip"),
            (s["bad"] | (free & ~takes & ~short & (a != "--") & a.rlike("(?s)^-."))).alias("bad"),
        )

    at = F.when(F.size(args) > 0, F.sequence(F.lit(0), F.size(args) - 1)).otherwise(F.array().cast("array<int>"))
    return bind(F.aggregate(at, start, step), lambda s: _read(F.get(s["names"], F.lit(0)), ~s["bad"] & (F.size(s["names"]) == 1) & (s["n"] >= 1), "head-shape", F.lit(1), s["n"]))


def classify_shell_call(tool: Column, tool_input: Column, cwd: Column, wrap: bool = True, own_pattern: str | None = None) -> Column:
    """DECISION for a tool call: its name, its input as JSON ({"command": text or argv, "workdir"}) and its folder.

    status eligible: route read (path, lines where they are given) or exec (command, to be wrapped as it is); bypassed: reason, one of REASONS.
    One level of sh -c and the like is taken off. wrap: whether what cannot be routed as a read is wrapped; commands that own_pattern
    finds are wrapped already and are not again. Null or broken input is invalid-input; a null tool is unsupported-tool, a null folder unsafe-cwd.
    """
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    part = lambda v, p, t: F.try_variant_get(v, p, t)
    quoted = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    parsed = F.try_parse_json(tool_input)

    def command(v: Column) -> Column:
        """struct(raw, words): the command as text, and its words where it can be parsed."""
        whole = part(v, "$.command", "variant")
        items = part(v, "$.command", "array<variant>")
        argv = F.when(kind(whole).startswith("ARRAY") & F.forall(items, lambda x: kind(x) == "STRING") & (F.size(items) > 0), F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))

        def of_list(a: Column) -> Column:
            return bind(F.coalesce(_inner(a), F.array_join(F.transform(a, quoted), " ")), lambda raw: F.struct(raw.alias("raw"), shell_words(raw).alias("words")))

        def of_text(c: Column) -> Column:
            return bind(shell_words(c), lambda w: F.struct(c.alias("raw"), F.when(_inner(w).isNotNull(), shell_words(_inner(w))).otherwise(w).alias("words")))

        return F.when(kind(whole) == "STRING", bind(part(v, "$.command", "string"), of_text)).when(argv.isNotNull(), bind(argv, of_list))

    def route(c: Column) -> Column:
        raw, words = c["raw"], c["words"]
        program, args = F.get(words, F.lit(0)), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
        free = F.coalesce(raw.rlike(r"\S"), F.lit(False)) & (~raw.rlike(own_pattern) if own_pattern else F.lit(True)) & F.lit(wrap)
        whole = lambda reason: F.when(free, _decision("eligible", route="exec", command=raw)).otherwise(_decision("bypassed", reason=reason))
        direct = F.when(program == "cat", _cat(args)).when(program == "sed", _sed(args)).when(program == "head", _head(args)).when(program == "tail", _decision("bypassed", reason="tail-unbounded-from-end")).otherwise(_decision("bypassed", reason="unsupported-shell"))
        told = bind(direct, lambda d: F.when((d["status"] != "eligible") & free, _decision("eligible", route="exec", command=raw)).otherwise(d))
        return F.when(F.coalesce(F.size(words) > 0, F.lit(False)), F.when(program.isin("grep", "rg"), whole("grep-shell-wrap-disabled")).otherwise(told)).otherwise(whole("ambiguous-shell"))

    def judged(v: Column) -> Column:
        folder = part(v, "$.workdir", "variant")
        text = part(v, "$.workdir", "string")
        leads_out = F.when(folder.isNull(), F.lit(False)).otherwise((kind(folder) != "STRING") | (text == "") | text.rlike(r"^/|\x00") | F.array_contains(F.split(text, r"[\\/]"), ".."))
        safe = cwd.rlike("^/") & ~F.contains(cwd, F.lit("\x00")) & ~leads_out
        out = F.when(~F.coalesce(tool.isin(*TOOLS), F.lit(False)), _decision("bypassed", reason="unsupported-tool")).when(~kind(v).startswith("OBJECT"), _decision("bypassed", reason="invalid-input"))
        return out.when(~F.coalesce(safe, F.lit(False)), _decision("bypassed", reason="unsafe-cwd")).otherwise(bind(command(v), route))

    return bind(parsed, judged)
