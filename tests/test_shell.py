"""Routes of shell calls: each reason has a case, and the fold over characters is held against a plain lexer."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import shell


def decide(spark, rows, **settings):
    df = spark.createDataFrame(rows, "k int, tool string, input string, cwd string")
    got = df.select("k", shell.classify_shell_call(F.col("tool"), F.col("input"), F.col("cwd"), **settings).alias("d")).orderBy("k").collect()
    return [{n: v for n, v in r.d.asDict().items() if v is not None} for r in got]


def one(spark, command, tool="Bash", cwd="/w", more=None, **settings):
    return decide(spark, [(0, tool, json.dumps({"command": command, **(more or {})}), cwd)], **{"wrap": False, **settings})[0]


def read(path, *lines):
    return {"status": "eligible", "route": "read", "path": path, **dict(zip(("start_line", "end_line"), lines))}


def no(reason):
    return {"status": "bypassed", "reason": reason}


CASES = [
    ("cat a.txt", read("a.txt")), ("cat -- -a", no("unsafe-read-target")), ("cat -- a", read("a")), ("cat ./x//y/./z", read("x/y/z")), ("cat 'a b'", read("a b")), ('cat a"b"c', read("abc")), ("cat -n a", no("read-shape")), ("cat a b", no("read-shape")), ("cat", no("read-shape")), ("cat -", no("unsafe-read-target")),
    ("cat /etc/passwd", no("unsafe-read-target")), ("cat ../a", no("unsafe-read-target")), ("cat a\\b", no("ambiguous-shell")), ("cat .", no("unsafe-read-target")), ("cat a/..", no("unsafe-read-target")), ("cat ''", no("unsafe-read-target")),
    ("sed -n 3,9p a", read("a", 3, 9)), ("sed -n '7p' a", read("a", 7, 7)), ("sed -n 0,2p a", no("sed-shape")), ("sed -n 5,2p a", no("sed-shape")), ("sed -i s/a/b/ a", no("sed-shape")), ("sed -n 1,2p", no("sed-shape")), ("sed -n 1,2p /a", no("unsafe-read-target")),
    ("head a", read("a", 1, 10)), ("head -n 5 a", read("a", 1, 5)), ("head -7 a", read("a", 1, 7)), ("head -n 5 -- -a", no("unsafe-read-target")), ("head -n x a", no("head-shape")), ("head -c 5 a", no("head-shape")), ("head -n 0 a", no("head-shape")), ("head a b", no("head-shape")), ("head -n 3 -2 a", read("a", 1, 2)), ("head", no("head-shape")), ("head -n", no("head-shape")), ("head -- -n 3", no("head-shape")),
    ("tail a", no("tail-unbounded-from-end")), ("tail -n 5 a", no("tail-unbounded-from-end")), ("grep x a", no("grep-shell-wrap-disabled")), ("rg x", no("grep-shell-wrap-disabled")), ("make", no("unsupported-shell")), ("git diff", no("unsupported-shell")),
    ("cat a | wc", no("ambiguous-shell")), ("cat a > b", no("ambiguous-shell")), ("cat *.py", no("ambiguous-shell")), ("cat '$a'", no("ambiguous-shell")), ("cat 'a", no("ambiguous-shell")), ("cat a\nls", no("ambiguous-shell")), ("", no("ambiguous-shell")), ("   ", no("ambiguous-shell")), ("cat " + "a" * 8190, no("ambiguous-shell")), ("cat " + "a" * 5000, no("unsafe-read-target")),
    ("sh -lc 'cat a'", read("a")), ("/bin/bash -c 'head -3 a'", read("a", 1, 3)), ("bash -lc 'cat a | wc'", no("ambiguous-shell")), ('bash -lc "sh -c \'cat a\'"', no("unsupported-shell")), ("bash -x a b", no("unsupported-shell")), ("bash -lic 'tail a'", no("tail-unbounded-from-end")),
    (["/bin/bash", "-lc", "cat a"], read("a")), (["cat", "a b"], read("a b")), (["cat", "a|b"], no("ambiguous-shell")), (["cat", "it's"], no("ambiguous-shell")), ([], no("ambiguous-shell")), (["cat", 5], no("ambiguous-shell")), (["zsh", "-c", "a | b"], no("ambiguous-shell")), (7, no("ambiguous-shell")), (None, no("ambiguous-shell")), ({"a": 1}, no("ambiguous-shell")),
]


def test_cases(spark):
    rows = [(k, "Bash", json.dumps({"command": c}), "/w") for k, (c, _) in enumerate(CASES)]
    for (command, want), got in zip(CASES, decide(spark, rows, wrap=False), strict=True):
        assert got == want, command
    assert {w["reason"] for _, w in CASES if "reason" in w} | {"unsupported-tool", "invalid-input", "unsafe-cwd"} == set(shell.REASONS)


def test_tools_inputs_and_folders(spark):
    good = json.dumps({"command": "cat a"})
    rows = [("Read", good, "/w"), (None, good, "/w"), ("Bash", None, "/w"), ("Bash", "[1]", "/w"), ("Bash", '"cat a"', "/w"), ("Bash", "{", "/w"), ("Bash", good, "w"), ("Bash", good, None), ("Bash", good, "/a\x00b"), ("shell_command", good, "/w"), ("exec_command", good, "/w")]
    rows += [("Bash", json.dumps({"command": "cat a", "workdir": w}), "/w") for w in ("sub", "", "/abs", "../up", 5)]
    want = [no("unsupported-tool")] * 2 + [no("invalid-input")] * 4 + [no("unsafe-cwd")] * 3 + [read("a")] * 3 + [no("unsafe-cwd")] * 4
    assert decide(spark, [(k, *r) for k, r in enumerate(rows)]) == want


def test_wrapping(spark):
    wrapped = lambda c: {"status": "eligible", "route": "exec", "command": c}
    for command in ("make && make test", "grep -i x a", "cat -n a", "tail -5 a", "cat a | wc", "cat 'a"):
        assert one(spark, command, wrap=True) == wrapped(command)
    assert one(spark, "cat a", wrap=True) == read("a")
    assert one(spark, ["bash", "-lc", "a | b"], wrap=True) == wrapped("a | b")
    assert one(spark, ["rg", "it's"], wrap=True) == wrapped("'rg' 'it'\\''s'")
    assert one(spark, "tool exec -- make", wrap=True, own_pattern=r"\btool\s+exec\b") == no("unsupported-shell")
    assert one(spark, "  ", wrap=True) == no("ambiguous-shell")


def plain_words(command):
    """A lexer in plain Python."""
    if not command or len(command) > 8192 or "\0" in command:
        return None
    out, word, begun, quote = [], "", False, None
    for c in command:
        if c in ";|&<>$`(){}*?[]!~#\\":
            return None
        if quote:
            quote, word = (None, word) if c == quote else (quote, word + c)
        elif c in "'\"":
            quote, begun = c, True
        elif c in "\n\r":
            return None
        elif c.isspace():
            out += [word] * begun
            word, begun = "", False
        else:
            word, begun = word + c, True
    return None if quote else out + [word] * begun


@pytest.mark.parametrize("seed", [1, 2])
def test_words_brute_force(spark, seed):
    rng = random.Random(seed)
    commands = ["".join(rng.choice("aab-.'\"   \t é𝒳" + ("\n|" if k % 4 == 0 else "")) for _ in range(rng.randint(0, 20))) for k in range(600)]
    df = spark.createDataFrame(list(enumerate(commands)), "k int, c string")
    got = [r.w for r in df.select("k", shell.shell_words(F.col("c")).alias("w")).orderBy("k").collect()]
    assert got == [plain_words(c) for c in commands]
