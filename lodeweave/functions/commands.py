"""Shell commands: normal form, similarity, outcome markers. The parser is Python, in Arrow batches."""

from __future__ import annotations

import difflib
import re
import shlex

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of arguments, the first that fits counts; wrappers, display stages and signs of the shell.
ARGUMENT_CLASSES = [
    ("<UUID>", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("<VERSION>", r"^([vV]\d+(\.\d+)*|\d+(\.\d+){2,}([-+][0-9A-Za-z.]+)?)$"),
    ("<PATH>", r"/|^\.{1,2}$|^~"),
    ("<NUM>", r"^-?\d+(\.\d+)?$"),
    ("<PATH>", r"^[\w.\-*?]+\.\w{1,5}$"),
]
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_]*=.*$"
#: Words by their part in a line, as one letter: between commands, between stages, and what stands before a command.
PARTS = {"&&": ";", "||": ";", ";": ";", "|": "|", "cd": "c", "2>&1": "m", "-n": "N", "cat": "d", "tail": "d", "head": "d", "timeout": "t", "env": "w", "nohup": "w", "nice": "n", "stdbuf": "s"}
MOST_VERB_TOKENS = 3
VERB_WEIGHT, FLAG_WEIGHT, ARG_WEIGHT = 0.5, 0.3, 0.2
SOFT_VERB_RATIO, SOFT_VERB_SCORE = 0.8, 0.7
BAND = (0.55, 0.999)
# What in a command's output tells how it ended.
MARKERS = [
    ("maven.build_failure", "BUILD FAILURE", "failure"),
    ("maven.build_success", "BUILD SUCCESS", "success"),
    ("maven.tests_failed", "Tests run:.*Failures: [1-9]", "failure"),
    ("gradle.build_failed", "BUILD FAILED", "failure"),
    ("gradle.build_successful", "BUILD SUCCESSFUL", "success"),
    ("pytest.failed", r"[1-9]\d* failed", "failure"),
    ("pytest.errors", "^ERRORS?$", "failure"),
    ("pytest.passed", r"\d+ passed", "success"),
    ("cargo.error", r"^error(\[E\d+\])?:", "failure"),
    ("cargo.finished", "Finished .* profile", "success"),
    ("go_test.fail", "^FAIL", "failure"),
    ("go_test.ok", r"^ok\s", "success"),
    ("jest.failed", r"Tests:.*[1-9]\d* failed", "failure"),
    ("jest.passed", r"Tests:.*\d+ passed", "success"),
    ("make.error", r"\*\*\* \[", "failure"),
    ("shell.command_not_found", "command not found", "failure"),
    ("shell.no_such_file", "No such file or directory", "failure"),
    ("shell.permission_denied", "Permission denied", "failure"),
    ("shell.traceback", r"Traceback \(most recent call last\)", "failure"),
]
#: Markers under which an arc is of low confidence; the table above has none of them, a caller's own may.
TRANSIENT = {"generic.timeout", "generic.connection_reset", "generic.rate_limit"}

NORMAL = "verb string, flags array<string>, args array<string>, arg_classes array<string>, env_names array<string>, cd_target string"


def words(command: str | None) -> list[str]:
    """Shell words; split at white space if the quotes do not match."""
    try:
        return shlex.split(command or "", posix=True)
    except ValueError:
        return (command or "").split()


_CLASSES = [(name, re.compile(pattern)) for name, pattern in ARGUMENT_CLASSES]
_ASSIGNMENT = re.compile(ASSIGNMENT)
# The shape of a line is a string of one letter a word (see PARTS; else - flag, = assignment, a an argument with a class,
# x any other word); what a line stands for is read off it with these expressions.
_LINE = re.compile(r"(?P<cds>(?:;*c[^;]?(?:;+|$))*)(?:(?:.*;)?(?P<last>[^;]+))?;*$")
_STAGES = re.compile(r"\|*(?P<main>[^|]*?)(?P<merge>m)?(?P<more>(?:\|+[^|]+)*?)(?:\|+d[^|]*)*\|*$")
_COMMAND = re.compile(r"(?P<before>(?:=|t.?|w|n(?:N.?)?|s[\-N]*)*+)(?P<verb>.[^a\-N]{0,%d})?" % (MOST_VERB_TOKENS - 1))
_BEFORE = re.compile(r"t.?|nN.?|.")


def argument_class(word: str) -> str:
    return next((name for name, pattern in _CLASSES if pattern.search(word)), word)


def argument_class_column(word: Column) -> Column:
    return F.coalesce(*[F.when(word.rlike(pattern), F.lit(name)) for name, pattern in ARGUMENT_CLASSES], word)


def _letter(word: str) -> str:
    if word in PARTS:
        return PARTS[word]
    if word.startswith("-"):
        return "-"
    if _ASSIGNMENT.match(word):
        return "="
    return "x" if argument_class(word) == word else "a"


def normal_form(command: str | None) -> dict:
    """The command a line stands for: leading cds, wrappers and display stages taken off, the last of several counts."""
    ws = words(command)
    shape = "".join(map(_letter, ws))
    line = _LINE.match(shape)
    cds = line["cds"].rstrip(";")
    cd = cds.rfind(";") + 1
    lo = max(0, line.start("last"))
    stages = _STAGES.match(line["last"] or "")
    main = slice(lo + stages.start("main"), lo + stages.end("main"))
    cmd = _COMMAND.match(shape[main])
    first = main.start + cmd.end("before")
    verb = ws[first : first + len(cmd["verb"] or "")]
    for k, w in enumerate(verb[1:], 1):
        if argument_class(w) != w:
            verb = verb[:k]
            break
    more = range(lo + stages.start("more"), lo + stages.end("more"))
    rest = [*ws[first + len(verb) : main.stop], *(ws[i] for i in more if shape[i] != "|")]
    args = [w for w in rest if not w.startswith("-")]
    return {
        "verb": " ".join(verb),
        "flags": sorted(w for w in rest if w.startswith("-")),
        "args": args,
        "arg_classes": [argument_class(w) for w in args],
        "env_names": [ws[m.start()].partition("=")[0] for m in _BEFORE.finditer(shape, main.start, first) if m[0] == "="],
        "cd_target": ws[cd + 1] if len(cds) - cd == 2 else None,
    }


def normalize_command(command: Column) -> Column:
    """normal_form of a column of commands, as a struct."""

    def run(commands: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normal_form(c) for c in commands], columns=["verb", "flags", "args", "arg_classes", "env_names", "cd_target"])

    return F.pandas_udf(run, NORMAL)(command)


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _overlap(a, b) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def similarity(a: dict, b: dict) -> float:
    """Of two normal forms: verb, flags and arguments, weighted."""
    verb = 1.0 if a["verb"] == b["verb"] else SOFT_VERB_SCORE if _ratio(a["verb"], b["verb"]) > SOFT_VERB_RATIO else 0.0
    x, y = list(a["args"]), list(b["args"])
    if len(x) == len(y):
        args = sum(map(_ratio, x, y)) / len(x) if x else 1.0
    else:
        args = _overlap(a["arg_classes"], b["arg_classes"]) * min(len(x), len(y)) / max(len(x), len(y))
    return VERB_WEIGHT * verb + FLAG_WEIGHT * _overlap(a["flags"], b["flags"]) + ARG_WEIGHT * args


def identical(a: dict, b: dict) -> bool:
    return a["verb"] == b["verb"] and set(a["flags"]) == set(b["flags"]) and list(a["args"]) == list(b["args"])


def in_band(score: float) -> bool:
    """Similar, but not the same: a changed command."""
    return BAND[0] <= score < BAND[1]


def command_similarity(a: Column, b: Column) -> Column:
    """similarity of two columns of commands."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity(normal_form(c), normal_form(d)) for c, d in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def markers(stdout: Column, stderr: Column) -> Column:
    """Ids of the markers found in a command's output, in table order."""
    both = F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    return F.array_compact(F.array(*[F.when(both.rlike(f"(?m){p}"), F.lit(i)) for i, p, _ in MARKERS]))


def termination(rc: Column, interrupted: Column) -> Column:
    return (
        F.when(F.coalesce(interrupted, F.lit(False)), "cancelled")
        .when(rc.isNull(), "unknown")
        .when((rc < 0) | (rc > 128), "signal")
        .otherwise("normal")
    )


def outcome(rc: Column, is_error: Column, interrupted: Column, found: Column, harness: Column | None = None) -> Column:
    """success, failure, soft_failure, interrupted or unknown, from the end of a command and its markers.

    harness: whether the harness counts it as a success; it has a say only where nothing else has.
    """
    routed = F.lit("unknown") if harness is None else F.when(harness, "success").when(~harness, "failure").otherwise("unknown")
    of = lambda kind: F.arrays_overlap(found, F.array(*[F.lit(i) for i, _, k in MARKERS if k == kind]))
    return (
        F.when(termination(rc, interrupted).isin("signal", "cancelled"), "interrupted")
        .when(of("failure"), F.when(rc.isNull() | (rc == 0), "soft_failure").otherwise("failure"))
        .when(of("success"), "success")
        .when(rc.isNotNull(), F.when(rc == 0, "success").otherwise("failure"))
        .when(F.coalesce(is_error, F.lit(False)), "failure")
        .otherwise(routed)
    )
