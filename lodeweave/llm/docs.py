"""Problem 2: functions paired with their documentation.

Method: comment spans and function spans of a whole text are extracted independently of each other, as rows
of positions; one as-of interval join over a whole batch attaches to each function the nearest documentation
comment that ends before it, in Python the nearest string statement from its body on, and pairs with a
statement between the two are rejected. What is left is dropped if the documentation says nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.runtime import spread

FUNCTION_NODES = ("function_definition", "function_declaration", "function_item", "method_definition", "method_declaration")
LEAST_WORDS = 4
_ROW = 1 << 40  # positions of a batch: row * _ROW + place in the text

# How the languages are named by extension.
_BY_EXTENSION = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust"}

_WORD = re.compile(r"[A-Za-z]+(?:'[a-z]+)?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_RULER = re.compile(r"^[\W_]*$")
_CODE = re.compile(r"[;{}]\s*$|^[\w.$:]+\s*\([^()]*\)\s*[;{]?$|^[\w.$\[\]]+\s*(?::=|=|\+=)\s|^(?:return|if|for|while|let|var|const|import|from|package|use)\b[^.!?]*[;({\[=:]|^(?:let|var|const)\s+\w+")
_LINTER = re.compile(
    r"^(?:go:\w|nolint|lint:|eslint|tslint|jshint|jslint|prettier-ignore|istanbul|c8 |v8 |@ts-|ts-|noqa|pylint|flake8|mypy|pyright|type:\s*ignore|fmt:|yapf|isort|pragma|checkstyle|NOSONAR|noinspection|CHECKSTYLE|clippy|rustfmt|spell-?checker|cspell|coverage|\+build|export \w+$)",
    re.I,
)
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX)\b(?:\([^)]*\))?:?")
_TAG = re.compile(r"^(?:@\w+|\\(?:param|return|brief)\w*|:\w+(?:\s+[^:]*)?:)")
_SECTION = re.compile(r"^(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|yields?|attributes|keyword args|other parameters|throws|errors|panics|safety|examples?)\s*:?$", re.I)
_SECTION_INLINE = re.compile(r"^(?:args|arguments|parameters|params|returns?|raises|yields?|throws)\s*:", re.I)
_ENTRY = re.compile(r"^(?:[*\-]\s*)?`?\*{0,2}\w+`?\s*(?:\([^)]*\))?\s*(?::|\s-\s)")

_HEADER = {
    "python": r"^[ \t]*(?:async[ \t]+)?def[ \t]+{name}[ \t]*[(\[]",
    "go": r"^[ \t]*func\b[ \t]*(?:\([^)]*\)[ \t]*)?{name}[ \t]*[(\[]",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+{name}[ \t]*[(<]",
    "java": r"^[ \t]*(?![ \t]*(?://|\*|/\*|@|#))(?:[\w.<>\[\], ?&]+[ \t]+)?{name}[ \t]*\(",
    "javascript": r"^[ \t]*(?![ \t]*(?://|\*|/\*|@|#))(?:[\w ]*?[ \t*])?{name}[ \t]*(?:=[^=\n]*?)?[(<]",
}
_HEADER["typescript"] = _HEADER["javascript"]
_DOC_LINE = {"rust": re.compile(r"^\s*(?:///(?!/)|#\[doc\s*=)"), "go": re.compile(r"^\s*//")}
_ATTRIBUTE = re.compile(r"^\s*(?:@(?!interface\b)|#\[|#!\[|# class: )")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|//[^\n]*")
_STRING = r"[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
_PYTHON = re.compile(rf"(?P<blank>[ \t\f]+|\\\n|#[^\n]*)|(?P<string>{_STRING})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<end>\n|;)|(?P<colon>:)|(?P<word>\w+)|(?P<other>[^\w\s\"'#()\[\]{{}};:\\]+|[\s\S])")
_QUOTES = re.compile(r"^[rRuU]?(\"\"\"|\'\'\'|\"|')")


def language_of(language: str | None, path: str | None) -> str | None:
    if language:
        return language
    return _BY_EXTENSION.get((path or "").rpartition(".")[2].lower())


def plain_text(lines: list[str], symbol: str | None) -> tuple[str, int]:
    """(the description, its words besides those of the symbol) of a comment's lines without their marks."""
    kept, section = [], -1
    for raw in lines:
        line = raw.strip()
        if not line:
            section = -1
            kept.append("")
            continue
        indent = len(raw) - len(raw.lstrip())
        if section >= 0 and (indent > section or _ENTRY.match(line)):
            continue
        section = -1
        if _SECTION.match(line) or _SECTION_INLINE.match(line):
            section = indent
            continue
        if _TAG.match(line) or _LINTER.match(line) or _RULER.match(line) or _CODE.search(line):
            continue
        kept.append(_TODO.sub("", line).strip())
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()
    own = {p.lower() for p in _PARTS.findall(symbol or "")} | {w.lower() for w in _WORD.findall(symbol or "")} | {(symbol or "").lower()}
    words = [w for w in re.findall(r"[A-Za-z][\w']*", text) if w.lower() not in own]
    return text, len(words)


def _block(lines: list[str]) -> list[str]:
    """The lines of a /* ... */ comment without its marks."""
    text = "\n".join(lines).strip()
    text = re.sub(r"^/\*+!?", "", text)
    text = re.sub(r"\*+/\s*$", "", text)
    return [re.sub(r"^\s*\*+(?!\w)", "", x) for x in text.split("\n")]


def _comments(lines: list[str], language: str) -> tuple[list[tuple[int, int, list[str], int]], list[int]]:
    """(comment spans (first, last, text lines, statements up to them) in the language's form, how many statements stand before each line)."""
    spans, statements, n, i = [], [0], 0, 0
    lone = _DOC_LINE.get(language)
    while i < len(lines):
        s = lines[i].strip()
        j = i
        if s.startswith("/*"):
            while j < len(lines) - 1 and "*/" not in lines[j][2 if j == i else 0 :]:
                j += 1
            tail = lines[j].partition("*/")[2].strip() if j > i or s.count("*/") else ""
            n += bool(tail)
            if s.startswith("/**") and not s.startswith("/**/") or language == "go":
                spans.append((i, j, _block(lines[i : j + 1]), n))
        elif lone and lone.match(lines[i]):
            while j < len(lines) - 1 and lone.match(lines[j + 1]):
                j += 1
            text = []
            for x in lines[i : j + 1]:
                m = re.match(r"^\s*#\[doc\s*=\s*r?#*\"(.*)\"#*\s*\]\s*$", x)
                text.append(" " + m[1] if m else re.sub(r"^\s*//[/!]?", "", x))
            if not (language == "go" and all(_LINTER.match(x.strip()) for x in text)):
                spans.append((i, j, text, n))
        elif language == "go" and not s:
            n += 1  # in Go documentation stands directly above
        elif s and _ATTRIBUTE.match(s):
            depth = 0  # an attribute reaches to the line on which its brackets are closed
            while True:
                plain = _LITERAL.sub("", lines[j])
                depth += sum(map(plain.count, "([{")) - sum(map(plain.count, ")]}"))
                if depth <= 0 or j == len(lines) - 1:
                    break
                j += 1
            if depth != 0:
                j, n = i, n + (depth > 0)
        elif s and not s.startswith("//"):
            n += 1
        statements += [n] * (j - i + 1)
        i = j + 1
    return spans, statements


_NAME = r"(?!(?:if|for|while|switch|catch|return|function|new)\b)(?P<name>[A-Za-z_$][\w$]*)"
_HEADERS = {k: re.compile(v.replace("{name}", _NAME), re.M) for k, v in _HEADER.items()}


def _bracketed(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """Functions (name, its line, its header's place, statements before) and comments (line after it, first, last, lines, statements before)."""
    lines = text.split("\n")
    spans, statements = _comments(lines, language)
    functions, line, at = [], 0, 0
    for m in _HEADERS[language].finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        functions.append((m["name"], line, at, statements[line]))
    return functions, [(last + 1, first, last, words, n) for first, last, words, n in spans]


def _python(text: str) -> tuple[list[tuple], list[tuple]]:
    """Functions (name, place of the body, place of the header, statements before the body) and string statements (place, place, end, lines, statements before)."""
    functions, strings = [], []
    depth = begun = 0
    fresh, header, held = True, None, None  # held: a string that is a statement if nothing follows it
    for m in _PYTHON.finditer(text):
        kind = m.lastgroup
        if kind == "blank":
            continue
        if kind == "end":
            if depth == 0:
                if held:
                    strings.append(held)
                fresh, header, held = True, None, None
            continue
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        if fresh:
            fresh = False
            if kind == "string":
                if q := _QUOTES.match(m[0]):
                    held = (m.start(), m.start(), m.end(), m[0][q.end() : len(m[0]) - len(q[1])].split("\n"), begun)
            elif kind == "word" and m[0] in ("def", "async"):
                line = text.rfind("\n", 0, m.start()) + 1
                header = _HEADERS["python"].match(text, line) if not text[line : m.start()].strip() else None
            begun += 1
        elif kind == "colon" and depth == 0 and header:
            functions.append((header["name"], m.end(), header.start(), begun))
            fresh, header = True, None
        elif kind != "string" or not held:  # of joined literals the first stands for all
            held = None
    if held:
        strings.append(held)
    return functions, strings


def _own(functions: list[tuple], symbol: str | None) -> list[tuple]:
    """The function named symbol; without a symbol the first one."""
    return [f for f in functions if not symbol or f[0] == symbol][:1]


_OUT = "chunk_id string, workspace string, file_path string, language string, symbol_name string, function_name string, code string, description string, words int"


def _run(every: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            functions, comments, texts = [], [], {}
            for i, r in enumerate(rows.itertuples(index=False)):
                language = language_of(r.language, r.file_path)
                if language not in _HEADER:
                    continue
                text = texts[i] = r.content.replace("\r\n", "\n")
                python = language == "python"
                found, spans = _python(text) if python else _bracketed(text, language)
                for name, at, header, n in found if every else _own(found, r.symbol_name):
                    functions.append((i * _ROW + at, i, n, name, header, language, python))
                comments += [(i * _ROW + at, i, n, (first, last, words), python) for at, first, last, words, n in spans]
            if not functions or not comments:
                continue
            left = pd.DataFrame(functions, columns=["pos", "row", "statements", "name", "header", "language", "python"]).sort_values("pos", kind="stable")
            right = pd.DataFrame(comments, columns=["pos", "row", "before", "span", "python"]).sort_values("pos", kind="stable")
            out = []
            for python, direction in ((True, "forward"), (False, "backward")):
                some, spans = left[left["python"] == python], right[right["python"] == python]
                if some.empty or spans.empty:
                    continue
                near = pd.merge_asof(some, spans.drop(columns="python"), on="pos", by="row", direction=direction)
                near = near[near["before"] == near["statements"]]  # else a statement stands between them
                for x in near.itertuples(index=False):
                    r, text = rows.iloc[x.row], texts[x.row]
                    first, last, lines = x.span
                    if python:
                        code = text[x.header : first].rstrip() + text[last:]
                        lines = [lines[0].strip(), *lines[1:]]
                    else:
                        head = text[: x.header].split("\n")[:-1] if x.header else []
                        code = "\n".join([y for y in head[last + 1 :] if not y.startswith("# class: ")] + [text[x.header :]])
                    description, words = plain_text(lines, x.name if every else r["symbol_name"])
                    if words >= LEAST_WORDS:
                        out.append((r["chunk_id"], r["workspace"], r["file_path"], x.language, r["symbol_name"], x.name, code, description, words))
            if out:
                yield pd.DataFrame(out, columns=["chunk_id", "workspace", "file_path", "language", "symbol_name", "function_name", "code", "description", "words"])

    return run


def documented_functions(chunks: DataFrame, every: bool = False) -> DataFrame:
    """Code and description of every function or method chunk that is documented in its language's own form.

    Result: chunk_id, workspace, file_path, language, symbol_name, function_name, code (without the documentation),
    description, words (those of the description besides the symbol's own). A chunk counts by the function of its
    symbol_name; with every=True each function of each text gives a row of its own. The forms: Python docstrings, /** */ in Java, JavaScript,
    TypeScript and Rust, /// and #[doc] in Rust, any comment of words directly above in Go. Documentation with fewer than
    four words after comment marks, tag lines, TODO and FIXME and the words of symbol_name are taken away gives no row,
    nor do code in comments, linter directives and rulers. Chunks with NULL or empty content, of other node types, of
    other languages or in which no function is found give none. NULL language is that of the path's extension; with NULL or
    empty symbol_name the first function counts and no words are taken away. Repeated chunks (same chunk_id and
    content) count once. An empty table gives an empty result; other columns are ignored.
    """
    cols = ["chunk_id", "workspace", "file_path", "language", "symbol_name", "content"]
    rows = chunks.filter(F.col("node_type").isin(*FUNCTION_NODES) & (F.length("content") > 0)).select(cols)
    return spread(rows).mapInPandas(_run(every), _OUT).dropDuplicates(["chunk_id", "function_name", "code", "description"])
