"""Definitions of functions, methods and types in source files of several languages, and chunks made of them.

Literals and comments are blanked first, line by line as long as they were; headers are found by one expression a language,
bodies by their brackets, in Python by indents. So a file that does not parse still gives what can be made out of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.chunking import chunk_id, markdown_sections, postprocess, underlined_sections, window_chunks
from lodeweave.plans.runtime import spread

LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c"}
# Reserved words of the languages; what looks like a header of a function may be a statement of one.
RESERVED = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "java": "assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while",
    "javascript": "await break case catch class const continue default delete do else export extends finally for function if import in instanceof let new of return super switch this throw try typeof var void while with yield",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "c": "auto bool break case catch char class const continue default delete do double else enum extern float for goto if inline int long namespace new operator private protected public return short signed sizeof static struct switch template throw try typedef union unsigned using virtual void volatile while",
    "rust": "as async await break const continue else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while",
}
RESERVED["typescript"] = RESERVED["javascript"] + " interface type enum namespace declare abstract implements keyof readonly"
_RESERVED = {k: frozenset(v.split()) for k, v in RESERVED.items()}

_STRINGS = {
    "python": r"[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|#[^\n]*",
    "java": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "javascript": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/ ])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*",
    "go": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'",
    "rust": r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|b?r#\"[\s\S]*?\"#|b?r\"[^\"]*\"|b?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_STRINGS["c"] = _STRINGS["java"]
_BLANKED = {k: re.compile(v) for k, v in _STRINGS.items()}

_JS_MODIFIERS = r"(?:(?:public|private|protected|static|async|readonly|abstract|override|get|set)[ \t]+|\*[ \t]*)*"
_JS = (
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?P<type>class)[ \t]+(?P<c>[\w$]+)"
    r"|^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<f>[\w$]+)"
    r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<v>[\w$]+)[ \t]*(?::[^=\n]+)?=[ \t]*(?:async[ \t]*)?(?:function\b|\([^()]*\)[ \t]*(?::[^=\n]+)?=>|[\w$]+[ \t]*=>)"
    rf"|^[ \t]+{_JS_MODIFIERS}(?P<m>#?[\w$]+)[ \t]*(?:<[^<>\n]*>)?\((?:[^()]|\([^()]*\))*\)[ \t]*(?::[^{{;=\n]+)?\{{"
)
_HEADERS = {
    "python": r"^[ \t]*(?:(?P<type>class)[ \t]+(?P<c>\w+)|(?:async[ \t]+)?def[ \t]+(?P<f>\w+))",
    "java": r"^[ \t]*(?:@\w+(?:\([^()]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|sealed|non-sealed|strictfp)[ \t]+)*(?P<type>class|interface|enum|record|@interface)[ \t]+(?P<c>\w+)"
    r"|^[ \t]*(?:@\w+(?:\([^()]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^()\n]*>[ \t]+)?(?:[\w.]+(?:<[^()\n]*>)?(?:\[\])*[ \t]+)?(?P<m>\w+)[ \t]*\((?:[^()]|\([^()]*\))*\)[ \t\n]*(?:throws[ \t]+[\w., \t]+)?[ \t]*\{",
    "javascript": _JS,
    "typescript": _JS + r"|^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?P<type2>interface|enum)[ \t]+(?P<c2>[\w$]+)",
    "go": r"^func[ \t]+(?P<r>\([^()]*\)[ \t]*)?(?P<f>\w+)|^type[ \t]+(?P<c>\w+)[ \t]+(?:struct|interface)",
    "c": r"^[ \t]*(?:template[ \t]*<[^{};]*>\s*)?(?:typedef[ \t]+)?(?P<type>struct|class|enum|union)[ \t]+(?P<c>\w+)(?=[^;{}()]*\{)"
    r"|^[ \t]*(?:[A-Za-z_][\w:<>,]*(?:[ \t]+|[ \t]*[*&]+[ \t]*))*(?P<f>~?[A-Za-z_]\w*(?:::~?\w+)*)[ \t]*\((?:[^(){};]|\([^(){};]*\))*\)[ \t\n]*(?:(?:const|noexcept|override|final)[ \t\n]*)*(?=\{)",
    "rust": r"^[ \t]*(?:pub(?:\([^()]*\))?[ \t]+)?(?:(?:default|const|async|unsafe|extern(?:[ \t]+\S+)?)[ \t]+)*fn[ \t]+(?P<f>\w+)|^[ \t]*(?:pub(?:\([^()]*\))?[ \t]+)?(?P<type>struct|enum|trait)[ \t]+(?P<c>\w+)|^[ \t]*(?:unsafe[ \t]+)?(?P<type2>impl)\b[ \t]*(?:<[^{}\n]*?>[ \t]+)?(?:[\w:<>', ]+?[ \t]+for[ \t]+)?(?P<c2>\w+)",
}
_HEADER = {k: re.compile(v, re.M) for k, v in _HEADERS.items()}
_BRACE = re.compile(r"[{};]")


def blanked(text: str, language: str) -> str:
    """text with its literals and comments as blanks, line breaks kept."""
    return _BLANKED[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _braced_end(plain: str, at: int) -> int:
    """The place of the bracket that closes the first one from `at` on; of a header without a body its end."""
    depth = 0
    for m in _BRACE.finditer(plain, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(plain.rstrip()) - 1 if depth else at


def found_definitions(text: str, language: str) -> list[tuple[str, str, str | None, int, int]]:
    """(kind, name, owner, first line, last line), in order; kind is class, function or method."""
    plain = blanked(text, language)
    starts = [0, *[m.end() for m in re.finditer("\n", plain)]]
    lines = plain.split("\n") if language == "python" else []
    out: list[tuple[str, str, str | None, int, int]] = []
    open_types: list[tuple[int, str]] = []  # (last line, name)
    for m in _HEADER[language].finditer(plain):
        g = m.groupdict()
        kind = "class" if g.get("c") or g.get("c2") else "function"
        name = g.get("c") or g.get("c2") or g.get("f") or g.get("v") or g.get("m")
        name, _, within = name.rpartition("::")[::-1] if name else (name, "", "")
        if name in _RESERVED[language] or g.get("m") and m[0].lstrip().split("(")[0].split()[0] in ("return", "new", "else", "throw", "await"):
            continue
        head = m.start() + len(m[0]) - len(m[0].lstrip())
        first = bisect_right(starts, head)
        if language == "python":
            indent = len(lines[first - 1]) - len(lines[first - 1].lstrip())
            end, depth = first, 0
            for k in range(first, len(lines) + 1):
                x = lines[k - 1]
                if x.strip():
                    if k > first and depth <= 0 and len(x) - len(x.lstrip()) <= indent:
                        break
                    end = k
                    depth = max(0, depth + sum(map(x.count, "([{")) - sum(map(x.count, ")]}")))
            # a docstring at the end is blank by now, but belongs to the body
            raw = text.split("\n")
            while end < len(lines) and not lines[end].strip() and raw[end].strip() and len(raw[end]) - len(raw[end].lstrip()) > indent and not raw[end].lstrip().startswith("#"):
                end += 1
        elif g.get("m"):
            end = bisect_right(starts, _braced_end(plain, m.end() - 1))
        else:
            end = bisect_right(starts, _braced_end(plain, m.end()))
        while open_types and open_types[-1][0] < first:
            open_types.pop()
        owner = open_types[-1][1] if open_types else None
        if language == "go" and g.get("r"):
            owner = (re.findall(r"\w+", g["r"]) or [None])[-1]
        if within:
            owner = within
        if kind == "function" and owner:
            kind = "method"
        if kind == "class":
            open_types.append((end, name))
        out.append((kind, name, owner, first, end))
    return out


def _lead(lines: list[str], first: int) -> int:
    """The line at which the comments, attributes and decorators directly before a definition begin."""
    k = first - 1
    while k > 0 and (s := lines[k - 1].strip()) and s.startswith(("#", "@", "//", "/*", "*", "#[")):
        k -= 1
    return k + 1


_NODES = {"class": {"python": "class_definition", "go": "type_declaration", "rust": "impl_item"}, "function": {"python": "function_definition", "rust": "function_item"}, "method": {"python": "function_definition", "rust": "function_item", "go": "method_declaration", "java": "method_declaration"}}
_FALLBACK = {"class": "class_declaration", "function": "function_declaration", "method": "method_definition"}
_OUT = "path string, language string, kind string, node_type string, symbol_name string, owner string, start_line int, end_line int, content string"
HEADER_LINES, LEAF_LINES = 40, 150


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for path, text in zip(rows["path"], rows["text"]):
            language = LANGUAGES[path.rpartition(".")[2]]
            lines = text.split("\n")
            for kind, name, owner, first, last in found_definitions(text, language):
                cap = HEADER_LINES if kind == "class" else LEAF_LINES
                body = lines[_lead(lines, first) - 1 : min(last, first - 1 + cap)]
                content = "\n".join([*([f"# class: {owner}"] if owner and kind == "method" else []), *body])
                out.append((path, language, kind, _NODES[kind].get(language, _FALLBACK[kind]), name, owner, first, last, content))
        yield pd.DataFrame(out, columns=["path", "language", "kind", "node_type", "symbol_name", "owner", "start_line", "end_line", "content"])


def definitions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Definitions in files of Python, Java, JavaScript, TypeScript, Go, Rust and C or C++, with the comments in front and, of methods, their class.

    Result: path, language, kind, node_type, symbol_name, owner, start_line, end_line, content (at most 40 lines of a type, 150 of
    a function). Nested definitions come out, too. NULL and empty texts and other files give none.
    """
    known = F.regexp_extract(F.col(path), r"\.(\w+)$", 1).isin(list(LANGUAGES))
    return spread(files.filter(known & (F.length(text) > 0)).select(F.col(path).alias("path"), F.col(text).alias("text"))).mapInPandas(_run, _OUT)


def chunk_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Chunks of files by what fits their extension: definitions, sections of Markdown or underlined titles, else windows of lines.

    A file of a language with definitions in which none is found is cut into windows. Result: chunk_id, path, language, node_type,
    symbol_name, start_line, end_line, content; trivial chunks are left out, lists of imports are navigational.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text"))
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    cols = ["path", "language", "node_type", "symbol_name", "start_line", "end_line", "content"]
    none = F.lit(None).cast("string")
    defined = definitions(rows)
    marked = markdown_sections(rows.filter(extension.isin("md", "markdown", "mdx"))).select("path", F.lit("markdown").alias("language"), F.lit("section").alias("node_type"), none.alias("symbol_name"), "start_line", "end_line", "content")
    titled = underlined_sections(rows.filter(extension == "rst")).select("path", F.lit("rst").alias("language"), F.lit("section").alias("node_type"), none.alias("symbol_name"), "start_line", "end_line", "content")
    rest = rows.filter(~extension.isin("md", "markdown", "mdx", "rst")).join(defined.select("path").distinct(), "path", "left_anti")
    plain = window_chunks(rest).select("path", language_of(F.col("path")).alias("language"), F.lit("window").alias("node_type"), none.alias("symbol_name"), "start_line", "end_line", "content")
    out = postprocess(defined.select(cols).unionByName(marked).unionByName(titled).unionByName(plain))
    return out.select(chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("chunk_id"), *cols)


def language_of(path: Column) -> Column:
    """The language of a path's extension, else the extension."""
    extension = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[extension], F.nullif(extension, F.lit("")))


def supports_symbols(language: Column) -> Column:
    """Whether symbols are extracted from a language."""
    return F.coalesce(F.lower(language).isin(sorted(set(LANGUAGES.values()))), F.lit(False))


def is_reserved(name: Column, language: Column) -> Column:
    """Whether a name is a reserved word of its language."""
    words = F.create_map(*[x for k, v in RESERVED.items() for x in (F.lit(k), F.split(F.lit(v), " "))])
    return F.coalesce(F.array_contains(words[F.lower(language)], name), F.lit(False))


def containers(found: DataFrame) -> DataFrame:
    """(path, symbol_name, start_line, members): types of definitions() whose body holds other definitions, and how many."""
    t = found.filter("kind = 'class'").select("path", "symbol_name", "start_line", "end_line").distinct()
    inner = found.select("path", F.col("start_line").alias("_a"), F.col("symbol_name").alias("_n")).distinct()
    held = t.join(inner, "path").filter((F.col("_a") > F.col("start_line")) & (F.col("_a") <= F.col("end_line")))
    return held.groupBy("path", "symbol_name", "start_line").agg(F.countDistinct("_a", "_n").alias("members"))


def module_names(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, name): constants and variables that are given a value on a line without indent."""
    shape = r"(?m)^(?:(?:export\s+)?(?:public\s+|pub\s+|static\s+|final\s+)*(?:const|let|var|static)\s+(?:mut\s+)?)?([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?:?=(?!=)"
    names = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(1)))
    known = F.regexp_extract(F.col(path), r"\.(\w+)$", 1).isin(list(LANGUAGES))
    return files.filter(known & (F.length(text) > 0)).select(F.col(path).alias("path"), F.explode(names).alias("name"))


_CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*!?)\s*(?:::<[^<>()]*>)?\(")
_EDGES = "from_file string, from_symbol string, from_line int, to_symbol string, edge_type string"


def found_calls(text: str, language: str) -> list[tuple[str, int, str]]:
    """(caller, its first line, callee), each once: names followed by arguments inside of a definition, by the innermost one that is no nested class."""
    plain = blanked(text, language)
    starts = [0, *[m.end() for m in re.finditer("\n", plain)]]
    spans = [(first, last, name) for kind, name, _, first, last in found_definitions(text, language) if kind != "class"]
    heads = {(first, name) for first, _, name in spans}
    out: dict[tuple[str, int, str], None] = {}
    for m in _CALL.finditer(plain):
        callee = m[1].rstrip("!")
        line = bisect_right(starts, m.start())
        if callee in _RESERVED[language] or (line, callee) in heads:
            continue
        around = [s for s in spans if s[0] <= line <= s[1]]
        if around:
            first, _, name = max(around)
            out[name, first, callee] = None
    return list(out)


def _calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for path, text in zip(rows["path"], rows["text"]):
            out += [(path, caller, line, callee, "call") for caller, line, callee in found_calls(text, LANGUAGES[path.rpartition(".")[2]])]
        yield pd.DataFrame(out, columns=["from_file", "from_symbol", "from_line", "to_symbol", "edge_type"])


def calls(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(from_file, from_symbol, from_line, to_symbol, edge_type) of the calls inside of functions and methods, in files of all languages with definitions.

    from_line is where the calling function begins. Files that do not parse give what can be made out of them.
    """
    known = F.regexp_extract(F.col(path), r"\.(\w+)$", 1).isin(list(LANGUAGES))
    return spread(files.filter(known & (F.length(text) > 0)).select(F.col(path).alias("path"), F.col(text).alias("text"))).mapInPandas(_calls, _EDGES)
