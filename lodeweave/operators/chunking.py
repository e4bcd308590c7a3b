"""Table-generating operators: windows, headings, definitions, symbols, routes, imports, request windows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators import quality as q
from lodeweave.plans.runtime import spread

# Sizes of windows and headers, in lines.
WINDOW, OVERLAP = 200, 50
SECTION_LINES, HEADER_LINES, LEAF_LINES = 150, 40, 150
ROUTES = r"^\s*@(?:[\w.]+\.)?(?:route|get|post|put|delete|patch|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"']([^\"']*)[\"']|^\s*(?:app|router)\.(?:get|post|put|delete|patch|use)\(\s*[\"'`]([^\"'`]*)[\"'`]"


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def chunk_id(path: Column, first: Column, last: Column) -> Column:
    return F.concat(path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))


def window_chunks(files: DataFrame, path: str = "path", text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(path, chunk_no, start_line, end_line, content): windows of `size` lines, each sharing `overlap` lines with the next.

    A text within one window gives one chunk; no window begins within the overlap of the last line. NULL or empty text gives none.
    """
    step = size - overlap
    rows = spread(files.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.col(text).alias("_t"))).select("path", lines_of(F.col("_t")).alias("_l"))
    n = F.size("_l")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step))
    rows = rows.select("path", "_l", F.posexplode(F.filter(starts, lambda s: (s == 0) | (s + overlap < n))).alias("chunk_no", "_s"))
    end = F.least(F.col("_s") + size, F.size("_l"))
    return rows.select("path", "chunk_no", (F.col("_s") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_l", F.col("_s") + 1, size), "\n").alias("content"))


def _sections(files: DataFrame, path: str, text: str, heading, two: bool = False) -> DataFrame:
    """Sections that begin at the lines where heading(line), or of two lines heading(line, next line), holds; lines are arrays, so nothing is shuffled."""
    rows = spread(files.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.col(text).alias("_t")))
    # each step is a column of its own, so that no text is split twice
    rows = rows.select("path", lines_of(F.col("_t")).alias("_l"))
    if two:
        rows = rows.withColumn("_after", F.concat(F.slice("_l", 2, F.size("_l")), F.array(F.lit(""))))
        rows = rows.withColumn("_head", F.zip_with("_l", "_after", lambda x, y: F.coalesce(heading(x, y), F.lit(False))))
    else:
        rows = rows.withColumn("_head", F.transform("_l", lambda x: F.coalesce(heading(x), F.lit(False))))
    rows = rows.withColumn("_at", F.array_compact(F.transform("_head", lambda f, i: F.when(f | (i == 0), i + 1))))
    ends = F.concat(F.transform(F.slice("_at", 2, F.size("_at")), lambda x: x - 1), F.array(F.size("_l")))
    rows = rows.withColumn("_z", F.arrays_zip(F.col("_at").alias("a"), ends.alias("z"))).select("path", "_l", F.posexplode("_z").alias("section_no", "_s"))
    rows = rows.select("path", "section_no", F.col("_s.a").alias("start_line"), F.col("_s.z").alias("end_line"), F.array_join(F.slice("_l", F.col("_s.a"), F.col("_s.z") - F.col("_s.a") + 1), "\n").alias("content"))
    return rows.filter(~F.col("content").rlike(r"^\s*$"))


def markdown_sections(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, section_no, start_line, end_line, content, heading): a section at each # heading, and what stands before the first."""
    out = _sections(files, path, text, lambda line: line.rlike(r"^#{1,6}\s"))
    return out.withColumn("heading", F.trim(F.regexp_extract("content", r"^#{1,6}\s+(.*)", 1)))


_RULER = r"^([=\-~^\"'`#*+:.])\1{2,}\s*$"


def underlined_sections(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Sections at titles whose next line is a ruler of one punctuation character at least as long; blocks of more than 150 lines are cut."""

    def heading(title: Column, below: Column) -> Column:
        return (F.trim(title) != "") & ~title.rlike(_RULER) & below.rlike(_RULER) & (F.length(F.rtrim(below)) >= F.length(F.rtrim(title)))

    out = _sections(files, path, text, heading, two=True)
    lines = lines_of(F.col("content"))
    out = out.select("path", "section_no", "start_line", lines.alias("_l"), F.explode(F.sequence(F.lit(1), F.size(lines), F.lit(SECTION_LINES))).alias("_p"))
    body = F.slice("_l", F.col("_p"), SECTION_LINES)
    return out.select("path", "section_no", (F.col("start_line") + F.col("_p") - 1).alias("start_line"), (F.col("start_line") + F.col("_p") + F.size(body) - 2).alias("end_line"), F.array_join(body, "\n").alias("content"))


_DEFS = "path string, node_type string, symbol_name string, owner string, start_line int, end_line int, content string, error string"


def _lead(lines: list[str], start: int) -> list[str]:
    i, out = start - 2, []
    while i >= 0 and (not lines[i].strip() or lines[i].lstrip().startswith(("#", "@"))):
        if lines[i].strip():
            out.append(lines[i])
        i -= 1
    return out[::-1]


def _definitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for path, text in zip(rows["path"], rows["text"]):
            lines = text.split("\n")
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError) as e:
                out.append((path, "error", None, None, 1, len(lines), None, type(e).__name__))
                continue
            stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
            while stack:
                node, owner = stack.pop()
                for child in ast.iter_child_nodes(node):
                    is_class = isinstance(child, ast.ClassDef)
                    if is_class or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        first = child.lineno
                        cap = HEADER_LINES if is_class else LEAF_LINES
                        body = lines[first - 1 : min(child.end_lineno, first - 1 + cap)]
                        head = _lead(lines, min([first, *[d.lineno for d in child.decorator_list]]))
                        decorators = lines[min([first, *[d.lineno for d in child.decorator_list]]) - 1 : first - 1]
                        content = "\n".join([*head, *decorators, *([f"# class: {owner}"] if owner else []), *body])
                        out.append((path, "class_definition" if is_class else "function_definition", child.name, owner, first, child.end_lineno, content, None))
                    stack.append((child, child.name if is_class else owner))
        yield pd.DataFrame(out, columns=["path", "node_type", "symbol_name", "owner", "start_line", "end_line", "content", "error"])


def python_definitions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Functions and classes of Python files with leading comments, decorators and a class line; one error row for a file that does not parse."""
    rows = files.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.col(text).alias("text"))
    out = rows.mapInPandas(_definitions, _DEFS)
    return out.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")))


def postprocess(chunks: DataFrame) -> DataFrame:
    """Chunks without trivial ones that define nothing; import lists and declaration manifests are retagged navigational."""
    kept = chunks.filter(~(q.is_trivial(F.col("content"), F.col("language")) & ~q.is_definition(F.col("symbol_name"), F.col("node_type"))))
    return kept.withColumn("node_type", F.when(q.is_navigational(F.col("content")), F.lit("navigational")).otherwise(F.col("node_type")))


_EDGES = "from_file string, from_symbol string, from_line int, to_symbol string, edge_type string"


def _calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for path, text in zip(rows["path"], rows["text"]):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                continue
            stack = [(tree, None, 0)]
            while stack:
                node, inside, line = stack.pop()
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    inside, line = node.name, node.lineno
                if isinstance(node, ast.Call) and inside:
                    name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
                    if name:
                        out.append((path, inside, line, name, "call"))
                stack += [(c, inside, line) for c in ast.iter_child_nodes(node)]
        yield pd.DataFrame(out, columns=["from_file", "from_symbol", "from_line", "to_symbol", "edge_type"])


def python_calls(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Call edges of Python files, one for each (file, caller, callee)."""
    rows = files.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.col(text).alias("text"))
    return rows.mapInPandas(_calls, _EDGES).dropDuplicates(["from_file", "from_symbol", "to_symbol"])


def routes(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, route) of HTTP routes declared by decorators, annotations or router calls."""
    rows = files.filter(F.length(text) > 0).select(F.col(path).alias("path"), F.posexplode(lines_of(F.col(text))).alias("_i", "_l")).filter(F.col("_l").rlike(ROUTES))
    found = F.concat(F.regexp_extract("_l", ROUTES, 1), F.regexp_extract("_l", ROUTES, 2))
    return rows.select("path", (F.col("_i") + 1).alias("line"), found.alias("route"))


def imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, module) of Python import lines, without repeats."""
    rows = files.filter(F.length(text) > 0)
    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import\b"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1)))
    return rows.select(F.col(path).alias("path"), F.explode(F.array_distinct(found)).alias("module"))


def import_graph(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(from_file, to_file): imports resolved to files by their longest dotted suffix."""
    stem = F.regexp_replace(F.regexp_replace(F.col(path), r"(/__init__)?\.py$", ""), "/", ".")
    parts = F.split(stem, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = files.filter(F.col(path).endswith(".py")).select(F.col(path).alias("to_file"), F.explode(tails).alias("name"))
    wanted = imports(files, path, text)
    ways = F.split("module", r"\.")
    wanted = wanted.select(F.col("path").alias("from_file"), "module", F.explode(F.transform(F.sequence(F.size(ways), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(ways, 1, i), "."))).alias("name"))
    hits = wanted.join(known, "name").filter("from_file <> to_file")
    best = Window.partitionBy("from_file", "module").orderBy(F.desc(F.length("name")), "to_file")
    return hits.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("from_file", "to_file").distinct()


def purpose_text(chunks: DataFrame) -> DataFrame:
    """(chunk_id, purpose): qualified name, signature and first doc line of symbol-bearing chunks; the text of the second space."""
    body = q.meaningful_lines(F.col("content"))
    signature = F.try_element_at(F.filter(body, lambda x: x.contains("(") | x.rlike(r"^(class|struct|enum|interface|type|impl|trait)\b")), F.lit(1))
    doc = F.regexp_extract("content", r'(?s)(?:"""|\'\'\'|/\*\*|///)\s*\**\s*([^\n"*]*)', 1)
    owner = q.owner_class(F.col("content"))
    name = F.concat_ws(".", owner, F.col("symbol_name"))
    text = F.trim(F.concat_ws(" ", name, F.coalesce(signature, F.lit("")), F.trim(doc)))
    return chunks.filter(q.is_symbol_bearing(F.col("symbol_name"), F.col("node_type"))).select("chunk_id", text.alias("purpose"))


def snippet(text: Column, start_line: Column, lines: int = 12) -> Column:
    return F.array_join(F.slice(lines_of(text), start_line, lines), "\n")


def request_window(messages: DataFrame, key: str, turn: str, text: str, most: int = 20, chars: int = 2000) -> DataFrame:
    """(key, window, files): the last `chars` characters of the last `most` messages, and the file paths named in them."""
    w = Window.partitionBy(key).orderBy(F.desc(turn))
    last = messages.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    both = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce(text, F.lit("")).alias("x")))).alias("_m"))
    joined = F.array_join(F.transform("_m", lambda m: m["x"]), "\n")
    window = F.substring(joined, -chars, chars)
    files = F.array_sort(F.array_distinct(F.regexp_extract_all(window, F.lit(r"(?:[\w.\-]+/)+[\w.\-]+\.\w{1,6}"), F.lit(0))))
    return both.select(key, F.when(F.length(joined) <= chars, joined).otherwise(window).alias("window"), files.alias("files"))
