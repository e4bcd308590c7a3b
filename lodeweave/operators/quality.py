"""Chunk quality: predicates over content, path and symbol, and the score they combine to. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeweave.functions.text import base_name, code_tokens, directories

# Multipliers of the tiers.
TRIVIAL, NAVIGATIONAL, NAVIGATIONAL_NAMED, HEADING_ONLY, GENERATED = 0.15, 0.35, 0.75, 0.40, 0.45
CONFIG, TEST, DOC, SHORT, PRIVATE = 0.10, 0.46, 0.70, 0.80, 0.80
FRAMEWORK_FAN_IN = 60
DOC_LANGUAGES = ["markdown", "md", "html", "htm", "rst", "text", "txt", "mdx"]
TRIVIAL_DOC_LANGUAGES = ["html", "htm", "text", "txt"]
CONFIG_NAMES = ["claude.md", "agents.md", "gemini.md", "codex.md", ".cursorrules", ".mcp.json", "copilot-instructions.md"]
CONFIG_DIRS = [".cursor", ".vscode"]
GENERATED_NAMES = r"(_db\.h|_metadata\.h|\.pb\.(go|cc|h|py)|_pb2\.pyi?|\.min\.(js|css)|\.g\.dart)$|\.generated\."
GENERATED_DIRS = ["clinic", "generated", "__generated__", "gen", "node_modules"]
TEST_NAMES = r"^test_|(_test\.(py|go|c|h)|\.(test|spec)\.(ts|js))$|^test.*\.(java|kt)$|^_test.*\.(c|h)$"
TEST_DIRS = ["test", "tests", "__tests__", "spec", "testing"]
TYPE_NODES = ["class_definition", "class_declaration", "struct_item", "enum_item", "impl_item", "interface_declaration", "enum_declaration", "type_declaration", "type_alias_declaration", "trait_item"]
FUNCTION_NODES = ["function_definition", "function_declaration", "function_item", "method_definition", "method_declaration"]
SYMBOLLESS_NODES = ["window", "section", "navigational"]

_IMPORT = r"^(import\b|from\s+\S+\s+import\b|use\s|pub\s+use\s|#include\b|export\s+(\*|\{)|(const|let|var)\s+.*=\s*require\(|package\s)"
_LONE = r"^([)\]}>;,]+|pass|return|break|continue|\.\.\.|else:?|try:|end|[{(\[]+)$"
_DECLARED = r"^\s*(\w+)\s*(?::[^=]+)?\s*=\s*[A-Z]\w*\([^().]*\)[\s;]*$"


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def meaningful_lines(content: Column) -> Column:
    """Trimmed lines that are neither blank nor comments."""
    lines = F.transform(F.split(F.coalesce(content, F.lit("")), "\r?\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|//|/\*|\*|<!--|--|;;)"))


def is_config_file(path: Column) -> Column:
    return F.lower(base_name(path)).isin(CONFIG_NAMES) | F.arrays_overlap(F.split(path, "/"), literals(CONFIG_DIRS))


def is_generated_file(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(GENERATED_NAMES) | F.arrays_overlap(F.transform(F.split(path, "/"), lambda p: F.lower(p)), literals(GENERATED_DIRS))


def is_artifact_file(path: Column) -> Column:
    return F.exists(directories(path), lambda d: d.rlike(r"(\.egg-info|\.dist-info)$"))


def is_test_file(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(TEST_NAMES) | F.arrays_overlap(directories(path), literals(TEST_DIRS))


def is_test_chunk(content: Column, language: Column) -> Column:
    """Test code by its own head: a test attribute in Rust, a test block in Zig."""
    head = F.regexp_extract(content, r"(?s)^((?:\s*(?:#|//|/\*|\*|@)[^\n]*\n|\s*\n)*[^\n]*)", 1)
    rust = head.rlike(r"(?m)^\s*#\[\s*(test|tokio::test|cfg\(test\))\s*\]\s*$")
    zig = head.rlike(r'(?m)^\s*test\s*(".*?"\s*)?\{')
    return F.coalesce(F.when(F.lower(language) == "rust", rust).when(F.lower(language) == "zig", zig), F.lit(False))


def is_doc_language(language: Column) -> Column:
    return F.coalesce(F.lower(language).isin(DOC_LANGUAGES), F.lit(False))


def is_private_name(name: Column) -> Column:
    return F.coalesce(name.startswith("_") & ~name.startswith("__"), F.lit(False))


def is_definition(symbol: Column, node_type: Column) -> Column:
    return F.coalesce((symbol != "") & node_type.isin(TYPE_NODES + FUNCTION_NODES), F.lit(False))


def is_type_definition(node_type: Column) -> Column:
    return F.coalesce(node_type.isin(TYPE_NODES), F.lit(False))


def is_symbol_bearing(symbol: Column, node_type: Column) -> Column:
    return F.coalesce((symbol != "") & ~node_type.isin(SYMBOLLESS_NODES), F.lit(False))


def owner_class(content: Column) -> Column:
    """The class named by a chunk's class line; NULL without one."""
    return F.nullif(F.regexp_extract(content, r"(?m)^\s*# class: (\w+)\s*$", 1), F.lit(""))


def is_module_level_function(node_type: Column, content: Column) -> Column:
    return F.coalesce(node_type.isin(FUNCTION_NODES), F.lit(False)) & owner_class(content).isNull()


def is_navigational(content: Column) -> Column:
    """Two or more lines, all imports, re-exports, lone tokens or bare constructions."""
    lines = meaningful_lines(content)
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(_IMPORT) | x.rlike(_LONE) | x.rlike(_DECLARED))


def declared_names(content: Column) -> Column:
    """Names that a chunk declares by bare construction."""
    return F.transform(F.filter(meaningful_lines(content), lambda x: x.rlike(_DECLARED)), lambda x: F.regexp_extract(x, _DECLARED, 1))


def is_heading_only(content: Column) -> Column:
    body = meaningful_lines(content)
    return (F.size(body) == 0) | ((F.size(body) <= 2) & (F.length(F.array_join(body, " ")) < 40))


def is_trivial(content: Column, language: Column) -> Column:
    """No line of substance, a single token, import or declaration, a stub, or one or two lines of markup."""
    lines = meaningful_lines(content)
    filled = F.size(F.filter(F.split(F.coalesce(content, F.lit("")), "\r?\n"), lambda x: F.trim(x) != ""))
    first, second = F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(2))
    one = first.rlike(_LONE) | first.rlike(_IMPORT) | first.rlike(r"^(class|struct|enum|def|fn|func|type|interface)\b[^=]*[:;{]?$") | (F.length(first) <= 3)
    stub = first.rlike(r"^(async\s+)?(def|class)\b.*:$") & second.rlike(r"^(pass|\.\.\.|return(\s+None)?)$")
    attributes = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    plain = first.rlike(r"^class\s+\w+[^:]*:$") & F.size(attributes).between(2, 6) & F.forall(attributes, lambda x: x.rlike(r"^\w+\s*(:[^=]+)?=\s*[^(.]+$"))
    return (
        F.when(F.lower(language).isin(TRIVIAL_DOC_LANGUAGES) & (filled <= 2), True)
        .when(F.size(lines) == 0, filled <= 2)
        .when(F.size(lines) == 1, one)
        .when((F.size(lines) == 2) & stub, True)
        .otherwise(F.coalesce(plain, F.lit(False)))
    )


def quality_score(content: Column, path: Column, language: Column, node_type: Column, symbol: Column, fan_in: Column | None = None, query_tokens: list[str] | None = None) -> Column:
    """Between 0 and 1: exclusive tiers first, else the product of all demotions that hold."""
    fan_in = F.lit(0) if fan_in is None else F.coalesce(fan_in, F.lit(0))
    named = F.lit(False)
    if query_tokens:
        asked = literals(query_tokens)
        named = F.exists(declared_names(content), lambda n: (F.size(code_tokens(n)) > 0) & (F.size(F.array_except(code_tokens(n), asked)) == 0))
    test = (is_test_file(path) | is_test_chunk(content, language)) & (fan_in < FRAMEWORK_FAN_IN)
    factor = lambda holds, by: F.when(F.coalesce(holds, F.lit(False)), F.lit(by)).otherwise(F.lit(1.0))
    product = factor(is_generated_file(path), GENERATED) * factor(test, TEST) * factor(is_doc_language(language), DOC) * factor(is_private_name(symbol), PRIVATE) * factor(F.size(meaningful_lines(content)) <= 2, SHORT)
    return (
        F.when(F.coalesce(is_config_file(path), F.lit(False)), CONFIG)
        .when((node_type == "navigational") | is_navigational(content), F.when(named, NAVIGATIONAL_NAMED).otherwise(NAVIGATIONAL))
        .when(is_trivial(content, language) & ~is_definition(symbol, node_type), TRIVIAL)
        .when((language == "markdown") & is_heading_only(content), HEADING_ONLY)
        .otherwise(product)
    )


def demotion_reason(content: Column, path: Column, language: Column, node_type: Column, symbol: Column, fan_in: Column | None = None) -> Column:
    """The strongest demotion that quality_score applies, in words; NULL for none."""
    fan_in = F.lit(0) if fan_in is None else F.coalesce(fan_in, F.lit(0))
    return (
        F.when(F.coalesce(is_config_file(path), F.lit(False)), "config")
        .when((node_type == "navigational") | is_navigational(content), "navigational")
        .when(is_trivial(content, language) & ~is_definition(symbol, node_type), "trivial")
        .when((language == "markdown") & is_heading_only(content), "heading_only")
        .when(F.coalesce(is_generated_file(path), F.lit(False)), "generated")
        .when((is_test_file(path) | is_test_chunk(content, language)) & (fan_in < FRAMEWORK_FAN_IN), "test")
        .when(is_doc_language(language), "doc")
        .when(is_private_name(symbol), "private")
        .when(F.size(meaningful_lines(content)) <= 2, "short")
    )
