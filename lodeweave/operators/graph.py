"""Symbol graph: building, locating, tracing, and importance of files and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators import quality as q
from lodeweave.plans.runtime import cut, small

# Ranks of the order of matches, sizes of spans, names no graph needs.
KIND_RANK = {"class": 0, "struct": 0, "interface": 0, "enum": 0, "trait": 0, "function": 0, "method": 0, "type": 1, "constant": 1, "impl": 2, "alias": 2}
LARGE_SPAN, SMALL_SPAN = 100, 10
BUILTINS = ["print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "isinstance", "super", "open", "sorted", "enumerate", "zip", "map", "filter", "sum", "min", "max", "any", "all", "append", "format", "println", "require", "panic", "make", "get", "put"]
DAMPING, ITERATIONS, CUT_EVERY = 0.85, 60, 10


def unique_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.dropDuplicates(["workspace", "name", "kind", "file_path", "start_line"])


def unique_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["workspace", "from_file", "from_symbol", "from_line", "to_symbol", "edge_type"])


def leaf(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]+)$", 1)


def is_test_path(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(F.lower(path), "/"), -1), r"\.[^.]*$", "")
    return stem.rlike(r"^(test[_\-]|tests?$)|(_test|\.test|\.spec|_spec)$") | F.arrays_overlap(q.directories(path), q.literals(["test", "tests", "testing", "__tests__"]))


def match_order(asked: str) -> list[Column]:
    """How well a symbol row answers a query for a name; the last keys make it total."""
    name = F.lower("name")
    place = F.when(name == asked.lower(), 0).when(name.startswith(asked.lower()), 1).otherwise(2)
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])[F.col("kind")], F.lit(1))
    private = F.element_at(F.split("file_path", "/"), -1).startswith("_")
    span = F.greatest(F.lit(0), F.coalesce(F.col("end_line"), F.lit(0)) - F.coalesce(F.col("start_line"), F.lit(0)))
    bucket = F.when(span >= LARGE_SPAN, 0).when(span >= SMALL_SPAN, 1).otherwise(2)
    return [place, rank, F.when(is_test_path(F.col("file_path")) | private, 1).otherwise(0), bucket, F.length("name"), F.col("file_path"), F.col("start_line"), F.col("symbol_id")]


def locate(symbols: DataFrame, workspace: str, name: str, limit: int = 10) -> DataFrame:
    """Symbols whose name holds the asked one (case does not matter, _ and % are wildcards): exact first, then short ones."""
    rows = unique_symbols(symbols).filter((F.col("workspace") == workspace) & F.col("name").ilike(f"%{name}%"))
    return rows.orderBy(F.when(F.col("name") == name, 0).otherwise(1), F.length("name"), "file_path", "start_line", "symbol_id").limit(limit)


def locate_cascade(symbols: DataFrame, workspace: str, name: str, limit: int = 10, caller_file: str | None = None, imported: DataFrame | None = None) -> DataFrame:
    """The best symbols for a name by the first strategy that finds any: exact, suffix, same directory, imports, substring, fuzzy.

    All strategies are one pass over the workspace's symbols: each row gets the number of the first strategy that takes
    it, and the rows of the least number stay. Result: the symbol's columns and strategy.
    """
    qualifier, short = "", name
    if "." in name or ":" in name:
        left, _, right = name.replace(":", ".").partition(".")
        if left[:1].isupper() and right:
            qualifier, short = left, right
    suffix = name.replace(":", ".").rpartition(".")[2]
    n = F.col("name")
    rows = unique_symbols(symbols).filter(F.col("workspace") == workspace)
    holds = n.ilike(f"%{short}%")
    directory = caller_file.rpartition("/")[0] + "/" if caller_file else None
    far = 1 if len(short) <= 4 else 2
    fuzzy = (F.abs(F.length(n) - len(short)) <= far) & (F.lower(F.substring(n, 1, 1)) == short[:1].lower()) & (F.levenshtein(F.lower(n), F.lit(short.lower())) <= far)
    step = F.when(n == short, 0)
    if not qualifier and suffix != name:
        step = step.when(n == suffix, 1)
    if directory:
        step = step.when(holds & F.col("file_path").startswith(directory), 2)
    if imported is not None:
        rows = rows.join(small(imported.select(F.col("to_file").alias("file_path"), F.lit(True).alias("_imp")).distinct()), "file_path", "left")
        step = step.when(holds & F.coalesce("_imp", F.lit(False)), 3)
    step = step.when(holds, 4).when(fuzzy, 5)
    rows = rows.withColumn("_step", step).filter("_step is not null")
    least = rows.agg(F.min("_step").alias("_least"))
    rows = rows.crossJoin(F.broadcast(least)).filter("_step = _least")
    distance = F.when(F.col("_step") == 5, F.levenshtein(F.lower(n), F.lit(short.lower()))).otherwise(0)
    names = ["exact", "suffix", "same_module", "import_chain", "substring", "fuzzy"]
    rows = rows.withColumn("strategy", F.element_at(q.literals(names), F.col("_step") + 1))
    return rows.orderBy(distance, *match_order(short)).limit(limit).select(*[c for c in symbols.columns], "strategy")


def nearest_names(symbols: DataFrame, workspace: str, token: str, limit: int = 3) -> DataFrame:
    """(name): names near a token that is none: one edit or two away, else names of six or more characters that it begins with."""
    rows = unique_symbols(symbols).filter((F.col("workspace") == workspace) & (F.col("name") != token)).select("name").distinct()
    t = F.lit(token.lower())
    near = F.levenshtein(F.lower("name"), t)
    far = 1 if len(token) <= 4 else 2
    prefix = (F.length("name") >= 6) & t.startswith(F.lower("name"))
    rows = rows.withColumn("_near", near <= far).filter(F.col("_near") | prefix)
    return rows.orderBy(F.desc("_near"), F.when(F.col("_near"), near).otherwise(-F.length("name")), "name").limit(limit).select("name")


def known_names(symbols: DataFrame, names: DataFrame, workspace: str) -> DataFrame:
    return names.select("name").distinct().join(symbols.filter(F.col("workspace") == workspace).select("name").distinct(), "name", "left_semi")


def touching(symbols: DataFrame, edges: DataFrame, workspace: str, path: str) -> DataFrame:
    """(name): names that a file defines or refers to."""
    mine = symbols.filter((F.col("workspace") == workspace) & (F.col("file_path") == path)).select("name")
    used = edges.filter((F.col("workspace") == workspace) & (F.col("from_file") == path)).select(F.col("to_symbol").alias("name"))
    return mine.union(used).filter("name is not null").distinct()


def callers(edges: DataFrame, workspace: str, name: str, limit: int = 10) -> DataFrame:
    """(from_symbol, from_file, sites): who calls a name, most sites first."""
    e = unique_edges(edges).filter((F.col("workspace") == workspace) & (F.col("to_symbol") == name))
    per = e.groupBy("from_symbol", "from_file").agg(F.countDistinct("from_line", "edge_type").alias("sites"))
    return per.orderBy(F.desc("sites"), "from_file", "from_symbol").limit(limit)


def callees(edges: DataFrame, symbols: DataFrame, workspace: str, name: str, limit: int = 10, builtins: bool = False) -> DataFrame:
    """(to_symbol, sites, defined): what a name calls; names of the repository first, builtins that it does not define hidden."""
    e = unique_edges(edges).filter((F.col("workspace") == workspace) & (F.col("from_symbol") == name) & (F.col("edge_type") != "use"))
    known = symbols.filter(F.col("workspace") == workspace).select(F.col("name").alias("to_symbol"), F.lit(True).alias("_d")).distinct()
    per = e.groupBy("to_symbol").agg(F.countDistinct("from_file", "from_line").alias("sites")).join(known, "to_symbol", "left")
    per = per.select("to_symbol", "sites", F.coalesce("_d", F.lit(False)).alias("defined"))
    if not builtins:
        per = per.filter(F.col("defined") | ~F.col("to_symbol").isin(BUILTINS))
    return per.orderBy(F.desc("defined"), F.desc("sites"), "to_symbol").limit(limit)


def trace(edges: DataFrame, symbols: DataFrame, workspace: str, name: str, limit: int = 10) -> DataFrame:
    """(direction, symbol, file_path, sites) of callers and callees of a name, or of its leaf if it is qualified."""
    short = name.replace(":", ".").rpartition(".")[2]
    a = callers(edges, workspace, short, limit).select(F.lit("caller").alias("direction"), F.col("from_symbol").alias("symbol"), F.col("from_file").alias("file_path"), "sites")
    b = callees(edges, symbols, workspace, short, limit).select(F.lit("callee").alias("direction"), F.col("to_symbol").alias("symbol"), F.lit(None).cast("string").alias("file_path"), "sites")
    return a.unionByName(b)


def definitions(symbols: DataFrame, workspace: str, name: str, limit: int = 5) -> DataFrame:
    """Definitions of exactly a name: outside of tests first, then the longest."""
    rows = unique_symbols(symbols).filter((F.col("workspace") == workspace) & (F.col("name") == name))
    return rows.orderBy(is_test_path(F.col("file_path")).cast("int"), F.desc(F.col("end_line") - F.col("start_line")), "file_path", "start_line", "symbol_id").limit(limit)


def in_degree(edges: DataFrame) -> DataFrame:
    """(workspace, to_symbol, callers): distinct callers of each name. Two counting steps, so that a frequent callee is no single task."""
    pairs = edges.groupBy("workspace", "to_symbol", "from_symbol").agg(F.lit(1).alias("_one"))
    return pairs.filter("from_symbol is not null").groupBy("workspace", "to_symbol").agg(F.count(F.lit(1)).alias("callers"))


def tied_counts(counts: DataFrame, workspace: str = "workspace", count: str = "callers") -> DataFrame:
    """Rows whose count another row of the workspace has too."""
    many = counts.groupBy(workspace, count).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return counts.join(many.drop("_n"), [workspace, count], "left_semi")


def ingest_traces(edges: DataFrame, events: DataFrame) -> DataFrame:
    """edges with observed (workspace, caller, callee, caller_file, caller_line) calls; those already there are not added twice."""
    new = events.select("workspace", F.coalesce("caller_file", F.lit("")).alias("from_file"), leaf(F.col("caller")).alias("from_symbol"), F.coalesce("caller_line", F.lit(0)).cast("int").alias("from_line"), leaf(F.col("callee")).alias("to_symbol"), F.lit("dynamic").alias("edge_type"))
    return unique_edges(edges.select(new.columns).unionByName(new))


def unresolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(workspace, to_symbol, sites): callees that no symbol of the workspace defines."""
    names = symbols.select("workspace", F.col("name").alias("to_symbol")).distinct()
    sites = unique_edges(edges).groupBy("workspace", "to_symbol").agg(F.count(F.lit(1)).alias("sites"))
    return sites.join(names, ["workspace", "to_symbol"], "left_anti")


def file_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(workspace, src, dst, weight): file to file, 1 / number of defining files for each distinct (file, callee)."""
    defs = symbols.select("workspace", F.col("name").alias("_leaf"), F.col("file_path").alias("dst")).distinct()
    spread = defs.groupBy("workspace", "_leaf").agg(F.count(F.lit(1)).alias("_n"))
    uses = unique_edges(edges).select("workspace", F.col("from_file").alias("src"), leaf(F.col("to_symbol")).alias("_leaf")).groupBy("workspace", "src", "_leaf").agg(F.count(F.lit(1)).alias("_c"))
    hits = uses.join(defs, ["workspace", "_leaf"]).join(spread, ["workspace", "_leaf"]).filter("src <> dst")
    return hits.groupBy("workspace", "src", "dst").agg(F.sum(F.col("_c") / F.col("_n")).alias("weight"))


def fan_in(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(workspace, file_path, fan_in): distinct calling files over names that exactly one file defines."""
    sole = symbols.groupBy("workspace", F.col("name").alias("_leaf")).agg(F.min("file_path").alias("file_path"), F.max("file_path").alias("_other")).filter("file_path = _other")
    uses = edges.select("workspace", F.col("from_file").alias("_src"), leaf(F.col("to_symbol")).alias("_leaf")).distinct()
    pairs = uses.join(sole, ["workspace", "_leaf"]).filter("_src <> file_path").select("workspace", "file_path", "_src").distinct()
    return pairs.groupBy("workspace", "file_path").agg(F.count(F.lit(1)).alias("fan_in"))


def name_frequency(files: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """(name, n, importance): whole-word uses of known names outside of import and export lines, ln(1+n) / ln(1+max)."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), lambda x: ~F.trim(x).rlike(r"^(import|from|export|use|pub use)\b"))
    words = files.select(F.explode(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_]\w*"), F.lit(0))).alias("name"))
    counts = words.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(names.select("name").distinct(), "name", "left_semi")
    most = counts.agg(F.max("n").alias("_most"))
    return counts.crossJoin(F.broadcast(most)).select("name", "n", (F.log1p(F.col("n")) / F.log1p(F.col("_most"))).alias("importance"))


def page_rank(edges: DataFrame, symbols: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(workspace, file_path, importance): PageRank of the files with symbols, divided by each workspace's greatest.

    Links are written once, partitioned by target; each round is one join and one sum, with the mass of files without
    links spread evenly. Lineage is cut every ten rounds in the shared checkpoint folder.
    """
    nodes = cut(symbols.select("workspace", "file_path").distinct())
    size = cut(nodes.groupBy("workspace").agg(F.count(F.lit(1)).alias("_size")))
    links = file_links(edges, symbols).join(nodes.withColumnRenamed("file_path", "src"), ["workspace", "src"], "left_semi")
    out = links.groupBy("workspace", "src").agg(F.sum("weight").alias("_out"))
    links = cut(links.join(out, ["workspace", "src"]).select("workspace", "src", "dst", (F.col("weight") / F.col("_out")).alias("share")))
    linked = links.select("workspace", F.col("src").alias("file_path")).distinct().withColumn("_linked", F.lit(True))
    ranks = nodes.join(size, "workspace").join(linked, ["workspace", "file_path"], "left")
    base = cut(ranks.select("workspace", "file_path", "_size", F.coalesce("_linked", F.lit(False)).alias("_linked")))
    ranks = base.withColumn("rank", 1 / F.col("_size"))
    whole = Window.partitionBy("workspace")
    for i in range(iterations):
        # each round refers to the ranks before it once, so that the plan grows by one join a round
        given = links.join(ranks.select("workspace", F.col("file_path").alias("src"), "rank"), ["workspace", "src"])
        given = given.groupBy("workspace", F.col("dst").alias("file_path")).agg(F.sum(F.col("share") * F.col("rank")).alias("_in"))
        ranks = base.join(given, ["workspace", "file_path"], "left").withColumn("_in", F.coalesce("_in", F.lit(0.0)))
        # what linked files give away is what arrives; the rest of the mass, 1 in all, is that of files without links
        ranks = ranks.withColumn("_loose", 1 - F.sum("_in").over(whole))
        new = (1 - damping) / F.col("_size") + damping * (F.col("_in") + F.col("_loose") / F.col("_size"))
        ranks = ranks.select("workspace", "file_path", "_size", "_linked", new.alias("rank"))
        if (i + 1) % CUT_EVERY == 0:
            ranks = cut(ranks)
    # the sum stays 1, so renormalising each round changes nothing but rounding
    most = ranks.groupBy("workspace").agg(F.max("rank").alias("_most"))
    return ranks.join(most, "workspace").select("workspace", "file_path", (F.col("rank") / F.col("_most")).alias("importance"))


def identifier_hints(symbols: DataFrame, workspace: str, tokens: list[str], most_tokens: int = 2, sites: int = 3) -> DataFrame:
    """(token, file_path, start_line): where the first tokens of a query that are names are defined."""
    spark = symbols.sparkSession
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "pos int, token string")
    hits = unique_symbols(symbols).filter(F.col("workspace") == workspace).join(F.broadcast(asked), F.col("name") == F.col("token"))
    rank = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("pos"))  # a handful of tokens
    site = F.row_number().over(Window.partitionBy("token").orderBy("file_path", "start_line", "symbol_id"))
    return hits.withColumn("_t", rank).withColumn("_s", site).filter((F.col("_t") <= most_tokens) & (F.col("_s") <= sites)).select("token", "file_path", "start_line")


def communities(links: DataFrame, rounds: int = 6, least: int = 2) -> DataFrame:
    """(workspace, file_path, community): label propagation over file links; groups under `least` files are left out.

    Ties go to the smallest label, so the result depends on the links alone.
    """
    both = links.select("workspace", F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(links.select("workspace", F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    both = cut(both.groupBy("workspace", "a", "b").agg(F.sum("weight").alias("weight")))
    labels = both.select("workspace", F.col("a").alias("file_path")).distinct().withColumn("community", F.col("file_path"))
    for i in range(rounds):
        votes = both.join(labels.select("workspace", F.col("file_path").alias("b"), "community"), ["workspace", "b"])
        votes = votes.groupBy("workspace", F.col("a").alias("file_path"), "community").agg(F.round(F.sum("weight"), 9).alias("_w"))
        # half of the files keep their label in each round: labels do not swap to and fro
        best = votes.groupBy("workspace", "file_path").agg(F.min_by("community", F.struct(-F.col("_w"), F.col("community"))).alias("_new"))
        turn = F.pmod(F.xxhash64("file_path") + i, F.lit(2)) == 0
        labels = labels.join(best, ["workspace", "file_path"], "left").select("workspace", "file_path", F.when(turn, F.coalesce("_new", "community")).otherwise(F.col("community")).alias("community"))
        labels = cut(labels)  # each round refers to the labels before it twice
    n = labels.groupBy("workspace", "community").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return labels.join(n.drop("_n"), ["workspace", "community"], "left_semi").select("workspace", "file_path", "community")


def enclosed(symbols: DataFrame) -> DataFrame:
    """(workspace, file_path, name, start_line, owner, depth): the innermost type around each symbol and how many symbols hold it.

    A join within files, so its size is bounded by the nesting of their symbols.
    """
    rows = unique_symbols(symbols).select("workspace", "file_path", "name", "kind", "start_line", F.coalesce("end_line", "start_line").alias("end_line"))
    around = rows.select("workspace", "file_path", F.col("name").alias("_n"), F.col("kind").alias("_k"), F.col("start_line").alias("_a"), F.col("end_line").alias("_z"))
    inside = (F.col("_a") < F.col("start_line")) & (F.col("start_line") <= F.col("_z"))
    pairs = rows.join(around, ["workspace", "file_path"]).filter(inside)
    types = [k for k, r in KIND_RANK.items() if k not in ("function", "method", "constant", "alias")]
    owner = F.max_by(F.when(F.col("_k").isin(types), F.col("_n")), F.when(F.col("_k").isin(types), F.struct("_a", "_n")))
    found = pairs.groupBy("workspace", "file_path", "name", "start_line").agg(owner.alias("owner"), F.countDistinct("_a", "_n").alias("depth"))
    return rows.select("workspace", "file_path", "name", "start_line").distinct().join(found, ["workspace", "file_path", "name", "start_line"], "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))


def qualifier_likeness(qualifier: str, owner: Column, path: Column) -> list[Column]:
    """How like an asked qualifier a symbol's type, then its path is: shares of the letters that need no edit; in descending order first."""
    like = lambda c: 1 - F.levenshtein(F.lower(F.coalesce(c, F.lit(""))), F.lit(qualifier.lower())) / F.greatest(F.length(F.coalesce(c, F.lit(""))), F.lit(max(1, len(qualifier))))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return [F.round(like(owner), 6), F.round(like(stem), 6)]


def locate_ranked(symbols: DataFrame, workspace: str, name: str, limit: int = 10) -> DataFrame:
    """(name, kind, file_path, start_line, owner, depth): symbols that hold an asked name, in the whole order: place of the name, kind,
    tests last, outer before inner, members of a type before others, size, length, path. Of Type.name the type's likeness goes first."""
    qualifier, _, short = name.replace(":", ".").rpartition(".")
    rows = unique_symbols(symbols).filter((F.col("workspace") == workspace) & F.col("name").ilike(f"%{short}%"))
    files = rows.select("workspace", "file_path").distinct()
    place = enclosed(symbols.filter(F.col("workspace") == workspace).join(files, ["workspace", "file_path"], "left_semi"))
    rows = rows.join(place, ["workspace", "file_path", "name", "start_line"])
    first, kind, test, span, length, path, line, symbol = match_order(short)
    likeness = [x.desc() for x in qualifier_likeness(qualifier, F.col("owner"), F.col("file_path"))] if qualifier else []
    order = [*likeness, first, kind, test, F.col("depth"), F.when(F.col("owner").isNotNull(), 0).otherwise(1), span, length, path, line, symbol]
    return rows.orderBy(*order).limit(limit).select("name", "kind", "file_path", "start_line", "owner", "depth")


def is_current(meta: DataFrame, stamp: Column) -> DataFrame:
    """(workspace, current): whether a graph of meta(workspace, stamp, complete) was built to its end by today's tools."""
    return meta.select("workspace", (F.col("complete") & (F.col("stamp") == stamp)).alias("current"))


def signature_hash(text: Column) -> Column:
    """16 digits of a snippet, that change when it does."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256), 1, 16)
