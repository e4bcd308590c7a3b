"""Core operators on small fixtures: against plain Python, edge cases, stream against batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import commands, text, vectors
from lodeweave.operators import catalog, chunking, episodes, graph, memory, quality, search, triggers
from lodeweave.plans.ordered import number_within
from lodeweave.sources import files as sources
from lodeweave.streaming import sessions


def test_tokens(spark):
    rows = ["RateLimitMiddleware", "send_signal_dispatch a send", "", None, "éa9b-x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.code_tokens(F.col("t"))).collect()]
    assert got == [["rate", "limit", "middleware"], ["send", "signal", "dispatch", "send"], [], None, ["a9b"]]
    assert text.query_tokens_py("fooBar foo_bar") == ["foo", "bar"]


def test_globs_and_trim(spark):
    import fnmatch
    import re

    for glob in ("src/*.py", "*", "a?c[0-9]", "x[!a]y", "(a).b"):
        for s in ("src/a/b.py", "abc1", "xby", "(a).b", "src.py"):
            assert bool(re.match(text.glob_regex(glob), s)) == fnmatch.fnmatch(s, glob)
    t = spark.createDataFrame([("One sentence. " * 40,), ("x" * 500,), ("short",)], "t string").select(text.trim_to_cap(F.col("t"), 20)).collect()
    assert t[0][0].endswith(".…") and len(t[0][0]) <= 80 and len(t[1][0]) == 80 and t[2][0] == "short"


def test_number_within_any_skew(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(400)]
    got = number_within(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], value="v").collect()
    for key in ("hot", "a", "b", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.i)
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        total = 0
        for r in mine:
            total += r.v
            assert r.running == total


def test_bm25_matches_the_formula(spark):
    import math

    docs = {1: "retry the token bucket", 2: "token token token", 3: "nothing here at all", 4: "", 5: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.bm25 for r in search.bm25(df, "token bucket unknownword", normalise=False).collect()}
    toks = {k: text.code_tokens_py(v) for k, v in docs.items() if v is not None}
    avg = sum(map(len, toks.values())) / len(toks)
    for k, ws in toks.items():
        s = 0.0
        for q in ("token", "bucket"):
            df_ = sum(q in w for w in toks.values())
            tf = ws.count(q)
            s += math.log((len(toks) + 1) / df_) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(ws) / avg) + tf))
        assert got[k] == pytest.approx(s)
    assert search.bm25(df.limit(0), "token").count() == 0


def test_embedding_and_search(spark):
    df = spark.createDataFrame([("parse the config file",), ("",), (None,)], "t string").select(vectors.embed(F.col("t")).alias("v"))
    assert [round(r[0], 9) for r in df.select(vectors.norm(F.col("v"))).collect()] == [1.0, 0.0, 0.0]
    rows = [(f"/a.py:{i}-{i}", "/w", "/a.py", "python", "function_definition", f"f{i}", i, i, f"def f{i}(rate, limit):\n    bucket = rate * {i}\n    return bucket") for i in range(5)]
    rows += [("/b.md:1-3", "/w", "/b.md", "markdown", "section", None, 1, 3, "# Bucket\n\nrate limit bucket rate limit bucket words of prose"), ("/c:1-1", "/w", "/c", None, None, None, 1, 1, None), rows[0]]
    c = spark.createDataFrame(rows, "chunk_id string, workspace string, file_path string, language string, node_type string, symbol_name string, start_line int, end_line int, content string")
    got = search.search(c, "rate limit bucket", k=3).orderBy("place").collect()
    assert [r.place for r in got] == [1, 2, 3][: len(got)] and got and not got[0].low_confidence
    assert search.search(c, "zzqqy rate", k=1).collect()[0].low_confidence
    assert search.search(c.limit(0), "rate").count() == 0


def test_quality(spark):
    rows = [("import os\nimport re", "/a/x.py", "python", "window", None, 0.35), ("pass", "/a/x.py", "python", "window", None, 0.15), ("def _f(a):\n    b = 1\n    c = 2\n    return b", "/a/tests/x.py", "python", "function_definition", "_f", 0.46 * 0.8), ("x", "/a/.vscode/x.py", "python", "window", None, 0.10), ("# T\n\nab cd ef", "/a/x.md", "markdown", "section", None, 0.40)]
    df = spark.createDataFrame(rows, "c string, p string, l string, n string, s string, want double")
    for r in df.select("want", quality.quality_score(*[F.col(x) for x in "cplns"]).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_chunkers(spark):
    for n, want in ((0, []), (1, [(1, 1)]), (200, [(1, 200)]), (201, [(1, 200), (151, 201)]), (351, [(1, 200), (151, 350), (301, 351)])):
        df = spark.createDataFrame([("p", "\n".join(map(str, range(n))) if n else "")], "path string, text string")
        assert [(r.start_line, r.end_line) for r in chunking.window_chunks(df).orderBy("chunk_no").collect()] == want
    df = spark.createDataFrame([("p", "intro\n# A\nx\n## B\ny"), ("q", None), ("r", "Title\n=====\ntext\n\nNext\n-----\nmore")], "path string, text string")
    assert [(r.start_line, r.end_line, r.heading) for r in chunking.markdown_sections(df.filter("path = 'p'")).orderBy("section_no").collect()] == [(1, 1, ""), (2, 3, "A"), (4, 5, "B")]
    assert [(r.start_line, r.end_line) for r in chunking.underlined_sections(df.filter("path = 'r'")).orderBy("section_no").collect()] == [(1, 4), (5, 7)]
    py = spark.createDataFrame([("a.py", "# lead\n@d\nclass C:\n    def m(self):\n        return g(1)\n"), ("b.py", "def (")], "path string, text string")
    got = {(r.symbol_name, r.owner, r.error) for r in chunking.python_definitions(py).collect()}
    assert got == {("C", None, None), ("m", "C", None), (None, None, "SyntaxError")}
    assert [(r.from_symbol, r.to_symbol) for r in chunking.python_calls(py).collect()] == [("m", "g")]


def test_graph(spark):
    sym = [(1, "w", "alpha", "function", "/w/a.py", 1, 50), (2, "w", "beta", "function", "/w/b.py", 1, 5), (3, "w", "alphabet", "class", "/w/tests/c.py", 1, 5), (4, "w", "gamma", "function", "/w/c.py", 1, 5), (1, "w", "alpha", "function", "/w/a.py", 1, 50)]
    s = spark.createDataFrame(sym, "symbol_id long, workspace string, name string, kind string, file_path string, start_line int, end_line int")
    edge = [("w", "/w/b.py", "beta", 1, "alpha", "call"), ("w", "/w/c.py", "gamma", 1, "alpha", "call"), ("w", "/w/a.py", "alpha", 1, "beta", "call"), ("w", "/w/a.py", "alpha", 1, "print", "call"), ("w", "/w/b.py", "beta", 1, "alpha", "call")]
    e = spark.createDataFrame(edge, "workspace string, from_file string, from_symbol string, from_line int, to_symbol string, edge_type string")
    names = lambda q: [(r.name, r.strategy) for r in graph.locate_cascade(s, "w", q).collect()]
    assert names("alpha") == [("alpha", "exact")] and names("x.beta") == [("beta", "suffix")] and names("lph") == [("alpha", "substring"), ("alphabet", "substring")] and names("gamna") == [("gamma", "fuzzy")] and names("zzz") == []
    assert [r.from_symbol for r in graph.callers(e, "w", "alpha").collect()] == ["beta", "gamma"]
    assert [r.to_symbol for r in graph.callees(e, s, "w", "alpha").collect()] == ["beta"]
    assert {r.to_symbol for r in graph.unresolved(e, s).collect()} == {"print"}
    assert {(r.file_path, r.fan_in) for r in graph.fan_in(e, s).collect()} == {("/w/a.py", 2), ("/w/b.py", 1)}
    got = {r.file_path: r.importance for r in graph.page_rank(e, s, iterations=20).collect()}
    files = ["/w/a.py", "/w/b.py", "/w/tests/c.py", "/w/c.py"]
    links = {"/w/a.py": ["/w/b.py"], "/w/b.py": ["/w/a.py"], "/w/c.py": ["/w/a.py"]}
    rank = dict.fromkeys(files, 0.25)
    for _ in range(20):
        loose = sum(rank[f] for f in files if f not in links)
        new = {f: 0.15 / 4 + 0.85 * loose / 4 for f in files}
        for f, to in links.items():
            for t in to:
                new[t] += 0.85 * rank[f] / len(to)
        rank = new
    for f in files:
        assert got[f] == pytest.approx(rank[f] / max(rank.values()), abs=1e-9)


NOTE = "note_id long, workspace string, content string, title string, tags array<string>, priority string, kind string, created_at double, last_accessed double, last_fired double, decay_score double, author_id string, author_trust_score double, valid_until double, provenance string, scope string, branch string, session_id string, pinned boolean, supersedes long, superseded_by_note_id long, anchors array<struct<path:string,hash:string>>, triggers array<struct<path:string,event:string,symbol:string,semantic:boolean,command:string,not_before:double,expires_visibility:double,cooldown:double>>"


def note(i, kind="finding", content="text of a note", created=1000.0, **k):
    base = dict(note_id=i, workspace="w", content=content, title=f"t{i}", tags=[], priority="medium", kind=kind, created_at=created, last_accessed=created, last_fired=None, decay_score=1.0, author_id="a", author_trust_score=1.0, valid_until=None, provenance="agent", scope="workspace", branch="main", session_id=None, pinned=False, supersedes=None, superseded_by_note_id=None, anchors=[], triggers=[])
    return tuple({**base, **k}.values())


def test_memory(spark):
    n = spark.createDataFrame([note(1, pinned=True), note(2, created=2000.0), note(3, "task", created=500.0, priority="high", author_trust_score=0.1), note(4, valid_until=5.0), note(5, content=None), note(2, created=2000.0)], NOTE)
    ev = spark.createDataFrame([(1, 5, "created", None, "a", None, 1.0), (2, 5, "expired", None, "a", None, 2.0), (3, 1, "revoked", "r", "a", None, 1.0), (4, 1, "reinstated", None, "a", None, 0.5), (5, 1, "recalled", None, "a", None, 9.0)], "id long, note_id long, event string, reason string, actor string, payload string, ts double")
    assert {(r.note_id, r.state) for r in memory.fold_states(ev).collect()} == {(5, "expired"), (1, "active")}
    ids = lambda df: [r.note_id for r in df.collect()]
    assert ids(memory.recall(n, ev, "w", 3000.0)) == [2, 1, 3] or ids(memory.recall(n, ev, "w", 3000.0))[0] == 2
    assert ids(memory.recall(n, ev, "w", 3000.0, sort_by="chronological")) == [3, 1, 2]
    assert ids(memory.recall_with_floor(n, ev, "w", 3000.0, limit=2, sort_by="recency").orderBy("place")) == [1, 2]
    assert [memory.floor_cap(x) for x in (1, 5, 10, 20, 100)] == [1, 1, 2, 4, 5]
    d = {r.note_id: r.decay_score for r in memory.decay(n, 1000.0 + 30 * 86400).collect()}
    assert d[1] == pytest.approx(0.5) and memory.decay(n, 0.0).filter("decay_score <> 1").count() == 0
    day = 86400.0
    at = lambda now: ids(memory.expirations(n, ev, now))
    assert 1 not in at(1000.0 + 120 * day) and 1 in at(1000.0 + 120 * day + 1) and 5 not in at(1e12)
    new = spark.createDataFrame([note(9, created=4000.0, supersedes=2)], NOTE)
    after = {r.note_id: (r.valid_until, r.superseded_by_note_id) for r in memory.remember(n, new).collect()}
    assert after[2] == (4000.0, 9) and after[9] == (None, None) and len(after) == 6
    back = {r.note_id: r.content for r in memory.parse_markdown(memory.export_markdown(n, ev, "w")).collect()}
    assert back == {1: "text of a note", 2: "text of a note", 3: "text of a note"}
    assert memory.restore_snapshot(memory.snapshot(n, ev, "w", "l", 1.0)).count() == 3
    assert memory.recall(n.limit(0), ev.limit(0), "w", 1.0).count() == 0


def test_triggers_pack_gate(spark):
    t = lambda **k: {**dict.fromkeys(["path", "event", "symbol", "semantic", "command", "not_before", "expires_visibility", "cooldown"]), **k}
    n = spark.createDataFrame([note(1, "directive"), note(2, "task"), note(3, "gotcha", anchors=[("src/a.py", "h")]), note(4, triggers=[t(path="src/*", event="pre-edit", not_before=99.0)]), note(5, triggers=[t(semantic=False)]), note(6, triggers=[t(command="git*")], scope="branch", branch="dev")], NOTE)
    ev = spark.createDataFrame([], "id long, note_id long, event string, reason string, actor string, payload string, ts double")
    m = spark.createDataFrame([(1, "w", "session-start", None, None, None, "main", 50.0), (2, "w", "pre-edit", "w/src/a.py", None, None, "main", 50.0), (3, "w", "pre-edit", "src/b.py", None, None, "main", 100.0), (4, "w", "pre-command", None, "git push", None, "dev", 1.0)], "moment_id long, workspace string, event string, file_path string, command_verb string, session_id string, branch string, ts double")
    assert {(r.moment_id, r.note_id) for r in triggers.fire(n, ev, m).collect()} == {(1, 1), (2, 3), (3, 4), (4, 6)}
    items = n.withColumn("full_text", F.lit("word " * 60)).withColumn("index_text", F.lit("x" * 40))
    got = triggers.pack(items, "workspace", 100).orderBy("place").collect()
    assert sum(r.tokens for r in got) <= 100 and got[0].note_id == 1 and got[0].tier == "full" and [r.place for r in got] == list(range(1, len(got) + 1))
    c = spark.createDataFrame([("s", "a", 0.9, 0, "line", True, "mention"), ("s", "a", 0.8, 0, "other", True, "anchor"), ("s", "b", 0.7, 0, "l", True, "mention"), ("s", "c", 0.6, 0, "l" * 900, True, "anchor"), ("s", "d", 0.5, 0, "l", True, "anchor"), ("s", "e", 0.2, 0, "l", True, "anchor")], "session_id string, anchor_id string, score double, provenance_rank int, line string, is_structural boolean, tier string")
    assert [r.anchor_id for r in triggers.gate(c).collect()] == ["a"]


EPISODE = "id long, workspace string, session_id string, ts double, cwd string, tool string, cmd_raw string, rc int, is_error boolean, interrupted boolean, stdout string, stderr string, env_delta_names array<string>, file_path string"


def episode(i, ts, cmd, rc, session="s", tool="bash", **k):
    base = dict(id=i, workspace="w", session_id=session, ts=ts, cwd="/r", tool=tool, cmd_raw=cmd, rc=rc, is_error=False, interrupted=False, stdout=None, stderr=None, env_delta_names=[], file_path=None)
    return tuple({**base, **k}.values())


EPISODES = [
    episode(1, 1.0, "pip install reqests", 1), episode(2, 2.0, "pip install requests", 0),
    episode(3, 3.0, "make all", 2), episode(4, 4.0, "make all", 0),
    episode(5, 5.0, "pytest tests -q", 1), episode(6, 6.0, None, None, tool="edit", file_path="a.py"), episode(7, 7.0, "pytest tests -q", 0),
    episode(8, 8.0, "npm test", 1), episode(9, 900.0, "npm test", 0), episode(10, None, "ls", None), episode(11, 1.0, "cd /x && make z.txt", 1, "t"), episode(12, 2.0, "cd /x && make -k z.txt", 0, "t"), episode(13, 3.0, "x", 0, None),
]


def test_commands_and_arcs(spark):
    n = commands.normal_form("cd a && FOO=1 timeout 5 git commit -m 'x y' src/a.py 2>&1 | tail -3")
    assert (n["verb"], n["flags"], n["args"], n["env_names"], n["cd_target"]) == ("git commit", ["-m"], ["x y", "src/a.py"], ["FOO"], "a")
    assert commands.normal_form('echo "unbalanced')["verb"] and commands.normal_form(None)["verb"] == ""
    assert commands.similarity(commands.normal_form("pip install a -q"), commands.normal_form("pip install a -q")) == 1.0
    e = spark.createDataFrame(EPISODES + EPISODES[:3], EPISODE)
    got = {(tuple(r.failure_ids), r.success_id, tuple(r.changed)) for r in episodes.arcs(e).collect()}
    assert got == {((1,), 2, ("verb",)), ((5,), 7, ("files",)), ((11,), 12, ("flag",))}
    d = {r.id: r.outcome for r in episodes.derived(spark.createDataFrame([episode(1, 1.0, "t", 0, stdout="3 failed, 2 passed"), episode(2, 1.0, "t", None, stdout="5 passed"), episode(3, 1.0, "t", 137), episode(4, 1.0, "t", None), episode(5, 1.0, "t", 1, stderr="x\nerror[E1]: y")], EPISODE)).collect()}
    assert d == {1: "soft_failure", 2: "success", 3: "interrupted", 4: "unknown", 5: "failure"}
    t = spark.createDataFrame([("a\na\na\nb",), ("",), (None,), ("\n".join(map(str, range(100))),)], "t string").select(episodes.digest(F.col("t"), 100, 3, 2)).collect()
    assert t[0][0] == "a [x3]\nb" and t[1][0] == "" and t[2][0] == "" and "[elided 95 lines" in t[3][0]


@pytest.mark.parametrize(
    "line, verb, args, env, target",
    [
        ("cd a && cd b && make x.c", "make", ["x.c"], [], "b"),
        ("cd a ; cd && ls", "ls", [], [], None),
        ("cd -L a && ls", "ls", [], [], None),
        ("make clean && npm run build all", "npm run build", ["all"], [], None),
        ("A=1 env B=/x nice -n 5 nohup stdbuf -oL -eL python run.py", "python", ["run.py"], ["A", "B"], None),
        ("timeout A=1 ls", "ls", [], [], None),
        ("cat a.csv | python t.py | head -3 | cat", "cat", ["a.csv", "python", "t.py"], [], None),
        ("A=1", "", [], ["A"], None),
        ("2>&1 | sort", "", ["sort"], [], None),
        ("cd a", "", [], [], "a"),
        ("ls ; ;", "ls", [], [], None),
        (None, "", [], [], None),
    ],
)
def test_normal_forms(line, verb, args, env, target):
    n = commands.normal_form(line)
    assert (n["verb"], n["args"], n["env_names"], n["cd_target"]) == (verb, args, env, target)


def test_argument_classes_agree_in_python_and_spark(spark):
    words = ["a", "a/b", "..", "~x", "3", "-3.5", "v1", "1.2.3", "x.py", "*.c", "", "123e4567-e89b-12d3-a456-426614174000", "a b"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", commands.argument_class_column(F.col("w")).alias("c")).collect()
    assert {r.w: r.c for r in got} == {w: commands.argument_class(w) for w in words}


def _drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    e = spark.createDataFrame(EPISODES, EPISODE)
    rows = episodes.derived(e).orderBy("ts", "id")
    folder = str(tmp_path / "in")
    for lo in (0, 5, 9):  # three files, one after another
        rows.filter(F.col("id").between(lo + 1, {0: 5, 5: 9, 9: 99}[lo])).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(tuple(r.failure_ids), r.success_id) for r in _drain(spark, sessions.stream_arcs(stream), "arcs_out").collect()}
    assert got == {(tuple(r.failure_ids), r.success_id) for r in episodes.arcs(e).collect()}
    chunks = spark.readStream.schema("language string, sign int").parquet(_write(spark, tmp_path / "d", [("go", 1), ("go", 1), ("go", -1), ("rs", 1)], "language string, sign int"))
    assert {(r.language, r.chunks) for r in _drain(spark, sessions.running_language_stats(chunks), "langs", "complete").collect()} == {("go", 1), ("rs", 1)}
    changes = spark.createDataFrame([("a", 1.0, "mod"), ("a", 2.0, "del"), ("a", 9.0, "add"), ("b", 1.0, "mod")], "path string, ts double, action string")
    assert {(r.path, r.started, r.changes, r.action) for r in sessions.debounced(changes).collect()} == {("a", 1, 2, "del"), ("a", 9, 1, "add"), ("b", 1, 1, "mod")}


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def test_sources(spark, tmp_path):
    (tmp_path / "w" / "src").mkdir(parents=True)
    (tmp_path / "w" / "node_modules").mkdir()
    (tmp_path / "w" / "src" / "a.py").write_bytes("\ufeffx = 1\r\n".encode() + b"\xff")
    (tmp_path / "w" / "src" / "b.bin").write_bytes(b"0")
    (tmp_path / "w" / "node_modules" / "c.js").write_bytes(b"0")
    got = sources.as_text(sources.read_tree(spark, str(tmp_path / "w"))).collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["a.py"] and got[0].text == "x = 1\n\ufffd"
    folder = str(tmp_path / "m")
    assert sources.read_manifest(spark, folder, 1).count() == 0
    seen = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, mtime double")
    sources.write_manifest(seen, folder, 1)
    assert sources.read_manifest(spark, folder, 1).count() == 2 and sources.read_manifest(spark, folder, 2).count() == 0
    now = spark.createDataFrame([("a", 1.5), ("c", 1.0)], "path string, mtime double")
    assert {(r.path, r.change) for r in catalog.manifest_diff(now, sources.read_manifest(spark, folder, 1)).collect()} == {("a", "modified"), ("b", "removed"), ("c", "added")}
    assert sources.ignore_rules(["# c", "", "dist/", "*.log", "re:^x", "re:("]) == {"dirs": ["dist"], "globs": ["*.log"], "regexes": ["^x"]}


def test_entry_without_optional_parts():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "search_bm25_topk" in entry.queries()


def test_binding_and_providers(spark):
    from lodeweave import providers
    from lodeweave.functions import binding

    assert binding.common_span("we  must keep the order", "please keep the\norder now") == "keep the order"
    df = spark.createDataFrame([("keep the order of all the rows as they were", "do keep the order of all the rows as"), ("a", None), (None, "b")], "a string, b string")
    assert [r[0] for r in df.select(binding.auto_quote(F.col("a"), F.col("b"))).collect()] == ["keep the order of all the rows as", None, None]
    key = lambda *kv: binding.canonical_key(F.lit("k"), F.create_map(*map(F.lit, kv)), F.lit(1))
    r = spark.range(1).select(key("a", "1", "b", "2").alias("x"), key("b", "2", "a", "1").alias("y"), key("a", "1", "b", "3").alias("z")).head()
    assert r.x == r.y != r.z
    now = [0.0]
    cache = providers.ResultCache(2, 10, lambda: now[0])
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 11.0
    assert cache.get("c") is None and (cache.hits, cache.misses) == (1, 2)
    assert providers.embedder() and providers.choose_model(None, "go", {"go": "m"}) == "m"
    with pytest.raises(ValueError):
        providers.embedder("none")


def test_code_questions_reads_whole_texts(spark, tmp_path):
    from lodeweave import queries

    rows = [(1, "hello\nwhere is parse_file() defined"), (2, "parse_file()\nexplain why, thanks, in general"), (3, "explain"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.needs_tool, r.confidence) for r in queries.queries()["code_questions"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, 0.5), 2: (False, 0.6), 3: (False, 1.0)}


def test_near_copies_are_compared_whole_and_with_all(spark):
    doc = '"""Licensed under the terms of the project."""\n'
    body = [doc + "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz \n", k=150)) for i in range(4)]
    rows = [(str(i), b, "window", i + 1, 0) for i, b in enumerate(body)] + [("copy", body[3] + "!", "window", 5, 2)]
    head = '"""Another block that both of them share."""\n' + "".join(random.Random(9).choices("abcdefgh \n", k=2200))
    rows += [(f"long{i}", head + "".join(random.Random(20 + i).choices("ABCDEFGH" if i else "stuvwxyz", k=9000)), "window", 6 + i, 0) for i in range(2)]
    page = spark.createDataFrame(rows, "chunk_id string, content string, node_type string, place int, dup_count long")
    near = lambda **limits: {r.chunk_id: r.dup_count for r in search.collapse_near_copies(page, "chunk_id", "content", "node_type", "place", **limits).collect()}
    assert near() == {"0": 0, "1": 0, "2": 0, "3": 3, "long0": 0, "long1": 0}
    assert near(seen=2000, most_compared=3) == {"0": 0, "1": 0, "2": 0, "3": 0, "copy": 2, "long0": 1}
