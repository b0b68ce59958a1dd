import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sextant import catalog
from sextant.operators import cache, index, links, rank, refs, report, search, verify, vocab
from sextant.plans import queries
from sextant.sources import extract, files, frontmatter
from sextant.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_links_need_one_definer_and_few_readers(spark):
    t = [("a", "foo", "def"), ("b", "foo", "ref"), ("a", "two", "def"), ("b", "two", "def"), ("c", "two", "ref"), ("a", "hot", "def"), ("b", "hot", "ref"), ("c", "hot", "ref"), ("d", "hot", "ref"), ("a", "own", "def"), ("a", "own", "ref")]
    tags = spark.createDataFrame(t, "node string, name string, role string")
    assert rows(links.inferred(tags, 4)) == [("b", "a", 1, "foo")]


def test_closure_excludes_start_and_keeps_dangling(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "gone")], "src string, dst string")
    got = rows(links.closure(e, spark.createDataFrame([("a",)], "s string")))
    assert got == [("a", "a", 2), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("a", "gone", 3)] or got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("a", "gone", 3)]
    assert ("a", "a", 2) not in got


def test_gate_keeps_larger_of_repeated_pairs(spark):
    raw = spark.createDataFrame([("c", "w", "3"), ("c", "w", "9"), ("c", "v", "x"), ("", "v", "1")], "cluster string, word string, cnt string")
    assert rows(vocab.table(raw)) == [("c", "v", 0), ("c", "w", 9)]


def test_reverse_index_refuses_bad_claims(spark):
    good = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "b")], "path string, node string")
    assert index.reverse(good).first()["nodes"] == ["a", "b"]
    with pytest.raises(Exception, match="refused claim"):
        index.reverse(spark.createDataFrame([("p", "")], "path string, node string")).collect()


def test_boundaries(spark):
    t = spark.createDataFrame([("root.md",), ("a/x.md",), ("a/b/y.md",), ("c/d/e/z.md",), ("c/d/f/w.md",), ("_t/q.md",), ("a/.h/r.md",)], "path string")
    assert rows(index.boundaries(t)) == [("a", "a/b/y.md"), ("a", "a/x.md"), ("c/d/e", "c/d/e/z.md"), ("c/d/f", "c/d/f/w.md")]


def test_removal_wins_over_update(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "path string, hash string")
    gone = spark.createDataFrame([("c",), ("zz",)], "path string")
    assert rows(cache.merged(old, new, gone)) == [("a", "1"), ("b", "2")]
    assert rows(cache.removed(old, gone)) == []


def test_cache_commits_atomically(spark, tmp_path):
    s = "path string, hash string"
    one = spark.createDataFrame([("a", "1")], s)
    cache.commit(spark.createDataFrame([], s), one, spark.createDataFrame([], "path string"), str(tmp_path))
    now = cache.current(spark, str(tmp_path))
    cache.commit(now, spark.createDataFrame([("b", "1")], s), spark.createDataFrame([("a",)], "path string"), str(tmp_path))
    assert rows(cache.current(spark, str(tmp_path))) == [("b", "1")]


def test_consumers_match_prefixes_in_a_module(spark):
    d = spark.createDataFrame([("m", "Kunde"), ("m", "ab"), ("n", "Kund")], "module string, stem string")
    c = spark.createDataFrame([("m", "KundeController"), ("m", "abc"), ("m", "Kunde")], "module string, stem string")
    assert rows(rank.consumers(d, c)) == [("m", "Kunde", 1), ("m", "KundeController", 1)]


def test_density_ranks(spark):
    tags = spark.createDataFrame([("a", "def"), ("a", "ref"), ("b", "def")], "path string, role string")
    f = spark.createDataFrame([("a", 100), ("b", 100), ("c", 5), ("d", 0)], "path string, size long")
    got = [tuple(r)[0] for r in rank.best(rank.density(tags, f), 2).collect()]
    assert got == ["a", "b"]


def test_groundings(spark):
    import hashlib

    h = hashlib.sha256(b"two\nthree\n").hexdigest()
    q = spark.createDataFrame([("n", p, 2, 3, h) for p in ("same", "moved", "edited", "gone")], "node string, path string, first int, last int, digest string")
    f = spark.createDataFrame([("same", "one\ntwo\nthree\n"), ("moved", "0\none\ntwo\nthree\n"), ("edited", "one\nTWO\nthree\n")], "path string, content string")
    assert {r["path"]: (r["status"], r["now"]) for r in verify.groundings(q, f).collect()} == {"same": ("unchanged", None), "moved": ("moved", 3), "edited": ("changed", None), "gone": ("gone", None)}


def test_symbols_say_what_is_known(spark):
    t = "array<struct<name: string, role: string, kind: string, line: int, expression: string>>"
    c = spark.createDataFrame([("a", [("f", "def", "function", 0, "")], False), ("u", [], True)], f"path string, tags {t}, unsupported boolean")
    s = spark.createDataFrame([("n", "a"), ("n", "u"), ("n", "x")], "node string, path string")
    got = {(r["path"], r["state"], r["role"]) for r in refs.symbol_in_node(s, c, "f").collect()}
    assert got == {("a", "checked", "def"), ("u", "unsupported", None), ("x", "not_cached", None)}


def test_tag_lines(spark):
    lines = ["  |name \t|  function\tdef (3, 4) - (3, 9) `def name()`", "a\tb", "n\tk\tother (1, 2)", "n\tk\tref (x, 2)", "n\tcall\tref (7, 2) `open"]
    got = rows(extract.tag_lines(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert got == [("n", "ref", "call", 7, "open"), ("name", "def", "function", 3, "def name()")]


def test_declarations(spark):
    f = spark.createDataFrame([("a.py", "def foo(x):\n    return bar(x)\n"), ("b.txt", "def no(x)")], "path string, text string")
    assert rows(extract.declarations(f).select("path", "name", "role", "kind", "line")) == [("a.py", "bar", "ref", "call", 1), ("a.py", "foo", "def", "function", 0)]


def test_node_types(spark):
    j = '[{"type": "function_definition", "named": true, "fields": {"name": "x"}}, {"type": "VarDecl", "named": true}, {"type": "struct", "named": true}, {"type": ";", "named": false}]'
    got = rows(extract.node_types(spark.createDataFrame([(j,)], "json string")).select("type", "kind"))
    assert got == [("VarDecl", "var"), ("function_definition", "function")]


@pytest.mark.parametrize(
    ("text", "reason"),
    [("x", "no_frontmatter"), ("---\na: 1", "unterminated"), ("---\na: &x\n---", "anchor_or_alias"), ("---\na: |\n---", "block_scalar"), ("---\na: {b: 1}\n---", "flow_collection"), ("---\na: [b: 1]\n---", "flow_collection"), ("---\na: 1\n---\n---", "second_document"), ("---\n\ta: 1\n---", "tab_indent"), ("---\nword\n---", "malformed_line"), ("---\n- x\n---", "malformed_line")],
)
def test_front_matter_is_refused(text, reason):
    with pytest.raises(frontmatter.Refused, match=reason):
        frontmatter.entity(text)


def test_front_matter_entity():
    text = '---\nname: "Ann"\ntemplate: person\n# c\nfriends:\n  close:\n    - "[[bob|Bob]]"\n    - link: "[[cat]] and [[dan]]"\ntags: [ "x",\n  "[[eve]]" ]\nhome: [[town]]\nempty: {}\n---\nbody'
    got = [(t["name"], t["role"], t["kind"]) for t in frontmatter.entity(text)]
    assert got == [("Ann", "def", "person"), ("bob", "ref", "close"), ("cat", "ref", "friends.close.link"), ("dan", "ref", "friends.close.link"), ("eve", "ref", "tags"), ("town", "ref", "home")]
    assert frontmatter.entity(text, qualified=True)[1]["kind"] == "friends.close"


def test_wikilinks_resolve_by_stem(spark):
    d = spark.createDataFrame([("v/a.md", "[[b]] [[b|x]] [[a]] [[none]]"), ("v/b.md", "[[a.md]]")], "path string, text string")
    assert rows(links.resolved_wikilinks(d)) == [("v/a.md", "v/b.md"), ("v/b.md", "v/a.md")]


def test_search_orders_by_backlinks(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "node string, text string")
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "a")], "src string, dst string")
    assert [r["node"] for r in search.by_backlinks(d, e, "x").collect()] == ["b", "a"]
    assert search.linking_notes(e, d, "zz") is None and rows(search.linking_notes(e, d, "b")) == [("a",), ("c",)]


def test_findings_and_exit(spark):
    r = spark.createDataFrame([("ok",), ("fail",)], "status string")
    assert report.exit_code(r).first()["code"] == 1 and report.exit_code(r.where("status = 'ok'")).first()["code"] == 0


def test_files_and_lists(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("hi")
    (tmp_path / "Index.md").write_text("no")
    (tmp_path / "01.title").write_text("One\n")
    (tmp_path / "01.txt").write_text("x\ny\n")
    (tmp_path / "02.txt").write_text("z\n")
    assert rows(files.texts(spark, str(tmp_path))) == [("a/n.md", "hi", "n")]
    assert rows(files.numbered_lists(spark, str(tmp_path))) == [("01", "One", "x"), ("01", "One", "y")]
    assert ("a/n.md", 2) in rows(files.listed(spark, str(tmp_path)))


def test_nudges_in_a_stream(spark, tmp_path):
    src = spark.createDataFrame([("s",)] * 53 + [("t",)] * 3, "session string")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run = events.nudges(stream, 25).writeStream.format("memory").queryName("nudged").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert rows(spark.table("nudged")) == [("s", 25), ("s", 50)]


def test_once_per_session_in_a_stream(spark, tmp_path):
    src = spark.createDataFrame([("s", "f"), ("s", "f"), ("s", "g"), ("t", "f")], "session string, file string")
    src.write.parquet(str(tmp_path / "in"))
    deps = spark.createDataFrame([("f", "n1")], "file string, dependents string")
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    run = events.once_per_session(stream, deps).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert rows(spark.table("once").select("session", "file")) == [("s", "f"), ("t", "f")]


def test_payloads(spark):
    lines = spark.createDataFrame([('{"session_id": "s", "tool_name": "Edit", "tool_input": {"file_path": "a"}}',), ("{}",)], "value string")
    assert rows(events.routed(events.payloads(lines), "Edit|Write")) == [("s", "Edit", "a")]


def test_blast_radius(spark):
    e = spark.createDataFrame([(f"n{i}", "o") for i in range(7)] + [("o", "o")], "src string, dst string")
    got = links.blast_radius(e, spark.createDataFrame([("p", "o")], "path string, node string")).first()
    assert (got["dependents"], got["more"]) == ("n0,n1,n2,n3,n4", 2)


def test_posix_patterns(spark):
    f = spark.createDataFrame([("ab.png",), ("12.md",)], "path string")
    assert rows(files.enumerated(f.withColumn("size", F.lit(1)), ["^[[:digit:]]+"])) == []


def test_note_store(spark, tmp_path):
    from sextant.sources import store

    store.register(spark)
    spark.createDataFrame([("a/b", "x\n"), ("c", "y")], "node string, text string").write.format("notes").mode("append").option("path", str(tmp_path)).save()
    (tmp_path / "Index.md").write_text("no")
    there = spark.read.format("notes").load(str(tmp_path))
    assert rows(there) == [("a/b", "x\n"), ("c", "y")]
    assert rows(store.nodes(there)) == [("a/b",), ("c",)] and rows(store.holding(there, "y")) == [("c", "y")]
    spark.createDataFrame([("c", None), ("gone", None)], "node string, text string").write.format("notes").mode("append").option("path", str(tmp_path)).save()
    assert rows(spark.read.format("notes").load(str(tmp_path))) == [("a/b", "x\n")]


def test_commit_graph(spark):
    from sextant.operators import commits

    c = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("m", "b"), ("m", "c")], "sha string, parent string")
    p = spark.createDataFrame([("a", "m"), ("b", "c"), ("m", "b")], "a string, b string")
    assert rows(commits.left_right(c, p)) == [("a", "m", 0, 3, True), ("b", "c", 1, 1, False), ("m", "b", 2, 0, False)]


def test_a_note_has_all_its_fields(spark):
    """As written out by hand."""
    from sextant.functions import notes as n

    nodes = [("a", "T", 'say "x\\"', "p", "main", "2026", "c1", "f.py", "3-9", "\n\nbody\n\n", "mine"), ("b", "U", "", "p", "dev", "2026", None, None, None, "", None)]
    columns = "node string, title string, summary string, project string, branch string, built_at string, commit string, crux_path string, crux_lines string, body string, tail string"
    sources = [("a", p, "h") for p in ("y.py", "x.py", "x.py")] + [("b", f"m{i % 2}/f{i}", "h") for i in range(5)]
    grounded = [("a", "g.py", "1-2", "d")]
    made = spark.createDataFrame(nodes, columns)
    out = dict((r["node"], r["text"]) for r in report.note(made, spark.createDataFrame(sources, "node string, path string, hash string"), F.substring_index("path", "/", 1), spark.createDataFrame(grounded, "node string, path string, lines string, digest string")).collect())
    digest = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert out["a"] == (
        f'---\ntitle: "T"\nsummary: "say \\"x\\\\\\""\nnode_type: sextant-node\nproject: p\nbranch: main\nsources:\n  - path: x.py\n    hash: h\n  - path: y.py\n    hash: h\nsources_digest: {digest(["x.py:h", "y.py:h"])}\n'
        f'stale: false\nbuilt_at: "2026"\ncommit: c1\ncrux_path: f.py\ncrux_lines: "3-9"\ngrounded_in:\n  - path: g.py\n    lines: "1-2"\n    digest: d\n---\n\n# T\n{n.START}\n\nbody\n\n## Sources\n- `x.py`\n- `y.py`\n{n.END}\nmine\n'
    )
    assert out["b"] == (
        '---\ntitle: "U"\nsummary: ""\nnode_type: sextant-node\nproject: p\nbranch: dev\nsources:\n' + "".join(f"  - path: {p}\n    hash: h\n" for p in ("m0/f0", "m0/f2", "m0/f4", "m1/f1", "m1/f3"))
        + f'sources_digest: {digest([f"m{m}/f{i}:h" for m, i in ((0, 0), (0, 2), (0, 4), (1, 1), (1, 3))])}\nstale: false\nbuilt_at: "2026"\n---\n\n# U\n{n.START}\n\n\n## Sources\n- `m0` (3)\n- `m1` (2)\n{n.END}\n\n## Notes\n\n'
    )


def test_paths_without_tags_stay(spark):
    lines = [("o", 1, "\tlost"), ("o", 2, "a.py"), ("o", 3, "\tx\ty"), ("o", 4, ""), ("o", 5, "b.py"), ("o", 6, "a.py"), ("o", 7, "\tz"), ("o", 8, "c.py")]
    out = extract.attributed(spark.createDataFrame(lines, "file string, n int, line string"), "file", "n").collect()
    assert sorted(((r["path"], r["line"]) for r in out), key=str) == [("a.py", "x\ty"), ("a.py", "z"), ("b.py", None), ("c.py", None)]


def test_repeated_rows_each_meet_their_ancestor(spark):
    from sextant.operators import index

    rows = spark.createDataFrame([("a/b/c.x",), ("a/b/c.x",), ("d.x",)], "path string")
    rules = spark.createDataFrame([("a", 1), ("a/b", 2)], "dir string, v int")
    assert [tuple(r) for r in index.nearest_ancestor(rows, rules).collect()] == [("a/b/c.x", "a/b", 2)] * 2


def test_the_first_request_of_a_path_counts(spark):
    from sextant.operators import cache

    asked = spark.createDataFrame([("p", "b", 1), ("p", "a", 2), ("q", "a", 1)], "path string, hash string, n int")
    known = spark.createDataFrame([("p", "a"), ("q", "a")], "path string, hash string")
    assert [tuple(r) for r in cache.needs_tagging(asked, known, "n").collect()] == [("p", "b")]


def test_intermediate_tables_need_a_shared_folder(spark, monkeypatch):
    from sextant.plans import storage

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: None)

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared(Session())


def test_stored_tables_follow_their_files(spark, tmp_path):
    from sextant.plans import storage

    at, made = str(tmp_path / "t"), []
    read = lambda: storage.kept(spark.read.parquet(at), "n", lambda: made.append(1) or spark.read.parquet(at).selectExpr("v + 1 AS v"))
    spark.range(3).withColumnRenamed("id", "v").write.parquet(at)
    assert rows(read()) == rows(read()) == [(1,), (2,), (3,)] and len(made) == 1
    spark.range(1).withColumnRenamed("id", "v").write.mode("overwrite").parquet(at)
    assert rows(read()) == [(1,)] and len(made) == 2
    path = storage._KEPT[[k for k in storage._KEPT if k[2] == "n"][-1]]
    folder, fs = storage._file(spark, path)
    fs.delete(folder, True)
    assert rows(read()) == [(1,)] and len(made) == 3


def test_written_tables_can_be_discarded(spark):
    from sextant.plans import storage

    table = storage.written(spark.range(3), "gone")
    at, fs = storage._file(spark, table._written_at)
    assert fs.exists(at)
    storage.discard(table)
    assert not fs.exists(at)


def test_a_lookup_pushes_its_name_to_the_scan(spark, tmp_path):
    tags = spark.createDataFrame([("p", "foo", "ref", "call", 1, "foo()"), ("p", "bar", "ref", "call", 1, "foo()"), ("q", "foo", "def", "f", 2, "def foo")], "path string, name string, role string, kind string, line int, expression string")
    refs.by_name(tags).write.parquet(str(tmp_path / "sites"))
    found = refs.looked_up(spark.read.parquet(str(tmp_path / "sites")), tags.select("path", "line", "expression").distinct(), "foo")
    assert rows(found) == [("foo", "ref", "call", "p:1", "foo()")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,foo)" in plan.split("PushedFilters", 1)[1][:200]


def test_closures_of_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(3, 40), (60, 0)], "src long, dst long")
    for hops in (1, 3, 4):
        found = links.closure(e, spark.createDataFrame([(0,)], "s long"), hops=hops)
        assert {r["node"]: r["depth"] for r in found.collect()} == {i: i if i <= 3 or i < 40 and i < 40 else i - 36 for i in range(1, 61)}


def test_predicates_that_cannot_be_told_drop_a_pattern(spark):
    m = spark.createDataFrame([("p", k, {"name": ("x", 0, 1), "definition.f": ("x", 0, 1)}) for k in range(5)], "path string, pattern int, captures map<string, struct<text: string, start: int, end: int>>")
    patterns = {0: [("match?", ["@name", "^x"])], 1: [("eq?", ["x", "@name"])], 2: [("set!", ["a", "b"]), ("eq?", ["@name"])], 3: [("not-eq?", ["@name", "@gone"])], 4: [("eq?", ["@name", "@name"])]}
    assert [r["name"] for r in extract.query_tags(m, patterns).collect()] == ["x", "x"]


LONG = " ".join(f"Word{i % 700}{',' * (i % 3 == 0)}" for i in range(2000))


def long_line(spark, tmp_path):
    """Documents of which one has a long line, two have the same path, and one lies in an unsupported source."""
    given = [(1, LONG + "\n  that, is\nthat ", "en", "src1"), (2, "that one", "en", "src1"), (2, "that one\nthat two", "en", "src1"), (3, "that", "de", "src6"), (4, "that", "de", "src4"), (5, None, "de", "src1"), (6, "a b", "fr", "src2")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in given], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sql(name, d):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet/*.parquet')")
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=str)


def mine(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_outcomes_of_long_lines(spark, tmp_path):
    """A cached file holds a line's text once, not once for each occurrence."""
    d = long_line(spark, tmp_path)
    assert mine(catalog.queries()["cache_outcomes"](spark, d)) == sql("cache_outcomes", d)
    assert queries._cached(spark, d).select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 20 * len(LONG)


def test_round_trip_of_long_lines(spark, tmp_path):
    d = long_line(spark, tmp_path)
    assert mine(catalog.queries()["cache_round_trip"](spark, d)) == sql("cache_round_trip", d)
    dumps = cache.dumped(queries._cached(spark, d))
    assert dumps.select(F.max(F.length("value"))).first()[0] < 20 * len(LONG)
    back = cache.loaded(dumps)
    assert rows(back) == rows(queries._cached(spark, d).select(back.columns))


def test_digests_of_dumps(spark, tmp_path, monkeypatch):
    """Digests are those of the sorted lines of whatever files come together, and only dumps go to Python, not an entry for each occurrence."""
    words = ["that", "thatch", "that1", "word", "a"]
    files = []
    for n in range(40):
        texts = [f"{'é' * (n % 3)}text {i % 4} of {n % 7}" for i in range(n % 12)] + ["x" * 300_000] * (n == 13)
        tags = [(words[(i * 7 + n) % 5], ("def", "ref")[i % 2], ("call", "name")[i % 3 == 0], i * 5 % 13 if n % 2 else 1, i % len(texts)) for i in range(3 * n)] if texts else []
        files.append((f"p{n}", f"h{n}", tags, texts, False))
    files.append(("q", "h", [], [], True))
    c = spark.createDataFrame(files, "path string, hash string, tags array<struct<name: string, role: string, kind: string, line: int, at: int>>, expressions array<string>, unsupported boolean").coalesce(1)
    want = {}
    for path, hash_, tags, texts, unsupported in files:
        lines = sorted(f"{name}|{role}|{kind}|{line}|{texts[at]}".encode() for name, role, kind, line, at in tags)
        want[path] = (hash_, unsupported, len(tags), hashlib.md5(b"\n".join(lines)).hexdigest())
    dumps = cache.dumped(c).union(spark.createDataFrame([(None,)], "value string"))
    for size in (cache.PIECE, 100):
        monkeypatch.setattr(cache, "PIECE", size)
        found = {r["path"]: tuple(r)[1:] for r in cache.loaded_digests(dumps).collect()}
        assert found.pop(None) == (None, None, None, None) and found == want
        assert rows(cache.loaded(dumps).where("path is not null")) == rows(c)
    bad = spark.createDataFrame([("P\tp\nH\th\nX\tx\nT\tdef\t0\tword\tname\t1",)], "value string")
    with pytest.raises(Exception, match="at a text that it lacks"):
        cache.loaded_digests(bad).collect()
    plan = catalog.queries()["cache_round_trip"](spark, long_line(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow run\(value#\d+\)", plan)


def test_index_of_long_lines(spark, tmp_path):
    """Lines are told apart before their occurrences stand apart, each with the line's text."""
    d = long_line(spark, tmp_path)
    found = catalog.queries()["refs_index"](spark, d)
    assert mine(found) == sql("refs_index", d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate") and plan.count("md5") == 1 and plan.index("Generate explode") < plan.index("md5")


def test_symbol_in_node_of_long_lines(spark, tmp_path):
    """Only the occurrences that are asked for meet the sources."""
    d = long_line(spark, tmp_path)
    found = catalog.queries()["symbol_in_node"](spark, d)
    assert mine(found) == sql("symbol_in_node", d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("= that)")
