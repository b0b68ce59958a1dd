import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import notes, paths, words
from sextant.sources import files


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_split_words(spark):
    got = values(spark, [("HTTPServer_getUserName2",), ("ßüber",), ("",), (None,)], "s string", words.split_words(F.col("s")))
    assert [g[0] for g in got] == [["httpserver", "get", "user", "name2"], ["ber"], [], None]


def test_keeps(spark):
    got = values(spark, [("abc",), ("abcd",), ("1234",), ("that",)], "w string", words.keeps(F.col("w"), ("that",)))
    assert [g[0] for g in got] == [False, True, False, False]


def test_three_rules_for_extensions(spark):
    p = F.col("p")
    got = values(spark, [("a/.gitignore",), ("B.PNG",), ("x/Makefile",), ("a.tar.gz",), ("end.",)], "p string", paths.artifact(p), paths.extension(p), paths.grammar_extension(p))
    assert got == [("gitignore", None, "gitignore"), ("png", "PNG", "png"), ("makefile", None, None), ("gz", "gz", "gz"), ("end.", "", "")]


def test_groups_and_modules(spark):
    p = F.col("p")
    rows = [("README.md",), ("a/b/c/d.x",), ("a/x.y",), ("svc/src/main/java/F.java",), ("lib/src/core/x.zig",), ("lib/src/x.zig",)]
    got = values(spark, rows, "p string", paths.group_of(p, 2), paths.module_of(p, ("src/main/java",)))
    assert got == [("(repo root)", "(repo root)"), ("a/b", "a"), ("a", "a"), ("svc/src", "svc"), ("lib/src", "lib/src/core"), ("lib/src", "lib")]


def test_test_paths(spark):
    cases = {"src/test/A.java": True, "FooTest.java": True, "Latest.java": False, "Foo.Tests.cs": True, "foo.spec.js": True, "test_a.py": True, "test_a": False, "m_SUITE.erl": True, "contest.py": False, "tests": False}
    got = values(spark, [(p,) for p in cases], "p string", "p", paths.is_test(F.col("p")))
    assert dict(got) == cases


def test_binary_and_noise(spark):
    cases = {"a.png": (True, False), "a.PNG": (False, False), ".png": (False, False), "go.sum": (False, True), "x/app.min.js": (False, True), "a.md": (False, False)}
    got = values(spark, [(p,) for p in cases], "p string", "p", paths.is_binary(F.col("p")), paths.is_noise(F.col("p")))
    assert {p: (b, n) for p, b, n in got} == cases


def test_names(spark):
    r = F.col("r")
    got = values(spark, [("git@host:org/repo.git",), ("https://h/o/repo/",), ("host:repo.git",)], "r string", paths.repo_name(r), paths.namespace(r, F.lit("f/x:1")))
    assert got == [("repo", "repo@f-x-1")] * 3
    assert values(spark, [("a b/ç~*+",)], "p string", paths.percent_encoded(F.col("p"))) == [("a%20b/%C3%A7~%2A%2B",)]
    assert values(spark, [("big cities/old Town",)], "p string", paths.cluster_title(F.col("p"))) == [("Big cities - Old Town",)]


def test_hash_and_slices(spark):
    assert values(spark, [("hello\n",)], "c string", words.blob_hash(F.col("c"))) == [("ce013625030ba8dba906f756967f9e9ca394464a",)]
    rows = [("a\nb\nc", 2, 3), ("a\nb\nc\n", 1, 2), ("a", 1, 2), ("a", 2, 1)]
    got = values(spark, rows, "t string, a int, b int", words.line_slice(F.col("t"), F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["b\nc", "a\nb\n", None, None]
    got = values(spark, [("3-9",), ("0-2",), ("5-4",), ("x",)], "s string", words.line_range(F.col("s")))
    assert [g[0] and tuple(g[0]) for g in got] == [(3, 9), None, None, None]


def test_checklists_and_versions(spark):
    total, checked = words.checklist(F.col("b"))
    rows = [("- [x] a\n  - [X] b",), ("- [ ] a\n- plain",), ("none",)]
    got = values(spark, rows, "b string", total, checked, words.next_status(total, checked))
    assert got == [(2, 2, "REVIEW"), (1, 0, "IN-PROGRESS"), (0, 0, "IN-PROGRESS")]
    got = values(spark, [("1.10", "1.9"), ("v1.2", "1.2.0"), ("1.2.1", "1.2")], "a string, b string", words.version_newer(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, False, True]


NOTE = '---\ntitle: "a \\"b\\""\nstale: false\nsources:\n  - path: x.py\n    hash: 1\n  - path: y.py\n    hash: 2\ngrounded_in:\n  - path: x.py\n    lines: 1-2\n    digest: d\n---\n# T\n' + notes.START + "\ninner\n" + notes.END + "\n## Links\n- uses [[B]]\n- [[C]]\n- calls: [[D|shown]]\n## Notes\nmine"


def test_notes(spark):
    t = F.col("t")
    got = values(spark, [(NOTE,), ("plain",)], "t string", notes.scalar(t, "title"), notes.field(t, "none"), notes.body(t), F.transform(notes.sources(t), lambda x: x["path"]), F.transform(notes.groundings(t), lambda x: x["lines"]), notes.section(t, "Notes"))
    assert got[0] == ('a "b"', None, "inner\n", ["x.py", "y.py"], ["1-2"], "mine")
    assert got[1] == (None, None, "plain", [], [], None)
    edges = values(spark, [(NOTE,)], "t string", notes.edges(t))[0][0]
    assert [tuple(e) for e in edges] == [("uses", "B"), ("calls:", "D|shown")]
    stale = values(spark, [(NOTE,), ("---\na: 1\n---\nx",), ("plain",)], "t string", notes.set_stale(t))
    assert stale == [(NOTE.replace("stale: false", "stale: true"),), ("---\na: 1\nstale: true\n---\nx",), ("plain",)]


def test_directives_and_spans(spark):
    said = "<!-- crux: a.py L3-L9 -->\nsee <!--crux:none--> <!-- cruxes are nice --> crux: b 1-2\n<!-- TODO -->\n<!-- crux: open"
    assert values(spark, [(said,)], "b string", notes.directives(F.col("b"), "crux"))[0][0] == ["a.py L3-L9", "none"]
    nested = "<!-- crux: x <!-- crux: y 1-2 -->"
    assert values(spark, [(nested,)], "b string", notes.directives(F.col("b"), "crux"))[0][0] == ["x <!-- crux: y 1-2", "y 1-2"]
    cases = {"src/a.java 412-419": ("src/a.java", 412, 419), "src/a.java L10-L12": ("src/a.java", 10, 12), "f.java 10-20-30": ("f.java", 10, 30), "a\tb 3-4": ("a", 3, 4), "src/a.java": None, "src/a.java 412": None, "src/a.java abc-def": None, "src/a.java +5-9": None, "a " + "1" * 40 + "-" + "2" * 40: None, " 1-2": None}
    got = values(spark, [(k,) for k in cases], "b string", notes.span(F.col("b")))
    assert [x[0] and tuple(x[0]) for x in got] == list(cases.values())
    rows = [(False, 1, 2, 9), (True, 0, 2, 9), (True, 1, 30, 99), (True, 2, 2, 9)]
    got = values(spark, rows, "c boolean, s int, e int, n int", notes.span_problem(F.col("c"), F.col("s"), F.col("e"), F.col("n"), 20))
    assert [g[0] for g in got] == ["not claimed", "out of range", "too long", None]


def test_sections_end_where_the_region_ends(spark):
    t = F.col("t")
    rows = {
        "# Title\n## Summary\nprose\n## Crux\n<!-- crux: src/a.java 10-12 -->\n## Links\n- uses [[X]]\n": "<!-- crux: src/a.java 10-12 -->\n",
        f"## Crux\r\n<!-- crux: none -->\n{notes.END}\n\n## Notes\nhand written\n": "<!-- crux: none -->\n",
        "## Summary\nprose\n## Crux": "",
        "## Summary\nprose\n": None,
        "## Cruxes and caveats\nprose\n": None,
        "## Crux \nblank behind it\n": None,
        " ## Crux\nindented\n": None,
    }
    assert [g[0] for g in values(spark, [(k,) for k in rows], "t string", notes.section(t, "Crux"))] == list(rows.values())


def test_edges_are_as_written(spark):
    text = "- before [[X]]\n## Links\n- uses [[A]]\n-tight [[B]]\n  - indented [[C]]\n- [[D]]\n- calls: [[E|shown]] and [[F]]\n- empty [[]]\n- open [[G\n## Links\n-\tmore\t [[H]]\n## Linksy\n- after [[I]]\n"
    edges = values(spark, [(text,), ("none",)], "t string", notes.edges(F.col("t")))
    assert [tuple(e) for e in edges[0][0]] == [("uses", "A"), ("tight", "B"), ("calls:", "E|shown"), ("more", "H")] and edges[1][0] == []


def test_a_crux_is_the_one_under_its_heading(spark):
    body = "## Summary\nlike `<!-- crux: path 10-20 -->`\n## Crux\nfirst <!-- crux: src/real.zig 5-8 --> x\n<!-- crux: none -->\n## Notes\n"
    rows = [(body,), ("## Crux\n<!-- crux: none -->",), ("<!-- crux: a 1-2 -->",), ("## Crux\n<!-- crux: bad -->",)]
    got = [x[0] for x in values(spark, rows, "t string", notes.crux(F.col("t")))]
    assert (tuple(got[0]["span"]), got[0]["none"], got[0]["marker"]) == (("src/real.zig", 5, 8), False, "<!-- crux: src/real.zig 5-8 -->")
    assert got[1]["none"] and got[2] is None and got[3]["span"] is None and not got[3]["none"]


def test_lines_are_replaced_and_groundings_go(spark):
    t = F.col("t")
    got = values(spark, [("a\n  x <!--m--> y\nb <!--m-->",), ("<!--m-->",), ("no mark",), ("a\n<!--m-->",)], "t string", notes.with_line(t, F.lit("<!--m-->"), F.lit("new\nlines\n\n")))
    assert [g[0] for g in got] == ["a\nnew\nlines\nb <!--m-->", "new\nlines", "no mark", "a\nnew\nlines"]
    got = values(spark, [("p\n <!-- grounded_in: a 1-2 --> \nsee <!-- grounded_in: b 3-4 -->here <!-- other -->\n<!-- grounded_in: c 1-1 --> <!-- x -->\nq",)], "t string", notes.without_directives(t, "grounded_in"))
    assert got[0][0] == "p\nsee here <!-- other -->\n <!-- x -->\nq"
    got = values(spark, [("\n \r\n a\n\nb\n \n\n",), ("x",), (" \n\t",), ("  x\n",)], "t string", notes.without_blank_edges(t))
    assert [g[0] for g in got] == [" a\n\nb", "x", "", "  x"]


def test_settings():
    text = "# c\nexport A=~/x\nB=\"$HOME/${A2}\"\nC='~$X'\nD=a\\$b\nbad line\n"
    assert files.settings(text, {"HOME": "/h", "A2": "z"}) == {"A": "/h/x", "B": "/h/z", "C": "~$X", "D": "a$b"}
    assert files.rules('[{"match": "f", "kind": "function"}, {"match": 1, "kind": "x"}, {"match": "g", "scope": "s", "kind": "k"}]') == [("f", None, "function"), ("g", "s", "k")]


@given(st.integers(1, 10**6), st.integers(1, 10**6))
def test_distinctiveness_falls(df, n):
    d = max(2, n // 20)
    score = lambda x: d / (d + x)
    assert 0 < score(df + 1) < score(df) <= 1 and score(d) == 0.5


def test_digest_does_not_depend_on_order(spark):
    from sextant.operators import verify

    rows = [("n", "b", "2"), ("n", "a", "1")]
    got = [verify.digests(spark.createDataFrame(r, "node string, path string, hash string")).first()["digest"] for r in (rows, rows[::-1])]
    assert got == [hashlib.sha256(b"a:1\nb:2").hexdigest()] * 2
