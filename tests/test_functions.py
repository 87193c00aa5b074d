"""Truth tables of the column functions."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from notewell.functions import text as T
from notewell.functions import vectors as V


def table(spark, f, cases):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens(spark):
    cases = {"The Réunion of data-base_keys, é": ["reunion", "data", "base", "keys"], "": [], None: [], "a bb ccc": ["ccc"], "para ÇÃO 123 12": ["cao", "123"],
             "žluťoučký Łódź": ["zlutoucky", "odz"], "ﬁne ½ ①②③ e\u0301te\u0301": ["fine", "123", "ete"]}
    assert table(spark, T.tokens, list(cases)) == list(cases.values())


def test_accents_as_unicode_decomposes_them(spark):
    texts = [chr(c) for c in [*range(0x80, 0x2FF), *range(0x1E00, 0x1F00), *range(0x2070, 0x2200), *range(0x2460, 0x24FF), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B), *range(0x300, 0x370)]]
    plain = lambda t: re.findall("[a-z0-9]{3,}", "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
    got = table(spark, lambda c: F.regexp_extract_all(T.strip_accents(F.concat(F.lit("aa"), c, F.lit("bb"))), F.lit("[a-z0-9]{3,}"), F.lit(0)), texts)
    assert got == [plain(f"aa{t}bb") for t in texts]


def test_scope_and_folders(spark):
    cases = ["ws/Learnings/a.md", "ws/proj/Learnings/a.md", "ws/proj/feat/_index.md", "ws/proj/feat/x/Learnings/a.md", "ws/proj/x/Learnings/b.md", "ws/Learnings/_index.md",
             "ws/_index.md", "ws/proj/notes.md", "ws/proj/Learnings/a.txt", "a.md", "ws/proj/Learnings/sub/_index.md", "ws/proj/Learnings/sub/n.md", "ws/proj/_index.md", "ws/proj/t/n.MD"]
    assert table(spark, T.scope_of, cases) == ["workspace", "project", "index", "ticket", "ticket", "workspace", None, None, None, None, "index", "ticket", None, None]
    assert table(spark, T.ticket_dir, ["w/p/t/_index.md", "w/p/t/Learnings/a/Learnings/b.md", "w/x.md"]) == ["w/p/t", "w/p/t", None]
    assert table(spark, T.learnings_dir, ["w/Learnings/a/Learnings/b.md", "w/x.md"]) == ["w/Learnings/a/Learnings", None]
    assert table(spark, T.is_learning, ["w/p/Learnings/a.md", "w/p/Learnings/_index.md", "w/a.md"]) == [True, False, False]
    assert table(spark, T.stem, ["a/B c.md", "x", "V:\\n\\Note.MD", "a/b/"]) == ["b c", "x", "note", "b"]
    assert table(spark, T.project_of, ["w/p/x.md", "w"]) == ["p", "w"]
    assert table(spark, lambda c: T.is_vault_read(c, "V:\\Notes/"), ["v:/notes/a.md", "V:\\NOTES", "v:/notes2/a", None]) == [True, True, False, False]
    assert table(spark, T.pair_label, ["a/b/c.md"]) == ["b/c.md"]


def test_branches(spark):
    got = table(spark, T.split_branch, ["feat/1-a/b", "main", None])
    assert [tuple(g) for g in got] == [("feat", "1-a/b"), ("", "main"), ("", None)]
    assert table(spark, T.branch_label, ["feat/39458-new-panel", "fix/AB-12-x", "feat/login"]) == ["feat/39458", "fix/AB-12", "feat/login"]


@pytest.mark.parametrize("url, host", [
    ("https://Git.example.com/a/b.git", "git.example.com"), ("https://user@host.org:8443/x", "host.org"), ("ssh://git@h.net:22/x", "h.net"), ("git@h.net:a/b.git", "h.net"),
    ("file:///srv/x", ""), ("/srv/x", ""), ("C:/x", ""), ("", ""), (None, "")])
def test_url_host(spark, url, host):
    assert table(spark, T.url_host, [url]) == [host]


def test_url_normalize(spark):
    same = ["https://Host/a/B.git", "https://user@mirror/a/b/", "git@host:a/b.git", " http://h.org/A/b.git/ "]
    assert set(table(spark, T.url_normalize, same)) == {"a/b"}
    assert table(spark, T.url_normalize, ["ssh://git@host/a/b", "/srv/x.git", "", None]) == ["ssh://git@host/a/b", "/srv/x", None, None]


def test_texts(spark):
    assert table(spark, T.first_line, ["# head\n\n--- x\nbody here\nmore", "# only", "", None]) == ["body here", "# only", "", ""]
    assert table(spark, lambda c: T.excerpt(c, 3, "!"), ["abcd", "abc", None]) == ["abc!", "abc", None]
    assert table(spark, T.token_estimate, ["", None, "abcdefgh", "é" * 4]) == [1, 1, 2, 2]
    assert table(spark, T.wiki_links, ["see [[a]] and [[ b c |alias]] [[d#part]] [x]", None]) == [["a", "b c", "d"], []]
    assert table(spark, lambda c: T.repoint(c, "old", "new"), ["[[old]] [[dir/old|x]] [[older]] [[old#s]]"]) == ["[[new]] [[new|x]] [[older]] [[old#s]]"]
    assert table(spark, T.mentioned, ["[[a]] [[d/b|x]] [[a]] [[c#s]]", None]) == [["a", "b", "c#s"], []]
    assert table(spark, T.link_key, ["a/b/c.md", " c "]) == ["c", "c"]
    assert table(spark, lambda c: T.fill("<<A>> and <<A>>, <<B>>", A=c, B=F.lit(None)), ["x"]) == ["x and x, "]
    assert table(spark, T.tier_glyph, ["high", "mid", "low", None]) == ["H", "M", "L", "-"]
    assert table(spark, lambda c: T.thousands(c.cast("long")), ["1234567"]) == ["1,234,567"]
    assert table(spark, lambda c: T.query_text(c, F.array(F.lit("s1"), F.lit("s2")), F.repeat(F.lit("z"), 2000)), ["feat/x"]) == ["feat/x | s1 | s2 | " + "z" * 1500]
    assert table(spark, T.symbols, ["`kv.get_value` and `x` FooBarBaz `abcdef()` MyHTTPServer `abcdefghi`"]) == [["kv.get_value", "MyHTTPServer", "get_value", "abcdefghi", "FooBarBaz"]]
    assert table(spark, T.unix_lines, ["a\r\nb\rc\n"]) == ["a\nb\nc\n"]
    assert table(spark, T.version_triple, ["v1.2.10-rc1", "2", None]) == [[1, 2, 10], [2, 0, 0], [0, 0, 0]]
    assert table(spark, lambda c: T.clock_times(F.split(c, ",")), ["9:05,23:59,24:00,09:05,x"]) == [["09:05", "23:59"]]
    assert table(spark, lambda c: T.percent_bar(c.cast("double")), ["0.5"]) == ["[#########---------] 50.0%"]
    assert table(spark, lambda c: T.drop_field(c, "tags"), ["a: 1\ntags:\n  - x\n  - y\nb: 2\n"]) == ["a: 1\nb: 2\n"]
    assert table(spark, lambda c: T.claim(F.lit("d"), c), ["# T\nfirst\npara\n\nsecond\n## S\nrest"]) == ["d\nT\nfirst\npara"]
    assert table(spark, T.encode_cwd, ["C:\\a_b/c"]) == ["C--a-b-c"]
    assert table(spark, T.clean_session_id, ["a.b/c-1_2"]) == ["abc-1_2"]


def test_markers(spark):
    got = table(spark, T.counts_marker, ["x\nRUN-COUNTS: refutes=4 adds=1 adjusts=3 confirms=2", "RUN-COUNTS: adds=1", None, "counts: ADDS = 0, Confirms=5, adjusts= 0 refutes =0 adds=7"])
    assert tuple(got[0]) == (1, 2, 3, 4) and got[1:3] == [None, None] and tuple(got[3]) == (7, 5, 0, 0)
    said = table(spark, T.verdict, ["VERDICT: Drop\nCONFIDENCE: HIGH\nREASON: twice ", "verdict: KEEP", "VERDICT: maybe", "VERDICT: TRIM\nCONFIDENCE: high", "x\n VERDICT: TRIM\n---TRIMMED---\n\nbody\nmore\n\n---END---", None])
    assert [s and tuple(s) for s in said] == [("DROP", "high", "twice", None), ("KEEP", "low", "", None), None, None, ("TRIM", "low", "", "body\nmore\n"), None]
    made = table(spark, T.merge_decision, ["DECISION: KEEP_BOTH", "DECISION: merge\n---BODY---\nb\n---END---", "DECISION: MERGE", "none"])
    assert [m and tuple(m) for m in made] == [("KEEP_BOTH", None), ("MERGE", "b\n"), None, None]
    fails = ["fatal: Authentication failed for x", "returned error: 403", "could not read Password", "interactivity has been disabled", "HTTP 401", "terminal prompts disabled"]
    assert table(spark, lambda c: c.rlike(T.AUTH_FAILURE), [*fails, "Permission denied (publickey)", "port 4013", "ok"]) == [True] * 6 + [False] * 3


def test_front_matter(spark):
    text = '---\nname: "A note"\ntags: [x, \'y z\', ]\nrelated:\n  - one\n  - two\nempty:\nname: last\n---\nbody\n---\nmore'
    got = table(spark, T.front_matter, [text, "no front matter", "---\nbroken: 1", None, text.replace("\n", "\r\n")])
    assert got[0] == {"name": ["last"], "tags": ["x", "y z"], "related": ["one", "two"], "empty": []}
    assert got[1:4] == [{}, {}, {}] and got[4] == got[0]
    assert table(spark, T.note_body, [text]) == ["body\n---\nmore"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(V.dot("a", "b"), V.norm(F.col("a")), V.normalize(F.col("a")), V.cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(3.0, 5.0, [0.6, 0.8], 0.6), (0.0, 0.0, [0.0, 0.0], None)]


def test_patch_status(spark):
    data = ["---\nstatus: open\nx: 1\nstatus: b\n---\nbody\n---\n", "---\nx: 1\n---\nbody status: no\n", "---\nmy status: a\n\n---", "no front matter\nstatus: x", "---\nnever closed", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string").orderBy("i").select(T.patch_status(F.col("t"), F.lit("done"))).collect()]
    assert got == ["---\nstatus: done\nx: 1\nstatus: b\n---\nbody\n---\n", "---\nx: 1\nstatus: done\n\n---\nbody status: no\n", "---\nmy status: a\nstatus: done\n\n---", None, None, None]


def test_front_matter_parses_a_text_once(spark):
    """The text is named once in the plan, not again for each pair; and of a repeated key the last value holds."""
    df = spark.createDataFrame([("---\na: 1\nb: [x, 'y']\nA: 2\n---\nbody",), (None,)], "raw string").select(T.front_matter(F.col("raw")).alias("fm"))
    assert [r.fm for r in df.collect()] == [{"a": ["2"], "b": ["x", "y"]}, {}]
    assert df._jdf.queryExecution().analyzed().toString().count("(?s)\\A---") == 1
