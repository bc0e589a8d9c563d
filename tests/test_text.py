"""Text functions on written inputs; native forms against the Python ones."""

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklens.functions import regions as R
from tracklens.functions import text as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


def plain(regions):
    return [tuple(r) for r in regions]


def test_url(spark):
    assert plain(one(spark, "a http://x.y/z). b", X.url_regions)) == [(2, 16, "url", "http://x.y/z).")]
    assert plain(one(spark, "http://x y", X.url_regions)) == [(0, 8, "url", "http://x")]
    assert plain(one(spark, "\U0001f600é https://q", X.url_regions)) == [(3, 12, "url", "https://q")]


def test_colour(spark):
    assert one(spark, "p {color:red}q{color} r", X.without_colour) == "p  q  r"
    assert plain(one(spark, "{color:red}q{color:blue}", X.colour_regions))[0][3] == "q{colo"
    assert one(spark, "{color:red}alone", X.without_colour) == "{color:red}alone"


def test_code(spark):
    assert plain(one(spark, "x {code:java}A{code} y", X.code_regions)) == [(2, 20, "{code:java}", "A")]
    assert [r[2] for r in plain(one(spark, "{code}A{code} {noformat}B{noformat}", X.code_regions))] == ["{noformat}", "{code}"]


def test_merge(spark):
    rows = [(0, 5, "u", "aaaaa"), (5, 8, "v", "bbb"), (2, 3, "w", "a"), (10, 12, "x", "cc")]
    df = spark.createDataFrame([(rows,)], f"r {X.REGIONS}").select(X.merged(F.col("r")).alias("m"))
    assert [tuple(r)[:3] for r in df.first().m] == [(10, 12, "x"), (0, 8, "u,v")]
    assert [r[:3] for r in R.merge([R.Region(*r) for r in rows])] == [(0, 8, "u,v"), (10, 12, "x")]


def test_comment_inside_url(spark):
    df = spark.createDataFrame([([(0, 20, "url", "")], [(5, 30, "singlecomment", "1"), (0, 9, "singlecomment", "2"), (20, 25, "singlecomment", "3")])], f"u {X.REGIONS}, c {X.REGIONS}")
    assert [r.content for r in df.select(X.comments_outside_urls(F.col("c"), F.col("u")).alias("r")).first().r] == ["2", "3"]


@pytest.mark.parametrize(("text", "start", "n"), [("if (a) {b{c}d} e", 7, 7), ("{ a", 0, 0), ("{}", 0, 2)])
def test_braces(spark, text, start, n):
    assert one(spark, text, lambda t: X.brace_match(t, F.lit(start))) == n == R.balanced(text, start)


def test_tokens(spark):
    assert one(spark, "Re-run U.S.A. $12.40 82% A=b!", X.tokens) == ["re-run", "u.s.a.", "$12.40", "82%", "a", "=", "b"]
    assert one(spark, None, X.tokens) == [] == one(spark, "", X.tokens)


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("5", "5.", "-5", ".5", "1.2.3", "82%", "$12", "")], "t string")
    assert [r.n for r in df.select(X.is_number(F.col("t")).alias("n")).collect()] == [True, True, True, False, False, False, False, False]
    assert one(spark, "The 5 cats the cats", lambda t: X.meaningful(X.tokens(t), ["the"])) == ["cats", "cats"]


def test_labels_and_colour(spark):
    assert one(spark, "client ;  maven,,", X.label_names) == ["client", "maven"]
    colour = one(spark, "dev1", X.colour_of)
    assert len(colour) == 7 and colour == one(spark, "dev1", X.colour_of)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r.s for r in df.select(X.cosine(F.col("a"), F.col("b")).alias("s")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None]


def test_exceptions():
    head = "x.y.BadError: "
    assert len(R.exceptions(head + "at " * 9 + head)) == 1
    assert len(R.exceptions(head + "at " * 10 + head)) == 2
    s = "pre java.io.EOFException: null\n    at org.acme.A.run(A.java:96)\nCaused by: java.lang.RuntimeException: x\n    at org.acme.B.go(B.java:7)\n"
    traces, causes = R.stack_traces(s)
    assert traces and causes
    assert all(s[r.start : r.end] == r.content for r in traces + causes)
    assert R.stack_traces("a.b.SomeException: nothing more")[0][0].tag == "stacktrace"


def test_code_regions():
    s = "text\nif (a) {b(c);} tail\n// note\nend"
    kinds = {r.tag for r in R.java_code(s)}
    assert {"ifstatement", "singlecomment"} <= kinds
    exact, loose = (next(r for r in R.java_code(s, compat=c) if r.tag == "ifstatement") for c in (False, True))
    assert loose.end == exact.end + 1 and s[exact.end - 1] == "}"


def test_clean():
    assert R.cleaned(None) == ("", [], "") == R.cleaned("")
    raw, regions, rest = R.cleaned("a {code}\nx = 1; // hi\n{code} b c")
    assert rest.startswith("a ") and rest.endswith("\n hi") and "b c" in rest


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), max_size=12))
def test_merged_regions_are_apart(pairs):
    out = R.merge([R.Region(a, a + n, "t", "x" * n) for a, n in pairs])
    assert all(a.end < b.start for a, b in zip(out, out[1:], strict=False))
    assert {i for a, n in pairs for i in range(a, a + n)} == {i for r in out for i in range(r.start, r.end)}


# The patterns that the scans stand for.
STATEMENTS = (
    ("import", r"(?ms)^\s*import.*;$"),
    ("package", r"(?ms)^package.*;$"),
    ("singlecomment", r"(?s)\s*//.*?[\n\r]"),
    ("multicomment", r"(?s)\s*/\*.*?\*/"),
    ("class", r"(?ms)^.*?class.*?\{"),
    ("assignment", r"(?ms)^.*=.*;$"),
    ("ifstatement", r"(?ms)^.*?if\s*\(.*?\)\s*\{"),
    ("elsestatement", r"(?ms)^.*?else\s*\{"),
    ("functiondef", r"(?ms)^.*?(?:[a-zA-Z_][a-zA-Z0-9_])+\s*\(.*?\)\s*\{"),
    ("functionall", r"(?ms)^.*\(.*?\).*?;$"),
)
EXCEPTION = r"(?:[\w<>$]+\.)+[\w<>$]+(?:.\s*Error|.\s*Exception)[\s:]"
REASON = r":?.*?at\s+(?:[\w<>$]+\.)+[\w<>$]+\s*\(.+?\.java:?\d*\)"
TRACE_LINE = r"\s*?at\s+(?:[\w<>$\s]+\.)+[\w<>$\s]+\s*(?:.+?\.java:?\d*\))*"
CAUSE = r"Caused by:.*?(?:Exception|Error).*?(?:\s+at.*?\(.*?:\d+\))+"
_PIECES = ["import", "package", "//", "/*", "*/", "class", "=", ";", ";\n", "if", "else", "(", ")", "{", "}", "\n", "\r", " ", "  ", "\n\n", "x", "ab", "a1", "1", ".", "..", "java.", "io.", "EOFException", "Exception", "Error", ":", "at", " at ", "\tat", "a.b(", "A.java", ".java:96)", ".java)", "(A.java:7)", ":7)", "Caused by:", "{noformat}", "{code", "{code}", "{color", "{color:red}", "$", "é", "\xa0"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=40).map("".join))
def test_scans_find_what_the_patterns_find(s):
    spans = lambda p: [m.span() for m in regex.finditer(p, s)]
    assert [n for n, _ in STATEMENTS] == list(R.STATEMENTS)
    for name, pattern in STATEMENTS:
        assert list(R.statements(name, s)) == spans(pattern), name
    assert list(R.matched(R._exception, s)) == spans("(?ms)" + EXCEPTION)
    assert list(R.traces_of(s)) == spans(f"(?ms){EXCEPTION}(?:{REASON})?(?:{TRACE_LINE})*")
    assert list(R.causes_of(s)) == spans("(?ms)" + CAUSE)
    for args, pattern in ((("{noformat}",), X.NOFORMAT_PAIR), (("{code", "}"), X.CODE_PAIR), (("{color", "}"), X.COLOUR_PAIR)):
        assert list(R.pairs_of(s, *args)) == spans(pattern)


def test_long_texts_keep_all_regions(spark):
    """A pattern that once ran out of time on the prose took the regions of all others with it."""
    prose = "some words of prose (with an aside) that go on. " * 6000
    trace = "java.io.EOFException: null\n at org.acme.A.run(A.java:96)\n"
    s = f"{{ see https://q.z/x \n// note\n{trace}{prose}"
    df = spark.createDataFrame([(s,)], "t string")
    got = df.select(R.clean_text(F.col("t"), compat=True).alias("c"), R.found_regions(F.col("t"), "code", True).alias("code"), R.found_regions(F.col("t"), "stack", True).alias("stack")).first()
    assert got.c.error is None and {"url", "stacktrace", "singlecomment"} <= {r.tag for r in got.c.regions}
    assert "singlecomment" in {r.tag for r in got.code} and got.stack
