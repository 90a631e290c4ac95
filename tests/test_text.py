import pytest
from pyspark.sql import functions as F

from vicinity.functions.globs import (
    UnsupportedGlob,
    exclude_paths,
    glob_to_regex,
    is_excluded,
    valid_globs,
)
from vicinity.functions.regexes import RegexDialectError, translate, valid_patterns
from vicinity.functions.text import (
    classify_error,
    embed_text,
    exclude_content,
    min_query_length,
    nonempty_content,
    note_title,
    path_hash,
    strip_frontmatter,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("---\na: 1\n---\nbody\n", "body\n"),
        ("---\n---\nbody", "body"),
        ("intro\n---\na: 1\n---\nbody", "intro\n---\na: 1\n---\nbody"),
        ("---\na: x---y\n--- no\n---\nbody", "body"),
        ("---\na: 1\nbody", "---\na: 1\nbody"),
        ("---\na: 1\n---", ""),
        ("---\r\na: 1\r\n---\r\nbody", "body"),
        ("", ""),
    ],
)
def test_frontmatter(spark, text, want):
    assert one(spark, strip_frontmatter(F.lit(text))) == want


def test_content_exclusion_in_order_and_invalid_skipped(spark):
    text = F.lit("# Title\nkeep me\n%% hidden %%\n# Other\n")
    out = one(spark, exclude_content(text, [r"^#.*$\n?", "(open", r"%%.*?%%", ""]))
    assert out == "keep me\n\n"
    with pytest.raises(RegexDialectError):
        exclude_content(text, ["(open"], strict=True)


@pytest.mark.parametrize(
    "pattern, text, want",
    [
        (r"a.b", "a\u0085b a\nb", " a\nb"),
        (r"x$", "x\u0085 x", "x\u0085 "),
        (r"^y", "y\n\u0085y", "\n\u0085y"),
        (r"\s+", "a 　b", "ab"),
        (r"[^\s]+", "a b", " "),
        (r"\bé", "é aé", "é a"),
        (r"[[]x]", "[x] ]", " ]"),
        (r"[a[]+", "a[b", "b"),
        (r"(?<n>a)\k<n>", "aab", "b"),
        (r"a{", "a{b", "b"),
        (r"[^]", "a\nb", ""),
        (r"\0", "a\x00b", "ab"),
        (r"^z", "z\nz\rz\u2028z\r\nz\u0085z", "\n\r\u2028\r\n\u0085z"),
        (r"z$", "z\nz\rz\u2028z\r\nz\u0085z", "\n\r\u2028\r\nz\u0085"),
        (r"\bthe\b", "the other éthe the_ (the) théé", " other é the_ () théé"),
        (r"\w\b", "ab é", "a é"),
        (r"a?\bb", "ab b", "ab "),
        (r"(?:c|a)\b", "ca c", "c "),
        (r"[xa]\b-", "a- b-", " b-"),
        (r"\x61\b", "a ab", " ab"),
        (r"x{2}\b", "xx xxx", " x"),
        (r"ab\B", "abc ab", "c ab"),
        (r"a{2,3}?", "aaaa", ""),
    ],
)
def test_regex_dialect(spark, pattern, text, want):
    assert one(spark, exclude_content(F.lit(text), [pattern], strict=True)) == want


@pytest.mark.parametrize("pattern", ["(?i)a", "(?>a)", "a++", "a{2}+", "[a", "a\\", "*a", "(a"])
def test_regex_refused(spark, pattern):
    good, bad = valid_patterns(["", pattern, " "])
    assert good == [] and bad == [(2, pattern)]


def test_translate_keeps_plain_patterns():
    assert translate(r"ab+c?[0-9]{2}") == r"(?md)ab+c?[0-9]{2}"


@pytest.mark.parametrize(
    "globs, excluded, kept",
    [
        (
            ["journal/2019/"],
            ["journal/2019/x.md", "journal/2019/05/entry.md"],
            ["journal/2020/x.md", "old/journal/2019/x.md", "journal/2019.md"],
        ),
        (["*.canvas.md", "~*"], ["board.canvas.md", "~lock"], ["deep/board.canvas.md", "canvas.md", "deep/~lock"]),
        (["**/_hr/*"], ["_hr/pay.md", "team/a/_hr/pay.md"], ["team/_hr/2024/pay.md", "team/hr/pay.md"]),
        (
            ["inbox/", "**/*.draft.md", "t-??.md"],
            ["inbox/1.md", "talks/q.draft.md", "q.draft.md", "t-07.md"],
            ["talks/inbox.md", "q.md", "t-7.md", "talks/t-07.md"],
        ),
        (["?/k.md"], ["x/k.md", "é/k.md"], ["xy/k.md", "k.md", "/k.md"]),
        ([], [], ["one/two.md", "three"]),
        ([""], [], ["one/two.md"]),
        (["**"], ["a.md", "b/c.md"], [".a.md", "b/.c/d.md"]),
        (["**.md"], ["a.md", "b/c.md"], ["a.txt"]),
        (["a**b.md"], ["axb.md"], ["a/b.md"]),
        (["*"], ["a.md"], [".hidden.md", "b/a.md"]),
        ([".trash/"], [".trash/x.md", ".trash/y/z.md"], ["trash/x.md"]),
        (["a/**/b.md"], ["a/b.md", "a/x/y/b.md"], ["a/.x/b.md", "ab.md"]),
        (["{a,b/c}/*.md"], ["a/1.md", "b/c/2.md"], ["b/2.md", "c/1.md"]),
        (["{a,{b,c}}.md"], ["a.md", "b.md", "c.md"], ["d.md"]),
        (["x{1..3}.md"], ["x1.md", "x3.md"], ["x4.md"]),
        (["{a}.md"], ["{a}.md"], ["a.md"]),
        (["[ab]*.md"], ["a1.md", "b.md"], ["c.md"]),
        (["[!ab].md"], ["c.md"], ["a.md", "/.md"]),
        (["!keep.md"], ["other.md", "a/b.md"], ["keep.md"]),
        (["a[.md", "b{.md"], ["a[.md", "b{.md"], ["a.md"]),
        (["a+b$^.md"], ["a+b$^.md"], ["aab.md"]),
        ([r"a\*.md"], ["a*.md"], ["ab.md"]),
        (["./x/*.md"], ["x/a.md"], ["y/a.md"]),
        (["a.md"], ["a.md"], ["aXmd", "a.md\n", "b/a.md"]),
    ],
)
def test_globs(spark, globs, excluded, kept):
    df = spark.createDataFrame([(p,) for p in [*excluded, *kept]], "path string")
    left = {r.path for r in exclude_paths(df, globs).collect()}
    assert left == set(kept)


def test_globs_refused_or_dropped():
    for glob in ("@(a|b)", "+(a)", "!(a)", "a|b", "(a)", "{10..20}"):
        with pytest.raises(UnsupportedGlob):
            glob_to_regex(glob)
    assert glob_to_regex("x" * 70000) is None
    assert valid_globs(["a/", "", "  b.md ", "@(c)"]) == (["a/", "b.md"], [(4, "@(c)")])


def test_null_path_is_not_excluded(spark):
    df = spark.createDataFrame([(None,)], "path string")
    assert df.select(is_excluded("path", ["*"]).alias("x")).first()["x"] is False


def test_titles_hash_and_embed_text(spark, table):
    df = table("p string", ("a/b.c/My note.v2.md",), ("x.md",), ("noext",), (".md",))
    assert [r[0] for r in df.select(note_title("p")).collect()] == ["My note.v2", "x", "noext", ""]
    assert one(spark, path_hash(F.lit("é.md"))) == (
        __import__("hashlib").sha256("é.md".encode()).hexdigest()
    )
    df = table("t string, c string, i int", ("T", "one", 0), ("T", "two", 1))
    assert [r[0] for r in df.select(embed_text("t", "c", "i")).collect()] == ["T\n\none", "two"]


def test_nonempty_and_query_length(table):
    df = table("content string", ("",), (None,), ("x",), (" ",))
    assert [r[0] for r in nonempty_content(df).collect()] == ["x", " "]
    df = table("text string", ("",), ("ab",), ("abc",))
    assert [r[0] for r in min_query_length(df).collect()] == ["abc"]
    assert [r[0] for r in min_query_length(df, 1).collect()] == ["ab", "abc"]


def test_error_messages(spark):
    def shown(text, rules=()):
        return one(spark, classify_error(F.lit(text), rules))

    assert shown("WebGPU lost") == "GPU acceleration failed - try disabling GPU in settings"
    assert shown("fetch models/x") == "Network error - check your internet connection"
    assert shown("x" * 101) == "x" * 100 + "..."
    assert shown("x" * 100) == "x" * 100
    assert shown("webgpu", [(("web",), "mine")]) == "mine"
