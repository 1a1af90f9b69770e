import re

from pyspark.sql import functions as F

from arborlens.functions import globs, paths, text, tokens


def one(values):
    return [(v,) for v in values]


def test_suffix_and_language(column_values):
    cases = {
        ".env": "", "foo.": "", "a.test.ts": ".ts", "..foo": ".foo", "Dockerfile": "", ".a.b": ".b",
        "x.PY": ".py", "a.b/c": "", "dir/.env": "", "a/b.tar.gz": ".gz",
    }
    assert column_values("p string", one(cases), paths.suffix(F.col("p"))) == list(cases.values())
    known = {
        "main.py": "python", "app.ts": "typescript", "index.js": "javascript", "lib.rs": "rust",
        "main.go": "go", "unknown.xyz": None, "UP.JS": "javascript", "Makefile": None, "a/b.svelte": "svelte",
    }
    assert column_values("p string", one(known), paths.language(F.col("p"))) == list(known.values())


def test_binary(column_values):
    cases = {"image.png": True, "font.woff2": True, "code.py": False, "config.yaml": False, "logo.SVG": True}
    assert column_values("p string", one(cases), paths.is_binary(F.col("p"))) == list(cases.values())


def test_entrypoints(column_values):
    cases = [
        (("src/main.py", "python"), True), (("src/index.ts", "typescript"), True),
        (("src/utils.py", "python"), False), (("src/helpers.ts", "typescript"), False),
        (("cmd/a/b.go", "go"), True), (("cmd/b.go", "go"), False), (("x/cmd/a/b.go", "go"), False),
        (("lib/main.go", "go"), True), (("Main.py", "python"), False), (("main.py", None), False),
    ]
    expression = paths.is_entrypoint(F.col("p"), F.col("l"))
    assert column_values("p string, l string", [c for c, _ in cases], expression) == [w for _, w in cases]


EXCLUDES = [
    ("**/*.test.*", "src/app.test.ts", True), ("**/*.test.*", "app.test.ts", True),
    ("**/node_modules/**", "node_modules/pkg/index.js", True), ("**/*.test.*", "src/app.ts", False),
    ("vendor", "vendor/x.py", False), ("vendor", "vendor", True), ("*.test.*", "src/a.test.ts", False),
    ("a[bc].py", "ab.py", False), ("a[bc].py", "a[bc].py", True), ("?.py", "a.py", True),
    ("?.py", "/.py", False), ("src/**", "src/a/b", True), ("src/**", "Src/a", False),
    ("a.b", "axb", False), ("**x", "a/b/x", True), ("a+b (1)", "a+b (1)", True), ("é_#*", "é_#1", True),
]


def test_exclude_globs(column_values):
    for pattern, path, wanted in EXCLUDES:
        expression = globs.anchored([globs.exclude_body(pattern)])
        assert column_values("p string", [(path,)], F.col("p").rlike(expression)) == [wanted], pattern
        assert bool(re.search(expression.replace(r"\z", r"\Z"), path)) == wanted, pattern


def test_tree_globs():
    def matches(pattern, path):
        return re.search(globs.tree_regex(pattern).replace(r"\z", r"\Z"), path) is not None

    assert matches("docs/**/*.md", "docs/a.md") and matches("docs/**/*.md", "docs/x/y/a.md")
    assert not matches("docs/**/*.md", "docs/a.txt") and not matches("docs/**/*.md", "x/docs/a.md")
    assert matches("a[bc].py", "ab.py") and not matches("a[!bc].py", "ab.py") and matches("a[!bc].py", "ad.py")
    assert matches("*/x.py", "a/x.py") and not matches("*/x.py", "a/b/x.py") and matches("[]]", "]")
    assert not matches("src/**", "src/a.py")  # a final ** stands for folders only


def test_orders(column_values):
    walk = ["a.py", "z.py", "a/x.py", "a/b/c.py", "a-b/q.py", "b/z.py"]
    keys = column_values("p string", one(walk), paths.walk_key(F.col("p")))
    assert keys == sorted(keys)
    parts = column_values("p string", one(["a/x.py", "a-b/q.py"]), paths.parts_key(F.col("p")))
    assert parts == sorted(parts) and "a-b/q.py" < "a/x.py"


def test_path_parts(column_values):
    p = F.col("p")
    rows = one(["a/b/c.py", "c.py"])
    wanted = [("c.py", "a/b", 2, "a", "    c.py"), ("c.py", "", 0, "root", "c.py")]
    got = column_values(
        "p string", rows, paths.base_name(p), paths.parent(p), paths.depth(p), paths.group_key(p), paths.tree_line(p)
    )
    assert got == wanted
    cases = {"a/./b/../c": "a/c", "../x": None, "a/..": ".", "a//b/": "a/b", "/a": "a", "a/../../b": None, ".": "."}
    assert column_values("p string", one(cases), paths.normalise(p)) == list(cases.values())


def test_decode(column_values):
    cases = {
        b"ab\xff": "ab", b"a\xffb": "ab", "a�b".encode(): "a�b", b"a\r\nb\rc\n": "a\nb\nc\n",
        "\U0001f600".encode(): "\U0001f600", b"\xed\xa0\x80x": "x", b"\xc0\x80\xf5y\xe2\x82": "y",
        "�".encode() + b"\xff\xe2\x82A": "�A", "﷐b﷐a�".encode() + b"\xc3": "﷐b﷐a�",
        b"": "", b"\r": "\n", b"\xf0\x9f\x98": "", b"\xf0\x9f\x98(": "(",
    }
    for raw, wanted in cases.items():
        assert wanted == raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
    rows = [(bytearray(c),) for c in cases]
    assert column_values("c binary", rows, text.decode(F.col("c"))) == list(cases.values())


def test_comments(column_values):
    cases = [
        (("total += 3 # add up\nprint(total)\n", "python"), "total += 3 \nprint(total)\n"),
        (("a = '#no'\n", "python"), "a = '\n"),
        (('"""doc\nmore"""x\n\'\'\'y\'\'\'', "python"), "x\n"),
        (("let n = go(); // why\n/* a\nb */ stop();\n", "javascript"), "let n = go(); \n stop();\n"),
        (("u = 'http://x'\n", "javascript"), "u = 'http:\n"),
        (("a { } // kept /* gone */", "css"), "a { } // kept "),
        (("<b><!-- x\ny --></b>", "html"), "<b></b>"),
        (("a # b\nc // d /* e */", "php"), "a \nc "),
        (("# kept", None), "# kept"), (("# kept", "yaml"), "# kept"), (("/* open", "c"), "/* open"),
        (("a // x\r b", "c"), "a "),
    ]
    expression = text.strip_comments(F.col("c"), F.col("l"))
    assert column_values("c string, l string", [c for c, _ in cases], expression) == [w for _, w in cases]


def test_whitespace(column_values):
    lines = "top\n\n\n\n\nend\n"
    cases = [
        ((lines, "aggressive"), "top\nend"), ((lines, "moderate"), "top\n\n\nend\n"), ((lines, "none"), lines),
        (("  a \t\n \t\n\x1c b\x85 \n　", "aggressive"), None), (("a  \nb", "aggressive"), "a \nb"),
        ((" \n\t\n", "aggressive"), ""), (("a\x0b\nb", "other"), "a\x0b\nb"),
    ]

    def plain(content):
        content = re.sub(r"[ \t]+$", "", content, flags=re.MULTILINE)
        return re.sub(r"\n{2,}", "\n", content).strip()

    expression = text.collapse_whitespace(F.col("c"), F.col("m"))
    got = column_values("c string, m string", [c for c, _ in cases], expression)
    for (content, mode), wanted, value in zip([c for c, _ in cases], [w for _, w in cases], got):
        assert value == (plain(content) if wanted is None else wanted)
    again = column_values("c string, m string", [(g, "aggressive") for g in got], expression)
    assert again == [plain(g) for g in got]


def test_tokens(column_values):
    rows = one(["a" * 400, "", "abc", "éé" * 2])
    assert column_values("c string", rows, tokens.estimate(F.col("c"))) == [100, 0, 0, 1]
    words = tokens.counter_from(lambda: str.split)
    assert column_values("c string", one(["a b c", ""]), words(F.col("c"))) == [3, 0]


def test_fixed_point(column_values):
    values = [0.15, 1.15, 1.25, 1.35, 1.45, 0.05, 2.675, 1e-9, 12345.65, 0.0, 99.95, 0.00005, 1.0, -1.25, 0.125, 1e6 + 0.5]
    for digits in (1, 2, 4):
        got = column_values("x double", one(values), text.fixed_point(F.col("x"), digits))
        assert got == [f"{v:.{digits}f}" for v in values]


def test_bracket_classes_as_fnmatch():
    import fnmatch
    import re

    names = ["[post-id].ts", "a", "b", "z", "-", "]", "!", "p.ts", "pages", "\\", "^", "d"]
    for pattern in ("[post-id].ts", "[z-a]", "[!a]", "[]a]", "[!]a]", "[a-]", "[!z-a]", "[a-cx-z]", "[^a]", "[\\]"):
        ours = re.compile(globs.shell_regex(pattern).replace(r"\z", r"\Z"))
        theirs = re.compile(fnmatch.translate(pattern))
        assert [bool(ours.match(n)) for n in names] == [bool(theirs.match(n)) for n in names], pattern
