"""Lines, logical statements, import aliases and blocks of a source file.

One file stays one row: the line table, the statements and the blocks are
arrays built by folds inside the row.  Nothing here shuffles, and a file is
never split over rows, so one source holding most of the files costs no more
than many small ones.

Approximations, since no parser is run: text between triple quotes is masked by
splitting at the quotes; a block ends before the first later code line indented
no deeper than its header (lines that start with a closing bracket do not end
it); several statements on one line count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.arrays import fold, let
from codeaudit.functions.plan import built, once
from codeaudit.functions.text import BLANKS, indent_of, is_blank, split_lines, stripped

STRUCTURED_LANGUAGES = ("python", "javascript", "typescript")

# Marks put where a triple-quoted text opens and closes; counted as brackets.
TEXT_OPEN, TEXT_CLOSE = "\x02", "\x03"

# Three equal quotes, told by the first: most characters cost one test.
TEXT_QUOTES = r"""["'](?:(?<=")""|(?<=')'')"""

# Loops over escapes are possessive: they never need to give back, and a literal
# with many thousand escapes must not exhaust the stack of the regex engine.
_STRING = r""""[^"\\]*(?:\\.[^"\\]*)*+"|'[^'\\]*(?:\\.[^'\\]*)*+'"""
_TEMPLATE = r"`[^`\\]*(?:\\.[^`\\]*)*+`"
PY_COMMENT = f"(?s)({_STRING})|#.*"
PY_STRING = f"(?s){_STRING}"
JS_COMMENT = f"(?s)({_STRING}|{_TEMPLATE})|//.*"
JS_STRING = f"(?s){_STRING}|{_TEMPLATE}"

BRACKETS = r"[(\[{)\]}\x02\x03]"
NO_BRACKETS = r"[^(\[{)\]}\x02\x03]+"
PY_HEADER = r"^\s*(async\s+)?(def|class)\s"
JS_BLOCK_OPENER = r"(=>|\))\s*\{\s*$"
DEF_LINE = r"^\s*(async\s+)?(def|class)\s+(\w+)"
FROM_IMPORT = r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\s+\(?([^()]*)\)?"
PLAIN_IMPORT = r"^\s*import\s+([^()]*)"
FROM_ITEM = r"^\s*(\w+)(?:\s+as\s+(\w+))?\s*$"
AS_ITEM = r"^\s*([\w.]+)\s+as\s+(\w+)\s*$"
DEFINED = r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)"
ASSIGNED = r"^\s*(\w+)\s*=[^=]"
ANY_BINDING = r"(?m)^[ \t]*(?:from[ \t]+[A-Za-z_]|import[ \t].* as )"
IMPORT_ALIAS = r"^\s*(?:from\s+[\w.]+\s+)?import\s+([\w.]+)\s+as\s+(\w+)"

_SPANS = "array<struct<s:int,e:int>>"
_CODE = (
    "array<struct<n:int,m:string,b:string,indent:int,seg:boolean,sig:boolean,stmt_end:int>>"
)
_STATEMENTS = "array<struct<n:int,e:int,indent:int,text:string>>"
_BLOCK = "struct<line:int,indent:int,kind:string,name:string,parent_line:int,parent_kind:string>"
_BLOCKS = (
    "array<struct<line:int,indent:int,kind:string,name:string,parent_line:int,"
    "parent_kind:string,end:int>>"
)


def with_lines(files: DataFrame) -> DataFrame:
    """Add ``raw``, the array of physical lines."""
    return files.withColumn("raw", once(split_lines(F.col("content"))))


def line_table(files: DataFrame) -> DataFrame:
    """One row per physical line, numbered from 1."""
    rows = with_lines(files).select("file_id", "repo_id", "path", "language", F.posexplode("raw"))
    text = stripped(F.col("col"))
    return rows.select(
        "file_id",
        "repo_id",
        "path",
        "language",
        (F.col("pos") + 1).alias("line"),
        F.col("col").alias("raw"),
        text.alias("stripped"),
        indent_of(F.col("col")).alias("indent"),
        (text == "").alias("is_blank"),
        text.startswith("#").alias("is_comment"),
    )


def _masked_lines(content: Column) -> Column:
    def spaces(s: Column) -> Column:
        blank_lines = F.transform(F.split(s, "\n", -1), lambda x: F.repeat(F.lit(" "), F.length(x)))
        return F.when(s.contains("\r"), F.regexp_replace(s, r"[^\r\n]", " ")).otherwise(
            F.array_join(blank_lines, "\n")
        )

    segments = F.split(content, TEXT_QUOTES, -1)
    hidden = F.transform(
        segments,
        lambda s, i: F.when(
            i % 2 == 1,
            F.concat(F.lit(TEXT_OPEN), spaces(s), F.lit(TEXT_CLOSE)),
        ).otherwise(s),
    )
    return let(F.array_join(hidden, ""), split_lines)


def _bracket_delta(blanked: Column, is_py: Column) -> Column:
    # the few brackets of a line are cut out before they are counted one by one
    brackets = F.regexp_replace(blanked, NO_BRACKETS, "")

    def net(opening, closing):
        return F.octet_length(F.translate(brackets, closing, "")) - F.octet_length(
            F.translate(brackets, opening, "")
        )

    return (
        F.when(~blanked.rlike(BRACKETS), F.lit(0))
        .when(is_py, net("([{" + TEXT_OPEN, ")]}" + TEXT_CLOSE))
        .otherwise(net("([", ")]"))
    )


def _structure_lines() -> Column:
    """Lines with triple-quoted text masked; empty for files without a code model."""
    content, masked = F.col("content"), F.slice(
        _masked_lines(F.col("content")), F.lit(1), F.size("raw")
    )
    quoted = (F.col("language") == "python") & (
        content.contains('"""') | content.contains("'''")
    )
    return (
        F.when(quoted, masked)
        .when(F.col("language").isin(*STRUCTURED_LANGUAGES), F.col("raw"))
        .otherwise(F.array().cast("array<string>"))
    )


def blanked(m: Column, is_py: Column) -> Column:
    """A line without its comments and the text of its string literals."""
    start = F.ltrim(m, F.lit(BLANKS))
    py = F.regexp_replace(F.regexp_replace(m, PY_COMMENT, "$1"), PY_STRING, '""')
    js = F.regexp_replace(F.regexp_replace(m, JS_COMMENT, "$1"), JS_STRING, '""')
    return (
        F.when(~m.rlike("[\"'`#/]"), m)
        .when(is_py & start.startswith("#"), F.lit(""))
        .when(~is_py & start.startswith("//"), F.lit(""))
        .when(is_py, py)
        .otherwise(js)
    )


def _blanked_lines() -> Column:
    """Number each line and drop its comments and the text of its string literals."""
    is_py = F.col("language") == "python"
    return F.transform(
        "_m",
        lambda m, i: F.struct((i + 1).alias("n"), m.alias("m"), blanked(m, is_py).alias("b")),
    )


def _measured_lines(opener_before: Column | None = None) -> Column:
    """Add the indent, the bracket balance, and whether a line must start a statement.

    ``opener_before`` tells of lines that are not the first of their file whether the line
    before them opens a block.
    """
    is_py = F.col("language") == "python"

    def starts(l, i):
        # a header begins its line, so it stands in what is left without comments and strings
        header = (l.b.contains("def") | l.b.contains("class")) & l.b.rlike(PY_HEADER)
        after_opener = F.get(F.col("_l"), i - 1).b.rlike(JS_BLOCK_OPENER)
        if opener_before is not None:
            after_opener = F.when(i == 0, opener_before).otherwise(after_opener)
        return F.coalesce(F.when(is_py, header).otherwise(after_opener), F.lit(False))

    return F.transform(
        "_l",
        lambda l, i: F.struct(
            l.n.alias("n"),
            l.m.alias("m"),
            l.b.alias("b"),
            indent_of(l.m).alias("indent"),
            _bracket_delta(l.b, is_py).alias("delta"),
            starts(l, i).alias("seg"),
            (~is_blank(l.b)).alias("sig"),
        ),
    )


def _span(s: Column, e: Column) -> Column:
    return F.array(F.struct(s.alias("s"), e.alias("e")))


def _bracket_fold(depth: Column | None = None) -> Column:
    """Fold the lines that change the depth into the spans with open brackets.

    With brackets open before the first line, ``depth`` of them, a span starts at line 0.
    """
    events = F.filter("_l", lambda l: (l.delta != 0) | l.seg)
    start = {"depth": F.lit(0) if depth is None else depth, "s": F.lit(0), "spans": F.array().cast(_SPANS)}

    def step(st, l):
        cut = l.seg & (st.depth > 0)
        before = F.when(l.seg, 0).otherwise(st.depth)
        after = F.greatest(F.lit(0), before + l.delta)
        spans = F.when(cut, F.concat(st.spans, _span(st.s, l.n - 1))).otherwise(st.spans)
        return F.struct(
            after.alias("depth"),
            F.when((before == 0) & (after > 0), l.n).otherwise(st.s).alias("s"),
            F.when((before > 0) & (after == 0), F.concat(spans, _span(st.s, l.n)))
            .otherwise(spans)
            .alias("spans"),
        )

    return fold(events, start, "spans", step)


def _long_spans() -> Column:
    """Spans of more than one line in order, after an empty one at line 0."""
    last = _span(F.col("_f.s"), F.size("_l"))
    spans = F.when(F.col("_f.depth") > 0, F.concat("_f.spans", last)).otherwise(F.col("_f.spans"))
    return F.concat(_span(F.lit(0), F.lit(0)), F.filter(spans, lambda p: p.e > p.s))


def _code_lines() -> Column:
    """The lines with the last line of the statement each one starts."""
    lines, spans = F.col("_l"), F.col("_spans")

    def placed(l, stmt_end):
        names = ("n", "m", "b", "indent", "seg", "sig")
        return F.struct(*[l[c].alias(c) for c in names], stmt_end.cast("int").alias("stmt_end"))

    def piece(p, k):
        inside = F.transform(
            F.slice(lines, F.greatest(p.s, F.lit(1)), p.e - p.s + 1),
            lambda l, j: placed(l, F.when(j == 0, p.e).otherwise(0)),
        )
        next_start = F.coalesce(F.get(spans, k + 1).s, F.size(lines) + 1)
        outside = F.transform(
            F.slice(lines, p.e + 1, next_start - p.e - 1), lambda l: placed(l, l.n)
        )
        return F.concat(F.when(p.e > 0, inside).otherwise(F.array().cast(_CODE)), outside)

    return F.flatten(F.transform(spans, piece))


def with_code(files: DataFrame) -> DataFrame:
    """Add ``raw`` and ``code``, one element per line of a Python, JS or TS file.

    ``m`` is the line with triple-quoted text masked, ``b`` the same without
    comments and with string literals emptied, ``sig`` tells code lines from
    blank and comment lines, and ``stmt_end`` is the last line of the logical
    statement that starts here (0 inside a statement).  A statement goes on
    while brackets are open; a Python header or the line after a JS block
    opener always starts a new one.
    """
    steps = built(
        ("code",),
        lambda: [
            ("_m", once(_structure_lines())),
            ("_l", once(_blanked_lines())),
            ("_l", once(_measured_lines())),
            ("_f", once(_bracket_fold())),
            ("_spans", once(_long_spans())),
            ("code", once(_code_lines())),
        ],
    )
    df = with_lines(files)
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop("_m", "_l", "_f", "_spans")


def statement_text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(
        F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n"
    )


def _statements() -> Column:
    starts = F.filter("code", lambda l: (l.stmt_end > 0) & l.sig)
    logical = F.transform(
        starts,
        lambda l: F.struct(
            l.n.alias("n"),
            l.stmt_end.alias("e"),
            l.indent.alias("indent"),
            F.when(l.stmt_end == l.n, F.get(F.col("raw"), l.n - 1))
            .otherwise(statement_text(F.col("raw"), l.n, l.stmt_end))
            .alias("text"),
        ),
    )
    physical = F.filter(
        F.transform(
            "raw",
            lambda x, i: F.struct(
                (i + 1).alias("n"), (i + 1).alias("e"), indent_of(x).alias("indent"), x.alias("text")
            ),
        ),
        lambda s: ~is_blank(s.text),
    )
    return (
        F.when(F.col("language").isin(*STRUCTURED_LANGUAGES), logical)
        .otherwise(physical)
        .cast(_STATEMENTS)
    )


def with_statements(coded: DataFrame) -> DataFrame:
    """Add ``statements``: logical statements of structured files, else non-blank lines."""
    return coded.withColumn("statements", built(("statements",), lambda: once(_statements())))


def with_aliases(df: DataFrame) -> DataFrame:
    """Add ``aliases``, the (short, full) name pairs of ``import … as …`` lines."""
    hits = F.filter(
        "raw", lambda x: x.contains("import ") & x.contains(" as ") & x.rlike(IMPORT_ALIAS)
    )
    pairs = F.transform(
        hits,
        lambda x: F.struct(
            F.regexp_extract(x, IMPORT_ALIAS, 2).alias("short"),
            F.regexp_extract(x, IMPORT_ALIAS, 1).alias("full"),
        ),
    )
    return df.withColumn(
        "aliases",
        once(
            F.when(F.col("language") == "python", pairs).otherwise(
                F.array().cast("array<struct<short:string,full:string>>")
            )
        ),
    )


def resolve_aliases(text: Column, aliases: Column) -> Column:
    """Write full module names for aliased ones: ``req.get`` becomes ``requests.get``."""
    return F.aggregate(
        aliases,
        text,
        lambda acc, a: F.when(
            acc.contains(F.concat(a["short"], F.lit("."))),
            F.regexp_replace(
                acc, F.concat(F.lit(r"\b"), a["short"], F.lit(r"\.")), F.concat(a["full"], F.lit("."))
            ),
        ).otherwise(acc),
    )


def with_resolved_statements(df: DataFrame) -> DataFrame:
    """Statements with import aliases written out; other files are left as they are."""
    resolved = F.transform(
        "statements",
        lambda s: F.struct(
            s.n.alias("n"),
            s.e.alias("e"),
            s.indent.alias("indent"),
            resolve_aliases(s.text, F.col("aliases")).alias("text"),
        ),
    )
    rows = with_aliases(df).withColumn(
        "statements",
        once(
            F.when(F.size("aliases") > 0, resolved)
            .otherwise(F.col("statements"))
            .cast(_STATEMENTS)
        ),
    )
    return with_variants(rows)


_BINDINGS = "array<struct<name:string,full:string,n:int,last:int>>"


def _bound_names(s: Column) -> Column:
    """(name, full) of the names that a statement's import binds."""
    text = F.replace(F.regexp_replace(s.text, r"#[^\n]*", ""), F.lit("\\"), F.lit(""))
    module = F.regexp_extract(text, FROM_IMPORT, 1)

    def items(listed: Column, pattern: str) -> Column:
        pieces = F.split(listed, ",", -1)
        return F.filter(F.transform(pieces, lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).alias("item"), F.regexp_extract(x, pattern, 2).alias("short")
        )), lambda i: i["item"] != "")

    def named(i: Column) -> Column:
        name = F.when(i["short"] == "", i["item"]).otherwise(i["short"])
        return F.struct(name.alias("name"), F.concat(module, F.lit("."), i["item"]).alias("full"))

    plain = F.transform(
        items(F.regexp_extract(text, PLAIN_IMPORT, 1), AS_ITEM),
        lambda i: F.struct(i["short"].alias("name"), i["item"].alias("full")),
    )
    return F.when(module != "", F.transform(items(F.regexp_extract(text, FROM_IMPORT, 2), FROM_ITEM), named)).otherwise(plain)


def _bindings() -> Column:
    """The symbol table: every binding of an imported name and the lines it holds on.

    A binding in a block ends with the block.  Definitions and assignments of an imported
    name are bindings without a full name: where they are the last to hold, the name is
    not the imported one.
    """
    def held(s: Column, name: Column, full: Column) -> Column:
        after = F.filter("statements", lambda x: (x.n > s.n) & (x.indent < s.indent))
        last = F.when(s.indent == 0, F.lit(1 << 30)).otherwise(
            F.coalesce(F.get(after, F.lit(0)).n - 1, F.lit(1 << 30))
        )
        return F.struct(
            name.alias("name"), full.alias("full"), s.n.alias("n"), last.cast("int").alias("last")
        )

    imports = F.flatten(F.transform(
        F.filter("statements", lambda s: s.text.contains("import ") & s.text.rlike(r"^\s*(?:from|import)\s")),
        lambda s: F.transform(_bound_names(s), lambda b: held(s, b["name"], b["full"])),
    )).cast(_BINDINGS)

    def with_shadows(found: Column) -> Column:
        names = F.transform(found, lambda b: b["name"])
        binding = F.filter(
            "statements",
            lambda s: s.text.contains("=") | s.text.contains("def") | s.text.contains("class"),
        )
        shadowing = F.filter(binding, lambda s: F.array_contains(names, _rebound(s.text)))
        shadows = F.transform(shadowing, lambda s: held(s, _rebound(s.text), F.lit(None).cast("string")))
        return F.concat(found, shadows.cast(_BINDINGS))

    return F.when(
        (F.col("language") == "python") & F.col("content").rlike(ANY_BINDING), let(imports, with_shadows)
    ).otherwise(F.array().cast(_BINDINGS))


def _rebound(text: Column) -> Column:
    """The name a definition or an assignment gives a new meaning; empty for others."""
    return F.concat(F.regexp_extract(text, DEFINED, 1), F.regexp_extract(text, ASSIGNED, 1))


def _variants() -> Column:
    """Statements in which imported names are used, with these written out in full."""
    names = F.array_sort(F.array_distinct(F.transform("bindings", lambda b: b["name"])))

    def resolved(s: Column, names: Column) -> Column:
        def step(text: Column, name: Column) -> Column:
            holding = F.filter(
                "bindings",
                lambda b: (b["name"] == name) & (s.n <= b["last"])
                & ((b["n"] < s.n) | ((b["n"] == s.n) & b["full"].isNull())),
            )
            full = F.array_max(F.transform(
                holding, lambda b: F.struct(b["n"].alias("n"), b["full"].alias("full"))))["full"]
            written_out = F.regexp_replace(
                text, F.concat(F.lit(r"(^|[^\w.])"), name, F.lit(r"\b")), F.concat(F.lit("$1"), full)
            )
            return F.when(text.contains(name), F.coalesce(written_out, text)).otherwise(text)

        return F.struct(
            s.n.alias("n"), s.e.alias("e"), s.indent.alias("indent"),
            F.aggregate(names, s.text, step).alias("text"),
        )

    def changed(names: Column) -> Column:
        naming = F.filter("statements", lambda s: F.exists(names, lambda x: s.text.contains(x)))
        pairs = F.transform(naming, lambda s: F.struct(s.alias("own"), resolved(s, names).alias("full")))
        return F.transform(
            F.filter(pairs, lambda p: p["own"]["text"] != p["full"]["text"]), lambda p: p["full"]
        )

    return F.when(F.size("bindings") > 0, let(names, changed)).otherwise(F.array()).cast(_STATEMENTS)


def with_variants(df: DataFrame) -> DataFrame:
    """Add ``variants``: statements as they read with the names of imports written out.

    ``loads(x)`` after ``from pickle import loads`` also reads ``pickle.loads(x)``.  The
    statements themselves stay, since rules may name either form.
    """
    bindings, variants = built(("variants",), lambda: (once(_bindings()), once(_variants())))
    return df.withColumn("bindings", bindings).withColumn("variants", variants)


def closes_blocks(l: Column) -> Column:
    return ~F.ltrim(l.m, F.lit(BLANKS)).rlike(r"^[)\]}\x03]")


def _block_fold(stack: Column | None = None, last: Column | None = None) -> Column:
    """One pass over the code lines that keeps the open blocks on a stack.

    A line pops every block indented at least as deep, a header is pushed.  ``stack`` holds
    the blocks open before the first line, ``last`` the last code line before it.
    """
    wanted = F.col("language") == "python"
    if stack is None:  # nothing is open, so a file without headers has no blocks
        wanted = wanted & F.exists("code", lambda l: l.seg)
    lines = F.when(wanted, F.filter("code", lambda l: l.sig)).otherwise(F.array().cast(_CODE))

    def opened(l, stack):
        top = F.get(stack, F.size(stack) - 1)
        is_async = F.regexp_extract(l.m, DEF_LINE, 1) != ""
        word = F.regexp_extract(l.m, DEF_LINE, 2)
        return F.struct(
            l.n.alias("line"),
            l.indent.alias("indent"),
            F.when(is_async, F.concat(F.lit("async "), word)).otherwise(word).alias("kind"),
            F.regexp_extract(l.m, DEF_LINE, 3).alias("name"),
            F.coalesce(top.line, F.lit(0)).alias("parent_line"),
            F.coalesce(top.kind, F.lit("")).alias("parent_kind"),
        )

    def step(st, l):
        # most lines end no block, so the text of a line is looked at last
        pops = F.exists(st.stack, lambda b: b.indent >= l.indent) & closes_blocks(l)
        kept = F.when(pops, F.filter(st.stack, lambda b: b.indent < l.indent)).otherwise(st.stack)
        ended = F.filter(st.stack, lambda b: b.indent >= l.indent)
        is_header = l.seg & l.m.rlike(DEF_LINE)
        done = F.concat(st.done, F.transform(ended, lambda b: _ended(b, st.last)))
        return F.struct(
            F.when(is_header, F.concat(kept, F.array(opened(l, kept)))).otherwise(kept).alias("stack"),
            F.when(pops, done).otherwise(st.done).alias("done"),
            l.n.alias("last"),
        )

    start = {
        "stack": F.array().cast(f"array<{_BLOCK}>") if stack is None else stack,
        "done": F.array().cast(_BLOCKS),
        "last": F.lit(0) if last is None else last,
    }
    return fold(lines, start, "done", step)


def _ended(b: Column, last: Column) -> Column:
    names = ("line", "indent", "kind", "name", "parent_line", "parent_kind")
    return F.struct(*[b[c].alias(c) for c in names], last.alias("end"))


def _blocks() -> Column:
    still_open = F.transform("_f.stack", lambda b: _ended(b, F.col("_f.last")))
    return F.concat("_f.done", still_open).cast(_BLOCKS)


def with_blocks(coded: DataFrame) -> DataFrame:
    """Add ``blocks``: functions and classes of a Python file with their line spans."""
    fold, blocks = built(("blocks",), lambda: (once(_block_fold()), once(_blocks())))
    return coded.withColumn("_f", fold).withColumn("blocks", blocks).drop("_f")
