"""Features of machine-written code and the confidence built from them.

A feature is a Column over one row of the code model (``operators.code``), so
scoring any number of files is a projection: no shuffle, no join, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.arrays import let
from codeaudit.functions.plan import built, once, settled
from codeaudit.functions.text import BLANKS, identifiers, is_blank, stripped
from codeaudit.operators.code import (
    with_blocks,
    with_code,
    with_resolved_statements,
    with_statements,
)
from codeaudit.sources.constants import (
    AI_THRESHOLD,
    FEATURE_TODO,
    MEDIUM_THRESHOLD,
    NAMED_IMPORT,
    PARAMETER_UNDERLINE,
    SECTION_HEADING,
    SIGNAL_WEIGHTS,
    STAR_IMPORT,
    STOCK_NAMES,
    SWALLOWED_EXCEPTION,
)

DOC_OPENING = r"^\s*[rRuU]?(\x02|\"|')"
ASSIGN_TARGETS = r"^\s*([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*(?::[^=]+)?=(?:[^=]|$)"
ANNOTATED_ONLY = r"^\s*([A-Za-z_]\w*)\s*:\s*[\w\[\], .|\"']+$"
PLAIN_ASSIGN = r"^\s*[\w.\[\]\"', ()]+\s*=(?:[^=]|$)"
ANNOTATED_ASSIGN = r"^\s*[\w.]+\s*:\s*[\w\[\], .|\"']+(=.*)?$"
COMPOUND_WORD = r"^\s*(else|elif|except|finally|try|if|for|while|with|def|class|lambda|return)\b"
NAME_ASSIGN = r"^\s*(\w+)\s*=(?:[^=]|$)"
RETURN_NAME = r"^\s*return\s+(\w+)\s*(?:#.*)?$"
CONTINUATION = r"^\s*(else|elif|except|finally)\b|^\s*@"
ISINSTANCE_CALL = r"\bisinstance\(\s*(\w+)"
GET_CALL = r"(?:^|[^\w.])(\w+)\.get\("
SUBSCRIPT = r"(?:^|[^\w.])(\w+)\["
PARAMETERS = r"(?s)def\s+\w+\s*\((.*)\)\s*(?:->[^:]*)?:"


# --- comment features (every language) ---------------------------------------


def is_hash_comment(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)).startswith("#")


def section_headings() -> Column:
    text = F.col("content")
    named = text.contains("Args:") | text.contains("Returns:") | text.contains("Raises:")
    return F.when(named & text.rlike(SECTION_HEADING), 0.25).otherwise(0.0)


def parameter_underline() -> Column:
    text = F.col("content")
    return F.when(
        text.contains("Parameters") & text.rlike(PARAMETER_UNDERLINE), 0.20
    ).otherwise(0.0)


def feature_todo() -> Column:
    text = F.col("content")
    return F.when(text.contains("#") & text.rlike(FEATURE_TODO), 0.20).otherwise(0.0)


def comment_density() -> Column:
    comments = F.size(F.filter("raw", is_hash_comment))
    share = comments / F.greatest(F.size("raw"), F.lit(1))
    return F.when(share > 0.33, 0.10).otherwise(0.0)


def restating_comment_count() -> Column:
    """Comments of six words or more that share three identifiers with code close by."""
    raw = F.col("raw")
    numbered = F.transform(raw, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    candidates = F.filter(
        numbered,
        lambda c: is_hash_comment(c.x) & c.x.rlike(r"^\s*#+\s*[^#\s]\S*(\s+\S+){5}"),
    )

    # each line is judged once, not once for every comment close by
    code_lines = F.transform(raw, lambda x: F.when(~is_blank(x) & ~is_hash_comment(x), x))

    def counted(code_lines):
        def nearby(c):
            first = F.greatest(c.i - 3, F.lit(0))
            code = F.array_compact(F.slice(code_lines, first + 1, c.i + 4 - first))
            return F.struct(c.x.alias("x"), F.array_join(F.slice(code, 1, 3), "\n").alias("code"))

        def overlaps(c):
            def shared(names):
                # a shared identifier stands in the comment, which is looked at before it is cut up
                there = let(F.lower(c.x), lambda x: F.size(F.filter(names, lambda n: x.contains(n))))
                return (
                    (F.size(names) >= 3)
                    & (there >= 3)
                    & (F.size(F.array_intersect(identifiers(c.x), names)) >= 3)
                )

            return (c.code != "") & let(identifiers(c.code), shared)

        return F.size(F.filter(F.transform(candidates, nearby), overlaps))

    return F.when(~F.exists(raw, is_hash_comment), 0).otherwise(let(code_lines, counted))


# --- block features (Python) ---------------------------------------------------


def with_functions(df: DataFrame) -> DataFrame:
    """Add ``functions``: the function blocks with their code lines and what they document."""
    kept = ("line", "end", "kind", "name", "lines", "header_end")

    def body(b):
        lines = F.slice(F.col("code"), b.line, F.greatest(b.end - b.line + 1, F.lit(0)))
        header = F.filter(lines, lambda l: l.sig & stripped(l.b).endswith(":"))
        return F.struct(
            b.line.alias("line"),
            b.end.alias("end"),
            b.kind.alias("kind"),
            b["name"].alias("name"),
            F.transform(
                F.filter(lines, lambda l: l.sig),
                lambda l: F.struct(
                    l.n.alias("n"), l.b.alias("b"), l.indent.alias("indent"),
                    l.stmt_end.alias("stmt_end"),
                ),
            ).alias("lines"),
            F.coalesce(F.get(header, 0).n, b.end).alias("header_end"),
        )

    def inner(f):
        after = F.filter(f.lines, lambda l: l.n > f.header_end)
        first = F.get(after, 0)
        return F.struct(
            *[f[c].alias(c) for c in kept],
            F.transform(
                F.filter(
                    after,
                    lambda l: (l.stmt_end > 0)
                    & (l.indent == first.indent)
                    & ~l.b.rlike(CONTINUATION),
                ),
                lambda l: F.struct(l.n.alias("n"), l.b.alias("b")),
            ).alias("direct"),
            first.alias("first"),
        )

    def documented(f):
        first = f.first
        has_doc = F.coalesce(first.b.rlike(DOC_OPENING), F.lit(False))
        doc = F.when(
            has_doc & first.b.contains("\x02"),
            F.slice(F.col("raw"), first.n, F.greatest(first.stmt_end - first.n + 1, F.lit(0))),
        ).otherwise(F.array().cast("array<string>"))
        written = F.filter(doc, lambda x: F.btrim(x, F.lit(BLANKS + "rRuU\"'")) != "")
        header = F.filter(f.lines, lambda l: l.n <= f.header_end)
        return F.struct(
            *[f[c].alias(c) for c in (*kept, "direct")],
            has_doc.alias("has_doc"),
            F.size(written).alias("doc_lines"),
            (f.end - first.n + 1).alias("body_span"),
            F.array_join(F.transform(header, lambda l: l.b), "\n").alias("header"),
        )

    def steps():
        functions = F.filter("blocks", lambda b: b.kind != "class")
        return [
            once(F.transform(functions, body)),
            once(F.transform("_fn", inner)),
            once(F.transform("_fn", documented)),
        ]

    bodies, inners, whole = built(("functions",), steps)
    return (
        df.withColumn("_fn", bodies)
        .withColumn("_fn", inners)
        .withColumn("functions", whole)
        .drop("_fn")
    )


def long_docstring_count() -> Column:
    return F.size(F.filter("functions", lambda f: (f.doc_lines > 12) & (f.body_span < 20)))


def function_lengths() -> Column:
    spans = F.transform("functions", lambda f: (f.end - f.line + 1).cast("double"))
    return F.filter(spans, lambda n: n > 3)


def length_variation(lengths: Column) -> Column:
    """Population deviation over mean of at least three function lengths, else null."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n >= 3, F.round(F.sqrt(n * squares - total * total) / total, 6))


def function_regularity(variation: Column) -> Column:
    return F.when(variation < 0.30, 0.30).when(variation < 0.60, 0.15).otherwise(0.0)


def stock_name_count() -> Column:
    known = F.array(*[F.lit(n) for n in STOCK_NAMES])

    def hits(s):
        targets = F.when(
            s.text.rlike(COMPOUND_WORD), F.lit("")
        ).when(
            s.text.rlike(ASSIGN_TARGETS), F.regexp_extract(s.text, ASSIGN_TARGETS, 1)
        ).otherwise(F.regexp_extract(s.text, ANNOTATED_ONLY, 1))
        return F.size(
            F.filter(F.split(targets, r"\s*,\s*"), lambda t: F.array_contains(known, t))
        )

    # a target stands before an equals sign or a colon
    assigning = F.filter("statements", lambda s: s.text.contains("=") | s.text.contains(":"))
    return F.aggregate(assigning, F.lit(0), lambda a, s: a + hits(s))


def class_method_counts() -> Column:
    classes = F.filter("blocks", lambda b: b.kind == "class")
    return F.transform(
        classes,
        lambda c: F.size(
            F.filter(
                F.col("blocks"),
                lambda b: (b.kind == "def") & (b.parent_line == c.line),
            )
        ),
    )


def uniform_classes(counts: Column) -> Column:
    spread = F.array_max(counts) - F.array_min(counts)
    return F.when((F.size(counts) > 1) & (spread <= 1), 0.25).otherwise(0.0)


def _public_functions() -> Column:
    return F.filter(
        "functions", lambda f: ~f["name"].startswith("_") & (f.end - f.line + 1 > 5)
    )


def documented_share() -> Column:
    public = _public_functions()
    documented = F.size(F.filter(public, lambda f: f.has_doc))
    return F.when(F.size(public) >= 2, F.round(documented / F.size(public), 6))


def swallowed_exception() -> Column:
    masked = F.array_join(F.transform("code", lambda l: l.m), "\n")
    possible = F.col("content").contains("xcept")
    return F.when(possible & masked.rlike(SWALLOWED_EXCEPTION), 0.25).otherwise(0.0)


def assign_return_count() -> Column:
    """Functions that end in ``v = …; return v`` and use ``v`` nowhere before."""

    def hit(f):
        n = F.size(f.direct)
        assign, ret = F.get(f.direct, n - 2), F.get(f.direct, n - 1)
        name = F.regexp_extract(assign.b, NAME_ASSIGN, 1)
        earlier = F.array_join(
            F.transform(
                F.filter(f.lines, lambda l: (l.n > f.header_end) & (l.n < assign.n)),
                lambda l: l.b,
            ),
            "\n",
        )
        names = F.regexp_extract_all(earlier, F.lit(r"(?:^|[^.\w])([A-Za-z_]\w*)"), F.lit(1))
        return (
            (f.kind == "def")
            & (n >= 2)
            & ret.b.contains("return")
            & (name != "")
            & (F.regexp_extract(ret.b, RETURN_NAME, 1) == name)
            & ~F.array_contains(names, name)
        )

    return F.size(F.filter("functions", hit))


def parameters(header: Column) -> Column:
    """Positional parameters of a signature, without ``self`` and ``cls``."""
    def flat(whole):
        # innermost brackets go first; as many rounds as there are brackets reach any depth
        brackets = F.length(whole) - F.length(F.translate(whole, "([{", ""))
        return F.aggregate(
            F.array_repeat(F.lit(0), brackets),
            whole,
            lambda t, _: F.regexp_replace(t, r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}", ""),
        )

    def before_star(items):
        star = F.array_position(
            F.transform(items, lambda p: p.startswith("*")), F.lit(True)
        ).cast("int")
        return let(star, lambda s: F.when(s > 0, F.slice(items, 1, s - 1)).otherwise(items))

    text = let(F.regexp_extract(header, PARAMETERS, 1), flat)
    return F.filter(
        let(F.transform(F.split(text, ","), stripped), before_star),
        lambda p: p.rlike(r"^[A-Za-z_]\w*") & ~F.regexp_extract(p, r"^\w+", 0).isin("self", "cls"),
    )


def several_parameters(header: Column) -> Column:
    """False where a signature cannot hold two parameters: they are parted by a comma."""
    return header.contains(",")


def isinstance_guard_count() -> Column:
    """Functions that check at least half of two or more parameters in their first half."""

    def hit(f):
        n = F.size(f.direct)
        half = F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int"))
        stop = F.coalesce(F.get(f.direct, half).n, f.end + 1)
        text = F.array_join(
            F.transform(
                F.filter(f.lines, lambda l: (l.n > f.header_end) & (l.n < stop)), lambda l: l.b
            ),
            "\n",
        )
        guarded = F.regexp_extract_all(text, F.lit(ISINSTANCE_CALL), F.lit(1))

        def checked(params):
            return (F.size(params) >= 2) & let(
                F.size(F.array_intersect(params, guarded)),
                lambda shared: (shared > 0) & (shared * 2 >= F.size(params)),
            )

        names = F.transform(parameters(f.header), lambda p: F.regexp_extract(p, r"^\w+", 0))
        has_call = F.exists(f.lines, lambda l: l.b.contains("isinstance("))
        return (f.kind == "def") & several_parameters(f.header) & has_call & let(names, checked)

    return F.size(F.filter("functions", hit))


def double_import() -> Column:
    text = F.col("content")
    star = F.regexp_extract_all(text, F.lit(STAR_IMPORT), F.lit(1))
    named = F.regexp_extract_all(text, F.lit(NAMED_IMPORT), F.lit(1))
    has_star = text.contains("import") & text.contains("*") & text.rlike(STAR_IMPORT)
    both = has_star & F.arrays_overlap(star, named)
    return F.when(both, 0.15).otherwise(0.0)


def exclusive_get_count() -> Column:
    """Functions that read one name by ``.get`` three times and never by subscript."""

    def hit(f):
        text = F.array_join(F.transform(f.lines, lambda l: l.b), "\n")
        gets = F.regexp_extract_all(text, F.lit(GET_CALL), F.lit(1))
        subs = F.regexp_extract_all(text, F.lit(SUBSCRIPT), F.lit(1))
        has_get = F.exists(f.lines, lambda l: l.b.contains(".get("))
        return (f.kind == "def") & has_get & F.exists(
            F.array_distinct(gets),
            lambda g: (F.size(F.filter(gets, lambda x: x == g)) >= 3)
            & ~F.array_contains(subs, g),
        )

    return F.size(F.filter("functions", hit))


def annotation_count() -> Column:
    """Functions with all of two or more parameters and most assignments annotated."""

    def hit(f):
        body = F.filter(
            f.lines,
            lambda l: (l.n > f.header_end) & (l.stmt_end > 0) & ~l.b.rlike(COMPOUND_WORD),
        )

        def mostly(body):
            annotated = F.size(F.filter(body, lambda l: l.b.rlike(ANNOTATED_ASSIGN)))
            plain = F.size(
                F.filter(body, lambda l: l.b.rlike(PLAIN_ASSIGN) & ~l.b.rlike(ANNOTATED_ASSIGN))
            )
            return annotated > 0.60 * (annotated + plain)

        return (
            (f.kind == "def")
            & several_parameters(f.header)
            & let(
                parameters(f.header),
                lambda params: (F.size(params) >= 2) & F.forall(params, lambda p: p.rlike(r"^\w+\s*:")),
            )
            & let(body, mostly)
        )

    return F.size(F.filter("functions", hit))


# --- totals -------------------------------------------------------------------

_PREFIXES = {"comments": "c_", "structure": "s_", "tokens": "t_"}


@dataclass(frozen=True)
class Signal:
    """A feature of the caller's own: points that a row of the code model adds to one signal.

    ``points`` makes the column; null counts as none.  The sum of a signal stays between 0 and 1.
    """

    name: str
    signal: str
    points: Callable[[], Column]

    def __post_init__(self):
        if self.signal not in _PREFIXES:
            raise ValueError(f"unknown signal {self.signal}")

    def column(self) -> tuple[str, Column]:
        value = F.coalesce(self.points().cast("double"), F.lit(0.0))
        return f"{_PREFIXES[self.signal]}own_{self.name}", once(value)


def capped(count: Column, weight: float, limit: float) -> Column:
    return F.round(F.least(count * weight, F.lit(limit)), 4)


def code_model(files: DataFrame) -> DataFrame:
    """Everything the features and the rules read: lines, statements, blocks, functions."""
    coded = with_blocks(with_statements(with_code(files)))
    return with_resolved_statements(with_functions(coded))


def with_features(model: DataFrame, own: Iterable[Signal] = ()) -> DataFrame:
    """Add the features as columns, also the caller's own, then the three signals and the confidence."""
    python = F.col("language") == "python"
    blank = is_blank(F.col("content"))

    def py(feature, default=0.0):
        return F.when(python, feature).otherwise(default)

    def counts():
        return {
            "f_restating": once(restating_comment_count()),
            "f_long_doc": once(py(long_docstring_count(), 0)),
            "f_variation": once(py(length_variation(function_lengths()), None)),
            "f_stock": once(py(stock_name_count(), 0)),
            "f_documented": once(py(documented_share(), None)),
            "f_assign_return": once(py(assign_return_count(), 0)),
            "f_guards": once(py(isinstance_guard_count(), 0)),
            "f_gets": once(py(exclusive_get_count(), 0)),
            "f_annotated": once(py(annotation_count(), 0)),
        }

    def points():
        return {
            "c_headings": once(section_headings()),
            "c_underline": once(parameter_underline()),
            "c_restating": once(capped(F.col("f_restating"), 0.05, 0.15)),
            "c_todo": once(feature_todo()),
            "c_long_doc": once(capped(F.col("f_long_doc"), 0.08, 0.15)),
            "c_density": once(comment_density()),
            "s_regularity": once(function_regularity(F.col("f_variation"))),
            "s_stock": once(F.round(F.least(F.col("f_stock") / 5, F.lit(1.0)) * 0.25, 4)),
            "s_uniform": once(py(uniform_classes(class_method_counts()))),
            "s_documented": once(F.when(F.col("f_documented") >= 0.80, 0.20).otherwise(0.0)),
            "t_swallowed": once(py(swallowed_exception())),
            "t_assign_return": once(capped(F.col("f_assign_return"), 0.15, 0.20)),
            "t_guards": once(capped(F.col("f_guards"), 0.15, 0.20)),
            "t_double_import": once(py(double_import())),
            "t_gets": once(F.when(F.col("f_gets") > 0, 0.10).otherwise(0.0)),
            "t_annotated": once(capped(F.col("f_annotated"), 0.05, 0.10)),
        }

    counted = model.withColumns(built(("feature counts",), counts))
    parts = counted.withColumns(built(("feature points",), points))
    for signal in own:
        parts = parts.withColumn(*signal.column())

    def total(prefix):
        names = [c for c in parts.columns if c.startswith(prefix)]
        added = reduce(lambda a, b: a + b, [F.col(c) for c in names])
        return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), added)), 4)

    scored = parts.withColumns(
        {
            "comments": once(F.when(blank, 0.0).otherwise(total("c_"))),
            "structure": once(total("s_")),
            "tokens": once(total("t_")),
        }
    )
    return scored.withColumn("confidence", once(confidence()))


def confidence() -> Column:
    weighted = reduce(
        lambda a, b: a + b, [F.col(s) * w for s, w in SIGNAL_WEIGHTS.items()]
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted)), 4)


def scan_tier(value: Column, threshold: float = AI_THRESHOLD) -> Column:
    return (
        F.when(value >= threshold, "FULL")
        .when(value >= MEDIUM_THRESHOLD, "MEDIUM")
        .otherwise("CRITICAL_ONLY")
    )


def detect(
    files: DataFrame, threshold: float = AI_THRESHOLD, own: Iterable[Signal] = ()
) -> DataFrame:
    """One row per file: the three signals, the confidence, the tier and the AI flag."""
    scored = with_features(code_model(files), own).withColumns(
        {
            "scan_tier": once(scan_tier(F.col("confidence"), threshold)),
            "is_ai": F.col("confidence") >= AI_THRESHOLD,
        }
    )
    return settled(
        scored, "file_id", "repo_id", "path", "comments", "structure", "tokens", "confidence",
        "scan_tier", "is_ai",
    )
