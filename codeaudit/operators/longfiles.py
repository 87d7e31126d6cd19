"""Statements and blocks of files that are too long for one task.

A file is a number of buckets, rows of consecutive lines, dealt over all tasks.  What a
bucket must know of the lines before it is small and combines associatively:

* whether a triple-quoted text is open: the number of quotes before, modulo 2;
* the depth of open brackets: a bucket turns depth d into max(low, d + sum), or into a
  constant if one of its lines must start a statement, and such functions compose;
* the open blocks: those left open by earlier buckets whose indent is below the least
  indent of a line that closes blocks in each bucket between.

So each of them takes two passes over the buckets: one makes a short summary per bucket,
windows over the summaries of a file give what is carried into each bucket, and the second
pass folds the lines of a bucket from there on.  Line numbers, statements and blocks equal
those of ``operators.code`` on whole files.  Only a statement that spans buckets is put
together from pieces.

A null text has no lines; nor has an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.functions.arrays import let
from codeaudit.functions.plan import once
from codeaudit.functions.text import extension_of, indent_of, split_lines, stripped
from codeaudit.operators.code import (
    JS_BLOCK_OPENER,
    STRUCTURED_LANGUAGES,
    TEXT_CLOSE,
    TEXT_OPEN,
    _BLOCK,
    _CODE,
    _blanked_lines,
    _block_fold,
    _blocks,
    _bracket_fold,
    _measured_lines,
    blanked,
    closes_blocks,
    statement_text,
)
from codeaudit.sources.corpus import language_of

BUCKET_LINES = 512
QUOTES = "\"\"\"|'''"
_KEY = ["file_id", "bucket"]


def buckets_of(files: DataFrame, lines: int = BUCKET_LINES) -> DataFrame:
    """(file_id, language, bucket, first, raw, unended): the lines of files, dealt over tasks.

    ``first`` is the number of lines before the bucket.  ``unended`` marks the last bucket
    of a text without a line break at its end.
    """
    last = F.floor((F.size("raw") - 1) / lines).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("bucket"), F.slice("raw", k * lines + 1, F.lit(lines)).alias("raw"),
                           ((k == last) & ~F.col("content").rlike(r"[\r\n]\z")).alias("unended")),
    )
    rows = (
        files.where(F.length("content") > 0)
        .withColumn("raw", once(split_lines(F.col("content"))))
        .select("file_id", "language", F.inline(parts))
    )
    return _dealt(rows.withColumn("first", F.col("bucket") * lines))


def _dealt(rows: DataFrame) -> DataFrame:
    """Buckets by hash over a fixed number of tasks.

    Their folds cost far more than their bytes tell, so adaptive execution must not put
    small partitions together.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *_KEY)


def read_buckets(spark: SparkSession, paths: str | list[str], lines: int = BUCKET_LINES) -> DataFrame:
    """The buckets of text files, read in splits: no task sees a whole file.

    ``file_id`` is the path.  The last line counts as ended by a line break.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), F.col("value"),
    )
    place = F.row_number().over(Window.partitionBy("file_id", "split").orderBy("seq")) - 1
    parts = (
        rows.withColumn("part", F.floor(place / lines))
        .groupBy("file_id", "split", "part")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("_rows"))
        .withColumn("raw", F.transform("_rows", lambda r: r["value"])).drop("_rows")
    )
    order = Window.partitionBy("file_id").orderBy("split", "part")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = parts.select("file_id", "split", "part", F.size("raw").alias("n")).select(
        "file_id", "split", "part", (F.row_number().over(order) - 1).alias("bucket"),
        F.coalesce(before, F.lit(0)).cast("int").alias("first"),
    )
    name = F.element_at(F.split("file_id", "/"), -1)
    return _dealt(parts.join(places, ["file_id", "split", "part"]).select(
        "file_id", language_of(name, extension_of(name)).alias("language"), "bucket", "raw",
        F.lit(False).alias("unended"), "first",
    ))


def _file_window() -> Window:
    return Window.partitionBy("file_id").orderBy("bucket")


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _masked(text: Column) -> Column:
    """Lines of a bucket with triple-quoted text masked, from the carried quote on."""
    inside = F.when(F.col("in_text"), 1).otherwise(0)

    def masked(segments):
        def hidden(s, i):
            closes = (i < F.size(segments) - 1) | F.col("unended")
            return F.concat(
                F.when(i > 0, F.lit(TEXT_OPEN)).otherwise(""),
                F.regexp_replace(s, r"[^\n]", " "),
                F.when(closes, F.lit(TEXT_CLOSE)).otherwise(""),
            )

        return F.transform(
            segments, lambda s, i: F.when((i + inside) % 2 == 1, hidden(s, i)).otherwise(s)
        )

    return F.split(F.array_join(let(F.split(text, QUOTES, -1), masked), ""), "\n", -1)


def with_code_lines(buckets: DataFrame) -> DataFrame:
    """Add ``_l``, the measured lines of each bucket of a structured file, and ``is_last``."""
    is_py = F.col("language") == "python"
    text = F.array_join("raw", "\n")
    last_line = F.element_at("raw", -1)
    rows = buckets.where(F.col("language").isin(*STRUCTURED_LANGUAGES))
    summary = rows.select(
        *_KEY,
        F.when(is_py, F.regexp_count(text, F.lit(QUOTES))).otherwise(0).alias("quotes"),
        (~is_py & blanked(last_line, F.lit(False)).rlike(JS_BLOCK_OPENER)).alias("opens"),
    )
    order = _file_window()
    carried = summary.select(
        *_KEY,
        (F.coalesce(F.sum("quotes").over(_before(order)), F.lit(0)) % 2 == 1).alias("in_text"),
        F.coalesce(F.lag("opens").over(order), F.lit(False)).alias("opener_before"),
        F.lead("bucket").over(order).isNull().alias("is_last"),
    )
    quoted = is_py & (F.col("in_text") | text.rlike(QUOTES))
    return (
        rows.join(carried, _KEY)
        .withColumn("_m", once(F.when(quoted, _masked(text)).otherwise(F.col("raw"))))
        .withColumn("_l", once(_blanked_lines()))
        .withColumn("_l", once(_measured_lines(F.col("opener_before"))))
        .drop("_m", "in_text", "opener_before", "unended")
    )


def _depth_summary() -> Column:
    """What a bucket does to the depth of open brackets.

    From depth d it leads to sum + max(d, -low), or with ``reset`` to sum + max(0, -low).
    """
    zero = F.struct(F.lit(0).alias("reset"), F.lit(0).alias("sum"), F.lit(0).alias("low"))

    def step(st, l):
        total = F.when(l.seg, 0).otherwise(st["sum"]) + l.delta
        low = F.least(F.when(l.seg, 0).otherwise(st["low"]), total)
        return F.struct(
            F.when(l.seg, 1).otherwise(st["reset"]).alias("reset"), total.alias("sum"), low.alias("low")
        )

    return F.aggregate(F.filter("_l", lambda l: (l.delta != 0) | l.seg), zero, step)


def carried_depth(rows: DataFrame) -> DataFrame:
    """(file_id, bucket, depth): the brackets open before each bucket."""
    folded = rows.select(*_KEY, once(_depth_summary()).alias("d"))
    level = F.col("d.sum") + F.greatest(F.lit(0), -F.col("d.low"))
    is_reset = F.col("d.reset") == 1
    order = _file_window()
    runs = folded.select(
        *_KEY, F.when(is_reset, level).otherwise(F.col("d.sum")).alias("sum"),
        F.when(is_reset, 0).otherwise(F.col("d.low")).alias("low"),
        F.sum("d.reset").over(order).alias("run"),
    )
    inside = Window.partitionBy("file_id", "run").orderBy("bucket")
    summed = runs.withColumn("total", F.sum("sum").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = F.min(F.col("total") - F.col("sum") + F.col("low")).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    after = summed.withColumn("after", F.col("total") + F.greatest(F.lit(0), -lowest))
    return after.select(
        *_KEY, F.coalesce(F.lag("after").over(order), F.lit(0)).cast("int").alias("depth")
    )


def _pieces() -> Column:
    """(s, e, text, indent, sig, open) of the statements of a bucket, in local line numbers.

    A piece with ``s`` 0 goes on from an earlier bucket, an open one goes on in the next.
    """
    lines, size, spans = F.col("_l"), F.size("_l"), F.col("_spans")

    def part(s, e, text, line):
        is_open = (F.col("_f.depth") > 0) & (e == size)
        return F.struct(
            s.cast("int").alias("s"), e.cast("int").alias("e"), text.alias("text"),
            line.indent.alias("indent"), line.sig.alias("sig"), is_open.alias("open"),
        )

    def around(p, k):
        begin = F.greatest(p.s, F.lit(1))
        long = F.transform(
            F.slice(lines, begin, F.least(p.e, F.lit(1))),
            lambda l: part(p.s, p.e, statement_text(F.col("raw"), begin, p.e), l),
        )
        following = F.coalesce(F.get(spans, k + 1).s, size + 1)
        single = F.transform(
            F.slice(lines, p.e + 1, following - p.e - 1),
            lambda l: part(l.n, l.n, F.get(F.col("raw"), l.n - 1), l),
        )
        return F.concat(long, single)

    return F.flatten(F.transform(spans, around))


def _spans_of_bucket() -> Column:
    """Spans of more than one line, after an empty one unless brackets are open before."""
    def span(s, e):
        return F.array(F.struct(s.alias("s"), e.alias("e")))

    found = F.col("_f.spans")
    all_spans = F.when(
        F.col("_f.depth") > 0, F.concat(found, span(F.col("_f.s"), F.size("_l")))
    ).otherwise(found)
    spans = F.filter(all_spans, lambda p: p.e > p.s)
    return F.when(F.get(spans, F.lit(0)).s == 0, spans).otherwise(
        F.concat(span(F.lit(0), F.lit(0)), spans)
    )


def statements(buckets: DataFrame) -> DataFrame:
    """(file_id, line, last_line, indent, text) of the statements of all files.

    Logical statements in files with a code model, else lines that are not blank.
    """
    coded = with_code_lines(buckets)
    rows = (
        coded.join(carried_depth(coded), _KEY)
        .withColumn("_f", once(_bracket_fold(F.col("depth"))))
        .withColumn("_spans", once(_spans_of_bucket()))
        .select(*_KEY, "first", F.inline(_pieces()))
    )
    local = rows.select(
        *_KEY, F.col("s"), (F.col("first") + F.col("s")).alias("line"),
        (F.col("first") + F.col("e")).alias("last_line"), "indent", "text", "sig", "open",
    )
    at_border = (F.col("s") == 0) | F.col("open")
    order = Window.partitionBy("file_id").orderBy("bucket", "s")
    merged = (
        local.where(at_border)
        .withColumn("of", F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).over(order))
        .groupBy("file_id", "of")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "line", "last_line", "indent", "text", "sig"))).alias("p"))
    )
    begin, end = F.get("p", F.lit(0)), F.element_at("p", -1)
    spanning = merged.where(begin["sig"]).select(
        "file_id", begin["line"].alias("line"), end["last_line"].alias("last_line"),
        begin["indent"].alias("indent"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
    )
    plain = (
        buckets.where(~F.col("language").isin(*STRUCTURED_LANGUAGES))
        .select("file_id", "first", F.posexplode("raw").alias("pos", "text"))
        .where(stripped(F.col("text")) != "")
        .withColumn("line", F.col("first") + F.col("pos") + 1)
        .select("file_id", "line", F.col("line").alias("last_line"), indent_of(F.col("text")).alias("indent"), "text")
    )
    whole = local.where(~at_border & F.col("sig")).select("file_id", "line", "last_line", "indent", "text")
    return whole.unionByName(spanning).unionByName(plain)


def _carried_blocks(summary: DataFrame) -> DataFrame:
    """(file_id, bucket, stack): the blocks of earlier buckets open before a bucket.

    A block is carried up to the first bucket that holds a closing line indented no deeper.
    For each indent of open blocks that bucket is a minimum over the buckets behind.
    """
    opened = summary.select("file_id", "bucket", "final", F.inline("open_blocks"))
    floors = summary.select("file_id", "bucket", "least")
    backward = Window.partitionBy("file_id", "indent").orderBy(F.desc("bucket"))
    closing = (
        floors.join(opened.select("file_id", "indent").distinct(), "file_id")
        .withColumn(
            "closed_in",
            F.min(F.when(F.col("least") <= F.col("indent"), F.col("bucket"))).over(_before(backward)),
        )
        .select("file_id", "indent", "bucket", "closed_in")
    )
    until = F.coalesce("closed_in", "final")
    carried = (
        opened.where(F.col("bucket") < F.col("final"))
        .join(closing, ["file_id", "indent", "bucket"])
        .select(
            "file_id", F.explode(F.sequence(F.col("bucket") + 1, until)).alias("bucket"),
            F.struct("line", "indent", "kind", "name").alias("block"),
        )
        .groupBy("file_id", "bucket")
        .agg(F.sort_array(F.collect_list("block")).alias("stack"))
    )

    def with_parent(b, i):
        parent = F.get(F.col("stack"), i - 1)
        return F.struct(
            b["line"].alias("line"), b["indent"].alias("indent"), b["kind"].alias("kind"), b["name"].alias("name"),
            F.coalesce(parent["line"], F.lit(0)).alias("parent_line"),
            F.coalesce(parent["kind"], F.lit("")).alias("parent_kind"),
        )

    return carried.withColumn("stack", F.transform("stack", with_parent).cast(f"array<{_BLOCK}>"))


def blocks(buckets: DataFrame) -> DataFrame:
    """(file_id, line, last_line, indent, kind, name, parent_line, parent_kind) of Python blocks."""
    def numbered(l):
        kept = [l[c].alias(c) for c in ("m", "b", "indent", "seg", "sig")]
        n = (l.n + F.col("first")).cast("int").alias("n")
        return F.struct(n, *kept, F.lit(0).alias("stmt_end"))

    coded = (
        with_code_lines(buckets.where("language = 'python'"))
        .withColumn("code", once(F.transform("_l", numbered).cast(_CODE)))
        .drop("_l", "raw")
    )
    sig = F.filter("code", lambda l: l.sig)
    closers = F.filter("code", lambda l: l.sig & closes_blocks(l))
    summary = coded.withColumn("_f", once(_block_fold())).select(
        *_KEY, F.col("_f.stack").alias("open_blocks"),
        F.array_min(F.transform(closers, lambda l: l.indent)).alias("least"),
        F.array_max(F.transform(sig, lambda l: l.n)).alias("at"),
    )
    whole_file = Window.partitionBy("file_id")
    summary = summary.withColumn("final", F.max("bucket").over(whole_file))
    before = summary.select(
        *_KEY, F.coalesce(F.max("at").over(_before(_file_window())), F.lit(0)).alias("last")
    )
    no_blocks = F.array().cast(f"array<{_BLOCK}>")
    folded = (
        coded.join(before, _KEY).join(_carried_blocks(summary), _KEY, "left")
        .withColumn("stack", F.coalesce("stack", no_blocks))
        .withColumn("_f", once(_block_fold(F.col("stack"), F.col("last"))))
    )
    found = F.when(F.col("is_last"), _blocks()).otherwise(F.col("_f.done"))
    return folded.select("file_id", F.inline(found)).select(
        "file_id", "line", F.col("end").alias("last_line"), "indent", "kind", "name",
        "parent_line", "parent_kind",
    )
