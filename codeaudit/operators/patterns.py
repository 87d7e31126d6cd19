"""Rules as rows: an algebra of match intervals.

A rule is a tree of ``Node`` rows.  Leaves are expressions on the text of a file; each
match is an interval of characters with the captures that its named groups made.  Inner
nodes combine the matches of their children:

* ``any``: matches of every child;
* ``all``: matches of the first child with role ``match`` that meet the other children:
  another ``match`` covers it or lies in it, an ``inside`` covers it, no ``not`` has the same
  interval, no ``not-inside`` covers it, and ``where`` holds on a capture.  Captures of the
  same name must have equal values in both matches.

All rules are evaluated together, level by level: leaves in one pass over the files, within
the row; covering as a join on file, rule and a bucket of the text; equal captures as a
further key of that join.  No step names a rule, so any number of rules costs as many joins
as the deepest of them.

Leaf kinds: ``regex``; ``indented``, a header whose interval goes on over the lines below it
that are indented deeper; ``braced``, a header that ends in ``{`` and goes on to the matching
``}``.  A capture whose name ends in ``List`` holds names between commas and gives one match
for each, under the name without that ending.  Captures are read from the matched text, so
they must not depend on what stands around it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.arrays import let, running_sums
from codeaudit.functions.plan import once, settled, written
from codeaudit.functions.text import any_of, newline_count
from codeaudit.operators.findings import SOURCE_RANK, as_findings

#: Characters of a bucket; a covering interval is copied to the buckets it reaches.
BUCKET = 2048
LEAVES = ("regex", "indented", "braced")


class Node(NamedTuple):
    """``parent`` is None at the root; ``role`` says what the node is to its parent ``all``.

    ``keyword`` is a literal that every match of a leaf must contain; it is tested before
    the expression.
    """

    rule_id: str
    node: int
    parent: int | None
    kind: str
    expression: str = ""
    role: str = "match"
    capture: str = ""
    keyword: str = ""


class Description(NamedTuple):
    """What findings of a rule say."""

    rule_id: str
    languages: tuple[str, ...]
    severity: str
    category: str
    cwe: str
    message: str
    fix_guidance: str = ""


def groups(expression: str) -> dict[str, int]:
    """The named groups of an expression and their numbers."""
    return dict(re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", re.sub(r"\\k<(\w+)>", r"(?P=\1)", expression))).groupindex)


# --- leaves ----------------------------------------------------------------------------


def spans_in(text: Column, pattern: str) -> Column:
    """Array of (start, match): every match and the number of characters before it."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), found,
        lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), m.alias("match")),
    )

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: p["gap"] + F.length(p["match"]))
        return F.zip_with(
            running_sums(lengths), pairs,
            lambda before, p: F.struct((before + p["gap"]).alias("start"), p["match"].alias("match")),
        )

    return let(pairs, placed)


def _lines(text: Column) -> Column:
    """Array of (start, indent) of lines that are not blank; indent in characters."""
    def placed(lines: Column) -> Column:
        lengths = F.transform(lines, lambda x: (F.length(x) + 1).cast("bigint"))
        each = F.zip_with(
            running_sums(lengths), lines,
            lambda at, x: F.struct(
                at.alias("start"), (F.length(x) - F.length(F.ltrim(x, F.lit(" \t")))).alias("indent"),
                (F.trim(x, F.lit(" \t\r")) == "").alias("blank"),
            ),
        )
        return F.filter(each, lambda l: ~l["blank"])

    return let(F.split(text, "\n", -1), placed)


def _braces(text: Column) -> Column:
    """Array of (start, depth): each brace and how many are open after it."""
    def counted(found: Column) -> Column:
        steps = F.transform(found, lambda b: F.when(b["match"] == "{", 1).otherwise(-1).cast("bigint"))
        return F.zip_with(
            found, F.zip_with(running_sums(steps), steps, lambda before, s: before + s),
            lambda b, depth: F.struct(b["start"].alias("start"), depth.alias("depth")),
        )

    return let(spans_in(text, r"[{}]"), counted)


def _end(kind: str, span: Column, helper: Column, size: Column) -> Column:
    stop = span["start"] + F.length(span["match"])
    if kind == "indented":
        own = F.element_at(F.filter(helper, lambda l: l["start"] <= span["start"]), -1)
        after = F.filter(helper, lambda l: (l["start"] > span["start"]) & (l["indent"] <= own["indent"]))
        return F.when(F.size(after) > 0, F.element_at(after, 1)["start"]).otherwise(size)
    if kind == "braced":
        opened = F.element_at(F.filter(helper, lambda b: b["start"] <= stop - 1), -1)
        after = F.filter(helper, lambda b: (b["start"] > stop - 1) & (b["depth"] < opened["depth"]))
        return F.when(F.size(after) > 0, F.element_at(after, 1)["start"] + 1).otherwise(size)
    return stop


def _captures(expression: str, match: Column) -> Column:
    names = groups(expression)
    if not names:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[
        x for name, i in names.items() for x in (F.lit(name), F.regexp_extract(match, expression, i))
    ]).cast("map<string,string>")


MATCH = "struct<rule_id:string,node:int,start:bigint,stop:bigint,breaks:int,match:string,captures:map<string,string>>"


def leaf_matches(files: DataFrame, nodes: Sequence[Node], languages: dict[str, tuple[str, ...]]) -> DataFrame:
    """(file_id, repo_id, path, rule_id, node, start, stop, line, col, match, captures) of all leaves."""
    text, size = F.col("content"), F.length("content").cast("bigint")

    def may_hold(leaf: Node) -> Column:
        wanted = languages.get(leaf.rule_id, ())
        could = F.col("language").isin(*wanted) if wanted else F.lit(True)
        return could & text.contains(leaf.keyword) if leaf.keyword else could

    def needed(kind: str) -> Column:
        mine = [n for n in leaves if n.kind == kind]
        return any_of([may_hold(n) & text.rlike(n.expression) for n in mine])

    def found(leaf: Node) -> Column:
        helper = {"indented": F.col("_lines"), "braced": F.col("_braces")}.get(leaf.kind)

        def row(span: Column) -> Column:
            return F.struct(
                F.lit(leaf.rule_id).alias("rule_id"), F.lit(leaf.node).alias("node"),
                span["start"].alias("start"), _end(leaf.kind, span, helper, size).alias("stop"),
                newline_count(F.substr(text, F.lit(1), span["start"].cast("int"))).alias("breaks"),
                span["match"].alias("match"), _captures(leaf.expression, span["match"]).alias("captures"),
            )

        return F.when(may_hold(leaf) & text.rlike(leaf.expression), F.transform(spans_in(text, leaf.expression), row)).otherwise(
            F.array().cast(f"array<{MATCH}>")
        ).cast(f"array<{MATCH}>")

    leaves = [n for n in nodes if n.kind in LEAVES]
    kinds = {n.kind for n in leaves}
    prepared = files.select("file_id", "repo_id", "path", "language", "content")
    if "indented" in kinds:
        prepared = prepared.withColumn("_lines", once(F.when(needed("indented"), _lines(text))))
    if "braced" in kinds:
        prepared = prepared.withColumn("_braces", once(F.when(needed("braced"), _braces(text))))
    rows = prepared.withColumn("found", once(F.flatten(F.array(*map(found, leaves)))))
    # line starts are looked up for the files that have matches only
    rows = rows.where(F.size("found") > 0).withColumn("_starts", once(let(
        F.split(text, "\n", -1),
        lambda x: running_sums(F.transform(x, lambda l: (F.length(l) + 1).cast("bigint"))),
    )))
    placed = F.transform("found", lambda m: F.struct(
        *[m[c].alias(c) for c in ("rule_id", "node", "start", "stop", "match", "captures")],
        (m["breaks"] + 1).alias("line"),
        (m["start"] - F.get("_starts", m["breaks"]) + 1).cast("int").alias("col"),
    ))
    rows = rows.select("file_id", "repo_id", "path", F.explode(placed).alias("m"))
    rows = rows.select("file_id", "repo_id", "path", "m.*")
    return _listed(rows)


def _listed(matches: DataFrame) -> DataFrame:
    """One match for each name in a capture that ends in ``List``."""
    many = F.filter(F.map_keys("captures"), lambda k: k.endswith("List"))
    name = F.get("_many", F.lit(0))
    pieces = F.transform(F.split(F.element_at("captures", name), ","), lambda x: F.regexp_extract(x, r"\w+", 0))
    single = F.create_map(F.regexp_replace(name, "List$", ""), F.col("_piece"))
    rows = matches.withColumn("_many", many)
    plain = rows.where(F.size("_many") == 0).drop("_many")
    spread = rows.where(F.size("_many") > 0).withColumn("_piece", F.explode(pieces)).where("_piece <> ''")
    spread = spread.withColumn("captures", F.map_concat(F.map_filter("captures", lambda k, _: k != name), single))
    return plain.unionByName(spread.drop("_many", "_piece"))


# --- inner nodes ----------------------------------------------------------------------


def _heights(nodes: Sequence[Node]) -> dict[tuple[str, int], int]:
    children: dict[tuple[str, int], list[Node]] = {}
    for n in nodes:
        if n.parent is not None:
            children.setdefault((n.rule_id, n.parent), []).append(n)

    def height(key: tuple[str, int]) -> int:
        return 1 + max((height((c.rule_id, c.node)) for c in children.get(key, ())), default=-1)

    return {(n.rule_id, n.node): height((n.rule_id, n.node)) for n in nodes}


def _names(nodes: Sequence[Node]) -> dict[tuple[str, int], set[str]]:
    """The captures that matches of every node have in any case."""
    at = {(n.rule_id, n.node): n for n in nodes}

    def names(key: tuple[str, int]) -> set[str]:
        node = at[key]
        if node.kind in LEAVES:
            return {n.removesuffix("List") for n in groups(node.expression)}
        below = [c for c in nodes if c.rule_id == key[0] and c.parent == node.node and c.role == "match" and c.kind != "where"]
        below = below if node.kind == "any" else below[:1]
        return set.intersection(*(names((c.rule_id, c.node)) for c in below)) if below else set()

    return {key: names(key) for key in at}


def covering(inner: DataFrame, outer: DataFrame, how: str, exact: bool = False) -> DataFrame:
    """Rows of ``inner`` with (``left_semi``) or without (``left_anti``) a covering row of ``outer``.

    Both have file_id, rule_id, target, key, start and stop.  Rows meet in the bucket in
    which the inner one starts, so an interval is compared with those around it only.
    """
    bucket = F.floor(F.col("start") / BUCKET)
    dealt = inner.withColumn("bucket", bucket).alias("i")
    reach = F.sequence(bucket, F.greatest(bucket, F.floor((F.col("stop") - 1) / BUCKET)))
    outer = outer.select("file_id", "rule_id", "target", "key", "start", "stop")
    around = outer.withColumn("bucket", F.explode(reach)).alias("o")
    same = [F.col(f"i.{c}") == F.col(f"o.{c}") for c in ("file_id", "rule_id", "target", "key", "bucket")]
    if exact:
        same += [F.col("i.start") == F.col("o.start"), F.col("i.stop") == F.col("o.stop")]
    else:
        same += [F.col("o.start") <= F.col("i.start"), F.col("i.stop") <= F.col("o.stop")]
    return dealt.join(around, same, how).drop("bucket")


def matches(files: DataFrame, nodes: Sequence[Node], languages: dict[str, tuple[str, ...]]) -> DataFrame:
    """Matches of the roots of all rules."""
    spark, heights, names = files.sparkSession, _heights(nodes), _names(nodes)
    at = {(n.rule_id, n.node): n for n in nodes}
    known = written(leaf_matches(files, nodes, languages), "rule-leaves")

    def pick(rows: DataFrame, chosen: list[tuple[Node, int, list[str]]]) -> DataFrame:
        """Matches of nodes, with the parent they go to and the key of captures shared with it."""
        table = spark.createDataFrame(
            [(n.rule_id, n.node, target, shared) for n, target, shared in chosen],
            "rule_id string, node int, target int, shared array<string>",
        )
        joined = rows.join(F.broadcast(table), ["rule_id", "node"])
        key = F.transform("shared", lambda s: F.element_at("captures", s))
        return joined.withColumn("key", F.array_join(key, "\x00")).drop("shared")

    for level in range(1, max(heights.values(), default=0) + 1):
        inner = [n for n in nodes if heights[n.rule_id, n.node] == level]
        done = []
        either = [
            (c, n.node, []) for n in inner if n.kind == "any" for c in nodes
            if (c.rule_id, c.parent) == (n.rule_id, n.node)
        ]
        if either:
            done.append(pick(known, either).withColumn("node", F.col("target")).drop("target", "key"))
        every = [n for n in inner if n.kind == "all"]
        if every:
            done.append(_all_of(known, nodes, every, names, pick))
        if done:
            new = done[0] if len(done) == 1 else done[0].unionByName(done[1])
            known = known.unionByName(written(new.select(*known.columns), "rule-matches"))
    roots = [(n, n.node, []) for n in at.values() if n.parent is None]
    return pick(known, roots).drop("node", "target", "key")


def _all_of(known: DataFrame, nodes, every, names, pick: Callable) -> DataFrame:
    children = {(n.rule_id, n.node): [c for c in nodes if (c.rule_id, c.parent) == (n.rule_id, n.node)] for n in every}
    plain = {key: [c for c in cs if c.role == "match" and c.kind != "where"] for key, cs in children.items()}
    base = [(plain[key][0], key[1], []) for key in plain if plain[key]]
    rows = pick(known, base).drop("key")
    where = [(c.rule_id, key[1], c.capture, c.expression) for key, cs in children.items() for c in cs if c.kind == "where"]
    if where:
        table = rows.sparkSession.createDataFrame(where, "rule_id string, target int, capture string, expression string")
        conditions = table.groupBy("rule_id", "target").agg(F.collect_list(F.struct("capture", "expression")).alias("where"))
        rows = rows.join(F.broadcast(conditions), ["rule_id", "target"], "left")
        holds = F.forall("where", lambda w: F.coalesce(
            F.rlike(F.element_at("captures", w["capture"]), w["expression"]), F.lit(False)))
        rows = rows.where(F.coalesce(holds, F.lit(True))).drop("where")

    def others(wanted: Callable[[Node, int], bool]) -> list[tuple[int, Node, int, list[str]]]:
        """(turn, child, parent, captures it shares with the base); a parent's children take turns."""
        out = []
        for key, cs in children.items():
            mine = [c for i, c in enumerate(cs) if c.kind != "where" and wanted(c, plain[key].index(c) if c in plain[key] else -1)]
            shared_with = names[key[0], plain[key][0].node] if plain[key] else set()
            out += [
                (turn, c, key[1], sorted(shared_with & names[c.rule_id, c.node])) for turn, c in enumerate(mine)
            ]
        return out

    for role, how in (("match", "left_semi"), ("inside", "left_semi"), ("not", "left_anti"), ("not-inside", "left_anti")):
        found = others(lambda c, place, role=role: c.role == role and (role != "match" or place > 0))
        for turn in sorted({t for t, *_ in found}):
            now = [(c, target, shared) for t, c, target, shared in found if t == turn]
            keys = rows.sparkSession.createDataFrame(
                [(c.rule_id, target, shared) for c, target, shared in now],
                "rule_id string, target int, shared array<string>",
            )
            asked = rows.join(F.broadcast(keys), ["rule_id", "target"])
            rest = rows.join(F.broadcast(keys), ["rule_id", "target"], "left_anti")
            key = F.transform("shared", lambda s: F.element_at("captures", s))
            asked = asked.withColumn("key", F.array_join(key, "\x00")).drop("shared")
            kept = covering(asked, pick(known, now), how, exact=role == "not")
            rows = rest.unionByName(kept.drop("key").select(*rest.columns))
    return rows.withColumn("node", F.col("target")).drop("target")


def pattern_findings(nodes: Sequence[Node], rules: Sequence[Description]) -> Callable[[DataFrame], DataFrame]:
    """A detector for rules given as rows; add it to the ``detectors`` of a scan."""
    def detector(files: DataFrame) -> DataFrame:
        table = files.sparkSession.createDataFrame(
            [(r.rule_id, r.severity, r.category, r.cwe, r.message, r.fix_guidance) for r in rules],
            "rule_id string, severity string, rule_category string, cwe_id string, message string, fix_guidance string",
        )
        rows = matches(files, nodes, {r.rule_id: r.languages for r in rules})
        rows = settled(rows.dropDuplicates(["rule_id", "file_id", "start", "stop"]), *rows.columns)
        rows = rows.join(F.broadcast(table), "rule_id")
        return as_findings(
            rows, file_path=F.col("path"), line=F.col("line"), col=F.col("col"), message=F.col("message"),
            fix_guidance=F.col("fix_guidance"), cwe_id=F.col("cwe_id"), rule_category=F.col("rule_category"),
            snippet=F.array_join(F.slice(F.split("match", "\n"), 1, 3), "\n"),
            source_rank=SOURCE_RANK["config"],
        )

    return detector
