"""Rules joined with files: one pass over the statements of a file.

The patterns are literals of one projection, grouped by language and guarded by
a keyword test, so each is compiled once and most statements cost a few
substring searches.  Matching stays inside the row; only hits are exploded, and
the rule table that is joined to them has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.arrays import let, running_sums
from codeaudit.functions.plan import built, once
from codeaudit.functions.text import any_of, newline_count, stripped, truncated
from codeaudit.sources.catalogue import FIX_GUIDANCE, RULES, TIER_NAMES, Rule

_HITS = "array<struct<rule_id:string,n:int,text:string>>"
_NUMBERED = "array<struct<n:int,k:int,rule_id:string,text:string>>"
_PLACE = "struct<breaks:int,col:int,match:string>"
_PLACED = f"array<{_PLACE}>"
SNIPPET_LINES = 3
#: A pattern that begins so takes the character before a name.
CHARACTER_BEFORE = r"(^|[^"
CONSTANT_NAME = r"^(__name__|__version__|[A-Z0-9_]+)$"
PLACED_VALUE = r"\{([^}]+)\}"
CREDENTIAL_ROUTE = r"""(?i)@app\.\w+\(["'][^"']*(login|auth)"""
MAIN_GUARD_RULE = "python-debug-mode-outside-main-guard"
OWNER_GUARD = r"""^\s*if\s+(?:current_user\.id|session\[["']user_id["']\])\s*==\s*([\w.]+)"""
APP_DECORATOR = r"^\s*@app\.\w+\("
METHOD_CALL = r"^\s+\w+\.\w+\("
FUNCTION_PARAMETERS = r"function\s*\w*\s*\(([^)]*)\)"
ARROW_PARAMETERS = r"\(([^()]*)\)\s*(?::\s*\w+\s*)?=>"
ARROW_PARAMETER = r"(\w+)\s*=>"

#: What every match of a rule without a keyword holds.
OPENINGS = {
    "js-pii-in-logs": r"console\.log|logger\.",
    "python-crlf-injection": r"(?i)response\.headers\[",
    "python-missing-rate-limit": r"(?i)def\s",
    "python-open-redirect": r"(?i)redirect\(",
    "python-pii-in-logs": r"(?i)logg(?:er|ing)\.",
    "sql-missing-rls": r"(?i)create\s+table",
}

#: For rules with a common keyword: texts of which every match holds one.  They begin with rare
#: characters, since a search stops at each place of the first one.
HELD = {
    "js-eval-user-input": ("val(", "Timeout(", "Function("),
    "js-hardcoded-secret": ('"', "'", "`"),
    "js-sqli-template-literal": (".query(", ".execute(", ".run(", ".raw("),
    "python-default-credentials": ('"', "'"),
    "python-deserial-eval-exec": ("val(", "xec("),
    "python-graphql-injection": ("xecute(", "query("),
    "python-hardcoded-secret": ('"', "'"),
    "python-html-injection": ("</",),
    "python-nosql-injection": (".find(", ".find_one(", ".delete_one(", ".update_one("),
    "python-path-traversal-unsanitized": ("pen(", "_file("),
    "python-ssrf-user-controlled-url": ("quests.", "px.", "urlopen("),
    "python-token-in-url": ("={",),
    "python-weak-session-token": ("uuid4(", ".random(", ".randint(", ".randrange("),
}


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The catalogue as a table, one row per rule; append rows to add rules."""
    rows = [
        (
            r.rule_id, r.pack, list(r.languages), r.severity, r.category, r.cwe, r.scope,
            list(r.tier_names), effective_pattern(r), r.negative, r.keyword, r.message,
            FIX_GUIDANCE.get(r.category, ""),
        )
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, pack string, languages array<string>, severity string, "
        "category string, cwe string, scope string, tiers array<string>, pos_regex string, "
        "neg_regex string, keyword string, message string, fix_guidance string",
    )


def rule_tiers(spark: SparkSession, rules=RULES) -> DataFrame:
    """One row per rule and tier the rule runs in."""
    return rule_table(spark, rules).select("rule_id", "pack", F.explode("tiers").alias("tier"))


def listed_rules(
    table: DataFrame, language: str = "", severity: str = "", category: str = ""
) -> DataFrame:
    """The catalogue as listed: filters are case-insensitive and all must hold."""
    kept = table
    if language:
        kept = kept.where(F.array_contains("languages", language.lower()))
    if severity:
        kept = kept.where(F.upper("severity") == severity.upper())
    if category:
        kept = kept.where(F.lower("category") == category.lower())
    return kept.select(
        "rule_id",
        F.array_join("languages", ",").alias("languages"),
        F.upper("severity").alias("severity"),
        "category",
        F.split_part(F.col("cwe"), F.lit(":"), F.lit(1)).alias("cwe"),
        truncated(F.col("message")).alias("description"),
    )


def effective_pattern(rule: Rule) -> str:
    """Statements span lines, so the dot matches line breaks except in whole-file rules."""
    return rule.positive if rule.scope == "F" else (
        "(?s)" + rule.positive if rule.positive else ""
    )


def _negative(rule: Rule) -> str:
    return "(?s)" + rule.negative if rule.negative else ""


def _matches(rule: Rule, text: Column) -> Column:
    found = text.rlike(effective_pattern(rule))
    return text.contains(rule.keyword) & found if rule.keyword else found


def _enabled(rule: Rule, tier: Column | None) -> Column:
    if tier is None or len(rule.tiers) == len(TIER_NAMES):
        return F.lit(True)
    return tier.isin(*rule.tier_names)


# --- conditions on the lines around a statement ---------------------------------


def _any_line_before(n: Column, pattern: str) -> Column:
    return F.exists(
        F.slice(F.col("code"), F.lit(1), F.greatest(n - 1, F.lit(0))),
        lambda l: l.sig & l.m.rlike(pattern),
    )


def _outside_main_guard(rule: Rule, s: Column, i: Column) -> Column:
    above = F.filter(
        F.slice(F.col("code"), F.lit(1), F.greatest(s.n - 1, F.lit(0))),
        lambda l: l.sig & (l.indent == 0) & (l.stmt_end > 0),
    )
    guarded = F.get(above, F.size(above) - 1).m.rlike(rule.negative)
    return (s.indent == 0) | ~F.coalesce(guarded, F.lit(False))


def _unowned_record(rule: Rule, s: Column, i: Column) -> Column:
    pattern = effective_pattern(rule)
    model = F.regexp_extract(s.text, pattern, 1)
    record = F.regexp_extract(s.text, pattern, 3)
    guards = F.filter(
        F.slice(F.col("code"), F.lit(1), F.greatest(s.n - 1, F.lit(0))),
        lambda l: l.sig & l.m.rlike(rule.negative),
    )
    return (model == F.regexp_extract(s.text, pattern, 2)) & ~F.exists(
        guards, lambda l: F.regexp_extract(l.m, OWNER_GUARD, 1) == record
    )


def _route_without_limit(rule: Rule, s: Column, i: Column) -> Column:
    before = F.reverse(F.slice(F.col("statements"), F.lit(1), i))
    first_other = F.array_position(
        F.transform(before, lambda p: F.ltrim(p.text, F.lit(" \t")).startswith("@")), F.lit(False)
    ).cast("int")
    decorators = F.when(first_other > 0, F.slice(before, F.lit(1), first_other - 1)).otherwise(
        before
    )
    return F.exists(decorators, lambda d: d.text.rlike(APP_DECORATOR)) & ~F.exists(
        decorators, lambda d: d.text.rlike(rule.negative)
    )


def _check_then_act(rule: Rule, s: Column, i: Column) -> Column:
    code = F.col("code")
    after = F.filter(
        F.slice(code, s.e + 1, F.greatest(F.size(code) - s.e, F.lit(0))), lambda l: l.sig
    )
    first_out = F.array_position(
        F.transform(after, lambda l: l.indent <= s.indent), F.lit(True)
    ).cast("int")
    body = F.when(first_out > 0, F.slice(after, F.lit(1), first_out - 1)).otherwise(after)
    transactions = F.filter(
        F.slice(code, F.lit(1), F.greatest(s.n - 1, F.lit(0))),
        lambda l: l.sig & (l.indent < s.indent) & l.m.rlike(rule.negative),
    )
    enclosed = F.exists(
        transactions,
        lambda w: ~F.exists(
            F.slice(code, w.n + 1, F.greatest(s.n - w.n - 1, F.lit(0))),
            lambda l: l.sig & (l.indent <= w.indent),
        ),
    )
    return F.exists(body, lambda l: l.m.rlike(METHOD_CALL)) & ~enclosed


def _no_replace_above(rule: Rule, s: Column, i: Column) -> Column:
    return ~_any_line_before(s.n, rule.negative)


def _no_policy_after(rule: Rule, s: Column, i: Column) -> Column:
    return ~F.exists(
        F.slice(F.col("raw"), s.n, F.greatest(F.size("raw") - s.n + 1, F.lit(0))),
        lambda x: x.rlike(rule.negative),
    )


def _plain_start_with_login(rule: Rule, s: Column, i: Column) -> Column:
    return ~s.text.rlike(rule.negative) & F.col("content").rlike(CREDENTIAL_ROUTE)


BLOCK_CONDITIONS = {
    "python-crlf-injection": _no_replace_above,
    MAIN_GUARD_RULE: _outside_main_guard,
    "python-idor": _unowned_record,
    "python-missing-rate-limit": _route_without_limit,
    "python-race-condition-balance": _check_then_act,
    "sql-missing-rls": _no_policy_after,
    "python-missing-tls": _plain_start_with_login,
}


def _no_hits() -> Column:
    return F.array().cast(_HITS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _held(rule: Rule) -> tuple[str, ...]:
    return HELD.get(rule.rule_id, ()) if rule in RULES else ()


def _may_match(rule: Rule, text: Column) -> Column:
    """False only where no statement of ``text``, all of a file's, can meet the rule."""
    if rule.keyword:
        held = [text.contains(word) for word in _held(rule)]
        return text.contains(rule.keyword) & any_of(held) if held else text.contains(rule.keyword)
    opening = OPENINGS.get(rule.rule_id) if rule in RULES else None
    return text.rlike(opening) if opening else F.lit(True)


def _plain_hits(rule: Rule, k: int, rows: str) -> Column:
    """Hits of a rule that reads a statement alone; as one expression, since there are many."""
    test = f"rlike(s.text, {_quoted(effective_pattern(rule))})"
    held = " OR ".join(f"contains(s.text, {_quoted(word)})" for word in _held(rule))
    if held:
        test = f"({held}) AND {test}"
    if rule.keyword:
        test = f"contains(s.text, {_quoted(rule.keyword)}) AND {test}"
    if rule.negative:
        test += f" AND NOT rlike(s.text, {_quoted(_negative(rule))})"
    if rule.rule_id == "python-log-injection":
        values = f"regexp_extract_all(s.text, {_quoted(PLACED_VALUE)}, 1)"
        test += f" AND exists({values}, v -> NOT rlike(v, {_quoted(CONSTANT_NAME)}))"
    return F.expr(
        f"transform(filter({rows}, s -> {test}), s -> "
        f"named_struct('n', s.n, 'k', {k}, 'rule_id', {_quoted(rule.rule_id)}, 'text', s.text))"
    )


def _block_hits(rule: Rule, k: int) -> Column:
    def hit(s, i):
        return _matches(rule, s.text) & BLOCK_CONDITIONS[rule.rule_id](rule, s, i)

    return F.transform(
        F.filter("statements", hit),
        lambda s: F.struct(
            s.n.alias("n"), F.lit(k).alias("k"), F.lit(rule.rule_id).alias("rule_id"), s.text.alias("text")
        ),
    )


def _statement_hits(rules, tier, rows: str = "statements") -> Column:
    """Hits in order of statements, then of rules; a rule looks at statements only where the
    file's statements, taken as one text, can hold a match."""
    if not rules:
        return _no_hits()
    text = F.col(f"{rows}_text")
    found = [
        F.when(
            _enabled(r, tier) & _may_match(r, text),
            (_block_hits(r, k) if r.scope == "B" else _plain_hits(r, k, rows)).cast(_NUMBERED),
        ).otherwise(F.array().cast(_NUMBERED))
        for k, r in enumerate(rules)
    ]
    return F.transform(
        F.array_sort(F.flatten(F.array(*found))),
        lambda h: F.struct(h["rule_id"].alias("rule_id"), h["n"].alias("n"), h["text"].alias("text")),
    ).cast(_HITS)


def _file_condition(rule: Rule, text: Column) -> Column:
    cond = _matches(rule, text)
    if rule.rule_id == "dockerfile-missing-user":
        users = F.regexp_extract_all(text, F.lit(r"(?im)^USER\s+(\S+)"), F.lit(1))
        return cond & ~F.exists(users, lambda u: F.lower(u) != "root")
    if rule.negative:
        cond = cond & ~text.rlike(rule.negative)
    return cond


def _file_hits(rules, tier) -> Column:
    text = F.col("file_text")
    found = F.array(
        *[
            F.when(
                _enabled(r, tier) & _file_condition(r, text),
                F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(1).alias("n"), text.alias("text")),
            )
            for r in rules
        ]
    )
    return F.array_compact(found).cast(_HITS) if rules else _no_hits()


def _piece_hits(rules, tier) -> Column:
    """Rules over the pieces between semicolons; computed only where a keyword occurs."""
    if not rules:
        return _no_hits()
    text = F.col("file_text")
    pieces = F.split(text, ";", -1)
    names = F.flatten(
        F.transform(
            F.concat(
                F.regexp_extract_all(text, F.lit(FUNCTION_PARAMETERS), F.lit(1)),
                F.regexp_extract_all(text, F.lit(ARROW_PARAMETERS), F.lit(1)),
                F.regexp_extract_all(text, F.lit(ARROW_PARAMETER), F.lit(1)),
            ),
            lambda p: F.transform(F.split(p, ","), lambda x: F.regexp_extract(x, r"\w+", 0)),
        )
    )

    def condition(rule, piece):
        cond = _matches(rule, piece)
        if rule.negative:
            cond = cond & ~piece.rlike(_negative(rule))
        if rule.rule_id == "js-prototype-pollution-unsafe-assign":
            source = F.regexp_extract(piece, effective_pattern(rule), 1)
            cond = cond & (source.contains(".") | F.array_contains(names, source))
        return cond

    def hits(piece, i):
        ids = F.array_compact(
            F.array(
                *[
                    F.when(_enabled(r, tier) & condition(r, piece), F.lit(r.rule_id))
                    for r in rules
                ]
            )
        )
        above = F.aggregate(
            F.slice(pieces, F.lit(1), i), F.lit(1), lambda a, p: a + newline_count(p)
        )
        return F.when(
            F.size(ids) > 0,
            F.transform(
                ids, lambda r: F.struct(r.alias("rule_id"), above.alias("n"), piece.alias("text"))
            ),
        ).otherwise(_no_hits())

    wanted = any_of([text.contains(r.keyword) for r in rules])
    return F.when(wanted, F.flatten(F.transform(pieces, hits)).cast(_HITS)).otherwise(_no_hits())


def _by_language(rules, hits) -> Column:
    """``hits`` of the rules of each file's language."""
    found = None
    for lang in sorted({lang for r in rules for lang in r.languages}):
        mine = hits([r for r in rules if lang in r.languages])
        is_lang = F.col("language") == lang
        found = F.when(is_lang, mine) if found is None else found.when(is_lang, mine)
    return _no_hits() if found is None else found.otherwise(_no_hits())


def _own_hits(tier: Column | None, rules) -> Column:
    return _by_language([r for r in rules if r.scope in "LB"], lambda mine: _statement_hits(mine, tier))


def _full_hits(tier: Column | None, rules) -> Column:
    """Hits with imported names written out, where a rule has none in the statement itself."""
    calls = [r for r in rules if r.scope == "L" and "python" in r.languages]
    found = F.filter(
        _by_language(calls, lambda mine: _statement_hits(mine, tier, "variants")),
        lambda h: ~F.exists(
            F.col("_own"), lambda o: (o["rule_id"] == h["rule_id"]) & (o["n"] == h["n"])
        ),
    )
    return F.when(F.size("variants") > 0, found).otherwise(_no_hits())


def _all_hits(tier: Column | None, rules) -> Column:
    whole = _by_language(
        [r for r in rules if r.scope in "FS"],
        lambda mine: F.concat(
            _file_hits([r for r in mine if r.scope == "F"], tier),
            _piece_hits([r for r in mine if r.scope == "S"], tier),
        ),
    )
    return F.concat("_own", "_full", whole)


def with_rule_hits(model: DataFrame, tier: str | None = None, rules=RULES) -> DataFrame:
    """Add ``rule_hits`` to a code model; ``tier`` names the column that gates the rules."""
    def steps():
        gate, mine = F.col(tier) if tier else None, tuple(rules)
        return [once(make(gate, mine)) for make in (_own_hits, _full_hits, _all_hits)]

    own, full, whole = built(("rule_hits", tier, tuple(rules)), steps)
    texts = {
        "file_text": once(F.array_join("raw", "\n")),
        "statements_text": once(F.array_join("statements.text", "\n")),
        "variants_text": once(F.array_join("variants.text", "\n")),
    }
    return (
        model.withColumns(texts)
        .withColumn("_own", own)
        .withColumn("_full", full)
        .withColumn("rule_hits", whole)
        .drop(*texts, "_own", "_full")
    )


def _matches_in(text: Column, pattern: Column) -> Column:
    """Every match of a pattern in a text: (breaks before it, column, matched text).

    Matches and the texts between them follow one another, so a match starts at the
    running sum of the lengths before it; the running sum of the line breaks says in
    which line, and the array of line starts at which column.  Where a pattern begins
    with the character before a name, the match is placed at the name.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    named = pattern.contains(CHARACTER_BEFORE)

    def pair(gap, match):
        lead = F.when(named, F.regexp_extract(match, r"^\W", 0)).otherwise("")
        return F.struct(
            F.concat(gap, lead).alias("gap"), F.substr(match, F.length(lead) + 1).alias("match")
        )

    def paired(f):
        def gaps(between):
            # an empty match at the very start opens no piece of its own
            opened = F.when(F.size(between) > F.size(f), between).otherwise(
                F.concat(F.array(F.lit("")), between)
            )
            return F.slice(opened, F.lit(1), F.size(f))

        return F.zip_with(let(F.split(text, pattern, -1), gaps), f, pair)

    pairs = let(found, paired)

    def before(pairs, measure):
        both = F.transform(pairs, lambda p: (measure(p["gap"]) + measure(p["match"])).cast("bigint"))
        own = F.transform(pairs, lambda p: measure(p["gap"]))
        return F.zip_with(running_sums(both), own, lambda x, y: x + y)

    line_lengths = F.transform(F.split(text, "\n", -1), lambda x: (F.length(x) + 1).cast("bigint"))

    def placed(st):
        return F.transform(
            F.arrays_zip(st["starts"], st["breaks"], st["pairs"]),
            lambda m: F.struct(
                m["breaks"].cast("int").alias("breaks"),
                (m["starts"] - F.get(st["lines"], m["breaks"].cast("int")) + 1).cast("int").alias("col"),
                m["pairs"]["match"].alias("match"),
            ),
        )

    def places(pairs):
        state = F.struct(
            before(pairs, F.length).alias("starts"), before(pairs, newline_count).alias("breaks"),
            pairs.alias("pairs"), running_sums(line_lengths).alias("lines"),
        )
        return let(state, placed)

    whole = F.array(F.struct(F.lit(0), F.lit(1), F.lit("")).cast(_PLACE))
    return F.when(pattern == "", whole).otherwise(let(pairs, places).cast(_PLACED))


def with_lines_around(model: DataFrame, window: int) -> DataFrame:
    """``rule_hits`` with the lines a hit's matches may need around them, and the first one's number.

    Each hit takes its slice while the lines are at hand, so the file's lines need not
    follow every hit.
    """
    def around(h):
        first = F.greatest(h["n"] - window, F.lit(1))
        last = F.least(h["n"] + newline_count(h["text"]) + window, F.size("raw"))
        return F.struct(
            h["rule_id"].alias("rule_id"), h["n"].alias("n"), h["text"].alias("text"),
            first.alias("first"),
            F.slice("raw", first, F.greatest(last - first + 1, F.lit(0))).alias("around"),
        )

    return model.withColumn("rule_hits", once(F.transform("rule_hits", around)))


def located(
    hits: DataFrame, spark: SparkSession, rules=RULES, keep_rank: bool = False,
    window: int | None = None,
) -> DataFrame:
    """Explode hits, look up their rules and place every match: line, column and snippet.

    The line is the first line of the hit text plus the line breaks before the
    match; a rule without a pattern is placed at the first line.  With ``window`` the
    hits are those of ``with_lines_around`` and each row gets its ``context``.
    """
    table = F.broadcast(rule_table(spark, rules)).drop("languages", "tiers")
    rows = hits.withColumn("hit", F.explode("rule_hits")).drop("rule_hits")
    joined = rows.join(table, F.col("hit.rule_id") == F.col("rule_id")).withColumn(
        "_place", F.explode(_matches_in(F.col("hit.text"), F.col("pos_regex")))
    )
    matched = stripped(F.col("_place.match"))
    line = (F.col("hit.n") + F.col("_place.breaks")).cast("int")
    context = []
    if window is not None:
        above = F.greatest(line - window, F.lit(1))
        lines = F.slice("hit.around", above - F.col("hit.first") + 1, line + window - above + 1)
        context = [F.array_join(lines, "\n").alias("context")]
    return joined.select(
        *[c for c in rows.columns if c != "hit"],
        *([F.col("hit.rank").alias("rank")] if keep_rank else []),
        "rule_id",
        "severity",
        "category",
        "cwe",
        "message",
        "fix_guidance",
        line.alias("line"),
        F.col("_place.col").alias("col"),
        F.array_join(F.slice(F.split(matched, "\n"), 1, SNIPPET_LINES), "\n").alias("snippet"),
        *context,
    )

