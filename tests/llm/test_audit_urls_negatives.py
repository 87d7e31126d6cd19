"""Filter interaction, url rules over aliases and hard negatives, against brute force."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from codeaudit.llm import interaction, negatives, redirects, sql

WORDS = " ".join(f"w{i}" for i in range(70))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- filter interaction

DOCS = [
    (1, WORDS, "a"), (2, WORDS, "b"), (2, WORDS, "b"), (3, None, None), (4, "", ""), (5, " \t\n", "a"),
    (None, WORDS, "a"), (None, None, "c"), (6, "same " * 80, "a"), (7, "LOUD " + WORDS, "b"),
    (8, "UP " * 60 + "#", "b"), (9, WORDS + " $", "c"), (10, "é Ü " * 30, "c"), (1, WORDS, "a"),
    (11, "long " * 60_000, "b"), (12, "long " * 60_000, "c"),
]
LABELS = [(1, 1, 1), (1, 0, 0), (2, 1, None), (4, 0, 1), (6, None, None), (None, 1, 1), (8, 1, 0), (12, 1, 1), (99, 1, 1)]


def brute_audit():
    import re

    out, fails = {}, []
    good = {i for i, q, _ in LABELS if i is not None and q == 1}
    toxic = {i for i, _, t in LABELS if i is not None and t == 1}
    for i, text, source in DOCS:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w))
        f += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in DOCS)
        fails.append((source or "", f, i in good, i in toxic))
    for part in {f[0] for f in fails}:
        mine, total = [f for f in fails if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                hit, lost = [f for f in left if name in f[1]], len(mine) - len(left)
                left = [f for f in left if name not in f[1]]
                total[name] += len(hit)
                out[part, order, step] = [
                    len(left), len(hit), sum(name in f[1] for f in mine) - len(hit),
                    sum(f[1] == name for f in mine), sum(f[2] for f in hit), sum(f[3] for f in hit),
                ]
                assert lost == len(mine) - len(left) - len(hit)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def frames(spark):
    extra = "mask int, digest string, words string, rows long, part string, first string"
    docs = spark.createDataFrame(
        [(*r, 7, "d", "w", 9, "p", "f") for r in DOCS], f"doc_id long, text string, source string, {extra}"
    )
    return docs, spark.createDataFrame(
        [(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, text string"
    )


def test_audit_equals_brute_force(spark):
    docs, labels = frames(spark)
    got = {
        (r.part, r.filter_order, r.step):
        (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in interaction.audit(docs, labels).collect()
    }
    assert got == brute_audit()
    assert interaction.audit(docs.limit(0), labels).count() == 0
    assert len(interaction.audit(docs, labels.limit(0)).filter("good_lost > 0").head(1)) == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_solver_gives_shapley_values(n):
    """For every unit game the least squares solution is the textbook weight."""
    weight, rows = interaction.kernel(n), interaction.solver(n)
    for game in range(1, 1 << n):
        worth = {s: int(s == game) for s in range(1 << n)}
        sides = [sum(w * worth[s] for s, w in weight.items() if s >> i & 1) for i in range(n)]
        for i, row in enumerate(rows):
            got = sum(x * y for x, y in zip(row, [*sides, Fraction(worth[(1 << n) - 1])], strict=True))
            k = game.bit_count()
            inside = Fraction(math.factorial(k - 1) * math.factorial(n - k), math.factorial(n))
            outside = Fraction(math.factorial(k) * math.factorial(n - k - 1), math.factorial(n)) if k < n else 0
            assert got == (inside if game >> i & 1 else -outside)


def test_audit_with_filters_of_ones_own(spark):
    from pyspark.sql import functions as F

    docs, labels = frames(spark)
    rows = interaction.audit(docs, labels, {"X": F.col("n_words") == 0}).collect()
    assert {r.filter_order for r in rows} == {"XE", "EX"} and {r.step for r in rows} == {1, 2}


# --- url rules

PAGES = [
    (1, "http://a.example.net/x", '<link rel="canonical" href="https://b.example.com/de/1">'),
    (2, "https://b.example.com/de/1?", None),
    (3, "http://c.example.net/y#top", '<meta http-equiv="refresh" content="0; url=http://a.example.net/x">'),
    (4, "http://d.example.net/z", '<link rel="canonical" href="http://e.example.org/p">'
        '<meta http-equiv="refresh" content="3;url=http://f.com/de/">'),
    (5, "HTTP://E.Example.ORG/p", ""),
    (6, "http://sub.example.org/en/12", "<p>refresh canonical</p>"),
    (7, "http://sub.example.org/en/2", None),
    (8, "http://notexample.org/es/", None),
    (9, "http://example.org/es/", None),
    (10, "http://example.org", None),
    (11, None, '<link rel="canonical" href="https://b.example.com/de/1">'),
    (12, "no scheme", None),
    (None, "http://x.com/fr/a?u=http://y.org/", None),
    (13, "http://x.com/de/a", None), (13, "http://x.com/de/a", None),
    (14, "http://plain.net/", None),
    (15, "http://commented.net/", '<!-- <link rel="canonical" href="https://b.example.com/de/1"> -->'),
    (16, "https://c.example.net:443/y", "x" * 300_000),
]


def pages_of(spark, rows):
    extra = [(*r, "h", "p", "v", "n", "u") for r in rows]
    return spark.createDataFrame(
        extra, "page_id long, url string, html string, host string, path string, verdict string, node string, rule string"
    )


def test_verdicts(spark):
    got = rows_of(redirects.verdicts(pages_of(spark, PAGES), redirects.rule_table(spark)), "page_id", "verdict", "rule", "decided_by")
    want = [
        (1, "block", None, "alias"), (2, "block", "com/de/", "rule"), (3, "block", None, "alias"),
        (4, "allow", None, "none"), (5, "allow", "org/", "rule"), (6, "block", "example.org/en/1", "rule"),
        (7, "allow", "org/", "rule"), (8, "allow", "org/", "rule"), (9, "block", "example.org/es/", "rule"),
        (10, "allow", None, "none"), (11, "allow", None, "none"), (12, "allow", None, "none"),
        (None, "allow", "com/fr/", "rule"), (13, "block", "com/de/", "rule"), (13, "block", "com/de/", "rule"),
        (14, "allow", None, "none"), (15, "allow", None, "none"), (16, "block", None, "alias"),
    ]
    # 2 ends in an empty query, which is a url of its own: 1 names the url without it
    assert got == sorted(want, key=str)
    empty = redirects.verdicts(pages_of(spark, PAGES).limit(0), redirects.rule_table(spark))
    assert empty.count() == 0


def test_verdicts_equal_sql(spark):
    """A graph of absolute links, long chains and a hub, against the recursive SQL form."""
    rng = random.Random(5)
    hosts = ["a.net", "b.example.net", "c.example.com", "d.example.org", "m.c.com", "org"]
    rows = []
    for i in range(400):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'en', 'es', 'it'])}/{i}"
        to = rng.choice(["http://hub.net/", f"https://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'it'])}/{rng.randrange(900)}", None])
        tag = rng.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0;url={}">'])
        rows.append((i, url, f"<html>{tag.format(to)}</html>" if to else "<p>x</p>"))
    rows += [(1000 + i, f"http://chain.net/{i}", f'<link rel="canonical" href="http://chain.net/{i + 1}">') for i in range(30)]
    rows += [(1030, "http://chain.net/30", '<link rel="canonical" href="http://z.com/de/">')]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    columns = ["page_id", "host", "path", "rule", "verdict", "decided_by"]
    rel = con.sql(sql.OP12)
    want = sorted((tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()), key=str)
    assert rows_of(redirects.verdicts(pages_of(spark, rows), redirects.rule_table(spark)), *columns) == want
    assert sum(r[-1] == "alias" for r in want) > 31


@pytest.mark.parametrize(("html", "target"), [
    ("<LINK href='/a/../b?x=1&amp;y=2' REL=\"nofollow Canonical\" >", "http://h.org/b?x=1&y=2"),
    ("<link rel=canonical href=c/./d>", "http://h.org/dir/c/d"),
    ('<link title="rel=canonical href=x" rel="icon" href="/y">', None),
    ("<meta http-equiv=Refresh content=\"5; URL='//o.net/'\">", "http://o.net/"),
    ('<meta http-equiv="refresh" content="30">', None),
    ('<link rel="canonical" href="mailto:a@b">', None),
    ('<link rel="canonical" href="#top">', None),
    ('<link rel="canonical" href="?q">', "http://h.org/dir/page?q"),
    ('<link rel="canonical" href="..">', "http://h.org/"),
    ('<script>var s = "<link rel=canonical href=/js>"</script>', None),
    ('<!-- open <link rel="canonical" href="/c">', None),
    ('<link rel="canonical" href="/late', None),
])
def test_links(spark, html, target):
    df = spark.createDataFrame([("http://h.org/dir/page?z#f", html)], "url string, html string")
    assert [r.target for r in redirects.links(df).collect()] == ([target] if target else [])


def test_further_edges_and_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", None), (2, "http://b.net/", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://a.net/", "http://bad.com/"), ("http://c.net/", None)], "url string, target string")
    rules = redirects.rule_table(spark, [("block", "bad.com", "/"), ("allow", "bad.com", "/"), ("block", "net", "/q")])
    assert rows_of(redirects.verdicts(pages, rules, log), "page_id", "verdict") == [(1, "allow"), (2, "allow")]
    rules = redirects.rule_table(spark, [("block", "bad.com", "/")])
    assert rows_of(redirects.verdicts(pages, rules, log), "page_id", "verdict") == [(1, "block"), (2, "allow")]


# --- hard negatives


def brute_negatives(rows, step):
    """Over rows (vec_id, label, vector), each distinct row once."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out, rows = [], list(kept)
    for i, label, v in rows:
        if i % step:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for p, j, _ in sorted(o for o in others if o[2] == label)[:5]:
            near = sorted(o for o in others if o[2] != label and -80 * p <= -100 * o[0] <= -100 * p)[:5]
            out += [(i, j, k, m, -p, -s) for k, (s, m, _) in enumerate(near, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("dim", "blocks"), [(64, 1), (5, 7), (130, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, blocks):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((3, dim))
    rows = []
    for i in range(400):
        v = centres[rng.integers(3)] + rng.standard_normal(dim)
        rows.append((i, int(rng.integers(4)), (v / np.linalg.norm(v)).tolist()))
    hot = rows[7][2]
    rows += [(1000 + i, i % 4, hot) for i in range(150)]  # ties by the hundred
    rows += [(2000, 1, [0.0] * dim), (2010, 2, [0.0] * dim), (2020, 1, [0.0] * dim)]
    rows += [rows[0], rows[20], (30, 3, rows[31][2])]  # repeated in full, and a second row of one id
    rows += [(3000, 1, None), (3010, None, hot), (None, 1, hot), (3020, 1, [math.nan] * dim),
             (3030, 1, [math.inf] * dim), (3040, 1, [None] * dim), (3050, 1, hot[:3]), (3060, 2, hot[:3]),
             (3070, 1, hot[:3]), (3080, 0, []), (3090, 0, []), (3100, 1, []), (3110, 0, [300.0] * dim)]
    df = spark.createDataFrame(
        [(*r, 1, "i") for r in rows], "vec_id long, label int, embedding array<double>, block int, ints string"
    )
    monkeypatch.setattr(negatives, "_block_count", lambda rows: blocks)
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(negatives.index(df), F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, 10)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want and len(want) > 200
    assert negatives.hard_negatives(negatives.index(df.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_every_score():
    """Both intervals contain the true score, for vectors of any shape."""
    rng = np.random.default_rng(3)
    for dim in (1, 3, 64, 65, 200):
        ints = rng.integers(-400, 400, (300, dim))
        ints[:5] = 0
        ints[5:9] = ints[9]
        codes, figures = negatives.encoded(ints)
        ids = np.arange(300)
        held = {"vec_id": ids, "akey": ids, "label": ids % 3, "ints": ints, "codes": codes, "figures": figures}
        block = negatives.Block(held, dim)
        q = negatives.Queries({k: v[:40] for k, v in held.items()}, dim)
        true = q.ints @ block.ints.T
        widths = []
        for n in (1, negatives.CODES):
            low, high = negatives.bounds(q, block, slice(0, 300), n)
            assert (low <= true + 1e-6).all() and (true <= high + 1e-6).all()
            widths.append((high - low).mean())
        if dim >= 64:
            assert widths[1] < 0.5 * widths[0]


def test_codes_spare_most_scores(monkeypatch):
    """Of the pairs compared, few are scored in integers."""
    import pyarrow.parquet as pq

    data = pq.read_table("/root/testdata/check_s/embeddings.parquet").to_pydict()
    ints = np.floor(256 * np.array(data["embedding"], np.float64)).astype(np.int64)
    codes, figures = negatives.encoded(ints)
    ids, labels = np.array(data["vec_id"]), np.array(data["label"])
    held = {"vec_id": ids, "akey": ids, "label": labels, "ints": ints, "codes": codes, "figures": figures}
    scored = defaultdict(int)
    plain = negatives._scores

    def counting(q, b, at, row):
        scored["pairs"] += len(at)
        return plain(q, b, at, row)

    monkeypatch.setattr(negatives, "_scores", counting)
    block = negatives.Block(held, 64)
    asked = ids % 100 == 0
    q = negatives.Queries({k: v[asked] for k, v in held.items()}, 64)
    scores = np.full((len(q), 5), -1)
    for found in negatives._positives(q, block):
        for g in range(len(found.q)):
            mine = sorted(found.score[found.group == g], reverse=True)
            scores[np.flatnonzero(q.ids == found.q.ids[g])[0], : len(mine)] = mine
    list(negatives._negatives(q, block, scores))
    assert 0 < scored["pairs"] < 0.15 * len(q) * len(ids)
