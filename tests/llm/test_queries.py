"""Registered queries against their SQL, or against brute force where SQL has no form for them."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module
from codeaudit.llm import jaccard, licenses, passages, secrets, sharding
from codeaudit.llm.queries import QUERIES, SQL
from conftest import DATA

SF = f"{DATA}/sf0.001"
MORE = f"{DATA}/sf0.01"
TABLES = "documents pages benchmark labels conversations embeddings".split()
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def more_documents():
    return pq.read_table(f"{MORE}/documents.parquet").to_pylist()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_native_modules_run_no_python_in_tasks():
    folder = os.path.dirname(licenses.__file__)
    for name in ("licenses.py", "quality.py"):
        text = open(os.path.join(folder, name)).read()
        for banned in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "pyarrow", "numpy"):
            assert banned not in text, (name, banned)


def test_no_local_checkpoints():
    for path in glob.glob(os.path.join(os.path.dirname(licenses.__file__), "*.py")):
        assert "localCheckpoint" not in open(path).read(), path


def test_all_operators_and_the_pipeline_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(row[i] for i in at)) for row in rel.fetchall())


def test_licenses_equal_brute_force(spark, documents):
    rules = [(label, p, re.compile(rule)) for label, word, p, rule in licenses.signatures()]
    want = {}
    for d in documents:
        w = letters(d["text"])
        text = " " + " ".join(w) + " "
        found = []
        for i, (label, p, rule) in enumerate(rules):
            for m in rule.finditer(text):
                first = text.count(" ", 0, m.start()) - 1
                found.append((first, first + m[0].count(" "), p, i, label))
        kept = [
            a for a in found
            if a[2] == 0 or not any(
                b[2] <= a[2] and b[0] <= a[0] and a[1] <= b[1] and b is not a
                and (b[2] < a[2] or (b[0], -b[1], b[3]) < (a[0], -a[1], a[3])) for b in found
            )
        ]
        base = [a for a in found if a[2] == 0]
        want[d["doc_id"]] = (
            len(w), len(base), min((a[0] for a in base), default=None),
            max((a[0] for a in base), default=None), ",".join(sorted({a[4] for a in base})),
            ",".join(sorted({a[4] for a in kept})),
        )
    got = {
        r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        for r in QUERIES["op4_license"](spark, SF).collect()
    }
    assert got == want
    assert any(w[1] for w in want.values())


def test_secrets_equal_brute_force(spark, more_documents):
    documents = more_documents
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A,
    )
    rank = {"assign": 0, "access": 1, "hex": 2}
    got = {r.doc_id: r for r in QUERIES["op6_secrets"](spark, MORE).collect()}
    assert len(got) == len(documents)
    seen, patterns = 0, secrets.compiled()
    owners, randoms = defaultdict(set), {}
    held = {}
    for d in documents:
        held[d["doc_id"]] = values = [c[3] for c in secrets.candidates(d["text"] or "", patterns)]
        for value in values:
            owners[value].add(d["source"])
            share = [values_n / len(value) for values_n in Counter(value).values()]
            randoms[value] = -sum(x * math.log2(x) for x in share) >= secrets.MIN_ENTROPY
    copied = {v for v, who in owners.items() if len(who) > secrets.MAX_OWNERS}
    for d in documents:
        text, spans = d["text"] or "", []
        spans += [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], rank[s[0]]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r, n = got[d["doc_id"]], Counter(s[0] for s in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        mine = held[d["doc_id"]]
        assert r.n_copied == sum(v in copied for v in mine)
        assert r.n_live == sum(v not in copied and randoms[v] for v in mine)
        seen += len(spans)
    assert seen


def test_secrets_of_many_and_of_few_owners(spark):
    common, own = "k7Qz91LmXw", ["r4Tt%dZzQ81n" % i for i in range(9)]
    rows = [(i, f"src{i}", f"token={common}" + (f" secret: {own[i]}" if i < 9 else "")) for i in range(12)]
    rows += [(100 + i, "src0", f"secret: {own[0]} password = aaaaaaaa") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    judged = secrets.judged(secrets.find(docs)).collect()
    seen = Counter((r["class"], r.n_repos, r.n_owners) for r in judged)
    assert seen == {("copied", 12, 12): 12, ("live", 31, 1): 31, ("live", 1, 1): 8, ("weak", 30, 1): 30}


def brute_passages(texts):
    """Words in passages that two different texts share, over all pairs with common shingles.

    The pairs come from comparing all texts, the bounds from the library's own alignment.
    """
    codes, holders = {}, defaultdict(set)
    ids = {}
    for name, w in texts.items():
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        codes[name] = np.array([ids.setdefault(g, len(ids)) for g in grams], np.uint32)
        for g in set(codes[name].tolist()):
            holders[g].add(name)
    common = Counter()
    for held in holders.values():
        if len(held) > 1:
            common.update(combinations(sorted(held), 2))
    covered = defaultdict(set)
    for (a, b), n in common.items():
        if n < passages.COMMON:
            continue
        x, y = codes[a], codes[b]
        where = defaultdict(list)
        for j, g in enumerate(y.tolist()):
            where[g].append(j)
        shifts = Counter()
        for i, g in enumerate(x.tolist()):
            shifts.update({(i - j) // passages.CELL for j in where.get(g, ())})
        for cell in {c for c in shifts for c in (c, c - 1)}:
            if shifts[cell] + shifts[cell + 1] < passages.COMMON:
                continue
            low = cell * passages.CELL
            found = passages.matching(x, y, low - passages.SLACK, low + passages.BAND + passages.SLACK)
            for first, last, start, stop in passages.segments(found):
                covered[a].update(range(first, last + 5))
                covered[b].update(range(start, stop + 5))
    return covered


def test_recall_of_near_duplicate_passages(spark, more_documents):
    text = {d["doc_id"]: words(d["text"]) for d in more_documents}
    by_text = {tuple(w): i for i, w in sorted(text.items(), reverse=True) if len(w) >= passages.MIN_WORDS}
    want = brute_passages({i: list(w) for w, i in by_text.items()})
    got = {}
    for r in QUERIES["op8_passages"](spark, MORE).collect():
        spans = [tuple(map(int, s.split("-"))) for s in r.spans.split(",") if s]
        got[r.doc_id] = {k for first, last in spans for k in range(first, last + 1)}
    total = sum(len(w) for w in want.values())
    held = sum(len(w & got[i]) for i, w in want.items())
    print("recall", held / total, "of", total)
    assert total > 10_000 and held >= 0.9 * total


def test_passages_hold_the_exact_repeats(spark, documents):
    """Words in 50-word runs that another document has too, against the spans reported."""
    text = {d["doc_id"]: words(d["text"]) for d in documents}
    holders = defaultdict(set)
    for i, w in text.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k:k + 50])].add(i)
    missed = total = 0
    for r in QUERIES["op8_passages"](spark, SF).collect():
        w, want, got = text[r.doc_id], set(), set()
        for k in range(len(w) - 49):
            if len(holders[tuple(w[k:k + 50])]) > 1:
                want.update(range(k, k + 50))
        for span in filter(None, r.spans.split(",")):
            first, last = map(int, span.split("-"))
            assert last - first + 1 >= passages.MIN_WORDS
            got.update(range(first, last + 1))
        assert r.n_words == len(w) and r.n_repeat_words == len(got)
        assert (r.partner_id is not None) == bool(got) and r.partner_id != r.doc_id
        missed, total = missed + len(want - got), total + len(want)
    assert total and missed <= 0.01 * total


def test_shards_follow_the_law(spark, documents):
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in documents)
    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    places = defaultdict(list)
    for r in rows:
        assert r.size == len(text[r.doc_id]) + 1
        assert r.text_crc32 == zlib.crc32(text[r.doc_id])
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
        assert r.shard == sharding.first_map()[r.vslot]
        assert r.grown_shard == sharding.grown(sharding.first_map(), 16)[r.vslot]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = {r.doc_id: (r.shard, r.grown_shard) for r in QUERIES["op10_sharding"](spark, f"{DATA}/sf0.01").collect()}
    assert all(again[r.doc_id] == (r.shard, r.grown_shard) for r in rows)


def brute_components(rows):
    """Smallest reachable id by comparing all pairs of documents that share a shingle."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in holders[g])
        for j, x in common.items():
            if 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in sets[i]:
            holders[g].append(i)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_blocks_lose_no_link(spark, monkeypatch, block):
    """Forty edits of one text and some bystanders, in one block and in many."""
    import random

    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:40]) + f" y{i} " * 60) for i in range(5)]
    rows += [(200 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(30))) for i in range(5)]
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def brute_targets(sizes):
    """Targets by raising the level until the budget is used, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()) * 1.5, set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    return target


def brute_mix(rows):
    """(doc_id, text) of every copy, from (doc_id, source, text)."""
    queues, out = defaultdict(list), []
    for i, source, text in rows:
        queues[source].append((hashlib.md5(f"mix-1|{i}".encode()).hexdigest(), i, text))
    target = brute_targets({s: sum(len(words(t)) for _, _, t in q) for s, q in queues.items()})
    for source, queue in queues.items():
        left = int(target[source] + 1e-9)
        for _, i, text in sorted(queue) * 2:
            n = min(left, len(words(text)))
            if n:
                ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                out.append((i, text if n == len(ends) else text[:ends[n - 1]]))
            left -= n
    return out


def brute_clean(documents):
    """doc_id -> text without the lines that too many texts of the source hold."""

    def plain(line):
        return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))

    holders, of_source = defaultdict(set), defaultdict(set)
    for d in documents:
        of_source[d["source"]].add(d["text"] or "")
        for line in (d["text"] or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                holders[d["source"], plain(line)].add(d["text"])
    often = {k for k, held in holders.items() if len(held) > 10 and len(held) > 0.05 * len(of_source[k[0]])}
    return {
        d["doc_id"]: "\n".join(x for x in (d["text"] or "").split("\n") if (d["source"], plain(x)) not in often)
        for d in documents
    }


def test_pipeline_equals_brute_force(spark, more_documents):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{MORE}/{t}.parquet'")
    kept = {i for i, ok in duck.sql(f"SELECT doc_id, kept FROM ({SQL['op7_quality']})").fetchall() if ok}
    cleaned = brute_clean(more_documents)
    docs = [d | {"text": cleaned[d["doc_id"]]} for d in more_documents if d["doc_id"] in kept]
    assert any(d["text"] != o["text"] for d in docs for o in more_documents if o["doc_id"] == d["doc_id"])
    first = brute_components([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if first[d["doc_id"]] == d["doc_id"]]
    windows = set()
    for (text,) in duck.sql("SELECT text FROM benchmark").fetchall():
        w = letters(text)
        n = min(13, len(w))
        windows |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1) if n}
    lengths = {len(w) for w in windows}

    def is_clean(text):
        w, hit = letters(text), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
        return not hit or 20 * len(hit) < len(w)

    docs = [d for d in docs if is_clean(d["text"])]
    mixed = brute_mix([(d["doc_id"], d["source"], d["text"]) for d in docs])
    want = Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in mixed)
    rows = entry_module.queries()["pipeline"](spark, MORE).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
