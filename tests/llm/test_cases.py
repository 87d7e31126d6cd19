"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
from base64 import b32encode

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeaudit.llm import (
    decontaminate, jaccard, licenses, mixing, passages, quality, scoring, secrets, sharding, warc,
)

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words long, "
    "text_key string, host string, size long, taken long, shard string, words string, "
    "row string, at double, kept string, label string, whole_row string"
)
EXTRA = (7, "k", "h", 8, 9, "s", "w", "r", 0.5, "keep", "l", "whole")
PROSE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"long{i % 9973}" for i in range(60_000))
TEXTS = [
    (1, PROSE, "a"), (1, PROSE, "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"),
    (None, PROSE + " tail", "b"), (None, None, None), (5, "Étude naïve ÜBER password: 'hunter22x'", "b"),
    (6, LONG, "c"), (7, "one two", None), (8, "one two", "c"), (9, PROSE.upper(), "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PROSE), (1, PROSE), (None, "one two"), (3, None), (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()), key=str)


def test_quality(docs, none):
    rows = by_id(quality.judged(docs, docs), "n_words", "base_failed", "kept")
    assert (1, 60, False, True) in rows and rows.count((1, 60, False, True)) == 2
    assert (2, 0, True, False) in rows and (None, 0, True, False) in rows
    assert (7, 2, True, False) in rows
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    assert by_id(kept, "n_words") == sorted([(1, 7), (1, 7), (None, 7), (9, 7)], key=str)
    assert quality.keep(none).count() == 0 and quality.judged(none, none).count() == 0


def test_frequent_lines_deplete(spark):
    line = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, f"{line}\n{line}", "x") for i in range(3)]
    rows += [(100 + i, f"{line.upper()}\n" + " ".join(f"own{i}x{k}" for k in range(40)), "x") for i in range(20)]
    rows += [(200 + i, f"{line}", "y") for i in range(30)]  # copies are one text
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.judged(df, df).filter("kept").collect()}
    assert kept == {100 + i for i in range(20)} | {200 + i for i in range(30)}


def test_frequent_lines_are_removed(spark):
    menu = "Home  About 12\tContact"
    own = ["\n".join(" ".join(f"{'t' * (i + 1)}l{k}w{j}" for j in range(8)) for k in range(4)) for i in range(30)]
    rows = [(i, f"{menu}\n{t}\n\n{menu.upper()}", "hot", 1) for i, t in enumerate(own[:20])]
    rows += [(100 + i, f"{menu}\n{t}", "calm", 1) for i, t in enumerate(own[20:])]  # ten texts: not above the limit
    rows += [(200, own[0] + " more", "hot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    want = [(i, f"{t}\n", len(t) + 1) for i, t in enumerate(own[:20])]
    want += [(100 + i, f"{menu}\n{t}", 1) for i, t in enumerate(own[20:])] + [(200, own[0] + " more", 1)]
    for cleaned in (quality.clean(df), corpus_pipeline.STAGES[0][1](spark, df, "")):
        assert cleaned.schema == df.schema
        assert by_id(cleaned, "text", "n_chars") == sorted(want, key=str)
    assert quality.clean(df.limit(0)).count() == 0


def test_decontamination(docs, none, items):
    rows = by_id(decontaminate.report(docs, items), "n_words", "n_hit", "item_ids", "contaminated")
    assert rows.count((1, 60, 60, ["1"], True)) == 2
    assert (9, 60, 60, ["1"], True) in rows and (None, 61, 60, ["1"], True) in rows
    assert (7, 2, 2, [""], True) in rows and (2, 0, 0, [], False) in rows
    cleaned = decontaminate.clean(docs, items)
    assert cleaned.schema == docs.schema
    assert sorted(str(r.doc_id) for r in cleaned.collect()) == ["2", "3", "4", "5", "6", "None"]
    assert decontaminate.clean(none, items).count() == 0
    assert decontaminate.report(docs, items.limit(0)).filter("contaminated").count() == 0


def test_decontamination_windows(spark):
    long_item = [f"t{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(long_item)), (2, "a b")], "item_id long, text string")
    rows = [
        (1, " ".join(["p"] * 5 + long_item[3:16] + ["q"] * 300)),  # 13 of 318 words: under 5 %
        (2, " ".join(long_item[3:15])),  # 12 words are no window
        (3, "a, B c a b"),
        (4, " ".join(["p"] * 5 + long_item + ["q"] * 300)),
    ]
    got = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert by_id(got, "n_hit", "item_ids", "contaminated") == [
        (1, 13, ["1"], False), (2, 0, [], False), (3, 4, ["2"], True), (4, 20, ["1"], True),
    ]


def test_jaccard(docs, none):
    rows = by_id(jaccard.join(docs), "n_shingles", "component_id")
    assert rows.count((1, 56, 1)) == 2 and (9, 56, 1) in rows and (None, 57, 1) in rows
    assert (7, 1, 7) in rows and (8, 1, 7) in rows
    assert (2, 0, 2) in rows and (None, 0, None) in rows
    kept = jaccard.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    assert jaccard.join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_mixing(docs, none):
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    # a: 120 of weight 3, b: 61 + 60 + 4, c: 60002, none: 2; the small ones reach twice their size
    assert words["a"] == 240 and words[None] == 4
    total = 120 + 125 + 60_002 + 2
    assert abs(sum(words.values()) - 1.5 * total) <= 4
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(none).count() == 0


def test_mix_order_and_cut(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(10)), s) for i, s in enumerate("aaaabbbbbb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = df.select("doc_id", "source", F.lit(10).cast("long").alias("size"), F.col("doc_id").cast("string").alias("key"))
    got = mixing.schedule(plan, "size", "key").collect()
    taken = {s: sum(r.taken for r in got if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in got}
    assert target == {"a": 80.0, "b": 70.0} and taken == {"a": 80, "b": 70}
    assert all(r.taken <= 20 for r in got)
    # every source is consumed evenly: after half of the mix each has half of its target
    order = [r.source for r in mixing.mix(df).coalesce(1).collect()]
    assert abs(order[:8].count("a") - order.count("a") / 2) <= 1


def test_mix_ranges_grow_with_shuffle_partitions(spark):
    rows = [(i, f"w{i} w w", "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = mixing.mix(df)
        assert mixed.rdd.getNumPartitions() == 23
        assert mixed.count() == 600
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_sharding(docs, none):
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(TEXTS)
    for shard in {r.shard for r in rows}:
        places = sorted(r.slot for r in rows if r.shard == shard)
        assert places == list(range(len(places)))
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {1}
    assert sharding.assign(none).count() == 0


def test_slot_maps():
    first = sharding.first_map()
    more = sharding.grown(first, 16)
    moved = [(a, b) for a, b in zip(first, more) if a != b]
    assert {b for _, b in moved} == {16} and len(moved) == 4096 // 17
    weights = {slot: (slot * 7919) % 1000 + (50_000 if slot < 5 else 0) for slot in range(4096)}
    even = sharding.rebalanced(first, weights, 16)

    def spread(m):
        load = [sum(weights[s] for s in range(4096) if m[s] == shard) for shard in range(16)]
        return max(load) - min(load)

    assert spread(even) <= 1000 < spread(first)


def test_write_shards(spark, docs, tmp_path):
    slots = sharding.map_table(spark, [sharding.first_map()]).filter("version = 1")
    sharding.write_shards(docs, slots, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(TEXTS)


def test_licenses(docs, none, spark):
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(none).count() == 0
    rows = [
        (1, "Licensed under the MIT License. under the mit license, UNDER the MIT-license"),
        (2, "SPDX-License-Identifier: GPL-3.0-or-later"), (3, None), (4, "mit der Zeit"),
        (5, "released under the Apache License, Version 2.0; cc by-nc"),
        (6, "all rights reserved " * 3000),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: [(d.label, d.priority, d.first, d.last) for d in r.detections] for r in got}
    assert [d for d in found[1] if d[1] == 0] == [("mit", 0, 1, 4), ("mit", 0, 5, 8), ("mit", 0, 9, 12)]
    assert found[2] == [("gpl-3", 1, 0, 7)]
    assert found[3] == [] and found[4] == []
    assert {d[0] for d in found[5]} == {"apache-2", "cc-by-nc"}
    assert len(found[6]) == 3000


def test_license_rules_are_many_and_gated():
    assert len(licenses.signatures()) > 200
    for _, _, names in licenses.LICENSES:
        for name in licenses.alternatives(names):
            assert any(g in licenses.keyword_of(name) for g in licenses.GATES), name
    for _, _, word, rule in licenses.SENTENCES:
        assert word in rule and any(g in rule for g in licenses.GATES), rule
    for phrase, _ in licenses.BASE_PHRASES:
        assert any(g in phrase for g in licenses.GATES)
    assert licenses.keyword_of("bsd [23] clause(?: patent| views)?") == "clause"
    assert licenses.keyword_of("names? of(?: [^ ]+){1,12} nor the") == "nor the"


def test_secrets(docs, none, spark):
    found = secrets.find(docs)
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert spans[5] == [("assign", 17, 37)]
    assert secrets.find(none).count() == 0
    key = "0123456789abcdef0123456789abcdef"
    rows = [(i, f"token={key}", f"owner{i % 4}") for i in range(9)] + [(100, "secret: Zx81-kq_Pw.7t", "one"), (101, "password=aaaaaaaa", None)]
    judged = secrets.judged(secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    classes = {r["class"]: (r.n_repos, r.n_owners) for r in judged.collect()}
    assert classes == {"copied": (9, 4), "live": (1, 1), "weak": (1, 1)}


def test_passages(docs, none):
    rows = by_id(passages.repeats(docs), "n_words", "spans", "partner_id")
    assert rows.count((1, 60, "0-59", 9)) == 2 and (9, 60, "0-59", 1) in rows
    assert (None, 61, "0-59", 1) in rows and (2, 0, "", None) in rows
    assert passages.repeats(none).count() == 0


def test_passages_near_copies(spark):
    passage = [f"p{i}" for i in range(80)]
    edited = passage[:30] + ["new"] + passage[31:]
    rows = [
        (1, " ".join([f"a{i}" for i in range(70)] + passage + [f"b{i}" for i in range(50)])),
        (2, " ".join([f"c{i}" for i in range(20)] + edited)),
        (3, " ".join(f"d{i}" for i in range(300))),
        (4, " ".join(passage[:40])),
    ]
    got = by_id(passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")), "spans", "partner_id")
    assert got == [(1, "70-149", 2), (2, "20-99", 1), (3, "", None), (4, "", None)]


def test_passages_among_holders_that_are_not_the_ends(spark):
    """Sixty wordings of a passage, each in two texts; most holders of a min-hash have another."""
    rows = []
    for g in range(60):
        passage = [f"p{i}" for i in range(60)]
        for at in (5 + g % 25, 33 + g % 22):
            passage[at] = f"w{g}x{at}"
        for side in "ab":
            own = [f"{side}{g}x{i}" for i in range(20)]
            rows.append((2 * g + (side == "b"), " ".join(own + passage + [f"end{g}{side}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = by_id(passages.repeats(docs), "spans")
    assert sum(s == "20-79" for _, s in spans) >= 0.95 * len(spans)


def test_passages_of_texts_that_share_a_frequent_run(spark, monkeypatch):
    """A hundred and fifty texts with a run of one word, two of them similar around it."""
    own = [f"w{g}" for g in range(148)] + ["same", "same"]
    rows = []
    for g, word in enumerate(own):
        before, after = (" ".join(f"{side}{g}x{i}" for i in range(30)) for side in "ab")
        rows.append((g, f"{before} {f'{word} ' * 30}{'the ' * 30}{after}"))
    bands, verified = [], passages.verified
    monkeypatch.setattr(passages, "verified", lambda pairs, codes: (bands.append(pairs.count()), verified(pairs, codes))[1])
    found = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.spans, r.partner_id) for r in found if r.spans} == {148: ("30-89", 149), 149: ("30-89", 148)}
    # all pairs are 11,175
    assert sum(bands) < 20 * len(rows)


def test_prefixes_are_shared_by_similar_stretches():
    rng = np.random.default_rng(5)
    common = [np.zeros(1 << 10, np.uint8) for _ in range(2)]
    for _ in range(200):
        code = rng.integers(0, 60, passages.LEAST).astype(np.uint32)
        other = code.copy()
        other[rng.choice(passages.LEAST, passages.LEAST - passages.COMMON, replace=False)] = 99
        one, two = (passages.prefixes(passages.rare_first(c, common)) for c in (code, other))
        assert np.intersect1d(one, two).size
        c, low = np.array([7]), np.zeros(1, np.int64)
        names = [passages.narrowed(passages.rare_first(x, common), c, low, low)[1] for x in (code, other)]
        assert np.intersect1d(*names).size


def test_matchings_go_on_and_keep_rows_apart():
    a = np.array([1, 1, 1, 2, 3, 1, 1], np.uint32)
    b = np.array([9, 1, 1, 1, 1, 2, 3, 1], np.uint32)
    alone = passages.matching(a, b, -3, 4)
    both = dict(passages.matchings(np.tile(a, 2), np.array([7, 7]), np.tile(b, 2), np.array([8, 8]),
                                   np.array([-3, -3]), np.array([4, 4]), 1))
    assert (both[0] == alone).all() and (both[1] == alone).all()
    assert alone.tolist()[3:5] == [5, 6] and all(b[j] == a[i] for i, j in enumerate(alone) if j >= 0)


def test_passage_bands_overlap(spark):
    """Matches on both sides of every multiple of a cell are counted together."""

    def aligned(*matches):
        rows = []
        for fn, (at, shift) in enumerate(matches):
            rows += [(1, fn, fn, at, at + 20, at + 60), (2, fn, fn, at - shift, at - shift + 20, at - shift + 60)]
        windows = spark.createDataFrame(rows, "text_id long, key long, fn int, l int, c int, r int")
        return passages.alignments(windows).filter("a = 1").collect()

    for border in (-32, 0, 16, 32, 48):
        (got,) = aligned((100, border - 1), (110, border - 1), (130, border))
        assert got.shift <= border - 1 and border < got.shift + passages.BAND
        assert (got.a_lo, got.a_hi) == (100, 190)
    assert not aligned((100, 5), (110, 5), (130, 90))
    assert len(aligned((100, 5), (110, 5), (130, 5))) == 1


def test_windows_of_texts_longer_than_their_places(monkeypatch):
    code = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    row = np.repeat([0, 1], [4000, 1000])
    want = passages.compact_windows(code, row, 2)
    monkeypatch.setattr(passages, "_PLACE", 8)
    got = passages.compact_windows(code, row, 2)
    assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_scoring(docs, none, spark):
    rows = by_id(scoring.score(docs), "n_words", "log_score")
    assert (2, 0, None) in rows and (None, 0, None) in rows
    assert scoring.score(none).count() == 0
    alone = scoring.score(spark.createDataFrame([(1, "a b a")], "doc_id long, text string")).first()
    assert alone.n_full == 0 and alone.log_score < 0


PAGES = [
    (1, "u1", "<p>same</p>"), (5, None, "<p>same</p>"), (3, "u3", None), (4, "u4", ""),
    (None, "u", "<p>same</p>"), (9, "é\r", "<p>" + "ü" * 70_000), (9, "é\r", "<p>" + "ü" * 70_000),
]


def test_warc(spark, tmp_path):
    schema = "page_id long, url string, html string, sha256 string, payload string"
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], schema)
    folder = str(tmp_path / "archive")
    warc.archive(pages, folder)
    assert warc.payloads(spark, folder).count() == 3  # each payload once
    heads = {(r.page_id, r.record_type, r.refers_to) for r in warc.headers(spark, folder).collect()}
    assert heads == {
        (1, "revisit", 5), (5, "response", None), (None, "revisit", 5), (3, "revisit", 4),
        (4, "response", None), (9, "response", None),
    }
    held = [(r.page_id, r.payload.decode()) for r in warc.pages_back(spark, folder).collect()]
    assert sorted(held, key=str) == sorted([(i, h or "") for i, _, h in PAGES], key=str)
    for r in warc.records(spark, folder).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
        assert int(fields[b"Content-Length"]) == len(block) - 4
        assert block.endswith(b"\r\n\r\n")
        if r.page_id == 5:
            assert fields[b"WARC-Payload-Digest"] == b"sha1:" + b32encode(hashlib.sha1(b"<p>same</p>").digest())
    empty = str(tmp_path / "empty")
    warc.archive(pages.limit(0), empty)
    assert warc.records(spark, empty).count() == 0


def test_warc_urls_add_no_headers(spark, tmp_path):
    forged = "http://a/\r\nWARC-Refers-To: <urn:page:99>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 1\r\n\r\nx"
    pages = spark.createDataFrame([(1, forged, "<p>é</p>"), (2, "http://b/\n", "<p>é</p>")], "page_id long, url string, html string")
    folder = str(tmp_path / "forged")
    warc.archive(pages, folder)
    rows = {r.page_id: r for r in warc.records(spark, folder).collect()}
    assert (rows[1].record_type, rows[1].refers_to) == ("revisit", 2) and rows[2].refers_to is None
    for r in rows.values():
        assert r.stated_digest == r.payload_digest
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        assert len(head) + 4 == r.header_bytes and len(block) - 4 == r.stated_bytes
        assert head.count(b"WARC-Target-URI") == 1 and head.count(b"\r\nContent-Length") == 1


def test_warc_wrong_digest_is_an_error(spark, tmp_path):
    folder = str(tmp_path / "bad")
    spark.createDataFrame([("00", bytearray(b"x"), 1)], "sha256 string, payload binary, stored_by long").write.parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.payloads(spark, folder).collect()


def test_pipeline_stages_keep_the_columns(spark, docs, none, items, tmp_path):
    folder = str(tmp_path)
    items.write.parquet(f"{folder}/benchmark.parquet")
    for start in (docs, none):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, folder)
            assert rows.schema == start.schema, name
        assert {"doc_id", "shard", "slot"} <= set(corpus_pipeline.STAGES[-1][1](spark, rows, folder).columns)
