"""N-gram Jaccard join of documents by prefix trees.

A document is the set of its 5-word shingles.  Equal sets are one class and take part
once.  Two sets x, y link when their Jaccard similarity is at least 0.8, so each shares
at least t(n) = ceil(0.8 n) of its n shingles with the other.

1. Shingles in hash order: the l smallest common shingles of two linked sets lie among the
   first n - t(n) + l of both, so a set fewer than l of whose first shingles are held by
   another set links with nothing.  l is a tenth of the set.  Sets made of their own
   words, nearly all of a corpus, end here; only these first shingles are shuffled.
2. For the sets left, document frequencies of all their shingles.  Ordered from rare to
   frequent, linked sets share one of the first n - t(n) + 1; shingles of one set only
   take up room in this prefix but need no partner.
3. Sets with a common prefix shingle meet under the smallest set of that shingle.  There
   they are stored in a prefix tree, shingles in order of frequency; the tree is walked
   once for all sets together, each node adding the overlap of its run of shingles to what
   its parent has, and a set leaves a subtree that its lengths rule out.
4. Meetings of more than ``BLOCK`` sets are dealt into blocks that all hold the smallest
   set.  Components found so far drop out of the next step, in which sets of different
   components that still share a prefix shingle meet block against block.
5. Links become components; an all-pairs list is never made.

Shingles and sets are compared by 64-bit codes.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are
their own component; fewer than five words are one shingle; repeated rows are linked as
equal sets; a null doc_id never names a component unless all ids of it are null; an empty
table gives an empty result; other columns are ignored or, by ``keep_one``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import free_name, table
from codeaudit.llm.components import components
from codeaudit.llm.frequency import PACKED, bucket_count, packed, shared_codes
from codeaudit.llm.tokens import (
    NONBLANK, Words, bitmap_of, in_bitmap, scramble, shingles, signed, whole_code, words_of,
)

SHINGLE = 5
#: Similarity at which two documents link, in percent.
PERCENT = 80
#: Sets that meet in one task.
BLOCK = 1024


def set_codes(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingles of every row."""
    row, _, code = shingles(words, SHINGLE)
    cut = np.searchsorted(row, np.arange(len(words.first)))
    out = []
    for r in range(len(words.first) - 1):
        found = code[cut[r]:cut[r + 1]]
        lo, hi = words.first[r], words.first[r + 1]
        if not len(found) and hi > lo:
            found = np.array([whole_code(words.code[lo:hi])])
        out.append(np.unique(found))
    return out


def set_id(codes: np.ndarray) -> int:
    """One code for a set: equal sets, and almost surely no others, share it."""
    spread = scramble(codes ^ np.uint64(0xA0761D6478BD642F))
    total = np.array([spread.sum(dtype=np.uint64) + np.uint64(len(codes))])
    return int(signed(scramble(total))[0])


def needed(n: np.ndarray) -> np.ndarray:
    """Fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-n * PERCENT // 100)


def first_length(n: int) -> tuple[int, int]:
    """(how many first shingles are looked at, how many of them must be shared)."""
    many = max(1, n // 10)
    return min(n, n - int(needed(n)) + many), many


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n): the class of every document; no class without words."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in words_of(batch.column("text"), NONBLANK):
                sets = set_codes(words)
                ids = [set_id(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, len(sets)), pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                ], ["doc_id", "set_id", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        classify, f"doc_id {kind}, set_id long, n long"
    )


def first_shingles(docs: DataFrame, n_buckets: int) -> DataFrame:
    """The first shingles, in hash order, of every document's set, packed by bucket."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for _, words in words_of(batch.column("text"), NONBLANK):
                for codes in set_codes(words):
                    if len(codes):
                        yield set_id(codes), codes[:first_length(len(codes))[0]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(firsts(batches), n_buckets)

    return docs.select("text").mapInArrow(cut, PACKED)


def candidate_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(set_id, n, codes) of the documents whose class has its bit set."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in words_of(batch.column("text"), NONBLANK):
                found: dict[int, np.ndarray] = {}
                for codes in set_codes(words):
                    if len(codes):
                        key = set_id(codes)
                        if in_bitmap(wanted, np.array([key], np.int64).view(np.uint64))[0]:
                            found[key] = codes
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(found), pa.int64()),
                    pa.array([len(c) for c in found.values()], pa.int64()),
                    pa.array([c.tobytes() for c in found.values()], pa.binary()),
                ], ["set_id", "n", "codes"])

    return docs.select("text").mapInArrow(pick, "set_id long, n long, codes binary")


def repacked(sets: DataFrame, n_buckets: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for key, codes in zip(batch.column("set_id").to_pylist(), batch.column("codes")):
                yield key, np.frombuffer(codes.as_buffer(), np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(each(batches), n_buckets)

    return sets.select("set_id", "codes").mapInArrow(cut, PACKED)


def prefixes(shared: DataFrame) -> DataFrame:
    """(set_id, n, codes, prefix): shared shingles, and those of them in the rarest n - t + 1."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, codes, held in zip(*(batch.column(c).to_pylist() for c in ("n", "codes", "held"))):
                codes, held = np.array(codes, np.int64), np.array(held, np.int64)
                room = n - int(needed(n)) + 1 - (n - len(codes))  # the set's own shingles come first
                out.append(codes[np.lexsort((codes, held))][:max(0, room)])
            yield pa.RecordBatch.from_arrays([
                batch.column("set_id"), batch.column("n"),
                batch.column("codes").cast(pa.list_(pa.int64())),
                pa.array(out, pa.list_(pa.int64())),
            ], ["set_id", "n", "codes", "prefix"])

    return shared.select("set_id", "n", "codes", "held").mapInArrow(
        cut, "set_id long, n long, codes array<long>, prefix array<long>"
    )


class Tree:
    """Prefix tree of shingle sets, runs of shingles without a branch being one node.

    Nodes are in preorder: ``parent``, ``run`` (shingles), ``after`` (most shingles below
    the node), ``least`` and ``most`` (sizes of the sets at or below it), ``sets`` (those
    that end in it).
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.parent: list[int] = [-1]
        self.run: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.sets: list[list[int]] = [[]]
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        path: list[tuple[int, int]] = [(0, 0)]  # (node, depth at its end)
        last = np.zeros(0, np.int64)
        for i in order:
            own = sets[i]
            k = min(len(own), len(last))
            differ = np.flatnonzero(own[:k] != last[:k])
            same = int(differ[0]) if len(differ) else k
            above = path[-1]
            while path[-1][1] > same:
                above = path.pop()
            node, depth = path[-1]
            if depth < same:  # cut the run of the node above in two
                node = self._split(above[0], same - depth)
                path.append((node, same))
            if len(own) > same:
                node = self._add(node, own[same:])
                path.append((node, len(own)))
            self.sets[path[-1][0]].append(i)
            last = own
        self._measure(sizes)

    def _add(self, parent: int, run: np.ndarray) -> int:
        self.parent.append(parent)
        self.run.append(run)
        self.sets.append([])
        return len(self.parent) - 1

    def _split(self, node: int, at: int) -> int:
        """A new node with the first ``at`` shingles of ``node``, put above it."""
        top = self._add(self.parent[node], self.run[node][:at])
        self.run[node] = self.run[node][at:]
        self.parent[node] = top
        return top

    def _measure(self, sizes: np.ndarray) -> None:
        n = len(self.parent)
        below: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            below[self.parent[node]].append(node)
        self.order, stack = [], [0]
        while stack:
            node = stack.pop()
            self.order.append(node)
            stack += below[node]
        big = np.iinfo(np.int64).max
        self.after = np.zeros(n, np.int64)
        self.least, self.most = np.full(n, big), np.zeros(n, np.int64)
        self.children = [len(b) for b in below]
        for node in reversed(self.order):
            for i in self.sets[node]:
                self.least[node] = min(self.least[node], sizes[i])
                self.most[node] = max(self.most[node], sizes[i])
            if node:
                up = self.parent[node]
                self.after[up] = max(self.after[up], self.after[node] + len(self.run[node]))
                self.least[up] = min(self.least[up], self.least[node])
                self.most[up] = max(self.most[up], self.most[node])


def linked(x: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles, x of them common, are similar enough."""
    return 100 * x >= PERCENT * (n + m - x)


def tree_links(ids, sizes, codes, labels, probes, stored) -> list[tuple[int, int]]:
    """Links that join different labels, from ``probes`` to ``stored`` (lists of set numbers).

    Returns a spanning set: of the links between two labels, or labels already joined by
    the links returned, only the first one met.
    """
    flat = np.concatenate([codes[i] for i in stored])
    found, held = np.unique(flat, return_counts=True)
    order = np.lexsort((found, -held))
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))

    def ranks(i: int) -> np.ndarray:
        at = np.searchsorted(found, codes[i])
        at[at == len(found)] = 0
        return np.sort(rank[at[found[at] == codes[i]]]) if len(found) else np.zeros(0, np.int64)

    sizes = np.asarray(sizes, np.int64)
    tree = Tree([ranks(i) for i in stored], sizes[np.array(stored)])
    probe_ranks = [ranks(i) for i in probes]
    flat = np.concatenate(probe_ranks)
    owner = np.repeat(np.arange(len(probes)), [len(r) for r in probe_ranks])
    by_rank = np.argsort(flat, kind="stable")
    owner = owner[by_rank]
    bounds = np.searchsorted(flat[by_rank], np.arange(len(found) + 1))
    n = sizes[np.array(probes)]

    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            joined[x] = joined.get(joined[x], joined[x])
            x = joined[x]
        return x

    out = []
    alive = {0: np.arange(len(probes))}
    overlap = {0: np.zeros(len(probes), np.int64)}
    waiting = {0: tree.children[0]}
    for node in tree.order:
        if node:
            up = tree.parent[node]
            left, total = alive[up], overlap[up]
            waiting[up] -= 1
            if not waiting[up]:
                del alive[up], overlap[up], waiting[up]
            if len(left):
                run = tree.run[node]
                hits = np.concatenate([owner[bounds[t]:bounds[t + 1]] for t in run])
                total = total + np.bincount(hits, minlength=len(probes))[left]
                most, least, size = tree.most[node], tree.least[node], n[left]
                best = np.minimum(total + tree.after[node], size)
                fits = (100 * size >= PERCENT * least) & (100 * most >= PERCENT * size)
                # the smallest set that may stand below needs the smallest overlap
                other = np.maximum(least, needed(size))
                fits &= linked(best, size, other)
                left, total = left[fits], total[fits]
            if tree.children[node]:
                alive[node], overlap[node], waiting[node] = left, total, tree.children[node]
        else:
            left, total = alive[0], overlap[0]
        for s in tree.sets[node]:
            i = stored[s]
            for p in left[linked(total, n[left], sizes[i])]:
                a, b = root(labels[i]), root(labels[probes[p]])
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[probes[p]]))
    return out


LINKS = "a long, b long"
_LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _meet(group: pa.Table) -> pa.Table:
    """Links among the sets of a block, or between its two sides when there are two."""
    seen: dict[tuple[int, int], int] = {}
    ids, sizes, codes, labels, sides = [], [], [], [], []
    columns = (group.column(c).to_pylist() for c in ("set_id", "n", "label", "side"))
    for key, n, label, side, code in zip(*columns, group.column("codes").combine_chunks()):
        if (key, side) not in seen:
            seen[key, side] = len(ids)
            ids.append(key)
            sizes.append(n)
            labels.append(label)
            sides.append(side)
            codes.append(code.values.to_numpy(zero_copy_only=False))
    one = [i for i, side in enumerate(sides) if side == 0]
    two = [i for i, side in enumerate(sides) if side == 1]
    links = tree_links(ids, sizes, codes, labels, two or one, one) if one else []
    return pa.Table.from_arrays([
        pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64()),
    ], schema=_LINK_SCHEMA)


def _blocks(count, size: int):
    return F.ceil(count / size).cast("int")


def _block_of(blocks):
    return F.pmod(F.xxhash64("set_id"), blocks).cast("int")


def first_links(meetings: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside blocks; every block of a meeting also holds the meeting's smallest set."""
    blocks = meetings.groupBy("leader").agg(_blocks(F.count("*"), BLOCK).alias("blocks"))
    dealt = meetings.join(blocks, "leader")
    others = dealt.select("leader", _block_of(F.col("blocks")).alias("block"), "set_id")
    leaders = blocks.select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("leader").alias("set_id"),
    )
    rows = others.filter("set_id <> leader").unionByName(leaders).join(sets, "set_id")
    rows = rows.select("leader", "block", "set_id", "n", "codes",
                       F.col("set_id").alias("label"), F.lit(0).alias("side"))
    return rows.groupBy("leader", "block").applyInArrow(_meet, LINKS)


def cross_links(meetings: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between different labels of meetings (leader, set_id), block against block."""
    half = BLOCK // 2
    blocks = meetings.groupBy("leader").agg(_blocks(F.count("*"), half).alias("blocks"))
    dealt = meetings.join(blocks, "leader").withColumn("own", _block_of(F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("leader", "set_id", "own", other).select(
        "leader", "set_id",
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    rows = paired.join(sets, "set_id").join(labels, "set_id", "left")
    rows = rows.select("leader", "low", "high", "set_id", "n", "codes",
                       F.coalesce("label", "set_id").alias("label"), "side")
    return rows.groupBy("leader", "low", "high").applyInArrow(_meet, LINKS)


def set_labels(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(set_id, label) of the sets that link with another; None when there can be none."""
    total = classes.agg(F.sum("n").alias("n")).first().n or 0
    if not total:
        return None
    buckets = bucket_count(docs.sparkSession, total * 3 // 10)
    counted = shared_codes(first_shingles(docs, buckets), with_codes=False)
    held = counted.groupBy("set_id").agg(F.max("shared").alias("shared"))
    sizes = classes.filter("n > 0").select("set_id", "n").distinct()
    many = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    chosen = held.join(sizes, "set_id").filter(F.col("shared") >= many).select("set_id", "n")
    chosen = written(chosen, "jaccard-candidates")
    wanted = bitmap_of(chosen, "set_id")
    picked = candidate_sets(docs, wanted).dropDuplicates(["set_id"])
    picked = written(picked.join(chosen.select("set_id"), "set_id", "left_semi"), "jaccard-sets")
    size = chosen.agg(F.sum("n").alias("n")).first().n or 0
    shared = shared_codes(repacked(picked, bucket_count(docs.sparkSession, size)))
    shared = written(shared.drop("shared"), "jaccard-shared")  # one Python step a stage
    sets = written(prefixes(shared.join(chosen, "set_id")), "jaccard-prefixes")
    entries = sets.select("set_id", F.explode("prefix").alias("code"))
    met = entries.groupBy("code").agg(F.min("set_id").alias("leader"), F.count("*").alias("sets"))
    entries = entries.join(met.filter("sets > 1").select("code", "leader"), "code")
    entries = written(entries, "jaccard-entries")
    meetings = entries.select("leader", "set_id").distinct()
    plain = sets.select("set_id", "n", "codes")
    found = written(first_links(meetings, plain), "jaccard-links")
    labels = _labels(found)

    # meetings that took more than one block have not seen all their pairs
    large = meetings.groupBy("leader").agg(F.count("*").alias("sets")).filter(F.col("sets") > BLOCK)
    open_ = entries.join(large.select("leader"), "leader").join(labels, "set_id", "left")
    open_ = open_.withColumn("label", F.coalesce("label", "set_id"))
    mixed = open_.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.filter("low <> high").select("code")
    rest = written(open_.join(mixed, "code").select("leader", "set_id").distinct(), "jaccard-open")
    more = written(cross_links(rest, plain, labels), "jaccard-links")
    return _labels(found.unionByName(more))


def _labels(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("set_id"), F.col("root").alias("label"))


def classes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_id, label): documents with equal label are reachable over links."""
    classes = written(members(docs), "jaccard-classes")
    labels = set_labels(docs, classes)
    if labels is None:
        return classes.withColumn("label", F.col("set_id"))
    return classes.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, set_id."""
    rows = classes_of(docs)
    first = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("first_id", "doc_id").alias("component_id"), "set_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of every component, with the columns of ``docs``.

    A null doc_id comes after all others; among equal ids the smallest digest of the text
    decides, and rows equal in id and text are one document.  Documents without words stay.
    """
    key = free_name(docs, "jaccard_row")
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest)
    rows = classes_of(docs.select(row.alias("doc_id"), "text"))
    firsts = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("doc_id"))
    staying = firsts.select("doc_id").unionByName(rows.filter("label is null").select("doc_id"))
    staying = staying.select(_row_key(F.col("doc_id.id"), F.col("doc_id.digest")).alias(key))
    keyed = docs.withColumn(key, _row_key(F.col("doc_id"), digest))
    return keyed.join(staying, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def _row_key(doc_id, digest):
    return F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), F.lit("|"), digest)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("set_id")
