"""Hard negatives of anchors, found through rotated one-bit codes.

Vectors are scaled to integers and scores are integer inner products.  The index stores
for every row a few one-bit codes: the vector is rotated, the signs of its coordinates are
the first code, the signs of what the code leaves over are the next one, and so on.  With
each code goes the alignment of the rotated vector with it, and the norm of the rest.

A score is estimated from the codes and a query cut into bit planes, by AND and popcount.
What the codes leave over is orthogonal to the last code, so the Cauchy-Schwarz inequality
bounds its part in the score, with no probability involved.  A row whose interval cannot
hold a wanted score is passed over; first by one code, then by all.  The rest are scored
in integers.  The result is exact: it does not depend on the rotation.

Rows are dealt by hash into blocks of bounded size.  Anchors, one row in a hundred, are
copied to every block and stream past it, so rows are shuffled once for each of the two
passes (positives, then negatives) and no block, anchor or label is gathered in one place.
Each block gives the best few rows of every anchor, which are then ranked per anchor.

Defined cases: rows with a null vec_id, label or vector and rows with a null or non-finite
component take no part; rows repeated in full count once; rows that share the anchor's
vec_id are not other rows; ties go by vec_id; rows of different length never meet; an empty
vector scores 0 with every other; very long vectors make blocks of fewer rows; an anchor
without other rows of its label has no positives and gives no rows; an empty table gives an
empty result; other columns are not read.  Components are taken to stay below 2^20, so that
integers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import table

SCALE = 256
#: One-bit codes a row, and bit planes of a query.
CODES, PLANES = 6, 8
#: Rows of a block at most, and bytes of its integer vectors at most.
BLOCK_ROWS, BLOCK_BYTES = 1 << 18, 64 << 20
#: Rows a block has at least before work is cut into more blocks than memory asks for.
SMALL_BLOCK = 4096
#: Anchors and rows compared at once.
ANCHOR_TILE, ROW_TILE = 128, 4096
#: Pairs whose vectors are gathered at once.
PAIRS = 1 << 16
POSITIVES, NEGATIVES = 5, 5
#: Bounds are widened by this share of the product of norms, far above rounding errors.
SLACK = 1e-9
SEED = 20


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, dim, ints, akey): rows that take part, their vector as integers.

    ``akey`` tells rows apart that share a vec_id.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        ints.alias("ints"),
    ).select("*", F.size("ints").alias("dim"), F.xxhash64("vec_id", "label", "ints").alias("akey"))


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix that depends on the dimension only."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    n, dim = bits.shape
    words = np.zeros((n, max(1, -(-dim // 64)) * 8), np.uint8)
    words[:, : -(-dim // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return words.view(np.uint64)


def encoded(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x CODES x words) and figures (rows x CODES + 2) of integer vectors.

    Figures are the norm, the alignment with each code and the norm of the rest, the last
    two for the vector scaled to length 1.
    """
    n, dim = ints.shape
    vectors = ints.astype(np.float64)
    norm = np.sqrt((vectors * vectors).sum(1))
    rest = vectors / np.where(norm > 0, norm, 1)[:, None] @ rotation(dim).T if dim else vectors
    codes, aligned = [], []
    for _ in range(CODES):
        bits = rest > 0
        along = np.abs(rest).sum(1) / np.sqrt(max(dim, 1))
        rest = rest - np.where(bits, 1, -1) * (along / np.sqrt(max(dim, 1)))[:, None]
        codes.append(packed(bits))
        aligned.append(along)
    left = np.sqrt((rest * rest).sum(1))
    return np.stack(codes, 1), np.column_stack([norm, *aligned, left])


def _ints_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            ints = _ints_of(part, int(dim))
            codes, figures = encoded(ints)
            small = np.abs(ints).max(initial=0) < 1 << 15
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("vec_id", "akey", "label", "dim")),
                    pa.array([bool(small)] * part.num_rows),
                    pa.array([x.tobytes() for x in (ints.astype(np.int16) if small else ints)], pa.binary()),
                    pa.array([x.tobytes() for x in codes], pa.binary()),
                    pa.array([x.tobytes() for x in figures], pa.binary()),
                ],
                names=["vec_id", "akey", "label", "dim", "small", "ints", "codes", "figures"],
            )


INDEX = (
    "vec_id long, akey long, label long, dim int, small boolean, ints binary, codes binary, figures binary"
)


def index(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The stored codes, alignments and integers of every row that takes part, written as a table."""
    return written(usable(embeddings, vector).mapInArrow(_coded, INDEX), "codes")


class Block:
    """Rows of one block and dimension, sorted by label."""

    def __init__(self, rows: dict[str, np.ndarray], dim: int):
        _, first = np.unique(np.column_stack([rows["vec_id"], rows["akey"]]), axis=0, return_index=True)
        order = first[np.lexsort((rows["vec_id"][first], rows["label"][first]))]
        self.dim = dim
        self.ids, self.labels = rows["vec_id"][order], rows["label"][order]
        self.ints, self.codes, self.figures = (rows[k][order] for k in ("ints", "codes", "figures"))


class Queries:
    """A tile of anchors with their bit planes."""

    def __init__(self, rows: dict[str, np.ndarray], dim: int):
        self.ids, self.akeys, self.labels = rows["vec_id"], rows["akey"], rows["label"]
        self.ints, self.norm = rows["ints"].astype(np.int64), rows["figures"][:, 0]
        unit = self.ints / np.where(self.norm > 0, self.norm, 1)[:, None]
        turned = unit @ rotation(dim).T if dim else unit
        self.low = turned.min(1, initial=0)
        self.step = (turned.max(1, initial=0) - self.low) / ((1 << PLANES) - 1)
        level = np.rint((turned - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None])
        level = level.astype(np.int64)
        self.planes = np.stack([packed((level >> j & 1).astype(bool)) for j in range(PLANES)], 1)
        cut = self.low[:, None] + level * self.step[:, None]
        self.total, self.error = cut.sum(1), np.sqrt(((turned - cut) ** 2).sum(1))

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Queries:
        """Some of the anchors."""
        part = object.__new__(Queries)
        part.__dict__.update({name: held[at] for name, held in self.__dict__.items()})
        return part


def _inner(q: Queries, codes: np.ndarray, dim: int) -> np.ndarray:
    """<code, query> (anchors x rows) for codes of +-1/sqrt(dim), by popcounts."""
    count = np.bitwise_count(codes).sum(1, dtype=np.int32)
    weighted = np.zeros((len(q), len(codes)), np.int32)
    for j in range(PLANES):
        for word in range(codes.shape[1]):
            common = np.bitwise_count(q.planes[:, j, word, None] & codes[None, :, word])
            weighted += common.astype(np.int32) << j
    signed = 2 * (q.low[:, None] * count[None] + q.step[:, None] * weighted) - q.total[:, None]
    return signed / np.sqrt(max(dim, 1))


def bounds(q: Queries, b: Block, rows: np.ndarray | slice, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Score intervals (anchors x rows) from the first ``n_codes`` codes.

    The rest is orthogonal to the last code, so the query's part along that code, less what
    the bit planes leave out, is no part of the query's product with the rest.
    """
    codes, figures = b.codes[rows], b.figures[rows]
    aligned = figures[:, 1 : 1 + n_codes]
    estimate = 0
    for k in range(n_codes):
        along = _inner(q, codes[:, k], b.dim)
        estimate = estimate + along * aligned[:, k]
    rest = figures[:, -1] if n_codes == CODES else np.sqrt(np.maximum(1 - (aligned**2).sum(1), 0))
    error = q.error[:, None]
    off = np.sqrt(np.maximum(1 + SLACK - np.maximum(np.abs(along) - error, 0) ** 2, 0))
    half = (rest + SLACK) * off + aligned.sum(1) * error + SLACK
    scale = q.norm[:, None] * figures[:, 0]
    return (estimate - half) * scale, (estimate + half) * scale


def _scores(q: Queries, b: Block, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q.ints[at], b.ints[row].astype(np.int64))


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of every group by score, then vec_id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < n]


class Search:
    """The best ``keep`` rows of every anchor and wanted interval of scores, row tile by row tile.

    ``most`` and ``least`` (anchors x intervals) hold the limits, from above and below;
    least is raised to the score of the last of ``keep`` rows once so many were found.
    """

    def __init__(self, q: Queries, most: np.ndarray, least: np.ndarray, keep: int):
        self.q, self.keep, self.most, self.least = q, keep, most, least
        self.floor = least.astype(np.float64)
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def _fits(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        most, floor = self.most, self.floor
        return np.any(
            [(low <= most[:, k, None]) & (high >= floor[:, k, None]) for k in range(most.shape[1])], axis=0
        )

    def tile(self, b: Block, rows: slice, allowed: np.ndarray) -> None:
        """Rows of a tile, against the anchors that ``allowed`` (anchors x rows) names."""
        fits = self._fits(*bounds(self.q, b, rows, 1)) & allowed
        open_ = np.flatnonzero(fits.any(0))
        fits, row = fits[:, open_], np.arange(rows.start, rows.stop)[open_]
        low, high = bounds(self.q, b, row, CODES)
        self._raise(fits, low, high)
        at, column = np.nonzero(fits & self._fits(low, high))
        for i in range(0, len(at), PAIRS):
            a, r = at[i : i + PAIRS], row[column[i : i + PAIRS]]
            self._add(a, _scores(self.q, b, a, r), b.ids[r])

    def _raise(self, fits: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Lift the floors to the last of ``keep`` scores that rows sure to fit reach at least."""
        if fits.shape[1] < self.keep:
            return
        for k in range(self.most.shape[1]):
            sure = fits & (high <= self.most[:, k, None]) & (low >= self.least[:, k, None])
            reached = np.where(sure, low, -np.inf)
            last = np.partition(reached, -self.keep, axis=1)[:, -self.keep]
            self.floor[:, k] = np.maximum(self.floor[:, k], last)

    def _lift(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the best rows of every group, whose floor they lift where they are enough."""
        best = _best(group, score, ids, self.keep)
        full, count = np.unique(group[best], return_counts=True)
        enough, last = count == self.keep, np.cumsum(count) - 1
        floor = self.floor.reshape(-1)
        floor[full[enough]] = np.maximum(floor[full[enough]], score[best][last[enough]])
        return best

    def _add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        n = self.most.shape[1]
        new = [(self.group, self.score, self.ids)]
        for k in range(n):
            fits = (score <= self.most[at, k]) & (score >= self.least[at, k])
            new.append((at[fits] * n + k, score[fits], ids[fits]))
        group, score, ids = (np.concatenate(x) for x in zip(*new, strict=True))
        best = self._lift(group, score, ids)
        self.group, self.score, self.ids = group[best], score[best], ids[best]

    def batch(self) -> pa.RecordBatch:
        """What was found, as rows of FOUND."""
        at, place = np.divmod(self.group, self.most.shape[1])
        columns = [self.q.ids[at], self.q.akeys[at], place.astype(np.int32), self.ids, self.score]
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in columns], names=["anchor_id", "akey", "place", "found_id", "score"]
        )


NO_LIMIT = 1 << 62


def _positives(q: Queries, b: Block) -> Iterator[Search]:
    for label in np.unique(q.labels):
        mine = q.take(np.flatnonzero(q.labels == label))
        search = Search(mine, np.full((len(mine), 1), NO_LIMIT), np.full((len(mine), 1), -NO_LIMIT), POSITIVES)
        start, end = np.searchsorted(b.labels, [label, label + 1])
        for s in range(start, end, ROW_TILE):
            rows = slice(s, min(end, s + ROW_TILE))
            search.tile(b, rows, mine.ids[:, None] != b.ids[rows][None])
        yield search


def _negatives(q: Queries, b: Block, positives: np.ndarray) -> Iterator[Search]:
    """``positives``: scores (anchors x POSITIVES), those missing below zero."""
    most = np.where(positives < 0, -1, positives)
    least = np.where(positives < 0, 0, -(-80 * positives // 100))  # of no use: most < least
    search = Search(q, most, least, NEGATIVES)
    for s in range(0, len(b.ids), ROW_TILE):
        rows = slice(s, min(len(b.ids), s + ROW_TILE))
        search.tile(b, rows, q.labels[:, None] != b.labels[rows][None])
    yield search


def _arrays(batch: pa.RecordBatch, dim: int) -> dict[str, np.ndarray]:
    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)

    n, out = batch.num_rows, {}
    for name in ("vec_id", "akey", "label"):
        out[name] = batch.column(name).to_numpy(zero_copy_only=False)
    small = batch.column("small").to_numpy(zero_copy_only=False).astype(bool)
    ints = np.zeros((n, dim), np.int16 if small.all() else np.int64)
    blobs = batch.column("ints").to_pylist()
    for kind, held in ((np.int16, small), (np.int64, ~small)):
        part = b"".join(blobs[i] for i in np.flatnonzero(held))
        ints[held] = np.frombuffer(part, kind).reshape(int(held.sum()), dim)
    out["ints"] = ints
    out["codes"] = joined("codes", np.uint64).reshape(n, CODES, -1)
    out["figures"] = joined("figures", np.float64).reshape(n, CODES + 2)
    return out


def _meet(batches: Iterator[pa.RecordBatch], negatives: bool) -> Iterator[pa.RecordBatch]:
    """Best rows of every anchor; rows of a block come before its anchors."""
    key, rows, block = None, [], None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "dim", "is_anchor")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            if start == end:
                continue
            here, anchors = (int(keys[start, 0]), int(keys[start, 1])), bool(keys[start, 2])
            if here != key:
                key, rows, block = here, [], None
            part, dim = batch.slice(start, end - start), here[1]
            if not anchors:
                rows.append(_arrays(part, dim))
                continue
            if block is None:
                if not rows:
                    continue
                block = Block({k: np.concatenate([r[k] for r in rows]) for k in rows[0]}, dim)
                rows = []
            for s in range(0, part.num_rows, ANCHOR_TILE):
                tile = part.slice(s, ANCHOR_TILE)
                q = Queries(_arrays(tile, dim), dim)
                if negatives:
                    scores = np.full((len(q), POSITIVES), -1, np.int64)
                    for i, known in enumerate(tile.column("scores").to_pylist()):
                        scores[i, : len(known)] = known
                    searches = _negatives(q, block, scores)
                else:
                    searches = _positives(q, block)
                for found in searches:
                    yield found.batch()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _meet(batches, False)


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _meet(batches, True)


FOUND = "anchor_id long, akey long, place int, found_id long, score long"


def _block_count(rows: DataFrame) -> int:
    """Blocks that fit in memory, and enough of them for all cores where rows are few."""
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    most = max(1024, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dim or 1, 1))))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // most), min(cores, n // SMALL_BLOCK))


def meet(rows: DataFrame, anchors: DataFrame, n_blocks: int, negatives: bool) -> DataFrame:
    """The best rows of each block for every anchor, ranked over all blocks."""
    own = F.pmod(F.xxhash64("vec_id", "akey"), F.lit(n_blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    scores = F.col("scores") if negatives else F.lit(None).cast("array<long>")
    columns = ["vec_id", "akey", "label", "dim", "small", "ints", "codes", "figures"]
    held = rows.select(*columns, F.lit(None).cast("array<long>").alias("scores"), own.alias("block"), F.lit(0).alias("is_anchor"))
    asked = anchors.select(*columns, scores.alias("scores"), every.alias("block"), F.lit(1).alias("is_anchor"))
    dealt = held.unionByName(asked).repartition(n_blocks, "block")
    found = dealt.sortWithinPartitions("block", "dim", "is_anchor").mapInArrow(
        _second_pass if negatives else _first_pass, FOUND
    )
    best = Window.partitionBy("anchor_id", "akey", "place").orderBy(F.desc("score"), "found_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= (NEGATIVES if negatives else POSITIVES))


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    moved = (F.col("label") + 1) % classes
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label")))


def hard_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` is an index; for every anchor and each of its positives, the first rows of
    another label that score from 80 to 100 per cent of the positive.
    """
    n_blocks = _block_count(rows)
    anchors = rows.filter(is_anchor).dropDuplicates(["vec_id", "akey"])
    positives = written(meet(rows, anchors, n_blocks, False), "positives")
    # POSITIVES scores an anchor at most
    known = positives.groupBy("anchor_id", "akey").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("scores")
    ).select(F.col("anchor_id").alias("vec_id"), "akey", F.col("scores.score").alias("scores"))
    negatives = meet(rows, anchors.join(known, ["vec_id", "akey"]), n_blocks, True)
    named = positives.select(
        "anchor_id", "akey", (F.col("rank") - 1).alias("place"),
        F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return negatives.join(named, ["anchor_id", "akey", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND label IS NOT NULL")
    return hard_negatives(index(relabelled(given)), F.col("vec_id") % 100 == 0)
