"""Near-duplicates by the Jaccard similarity of their shingles: MinHash bands find pairs, whole sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.components import components
from junctura.llm.shared import packed, stage
from junctura.llm.simhash import near_groups

SHINGLE = 5
# The least similarity, as a fraction, so that the comparison is exact.
LEAST = (4, 5)
# A pair of similarity s shares no band with a probability of (1 - s ** WIDTH) ** BANDS: 3e-6 at 0.8.
BANDS = 32
WIDTH = 5
SEED = 42
# Shingles that are hashed anew at a time.
CHUNK = 1 << 12
# Buckets of up to this many rows are compared pair by pair; larger ones meet on differences. Both give the same links.
PAIRWISE = 4
# Rows from which the centre of a bucket is made. Any centre gives the same links, a better one fewer candidates.
CENTRE = 9

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, (BANDS * WIDTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 1 << 63, (BANDS, WIDTH), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 digests of each run of ``shingle`` words.

    Words are those of the fingerprints; a text with fewer of them is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    width = max(min(shingle, len(words)), 1)
    pairs = zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One number a band, made of the smallest of the digests under ``WIDTH`` orders."""
    lows = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(lows, (_FACTORS * found[at : at + CHUNK]).min(axis=1), out=lows)
    return (lows.reshape(BANDS, WIDTH) * _MIX).sum(axis=1, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, n, buckets) of each row (id, body); n counts its distinct shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), shingle)
                sizes.append(len(found))
                own.append(bands(found).view(np.int64))
            buckets = pa.ListArray.from_arrays(
                pa.array(np.arange(0, BANDS * len(own) + 1, BANDS), pa.int32()),
                pa.array(np.concatenate(own) if own else [], pa.int64()),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), buckets], ["id", "n", "buckets"])

    return rows.mapInArrow(work, "id bigint, n int, buckets array<bigint>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, found) of each row (id, body): its shingles as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(text.as_py(), shingle).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "found"])

    return rows.mapInArrow(work, "id bigint, found binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3), strict=True)
            kept = [
                similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in sides
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(work, "a bigint, b bigint")


def _sized(x: str, y: str) -> str:
    """Sets of other sizes can't be similar enough."""
    return f"least({x}, {y}) * {LEAST[1]} >= greatest({x}, {y}) * {LEAST[0]}"


def centre_of(sets: list[np.ndarray]) -> np.ndarray:
    """The shingles of more than half of the sets, sorted."""
    found, counts = np.unique(np.concatenate(sets), return_counts=True)
    return found[2 * counts > len(sets)]


def _centres(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, centre): the majority of at most ``CENTRE`` rows of each bucket, one for each rest of a digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [centre_of([np.frombuffer(x, np.uint64) for x in own.as_py()]).tobytes() for own in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["bucket", "centre"])

    part = F.pmod(F.xxhash64("id"), F.lit(CENTRE)).alias("part")
    taken = rest.groupBy("bucket", part).agg(F.min("id").alias("id"))
    own = taken.join(sets, "id").groupBy("bucket").agg(F.collect_list("found").alias("own"))
    return own.mapInArrow(work, "bucket bigint, centre binary")


def _differences(rest: DataFrame, sets: DataFrame, centres: DataFrame) -> DataFrame:
    """``rest`` with ``differs``, the shingles that a row has and its bucket's centre has not or the other way round.

    ``over`` is 9 * |differs| - n: two rows x and y of one bucket are similar if and only if their
    differences share at least (x.over + y.over) / 18 shingles. For the sets differ from each other in
    |x.differs| + |y.differs| - 2 * shared, and a similarity of 0.8 allows (x.n + y.n) / 9 of that.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.setxor1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)
                for x, y in zip(batch.column(4), batch.column(5), strict=True)
            ]
            sizes = np.array([len(x) for x in found], np.int64)
            differs = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()),
            )
            over = pa.array(9 * sizes - batch.column(2).to_numpy())
            columns = [*batch.columns[:4], over, differs]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "id", "n", "root", "over", "differs"])

    both = rest.join(sets, "id").join(centres, "bucket").select("bucket", "id", "n", "root", "found", "centre")
    return both.mapInArrow(work, "bucket bigint, id bigint, n int, root bigint, over bigint, differs array<bigint>")


def _large_bucket_links(rest: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, candidates) of buckets (bucket, id, n, root) in which near copies may abound; each as (a, b).

    Rows are told by their differences from a centre of the bucket (see ``_differences``). The row
    with the least ``over`` is its pivot. Rows whose ``over`` and the pivot's add up to zero or less
    are similar to it whatever they share, and so is one of any two rows that need to share nothing;
    all those are linked to the pivot. Every other pair must share some shingles of its differences,
    so it meets on a prefix of them, rarest ones first: of d differences of which a partner has to
    share t, any d - t + 1 hold a shared one. Edits made independently share next to nothing.
    """
    centres = stage(_centres(rest, sets), "centres")
    told = stage(_differences(rest, sets, centres), "differences")
    pivots = told.groupBy("bucket").agg(F.min(F.struct("over", "id")).alias("pivot"))
    pivots = stage(pivots.select("bucket", F.col("pivot.over").alias("base"), F.col("pivot.id").alias("pivot")), "pivots")
    told = told.join(pivots, "bucket").withColumn("sure", F.col("over") + F.col("base") <= 0)
    links = told.filter("sure AND id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    # What a partner has to share: rows that are linked to the pivot seek only those that are not. A
    # partner has at most 5/4 as many shingles, so all but n / 4 differences are shared by it as well.
    alone = F.expr("ceil((over + base) / 18)")
    linked = F.expr("floor((over - base) / 18) + 1")
    needed = F.greatest(F.when(F.col("sure"), linked).otherwise(alone), F.expr("size(differs) - floor(n / 4)"), F.lit(1))
    told = stage(told.withColumn("needed", needed).filter("needed <= size(differs)"), "told")
    each = told.select("bucket", "id", F.explode("differs").alias("shingle"))
    counts = each.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    counts = stage(counts, "counts")
    # A row's shingles that others of its bucket differ in as well, rarest first.
    common = each.join(counts, ["bucket", "shingle"]).groupBy("bucket", "id")
    common = common.agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("common"))
    common = common.join(told.drop("differs"), ["bucket", "id"]).filter("needed <= size(common)")
    prefix = F.posexplode(F.expr("slice(common, 1, int(size(common) - needed + 1))")).alias("at", "one")
    keys = common.select("bucket", "id", "n", "root", "over", "sure", F.size("common").alias("size"), prefix)
    keys = keys.withColumn("shingle", F.col("one.shingle")).withColumn("most", F.col("size") - F.col("at"))
    keys = stage(keys.drop("one", "at", "size"), "keys")
    x, y = keys.alias("x"), keys.alias("y")
    pairs = x.join(y, ["bucket", "shingle"]).filter("x.id < y.id AND x.root <> y.root AND NOT (x.sure AND y.sure)")
    # From the first shared shingle on, both must hold as many as the pair needs.
    pairs = pairs.filter(_sized("x.n", "y.n")).filter("18 * least(x.most, y.most) >= x.over + y.over")
    return links, pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def similar_links(rows: DataFrame, shingle: int = SHINGLE, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges (a, b) that connect the rows (id, body) as all similar pairs that share a band would.

    The members of a bucket are first compared with its smallest one. Pairs that this connects need
    no comparison of their own, so a large group of near copies costs a few per member. What is left
    of a bucket is compared one by one if it has at most ``pairwise`` rows, and otherwise by what
    differs from its centre. Sets are built for rows that share a bucket only.
    """
    sketched = stage(_sketches(rows, shingle), "sketches")
    keys = sketched.select("id", "n", F.explode("buckets").alias("bucket"))
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot bucket.
    lows = keys.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("low"), F.count(F.lit(1)).alias("size"))
    lows = stage(lows.filter("size > 1").select("bucket", "low"), "lows")
    members = stage(keys.join(lows, "bucket"), "members")
    first = members.filter("id <> low.id").filter(_sized("n", "low.n"))
    first = stage(first.select(F.col("low.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sets = stage(_sets(rows.join(members.select("id").distinct(), "id", "left_semi"), shingle), "sets")
    links = stage(_confirmed(first, sets), "links")
    rooted = members.select("bucket", "id", "n").join(components(links).withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    # Buckets whose members are connected are done.
    mixed = rooted.groupBy("bucket").agg(
        F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("size")
    )
    mixed = stage(mixed.filter("r <> s").select("bucket", "size"), "mixed")
    rest = stage(rooted.join(mixed, "bucket"), "rest")
    small = rest.filter(F.col("size") <= pairwise)
    x, y = small.alias("x"), small.alias("y")
    others = x.join(y, "bucket").filter("x.id < y.id AND x.root <> y.root").filter(_sized("x.n", "y.n"))
    others = others.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = rest.filter(F.col("size") > pairwise).select("bucket", "id", "n", "root")
    more, found = _large_bucket_links(large, sets)
    others = others.unionByName(found).distinct()
    others = stage(others.join(first, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(more).unionByName(_confirmed(others, sets))


def drop_similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, fingerprints: bool = False
) -> DataFrame:
    """One row of each component of similar texts, with its columns as they are.

    Texts are linked if the Jaccard similarity of their shingles is at least ``LEAST``. Of linked
    rows the one with the smallest key stays; a null key stays only where there is no other, and of
    rows that repeat the key one stays. Rows are told apart by a number of their own, so nulls and
    repeated keys drop nothing else. Texts without words are alike. With ``fingerprints`` the groups of
    near fingerprints (see :func:`near_groups`) are linked as well; links of both kinds reach through each other.
    """
    rows = stage(packed(docs, id=F.monotonically_increasing_id()), "rows")
    own = rows.select("id", F.col(f"doc.`{text}`").cast("string").alias("body"))
    links = similar_links(own, shingle)
    if fingerprints:
        groups = near_groups(own, "id", "body").filter("component_id <> id")
        links = links.unionByName(groups.select(F.col("component_id").alias("a"), F.col("id").alias("b")))
    roots = stage(components(links), "roots")
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    keys = rows.select("id", F.col(f"doc.`{key}`").alias("key"), F.xxhash64(f"doc.`{text}`").alias("digest"))
    keys = stage(keys.join(named, keys.id == named.node), "keys")
    lows = stage(keys.groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "digest", "id")).alias("low")), "lows")
    gone = stage(keys.join(lows, "root").filter("id <> low.id").select("id"), "gone")
    return rows.join(gone, "id", "left_anti").select("doc.*")
