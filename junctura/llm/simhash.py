"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.components import components
from junctura.llm.shared import packed, stage

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
# Buckets up to this size are compared pair by pair, larger ones through common neighbours.
BUCKET = 32
# Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number.

    Words are runs of anything but ASCII white space, with A-Z in lower case. Each run of
    ``shingle`` words, repeats included, is hashed by XXH64; a text with fewer words is one shingle.
    A bit is set if it is set in more than half of the hashes. No words: zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    width = min(shingle, len(words))
    count = len(words) - width + 1
    del words
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, CHUNK):
        # Places as Python numbers and hashes of one chunk at a time.
        some = slice(at, min(at + CHUNK, count))
        pairs = zip(starts[some].tolist(), ends[width - 1 :][some].tolist(), strict=True)
        part = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, some.stop - at)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """(key, fp) of each row; the texts themselves are not shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["key", "fp"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body"))
    return rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint")


def covering_masks(radius: int) -> list[int]:
    """Masks of which, for any two fingerprints within ``radius`` bits, one hides every difference.

    Bit i gets a nonzero vector of radius + 1 bits; the mask of a nonzero vector v shows the bits
    whose vector has an odd product with v. At most ``radius`` differing bits span a proper
    subspace, so some v is orthogonal to it, and the mask of that v shows none of them.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _small_bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Links within buckets of at most ``BUCKET`` fingerprints, by comparing them."""
    lists = members.groupBy("t", "bucket").agg(F.collect_list("fp").alias("fps"))
    fps = F.col("fps")
    near = F.flatten(
        F.transform(
            fps,
            lambda x: F.transform(
                F.filter(fps, lambda y: (y > x) & (_distance(x, y) <= radius)),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        )
    )
    return lists.select(F.explode(near).alias("link")).select("link.a", "link.b")


def _flips(hidden: list[int], most: int) -> list[int]:
    return [
        _signed(sum(1 << i for i in chosen))
        for n in range(most + 1)
        for chosen in combinations(hidden, n)
    ]


def _large_bucket_links(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links within larger buckets, without pairs.

    Two fingerprints of a bucket within ``radius`` bits have a number between them that is at most
    half the radius, rounded up, from one and half of it, rounded down, from the other, and differs
    from both in hidden bits only. Every member names the numbers around it; members that name the
    same number are linked to the smallest of them, which connects exactly what pairs would connect
    and leaves groups bounded by the number of flips.
    """
    near, far = radius // 2, radius - radius // 2
    flips = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for t, mask in enumerate(masks):
        hidden = [i for i in range(BITS) if not mask >> i & 1]
        flips = flips.when(F.col("t") == t, F.array(*[F.lit(x).cast("bigint") for x in _flips(hidden, far)]))
    around = members.select("fp", F.explode(flips).alias("flip")).select(
        F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "fp", (F.bit_count("flip") <= near).alias("close")
    )
    groups = around.distinct().groupBy("z").agg(F.collect_list("fp").alias("fps"), F.max("close").alias("linked"))
    return groups.filter((F.size("fps") > 1) & F.col("linked")).select(
        F.explode("fps").alias("a"), F.array_min("fps").alias("b")
    )


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as all pairs within ``radius`` would."""
    masks = covering_masks(radius)
    keys = F.array(
        *[
            F.struct(
                F.lit(t).cast("tinyint").alias("t"),
                F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("bucket"),
            )
            for t, m in enumerate(masks)
        ]
    )
    tables = fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.bucket", "fp")
    # Written, so that both sides of the join are plain shuffles, of which Spark can split a hot bucket.
    sizes = tables.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = stage(sizes, "sizes")
    members = stage(tables.join(sizes, ["t", "bucket"]), "members")
    small = _small_bucket_links(members.filter(F.col("size") <= bucket), radius)
    large = _large_bucket_links(members.filter(F.col("size") > bucket), masks, radius)
    return small.unionByName(large).filter("a <> b").distinct()


def near_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    key that links reach. Equal fingerprints count once in the search, so copies cost nothing there.
    A null or empty text has fingerprint zero and is linked like any other; a null key is reached
    like others but never the smallest, unless a component has no other (then null). Repeated rows
    each give a row. Empty tables give no rows; other columns are ignored.
    """
    found = stage(fingerprints(docs, key, text, shingle), "fingerprints")
    fps = found.groupBy("fp").agg(F.min("key").alias("low"))
    roots = components(near_links(fps.select("fp"), radius, bucket))
    rooted = stage(
        fps.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "low", F.coalesce("root", "fp").alias("root")
        ),
        "roots",
    )
    lows = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    named = rooted.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest key of each component, with its columns as they are.

    Rows of a component that repeat that key all stay; drop exact copies first. Rows are told apart
    by a number of their own, so a null or repeated key drops no row of another component.
    """
    rows = stage(packed(docs, id=F.monotonically_increasing_id()), "rows")
    own = rows.select("id", F.col(f"doc.`{key}`").alias("key"), F.col(f"doc.`{text}`").alias("body"))
    groups = near_groups(own, "id", "body").select("id", F.col("component_id").alias("root"))
    keys = stage(own.select("id", "key").join(groups, "id"), "keys")
    lows = stage(keys.groupBy("root").agg(F.min("key").alias("low")), "lows")
    gone = stage(keys.join(lows, "root").filter(~F.col("key").eqNullSafe(F.col("low"))).select("id"), "gone")
    return rows.join(gone, "id", "left_anti").select("doc.*")
