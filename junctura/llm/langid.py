"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from junctura.llm.shared import stage

UNKNOWN = "und"
# Buckets of hashed n-grams, centroids per language, and labelled texts fitted per language.
BUCKETS = 1 << 14
CENTROIDS = 3
SAMPLE = 1_000
ROUNDS = 12
SEED = 17
# A text is rejected below this share of the least cosine that a centroid's own texts have.
REACH = 0.5
# Characters that are hashed at a time.
CHUNK = 1 << 18


@cache
def _fold() -> np.ndarray:
    """Lower case of each letter's code point, and a space for anything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the text's n-grams of one to three characters, in lower case.

    Everything that isn't a letter counts as a space, and runs of spaces as one. A text without a
    letter has none.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    fold = _fold()
    kept = np.array([32], np.uint32)
    for at in range(0, len(codes) + 1, CHUNK):
        part = np.concatenate((kept[-3:], fold[codes[at : at + CHUNK]]))
        if at + CHUNK > len(codes):
            part = np.append(part, np.uint32(32))
        blank = part == 32
        part = part[~(blank & np.concatenate(([False], blank[:-1])))]
        done = min(3, len(kept))
        one, two = part[:-1], part[1:]
        hashes = [part * np.uint32(2654435761), one * np.uint32(2246822519) + two * np.uint32(3266489917)]
        if len(part) > 2:
            hashes.append(
                part[:-2] * np.uint32(668265263) + part[1:-1] * np.uint32(374761393) + part[2:] * np.uint32(2869860233)
            )
        # Only n-grams that end in new characters count.
        new = [h[max(0, done - n) :] for n, h in enumerate(hashes)]
        mixed = np.concatenate(new)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(739982445)
        total += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
        kept = part
    if len(kept) <= 1 and not (fold[codes] != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


def weighted(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length; term frequency counts by its logarithm."""
    weights = np.log1p(counts) * idf[buckets]
    norm = np.sqrt(weights @ weights)
    return weights / norm if norm else weights


def cluster(vectors: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit vectors by spherical k-means, and the least cosine within each.

    Starts from the vector nearest to the mean, then those farthest from what is chosen, so equal
    input gives equal centroids; duplicates of a centroid are left out.
    """
    nearest = vectors @ vectors.mean(axis=0)
    chosen = [int(np.argmax(nearest))]
    while len(chosen) < min(centroids, len(vectors)):
        far = int(np.argmin((vectors @ vectors[chosen].T).max(axis=1)))
        if far in chosen:
            break
        chosen.append(far)
    centres = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.array([vectors[own == i].sum(axis=0) for i in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1)
        centres = sums[norms > 0] / norms[norms > 0, None]
    cosines = vectors @ centres.T
    own = np.argmax(cosines, axis=1)
    used = np.unique(own)
    return centres[used], np.array([cosines[own == i, i].min() for i in used])


@dataclass
class Model:
    """Names, centroids (buckets by centroids), least cosines of the centroids, and IDF weights."""

    langs: list[str]
    centres: np.ndarray
    reach: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the cosine with its nearest centroid, and whether that is too far off."""
        buckets, counts = grams(text)
        if not len(buckets) or not self.langs:
            return UNKNOWN, 0.0, True
        cosines = weighted(buckets, counts, self.idf) @ self.centres[buckets]
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[best], score, score < REACH * float(self.reach[best])


def fit(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE,
    centroids: int = CENTROIDS,
) -> Model:
    """Fit on at most ``sample`` labelled texts per language, those with the smallest seeded digest.

    The texts are chosen by key, language and the digest of the text: a threshold from the language's
    count lets about twice ``sample`` of them through, whatever its size, and those are ranked. Rows equal
    in all three count once, so neither null nor repeated keys crowd the sample. Then whole texts are
    read for what was chosen. Document frequencies are counted by
    Spark, and each language is clustered in a task of its own over its bounded sample. The model is
    ``centroids`` x ``BUCKETS`` numbers per language. Rows without language are left out, and so are
    texts without a letter; without rows the model is empty and predicts ``und``.
    """
    rows = labelled.filter(F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("body")
    )
    # A struct compares nulls as equal.
    name = F.struct("key", "lang", F.xxhash64("body").alias("text"))
    names = stage(rows.select(name.alias("name")).distinct(), "names").withColumn("lang", F.col("name.lang"))
    counts = stage(names.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    digest = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "name.key", "name.text"), 11)
    place = F.row_number().over(W.partitionBy("lang").orderBy("digest", "name"))
    chosen = stage(
        names.withColumn("digest", digest)
        .join(counts, "lang")
        .filter(F.col("digest") / float(1 << 53) <= 2.0 * sample / F.col("rows"))
        .withColumn("place", place)
        .filter(F.col("place") <= sample)
        .select("name"),
        "chosen",
    )
    texts = rows.withColumn("own", name).join(chosen, F.col("own") == chosen.name, "left_semi")
    texts = texts.groupBy("own").agg(F.first("lang").alias("lang"), F.first("body").alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].tolist() for f in found], pa.list_(pa.int64())),
                ],
                ["lang", "buckets", "counts"],
            )

    vectors = stage(
        texts.select("lang", "body")
        .mapInArrow(count, "lang string, buckets array<int>, counts array<bigint>")
        .filter(F.size("buckets") > 0),
        "vectors",
    )
    n = vectors.count()
    idf = np.full(BUCKETS, np.log(1.0 + n) + 1.0)
    for bucket, df in vectors.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        idf[bucket] = np.log((1.0 + n) / (1.0 + df)) + 1.0

    def cluster_language(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["counts", "buckets"], key=lambda c: c.map(lambda x: tuple(x[:50])))
        dense = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (b, c) in enumerate(zip(rows["buckets"], rows["counts"], strict=True)):
            dense[i, b] = weighted(np.asarray(b), np.asarray(c), idf)
        centres, reach = cluster(dense, centroids)
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "place": range(len(centres)), "centre": list(centres), "reach": reach}
        )

    found = (
        vectors.groupBy("lang")
        .applyInPandas(cluster_language, "lang string, place int, centre array<float>, reach double")
        .orderBy("lang", "place")
        .collect()
    )
    centres = np.array([r.centre for r in found], np.float32).T if found else np.zeros((BUCKETS, 0), np.float32)
    return Model([r.lang for r in found], np.ascontiguousarray(centres), np.array([r.reach for r in found]), idf)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, rejected. The whole text is read.

    ``score`` is the cosine with the nearest centroid, of equally near ones the first by language;
    ``rejected`` says that the text is farther off than ``REACH`` allows, which leaves it to the
    caller to call it ``und``. A null text or one without a letter is ``und``, with score 0.
    Repeated rows and null keys each give a row; an empty table gives none; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(1)]
            types = (pa.string(), pa.float64(), pa.bool_())
            arrays = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, "lang_pred", "score", "rejected"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")
