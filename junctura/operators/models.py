"""Logistic models on hashed receptor-by-peptide tokens, learned one example at a time."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.fixed import EPITOPE_CAP, EPITOPES, EPOCHS, HASH_BITS, L2, LEARNING_RATE, SEED
from junctura.functions.crossing import Cross
from junctura.session import stage

# Most training examples one sequential fit may hold: every capped group, with one negative per positive.
FIT_ROWS = EPITOPE_CAP * EPITOPES * 2
# Examples that are scored as one slice.
SCORE_ROWS = 20_000


def _lists(column) -> list:
    """The lists of a pandas or Arrow column as arrays; a missing one is empty."""
    import numpy as np

    values = column.to_pylist() if hasattr(column, "to_pylist") else column
    return [np.zeros(0, np.int64) if x is None else np.asarray(x) for x in values]


def _visit_order(keys: Sequence[str], seed: int, epoch: int) -> list[int]:
    """Examples in the order of an epoch: by the MD5 of seed, epoch and key, equal keys as they stand."""
    from hashlib import md5

    order = [md5(f"{seed}:{epoch}:{k}".encode()).hexdigest() for k in keys]
    return sorted(range(len(keys)), key=order.__getitem__)


def _packed_weights(
    rows: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    label: str,
    key: str,
    epochs: int = EPOCHS,
    rate: float = LEARNING_RATE,
    l2: float = L2,
    bits: int = HASH_BITS,
    seed: int = SEED,
    max_rows: int = FIT_ROWS,
) -> DataFrame:
    """(by.., bucket array, weight array) of each experiment; see :func:`sequential_weights`."""
    rows = rows.select(*by, key, *columns, label)
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > max_rows:
        raise ValueError(f"{largest} training examples in one experiment; cap the groups or use fit_logistic")

    def learn(fit: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        order = [key, label]
        if fit[key].duplicated().any():
            # Rows that share a key go by label and tokens, so that no order of arrival matters.
            text = [b"".join(x.tobytes() for x in r) for r in zip(*(_lists(fit[c]) for c in columns))]
            fit, order = fit.assign(_text=text), [key, label, "_text"]
        fit = fit.sort_values(order, kind="stable")
        lists = [_lists(fit[c]) for c in columns]
        if len(columns) == 1:
            found = lists[0]
        else:
            cross = Cross(*lists, bits)
            found = (cross.buckets(i) for i in range(len(fit)))
        weights, bias, decay = np.zeros(1 << bits), 0.0, 1.0 - l2
        # A token visited m times is decayed and moved m times in turn; this is its closed form.
        visits = [np.unique(x.astype(np.int32), return_counts=True) for x in found]
        repeats = max((int(m.max()) for _, m in visits if len(m)), default=1)
        powers = decay ** np.arange(repeats + 1)
        moves = (1.0 - powers) / l2 if l2 else np.arange(repeats + 1.0)
        wanted, keys = fit[label].to_numpy(), fit[key].tolist()
        for epoch in range(epochs):
            for at in _visit_order(keys, seed, epoch):
                slots, times = visits[at]
                current = weights[slots]
                z = bias + float(current @ times)
                p = 1.0 if z > 30 else 0.0 if z < -30 else 1.0 / (1.0 + np.exp(-z))
                step = (p - wanted[at]) * rate
                bias -= step
                weights[slots] = current * powers[times] - step * moves[times]
        touched = np.flatnonzero(weights)
        learned = {name: [fit[name].iloc[0]] for name in by}
        learned |= {"bucket": [np.append(-1, touched)], "weight": [np.append(bias, weights[touched])]}
        return pd.DataFrame(learned)

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in by] + ["bucket array<int>", "weight array<double>"])
    return rows.groupBy(*by).applyInPandas(learn, schema)


def sequential_weights(
    examples: DataFrame,
    by: Sequence[str],
    tokens: str | Sequence[str] = "idx",
    label: str = "label",
    key: str = "example",
    **options: float,
) -> DataFrame:
    """(by.., bucket, weight) learned one example at a time; bucket -1 is the bias.

    ``tokens`` names a column of buckets, or the columns ``SIDES`` of a cross, whose buckets are then made
    where they are used. Stochastic descent is sequential within an experiment, so each runs in one task
    and the experiments run side by side. The caps of the design bound an experiment's training rows; a
    larger one is refused, and ``logistic.fit_logistic`` is the distributed model for it. Each epoch visits the
    examples in the order of a digest of its number and their keys, so that the weights can be worked out
    again by any other means. The options are those of the fit: epochs, rate, l2, bits, seed, max_rows.
    """
    columns = [tokens] if isinstance(tokens, str) else list(tokens)
    packed = _packed_weights(stage(examples.select(*by, key, *columns, label)), by, columns, label, key, **options)
    pairs = F.explode(F.arrays_zip("bucket", "weight")).alias("pair")
    return packed.select(*by, pairs).select(*by, "pair.bucket", "pair.weight")


def _sliced_scores(
    rows: DataFrame, packed: DataFrame, by: Sequence[str], columns: Sequence[str], bits: int, slice_rows: int
) -> DataFrame:
    """Scores of written ``rows`` under packed weights; see :func:`linear_scores`."""
    others = [c for c in rows.columns if c not in columns]
    sizes = stage(rows.groupBy(*by).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_slices")))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).join(sizes, list(by))
    dealt = dealt.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.col("_slices")).cast("int"))
    copies = packed.join(sizes, list(by)).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in others)

    def score(slice_: pa.Table, learned: pa.Table) -> pa.Table:
        import numpy as np

        dense, bias = np.zeros(1 << bits), 0.0
        if learned.num_rows:
            at = learned.column("bucket").combine_chunks().flatten().to_numpy()
            value = learned.column("weight").combine_chunks().flatten().to_numpy()
            dense[at[at >= 0]] = value[at >= 0]
            bias = float(value[at < 0].sum())
        lists = [_lists(slice_.column(c)) for c in columns]
        if len(columns) == 1:
            own = np.repeat(np.arange(slice_.num_rows), [len(x) for x in lists[0]])
            flat = np.concatenate([np.zeros(0, np.int64), *lists[0]]).astype(np.int64)
            sums = np.bincount(own, weights=dense[flat], minlength=slice_.num_rows)
        else:
            sums = Cross(*lists, bits).sums(dense)
        return slice_.select(others).append_column("score", pa.array(bias + sums))

    keys = [*by, "_slice"]
    left = dealt.select(*rows.columns, "_slice").groupBy(*keys)
    right = copies.select(*keys, "bucket", "weight").groupBy(*keys)
    return left.cogroup(right).applyInArrow(score, f"{schema}, score double")


def linear_scores(
    examples: DataFrame,
    weights: DataFrame,
    by: Sequence[str],
    tokens: str | Sequence[str] = "idx",
    bits: int = HASH_BITS,
    slice_rows: int = SCORE_ROWS,
) -> DataFrame:
    """``examples`` without their tokens but with ``score``: the bias of the experiment and the weights
    of the example's buckets, each as often as it occurs.

    The examples of an experiment are dealt into slices of about ``slice_rows``, and each slice meets one
    copy of the experiment's weights, which become a dense vector of 2 ** ``bits`` numbers there. No row
    a token is made or shuffled: a slice moves its examples and the weights once.
    """
    columns = [tokens] if isinstance(tokens, str) else list(tokens)
    pair = F.struct(F.col("bucket").cast("int").alias("b"), F.col("weight").cast("double").alias("w"))
    packed = weights.groupBy(*by).agg(F.collect_list(pair).alias("p"))
    packed = packed.select(*by, F.col("p.b").alias("bucket"), F.col("p.w").alias("weight"))
    return _sliced_scores(stage(examples), packed, by, columns, bits, slice_rows)


def sequential_fits(
    examples: DataFrame,
    by: Sequence[str],
    tokens: str | Sequence[str] = "idx",
    label: str = "label",
    train: str = "in_train",
    key: str = "example",
    bits: int = HASH_BITS,
    slice_rows: int = SCORE_ROWS,
    **options: float,
) -> DataFrame:
    """Score the test examples of every experiment with weights learned from its training examples."""
    columns = [tokens] if isinstance(tokens, str) else list(tokens)
    rows = stage(examples.select(*by, key, *columns, label, train))
    packed = stage(_packed_weights(rows.filter(train), by, columns, label, key, bits=bits, **options))
    return _sliced_scores(rows.filter(~F.col(train)).drop(train), packed, by, columns, bits, slice_rows)
