"""As-of lookups that no key can make lopsided."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import as_list, col, quote, split_null_keys
from relops.staging import CHUNK, ROW, stage_in_order

TIME, VALUE, SIDE, TIE, RUN, LEFT = (f"__relops_{n}" for n in ("time", "value", "side", "tie", "run", "left"))
OF, CARRIED = "__relops_of", "__relops_carried"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str | list[str],
    left_time: str,
    right_time: str,
    value: Column,
    name: str = "latest",
) -> DataFrame:
    """Every left row with the greatest ``value`` among right rows of its group no later than ``left_time``.

    Both sides form one time line, range-partitioned and sorted by (group, time): a group holding a third of it is
    spread over many files. Each task takes the running maximum of its own rows while it writes them, the left rows
    going along whole, so nothing is joined back. Only a file's first group can go on from an earlier file: what is
    carried over is one value per file at most and is broadcast. A left row without a group or time finds nothing.
    ``value`` may be a struct, compared field by field.
    """

    groups = as_list(by)
    keys = [f"__relops_g{i}" for i in range(len(groups))]
    named = [col(g).alias(k) for g, k in zip(groups, keys)]
    known = right.select(*named, col(right_time).alias(TIME), value.alias(VALUE), F.lit(0).alias(SIDE))
    known = known.dropna(subset=[*keys, TIME, VALUE])
    kind = known.schema[VALUE].dataType
    timed, untimed = split_null_keys(left, [*groups, left_time])
    asked = timed.select(*named, col(left_time).alias(TIME), F.lit(1).alias(SIDE), F.struct(*map(col, left.columns)).alias(LEFT))
    line = asked.unionByName(known, allowMissingColumns=True).withColumn(TIE, F.monotonically_increasing_id())
    # The tie keeps equal instants apart, so that a hot one fills several files.
    staged = stage_in_order(line, [*keys, TIME, SIDE, TIE], in_task={RUN: _running(kind)(VALUE, *keys)})

    answers = staged.filter(F.col(SIDE) == 1).join(F.broadcast(_carried(staged, keys)), F.col(CHUNK) == F.col(OF), "left")
    going_on = F.when(F.col(f"{RUN}.first"), F.col(CARRIED))
    found = F.greatest(f"{RUN}.best", going_on).alias(name)
    rows = answers.select(*[F.col(f"{LEFT}.{quote(c)}").alias(c) for c in left.columns if c != name], found)
    rows = rows.select(*[col(c) for c in left.columns if c != name], col(name))
    if untimed is None:
        return rows
    return rows.unionByName(untimed.drop(name).withColumn(name, F.lit(None).cast(kind)))


def _carried(staged: DataFrame, keys: list[str]) -> DataFrame:
    """For each file the greatest value of its first group in all earlier files.

    A group that goes on was the last of every file before, so one row a file says all: two for the window, its first
    group as asking and its last one with its value.
    """

    ends = staged.groupBy(CHUNK).agg(
        F.min_by(F.struct(*keys), ROW).alias("asks"),
        F.max_by(F.struct(*keys), ROW).alias("ends"),
        F.max_by(f"{RUN}.best", ROW).alias("best"),
    )
    both = ends.select(
        CHUNK,
        F.explode(F.array(F.struct(F.lit(0).alias("at"), F.col("asks").alias("of")), F.struct(F.lit(1).alias("at"), F.col("ends").alias("of")))).alias("one"),
        "best",
    )
    before = Window.partitionBy("one.of").orderBy(CHUNK, "one.at").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col("one.at") == 1, F.col("best"))).over(before)
    return both.withColumn(CARRIED, best).filter((F.col("one.at") == 0) & F.col(CARRIED).isNotNull()).select(F.col(CHUNK).alias(OF), CARRIED)


def _running(kind: T.DataType):
    """Greatest value so far within a run of equal keys of a task's rows, and whether the run is the task's first."""

    result = T.StructType([T.StructField("best", kind), T.StructField("first", T.BooleanType())])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        last, first = None, True
        for values, *keys in batches:
            if not len(values):
                yield pa.StructArray.from_arrays([values, pa.array([], pa.bool_())], ["best", "first"])
                continue
            # The last row of the batch before goes ahead of this one's.
            if last is not None:
                values, *keys = (pa.concat_arrays([end, column]) for end, column in zip(last, (values, *keys)))
            opens = np.zeros(len(values), bool)
            for column in keys:
                opens[1:] |= ~np.asarray(pc.fill_null(pc.equal(column[1:], column[:-1]), False), dtype=bool)
            run_of = np.cumsum(opens)
            best = _running_max(values, run_of)
            firsts = (run_of == 0) & first
            first = bool(firsts[-1])
            ahead = int(last is not None)
            last = tuple(column[-1:] for column in (best, *keys))
            yield pa.StructArray.from_arrays([best[ahead:], pa.array(firsts[ahead:])], ["best", "first"])

    return F.arrow_udf(run, result)


def _running_max(values: pa.Array, run_of: np.ndarray) -> pa.Array:
    """Greatest value so far in each run, by the ranks of the values; null before the first one."""

    # Nulls first, then by the value, or by the fields of a struct one after the other.
    columns = [values.is_valid(), *_leaves(values)]
    keys = [(f"c{i}", "ascending") for i in range(len(columns))]
    order = pc.sort_indices(pa.table(columns, [name for name, _ in keys]), keys, null_placement="at_start").to_numpy()
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    nulls = values.null_count
    ranks = np.where(ranks < nulls, -1, ranks)
    step = len(values) + 1
    best = np.maximum.accumulate(run_of * step + ranks) - run_of * step
    at = pa.array(np.where(best < 0, 0, order[np.maximum(best, 0)]), mask=best < 0)
    return values.take(at)


def _leaves(values: pa.Array) -> list[pa.Array]:
    if not pa.types.is_struct(values.type):
        return [values]
    return [leaf for field in values.flatten() for leaf in _leaves(field)]


def latest_run_as_of(
    requests: DataFrame,
    runs: DataFrame,
    *,
    by: str = "dag_id",
    request_end: str = "data_interval_end",
    run_end: str = "data_interval_end",
    logical_date: str = "logical_date",
) -> DataFrame:
    """Newest logical date among another pipeline's runs that ended no later than each request; null when none."""

    return asof_join(
        requests, runs, by=by, left_time=request_end, right_time=run_end, value=col(logical_date), name="latest_run"
    )
