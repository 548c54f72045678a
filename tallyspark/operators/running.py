"""Running totals over a whole ordered result without putting it into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import durable

_PART = "_slice"


def running_totals(df: DataFrame, order_by: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add one running sum per entry of ``sums`` in the order ``order_by``, which must be total.

    The global sort range-partitions the rows, so slice *i* holds only rows before slice *i+1*. The totals of
    the slices, one row per slice, give where each begins; then every slice adds up its own rows where they
    lie, batch by batch. That is one shuffle. The sorted rows are checkpointed first: both passes must see the very
    same slices, also after an executor is lost.
    """
    inputs = {f"_in_{name}": value for name, value in sums.items()}
    ordered = durable(df.withColumns(inputs).orderBy(*order_by))
    slices = ordered.groupBy(F.spark_partition_id().alias(_PART)).agg(*[F.sum(i).alias(i) for i in inputs])
    kinds = {name: slices.schema[f"_in_{name}"].dataType for name in sums}
    begins: dict[int, list] = {}
    so_far: list = [None] * len(sums)
    # At most spark.sql.shuffle.partitions rows, whatever the data size.
    for row in slices.orderBy(_PART).collect():
        begins[row[0]] = so_far
        so_far = [old if x is None else x if old is None else old + x for old, x in zip(so_far, row[1:], strict=True)]
    fields = [*ordered.schema.fields[: len(df.columns)], *[T.StructField(n, k) for n, k in kinds.items()]]
    add = _adder(len(df.columns), begins, {n: to_arrow_type(k) for n, k in kinds.items()})
    return ordered.mapInArrow(add, T.StructType(fields))


def _adder(width: int, begins: dict[int, list], kinds: dict):
    """The batch function; it needs pyarrow on the executors, not this package.

    A batch's sums are one cumulative kernel for each column, which starts at the total so far. A row without a value keeps the total before
    it, and rows before the first value have none.
    """

    def run(batches):
        from itertools import accumulate

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        totals = list(begins.get(TaskContext.get().partitionId(), [None] * len(kinds)))
        for batch in batches:
            columns, names = batch.columns[:width], batch.schema.names[:width]
            for k, (name, kind) in enumerate(kinds.items()):
                values = batch.column(width + k).cast(kind)
                zero = pa.scalar(0, pa.int64()).cast(kind)
                start = zero if totals[k] is None else pa.scalar(totals[k], kind)
                filled = pc.fill_null(values, zero)
                if pa.types.is_decimal(kind):  # for which Arrow has no kernel
                    sums = pa.array(list(accumulate(filled.to_pylist(), initial=start.as_py()))[1:], kind)
                else:
                    sums = pc.cumulative_sum_checked(filled, start=start)
                if totals[k] is None:
                    there = pc.index(pc.is_valid(values), True).as_py()
                    none = len(values) if there < 0 else there
                    sums = pa.concat_arrays([pa.nulls(none, kind), sums.slice(none)])
                if len(sums):
                    totals[k] = sums[-1].as_py()
                columns.append(sums)
                names.append(name)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
