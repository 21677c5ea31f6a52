"""Order-dependent folds over many groups.

Groups are co-located by a shuffle, sorted inside their partition, and streamed
through one fold object per group. A task never holds a group: it holds the
state of the fold and one Arrow batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Fold:
    """One group's state. ``push`` sees rows in order; both may emit rows (dicts)."""

    def push(self, row: dict) -> Iterable[dict]:
        return ()

    def finish(self) -> Iterable[dict]:
        return ()


def fold_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    factory: Callable[[], Fold], schema: T.StructType,
) -> DataFrame:
    arrow_schema = to_arrow_schema(schema)
    keys = list(keys)
    placed = spread(df, *keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        current, fold, out = None, None, []
        for batch in batches:
            columns = [plain(c) for c in batch.columns]
            owners = zip(*[columns[batch.schema.get_field_index(k)] for k in keys], strict=True)
            names = batch.schema.names
            for key, values in zip(owners, zip(*columns, strict=True), strict=True):
                row = dict(zip(names, values, strict=True))
                if key != current:
                    if fold is not None:
                        out.extend(fold.finish())
                    current, fold = key, factory()
                out.extend(fold.push(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)
                out = []
        if fold is not None:
            out.extend(fold.finish())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema)

    return placed.mapInArrow(run, schema)


def plain(column: pa.Array) -> list:
    """The values as Python objects; numbers without nulls and strings without a scalar for each, structs and lists by their parts."""
    kind = column.type
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        rows = [dict(zip(names, v, strict=True)) for v in zip(*map(plain, column.flatten()), strict=True)]
    elif pa.types.is_list(kind) and len(column):
        ends = column.offsets.to_numpy().tolist()
        values = plain(column.values.slice(ends[0], ends[-1] - ends[0]))
        rows = [values[a - ends[0]: b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    else:
        return _flat(column)
    if column.null_count:
        rows = [row if known else None for row, known in zip(rows, column.is_valid().to_numpy(zero_copy_only=False), strict=True)]
    return rows


def _flat(column: pa.Array) -> list:
    kind = column.type
    number = (pa.types.is_integer(kind) or pa.types.is_floating(kind)) and not column.null_count
    if number or pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by ``keys`` into the configured number of partitions, kept as they are.

    For small inputs of CPU-bound stages, which Spark would merge into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; made up only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="captrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write a result that several branches read as Parquet to the shared folder, and read it back.

    Lineage ends here, and each branch reads only the columns it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
