"""Python functions over rows, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that leave a task at once.
ROWS = 2000


def flat_map(df: DataFrame, keep: list[str], args: list[str], f: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``keep`` columns with each row that ``f`` gives for the ``args`` columns; rows leave in batches, so no row's list is one value."""
    out = StructType([*df.select(*keep).schema.fields, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)
    names = arrow.names

    def nested(value, kind):
        if pa.types.is_struct(kind) and isinstance(value, (tuple, list)):
            return {kind.field(i).name: nested(v, kind.field(i).type) for i, v in enumerate(value)}
        if pa.types.is_list(kind) and value is not None:
            return [nested(v, kind.value_type) for v in value]
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([nested(v, t.type) for v in c], t.type) for c, t in zip(columns, arrow, strict=True)], names=names)

        for batch in batches:
            kept, given = ([batch.column(c).to_pylist() for c in part] for part in (keep, args))
            for i in range(batch.num_rows):
                head = tuple(c[i] for c in kept)
                for row in f(*(c[i] for c in given)):
                    rows.append((*head, *row))
                    if len(rows) >= ROWS:
                        yield batch_of()
                        rows = []
        if rows:
            yield batch_of()

    return df.select(*dict.fromkeys([*keep, *args])).mapInArrow(run, out)
