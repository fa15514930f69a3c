"""Run a function over the documents of each Arrow batch, inside the tasks of Spark."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Row function: the values of the input columns of a batch, as lists, to lists of output values.
BatchFunction = Callable[..., dict[str, list]]

# The conversion to an Arrow schema reports nothing that matters here.
logging.getLogger("py4j").setLevel(logging.ERROR)


def map_columns(
    docs: DataFrame,
    columns: list[Column],
    make: Callable[[], BatchFunction],
    schema: str,
    rows: int = 2000,
) -> DataFrame:
    """Evaluate ``columns`` and map them batch by batch.

    ``make`` runs once in each task and returns the function of a batch, which gets
    one list for each column and returns one list for each output column. ``rows``
    bounds what the function holds at once.
    """
    fields: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = function(*(column.to_pylist() for column in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    named = [column.alias(f"c{i}") for i, column in enumerate(columns)]
    return docs.select(*named).mapInArrow(task, fields)


def whole_text(text: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
