"""Failures as data: what a kernel raises for one image becomes a value of that image's row.

Kernels raise ValueError("stage: code"), stage being lexing, parsing, decoding, encoding or the name of
a container. FAILFAST lets it end the job; PERMISSIVE gives the row with nulls and error (stage, code, details).
"""

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FAILFAST, PERMISSIVE = "FAILFAST", "PERMISSIVE"
ERROR = "error struct<stage: string, code: string, details: string>"


def fault(error: Exception) -> dict:
    """stage, code and details of a failure; what no kernel foresaw is unexpected, with its text."""
    stage, found, code = str(error).partition(": ")
    if isinstance(error, ValueError) and found and stage.isidentifier() and code.split(" ")[0].isidentifier():
        return {"stage": stage, "code": code.split(" ")[0], "details": code.partition(" ")[2] or None}
    return {"stage": "decoding", "code": "unexpected", "details": f"{type(error).__name__}: {error}"}


def rendered(stage: str, code: str, details: str | None) -> str:
    return f"{stage}: {code}" + (f" ({details})" if details else "")


def per_row(rows: DataFrame, columns: list[str], schema: str, make, mode: str = FAILFAST) -> DataFrame:
    """For every row of rows make(*columns) gives the other columns of schema, behind image_id: one row, or a list of them as arrays.

    make returns a tuple with one value per column, or a list of tuples. In PERMISSIVE mode schema gets the
    error column, and a row that fails has nulls in the others.
    """
    if mode not in (FAILFAST, PERMISSIVE):
        raise ValueError("options: invalidMode")
    permissive = mode == PERMISSIVE
    full = StructType.fromDDL(f"image_id long, {schema}" + (f", {ERROR}" if permissive else ""))
    arrow = to_arrow_schema(full)
    width = len(full) - 1 - permissive

    def batches(it):
        for batch in it:
            ids = batch.column("image_id").to_pylist()
            for k in range(batch.num_rows):
                try:
                    made = make(*(batch.column(c)[k].as_py() for c in columns))
                    found = made if isinstance(made, list) else [made]
                    out = [(ids[k], *r) + ((None,) if permissive else ()) for r in found]
                except (ValueError, IndexError, KeyError, OverflowError, TypeError, struct.error) as error:
                    if not permissive:
                        raise
                    out = [(ids[k], *[None] * width, fault(error))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.select("image_id", *columns).mapInArrow(batches, full)
