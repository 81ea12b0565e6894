"""Table functions for SQL: rows made from values (LATERAL) or from a whole table (TABLE).

``register`` makes them known to a session: ``rotations`` is a SQL function, which Spark inlines; ``json_objects`` walks values of any
depth in Python, with Arrow between; ``depth_ladder`` turns whole batches of a table into batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: The letters of choices, and the depths of a ladder with their factors.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LADDER = ((1, 1), (2, 10), (3, 100))

ROTATIONS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION rotations(choices ARRAY<STRING>, gold INT)
RETURNS TABLE (shift INT, letter STRING, rotated ARRAY<STRING>)
RETURN SELECT s, substring('{LETTERS}', pmod(rotations.gold - s, size(rotations.choices)) + 1, 1), concat(slice(rotations.choices, s + 1, size(rotations.choices)), slice(rotations.choices, 1, s))
FROM explode(sequence(0, size(rotations.choices) - 1)) AS t(s)
"""


@F.udtf(returnType="json_path string, object string", useArrow=True)
class JsonObjects:
    """Every object of a JSON text, at any depth, outer ones first; of null or of what is no JSON, none."""

    def eval(self, document: str) -> Iterator[tuple[str, str]]:
        try:
            todo = [("$", json.loads(document))] if document is not None else []
        except ValueError:
            todo = []
        while todo:
            at, x = todo.pop()
            if isinstance(x, dict):
                yield at, json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
            todo += [(f"{at}.{k}" if isinstance(x, dict) else f"{at}[{k}]", v) for k, v in inner]


@F.arrow_udtf(returnType="id long, depth int, value long")
class DepthLadder:
    """(id, value) of each row at every depth, the value grown by the depth's factor. Takes a table of two columns: id and value."""

    def eval(self, table) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for depth, factor in LADDER:
            yield pa.table({"id": pc.cast(table.column(0), pa.int64()), "depth": pa.array([depth] * table.num_rows, pa.int32()), "value": pc.multiply(pc.cast(table.column(1), pa.int64()), factor)})


def register(spark: SparkSession) -> None:
    spark.sql(ROTATIONS)
    spark.udtf.register("json_objects", JsonObjects)
    spark.udtf.register("depth_ladder", DepthLadder)
