"""Generators called from SQL as table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ._registry import query


@query("SELECT item_id, shift, concat('ABCD'[(item_id % 4 - shift + 8) % 4 + 1]) AS letter, array_to_string(list_concat(c[shift + 1 :], c[1 : shift]), '|') AS choices FROM (SELECT item_id, [concat('w', item_id), concat('x', item_id), concat('y', item_id), concat('z', item_id)] AS c FROM benchmark), (SELECT unnest([0, 1, 2, 3]) AS shift)")
def rotations_function(t):
    """Each question's choices in all rotations, by a SQL table function joined laterally."""
    b = t("benchmark")
    tables.register(b.sparkSession)
    return b.sparkSession.sql("SELECT item_id, shift, letter, array_join(rotated, '|') AS choices FROM (SELECT item_id, transform(array('w', 'x', 'y', 'z'), x -> concat(x, item_id)) AS c FROM {b}), LATERAL rotations(c, cast(item_id % 4 AS INT))", b=b)


@query("SELECT conv_id, '$' AS json_path, count(*) AS fields FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, concat('$.turns[', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, ']'), 2 FROM conversations")
def json_objects_function(t):
    """Every object within a conversation's JSON, by a Python table function joined laterally: the number of turns or of fields."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    docs = t("conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("document"))
    tables.register(docs.sparkSession)
    x = docs.sparkSession.sql("SELECT conv_id, json_path, object FROM {d}, LATERAL json_objects(document)", d=docs)
    return x.select("conv_id", "json_path", F.when(F.col("json_path") == "$", F.json_array_length(F.get_json_object("object", "$.turns"))).otherwise(F.size(F.json_object_keys("object"))).cast("long").alias("fields"))


@query("SELECT p_partkey, unnest([1, 2, 3]) AS depth, p_size * unnest([1, 10, 100]) AS value FROM part")
def depth_ladder_function(t):
    """Parameters grown to three depths, by an Arrow table function over the whole table."""
    p = t("part")
    tables.register(p.sparkSession)
    return p.sparkSession.sql("SELECT id AS p_partkey, depth, value FROM depth_ladder(TABLE(SELECT p_partkey, p_size FROM {p}))", p=p)
