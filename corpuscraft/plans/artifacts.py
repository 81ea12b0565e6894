"""Round trips through sources and sinks: what a query derives from a table is written in one of the library's formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import generate
from ..operators.shared import Scratch
from ..sources import archives
from ..sources import documents as sources
from ._registry import query

#: Ids of a file.
FILE = 64


def scratch_of(df: DataFrame) -> Scratch:
    return Scratch(df.sparkSession, "artifacts")


def file_of(column: str):
    return F.floor(F.col(column) / FILE).alias("file")


def small_files(df: DataFrame, path: str) -> None:
    """A file for each row (file, value), in a folder of the file's number."""
    df.select("file", "value").repartition("file").write.partitionBy("file").text(path)


def number_in(path) -> F.Column:
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("long")


ROWS = "SELECT doc_id, lang, n_chars FROM documents"


@query(ROWS)
def appended_lines(t):
    """JSON lines appended in two runs and read with a schema; a line file that is not there yet is an empty table."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    path, schema = scratch_of(d).path("lines"), "doc_id bigint, lang string, n_chars bigint"
    none = sources.read_lines(d.sparkSession, path, schema, missing_ok=True)
    for k in (0, 1):
        sources.append_lines(d.filter(F.col("doc_id") % 2 == k), path)
    return sources.read_lines(d.sparkSession, path, schema).unionByName(none)


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")
def json_documents(t):
    """Conversations as arrays in JSON documents of 64, read by a schema beside a document that is not there."""
    convs = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("turns"))
    files = convs.groupBy(file_of("conv_id")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turns"))).alias("value"))
    path, schema = scratch_of(convs).path("documents"), "conv_id bigint, turns array<struct<role:string>>"
    small_files(files, path)
    spark = convs.sparkSession
    both = sources.read_document(spark, path, schema).select("conv_id", "turns").unionByName(sources.read_document(spark, path + "-none", schema, missing_ok=True))
    return both.select("conv_id", F.size("turns").cast("long").alias("turns"))


@query(ROWS)
def packed_documents(t):
    """Rows exported as base64 of gzip of JSON and read back, every file decoded and without an error."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    path = scratch_of(d).path("packed")
    sources.export_packed(d, path)
    read = sources.read_packed(d.sparkSession, f"{path}/part-*").filter("error is null and sha256 is not null")
    return read.select(F.explode(F.from_json("document", "array<struct<doc_id:bigint,lang:string,n_chars:bigint>>")).alias("x")).select("x.*")


@query("SELECT conv_id, count(*) + 1 AS objects, count(*) AS candidates, count_if(role = 'user') AS accepted, count_if(role <> 'user') AS rejected FROM conversations GROUP BY conv_id")
def nested_registry(t):
    """The objects in each conversation's JSON that have a role and a text: candidates; those of users are accepted."""
    docs = t("conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.to_json(F.struct(F.collect_list(F.struct("role", "text")).alias("turns"))).alias("document"))
    _, counts = sources.registry_of(sources.nested_objects(docs), ["role", "text"], F.get_json_object("object", "$.role") == "user")
    return counts.select(F.col("path").cast("long").alias("conv_id"), "objects", "candidates", "accepted", "rejected")


PAGES = f"SELECT doc_id // {FILE} AS file, string_agg(sha256(text), ',' ORDER BY doc_id) AS v FROM documents GROUP BY 1"


def pages(t) -> DataFrame:
    """file, value: the digests of 64 documents each."""
    d = t("documents").groupBy(file_of("doc_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("h")))).alias("x"))
    return d.select("file", F.array_join(F.transform("x", lambda e: e["h"]), ",").alias("value"))


@query(f"SELECT file, length(v) + 1 AS bytes, sha256(concat(v, chr(10))) AS sha256 FROM ({PAGES})")
def packaged_tree(t):
    """A tree of files packed into archives with their manifests, every member read back by its checksum."""
    p = pages(t)
    scratch = scratch_of(p)
    small_files(p, scratch.path("tree"))
    packed = archives.package(p.sparkSession, scratch.path("tree"), scratch.path("archives"))
    return packed.filter("path like 'file=%'").select(number_in(F.col("path")).alias("file"), "bytes", "sha256")


@query(f"SELECT file, CASE file % 5 WHEN 1 THEN 'drifted' WHEN 2 THEN 'missing' ELSE 'valid' END AS state FROM ({PAGES})")
def record_files(t):
    """A folder of one record a file, each checked against the digest it carries; some have changed since, some have lost it."""
    d = pages(t).select("file", F.col("value").alias("digests"))
    body = canonical.record("digests", "file")
    sha, k = F.sha2(body, 256), F.col("file") % 5
    stamped = F.when(k == 2, body).otherwise(F.regexp_replace(body, r"\}$", F.concat(F.lit(',"sha":"'), sha, F.lit('"}'))))
    stamped = F.when(k == 1, F.concat(F.lit('{"added":1,'), F.substring(stamped, F.lit(2), F.length(stamped)))).otherwise(stamped)
    path = scratch_of(d).path("records")
    small_files(d.select("file", stamped.alias("value")), path)
    return sources.read_records(d.sparkSession, f"{path}/file=*", "sha").select(number_in(F.col("path")).alias("file"), "state")


@query(f"SELECT min(file) AS file, count(*) AS files FROM ({PAGES})")
def located_file(t):
    """The one file of a tree whose content has a digest, found by the manifest; how many files the tree has."""
    p = pages(t)
    path = scratch_of(p).path("tree")
    small_files(p, path)
    n = F.count(F.lit(1)).alias("files")
    want = p.agg(F.min_by(F.sha2(F.concat("value", F.lit("\n")), 256), "file").alias("sha"), n).first()  # one row
    found = sources.locate(p.sparkSession, path, want["sha"])
    return p.agg(n).select(number_in(F.lit(found)).alias("file"), "files")


@query("SELECT user_id // 64 AS file, count(*)::DOUBLE / 4 AS train_runtime, (sum(event_id) % 97)::DOUBLE / 8 AS train_loss FROM events GROUP BY 1")
def training_logs(t):
    """Logs whose first printed dictionary tells run time and loss."""
    logs = t("events").groupBy(file_of("user_id")).agg((F.count(F.lit(1)) / 4).alias("time"), (F.sum("event_id") % 97 / 8).alias("loss"))
    line = F.concat(F.lit("start\nloss 3\n{'train_runtime': "), F.col("time").cast("string"), F.lit(", 'train_loss': "), F.col("loss").cast("string"), F.lit("}\n{'train_runtime': 0.5, 'train_loss': 9.0}\nend"))
    path = scratch_of(logs).path("logs")
    small_files(logs.select("file", line.alias("value")), path)
    return sources.scrape_log(logs.sparkSession, f"{path}/file=*", "{'train_runtime'", "train_runtime double, train_loss double").select(number_in(F.col("path")).alias("file"), "x.*")


@query("SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 3 <> 0")
def replaced_table(t):
    """A table that takes another's place as a whole."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    path = scratch_of(d).path("table")
    sources.replace_table(d.select("doc_id", "lang"), path)
    sources.replace_table(d.filter("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") % 2 == 0, "new").otherwise(F.col("lang")).alias("lang")), path)
    return d.sparkSession.read.schema("doc_id bigint, lang string").parquet(path)


@query("SELECT TRUE AS written, FALSE AS again, TRUE AS refused, count(*) AS n FROM documents")
def written_once(t):
    """A table is written once: the same rows are passed over, others are refused and change nothing."""
    d = t("documents").select("doc_id", "lang")
    path = scratch_of(d).path("once")
    written, again = sources.write_once(d, path), sources.write_once(d.repartition(3), path)
    try:
        refused = sources.write_once(d.filter("doc_id <> 0"), path) is None
    except ValueError:
        refused = True
    kept = d.sparkSession.read.schema(d.schema).parquet(path)
    return kept.agg(F.lit(written).alias("written"), F.lit(again).alias("again"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN concat(lang, '2') ELSE lang END AS lang, 'regenerated' AS side FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 UNION ALL SELECT doc_id, lang, 'stored' FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0")
def checked_table(t):
    """Regenerated rows against the stored ones: what changed, on both sides, and what the stored table lacks."""
    d = t("documents").select("doc_id", "lang")
    path = scratch_of(d).path("stored")
    d.filter("doc_id % 11 <> 0").write.parquet(path)
    return sources.check_table(d.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.concat("lang", F.lit("2"))).otherwise(F.col("lang"))), path)


SPLITS = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'blind' END"


@query(f"SELECT {SPLITS} AS split, count(*) AS n, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY 1")
def split_artifacts(t):
    """Public splits and the hidden one in folders of their own, read separately."""
    d = t("documents").select("doc_id", "n_chars", F.expr(SPLITS).alias("split"))
    path, spark = scratch_of(d).path("splits"), d.sparkSession
    sources.write_splits(d, path)
    both = spark.read.schema(d.schema).parquet(f"{path}/public").unionByName(spark.read.schema(d.schema).parquet(f"{path}/blind"))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("characters"))


@query("SELECT concat('## languages', chr(10), chr(10), '| lang | n |', chr(10), '|-|-|', chr(10), string_agg(concat('| ', lang, ' | ', n, ' |'), chr(10) ORDER BY lang), chr(10)) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def markdown_report(t):
    """A report's few groups as Markdown."""
    g = t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")
    text = sources.report(g, "languages")
    return g.agg(F.lit(text).alias("report"))


@query("SELECT item_id AS id, text AS question, 'item_id,split,text' AS withheld FROM (SELECT *, 'blind' AS split FROM benchmark)")
def sanitized_requests(t):
    """What a request may hold, and the columns that it must not."""
    rows = t("benchmark").select("item_id", "text", F.col("text").alias("question"), F.lit("blind").alias("split"))
    kept = generate.sanitized(rows, "item_id")
    if generate.forbidden_columns(kept):
        raise ValueError("a request holds more than it may")
    return kept.withColumn("withheld", F.lit(",".join(generate.forbidden_columns(rows))))
