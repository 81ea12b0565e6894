"""Reading and writing curation artifacts with explicit schemas."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts, core
from ..operators.shared import Scratch


def read_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line is an error. A missing path gives an empty table if allowed."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """One JSON array or object for each file."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_packed(spark: SparkSession, path: str, pinned: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """path, document, sha256 (of the decoded bytes), file_sha256, gzip_sha256, error: files of plain JSON, or of base64 of gzip of
    JSON (white space in the base64 is allowed, any other stray character is an error).

    ``pinned`` maps a file's name to the digests it must have (any of file_sha256, gzip_sha256, sha256); a file that has another,
    or that cannot be decoded to JSON, has no document and says why.
    """
    pins = dict(pinned or {})

    @F.pandas_udf("document string, sha256 string, file_sha256 string, gzip_sha256 string, error string")
    def decode(path, content):
        import base64
        import gzip
        import hashlib
        import json
        import zlib

        import pandas as pd

        sha, out = lambda raw: hashlib.sha256(raw).hexdigest(), []
        for name, raw in zip(path, content, strict=True):
            row = {"document": None, "sha256": None, "file_sha256": sha(raw), "gzip_sha256": None, "error": None}
            try:
                if raw.lstrip()[:1] not in (b"{", b"["):
                    packed = base64.b64decode(b"".join(raw.split()), validate=True)
                    row["gzip_sha256"] = sha(packed)
                    raw = gzip.decompress(packed)
                row["sha256"] = sha(raw)
                text = raw.decode()
                json.loads(text)
                drift = next((k for k, v in pins.get(name.rsplit("/", 1)[-1], {}).items() if row[k] != v), None)
                if drift:
                    raise ValueError(f"{drift} drift")
                row["document"] = text
            except (ValueError, OSError, EOFError, zlib.error) as e:
                row["error"] = str(e)
            out.append(row)
        return pd.DataFrame(out, columns=["document", "sha256", "file_sha256", "gzip_sha256", "error"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode("path", "content").alias("x")).select("path", "x.*")


def registry_of(objects: DataFrame, required: list[str], accepted) -> tuple[DataFrame, DataFrame]:
    """Of nested objects, those that hold all required keys are candidates; ``accepted`` (a condition on column ``object``) keeps
    some. Returns the accepted ones and path, objects, candidates, accepted, rejected by file."""
    candidate = F.size(F.array_except(F.array(*map(F.lit, required)), F.json_object_keys("object"))) == 0
    marked = objects.withColumn("__candidate", F.coalesce(candidate, F.lit(False))).withColumn("__ok", F.col("__candidate") & F.coalesce(accepted, F.lit(False)))
    counts = marked.groupBy("path").agg(F.count(F.lit(1)).alias("objects"), F.count_if("__candidate").alias("candidates"), F.count_if("__ok").alias("accepted"), F.count_if(F.col("__candidate") & ~F.col("__ok")).alias("rejected"))
    return marked.filter("__ok").drop("__candidate", "__ok"), counts


def nested_objects(df: DataFrame, column: str = "document") -> DataFrame:
    """path, json_path, object (compact JSON text, keys in order): every object at any depth of a JSON column.

    Documents are variants, opened level by level: objects and arrays of one depth give those of the next, until none is left.
    Levels are written to the shared folder, so a document of any depth is walked without a growing plan. Null documents hold no
    object; text that is no JSON, or repeats a key within an object, is an error.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "nested")
    level, found, depth = df.select("path", F.lit("$").alias("json_path"), F.parse_json(column).alias("v")).filter("v is not null"), None, 0
    while True:
        kind = F.schema_of_variant("v")
        level = scratch.put(level.withColumn("is_object", kind.startswith("OBJECT")).filter(F.col("is_object") | kind.startswith("ARRAY")), f"level-{depth}")
        if found is not None and level.isEmpty():
            return found
        here = level.filter("is_object").select("path", "json_path", F.to_json("v").alias("object"))
        found, depth = here if found is None else found.unionByName(here), depth + 1
        step = F.when(F.col("is_object"), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("path", F.concat("json_path", step).alias("json_path"), F.col("value").alias("v"))


def read_records(spark: SparkSession, path: str, field: str) -> DataFrame:
    """path, record, state: a folder of one JSON record a file, each checked against the digest it carries in ``field``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("record"))
    return contracts.self_hashes(files, "record", field)


def locate(spark: SparkSession, path: str, sha256: str, first: list[str] | None = None) -> str:
    """The path of the one file under a tree whose content has the digest; none or several are an error. The folders in ``first``
    are tried before the tree."""
    for folder in [*(first or []), path]:
        if folder != path and not exists(spark, folder):
            continue
        found = [r["path"] for r in manifest(spark, folder).filter(F.col("sha256") == sha256).select("path").limit(2).collect()]
        if len(found) == 1:
            return found[0]
        if len(found) > 1 or folder == path:
            raise ValueError(f"{'several' if found else 'no'} files of digest {sha256} under {folder}")
    raise ValueError("nowhere to look")


def scrape_log(spark: SparkSession, path: str, start: str, schema: str) -> DataFrame:
    """path, x: of each log, the first line that begins with ``start``, a printed dictionary, read with a schema."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    line = F.get(F.filter("lines", lambda x: F.startswith(x, F.lit(start))), F.lit(0))
    return lines.select("path", F.from_json(line, schema, {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"}).alias("x")).filter("x is not null")


def tree_digest(spark: SparkSession, path: str) -> str:
    """One digest of a tree: of the lines "path below the tree:sha256", in the order of paths."""
    files = manifest(spark, path)
    root = files.agg(F.min("path")).first()[0]
    if root is None:
        return hashlib.sha256(b"").hexdigest()
    base = path.rstrip("/").rsplit("/", 1)[-1]
    below = files.withColumn("path", F.substring_index("path", f"/{base}/", -1))
    return contracts.tree_digest(below, []).first()["tree"]


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a table through a folder of its own beside it, which takes the place of the old one when it is complete: a reader
    sees the old rows or the new ones."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    fs, new, old, here = _paths(spark, fresh, f"{fresh}.old", path)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(new, here):
        raise OSError(f"{fresh} cannot be moved")
    fs.delete(old, True)


def _paths(spark: SparkSession, *paths: str) -> tuple:
    made = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return (made[0].getFileSystem(spark._jsc.hadoopConfiguration()), *made)


def append_lines(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; a failed append leaves no line behind."""
    df.write.mode("append").json(path)


def check_table(df: DataFrame, path: str) -> DataFrame:
    """Regenerated rows against the stored table: side, and the rows only that side has (as often). Empty if they are the same."""
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    return df.exceptAll(stored).withColumn("side", F.lit("regenerated")).unionByName(stored.exceptAll(df).withColumn("side", F.lit("stored")))


def export_packed(df: DataFrame, path: str) -> None:
    """Rows as JSON objects in an array, gzipped and in base64, one line a partition: what ``read_packed`` reads."""

    def packed(batches):
        import base64
        import gzip

        import pandas as pd

        rows = [x for pdf in batches for x in pdf["row"]]
        if rows:
            raw = ("[" + ",".join(rows) + "]").encode()
            yield pd.DataFrame({"value": [base64.b64encode(gzip.compress(raw, mtime=0)).decode()]})

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")).mapInPandas(packed, "value string").write.text(path)


def report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown; an error if it has more than ``most`` rows, for a report is read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str) -> bool:
    """Writes a table that must not change: True if written, False if an equal one is there; another one is an error."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.mode("errorifexists").parquet(path)
        return True
    if not same_rows(df, spark.read.schema(df.schema).parquet(path)):
        raise ValueError(f"{path} holds other rows")
    return False


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_splits(df: DataFrame, path: str, hidden: str = "blind") -> None:
    """Public and hidden rows in separate folders; the public reader has no path to the hidden ones."""
    df.filter(F.col("split") != hidden).write.mode("errorifexists").partitionBy("split").parquet(f"{path}/public")
    df.filter(F.col("split") == hidden).write.mode("errorifexists").parquet(f"{path}/{hidden}")


def contract(df: DataFrame, required: list[str], unique: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """Violations of a table's contract: null or blank required fields, repeated keys, splits of another size."""
    spark = df.sparkSession
    out = core.key_violations(df, *unique)
    for c in required:
        blank = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        out = out.unionByName(df.filter(blank).select(F.lit("required").alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in unique]).alias("key"), F.lit(c).alias("detail")))
    if counts:
        want = spark.createDataFrame(list(counts.items()), T.StructType([T.StructField("split", T.StringType()), T.StructField("want", T.LongType())]))
        got = want.join(df.groupBy("split").agg(F.count(F.lit(1)).alias("got")), "split", "full")
        out = out.unionByName(got.filter("want is distinct from got").select(F.lit("count").alias("check"), F.col("split").alias("key"), F.concat_ws(" is not ", F.coalesce(F.col("got"), F.lit(0)).cast("string"), F.col("want").cast("string")).alias("detail")))
    return out
