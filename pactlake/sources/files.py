"""Sources, sinks and data quality."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# --- fixed values -------------------------------------------------------------------------------
MAX_BYTES = 10 * 1024 * 1024
ZIP, OLE, PDF = "504B0304", "D0CF11E0A1B11AE1", "255044462D"
CHARS_PER_PAGE = 200
LOG_FIELDS = ("report_id", "document_type", "findings", "grounded", "score", "inconsistencies", "duration_ms", "cached")
REPORT_ID = r"^[0-9]{1,19}$"
_SLOTS = 1 << 27


def scan_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with text, and the rejected with their reason."""
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    return docs.where(~blank), docs.where(blank).select("doc_id", F.lit("empty").alias("reason"))


def triage_files(files: DataFrame) -> DataFrame:
    """``path, length, content`` by size first, then by first bytes, then against the name."""
    content = F.col("content")
    starts = lambda magic: F.startswith(F.hex(F.substring(content, 1, len(magic) // 2)), F.lit(magic))
    holds = lambda data, word: F.contains(data, F.lit(word).cast("binary"))
    encrypted = F.conv(F.hex(F.substring(content, 7, 1)), 16, 10).cast("int").bitwiseAND(1) == 1
    sniffed = (
        F.when(starts(ZIP), "zip").when(starts(OLE), "ole").when(holds(F.substring(content, 1, 1024), "%PDF-"), "pdf").otherwise("unknown")
    )
    name = F.lower("path")
    return files.select("path", "length", sniffed.alias("sniffed"), encrypted.alias("encrypted"), holds(content, "word/document.xml").alias("word"), F.contains(content, F.unhex(F.lit("00"))).alias("nul"), F.is_valid_utf8(content.cast("string")).alias("utf8"), name.alias("name")).select(
        "path",
        F.when(F.col("length") > MAX_BYTES, "rejected:too_large").when(F.col("length") == 0, "rejected:empty")
        .when(F.col("sniffed") == "pdf", F.when(F.endswith("name", F.lit(".pdf")), "pdf").otherwise("rejected:not_a_document"))
        .when((F.col("sniffed") == "zip") & F.col("encrypted"), "rejected:encrypted")
        .when(F.col("sniffed") == "zip", F.when(F.col("word") & F.endswith("name", F.lit(".docx")), "docx").otherwise("rejected:not_a_document"))
        .when(F.col("sniffed") == "ole", "rejected:encrypted_or_legacy")
        .when(F.endswith("name", F.lit(".txt")), F.when(F.col("utf8") & ~F.col("nul"), "text").otherwise("rejected:encoding"))
        .otherwise("rejected:not_a_document").alias("outcome"),
    )


def read_files(spark: SparkSession, path: str, inventory: DataFrame | None = None) -> DataFrame:
    """Binary files of a lake; content above the limit is never read: those files' rows come from a scan without the content.

    Spark's reader passes over files of zero bytes. Where they are to be
    reported, an ``inventory`` (``path, length``) of the lake names them.
    """
    files = spark.read.format("binaryFile").load(path)
    none = F.lit(None).cast("binary").alias("content")
    files = files.where(F.col("length") <= MAX_BYTES).select("path", "length", "content").unionAll(files.where(F.col("length") > MAX_BYTES).select("path", "length", none))
    if inventory is None:
        return files
    return files.unionByName(inventory.where("length = 0").select("path", F.col("length").cast("long"), none))


def check_text_encoding(files: DataFrame) -> DataFrame:
    """S3: strict UTF-8 without NUL."""
    fine = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains("content", F.unhex(F.lit("00")))
    return files.select("path", fine.alias("accepted"))


def scan_quality(pages: DataFrame) -> DataFrame:
    """``doc_id, page, text``: documents with little text per page are probably scans."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    per = pages.groupBy("doc_id").agg(joined.alias("text"), F.count(F.lit(1)).alias("pages"))
    scanned = (F.trim(F.regexp_replace("text", r"\s+", " ")) == "") | (F.length("text") / F.col("pages") < CHARS_PER_PAGE)
    return per.select("doc_id", "pages", F.length("text").alias("chars"), scanned.alias("likely_scanned"), (~scanned).alias("offsets_reliable"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule files, one folder a tier; fields that a rule leaves out are left out."""
    rules.write.mode("overwrite").partitionBy("tier").json(path, ignoreNullFields=True)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules as their files have them; the tier is the folder's, fields left out have their defaults."""
    kind = "rule_id string, severity string, weight int, applies_to array<string>, evidence_from string, benchmark string, title string, inputs array<string>, text_en string, text_hi string, tier string"
    return spark.read.schema(kind).json(path).withColumn("applies_to", F.coalesce("applies_to", F.array().cast("array<string>")))


def write_reports(reports: DataFrame, path: str, run: str) -> None:
    """Reports and, when they are all there, the ids of the run, which make them count.

    A run writes its own partition and replaces it if it is run again. Until the
    manifest names a run, readers do not see its reports, so a run that is killed
    leaves no half of itself.
    """
    named = reports.withColumn("run", F.lit(run))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/reports")
    held = reports.sparkSession.read.schema(named.schema).parquet(f"{path}/reports").where(F.col("run") == run)
    held.select("doc_id", "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/manifest")


def finished(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, run`` of the reports that count; none where nothing was written yet."""
    kind = "doc_id long, run string"
    try:
        return spark.read.schema(kind).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def read_reports(spark: SparkSession, path: str, kind: str | StructType) -> DataFrame:
    """Stored reports of all finished runs."""
    rows = spark.read.schema(kind).parquet(f"{path}/reports")
    return rows.join(F.broadcast(finished(spark, path).select("run").distinct()), "run", "left_semi")


def read_report_files(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Reports from files of JSON lines under their schema ``kind``, and the files that are none, with why.

    Files are read line by line, so that a large one is many rows and may be many
    tasks; what is wrong with its lines is put together by its path: ``encoding``
    if one is no UTF-8, ``malformed`` if one does not parse or all are blank,
    ``alien`` if one is no whole report (no proper id, another kind, a report
    without its score or drivers, a refusal without its reason). None of the lines
    of such a file is taken.
    """
    # The reader keeps the bytes of a line as they are.
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), "value")
    lines = lines.withColumn("utf8", F.is_valid_utf8("value")).withColumn("blank", F.trim("value") == "")
    lines = lines.withColumn("r", F.when(F.col("utf8") & ~F.col("blank"), F.from_json("value", kind, {"mode": "PERMISSIVE"})))

    def whole(r: Column) -> Column:
        body = F.when(r["kind"] == "report", r["score"].isNotNull() & r["drivers"].isNotNull()).when(r["kind"] == "not_a_document", r["reason"].isNotNull())
        return F.coalesce(r["doc_id"].cast("string").rlike(REPORT_ID) & body, F.lit(False))

    reasons = ("encoding", "malformed", "alien")
    worst = (
        F.when(~F.col("utf8"), 1).when(F.col("blank"), None).when(F.try_parse_json("value").isNull(), 2)
        .when(~whole(F.col("r")), 3)
    )
    per = lines.select("path", worst.alias("worst"), F.col("blank").cast("int").alias("blank")).groupBy("path").agg(F.min("worst").alias("worst"), F.min("blank").alias("blank"))
    problem = F.try_element_at(F.array(*map(F.lit, reasons)), F.coalesce("worst", F.when(F.col("blank") == 1, 2)))
    bad = stored(per.select("path", problem.alias("problem")).where("problem is not null"), "report-problems")
    good = lines.where(~F.col("blank")).join(bad, "path", "left_anti").select("r.*")
    return good, bad


def leaves(kind: DataType, value: Column, path: Column | None = None) -> Column:
    """``path, value`` of every leaf of a nested value of a type, in order; values as strings."""
    step = lambda name: F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))
    if isinstance(kind, StructType):
        return F.concat(*[leaves(f.dataType, value[f.name], step(f.name)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x, i: leaves(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(each), F.array().cast("array<struct<path:string,value:string>>"))
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is none of ``keys`` (some stay), and without a shuffle.

    Hashes of the keys are bits of ``_SLOTS`` slots, 16 MB in all, which go to every task.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(_SLOTS)) + 1
    bits = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit")).repartition("bucket")
    maps = F.broadcast(bits.groupBy(F.col("bucket").alias("_bucket")).agg(F.bitmap_construct_agg("bit").alias("_bits")))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    return rows.join(maps, F.bitmap_bucket_number(slot) == F.col("_bucket")).where(held).select(rows.columns)


def diff_reports(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, path, old, new`` of every leaf in which two sets of nested rows differ; a missing leaf or row is null.

    Rows are compared whole by digests first: of all rows only keys and digests
    are shuffled. Rows that differ follow as they are, are taken apart beside each
    other, and only leaves that differ are paired by their path.
    """

    def body(rows: DataFrame) -> tuple[StructType, Column]:
        kind = StructType([f for f in rows.schema.fields if f.name != key])
        return kind, F.struct(*[F.col(f.name) for f in kind.fields])

    def digests(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(key, F.unhex(F.sha2(F.to_json(body(rows)[1]), 256)).alias(f"{side}_digest"))

    def taken(rows: DataFrame, side: str) -> DataFrame:
        kind, whole = body(rows)
        own = differing.select(F.col(key).alias("_key"))
        some = among(rows, differing, key).join(own, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        return some.select(key, whole.alias(side))

    unlike = digests(old, "old").join(digests(new, "new"), key, "full_outer").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    differing = stored(unlike.select(key), "differing")
    none = F.array().cast("array<struct<path:string,value:string>>")
    parts = lambda rows, side: F.when(F.col(side).isNotNull(), leaves(body(rows)[0], F.col(side))).otherwise(none).alias(side)
    both = taken(old, "old").join(taken(new, "new"), key, "full_outer").select(key, parts(old, "old"), parts(new, "new"))
    changed = both.select(key, F.array_except("old", "new").alias("old"), F.array_except("new", "old").alias("new"))
    apart = lambda side: changed.select(key, F.explode(side).alias("l")).select(key, "l.path", F.col("l.value").alias(side))
    return apart("old").join(apart("new"), [key, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def log_projection(rows: DataFrame) -> DataFrame:
    """Only the allowed scalars."""
    return rows.select(*[c for c in LOG_FIELDS if c in rows.columns])


def pseudonymise_client(requests: DataFrame, salt: str) -> DataFrame:
    """First forwarded address, else the real one, else unattributed; 32 hex digits of a salted hash."""
    first = F.nullif(F.trim(F.split("forwarded_for", ",")[0]), F.lit(""))
    address = F.coalesce(first, F.nullif(F.trim("real_ip"), F.lit("")), F.lit("unattributed"))
    return requests.withColumn("client", F.substring(F.sha2(F.concat(F.lit(salt), address), 256), 1, 32)).drop("forwarded_for", "real_ip")


def incremental_select(wanted: DataFrame, reports: DataFrame, outputs: DataFrame, only: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Of the wanted ids, or of those listed in ``only``, the ones that have not both a report and model outputs."""
    if only is not None:
        wanted = wanted.join(only.select("doc_id"), "doc_id", "left_semi")
    if force:
        return wanted
    done = reports.select("doc_id").join(outputs.select("doc_id"), "doc_id", "left_semi").distinct()
    return wanted.join(done, "doc_id", "left_anti")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both write: below ``spark.checkpoint.dir``, or a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pactlake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once as Parquet in the shared folder and read back: what is used twice is computed once, and survives a lost executor."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
