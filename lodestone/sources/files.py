"""Corpora, listings, JSON records and scheduler output as tables, and the writers for results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.classes import EXCLUDED_DIRS, TEXT_ENDINGS, extension, hits_directory, language_of_path, scheduler_state


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deals the rows of a table that is one small file out by a key, so that they are worked on by all cores. A table of several files is split by the scan, and stays as it is."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key) if len(rows.inputFiles()) == 1 else rows


def file_path_of(uri: Column) -> Column:
    """The path of a file URI, percent-decoded, plus signs kept; any other scheme is an error."""
    path = F.url_decode(F.replace(F.regexp_replace(uri, "^file://[^/]*", ""), F.lit("+"), F.lit("%2B")))
    return F.when(F.lower(uri).startswith("file:"), path).otherwise(F.raise_error(F.concat(F.lit("unsupported input uri: "), uri)).cast("string"))


def normalized_uri(uri: Column) -> Column:
    """file, repo, directory, log and document URIs as file URIs, a host joined into the path; others stay."""
    scheme, rest = F.lower(F.regexp_extract(uri, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(uri, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), rest), "/+", "/"), "(.)/$", "$1")
    return F.when(scheme.isin("file", "repo", "directory", "log", "document"), F.concat(F.lit("file://"), path)).otherwise(uri)


def artifact_id(uri: Column) -> Column:
    return F.regexp_replace(uri, "^artifact://", "")


def texts(spark: SparkSession, root: str, kind: str = "document", classification: str = "unknown", excluded: list[str] | None = None) -> DataFrame:
    """Whole files under root as documents; undecodable bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root), "^file:", "")
    rows = raw.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.concat(F.lit("^"), F.regexp_replace(base, "/+$", ""), F.lit("/?")), "").alias("path"), "content", F.col("length").alias("size"))
    kept = rows.where(~hits_directory(F.col("path"), excluded or EXCLUDED_DIRS) & (extension(F.col("path")).isin(*TEXT_ENDINGS, ".log", ".rst") | (F.substring_index("path", "/", -1) == "go.mod")))
    return kept.select(F.sha2("path", 256).alias("input_id"), F.lit(kind).alias("input_type"), F.lit(classification).alias("classification"), "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "size")


def relative(path: Column, root: str) -> Column:
    """A path below a root as it is listed, whatever scheme and slashes both have."""
    base = F.regexp_replace(F.regexp_replace(F.lit(root), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/+$", "")
    plain = F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "/+", "/")
    return F.regexp_replace(F.when(plain.startswith(F.concat(base, F.lit("/"))), F.substr(plain, F.length(base) + 2)).otherwise(plain), "^(\\./)+", "")


def listing(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored listing, a path a line or between NULs, as (path); None where there is none or it names nothing."""
    try:
        lines = spark.read.text(path)
        found = lines.select(F.explode(F.split("value", "\x00")).alias("path")).where(F.trim("path") != "")
        return found if found.limit(1).count() else None
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def discovered(spark: SparkSession, root: str, listings: list[str] | None = None) -> DataFrame:
    """(path, absolute, language, origin): the source files below a root, each absolute path once, in a language that is known by its name and in no directory that a scan leaves out.

    The first of the stored listings that names a file says what there is (a repository's own list, then a search
    tool's); without any, the tree is walked. Files of a listing that are not there any more are left out. Listed files
    come with what the store says of them, none is opened. The store follows links, so a link and its target are two.
    """
    walked = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(F.col("path"), root).alias("path"), "length", "modificationTime")
    origin, listed_paths = "walk", None
    for name in listings or []:
        if (listed_paths := listing(spark, name)) is not None:
            origin = name.rsplit("/", 1)[-1]
            break
    rows = walked if listed_paths is None else walked.join(listed_paths.select(relative(F.col("path"), root).alias("path")).distinct(), "path", "left_semi")
    language = language_of_path(F.col("path"))
    kept = rows.withColumn("language", language).where((F.col("language") != "") & ~hits_directory(F.col("path"), EXCLUDED_DIRS))
    base = root.rstrip("/")
    return kept.select("path", F.concat(F.lit(base + "/"), "path").alias("absolute"), "language", F.lit(origin).alias("origin"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).dropDuplicates(["absolute"])


def read_discovered(spark: SparkSession, root: str, found: DataFrame) -> DataFrame:
    """The files of discovered() with content; undecodable bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(F.col("path"), root).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return raw.join(found, "path")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file, without reading any."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return raw.where(~hits_directory(F.col("path"), EXCLUDED_DIRS))


def listed(path: str) -> str:
    """A pattern that only the path itself matches. A stream takes a plain path for a folder, and what a pattern matches for a folder or a file."""
    return path if set(path) & set("*?[]{}\\") else f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream; per_trigger files at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(listed(path))


def numbered_lines(docs: DataFrame) -> DataFrame:
    from lodestone.functions.text import lines

    return docs.select(*(c for c in docs.columns if c != "content"), F.posexplode(lines(F.col("content"))).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def grep_line(line: Column) -> Column:
    """path:number:text; fewer parts give empty ones, no number gives 0."""
    parts = F.split(line, ":", 3)
    whole = F.size(parts) == 3
    return F.struct(F.when(whole, parts[0]).otherwise("").alias("path"), F.when(whole, F.coalesce(parts[1].try_cast("int"), F.lit(0))).otherwise(0).alias("line_no"), F.when(whole, parts[2]).otherwise("").alias("text"))


def tag_line(line: Column) -> Column:
    """name, kind and the first number of the third field of a tab-separated tag."""
    parts = F.split(line, "\t")
    return F.when(F.size(parts) >= 3, F.struct(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("kind"), F.regexp_extract(parts[2], "(\\d+)", 1).try_cast("int").alias("line_no")))


def pipe_fields(line: Column, names: list[str]) -> Column:
    """A pipe-separated row with exactly these fields, else null."""
    parts = F.split(line, "\\|", -1)
    return F.when(F.size(parts) == len(names), F.struct(*(F.trim(parts[i]).alias(n) for i, n in enumerate(names))))


def nodes(lines: DataFrame) -> DataFrame:
    n = pipe_fields(F.col("line"), ["partition", "node", "features", "gres", "state"])
    rows = lines.select(n.alias("n")).where("n IS NOT NULL").select("n.*")
    return rows.withColumn("partition", F.rtrim("partition", F.lit("*"))).withColumn("state", F.lower("state"))


def queue(lines: DataFrame) -> DataFrame:
    q = pipe_fields(F.col("line"), ["partition", "state", "nodes"])
    return lines.select(q.alias("q")).where("q IS NOT NULL").select("q.*").withColumn("state", F.lower("state"))


def run_status(lines: DataFrame, run_id: str) -> DataFrame:
    """The state of the first row of a run, queued if there is none."""
    parts = F.split("line", "\\|")
    rows = lines.where((F.size(parts) >= 2) & (F.trim(parts[0]) == run_id)).agg(F.min_by(parts[1], "line_no").alias("raw"))
    return rows.select(F.coalesce(scheduler_state(F.col("raw")), F.lit("queued")).alias("state"))


def json_table(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """JSON rows; a broken one is a row with its text in _corrupt_record, which callers take as pending."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", whole_files).json(path)


def first_json(text: Column) -> Column:
    """The text where it is an object, else from its first brace to its last."""
    whole = F.when(F.try_parse_json(text).isNotNull(), text)
    inner = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))


def combined_log(out: Column, err: Column) -> Column:
    """Both streams under headers; an empty one is left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"== {name} ==\n"), F.regexp_replace(c, "\\n+\\z", "")))
    return F.concat_ws("\n\n", part("stdout", out), part("stderr", err))


def write_artifacts(rows: DataFrame, path: str, only: list[str] | None = None) -> None:
    """A folder for each artifact_type."""
    (rows.where(F.col("artifact_type").isin(*only)) if only else rows).write.mode("overwrite").partitionBy("artifact_type").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def publish(rows: DataFrame, root: str, version: str) -> str:
    """Writes a new version beside the old ones and returns its path; readers switch by name, so no half-written table is seen."""
    path = f"{root.rstrip('/')}/v={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def write_shards(rows: DataFrame, path: str, id_: str, width: int = 2) -> None:
    """A folder for each head of the id's hash."""
    rows.withColumn("shard", F.substring(F.sha2(F.col(id_).cast("string"), 256), 1, width)).write.mode("overwrite").partitionBy("shard").parquet(path)
