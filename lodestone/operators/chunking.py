"""Chunking: fixed windows, overlapping windows inside marked regions, byte limits, manifests."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.folds import in_order

V1_LINES, V1_LOG_LINES = 40, 80
V2_LINES, V2_OVERLAP, V2_BYTES = 120, 12, 32768
DECLARED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def fixed_windows(docs: DataFrame, size: int = V1_LINES, log_size: int = V1_LOG_LINES, counts: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """docs (input_id, input_type, classification, path, content, ...) -> chunks of whole lines, without overlap. No shuffle: a document's windows come from its own row.

    counts: names with what each line counts as. It is worked out once a line, and name_here and name_file add it up over the chunk and its document.
    """
    n = F.when(F.col("input_type") == "log", log_size).otherwise(size)
    rows = docs.where(F.col("content") != "").withColumn("_lines", T.lines(F.col("content")))  # any other text has a line
    added = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    for name, of_line in (counts or {}).items():
        rows = rows.withColumn(f"_{name}", F.transform("_lines", of_line)).withColumn(f"{name}_file", added(F.col(f"_{name}")))
    rows = rows.withColumn("_n", n).withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / F.col("_n")).cast("int"))))
    part = lambda c: F.slice(c, F.col("_at") * F.col("_n") + 1, F.col("_n"))
    out = rows.withColumns({f"{name}_here": added(part(f"_{name}")) for name in counts}) if counts else rows
    out = out.withColumn("content", F.array_join(part("_lines"), "\n")).withColumn("line_start", F.col("_at") * F.col("_n") + 1).withColumn("line_end", F.least((F.col("_at") + 1) * F.col("_n"), F.size("_lines")))
    return chunk_record(out.drop("_lines", "_n", "_at", *(f"_{name}" for name in counts or {})))


def chunk_record(rows: DataFrame) -> DataFrame:
    """Adds chunk_hash, chunk_id and token_estimate."""
    digest = F.sha2("content", 256)
    return rows.withColumn("chunk_hash", F.concat(F.lit("sha256:"), digest)).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.substring(digest, 1, 12), F.lit("_"), F.col("line_start"))).withColumn("token_estimate", T.tokens_v1(F.col("content")))


def region_starts(lines: Column, markers: Column | None) -> Column:
    """Where regions begin: line 1 and every marked line. markers: array<struct<line, symbol>>, sorted, a line once."""
    first = F.array(F.struct(F.lit(1).alias("line"), F.lit("").alias("symbol")))
    if markers is None:
        return first
    return F.array_sort(F.concat(F.filter(first, lambda f: ~F.exists(markers, lambda m: m["line"] == 1)), markers))


def region_windows(docs: DataFrame, markers: str | None = None, size: int = V2_LINES, overlap: int = V2_OVERLAP) -> DataFrame:
    """Windows of size lines that overlap inside a region and never leave it; blank ones are left out. Adds line_start, line_end, symbol, content."""
    rows = docs.withColumn("_lines", T.lines(F.coalesce("content", F.lit("")))).where(F.size("_lines") > 0)
    starts = region_starts(F.col("_lines"), F.col(markers) if markers else None)
    rows = rows.withColumn("_starts", starts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_starts"))))
    begin = F.col("_starts")[F.col("_i") - 1]
    end = F.coalesce(F.try_element_at("_starts", F.col("_i") + 1)["line"] - 1, F.size("_lines"))
    rows = rows.withColumn("symbol", begin["symbol"]).withColumn("_from", begin["line"]).withColumn("_to", end).where("_from <= _to")
    step = size - overlap
    more = F.greatest(F.lit(0), F.ceil((F.col("_to") - F.col("_from") + 1 - size) / step)).cast("int")  # windows after the first
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), more)))
    rows = rows.withColumn("line_start", F.col("_from") + F.col("_k") * step).withColumn("line_end", F.least(F.col("_from") + F.col("_k") * step + size - 1, F.col("_to")))
    rows = rows.withColumn("content", F.array_join(F.slice("_lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n"))
    return rows.where(T.strip(F.col("content")) != "").drop("_lines", "_starts", "_i", "_from", "_to", "_k")


def chunk_record_v2(rows: DataFrame, namespace: str = "") -> DataFrame:
    """chunk_id from namespace, path, lines, segment and content; rows have path, line_start, line_end, segment, content."""
    digest = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    key = F.concat_ws("\x00", F.lit(namespace), "path", "line_start", "line_end", "segment", digest)
    return rows.withColumn("content_hash", digest).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.substring(F.sha2(key, 256), 1, 20))).withColumn("token_estimate", T.tokens_v2(F.col("content")))


def byte_pieces(text: str, most: int) -> list[str]:
    """text cut before the last character that would pass most UTF-8 bytes; a longer character is a piece of its own."""
    data = text.encode("utf-8", "replace")
    begins = np.flatnonzero(np.frombuffer(data + b"\0", np.uint8) & 0xC0 != 0x80)  # of characters, and the end
    cuts = [0]
    while cuts[-1] < len(data):
        fits = np.searchsorted(begins, cuts[-1] + most, "right") - 1
        cuts.append(int(begins[max(fits, np.searchsorted(begins, cuts[-1]) + 1)]))
    return [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]


def split_bytes(rows: DataFrame, most: int = V2_BYTES) -> DataFrame:
    """Adds segment; content over most UTF-8 bytes becomes several rows, no character cut. Only the content of oversized rows passes through Python."""

    @F.arrow_udf("array<string>")
    def cut(contents: pa.Array) -> pa.Array:
        return pa.array([byte_pieces(c.as_py(), most) for c in contents], pa.list_(pa.string()))

    small = rows.where(F.octet_length("content") <= most).withColumn("segment", F.lit(0))
    large = rows.where(F.octet_length("content") > most).select("*", F.posexplode(cut("content")).alias("segment", "_piece"))
    return small.unionByName(large.withColumn("content", F.col("_piece")).drop("_piece"))


# Declarations that begin a region, by language.
MARKERS = {
    "go": r"^\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Za-z_][\w]*)",
    "javascript": r"^\s*(?:export\s+)?(?:async\s+)?(?:function|class)\s+([A-Za-z_$][\w$]*)|^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)|^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+([A-Za-z_][\w]*)",
    "java": r"^\s*(?:public|protected|private|static|final|abstract|synchronized|native|\s)+\s*(?:class|interface|enum|[\w<>\[\],?]+)\s+([A-Za-z_][\w]*)\s*(?:\(|\{|extends|implements)",
    "c": r"^\s*(?:[A-Za-z_]\w*[\s*]+)+([A-Za-z_]\w*)\s*\([^;]*\)\s*\{",
    "cpp": r"^\s*(?:template\s*<[^>]+>\s*)?(?:[A-Za-z_:~]\w*[\s:*&<>]+)+([A-Za-z_:~]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{",
    "ruby": r"^\s*(?:def|class|module)\s+([A-Za-z_][\w:!?=]*)",
    "shell": r"^\s*(?:function\s+)?([A-Za-z_][\w]*)\s*\(\s*\)\s*\{",
    "python": r"^([ \t]*)(?:(?:async\s+)?def|class)\s+([A-Za-z_][\w]*)",
}


def line_numbers(text: str, places: list[int]) -> list[int]:
    """The line of each place, from 1 on; the breaks are found once."""
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    return (1 + np.searchsorted(breaks, places, "left")).tolist()


def matched_markers(text: str, language: str) -> dict[int, str]:
    """Line and name of each declaration that the language's pattern finds; leading blank lines belong to a declaration, which stands at the second of them where it begins with one."""
    named = [(m.start() + 1, name) for m in re.compile(MARKERS[language], re.MULTILINE).finditer(text) if (name := next(filter(None, m.groups()), None))]
    found: dict[int, str] = {}
    for line, (_, name) in zip(line_numbers(text, [at for at, _ in named]), named):
        found.setdefault(line, name)
    return found


def python_markers(text: str) -> dict[int, str]:
    """Top-level declarations; where others are indented and the text parses, its grammar gives these and the methods of classes as Class.method."""
    matches = list(re.compile(MARKERS["python"], re.MULTILINE).finditer(text))
    if any(m[1] for m in matches):
        try:
            tops = [n for n in ast.parse(text).body if isinstance(n, DECLARED)]
        except (SyntaxError, ValueError):
            tops = None
        if tops is not None:
            methods = ((m.lineno, f"{c.name}.{m.name}") for c in tops if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, DECLARED[:2]))
            return dict([*methods, *((n.lineno, n.name) for n in tops)])
    tops = [m for m in matches if not m[1]]
    return dict(zip(line_numbers(text, [m.start() for m in tops]), (m[2] for m in tops)))


def _markers(texts: pa.Array, languages: pa.Array) -> pa.Array:
    out = []
    for text, language in zip(texts.to_pylist(), languages.to_pylist()):
        found = python_markers(text or "") if language == "python" else matched_markers(text or "", language) if language in MARKERS else {}
        out.append([{"line": k, "symbol": found[k]} for k in sorted(found)])
    return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("symbol", pa.string())])))


def markers_of(content: Column, language: Column) -> Column:
    """array<struct<line, symbol>>: declarations of a source text, each line once, in order. Texts of other languages don't pass through Python whole."""
    found = F.arrow_udf(_markers, "array<struct<line:int,symbol:string>>")
    return found(F.when(language.isin(*MARKERS), content), language)


def source_regions(docs: DataFrame, size: int = V2_LINES, overlap: int = V2_OVERLAP, namespace: str = "") -> DataFrame:
    """The whole chunking of source files (path, language, content): regions that declarations begin, overlapping windows, the byte limit, ids."""
    marked = docs.withColumn("_markers", markers_of(F.col("content"), F.col("language")))
    return chunk_record_v2(split_bytes(region_windows(marked, "_markers", size, overlap).drop("_markers")), namespace)


INPUT_TYPES = ["artifact", "document", "file", "log", "repo"]


def manifest(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens, paths, and chunks by input type."""
    by_type = [F.count_if(F.col("input_type") == t).alias(f"{t}_chunks") for t in INPUT_TYPES]
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_estimate").alias("token_estimate"), F.count_distinct("path").alias("path_count"), *by_type)


def first_paths(chunks: DataFrame, order: list[str], limit: int = 64) -> DataFrame:
    """The first paths as they came, each once."""
    firsts = chunks.groupBy("path").agg(F.min(F.struct(*order)).alias("came")).orderBy("came", "path").limit(limit)
    return firsts.select("path", F.row_number().over(Window.orderBy("came", "path")).alias("place"))


def path_counts(chunks: DataFrame, order: str, limit: int = 24) -> DataFrame:
    """The paths with most chunks, ties by first appearance."""
    return chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"), F.min(order).alias("first_seen")).orderBy(F.desc("chunk_count"), "first_seen").limit(limit)


def drop_repeated(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The first chunk of each hash, with how many others it stands for. Counting is combined before the shuffle; no group is sorted."""
    first = F.struct(*order, *(c for c in chunks.columns if c not in order))
    kept = chunks.groupBy("chunk_hash").agg(F.min(first).alias("first"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return kept.select("first.*", "duplicates")


def with_position(chunks: DataFrame, order: list[str]) -> DataFrame:
    """A struct that sorts as the chunks came, for stable ties."""
    return chunks.withColumn("pos", F.struct(*order))


def segments_for_embedding(texts: DataFrame, text: str = "content", tokens: int = 256) -> DataFrame:
    """Pieces of 4 characters a token at most, broken after the last line break or space beyond the half; stripped, empty ones left out.

    One pattern, greedy from where the last piece ended: all that is left if it fits, else the longest piece that ends
    in a break beyond the half, else a full piece.
    """
    most = max(64, tokens * 4)
    pattern = rf"(?s)(.{{1,{most}}}\z|.{{{most // 2 + 1},{most - 1}}}[\n ]|.{{{most}}})"
    whole = F.coalesce(F.col(text), F.lit(""))
    pieces = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(pattern), 1), T.strip), lambda p: p != "")
    found = F.when(F.char_length(whole) <= most, F.array(whole)).when(F.size(pieces) == 0, F.array(F.left(whole, F.lit(most)))).otherwise(pieces)
    return texts.select("*", F.posexplode(found).alias("segment", "segment_text"))


def pack_batches(rows: DataFrame, group: str, order: list[str], items: int = 16, tokens: int = 2048) -> DataFrame:
    """Adds batch: within a group, a batch closes before it would pass items or tokens."""

    def step(state: tuple[int, int, int], cost: int) -> tuple:
        batch, n, used = state
        if n and (n >= items or used + cost > tokens):
            batch, n, used = batch + 1, 0, 0
        return (batch, n + 1, used + cost), (batch,)

    return in_order(rows, group, order, ["token_estimate"], {"batch": ("int", pa.int32())}, lambda: (0, 0, 0), step)


def lead_line(partition: list[str]) -> Column:
    """Where the next marker of the same file stands, less one: markers kept as rows."""
    return F.lead("line").over(Window.partitionBy(*partition).orderBy("line")) - 1
