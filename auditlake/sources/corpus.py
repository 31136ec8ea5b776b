"""Source files as rows, and their code units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions.text import basename, line_array

#: A line that opens a function.
FN_START = r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+"
FN_NAME = r"^[ \t]*" + FN_START + r"(\w+)"
STRUCT_NAME = r"struct\s+(\w+)"
STRUCT_BLOCK = r"((?:#\[derive\([^)]*\)\]\s*)?pub\s+struct\s+(\w+)[^{;]*\{([^{}]*)\})"


def read_corpus(spark: SparkSession, path: str, glob: str = "*.rs") -> DataFrame:
    """One row per source file below path; program is the first folder below path."""
    files = (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(path)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file_path"))
    )
    root = path.rstrip("/").split("/")[-1]
    program = F.regexp_extract("file_path", rf"/{root}/([^/]+)/", 1)
    return files.select(
        F.when(program == "", F.lit(root)).otherwise(program).alias("program"), "file_path",
        basename(F.col("file_path")).alias("file_name"), "content",
    )


def source_string(spark: SparkSession, content: str, file_path: str = "inline.rs", program: str = "inline") -> DataFrame:
    """A source text given as a string, in the shape of read_corpus."""
    return spark.createDataFrame(
        [(program, file_path, file_path.split("/")[-1], content)],
        "program string, file_path string, file_name string, content string",
    )


# Limits of the source guard.
MAX_SOURCE_BYTES = 10 * 1024 * 1024
MAX_PATH_DEPTH = 50


def validate_source(df: DataFrame, text: str = "content", limit: int = MAX_SOURCE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): missing texts, texts of more than limit bytes and binary-looking ones are rejected; an
    empty text is accepted."""
    col = F.col(text)
    reason = (
        F.when(col.isNull(), "missing").when(F.octet_length(col) > limit, "too long")
        .when(F.contains(col, F.lit("\u0000")), "binary")
    )
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def validate_path(df: DataFrame, path: str = "file_path", depth: int = MAX_PATH_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): missing paths, paths with '..' and paths of more than depth components are rejected. A
    root and a leading '.' are components, empty ones and other '.' are not."""
    col = F.col(path)
    named = F.filter(F.split(col, "/"), lambda p: ~p.isin("", "."))
    start = F.when(col.startswith("/") | col.startswith("./") | (col == "."), 1).otherwise(0)
    reason = (
        F.when(col.isNull(), "missing").when(F.contains(col, F.lit("..")), "traversal")
        .when(F.size(named) + start > depth, "too deep")
    )
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def explode_lines(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per line: line_no from 1, line, is_blank, is_comment."""
    keep = keep or [c for c in df.columns if c != text]
    lines = df.select(*keep, F.posexplode(line_array(F.col(text))).alias("_i", "line"))
    trimmed = F.trim(F.col("line"))
    return lines.select(
        *keep, (F.col("_i") + 1).alias("line_no"), "line", (trimmed == "").alias("is_blank"),
        trimmed.startswith("//").alias("is_comment"),
    )


def _segments(text, start: str):
    """Array of pieces, each beginning at a line that opens a unit (the first piece is the preamble)."""
    return F.split(text, rf"(?m)^(?=[ \t]*{start})", -1)


def _offsets(pieces):
    """Array of the first line number of every piece, computed inside the row."""
    newlines = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    first = F.array(F.lit(1)).cast("array<int>")
    return F.aggregate(newlines, first, lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))


def _with_offsets(pieces):
    """Array of struct(code, line): first line number of every piece, computed inside the row."""
    return F.zip_with(pieces, F.slice(_offsets(pieces), F.lit(1), F.size(pieces)), lambda p, s: F.struct(p.alias("code"), s.alias("line")))


def extract_units(
    df: DataFrame, text: str = "content", keep: list[str] | None = None, start: str = FN_START, name: str = FN_NAME
) -> DataFrame:
    """Units of each text: unit_no, fn_name, line, code. Everything happens inside the file's row."""
    keep = keep or [c for c in df.columns if c != text]
    rows = df.select(*keep, _segments(F.col(text), start).alias("_p"))
    # Names are read before the pieces become rows, where the filter below can look at a finished value. First lines stay an
    # array of their own, so that a plan without `line` doesn't count them.
    named = F.transform("_p", lambda p: F.struct(F.regexp_extract(p, name, 1).alias("fn_name"), p.alias("code")))
    pieces = rows.select(*keep, _offsets(F.col("_p")).alias("_at"), F.posexplode(named).alias("unit_no", "_u")).filter("_u.fn_name <> ''")
    return pieces.select(*keep, "unit_no", F.col("_u.fn_name").alias("fn_name"), F.get("_at", F.col("unit_no")).alias("line"), F.col("_u.code").alias("code"))


def enclosing_unit(
    df: DataFrame, text: str = "content", keep: list[str] | None = None, start: str = FN_START, name: str = FN_NAME,
    unknown: str = "unknown",
) -> DataFrame:
    """Lines with the name of the unit that encloses them (the nearest opening line above)."""
    keep = keep or [c for c in df.columns if c != text]
    pieces = df.select(*keep, F.explode(_with_offsets(_segments(F.col(text), start))).alias("_u"))
    fn = F.nullif(F.regexp_extract(F.col("_u.code"), name, 1), F.lit(""))
    pieces = pieces.select(*keep, F.coalesce(fn, F.lit(unknown)).alias("fn_name"), "_u").filter("_u.code <> ''")
    lines = pieces.select(*keep, "fn_name", "_u.line", F.posexplode(line_array(F.col("_u.code"))).alias("_i", "text"))
    return lines.select(*keep, (F.col("line") + F.col("_i")).alias("line_no"), "fn_name", F.col("text").alias("line"))


def extract_structs(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Struct blocks: struct_no (place in the text), struct_name, block, body."""
    keep = keep or [c for c in df.columns if c != text]
    col = F.col(text)
    blocks = df.select(*keep, F.posexplode(F.regexp_extract_all(col, F.lit(STRUCT_BLOCK), F.lit(1))).alias("struct_no", "block"))
    return blocks.select(
        *keep, "struct_no", "block", F.regexp_extract("block", STRUCT_NAME, 1).alias("struct_name"),
        F.replace(F.substring_index("block", "{", -1), F.lit("}"), F.lit("")).alias("body"))


CONTEXT_NAME = r"Context<(?:[^<>]*,\s*)?([A-Z]\w*)\s*>"


def join_context(units: DataFrame, structs: DataFrame, file: str = "file_path") -> DataFrame:
    """Put the account struct named by a handler's Context<...> in front of its code (left equi-join). Of structs of one
    name in a file the last counts."""
    named = units.withColumn("_s", F.nullif(F.regexp_extract("code", CONTEXT_NAME, 1), F.lit("")))
    blocks = structs.filter(F.col(file).isNotNull()).groupBy(file, "struct_name").agg(F.max_by("block", "struct_no").alias("block"))
    # a file's structs meet in one row and the join is by file alone, so files that lie together by path stay where they are
    held = blocks.groupBy(file).agg(F.collect_list(F.struct("struct_name", "block")).alias("_blocks"))
    block = F.get(F.filter("_blocks", lambda b: b["struct_name"] == F.col("_s")), F.lit(0))["block"]
    joined = named.join(held, file, "left").withColumn("accounts_struct", block).drop("_blocks")
    code = F.when(
        F.col("accounts_struct").isNotNull(),
        F.concat(F.lit("/* ACCOUNTS_STRUCT: "), "_s", F.lit(" */\n"), "accounts_struct", F.lit("\n/* HANDLER: */\n"), "code"),
    ).otherwise(F.col("code"))
    return joined.withColumn("code", code).drop("_s")


def units_with_context(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """extract_units with the account struct in front, looked up inside the file's own row (no shuffle)."""
    keep = keep or [c for c in df.columns if c != text]
    # only texts and units that name a context are searched by patterns
    found = F.when(F.contains(text, F.lit("Context<")), F.regexp_extract_all(F.col(text), F.lit(STRUCT_BLOCK), F.lit(1)))
    blocks = df.withColumn("_structs", F.transform(found, lambda b: F.struct(F.regexp_extract(b, STRUCT_NAME, 1).alias("name"), b.alias("block"))))
    units = extract_units(blocks, text, [*keep, "_structs"])
    units = units.withColumn("_s", F.when(F.contains("code", F.lit("Context<")), F.nullif(F.regexp_extract("code", CONTEXT_NAME, 1), F.lit(""))))
    named = F.filter("_structs", lambda s: s["name"] == F.col("_s"))
    units = units.withColumn("accounts_struct", F.when(F.col("_s").isNotNull(), F.get(F.reverse(named), F.lit(0))["block"]))
    code = F.when(
        F.col("accounts_struct").isNotNull(),
        F.concat(F.lit("/* ACCOUNTS_STRUCT: "), "_s", F.lit(" */\n"), "accounts_struct", F.lit("\n/* HANDLER: */\n"), "code"),
    ).otherwise(F.col("code"))
    return units.withColumn("code", code).drop("_s", "_structs")


def with_snippet(df: DataFrame, k: int, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Lines with a snippet of k lines before and after, cut from the file's own row."""
    keep = keep or [c for c in df.columns if c != text]
    rows = df.select(*keep, line_array(F.col(text)).alias("_all"))
    rows = rows.select(*keep, "_all", F.posexplode("_all").alias("_i", "line"))
    first = F.greatest(F.col("_i") - k, F.lit(0))
    part = F.slice("_all", first + 1, F.col("_i") - first + k + 1)
    return rows.select(*keep, (F.col("_i") + 1).alias("line_no"), "line", F.array_join(part, "\n").alias("snippet"))


def line_snippets(lines: DataFrame, k: int, keys: list[str], order: str = "line_no", text: str = "line") -> DataFrame:
    """with_snippet for a table of lines that no longer has the file row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)
    return lines.withColumn("snippet", F.array_join(F.collect_list(text).over(w), "\n"))
