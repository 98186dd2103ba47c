"""Loading of block-structured lines with the failing rows set apart, each with its reason.

Lines become cells (row, column, value); a rule table says what holds for which column of which block; failing cells
are aggregated to the first reason of their row and the clean rows are what is left by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the file format: block labels with the columns of their data lines.
BLOCKS = {
    "#!ctsdata": ["urn", "text"],
    "#!tokens": ["context", "id", "tokentype", "text", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"],
    "#!verbal_units": ["context", "token", "syntactic_type", "semantic_type"],
    "#!sentences": ["context_begin", "first_token", "context_end", "last_token"],
}
REASONS = ["quoting", "column_count", "bad_urn", "bad_text", "bad_context"]

BLANK = r"(?U)^\s*\z"
# A quoted field, or a plain one; possessive, so that matching is linear and does not recurse in long fields.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
FIELD = rf'(?:{QUOTED}|[^"|][^|]*+|)'
WELL_QUOTED = rf"^{FIELD}(?:\|{FIELD})*+\z"
EACH_FIELD = rf"\|({QUOTED}|[^|]*+)"
# bad_text: only blanks, or a replacement or control character
ONLY_BLANKS = r"^[\u0020\u00A0\u3000\u200B]*\z"
DAMAGED = r"[\uFFFD\u0000-\u001F\u007F-\u009F]"
GOOD_URN = r"^urn:cts:[^:]+:[^:]+:[^:]+\z"
URN_SPACE = r"(?U)[\s\u200B]"
GOOD_CONTEXT = r"^(?:[a-z0-9]+(?:\.[a-z0-9]+){0,2})?\z"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules, about ten rows: block, col (0 is the row as such), check, prio (order of reasons), reason."""
    rows = [(b, 0, check, k, check) for b in BLOCKS for k, check in enumerate(REASONS[:2])]
    rows += [("#!ctsdata", 1, "urn", 2, "bad_urn"), ("#!ctsdata", 2, "text", 3, "bad_text")]
    rows += [(b, k + 1, "context", 4, "bad_context") for b, cols in BLOCKS.items() for k, c in enumerate(cols) if c.startswith("context")]
    return spark.createDataFrame(rows, "block string, col int, check string, prio int, reason string")


def block_lines(raw: DataFrame, chunk: int = 4096) -> DataFrame:
    """Data lines with their block: file_id, line_no, block, line.

    raw: file_id, line_no, line. Repeated deliveries of a line are one line (the greatest text, should they differ);
    null lines count as blank; lines of null file_id or line_no and lines before any label are no data. Label state is
    carried in two steps, inside chunks of `chunk` lines and then over one summary row a chunk, so that one huge file
    does not end up in one task.
    """
    part = F.floor(F.col("line_no") / chunk).alias("chunk")
    lines = (
        raw.where(F.col("file_id").isNotNull() & F.col("line_no").isNotNull())
        .select("file_id", part, "line_no", "line")
        .groupBy("file_id", "chunk", "line_no")
        .agg(F.max("line").alias("line"))
        .where(F.col("line").isNotNull() & ~F.col("line").rlike(BLANK))
        .repartition("file_id", "chunk")
        .withColumn("label_at", F.when(F.col("line").isin(list(BLOCKS)), F.struct("line_no", F.col("line").alias("label"))))
    )
    inside = Window.partitionBy("file_id", "chunk").orderBy("line_no")
    so_far = lines.select(
        "file_id", "chunk", "line_no", "line", F.col("label_at").isNotNull().alias("is_label"),
        F.last("label_at", ignorenulls=True).over(inside).alias("label_at"), F.lag("line_no").over(inside).alias("before"),
    )
    over = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        lines.groupBy("file_id", "chunk")
        .agg(F.max("label_at").alias("label_at"), F.max("line_no").alias("last_line"))
        .select("file_id", "chunk", F.last("label_at", ignorenulls=True).over(over).alias("carried"), F.last("last_line").over(over).alias("carried_line"))
    )
    state = so_far.join(carry, ["file_id", "chunk"]).withColumn("at", F.coalesce("label_at", "carried")).withColumn("before", F.coalesce("before", "carried_line"))
    return state.where(~F.col("is_label") & F.col("at").isNotNull() & (F.col("before") != F.col("at.line_no"))).select("file_id", "line_no", F.col("at.label").alias("block"), "line")


def parse_fields(lines: DataFrame) -> DataFrame:
    """Adds well_quoted and fields (unquoted values; only meaningful when well_quoted)."""
    raw_fields = F.regexp_extract_all(F.concat(F.lit("|"), F.col("line")), F.lit(EACH_FIELD), 1)
    plain = F.split("line", r"\|", -1)
    unquoted = F.expr("""transform(raw_fields, f -> if(startswith(f, '"'), replace(substring(f, 2, length(f) - 2), '""', '"'), f))""")
    return (
        lines.withColumn("well_quoted", F.col("line").rlike(WELL_QUOTED))
        .withColumn("raw_fields", F.when(F.col("line").contains('"'), raw_fields).otherwise(plain))
        .withColumn("fields", F.when(F.col("line").contains('"'), unquoted).otherwise(F.col("raw_fields")))
        .drop("raw_fields")
    )


def failures(parsed: DataFrame) -> DataFrame:
    """file_id, line_no, reason: the first reason that applies to a row."""
    counts = F.create_map(*[F.lit(x) for b, cols in BLOCKS.items() for x in (b, len(cols))])
    shape = F.when(~F.col("well_quoted"), "quoting").when(F.size("fields") != F.try_element_at(counts, F.col("block")), "column_count").otherwise("ok")
    whole = F.struct(F.lit(0).alias("col"), shape.alias("value"))
    each = F.when(F.col("well_quoted"), F.expr("transform(fields, (v, k) -> struct(k + 1 AS col, v AS value))")).otherwise(F.array().cast("array<struct<col:int,value:string>>"))
    cells = parsed.select("file_id", "line_no", "block", F.explode(F.concat(F.array(whole), each)).alias("c")).select("file_id", "line_no", "block", "c.col", "c.value")
    v = F.col("value")
    fails = (
        F.when(F.col("check").isin("quoting", "column_count"), v == F.col("check"))
        .when(F.col("check") == "urn", ~v.rlike(GOOD_URN) | v.rlike(URN_SPACE))
        .when(F.col("check") == "text", v.rlike(ONLY_BLANKS) | v.rlike(DAMAGED))
        .when(F.col("check") == "context", ~v.rlike(GOOD_CONTEXT))
    )
    # the rule table is built above from constants, about a dozen rows: safe to broadcast
    found = cells.join(F.broadcast(rule_table(parsed.sparkSession)), ["block", "col"]).where(fails)
    return found.groupBy("file_id", "line_no").agg(F.min_by("reason", "prio").alias("reason"))


def split_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected) data rows of raw lines.

    loaded: file_id, line_no, block, fields; rejected: file_id, line_no, reason. Every data line is in exactly one.
    """
    parsed = parse_fields(block_lines(raw))
    bad = failures(parsed)
    return parsed.join(bad, ["file_id", "line_no"], "left_anti").select("file_id", "line_no", "block", "fields"), bad


def typed_block(loaded: DataFrame, block: str) -> DataFrame:
    """The loaded rows of one block with its named columns; ctsdata urns split into urnbase and citation; '' read as NULL elsewhere."""
    rows = loaded.where(F.col("block") == block)
    if block == "#!ctsdata":
        parts = F.split(F.col("fields")[0], ":", -1)
        return rows.select("file_id", "line_no", F.concat(F.array_join(F.slice(parts, 1, 4), ":"), F.lit(":")).alias("urnbase"), parts[4].alias("citation"), F.col("fields")[1].alias("text"))
    return rows.select("file_id", "line_no", *[F.nullif(F.col("fields")[k], F.lit("")).alias(c) for k, c in enumerate(BLOCKS[block])])
