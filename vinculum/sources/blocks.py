"""Strict readers of block-structured files: every error is a row with its place, the strict form raises the first.

Lines are numbered as Python's splitlines numbers them (but a blank line at a file's end that only a rarer break begins
counts). Files are read by splits, and state (line numbers, which block a line is in) is carried over splits and chunks, so
one huge file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinculum.functions.scan import scan
from vinculum.functions.text import decode_field, quoted
from vinculum.operators.checks import in_spans, raise_first
from vinculum.runtime import cut
from vinculum.schemas import IMPLIED, SEMANTIC, SYNTACTIC, TOKENTYPES

# Block labels and headers of analysis files and of passage files.
ANALYSIS = {
    "#!sentences": "context_begin|first_token|context_end|last_token",
    "#!verbal_units": "context|token|syntactic_type|semantic_type",
    "#!tokens": "context|id|tokentype|text|lemma|verbalunit|related1|relationship1|related2|relationship2",
}
PASSAGES = "#!ctsdata"
BREAKS = "\r\n|[" + "".join(map(chr, (0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029))) + "]"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line_no (from 1), line of text files, broken at every line break that Python's splitlines knows; an empty file has none."""
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.posexplode(F.split("value", BREAKS, -1)).alias("k", "line"), F.monotonically_increasing_id().alias("row"))
    rows = cut(own)  # row numbers hold only while the splits are read in the same way
    counts = rows.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("path", "split", (F.sum("n").over(Window.partitionBy("path").orderBy("split")) - F.col("n")).alias("before"))  # a row a split
    inside = rows.withColumn("i", F.row_number().over(Window.partitionBy("path", "split").orderBy("row", "k")))
    return inside.join(before, ["path", "split"]).select("path", (F.col("i") + F.col("before")).cast("int").alias("line_no"), "line")


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """path, line_no, line of whole texts; a break at the end of a text begins no further line."""
    rows = texts.select(F.col(key).alias("path"), F.posexplode(F.split(text, BREAKS, -1)).alias("p", "line"), F.size(F.split(text, BREAKS, -1)).alias("n"))
    return rows.where(~((F.col("p") == F.col("n") - 1) & (F.col("line") == "")) | (F.col("n") == 1)).select("path", (F.col("p") + 1).alias("line_no"), "line")


def _state(lines: DataFrame, labels: list[str]) -> DataFrame:
    """The lines that are not blank, with label (of the block), label_at, and role: label, header, data, stray."""
    solid = lines.where(F.col("line").isNotNull() & ~F.col("line").rlike(r"(?U)^\s*\z"))
    is_label = F.col("line").isin(labels)
    s = scan(solid, lasts={"open": F.when(is_label, F.struct(F.col("line").alias("label"), F.col("line_no").alias("at"))), "before": F.col("line_no")}, key="path", pos="line_no")
    role = F.when(is_label, "label").when(F.col("open").isNull(), "stray").when(F.col("before") == F.col("open.at"), "header").otherwise("data")
    return s.select("path", "line_no", "line", F.when(is_label, F.col("line")).otherwise(F.col("open.label")).alias("label"), F.col("open.label").alias("previous"), (F.col("before") == F.col("open.at")).alias("unheaded"), role.alias("role"))


def _problem(phase: int, code: str, message: Column, when: Column, ord_: Column | str = "line_no", sub: int = 0) -> Column:
    place = F.col(ord_) if isinstance(ord_, str) else ord_
    return F.when(when, F.struct(F.lit(phase).alias("phase"), place.cast("int").alias("ord"), F.lit(sub).alias("sub"), F.lit(code).alias("code"), message.alias("message")))


def _told(df: DataFrame, *problems: Column) -> DataFrame:
    return df.select(F.col("path").alias("doc_id"), F.explode(F.array_compact(F.array(*problems))).alias("p")).select("doc_id", "p.*")


def _at(*text: Column | str) -> Column:
    return F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), *[F.lit(t) if isinstance(t, str) else t for t in text])


def _scan_problems(state: DataFrame, paths: DataFrame, headers: dict[str, str]) -> DataFrame:
    header = F.create_map(*[F.lit(x) for p in headers.items() for x in p])
    want = F.try_element_at(header, F.col("label"))
    rows = _told(
        state,
        _problem(0, "no_header", _at("a ", quoted(F.col("previous")), " block has a label line but no header line before the next block starts"), (F.col("role") == "label") & F.coalesce("unheaded", F.lit(False))),
        _problem(0, "stray", _at("data line ", quoted(F.col("line")), " appears before any block label"), F.col("role") == "stray"),
        _problem(0, "header", _at("expected header ", quoted(want), " for a ", quoted(F.col("label")), " block, got ", quoted(F.col("line"))), (F.col("role") == "header") & (F.col("line") != want)),
    )
    ends = state.groupBy("path").agg(F.max_by(F.struct("role", "label"), "line_no").alias("end"), F.collect_set("label").alias("labels"))
    ends = paths.join(ends, "path", "left")
    missing = F.array_except(F.array(*[F.lit(x) for x in sorted(headers)]), F.coalesce("labels", F.array().cast("array<string>")))
    return rows.unionByName(_told(
        ends,
        _problem(1, "missing_block", F.concat(F.lit("file has no block(s): "), F.array_join(missing, ", ")), F.size(missing) > 0, F.lit(0)),
        _problem(2, "no_header", F.concat(F.lit("a "), quoted(F.col("end.label")), F.lit(" block has a label line but no header line -- the file ends too early")), F.col("end.role") == "label", F.lit(0)),
    ))


def passages(lines: DataFrame, delimiter: str = "|") -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of passage files given as lines (path, line_no, line).

    rows: path, line_no, urnbase, citation, text of the well-formed data lines; order by line_no. problems: doc_id (the
    path), phase, ord, sub, code, message. A header without rows is fine; blank lines do not count. Repeated blocks are
    allowed, each with its header.
    """
    state = _state(lines, [PASSAGES])
    told = _scan_problems(state, lines.select("path").distinct(), {PASSAGES: f"urn{delimiter}text"})
    data = state.where("role = 'data'").withColumn("f", F.split("line", F.concat(F.lit("\\Q"), F.lit(delimiter), F.lit("\\E")), -1)).withColumn("urn", F.when(F.size("f") == 2, F.col("f")[0])).withColumn("parts", F.split("urn", ":", -1))
    two, n = F.size("f") == 2, F.size("parts")
    row = _told(
        data,
        _problem(0, "columns", _at(quoted(F.lit(PASSAGES)), " row has ", F.size("f").cast("string"), f" column(s) (delimiter '{delimiter}'), expected 2: ", quoted(F.col("line"))), ~two, sub=1),
        _problem(0, "no_urn", _at(quoted(F.lit(PASSAGES)), " row has an empty urn column"), two & (F.col("urn") == ""), sub=2),
        _problem(0, "no_text", _at(quoted(F.lit(PASSAGES)), " row has an empty text column"), two & (F.col("urn") != "") & (F.col("f")[1] == ""), sub=3),
        _problem(0, "urn_parts", _at("urn ", quoted(F.col("urn")), " has ", n.cast("string"), " colon-separated part(s), expected 5"), two & (F.col("urn") != "") & (F.col("f")[1] != "") & (n != 5), sub=4),
        _problem(0, "no_citation", _at("urn ", quoted(F.col("urn")), " has an empty final (citation) part"), two & (F.col("f")[1] != "") & (n == 5) & (F.col("parts")[4] == ""), sub=5),
    )
    good = data.where(two & (F.col("urn") != "") & (F.col("f")[1] != "") & (n == 5) & (F.col("parts")[4] != ""))
    rows = good.select("path", "line_no", F.concat(F.array_join(F.slice("parts", 1, 4), ":"), F.lit(":")).alias("urnbase"), F.col("parts")[4].alias("citation"), F.col("f")[1].alias("text"))
    return rows, told.unionByName(row)


def analyses(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(graph, units, sentences, problems) of analysis files given as lines (path, line_no, line); doc_id is the path.

    graph: a token graph with context; units: doc_id, vu_pos, context, id, types; sentences: doc_id, sent_idx, first_id,
    last_id and their contexts. Blocks come in any order and may repeat, each with its header; all three must be there.
    An empty field is NULL. Problems come in phases: structure, tokens, units, sentences.
    """
    state = _state(lines, list(ANALYSIS))
    told = _scan_problems(state, lines.select("path").distinct(), ANALYSIS)
    data = state.where("role = 'data'").withColumn("f", F.split("line", r"\|", -1))
    width = {label: h.count("|") + 1 for label, h in ANALYSIS.items()}
    field = lambda label: [decode_field(F.get("f", F.lit(k))).alias(c) for k, c in enumerate(ANALYSIS[label].split("|"))]
    block = lambda label: data.where(F.col("label") == label)
    columns = lambda label, phase: _told(block(label), _problem(phase, "columns", _at(quoted(F.lit(label)), " row has ", F.size("f").cast("string"), f" column(s), expected {width[label]}"), F.size("f") != width[label]))
    whole = lambda label: block(label).where(F.size("f") == width[label]).select("path", "line_no", *field(label))
    tok, vu, sen = whole("#!tokens"), whole("#!verbal_units"), whole("#!sentences")
    first = tok.where("id is not null").groupBy("path", "id").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), F.min_by("context", "line_no").alias("own"))
    again = tok.join(first.where("n > 1").select("path", "id", F.col("line_no").alias("first_at")), ["path", "id"]).where(F.col("line_no") > F.col("first_at"))
    tokens_told = columns("#!tokens", 3).unionByName(_told(
        tok, _problem(3, "no_id", _at("a token row has an empty id"), F.col("id").isNull(), sub=1), _problem(3, "bad_value", _at("token ", quoted(F.col("id")), " has tokentype ", quoted(F.coalesce("tokentype", F.lit("")))), ~F.coalesce(F.col("tokentype").isin(TOKENTYPES), F.lit(False)), sub=3)
    )).unionByName(_told(again, _problem(3, "duplicate_id", _at("token id ", quoted(F.col("id")), " stands more than once"), F.lit(True), sub=2)))
    names = first.select("path", F.col("id").alias("token"), F.struct(F.col("own").alias("context"), F.col("line_no").alias("at")).alias("hit"))
    v = vu.join(names, ["path", "token"], "left")
    units_told = columns("#!verbal_units", 4).unionByName(_told(
        v,
        _problem(4, "no_id", _at("a verbal unit row has an empty token"), F.col("token").isNull(), sub=1), _problem(4, "unknown_id", _at("verbal unit ", quoted(F.col("token")), " is no token"), F.col("token").isNotNull() & F.col("hit").isNull(), sub=2),
        _problem(4, "context", _at("verbal unit ", quoted(F.col("token")), " declares another context than its token"), F.col("hit").isNotNull() & ~F.col("context").eqNullSafe(F.col("hit.context")), sub=3),
        _problem(4, "bad_value", _at("verbal unit ", quoted(F.coalesce("token", F.lit(""))), " has a type outside the vocabulary"), ~(F.coalesce(F.col("syntactic_type").isin(SYNTACTIC), F.lit(False)) & F.coalesce(F.col("semantic_type").isin(SEMANTIC), F.lit(False))), sub=4),
    ))
    s = sen
    for end in ("first", "last"):
        s = s.join(names.select("path", F.col("token").alias(f"{end}_token"), F.col("hit").alias(end)), ["path", f"{end}_token"], "left")
    both = F.col("first").isNotNull() & F.col("last").isNotNull()
    sentences_told = columns("#!sentences", 5).unionByName(_told(
        s,
        _problem(5, "no_id", _at("a sentence row has an empty boundary token"), F.col("first_token").isNull() | F.col("last_token").isNull(), sub=1),
        _problem(5, "unknown_id", _at("a sentence boundary is no token"), (F.col("first_token").isNotNull() & F.col("first").isNull()) | (F.col("last_token").isNotNull() & F.col("last").isNull()), sub=2),
        _problem(5, "order", _at("a sentence ends before it begins"), both & (F.col("first.at") > F.col("last.at")), sub=3),
        _problem(5, "context", _at("a sentence declares another context than its boundary tokens"), both & ~(F.col("context_begin").eqNullSafe(F.col("first.context")) & F.col("context_end").eqNullSafe(F.col("last.context"))), sub=4),
    ))
    rank = lambda df, name: scan(df.withColumn("_one", F.lit(1)), sums={"_k": F.col("_one")}, key="path", pos="line_no").withColumn(name, (F.col("_k") - 1).cast("int")).drop("_k", "_one", "line_no").withColumnRenamed("path", "doc_id")
    graph = rank(tok, "pos")
    units = rank(vu, "vu_pos").withColumnRenamed("token", "id")
    sentences = rank(sen, "sent_idx").withColumnRenamed("first_token", "first_id").withColumnRenamed("last_token", "last_id")
    return graph, units, sentences, told.unionByName(tokens_told).unionByName(units_told).unionByName(sentences_told)


def reconstructed(graph: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, tokens: the token lists of saved sentences, from the rows between their boundary tokens without implied ones.

    graph: doc_id, pos, id, tokentype, text, context; sentences: doc_id, sent_idx, first_id, last_id. A sentence of which a
    boundary is not in the graph, or the last comes before the first, has no row; one of implied tokens only an empty list.
    """
    at = graph.select("doc_id", "id", "pos")
    spans = sentences
    for end, name in (("first", "start_pos"), ("last", "end_pos")):
        spans = spans.join(at.select("doc_id", F.col("id").alias(f"{end}_id"), F.col("pos").alias(name)), ["doc_id", f"{end}_id"])
    token = F.when(~F.col("tokentype").isin(IMPLIED), F.struct("pos", "id", "text", F.col("context").alias("citation")))
    lists = in_spans(graph, spans).groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(token)).alias("t"))
    return lists.select("doc_id", "sent_idx", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["citation"].alias("citation"))).alias("tokens"))


def read_passages(spark: SparkSession, path: str | list[str], delimiter: str = "|", strict: bool = True) -> DataFrame:
    """Passage files as rows; strict raises ValueError at the first problem, else the good rows come out."""
    rows, told = passages(read_lines(spark, path), delimiter)
    if strict:
        raise_first(told)
    return rows


def read_analyses(spark: SparkSession, path: str | list[str], strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analysis files as (graph, units, sentences); strict raises ValueError at the first problem."""
    graph, units, sentences, told = analyses(read_lines(spark, path))
    if strict:
        raise_first(told)
    return graph, units, sentences
