"""Readable text, coloured HTML, depth-indented blocks and diagrams from token graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinculum.functions.scan import HTML, LABEL, join_in_order, replaced, scan
from vinculum.schemas import IMPLIED, IMPLIED_COLOUR, PALETTE, ROOT

# What joins how.
OPENING, CLOSING, QUOTE_MARKS = ["(", "[", "{"], [")", "]", "}"], ['"', "'"]
IMPLIED_LABELS = {"implied sum": "elided sum", "continued discourse": "continued discourse"}
CO = "coordinating conjunction"
# Between and after the divisions of a document; bytes of a text that goes out by itself.
_BETWEEN, _END, _LONG = "</div>\n", b"</div>", 1 << 20


def join_classes(graph: DataFrame, within: str | None = None) -> DataFrame:
    """Surface tokens with join_class (left, right, enclitic, normal) and sep, what goes before each.

    Implied tokens are left out. Straight quotes alternate between right and left, counted for each mark over the
    document, or over each value of `within` (a column that does not decrease along the document).
    """
    real = graph.where(~F.col("tokentype").isin(IMPLIED))
    mark = F.col("tokentype") == "punctuation"
    one = lambda q: (mark & (F.col("text") == q)).cast("int")
    if within is None:
        counted = scan(real, sums={"_q0": one(QUOTE_MARKS[0]), "_q1": one(QUOTE_MARKS[1])})
    else:
        counted = scan(real.withColumn("_grp", F.struct("doc_id", within)), sums={"_q0": one(QUOTE_MARKS[0]), "_q1": one(QUOTE_MARKS[1])}, key="_grp").drop("_grp")
    odd = F.when(F.col("text") == QUOTE_MARKS[0], F.col("_q0")).otherwise(F.col("_q1")) % 2 == 1
    right = F.col("text").isin(OPENING) | (F.col("text").isin(QUOTE_MARKS) & odd)
    kind = F.when(F.col("tokentype") == "enclitic", "enclitic").when(mark, F.when(right, "right").otherwise("left")).otherwise("normal")
    classed = counted.withColumn("join_class", kind).drop("_q0", "_q1")
    if within is None:
        before = scan(classed, lasts={"_before": F.col("join_class")})
    else:
        before = scan(classed.withColumn("_grp", F.struct("doc_id", within)), lasts={"_before": F.col("join_class")}, key="_grp").drop("_grp")
    tight = F.col("_before").isNull() | F.col("join_class").isin("left", "enclitic") | ((F.col("join_class") == "normal") & (F.col("_before") == "right"))
    return before.withColumn("sep", F.when(tight, "").otherwise(" ")).drop("_before")


def surface_text(graph: DataFrame) -> DataFrame:
    """doc_id, surface: one text a document; tokens without text count as empty. Documents with implied tokens only have no row."""
    return join_classes(graph).groupBy("doc_id").agg(join_in_order(F.concat("sep", F.coalesce("text", F.lit(""))), "pos", "").alias("surface"))


def plain_text(tokens: DataFrame, by: list[str]) -> DataFrame:
    """`by`, plain: tokens joined by single spaces in order of pos."""
    return tokens.groupBy(*by).agg(join_in_order(F.coalesce("text", F.lit("")), "pos", " ").alias("plain"))


def _span(resolved: DataFrame, colours: DataFrame) -> DataFrame:
    """Adds html: the escaped text, in a coloured span where the token is eligible and its unit has a colour."""
    lit = resolved.join(colours.select("doc_id", "unit_id", "fill", "ink"), ["doc_id", "unit_id"], "left")
    chosen = F.col("tokentype").isin("lexical", "praenomen", "numeral") | F.coalesce(F.col("relationship1") == CO, F.lit(False)) | F.coalesce(F.col("relationship2") == CO, F.lit(False))
    text = replaced(F.coalesce("text", F.lit("")), HTML)
    span = F.concat(F.lit('<span style="background-color: '), F.col("fill"), F.lit("; color: "), F.col("ink"), F.lit(';">'), text, F.lit("</span>"))
    return lit.withColumn("html", F.when(chosen & F.col("fill").isNotNull(), span).otherwise(text))


def html_text(resolved: DataFrame, colours: DataFrame) -> DataFrame:
    """doc_id, html: the surface text with the tokens of each verbal unit in its colour."""
    return join_classes(_span(resolved, colours)).groupBy("doc_id").agg(join_in_order(F.concat("sep", "html"), "pos", "").alias("html"))


def depth_blocks(resolved: DataFrame) -> DataFrame:
    """The rows with block and block_unit: a new block where a token has another unit than the open block's.

    Enclitics and tokens without a unit stay in the open block; block 0 holds what comes before the first unit.
    """
    has = F.when(F.col("tokentype") != "enclitic", F.col("unit_id"))
    seen = scan(resolved, lasts={"_open": has})
    starts = has.isNotNull() & (F.col("_open").isNull() | (F.col("_open") != has))
    return scan(seen.withColumn("_start", starts.cast("int")), sums={"block": F.col("_start")}).withColumn("block_unit", F.coalesce(has, F.col("_open"))).drop("_open", "_start")


def _float(x: Column) -> Column:
    return x.cast("double").cast("string")


def _unit_columns(resolved: DataFrame, colours: DataFrame | None) -> DataFrame:
    """Adds fill and ink, and d, the depth of the token's unit (0 where it has none), without a join to the rows' own units."""
    unit = Window.partitionBy("doc_id", "unit_id")
    rows = resolved.withColumn("d", F.coalesce(F.when(F.col("unit_id").isNotNull(), F.max(F.when(F.col("is_anchor"), F.col("depth"))).over(unit)), F.lit(0)))
    if colours is not None:
        return rows.join(colours.select("doc_id", "unit_id", "fill", "ink"), ["doc_id", "unit_id"], "left")
    seen = F.col("unit_id").isNotNull() & F.coalesce(F.col("tokentype") != "punctuation", F.lit(False))
    rows = rows.withColumns({"_seen": F.max(seen).over(unit), "_first": F.min(F.when(seen, F.col("pos"))).over(unit)})
    slot = (F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("_seen"), F.asc("_first"), F.asc("unit_id"))) - 1) % len(PALETTE)
    pick = lambda k: F.when(F.col("_seen"), F.element_at(F.array(*[F.lit(c[k]) for c in PALETTE]), slot + 1))
    return rows.withColumns({"fill": pick(0), "ink": pick(2)}).drop("_seen", "_first")


def _texts(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[str, int, bytearray]]:
    """(doc, part, text) of rows (doc_id, piece) that lie in order: a document's pieces one after another, in parts of about `most` bytes.

    The pieces of a batch lie one after another already, so they are copied as they are.
    """
    doc, part, text = None, 0, bytearray()
    for batch in batches:
        docs, pieces = batch.columns
        if not len(docs):
            continue
        _, ends, data = pieces.buffers()
        at, data = np.frombuffer(ends, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].tolist(), memoryview(data or b"")
        firsts = [0, *(np.flatnonzero(pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(docs)]
        for a, b in zip(firsts, firsts[1:]):
            if (now := docs[a].as_py()) != doc:
                if doc is not None:
                    yield doc, part, text
                doc, part, text = now, 0, bytearray()
            text += data[at[a] : at[b]]
            if most is not None and len(text) >= most:
                yield doc, part, text
                part, text = part + 1, bytearray()
    if doc is not None:
        yield doc, part, text


def _as_batches(texts: Iterator[tuple[str, int, bytearray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of doc, part (where it is named) and text; a long text goes out by itself, uncopied."""

    def told() -> pa.RecordBatch:
        docs, parts, values = zip(*rows)
        ends = pa.py_buffer(np.cumsum([0, *map(len, values)]).astype(np.int32))
        text = pa.StringArray.from_buffers(len(values), ends, pa.py_buffer(values[0] if len(values) == 1 else b"".join(values)))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *[pa.array(parts, pa.int32())] * (len(names) == 3), text], names)

    rows, size = [], 0
    for row in texts:
        if rows and size + len(row[2]) > _LONG:
            yield told()
            rows, size = [], 0
        rows.append(row)
        size += len(row[2])
    if rows:
        yield told()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _as_batches(_texts(batches, _LONG), ["doc_id", "part", "text"])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the first `_BETWEEN` of a document, and with its last end."""

    def trimmed() -> Iterator[tuple[str, int, bytearray]]:
        for doc, part, text in _texts(batches):
            del text[: len(_BETWEEN)]
            text += _END
            yield doc, part, text

    yield from _as_batches(trimmed(), ["doc_id", "html"])


def depth_html(resolved: DataFrame, colours: DataFrame | None = None, indent: float = 2.0, cap: int | None = None) -> DataFrame:
    """doc_id, html: blocks as indented divisions, those deeper than `cap` left out. ValueError for a negative cap.

    colours: as `unit_colours` gives them, which is what None stands for. A document of which no block is left has no row.
    As a document's text is one value, made in one task, everything before it is running values over the document there:
    `resolved` is read once and moved once, however often its rows are looked at (`depth_blocks` and `join_classes` say
    the same by chunks, each reading its input twice). Texts are put together by streams: an aggregate would hold a long one
    some ten times over (list, its serialised form, the merged list, text, row); and in a stage of their own, without
    the memory of the sorts before.
    """
    if cap is not None and cap < 0:
        raise ValueError(f"depth must be >= 0 (root clauses only), got {cap!r}")
    need = ["doc_id", "pos", "tokentype", "text", "unit_id", "is_anchor", "depth"]
    chosen = F.col("tokentype").isin("lexical", "praenomen", "numeral") | F.coalesce(F.col("relationship1") == CO, F.lit(False)) | F.coalesce(F.col("relationship2") == CO, F.lit(False))
    rows = _unit_columns(resolved.select(*need, chosen.alias("_chosen")).repartition("doc_id"), colours)
    place = Window.partitionBy("doc_id").orderBy("pos")
    to_here, before = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_has", F.when((F.col("tokentype") != "enclitic") & F.col("unit_id").isNotNull(), F.struct("unit_id", "d")))
    rows = rows.withColumn("_open", F.last("_has", ignorenulls=True).over(before))
    starts = F.col("_has").isNotNull() & (F.col("_open").isNull() | (F.col("_open.unit_id") != F.col("_has.unit_id")))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(to_here)).withColumn("d", F.coalesce("_has.d", "_open.d", F.lit(0))).drop("_has", "_open")
    if cap is not None:
        rows = rows.where(F.col("d") <= cap)

    part = Window.partitionBy("doc_id", "block").orderBy("pos")
    to_here, before = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(Window.unboundedPreceding, -1)
    real, mark = F.coalesce(~F.col("tokentype").isin(IMPLIED), F.lit(False)), F.col("tokentype") == "punctuation"
    odd = {q: F.sum(F.when(mark & (F.col("text") == q), 1).otherwise(0)).over(to_here) % 2 == 1 for q in QUOTE_MARKS}
    right = F.col("text").isin(OPENING) | ((F.col("text") == QUOTE_MARKS[0]) & odd[QUOTE_MARKS[0]]) | ((F.col("text") == QUOTE_MARKS[1]) & odd[QUOTE_MARKS[1]])
    kind = F.when(F.col("tokentype") == "enclitic", "enclitic").when(mark, F.when(right, "right").otherwise("left")).otherwise("normal")
    rows = rows.withColumn("_kind", F.when(real, kind))
    rows = rows.withColumn("_before", F.last("_kind", ignorenulls=True).over(before))
    tight = F.col("_before").isNull() | F.col("_kind").isin("left", "enclitic") | ((F.col("_kind") == "normal") & (F.col("_before") == "right"))
    text = replaced(F.coalesce("text", F.lit("")), HTML)
    span = F.concat(F.lit('<span style="background-color: '), F.col("fill"), F.lit("; color: "), F.col("ink"), F.lit(';">'), text, F.lit("</span>"))
    shown = F.concat(F.when(tight, "").otherwise(" "), F.when(F.col("_chosen") & F.col("fill").isNotNull(), span).otherwise(text))
    margin = _float(F.col("d") * F.lit(indent)) if isinstance(indent, float) else (F.col("d") * F.lit(indent)).cast("string")
    head = F.concat(F.lit(_BETWEEN + '<div style="margin-left: '), margin, F.lit('em; margin-bottom: 0.35em;">'))
    piece = F.concat(F.when(F.row_number().over(part) == 1, head).otherwise(""), F.when(F.col("_kind").isNotNull(), shown).otherwise(""))
    pieces = rows.select("doc_id", "block", "pos", piece.alias("piece")).sortWithinPartitions("doc_id", "block", "pos").select("doc_id", "piece")
    parts = pieces.mapInArrow(_parts, "doc_id string, part int, text string").repartition("doc_id").sortWithinPartitions("doc_id", "part")
    return parts.select("doc_id", "text").mapInArrow(_wholes, "doc_id string, html string")


def mermaid_edges(graph: DataFrame) -> DataFrame:
    """doc_id, pos, slot, src, label, dst, drawn for every edge that is not to the root and does not start at punctuation."""
    from vinculum.operators.graph import edges

    nodes = graph.where(F.col("tokentype") != "punctuation").select("doc_id", "id")
    drawn = edges(graph).where(F.col("dst") != ROOT).join(nodes.withColumnRenamed("id", "src"), ["doc_id", "src"], "left_semi")
    return drawn.join(nodes.select("doc_id", F.col("id").alias("dst"), F.lit(True).alias("there")), ["doc_id", "dst"], "left").select("doc_id", "pos", "slot", "src", "label", "dst", F.coalesce("there", F.lit(False)).alias("drawn"))


def mermaid_warnings(graph: DataFrame) -> DataFrame:
    """doc_id, pos, slot, message for edges left out of the diagram."""
    text = F.concat(F.lit("skipped edge "), F.col("src"), F.lit(" -["), F.col("label"), F.lit("]-> "), F.col("dst"), F.lit(": target is punctuation or not in tokengraph"))
    return mermaid_edges(graph).where("not drawn").select("doc_id", "pos", "slot", text.alias("message"))


def mermaid_lines(resolved: DataFrame, colours: DataFrame, orientation: str = "BT", coloured: bool = True) -> DataFrame:
    """doc_id, section, ord, sub, line: the lines of the diagram; in order of these they are the diagram's text."""
    pad = F.lit("    ")
    nodes = resolved.where(F.col("tokentype") != "punctuation")
    head = resolved.select("doc_id").distinct().select("doc_id", F.lit(0).alias("section"), F.lit(0).alias("ord"), F.lit(0).alias("sub"), F.lit(f"graph {orientation}").alias("line"))
    implied = F.create_map(*[F.lit(x) for p in IMPLIED_LABELS.items() for x in p])
    label = F.coalesce("text", F.try_element_at(implied, F.col("tokentype")), "tokentype")
    node = nodes.select("doc_id", F.lit(1), F.col("pos"), F.lit(0), F.concat(pad, "id", F.lit('["'), replaced(label, LABEL), F.lit('"]')))
    edge = mermaid_edges(resolved).where("drawn").select("doc_id", F.lit(2), F.col("pos"), F.col("slot"), F.concat(pad, "src", F.lit(" -->|"), replaced(F.col("label"), LABEL), F.lit("| "), "dst"))
    lines = head.union(node).union(edge)
    if not coloured:
        return lines
    is_implied = F.col("tokentype").isin(IMPLIED)
    style = lambda f, s, t: F.concat(F.lit(" fill:"), f, F.lit(",stroke:"), s, F.lit(",color:"), t, F.lit(";"))
    blank = colours.select("doc_id").unionByName(nodes.where(is_implied).select("doc_id")).distinct().select("doc_id", F.lit(3), F.lit(0), F.lit(0), F.lit(""))
    defs = colours.select("doc_id", F.lit(4), F.col("rank"), F.lit(0), F.concat(pad, F.lit("classDef vu"), F.col("rank").cast("string"), style(F.col("fill"), F.col("stroke"), F.col("ink"))))
    members = nodes.where(~is_implied & F.col("unit_id").isNotNull()).groupBy("doc_id", "unit_id").agg(join_in_order(F.col("id"), "pos", ",").alias("ids"))
    uses = members.join(colours, ["doc_id", "unit_id"]).select("doc_id", F.lit(5), F.col("rank"), F.lit(0), F.concat(pad, F.lit("class "), "ids", F.lit(" vu"), F.col("rank").cast("string"), F.lit(";")))
    amber = nodes.where(is_implied).groupBy("doc_id").agg(join_in_order(F.col("id"), "pos", ",").alias("ids"))
    caution = amber.select("doc_id", F.lit(6), F.lit(0), F.lit(0), F.concat(pad, F.lit("classDef implied"), style(*[F.lit(c) for c in IMPLIED_COLOUR])))
    marked = amber.select("doc_id", F.lit(7), F.lit(0), F.lit(0), F.concat(pad, F.lit("class "), "ids", F.lit(" implied;")))
    return lines.union(blank).union(defs).union(uses).union(caution).union(marked)


def mermaid(resolved: DataFrame, colours: DataFrame, orientation: str = "BT", coloured: bool = True) -> DataFrame:
    """doc_id, diagram."""
    return mermaid_lines(resolved, colours, orientation, coloured).groupBy("doc_id").agg(join_in_order(F.col("line"), F.struct("section", "ord", "sub"), "\n").alias("diagram"))


def console_dump(tokens: DataFrame, units: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, section, ord, line: the dump of an analysis: its tokens, its verbal expressions and its graph, in order of these."""
    docs = tokens.select("doc_id").union(units.select("doc_id")).union(graph.select("doc_id")).distinct()
    heads = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("ord"), F.lit(x).alias("line")) for s, k, x in ((0, 0, "Tokens:"), (2, 0, ""), (2, 1, "Verbal expressions:"), (4, 0, ""), (4, 1, "Token graph:"))])
    wide = F.when(F.length("id") < 4, F.lpad("id", 4, " ")).otherwise(F.col("id"))
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    given = tokens.select("doc_id", F.lit(1).alias("section"), F.col("pos").alias("ord"), F.concat(F.lit("  "), wide, F.lit("  "), none("text")).alias("line"))
    told = units.select("doc_id", F.lit(3), F.col("vu_pos"), F.concat(F.lit("  id="), none("id"), F.lit("  syntactic_type="), none("syntactic_type"), F.lit("  semantic_type="), none("semantic_type")))
    return docs.select("doc_id", F.explode(heads).alias("h")).select("doc_id", "h.*").union(given).union(told).union(console_lines(graph).select("doc_id", F.lit(5), "pos", "line"))


def console_lines(graph: DataFrame) -> DataFrame:
    """doc_id, pos, line: a token with its relations and unit, as a console dump prints it."""
    rel = lambda k: F.when(F.col(f"relationship{k}") != "", F.concat(F.col(f"relationship{k}"), F.lit(" -> "), F.coalesce(f"related{k}", F.lit("None"))))
    rels = F.array_join(F.array_compact(F.array(rel(1), rel(2))), "; ")
    unit = F.when(F.col("verbalunit") != "", F.concat(F.lit(" [verbal unit "), F.col("verbalunit"), F.lit("]"))).otherwise("")
    pad = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    shown = F.coalesce("text", F.concat(F.lit("("), "tokentype", F.lit(")")))
    lemma = F.when(F.length("lemma") > 0, F.col("lemma")).otherwise("-")
    return graph.select("doc_id", "pos", F.concat(
        F.lit("  "), F.when(F.length("id") < 4, F.lpad("id", 4, " ")).otherwise(F.col("id")), F.lit("  "), pad(shown, 15), F.lit(" type="), pad(F.col("tokentype"), 11), F.lit(" lemma="), pad(lemma, 15), F.lit(" "),
        F.when(rels == "", "-").otherwise(rels), unit,
    ).alias("line"))
