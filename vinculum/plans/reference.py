"""Queries over the analysis tables, one or more for each operator of the inventory, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.functions import text as X
from vinculum.operators import budget as B
from vinculum.operators import checks as C
from vinculum.operators import graph as G
from vinculum.operators import leaderboard as L
from vinculum.operators import metric as M
from vinculum.operators import render as R
from vinculum.operators import segment as S
from vinculum.runtime import cut, table
from vinculum.schemas import IMPLIED_COLOUR, PALETTE, RELATIONS, SEMANTIC, SYNTACTIC, TOKENTYPES
from vinculum.sources import blocks, sinks
from vinculum.sources.gold import gold_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name."""

    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- inputs, the same in Spark and SQL: first deliveries of each record ---


def graph(spark: SparkSession, d: str) -> DataFrame:
    return G.latest(table(spark, d, "tokengraph"))


def units(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, vu_pos, id, syntactic_type, semantic_type, context; first delivery of each place."""
    f = ["token", "syntactic_type", "semantic_type", "context"]
    return table(spark, d, "verbal_units").groupBy("doc_id", "vu_pos").agg(F.min_by(F.struct(*f), "loaded_at").alias("v")).select("doc_id", "vu_pos", F.col("v.token").alias("id"), "v.syntactic_type", "v.semantic_type", "v.context")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    f = ["sent_idx", "pos", "text", "citation"]
    return table(spark, d, "tokens").groupBy("doc_id", "id").agg(F.min_by(F.struct(*f), "loaded_at").alias("v")).select("doc_id", "id", "v.*")


def prediction(g: DataFrame) -> DataFrame:
    """A made prediction: every eleventh token is lost, labels, lemmas and units are changed at fixed places."""
    p = g.where(F.col("pos") % 11 != 7)
    wrong = lambda c, k, v: F.when(F.col("pos") % k == 3, v).otherwise(F.col(c))
    return p.withColumn("relationship1", wrong("relationship1", 5, F.lit("adverbial"))).withColumn("lemma", wrong("lemma", 7, F.lower("text"))).withColumn("verbalunit", wrong("verbalunit", 13, F.lit(None).cast("string")))


def predicted_units(u: DataFrame) -> DataFrame:
    return u.where(F.col("vu_pos") % 9 != 4).withColumn("semantic_type", F.when(F.col("vu_pos") % 4 == 1, "intransitive").otherwise(F.col("semantic_type")))


_G = """g AS (SELECT doc_id, id, v.pos AS pos, v.context AS context, v.tokentype AS tokentype, v.text AS text, v.lemma AS lemma, v.verbalunit AS verbalunit, v.related1 AS related1, v.relationship1 AS relationship1, v.related2 AS related2, v.relationship2 AS relationship2
  FROM (SELECT doc_id, id, arg_min(struct_pack(pos := pos, context := context, tokentype := tokentype, text := text, lemma := lemma, verbalunit := verbalunit, related1 := related1, relationship1 := relationship1, related2 := related2, relationship2 := relationship2), loaded_at) AS v FROM tokengraph GROUP BY doc_id, id))"""
_U = """u AS (SELECT doc_id, vu_pos, v.token AS id, v.syntactic_type AS syntactic_type, v.semantic_type AS semantic_type, v.context AS context FROM (SELECT doc_id, vu_pos, arg_min(struct_pack(token := token, syntactic_type := syntactic_type, semantic_type := semantic_type, context := context), loaded_at) AS v FROM verbal_units GROUP BY doc_id, vu_pos))"""
_T = """t AS (SELECT doc_id, id, v.sent_idx AS sent_idx, v.pos AS pos, v.text AS text, v.citation AS citation FROM (SELECT doc_id, id, arg_min(struct_pack(sent_idx := sent_idx, pos := pos, text := text, citation := citation), loaded_at) AS v FROM tokens GROUP BY doc_id, id))"""
_E = """e AS (SELECT doc_id, pos, id AS src, 1 AS slot, relationship1 AS label, related1 AS dst FROM g WHERE relationship1 IS NOT NULL AND related1 IS NOT NULL
  UNION ALL SELECT doc_id, pos, id, 2, relationship2, related2 FROM g WHERE relationship2 IS NOT NULL AND related2 IS NOT NULL)"""
_IMPLIED = "('implied sum', 'continued discourse')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_VOCAB = "vocab(field, value) AS (VALUES " + _values([(f, v) for f, vs in (("relationship", RELATIONS), ("tokentype", TOKENTYPES), ("syntactic_type", SYNTACTIC), ("semantic_type", SEMANTIC)) for v in vs]) + ")"
_USED = """used AS (SELECT 'relationship' AS field, label AS value FROM e UNION ALL SELECT 'tokentype', tokentype FROM g)"""


@query(f"WITH {_G}, {_E} SELECT DISTINCT doc_id, src, label, dst FROM e")
def edge_triples(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_triples(graph(spark, d))


@query(f"WITH {_G}, {_E} SELECT label, slot, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY label, slot")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(graph(spark, d)).groupBy("label", "slot").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH {_G}, {_E}, {_U}, {_VOCAB}, {_USED}, every AS (SELECT * FROM used UNION ALL SELECT 'syntactic_type', syntactic_type FROM u UNION ALL SELECT 'semantic_type', semantic_type FROM u) SELECT v.field, v.value, count(s.value) AS seen FROM vocab v LEFT JOIN every s ON s.field = v.field AND s.value = v.value GROUP BY v.field, v.value")
def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    return G.vocabulary_coverage(graph(spark, d), units(spark, d))


@query(f"WITH {_G}, {_E}, {_VOCAB}, {_USED} SELECT field, value, count(*) AS n FROM used WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.field = used.field AND v.value = used.value) GROUP BY field, value")
def unknown_values(spark: SparkSession, d: str) -> DataFrame:
    return G.unknown_values(graph(spark, d))


@query(f"WITH {_G}, {_E} SELECT doc_id, dst AS id, arg_max(src, pos * 2 + slot) AS source FROM e WHERE label = 'unit verb' AND dst <> 'root' GROUP BY doc_id, dst")
def reverse_unit_verbs(spark: SparkSession, d: str) -> DataFrame:
    return G.reverse_links(graph(spark, d), "unit verb")


# unit resolution: the least path by candidate order that reaches a token with a unit of its own
_CAND = f"""verbs AS (SELECT doc_id, dst AS id, arg_max(src, pos * 2 + slot) AS source FROM e WHERE label = 'unit verb' AND dst <> 'root' GROUP BY doc_id, dst),
parts AS (SELECT doc_id, dst AS id, arg_max(src, pos * 2 + slot) AS source FROM e WHERE label = 'circumstantial participle' AND dst <> 'root' GROUP BY doc_id, dst),
cand AS (SELECT c.* FROM (SELECT g.doc_id, g.id, 1 AS prio, v.source AS target FROM g JOIN verbs v ON v.doc_id = g.doc_id AND v.id = g.id
  UNION ALL SELECT g.doc_id, g.id, 2, p.source FROM g JOIN parts p ON p.doc_id = g.doc_id AND p.id = g.id WHERE g.relationship1 = 'ablative absolute' OR g.relationship2 = 'ablative absolute'
  UNION ALL SELECT doc_id, id, 3, related1 FROM g WHERE related1 IS NOT NULL UNION ALL SELECT doc_id, id, 4, related2 FROM g WHERE related2 IS NOT NULL) c JOIN g h ON h.doc_id = c.doc_id AND h.id = c.target),
walk AS (SELECT doc_id, id AS start, id AS at, '' AS path, '|' || id || '|' AS seen FROM g UNION ALL
  SELECT w.doc_id, w.start, c.target, w.path || c.prio, w.seen || c.target || '|' FROM walk w JOIN g ON g.doc_id = w.doc_id AND g.id = w.at AND g.verbalunit IS NULL
  JOIN cand c ON c.doc_id = w.doc_id AND c.id = w.at WHERE NOT contains(w.seen, '|' || c.target || '|')),
ua AS (SELECT g.doc_id, g.id, x.unit_id FROM g LEFT JOIN (SELECT w.doc_id, w.start, arg_min(h.verbalunit, w.path) AS unit_id FROM walk w JOIN g h ON h.doc_id = w.doc_id AND h.id = w.at AND h.verbalunit IS NOT NULL GROUP BY w.doc_id, w.start) x ON x.doc_id = g.doc_id AND x.start = g.id)"""
_GR1 = f"WITH RECURSIVE {_G}, {_E}, {_CAND}"
_RES = _GR1 + ", r AS (SELECT g.*, ua.unit_id FROM g JOIN ua ON ua.doc_id = g.doc_id AND ua.id = g.id)"
_COL = _RES + ", cf AS (SELECT doc_id, unit_id, min(pos) AS first FROM r WHERE unit_id IS NOT NULL AND tokentype <> 'punctuation' GROUP BY doc_id, unit_id), col AS (SELECT doc_id, unit_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, unit_id) - 1 AS rank FROM cf)"
_PAL = "pal(slot, fill, stroke, ink) AS (VALUES " + _values([(k, *c) for k, c in enumerate(PALETTE)]) + ")"


@query(_GR1 + " SELECT doc_id, id, unit_id FROM ua")
def verbal_unit_assignment(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve(graph(spark, d)).select("doc_id", "id", "unit_id")


@query(_RES + " SELECT doc_id, unit_id, count(*) AS tokens, count(*) FILTER (WHERE tokentype = 'lexical') AS lexical FROM r WHERE unit_id IS NOT NULL GROUP BY doc_id, unit_id")
def verbal_unit_sizes(spark: SparkSession, d: str) -> DataFrame:
    return G.unit_sizes(G.resolve(graph(spark, d)))


# depth: the first anchor reached from related1, else from related2; then the chain of anchors up to a root
_DEEP = """anchors AS (SELECT * FROM g WHERE verbalunit = id),
step AS (SELECT s.doc_id, s.id, s.prio, s.target FROM (SELECT doc_id, id, 1 AS prio, related1 AS target FROM g WHERE related1 IS NOT NULL UNION ALL SELECT doc_id, id, 2, related2 FROM g WHERE related2 IS NOT NULL) s JOIN g h ON h.doc_id = s.doc_id AND h.id = s.target),
chase AS (SELECT s.doc_id, s.id AS start, s.prio AS slot, s.target AS at, '' AS path, '|' || s.target || '|' AS seen FROM step s JOIN anchors a ON a.doc_id = s.doc_id AND a.id = s.id WHERE a.related1 IS DISTINCT FROM 'root'
  UNION ALL SELECT c.doc_id, c.start, c.slot, s.target, c.path || s.prio, c.seen || s.target || '|' FROM chase c JOIN g ON g.doc_id = c.doc_id AND g.id = c.at AND g.verbalunit IS DISTINCT FROM g.id JOIN step s ON s.doc_id = c.doc_id AND s.id = c.at WHERE NOT contains(c.seen, '|' || s.target || '|')),
hit AS (SELECT c.doc_id, c.start, c.slot, arg_min(c.at, c.path) AS parent FROM chase c JOIN anchors a ON a.doc_id = c.doc_id AND a.id = c.at GROUP BY c.doc_id, c.start, c.slot),
up AS (SELECT doc_id, start AS id, arg_min(parent, slot) AS parent FROM hit WHERE parent <> start GROUP BY doc_id, start),
down AS (SELECT doc_id, id, 0 AS depth FROM anchors WHERE related1 = 'root' UNION ALL SELECT u.doc_id, u.id, w.depth + 1 FROM down w JOIN up u ON u.doc_id = w.doc_id AND u.parent = w.id)"""
_GR2 = f"WITH RECURSIVE {_G}, {_DEEP}"
# the anchors that lead into one loop of governors: the walk of the first in list order tells where it comes round
_ROUND = """, rw AS (SELECT doc_id, id AS start, id AS at, '|' || id || '|' AS seen, FALSE AS hit FROM anchors UNION ALL
  SELECT rw.doc_id, rw.start, u.parent, rw.seen || u.parent || '|', contains(rw.seen, '|' || u.parent || '|') FROM rw JOIN up u ON u.doc_id = rw.doc_id AND u.id = rw.at WHERE NOT rw.hit),
entry AS (SELECT rw.doc_id, rw.start, rw.at AS entry FROM rw WHERE rw.hit), comp AS (SELECT rw.doc_id, rw.start, min(c.start) AS comp FROM rw JOIN entry c ON c.doc_id = rw.doc_id AND c.start = rw.at AND c.entry = c.start GROUP BY rw.doc_id, rw.start),
firsts AS (SELECT comp.doc_id, comp.comp, arg_min(comp.start, a.pos) AS start FROM comp JOIN anchors a ON a.doc_id = comp.doc_id AND a.id = comp.start GROUP BY comp.doc_id, comp.comp),
cycles AS (SELECT e.doc_id, e.entry AS anchor, 'cycle' AS code, 'cycle detected resolving the governing verbal expression for ''' || e.entry || ''' -- leaving its depth (and its parent''s) unresolved' AS message FROM firsts f JOIN entry e ON e.doc_id = f.doc_id AND e.start = f.start),
warned AS (SELECT * FROM cycles UNION ALL SELECT a.doc_id, a.id, 'no_governor', 'could not find a governing verbal expression for ''' || a.id || ''' -- leaving its depth unresolved' FROM anchors a LEFT JOIN up ON up.doc_id = a.doc_id AND up.id = a.id WHERE up.parent IS NULL AND a.related1 IS DISTINCT FROM 'root')"""


@query(_GR2 + " SELECT a.doc_id, a.id AS anchor, up.parent, coalesce(down.depth, -1) AS depth FROM anchors a LEFT JOIN up ON up.doc_id = a.doc_id AND up.id = a.id LEFT JOIN down ON down.doc_id = a.doc_id AND down.id = a.id")
def subordination_depth(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve(graph(spark, d)).where("is_anchor").select("doc_id", F.col("id").alias("anchor"), "parent", F.coalesce("depth", F.lit(-1)).alias("depth"))


@query(_GR2 + _ROUND + " SELECT * FROM warned")
def depth_warnings(spark: SparkSession, d: str) -> DataFrame:
    return G.depth_warnings(G.resolve(graph(spark, d)))


@query(_GR2 + _ROUND + " SELECT * FROM cycles")
def depth_cycles(spark: SparkSession, d: str) -> DataFrame:
    return G.depth_warnings(G.resolve(graph(spark, d))).where("code = 'cycle'")


@query(_GR2 + ", docs AS (SELECT DISTINCT doc_id FROM g) SELECT docs.doc_id, coalesce(max(down.depth), -1) AS max_depth FROM docs LEFT JOIN down ON down.doc_id = docs.doc_id GROUP BY docs.doc_id")
def max_depth_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return G.max_depth(G.resolve(graph(spark, d))).select("doc_id", F.coalesce("max_depth", F.lit(-1)).alias("max_depth"))


@query(f"""WITH {_G}, two AS (SELECT *, row_number() OVER (PARTITION BY doc_id, related1, related2 ORDER BY pos) AS rn FROM g WHERE related1 <> 'root' AND related2 <> 'root' AND relationship1 = 'coordinating conjunction' AND relationship2 = 'coordinating conjunction'),
s AS (SELECT t.*, coalesce(a.verbalunit = a.id, FALSE) AS a1, coalesce(b.verbalunit = b.id, FALSE) AS a2, CASE WHEN a.id IS NULL THEN '''' || t.related1 || '''' ELSE coalesce('''' || a.text || '''', 'None') END AS n1, CASE WHEN b.id IS NULL THEN '''' || t.related2 || '''' ELSE coalesce('''' || b.text || '''', 'None') END AS n2
  FROM two t LEFT JOIN g a ON a.doc_id = t.doc_id AND a.id = t.related1 LEFT JOIN g b ON b.doc_id = t.doc_id AND b.id = t.related2 WHERE t.rn = 1),
o AS (SELECT doc_id, pos, id AS conjunction, text, CASE WHEN a1 THEN related1 ELSE related2 END AS anchored, CASE WHEN a1 THEN related2 ELSE related1 END AS unanchored, CASE WHEN a1 THEN n1 ELSE n2 END AS yt, CASE WHEN a1 THEN n2 ELSE n1 END AS nt FROM s WHERE a1 <> a2)
SELECT doc_id, pos, conjunction, anchored, unanchored, conjunction || ' (' || coalesce('''' || text || '''', 'None') || ') coordinates ' || anchored || ' (' || yt || '), which anchors its own verbal unit, with ' || unanchored || ' (' || nt || '), which does not -- if this conjunction is meant to join two verbal expressions (rather than a noun/adjective/prepositional-phrase pair), ' || unanchored || ' is likely missing its own verbalunitid and ''unit verb''/''root'' (or dependent-clause) relation.' AS message FROM o""")
def unanchored_coordination(spark: SparkSession, d: str) -> DataFrame:
    return G.unanchored_coordination(graph(spark, d))


@query(_COL + f", {_PAL} SELECT col.doc_id, col.unit_id, col.rank, col.rank % 8 AS slot, pal.fill, pal.stroke, pal.ink FROM col JOIN pal ON pal.slot = col.rank % 8")
def unit_colors(spark: SparkSession, d: str) -> DataFrame:
    return G.unit_colours(G.resolve(graph(spark, d)))


@query(_COL + " SELECT doc_id, count(*) AS units, count(*) || ' verbal units but only 8 distinct colors -- colors repeat and may be ambiguous between units' AS message FROM col GROUP BY doc_id HAVING count(*) > 8")
def color_overflow_warnings(spark: SparkSession, d: str) -> DataFrame:
    return G.colour_warnings(G.unit_colours(G.resolve(graph(spark, d))))


def _classes(source: str, within: str = "") -> str:
    part = "doc_id" + within
    return f"""q0 AS (SELECT *, sum(CASE WHEN tokentype = 'punctuation' AND text = '"' THEN 1 ELSE 0 END) OVER w AS dq, sum(CASE WHEN tokentype = 'punctuation' AND text = '''' THEN 1 ELSE 0 END) OVER w AS sq FROM {source} WHERE tokentype NOT IN {_IMPLIED} WINDOW w AS (PARTITION BY {part} ORDER BY pos ROWS UNBOUNDED PRECEDING)),
q1 AS (SELECT *, CASE WHEN tokentype = 'enclitic' THEN 'enclitic' WHEN tokentype = 'punctuation' THEN CASE WHEN text IN ('(', '[', '{{') OR (text = '"' AND dq % 2 = 1) OR (text = '''' AND sq % 2 = 1) THEN 'right' ELSE 'left' END ELSE 'normal' END AS join_class FROM q0),
q2 AS (SELECT *, CASE WHEN lag(join_class) OVER w IS NULL OR join_class IN ('left', 'enclitic') OR (join_class = 'normal' AND lag(join_class) OVER w = 'right') THEN '' ELSE ' ' END AS sep FROM q1 WINDOW w AS (PARTITION BY {part} ORDER BY pos))"""


@query(f"WITH {_G}, {_classes('g')} SELECT doc_id, pos, id, join_class, sep FROM q2")
def join_classes(spark: SparkSession, d: str) -> DataFrame:
    return R.join_classes(graph(spark, d)).select("doc_id", "pos", "id", "join_class", "sep")


@query(f"WITH {_G}, {_classes('g')} SELECT doc_id, string_agg(sep || coalesce(text, ''), '' ORDER BY pos) AS surface FROM q2 GROUP BY doc_id")
def surface_text(spark: SparkSession, d: str) -> DataFrame:
    return R.surface_text(graph(spark, d))


_SPAN = _COL + f""", {_PAL}, h AS (SELECT r.*, CASE WHEN pal.fill IS NOT NULL AND (r.tokentype IN ('lexical', 'praenomen', 'numeral') OR r.relationship1 = 'coordinating conjunction' OR r.relationship2 = 'coordinating conjunction') THEN '<span style="background-color: ' || pal.fill || '; color: ' || pal.ink || ';">' ELSE '' END AS open,
  replace(replace(replace(replace(replace(coalesce(r.text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS body FROM r LEFT JOIN col ON col.doc_id = r.doc_id AND col.unit_id = r.unit_id LEFT JOIN pal ON pal.slot = col.rank % 8),
hh AS (SELECT *, open || body || CASE WHEN open <> '' THEN '</span>' ELSE '' END AS piece FROM h)"""


@query(_SPAN + f", {_classes('hh')} SELECT doc_id, string_agg(sep || piece, '' ORDER BY pos) AS html FROM q2 GROUP BY doc_id")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    r = cut(G.resolve(graph(spark, d)))
    return R.html_text(r, G.unit_colours(r))


_BLOCK = """, b0 AS (SELECT *, CASE WHEN tokentype <> 'enclitic' THEN unit_id END AS elig FROM {0}), b1 AS (SELECT *, last_value(elig IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM b0),
b2 AS (SELECT *, sum(CASE WHEN elig IS NOT NULL AND (prev IS NULL OR prev <> elig) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block, coalesce(elig, prev) AS block_unit FROM b1)"""


@query(_RES + _BLOCK.format("r") + " SELECT doc_id, pos, id, block::BIGINT AS block, block_unit FROM b2")
def depth_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.depth_blocks(G.resolve(graph(spark, d))).select("doc_id", "pos", "id", "block", "block_unit")


_CAPPED = (
    _SPAN + f", {_DEEP}" + _BLOCK.format("hh") + """, b3 AS (SELECT b2.*, coalesce(down.depth, 0) AS d FROM b2 LEFT JOIN down ON down.doc_id = b2.doc_id AND down.id = b2.block_unit), b4 AS (SELECT * FROM b3 WHERE d <= 1), """
    + _classes("b4", ", block")
    + """, inner_ AS (SELECT doc_id, block, string_agg(sep || piece, '' ORDER BY pos) AS body FROM q2 GROUP BY doc_id, block), bd AS (SELECT doc_id, block, min(d) AS d FROM b4 GROUP BY doc_id, block)
SELECT bd.doc_id, string_agg('<div style="margin-left: ' || (bd.d * 2) || '.0em; margin-bottom: 0.35em;">' || coalesce(i.body, '') || '</div>', chr(10) ORDER BY bd.block) AS html FROM bd LEFT JOIN inner_ i ON i.doc_id = bd.doc_id AND i.block = bd.block GROUP BY bd.doc_id"""
)


@query(_CAPPED)
def depth_html_capped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokengraph").repartition("doc_id")  # as `resolve` wants them, so that they are moved once
    return R.depth_html(G.resolve(G.latest(rows, extra=(), without=("lemma",))), cap=1)


_MERMAID = """, nodes AS (SELECT doc_id, id FROM g WHERE tokentype <> 'punctuation'), m AS (SELECT e.*, n.id IS NOT NULL AS drawn FROM e JOIN nodes s ON s.doc_id = e.doc_id AND s.id = e.src LEFT JOIN nodes n ON n.doc_id = e.doc_id AND n.id = e.dst WHERE e.dst <> 'root')"""


@query(f"WITH {_G}, {_E}{_MERMAID} SELECT doc_id, pos, slot, 'skipped edge ' || src || ' -[' || label || ']-> ' || dst || ': target is punctuation or not in tokengraph' AS message FROM m WHERE NOT drawn")
def mermaid_skipped_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.mermaid_warnings(graph(spark, d))


_ESC = "replace(replace(replace({0}, '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"


_LINES = (
    _COL.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + f", {_PAL}{_MERMAID}" + f""", colours AS (SELECT col.*, pal.fill, pal.stroke, pal.ink FROM col JOIN pal ON pal.slot = col.rank % 8), drawn_nodes AS (SELECT * FROM r WHERE tokentype <> 'punctuation'),
amber AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS ids FROM drawn_nodes WHERE tokentype IN {_IMPLIED} GROUP BY doc_id),
lines AS (SELECT doc_id, 0 AS section, 0 AS ord, 0 AS sub, 'graph BT' AS line FROM (SELECT DISTINCT doc_id FROM g)
UNION ALL SELECT doc_id, 1, pos, 0, '    ' || id || '["' || {_ESC.format("coalesce(text, CASE tokentype WHEN 'implied sum' THEN 'elided sum' ELSE tokentype END)")} || '"]' FROM drawn_nodes
UNION ALL SELECT doc_id, 2, pos, slot, '    ' || src || ' -->|' || {_ESC.format("label")} || '| ' || dst FROM m WHERE drawn
UNION ALL SELECT doc_id, 3, 0, 0, '' FROM (SELECT doc_id FROM colours UNION SELECT doc_id FROM amber)
UNION ALL SELECT doc_id, 4, rank, 0, '    classDef vu' || rank || ' fill:' || fill || ',stroke:' || stroke || ',color:' || ink || ';' FROM colours
UNION ALL SELECT n.doc_id, 5, c.rank, 0, '    class ' || string_agg(n.id, ',' ORDER BY n.pos) || ' vu' || c.rank || ';' FROM drawn_nodes n JOIN colours c ON c.doc_id = n.doc_id AND c.unit_id = n.unit_id WHERE n.tokentype NOT IN {_IMPLIED} GROUP BY n.doc_id, c.rank
UNION ALL SELECT doc_id, 6, 0, 0, '    classDef implied fill:{IMPLIED_COLOUR[0]},stroke:{IMPLIED_COLOUR[1]},color:{IMPLIED_COLOUR[2]};' FROM amber
UNION ALL SELECT doc_id, 7, 0, 0, '    class ' || ids || ' implied;' FROM amber)"""
)


@query(_LINES + " SELECT * FROM lines")
def mermaid_lines(spark: SparkSession, d: str) -> DataFrame:
    r = cut(G.resolve(graph(spark, d)))
    return R.mermaid_lines(r, G.unit_colours(r))


@query(_LINES + " SELECT doc_id, string_agg(line, chr(10) ORDER BY section, ord, sub) AS diagram FROM lines GROUP BY doc_id")
def mermaid_diagrams(spark: SparkSession, d: str) -> DataFrame:
    r = cut(G.resolve(graph(spark, d)))
    return R.mermaid(r, G.unit_colours(r))


_PAD = "CASE WHEN length({0}) < {1} THEN rpad({0}, {1}, ' ') ELSE {0} END"
_REL = "CASE WHEN relationship{0} <> '' THEN relationship{0} || ' -> ' || coalesce(related{0}, 'None') END"


@query(f"""WITH {_G}, {_T}, {_U}, docs AS (SELECT doc_id FROM g UNION SELECT doc_id FROM t UNION SELECT doc_id FROM u), c AS (SELECT *, coalesce(text, '(' || tokentype || ')') AS shown, CASE WHEN length(lemma) > 0 THEN lemma ELSE '-' END AS lem, concat_ws('; ', {_REL.format(1)}, {_REL.format(2)}) AS rels FROM g)
SELECT docs.doc_id, h.section, h.ord, h.line FROM docs CROSS JOIN (VALUES (0, 0, 'Tokens:'), (2, 0, ''), (2, 1, 'Verbal expressions:'), (4, 0, ''), (4, 1, 'Token graph:')) h(section, ord, line)
UNION ALL SELECT doc_id, 1, pos, '  ' || CASE WHEN length(id) < 4 THEN lpad(id, 4, ' ') ELSE id END || '  ' || coalesce(text, 'None') FROM t
UNION ALL SELECT doc_id, 3, vu_pos, '  id=' || coalesce(id, 'None') || '  syntactic_type=' || coalesce(syntactic_type, 'None') || '  semantic_type=' || coalesce(semantic_type, 'None') FROM u
UNION ALL SELECT doc_id, 5, pos, '  ' || CASE WHEN length(id) < 4 THEN lpad(id, 4, ' ') ELSE id END || '  ' || {_PAD.format("shown", 15)} || ' type=' || {_PAD.format("tokentype", 11)} || ' lemma=' || {_PAD.format("lem", 15)} || ' ' || CASE WHEN rels = '' THEN '-' ELSE rels END || CASE WHEN verbalunit <> '' THEN ' [verbal unit ' || verbalunit || ']' ELSE '' END AS line FROM c""")
def console_dump(spark: SparkSession, d: str) -> DataFrame:
    return R.console_dump(tokens(spark, d), units(spark, d), graph(spark, d))


# --- checks ---

_KNOWN = f"{_G}, {_T}, {_U}, known AS (SELECT doc_id, id FROM t UNION SELECT doc_id, id FROM g WHERE tokentype IN {_IMPLIED})"


@query(f"""WITH {_KNOWN}, gg AS (SELECT g.*, t.id IS NOT NULL AS given, g.tokentype IN {_IMPLIED} AS implied FROM g LEFT JOIN t ON t.doc_id = g.doc_id AND t.id = g.id)
SELECT DISTINCT doc_id, 0 AS phase, 0 AS ord, 0 AS sub, 'root_id' AS code, 'token id ''root'' is reserved as the sentinel relatedtoken1 value for independent verbs and must not be assigned to an actual token' AS message FROM t WHERE id = 'root'
UNION ALL SELECT doc_id, 1, pos, 0, 'reused_id', 'tokengraph entry ''' || id || ''' is tokentype=''' || tokentype || ''' but reuses an id already in the input `tokens` list -- an implied token must use a new id' FROM gg WHERE implied AND given
UNION ALL SELECT doc_id, 1, pos, 1, 'implied_text', 'tokengraph entry ''' || id || ''' is tokentype=''' || tokentype || ''' but has a non-None token value ''' || text || ''' -- an implied token''s text must be left unset' FROM gg WHERE implied AND text IS NOT NULL
UNION ALL SELECT doc_id, 1, pos, 2, 'unknown_id', 'tokengraph entry has unknown id ''' || id || '''' FROM gg WHERE NOT implied AND NOT given
UNION ALL SELECT doc_id, 1, pos, 3, 'no_text', 'tokengraph entry ''' || id || ''' has token=None but tokentype=''' || tokentype || ''' -- only ''implied sum''/''continued discourse'' may omit surface text' FROM gg WHERE NOT implied AND text IS NULL
UNION ALL SELECT doc_id, 1, pos, 4, 'unknown_target', 'token ''' || id || ''' relatedtoken1=''' || related1 || ''' is not a known token id' FROM g WHERE related1 <> 'root' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = g.doc_id AND k.id = g.related1)
UNION ALL SELECT doc_id, 1, pos, 5, 'unknown_target', 'token ''' || id || ''' relatedtoken2=''' || related2 || ''' is not a known token id' FROM g WHERE related2 <> 'root' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = g.doc_id AND k.id = g.related2)
UNION ALL SELECT doc_id, 2, vu_pos, 0, 'unknown_unit', 'verbal expression id ''' || id || ''' is not a known token id' FROM u WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.doc_id = u.doc_id AND k.id = u.id)""")
def validate_problems(spark: SparkSession, d: str) -> DataFrame:
    return C.validate(tokens(spark, d), graph(spark, d), units(spark, d))


@query(f"WITH {_G}, {_T} SELECT DISTINCT doc_id, id FROM t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = t.doc_id AND g.id = t.id)")
def missing_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_tokens(tokens(spark, d), graph(spark, d))


def damaged(g: DataFrame) -> DataFrame:
    """A made damage: bars and line breaks at fixed places of the text fields, since the tables hold none."""
    for k, f in enumerate(FIELDS):
        g = g.withColumn(f, F.when(F.col("pos") % 97 == 5 * k, F.concat(F.col(f), F.lit("|\n\r"[k % 3]))).otherwise(F.col(f)))
    return g


FIELDS = ["id", "tokentype", "text", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"]
_HURT = " UNION ALL ".join(f"SELECT doc_id, pos, '{f}' AS field, CASE WHEN pos % 97 = {5 * k} THEN {f} || chr({(124, 10, 13)[k % 3]}) ELSE {f} END AS value FROM g" for k, f in enumerate(FIELDS))


@query(f"WITH {_G}, f AS ({_HURT}) SELECT * FROM f WHERE regexp_matches(value, '[|\\n\\r]')")
def illegal_field_chars(spark: SparkSession, d: str) -> DataFrame:
    return C.illegal_fields(damaged(graph(spark, d)), FIELDS)


_SPANS = f"""{_G}, {_T}, sb AS (SELECT doc_id, sent_idx, arg_min(id, pos) AS first_id, arg_max(id, pos) AS last_id, count(*) AS n, arg_min(struct_pack(c := citation), pos).c AS begin_context, arg_max(struct_pack(c := citation), pos).c AS end_context FROM t GROUP BY doc_id, sent_idx),
sp AS (SELECT sb.*, a.pos AS start_pos, b.pos AS end_pos FROM sb LEFT JOIN g a ON a.doc_id = sb.doc_id AND a.id = sb.first_id LEFT JOIN g b ON b.doc_id = sb.doc_id AND b.id = sb.last_id)"""


@query(f"WITH {_SPANS} SELECT doc_id, sent_idx, first_id, last_id, n, begin_context, end_context FROM sb")
def sentence_bounds(spark: SparkSession, d: str) -> DataFrame:
    return C.sentence_bounds(tokens(spark, d))


@query(f"WITH {_SPANS} SELECT g.doc_id, sp.sent_idx, g.pos, g.id FROM g JOIN sp ON sp.doc_id = g.doc_id AND g.pos BETWEEN sp.start_pos AND sp.end_pos")
def split_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    return C.split_by_sentence(tokens(spark, d), graph(spark, d), units(spark, d))[0].select("doc_id", "sent_idx", "pos", "id")


@query(f"WITH {_SPANS}, {_U}, sl AS (SELECT g.doc_id, sp.sent_idx, g.id FROM g JOIN sp ON sp.doc_id = g.doc_id AND g.pos BETWEEN sp.start_pos AND sp.end_pos) SELECT u.doc_id, sl.sent_idx, u.id, u.syntactic_type, u.semantic_type FROM u JOIN sl ON sl.doc_id = u.doc_id AND sl.id = u.id")
def split_units(spark: SparkSession, d: str) -> DataFrame:
    return C.split_by_sentence(tokens(spark, d), graph(spark, d), units(spark, d))[1].select("doc_id", "sent_idx", "id", "syntactic_type", "semantic_type")


@query(f"""WITH {_SPANS}, want AS (SELECT doc_id, sent_idx, string_agg(id, ' ' ORDER BY pos) AS ids FROM t GROUP BY doc_id, sent_idx),
got AS (SELECT g.doc_id, sp.sent_idx, string_agg(g.id, ' ' ORDER BY g.pos) AS ids FROM g JOIN sp ON sp.doc_id = g.doc_id AND g.pos BETWEEN sp.start_pos AND sp.end_pos WHERE g.tokentype NOT IN {_IMPLIED} GROUP BY g.doc_id, sp.sent_idx),
c AS (SELECT sp.doc_id, sp.sent_idx, CASE WHEN sp.start_pos IS NULL OR sp.end_pos IS NULL THEN 'boundary_missing' WHEN want.ids IS DISTINCT FROM got.ids THEN 'not_contiguous' END AS code FROM sp JOIN want ON want.doc_id = sp.doc_id AND want.sent_idx = sp.sent_idx LEFT JOIN got ON got.doc_id = sp.doc_id AND got.sent_idx = sp.sent_idx)
SELECT * FROM c WHERE code IS NOT NULL""")
def contiguity_warnings(spark: SparkSession, d: str) -> DataFrame:
    return C.contiguity(tokens(spark, d), graph(spark, d))


@query(f"WITH {_G}, {_U}, w AS (SELECT doc_id, id, CASE vu_pos % 7 WHEN 2 THEN context || '.0' WHEN 4 THEN NULL ELSE context END AS context FROM u) SELECT w.doc_id, w.id, w.context AS declared, g.context AS actual FROM w JOIN g ON g.doc_id = w.doc_id AND g.id = w.id WHERE w.context IS DISTINCT FROM g.context")
def context_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """On units of which some declare another context or none at made places, since those of the tables agree."""
    made = F.when(F.col("vu_pos") % 7 == 2, F.concat("context", F.lit(".0"))).when(F.col("vu_pos") % 7 == 4, F.lit(None)).otherwise(F.col("context"))
    return C.context_mismatches(units(spark, d).withColumn("context", made), graph(spark, d))


@query(f"WITH {_T} SELECT doc_id, sent_idx, string_agg(coalesce(text, ''), ' ' ORDER BY pos) AS plain FROM t GROUP BY doc_id, sent_idx")
def plain_sentences(spark: SparkSession, d: str) -> DataFrame:
    return R.plain_text(tokens(spark, d), ["doc_id", "sent_idx"])


@query(f"WITH {_G} SELECT doc_id, pos, id, text FROM g WHERE tokentype NOT IN {_IMPLIED}")
def real_tokens(spark: SparkSession, d: str) -> DataFrame:
    return G.real_tokens(graph(spark, d))


@query("SELECT doc_id, sent_idx, generate_subscripts(tokens, 1) - 1 AS k, unnest(tokens).id AS id, unnest(tokens).text AS text, unnest(tokens).citation AS citation FROM sentences")
def flattened_sentences(spark: SparkSession, d: str) -> DataFrame:
    return S.token_rows(table(spark, d, "sentences"))


@query(f"WITH {_T} SELECT doc_id, sent_idx, count(*) AS n, string_agg(id || '=' || coalesce(text, '') || '@' || coalesce(citation, ''), ' ' ORDER BY pos) AS nested FROM t GROUP BY doc_id, sent_idx")
def nested_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = S.sentence_arrays(tokens(spark, d))
    one = lambda x: F.concat(x["id"], F.lit("="), F.coalesce(x["text"], F.lit("")), F.lit("@"), F.coalesce(x["citation"], F.lit("")))
    return s.select("doc_id", "sent_idx", F.size("tokens").cast("long").alias("n"), F.array_join(F.transform("tokens", one), " ").alias("nested"))


# --- sources and sinks ---


@query(f"""WITH {_SPANS}, {_U}, cite AS (SELECT doc_id, id, citation FROM t),
lines AS (SELECT doc_id, 1 AS section, sent_idx AS ord, coalesce(begin_context, '') || '|' || first_id || '|' || coalesce(end_context, '') || '|' || last_id AS line FROM sb
UNION ALL SELECT u.doc_id, 3, u.vu_pos, coalesce(c.citation, '') || '|' || coalesce(u.id, '') || '|' || coalesce(u.syntactic_type, '') || '|' || coalesce(u.semantic_type, '') FROM u LEFT JOIN cite c ON c.doc_id = u.doc_id AND c.id = u.id
UNION ALL SELECT g.doc_id, 5, g.pos, coalesce(c.citation, '') || '|' || g.id || '|' || coalesce(g.tokentype, '') || '|' || coalesce(g.text, '') || '|' || coalesce(g.lemma, '') || '|' || coalesce(g.verbalunit, '') || '|' || coalesce(g.related1, '') || '|' || coalesce(g.relationship1, '') || '|' || coalesce(g.related2, '') || '|' || coalesce(g.relationship2, '') FROM g LEFT JOIN cite c ON c.doc_id = g.doc_id AND c.id = g.id)
SELECT * FROM lines UNION ALL SELECT d.doc_id, h.* FROM (SELECT doc_id FROM g UNION SELECT doc_id FROM t) d CROSS JOIN (VALUES {_values([(s, k, x) for s, label in ((0, "#!sentences"), (2, "#!verbal_units"), (4, "#!tokens")) for k, x in enumerate([*([""] if s else []), label, blocks.ANALYSIS[label]])])}) h(section, ord, line)""")
def serialize_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.analysis_lines(tokens(spark, d), units(spark, d), graph(spark, d))


_CONTIGUITY = f"""want AS (SELECT doc_id, sent_idx, string_agg(id, ' ' ORDER BY pos) AS ids FROM t GROUP BY doc_id, sent_idx),
got AS (SELECT g.doc_id, sp.sent_idx, string_agg(g.id, ' ' ORDER BY g.pos) AS ids FROM g JOIN sp ON sp.doc_id = g.doc_id AND g.pos BETWEEN sp.start_pos AND sp.end_pos WHERE g.tokentype NOT IN {_IMPLIED} GROUP BY g.doc_id, sp.sent_idx),
c AS (SELECT sp.doc_id, sp.sent_idx, CASE WHEN sp.start_pos IS NULL OR sp.end_pos IS NULL THEN 'boundary_missing' WHEN want.ids IS DISTINCT FROM got.ids THEN 'not_contiguous' END AS code FROM sp JOIN want ON want.doc_id = sp.doc_id AND want.sent_idx = sp.sent_idx LEFT JOIN got ON got.doc_id = sp.doc_id AND got.sent_idx = sp.sent_idx)"""


@query(f"""WITH {_SPANS}, {_U}, {_CONTIGUITY} SELECT doc_id, 1 AS section, sent_idx AS ord, code FROM c WHERE code IS NOT NULL
UNION ALL SELECT u.doc_id, 3, u.vu_pos, 'unit_without_sentence' FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = u.doc_id AND t.id = u.id) AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = u.doc_id AND g.id = u.id AND g.tokentype IN {_IMPLIED})
UNION ALL SELECT g.doc_id, 5, g.pos, 'token_without_sentence' FROM g WHERE g.tokentype NOT IN {_IMPLIED} AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = g.doc_id AND t.id = g.id)""")
def serialize_warnings(spark: SparkSession, d: str) -> DataFrame:
    return sinks.analysis_warnings(tokens(spark, d), units(spark, d), graph(spark, d))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_lines").groupBy("path", "line_no").agg(F.max("line").alias("line"))


_STATE = r"""l AS (SELECT path, line_no, max(line) AS line FROM raw_lines GROUP BY path, line_no), solid AS (SELECT * FROM l WHERE NOT regexp_full_match(line, '[\s\p{Z}]*')),
s AS (SELECT *, last_value(CASE WHEN line = '#!ctsdata' THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_at, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS before FROM solid),
dat AS (SELECT path, line_no, string_split(line, '|') AS f, string_split(string_split(line, '|')[1], ':') AS p FROM s WHERE line <> '#!ctsdata' AND open_at IS NOT NULL AND before <> open_at)"""


@query("WITH " + _STATE + " SELECT path, line_no, p[1] || ':' || p[2] || ':' || p[3] || ':' || p[4] || ':' AS urnbase, p[5] AS citation, f[2] AS text FROM dat WHERE len(f) = 2 AND f[1] <> '' AND f[2] <> '' AND len(p) = 5 AND p[5] <> ''")
def strict_passages(spark: SparkSession, d: str) -> DataFrame:
    return blocks.passages(_raw(spark, d))[0]


@query()
def strict_passage_problems(spark: SparkSession, d: str) -> DataFrame:
    return blocks.passages(_raw(spark, d))[1]


@query()
def analysis_file_rows(spark: SparkSession, d: str) -> DataFrame:
    return blocks.analyses(_raw(spark, d))[0]


@query()
def analysis_file_problems(spark: SparkSession, d: str) -> DataFrame:
    return blocks.analyses(_raw(spark, d))[3]


@query("SELECT DISTINCT urnbase || citation AS urn, string_split(urnbase, ':')[4] AS work, length(text) AS n, CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 4 THEN array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:4], ' ') || '…' ELSE array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') END AS preview FROM ctsdata")
def urn_split(spark: SparkSession, d: str) -> DataFrame:
    base, cited = X.split_urn(F.concat("urnbase", "citation"))
    return table(spark, d, "ctsdata").select(F.concat(base, cited).alias("urn"), F.split("urnbase", ":")[3].alias("work"), F.length("text").cast("long").alias("n"), X.preview(F.col("text")).alias("preview")).distinct()


@query(r"SELECT DISTINCT slug, CASE WHEN regexp_replace(regexp_replace(passage, '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'passage' ELSE regexp_replace(regexp_replace(passage, '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') END AS filename FROM gold_examples")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_examples").select("slug", X.safe_filename(F.col("passage")).alias("filename")).distinct()


_OPT = "CASE WHEN {0} IS NULL THEN '' ELSE ',\"{1}\":' || to_json({0}) END"


@query(f"""WITH {_G}, {_U}, ts AS (SELECT doc_id, string_agg(CASE WHEN text IS NULL THEN '{{"token":null,"id":' || to_json(id) ELSE '{{"id":' || to_json(id) || ',"token":' || to_json(text) END || {" || ".join(_OPT.format(c, n) for c, n in (("tokentype", "tokentype"), ("lemma", "lemma"), ("verbalunit", "verbalunitid"), ("related1", "relatedtoken1"), ("relationship1", "relationship1"), ("related2", "relatedtoken2"), ("relationship2", "relationship2")))} || '}}', ',' ORDER BY pos) AS t FROM g GROUP BY doc_id),
vs AS (SELECT doc_id, string_agg('{{"id":' || to_json(id) || {_OPT.format("syntactic_type", "syntactic_type")} || {_OPT.format("semantic_type", "semantic_type")} || '}}', ',' ORDER BY vu_pos) AS v FROM u GROUP BY doc_id)
SELECT ts.doc_id, '{{"verbalunits":[' || coalesce(vs.v, '') || '],"tokengraph":[' || ts.t || ']}}' AS answer FROM ts LEFT JOIN vs ON vs.doc_id = ts.doc_id""")
def gold_export(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sparse_examples(graph(spark, d), units(spark, d))


@query(f"WITH {_G} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, id, tokentype, text, lemma, verbalunit, related1, relationship1, related2, relationship2 FROM g")
def gold_import(spark: SparkSession, d: str) -> DataFrame:
    """The exported examples read back as rows."""
    return gold_rows(sinks.sparse_examples(graph(spark, d), units(spark, d)).withColumnRenamed("doc_id", "slug"))[0]


@query()
def segment_sources(spark: SparkSession, d: str) -> DataFrame:
    return S.segment(table(spark, d, "sources"))


@query()
def segment_enclitics(spark: SparkSession, d: str) -> DataFrame:
    return S.segment(table(spark, d, "sources"), split_enclitics=True)


@query(f"WITH {_SPANS} SELECT sp.doc_id, sp.sent_idx, coalesce(string_agg(g.id || '=' || coalesce(g.text, '') || '@' || coalesce(g.context, ''), ' ' ORDER BY g.pos) FILTER (WHERE g.tokentype NOT IN {_IMPLIED}), '') AS sentence FROM sp JOIN g ON g.doc_id = sp.doc_id AND g.pos BETWEEN sp.start_pos AND sp.end_pos GROUP BY sp.doc_id, sp.sent_idx")
def reconstructed_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = blocks.reconstructed(graph(spark, d), C.sentence_bounds(tokens(spark, d)))
    one = lambda x: F.concat(x["id"], F.lit("="), F.coalesce(x["text"], F.lit("")), F.lit("@"), F.coalesce(x["citation"], F.lit("")))
    return s.select("doc_id", "sent_idx", F.array_join(F.transform("tokens", one), " ").alias("sentence"))


@query("SELECT path, urnbase, row_pos, row_number() OVER (PARTITION BY path ORDER BY row_pos) - 1 AS picked FROM (SELECT path, row_pos, any_value(urnbase) AS urnbase FROM ctsdata GROUP BY path, row_pos) WHERE urnbase IN (SELECT urnbase FROM documents WHERE lang = 'la')")
def picked_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the editions that Latin documents come from, in the order of their files."""
    rows = table(spark, d, "ctsdata").groupBy("path", "row_pos").agg(F.any_value("urnbase").alias("urnbase"))
    return L.pick(rows, table(spark, d, "documents").where("lang = 'la'").select("urnbase"), "urnbase", "row_pos").select("path", "urnbase", "row_pos", "picked")


# --- scores ---

_P = "p AS (SELECT doc_id, id, pos, tokentype, text, CASE WHEN pos % 7 = 3 THEN lower(text) ELSE lemma END AS lemma, CASE WHEN pos % 13 = 3 THEN NULL ELSE verbalunit END AS verbalunit, related1, CASE WHEN pos % 5 = 3 THEN 'adverbial' ELSE relationship1 END AS relationship1, related2, relationship2 FROM g WHERE pos % 11 <> 7)"
_PU = "pu AS (SELECT doc_id, vu_pos, id, syntactic_type, CASE WHEN vu_pos % 4 = 1 THEN 'intransitive' ELSE semantic_type END AS semantic_type FROM u WHERE vu_pos % 9 <> 4)"
_TRI = """gt AS (SELECT DISTINCT doc_id, src, label, dst FROM e), pt AS (SELECT doc_id, id AS src, relationship1 AS label, related1 AS dst FROM p WHERE relationship1 IS NOT NULL AND related1 IS NOT NULL UNION SELECT doc_id, id, relationship2, related2 FROM p WHERE relationship2 IS NOT NULL AND related2 IS NOT NULL)"""
_SCORES = f"""WITH {_G}, {_E}, {_U}, {_P}, {_PU}, {_TRI},
f AS (SELECT g.doc_id, sum(CASE WHEN p.id IS NULL THEN 2 ELSE 2 + (g.lemma IS NOT NULL)::INT END) AS a, sum(CASE WHEN p.id IS NULL THEN 0 ELSE (g.tokentype IS NOT DISTINCT FROM p.tokentype)::INT + (g.verbalunit IS NOT DISTINCT FROM p.verbalunit)::INT + CASE WHEN g.lemma IS NOT NULL THEN (g.lemma IS NOT DISTINCT FROM p.lemma)::INT ELSE 0 END END) AS k
  FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.id = g.id GROUP BY g.doc_id),
rr AS (SELECT coalesce(gt.doc_id, pt.doc_id) AS doc_id, count(*) AS a, count(*) FILTER (WHERE gt.src IS NOT NULL AND pt.src IS NOT NULL) AS k FROM gt FULL JOIN pt ON pt.doc_id = gt.doc_id AND pt.src = gt.src AND pt.label = gt.label AND pt.dst = gt.dst GROUP BY 1),
lu AS (SELECT doc_id, id, arg_max(struct_pack(a := syntactic_type, b := semantic_type), vu_pos) AS v FROM u GROUP BY doc_id, id), lp AS (SELECT doc_id, id, arg_max(struct_pack(a := syntactic_type, b := semantic_type), vu_pos) AS v FROM pu GROUP BY doc_id, id),
vv AS (SELECT lu.doc_id, count(*) * 2 AS a, sum(CASE WHEN lp.v IS NULL THEN 0 ELSE (lu.v.a IS NOT DISTINCT FROM lp.v.a)::INT + (lu.v.b IS NOT DISTINCT FROM lp.v.b)::INT END) AS k FROM lu LEFT JOIN lp ON lp.doc_id = lu.doc_id AND lp.id IS NOT DISTINCT FROM lu.id GROUP BY lu.doc_id),
sc AS (SELECT f.doc_id, f.k::DOUBLE / f.a AS field_score, coalesce(rr.k::DOUBLE / rr.a, 1) AS relation_score, coalesce(vv.k::DOUBLE / vv.a, 1) AS vu_score FROM f LEFT JOIN rr ON rr.doc_id = f.doc_id LEFT JOIN vv ON vv.doc_id = f.doc_id),
scored AS (SELECT *, field_score * 0.2::DOUBLE + relation_score * 0.5::DOUBLE + vu_score * 0.3::DOUBLE AS score FROM sc)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    g, u = graph(spark, d), units(spark, d)
    return M.scores(g, prediction(g), u, predicted_units(u))


@query(_SCORES + " SELECT doc_id, round(field_score, 6) AS field_score, round(relation_score, 6) AS relation_score, round(vu_score, 6) AS vu_score, round(score, 6) AS score FROM scored")
def metric_scores(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.select("doc_id", *[F.round(c, 6).alias(c) for c in ("field_score", "relation_score", "vu_score", "score")])


@query(_SCORES + " SELECT count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(field_score), 6) AS field_mean, round(avg(relation_score), 6) AS relation_mean, round(avg(vu_score), 6) AS vu_mean FROM scored")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    s = M.summary(_scored(spark, d))
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


@query(f"WITH {_G}, {_E}, {_P}, {_TRI} SELECT CASE WHEN pt.src IS NULL THEN 'missing' WHEN gt.src IS NULL THEN 'extra' ELSE 'both' END AS side, count(*) AS n FROM gt FULL JOIN pt ON pt.doc_id = gt.doc_id AND pt.src = gt.src AND pt.label = gt.label AND pt.dst = gt.dst GROUP BY 1")
def gold_vs_pred_full_outer(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    side = F.when(~F.col("in_pred"), "missing").when(~F.col("in_gold"), "extra").otherwise("both")
    return M.triple_pairs(g, prediction(g)).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query()
def metric_feedback(spark: SparkSession, d: str) -> DataFrame:
    g, u = graph(spark, d), units(spark, d)
    p, q = prediction(g), predicted_units(u)
    return M.feedback(M.scores(g, p, u, q), M.problems(g, p, u, q))


_BOTH = "FROM g JOIN p ON p.doc_id = g.doc_id AND p.id = g.id WHERE"
_CODES = f"""codes AS (SELECT 'missing_token' AS code FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.id = g.id) UNION ALL SELECT 'extra_token' FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE p.doc_id = g.doc_id AND p.id = g.id)
UNION ALL SELECT 'wrong_tokentype' {_BOTH} g.tokentype IS DISTINCT FROM p.tokentype UNION ALL SELECT 'wrong_verbalunit' {_BOTH} g.verbalunit IS DISTINCT FROM p.verbalunit UNION ALL SELECT 'wrong_lemma' {_BOTH} g.lemma IS NOT NULL AND g.lemma IS DISTINCT FROM p.lemma
UNION ALL SELECT 'missing_relation' FROM gt WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.doc_id = gt.doc_id AND pt.src = gt.src AND pt.label = gt.label AND pt.dst = gt.dst) UNION ALL SELECT 'extra_relation' FROM pt WHERE NOT EXISTS (SELECT 1 FROM gt WHERE pt.doc_id = gt.doc_id AND pt.src = gt.src AND pt.label = gt.label AND pt.dst = gt.dst)
UNION ALL SELECT 'missing_unit' FROM lu LEFT JOIN lp ON lp.doc_id = lu.doc_id AND lp.id IS NOT DISTINCT FROM lu.id WHERE lp.v IS NULL UNION ALL SELECT 'extra_unit' FROM lp LEFT JOIN lu ON lp.doc_id = lu.doc_id AND lp.id IS NOT DISTINCT FROM lu.id WHERE lu.v IS NULL
UNION ALL SELECT 'wrong_syntactic_type' FROM lu JOIN lp ON lp.doc_id = lu.doc_id AND lp.id IS NOT DISTINCT FROM lu.id WHERE lu.v.a IS DISTINCT FROM lp.v.a UNION ALL SELECT 'wrong_semantic_type' FROM lu JOIN lp ON lp.doc_id = lu.doc_id AND lp.id IS NOT DISTINCT FROM lu.id WHERE lu.v.b IS DISTINCT FROM lp.v.b)"""


@query(_SCORES + f", {_CODES} SELECT code, count(*) AS n FROM codes GROUP BY code")
def metric_feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    g, u = graph(spark, d), units(spark, d)
    return M.problems(g, prediction(g), u, predicted_units(u)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- bookkeeping and budgets ---


@query("SELECT item_id, slug, CASE WHEN list_contains(tags, 'held-out') THEN 'held_out' ELSE 'train' END AS part FROM gold_examples")
def heldout_split(spark: SparkSession, d: str) -> DataFrame:
    ex = table(spark, d, "gold_examples").select("item_id", "slug", "tags")
    train, held = L.split(ex, ex.where(F.array_contains("tags", "held-out")))
    return train.select("item_id", "slug", F.lit("train").alias("part")).unionByName(held.select("item_id", "slug", F.lit("held_out").alias("part")))


def _board(spark: SparkSession, d: str, late: bool) -> DataFrame:
    """Results made from the orders table: a candidate a customer, a provider a priority, a stage a status; the orders before 1995 are an earlier delivery."""
    before = F.col("o_orderdate") < "1995-01-01"
    o = table(spark, d, "orders").where(~before if late else before)
    stage = F.when(F.col("o_orderstatus") == "F", "baseline").when(F.col("o_orderstatus") == "O", "gepa").otherwise("bootstrap")
    r = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("label"), F.substring("o_orderpriority", 1, 1).alias("provider"), stage.alias("stage"), F.col("o_totalprice").cast("double").alias("v"))
    agg = r.groupBy("label", "provider", "stage").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.floor(F.sum(F.round(F.col("v") * 100).cast("long")) / F.count(F.lit(1))) / 100).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    have = set(agg.columns)
    return agg.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], L.SCHEMA).schema])


_BOARD = """SELECT 'c' || o_custkey AS label, o_orderpriority[1:1] AS provider, CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'gepa' ELSE 'bootstrap' END AS stage, count(*) AS n, floor(sum(round(o_totalprice::DOUBLE * 100)::BIGINT) / count(*)) / 100 AS mean, min(o_totalprice::DOUBLE) AS min, max(o_totalprice::DOUBLE) AS max FROM orders WHERE o_orderdate {0} DATE '1995-01-01' GROUP BY ALL"""


@query(f"""WITH o AS ({_BOARD.format("<")}), w AS ({_BOARD.format(">=")}), twice AS (SELECT *, 0 AS z FROM o UNION ALL SELECT *, 1 FROM w), kept AS (SELECT label, provider, stage, arg_max(struct_pack(n := n, mean := mean, min := min, max := max), z) AS v FROM twice GROUP BY label, provider, stage)
SELECT label, provider, NULL::VARCHAR AS model, NULL::VARCHAR AS family, NULL::VARCHAR AS tier, stage, v.n AS n, v.mean AS mean, v.min AS min, v.max AS max, NULL::DOUBLE AS field_mean, NULL::DOUBLE AS relation_mean, NULL::DOUBLE AS vu_mean, NULL::DOUBLE AS elapsed_s, NULL::INT AS n_calls, NULL::DOUBLE AS total_cost, NULL::VARCHAR AS error,
CASE WHEN label IN ('c1', 'c2', 'c3') THEN label[2:2]::INT ELSE 1073741824 END AS place, CASE WHEN label IN ('c1', 'c2', 'c3') THEN '' ELSE label END AS by_name, CASE stage WHEN 'baseline' THEN 0 WHEN 'gepa' THEN 1 ELSE 2 END AS step FROM kept""")
def leaderboard_upsert(spark: SparkSession, d: str) -> DataFrame:
    candidates = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "label string, rank int")
    board = L.upsert(_board(spark, d, False), _board(spark, d, True), candidates)
    return board.select(*L.COLUMNS, F.col("order_key.candidate").alias("place"), F.col("order_key.name").alias("by_name"), F.col("order_key.step").alias("step")).withColumn("n", F.col("n").cast("long"))


@query(f"WITH o AS ({_BOARD.format('<')}), w AS ({_BOARD.format('>=')}), a AS (SELECT label, provider, mean FROM w WHERE stage = 'baseline'), b AS (SELECT label, provider, mean FROM o WHERE stage = 'baseline') SELECT coalesce(a.label, b.label) AS label, coalesce(a.provider, b.provider) AS provider, coalesce(a.mean, b.mean) AS baseline, coalesce(a.mean, b.mean) >= 140000 AS go FROM a FULL JOIN b ON b.label = a.label AND b.provider = a.provider")
def baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    return L.gate(_board(spark, d, True), _board(spark, d, False), 140000.0)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples made from documents: words against characters; null texts are failed calls."""
    words = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("double")
    return table(spark, d, "documents").select(F.coalesce("lang", F.lit("-")).alias("lang"), words.alias("num_tokens"), F.length("text").cast("double").alias("completion_tokens"), F.when(F.col("text").isNull(), "no usage").alias("error"))


_SAMPLES = "s AS (SELECT coalesce(lang, '-') AS lang, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::DOUBLE AS x, length(text)::DOUBLE AS y FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND length(text) < 8000)"


@query(f"WITH {_SAMPLES}, f AS (SELECT lang, CASE WHEN count(DISTINCT x) >= 2 THEN regr_intercept(y, x) END AS i, CASE WHEN count(DISTINCT x) >= 2 THEN regr_slope(y, x) END AS sl, count(*) AS n FROM s GROUP BY lang) SELECT f.lang, round(f.i, 4) AS intercept, round(f.sl, 4) AS slope, f.n AS sample_size, round(max(abs(s.y - (f.i + f.sl * s.x))), 4) AS max_residual FROM f JOIN s ON s.lang = f.lang GROUP BY f.lang, f.i, f.sl, f.n")
def fit_completion_tokens(spark: SparkSession, d: str) -> DataFrame:
    fit = B.fit_line(B.usable(_samples(spark, d)), "num_tokens", "completion_tokens", ["lang"])
    return fit.select("lang", *[F.round(c, 4).alias(c) for c in ("intercept", "slope")], "sample_size", F.round("max_residual", 4).alias("max_residual"))


@query(f"WITH {_T} SELECT doc_id, sent_idx, count(*) AS n, greatest(256, least(8192, ceil((500.0::DOUBLE + 60.0::DOUBLE * count(*)) * 1.4::DOUBLE)))::INT AS budget FROM t GROUP BY doc_id, sent_idx")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("doc_id", "sent_idx").agg(F.count(F.lit(1)).alias("n")).withColumn("budget", B.budget(F.col("n")))


@query("SELECT count(*) AS n_calls, round(sum(value), 2) AS total_cost FROM events")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("cost"))
    return L.usage_totals(calls, -1).select("n_calls", F.round("total_cost", 2).alias("total_cost"))


