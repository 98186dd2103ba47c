"""Queries of the general training-data operators (p1, p2, p3, p5) with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.operators import hierarchy as H
from vinculum.operators import orphans as O
from vinculum.operators import rejects as R
from vinculum.operators import termcounts as T
from vinculum.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return O.find_orphans(*O.token_references(table(spark, d, "tokengraph"), table(spark, d, "verbal_units")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_report(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return R.split_rows(table(spark, d, "raw_lines"))[1].select("file_id", "line_no", "reason")


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    return R.typed_block(R.split_rows(table(spark, d, "raw_lines"))[0], "#!ctsdata")


def p2_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.typed_block(R.split_rows(table(spark, d, "raw_lines"))[0], "#!tokens")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.loop_nodes(H.token_parents(table(spark, d, "tokengraph"))[1])


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(*H.token_parents(table(spark, d, "tokengraph"))).drop("ids").withColumn("depth", F.coalesce("depth", F.lit(-1)))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(*H.token_parents(table(spark, d, "tokengraph"))))


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    return H.intervals(H.hierarchy(*H.token_parents(table(spark, d, "tokengraph"))))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tokengraph")
    return T.mark_terms(T.count_terms(rows, ["lemma", "relationship1"], "loaded_at"), rows).where("mark is not null").select("field", "term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of distinct records, reached in two steps: a first load, then the signed delta of the later deliveries.

    A record's second delivery replaces the first: -1 for the old version, +1 for the new.
    """
    rows = table(spark, d, "tokengraph").select("doc_id", "id", "lemma", "relationship1", "loaded_at")
    fields = ["lemma", "relationship1"]
    span = cut(rows.groupBy("doc_id", "id").agg(
        F.min_by(F.struct("lemma", "relationship1"), "loaded_at").alias("old"), F.max_by(F.struct("lemma", "relationship1"), "loaded_at").alias("new"), (F.min("loaded_at") < F.max("loaded_at")).alias("changed")
    ))
    later = T.record_terms(span.where("changed").select("doc_id", "old.*"), fields, -1).unionByName(T.record_terms(span.where("changed").select("doc_id", "new.*"), fields))
    store = T.new_store(spark)
    store.apply(T.record_terms(span.select("doc_id", "old.*"), fields))
    store.apply(later)
    return store.terms()


_REC = """rec AS (SELECT doc_id, id, min(loaded_at) AS loaded_at, bool_or(deleted_at IS NOT NULL) AS deleted, max(related1) AS r1, max(verbalunit) AS vu, max(related2) AS r2 FROM tokengraph GROUP BY doc_id, id)"""
_P1 = f"""WITH {_REC}, live AS (SELECT * FROM rec WHERE NOT deleted),
refs AS (
  SELECT 'tokengraph' AS src_table, doc_id, id AS rec_id, 'related1' AS field, r1 AS target, loaded_at FROM live WHERE r1 IS NOT NULL AND r1 <> 'root'
  UNION ALL SELECT 'tokengraph', doc_id, id, 'verbalunit', vu, loaded_at FROM live WHERE vu IS NOT NULL
  UNION ALL SELECT 'verbal_units', doc_id, token, 'token', token, min(loaded_at) FROM verbal_units WHERE token IS NOT NULL GROUP BY doc_id, token),
found AS (SELECT DISTINCT r.src_table, strftime(r.loaded_at, '%Y-%m') AS period, r.doc_id, r.rec_id, r.field FROM refs r LEFT JOIN live p ON p.doc_id = r.doc_id AND p.id = r.target
  WHERE p.id IS NULL OR p.loaded_at > r.loaded_at)
"""
_BLOCK_SQL = r"""WITH lines AS (SELECT file_id, line_no, max(line) AS line FROM raw_lines GROUP BY file_id, line_no),
solid AS (SELECT *, line IN ('#!ctsdata', '#!tokens', '#!verbal_units', '#!sentences') AS is_label FROM lines WHERE NOT regexp_full_match(line, '[\s\p{Z}]*')),
state AS (SELECT *, last_value(CASE WHEN is_label THEN line END IGNORE NULLS) OVER w AS block, coalesce(lag(is_label) OVER w, FALSE) AS is_header FROM solid WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
data AS (SELECT file_id, line_no, block, line, regexp_full_match(line, '(?s)("([^"]|"")*"|[^"|][^|]*|)(\|("([^"]|"")*"|[^"|][^|]*|))*') AS well FROM state WHERE NOT is_label AND NOT is_header AND block IS NOT NULL),
split AS (SELECT *, string_split(regexp_replace('|' || line, '\|"(([^"]|"")*)"', '|' || chr(1), 'g')[2:], '|') AS holes, regexp_extract_all('|' || line, '(?s)\|("([^"]|"")*"|[^|]*)', 1) AS raw FROM data),
parsed AS (SELECT *, CASE WHEN left(raw[1], 1) = '"' THEN replace(raw[1][2:-2], '""', '"') ELSE raw[1] END AS c1, CASE WHEN left(raw[2], 1) = '"' THEN replace(raw[2][2:-2], '""', '"') ELSE raw[2] END AS c2,
  CASE WHEN left(raw[3], 1) = '"' THEN replace(raw[3][2:-2], '""', '"') ELSE raw[3] END AS c3 FROM split)
"""
_P2 = (
    _BLOCK_SQL
    + r""", judged AS (SELECT *, CASE WHEN NOT well THEN 'quoting'
  WHEN len(raw) <> CASE block WHEN '#!ctsdata' THEN 2 WHEN '#!tokens' THEN 10 ELSE 4 END THEN 'column_count'
  WHEN block = '#!ctsdata' AND (NOT regexp_full_match(c1, '(?s)urn:cts:[^:]+:[^:]+:[^:]+') OR regexp_matches(c1, '[\s\p{Z}\x{200B}\x{85}]')) THEN 'bad_urn'
  WHEN block = '#!ctsdata' AND (regexp_full_match(c2, '[\x{20}\x{A0}\x{3000}\x{200B}]*') OR regexp_matches(c2, '[\x{FFFD}\x{00}-\x{1F}\x{7F}-\x{9F}]')) THEN 'bad_text'
  WHEN block <> '#!ctsdata' AND NOT regexp_full_match(c1, '([a-z0-9]+(\.[a-z0-9]+){0,2})?') THEN 'bad_context'
  WHEN block = '#!sentences' AND NOT regexp_full_match(c3, '([a-z0-9]+(\.[a-z0-9]+){0,2})?') THEN 'bad_context' END AS reason FROM parsed), plain AS (SELECT *, list_transform(raw, lambda x: CASE WHEN left(x, 1) = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM judged WHERE reason IS NULL)
"""
)
_LINKS = f"""WITH RECURSIVE {_REC}, links AS (SELECT a.doc_id, a.id, coalesce(p.id, q.id) AS parent FROM rec a
  LEFT JOIN rec p ON p.doc_id = a.doc_id AND p.id = a.r1 LEFT JOIN rec q ON q.doc_id = a.doc_id AND q.id = a.r2
  WHERE (a.r1 IS NULL OR a.r1 <> 'root') AND (p.id IS NOT NULL OR q.id IS NOT NULL)),
up AS (SELECT doc_id, id, parent AS above, 1 AS n FROM links UNION ALL SELECT u.doc_id, u.id, l.parent, u.n + 1 FROM up u JOIN links l ON l.doc_id = u.doc_id AND l.id = u.above WHERE u.above <> u.id AND u.n < 1000),
tree AS (SELECT rec.doc_id, rec.id, rec.id AS path, 0 AS depth, rec.id AS root FROM rec WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.doc_id = rec.doc_id AND l.id = rec.id)
  UNION ALL SELECT l.doc_id, l.id, t.path || '>' || l.id, t.depth + 1, t.root FROM tree t JOIN links l ON l.doc_id = t.doc_id AND l.parent = t.id),
loops AS (SELECT DISTINCT doc_id, id FROM up WHERE above = id)
"""
_P5 = """WITH terms AS (SELECT 'lemma' AS field, lemma AS term, doc_id FROM tokengraph WHERE lemma IS NOT NULL UNION ALL SELECT 'relationship1', relationship1, doc_id FROM tokengraph WHERE relationship1 IS NOT NULL),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM terms GROUP BY field, term), total AS (SELECT count(DISTINCT doc_id) AS n FROM tokengraph),
marked AS (SELECT field, term, CASE WHEN documents < 3 THEN 'rare' WHEN documents * 3 > n THEN 'common' END AS mark FROM counts, total)
SELECT field, term, mark FROM marked WHERE mark IS NOT NULL"""

QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_passages, p2_tokens, p3_found, p3_paths, p3_descendants, p3_intervals, p5_found, p5_counts)}

SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_report": _P1 + "SELECT src_table, period, field, count(*) AS orphans, count(DISTINCT doc_id) AS documents FROM found GROUP BY src_table, period, field",
    "p2_found": _P2 + "SELECT file_id, line_no, reason FROM judged WHERE reason IS NOT NULL",
    "p2_passages": _P2 + "SELECT file_id, line_no, array_to_string(string_split(f[1], ':')[1:4], ':') || ':' AS urnbase, string_split(f[1], ':')[5] AS citation, f[2] AS text FROM plain WHERE block = '#!ctsdata'",
    "p2_tokens": _P2 + "SELECT file_id, line_no, " + ", ".join(f"nullif(f[{k}], '') AS {c}" for k, c in enumerate(R.BLOCKS["#!tokens"], 1)) + " FROM plain WHERE block = '#!tokens'",
    "p3_found": _LINKS + "SELECT doc_id, id FROM loops",
    "p3_paths": _LINKS
    + """SELECT rec.doc_id, rec.id, t.path, coalesce(t.depth, -1) AS depth, t.root, o.id IS NOT NULL AS on_loop, t.id IS NULL AND o.id IS NULL AS into_loop
FROM rec LEFT JOIN tree t ON t.doc_id = rec.doc_id AND t.id = rec.id LEFT JOIN loops o ON o.doc_id = rec.doc_id AND o.id = rec.id""",
    "p3_descendants": _LINKS
    + """, down AS (SELECT doc_id, parent AS id, id AS descendant, 1 AS distance FROM links WHERE EXISTS (SELECT 1 FROM tree t WHERE t.doc_id = links.doc_id AND t.id = links.id)
  UNION ALL SELECT d.doc_id, l.parent, d.descendant, d.distance + 1 FROM down d JOIN links l ON l.doc_id = d.doc_id AND l.id = d.id)
SELECT doc_id, id, descendant, distance FROM down""",
    "p3_intervals": _LINKS
    + """, ranked AS (SELECT doc_id, id, depth, row_number() OVER (PARTITION BY doc_id ORDER BY replace(path, '>', chr(1))) - 1 AS entry FROM tree)
SELECT a.doc_id, a.id, a.entry, coalesce((SELECT min(b.entry) FROM ranked b WHERE b.doc_id = a.doc_id AND b.entry > a.entry AND b.depth <= a.depth), (SELECT count(*) FROM ranked b WHERE b.doc_id = a.doc_id)) - a.entry - 1 AS below FROM ranked a""",
    "p5_found": _P5,
    "p5_counts": """WITH rec AS (SELECT doc_id, id, arg_max(struct_pack(l := lemma, r := relationship1), loaded_at) AS v FROM tokengraph GROUP BY doc_id, id),
terms AS (SELECT 'lemma' AS field, v.l AS term, doc_id FROM rec WHERE v.l IS NOT NULL UNION ALL SELECT 'relationship1', v.r, doc_id FROM rec WHERE v.r IS NOT NULL)
SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM terms GROUP BY field, term""",
}
