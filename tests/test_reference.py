"""Operators of the inventory on constructed passages, edge cases and random graphs."""

import random
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import graph, rows, tok, units_by_recursion
from vinculum.functions import text as X
from vinculum.functions.scan import scan
from vinculum.operators import analyze as A
from vinculum.operators import budget as B
from vinculum.operators import checks as C
from vinculum.operators import graph as G
from vinculum.operators import leaderboard as L
from vinculum.operators import metric as M
from vinculum.operators import render as R
from vinculum.operators import segment as S
from vinculum.sources import blocks, sinks
from vinculum.sources.gold import gold_rows
from vinculum.streaming.blocks import stream_passages

P = "punctuation"


def passage(doc="p"):
    """Puer (cum luna luceret) "cantat" domuique: one unit inside another, with brackets, quotes and an enclitic."""
    return [
        tok(doc, 0, "t0", "Puer", r1="t6", l1="subject"), tok(doc, 1, "t1", "(", P), tok(doc, 2, "t2", "cum", r1="t6", l1="subordinating conjunction"), tok(doc, 3, "t3", "luceret", unit="t3", r1="t2", l1="unit verb"),
        tok(doc, 4, "t4", ")", P), tok(doc, 5, "t5", '"', P), tok(doc, 6, "t6", "cant<at", unit="t6", r1="root", l1="unit verb"), tok(doc, 7, "t7", '"', P), tok(doc, 8, "t8", "domui", r1="t6", l1="dative"), tok(doc, 9, "t9", "que", "enclitic", r1="t8", l1="coordinating conjunction"),
        tok(doc, 10, "t9_implied", None, "implied sum", unit="t9_implied", r1="t6", l1="indirect statement"), tok(doc, 11, "t10", ".", P),
    ]


def resolved(spark, toks, **kw):
    return G.resolve(G.latest(graph(spark, toks)), **kw)


def test_units_depths_and_views(spark):
    r = resolved(spark, passage()).cache()
    got = {x.id: x for x in r.collect()}
    assert [got[f"t{k}"].unit_id for k in (0, 2, 3, 6, 8, 9)] == ["t6", "t3", "t3", "t6", "t6", "t6"]
    assert got["t1"].unit_id is None and got["t6"].depth == 0 and got["t3"].depth == 1 and got["t3"].parent == "t6" and got["t9_implied"].depth == 1
    colours = G.unit_colours(r)
    assert [(x.unit_id, x.slot) for x in colours.orderBy("rank").collect()] == [("t6", 0), ("t3", 1), ("t9_implied", 2)]
    assert R.surface_text(r).first().surface == 'Puer (cum luceret) "cant<at" domuique.'
    html = R.html_text(r, colours).first().html
    assert html.startswith('<span style="background-color: #82bbff; color: #000000;">Puer</span> (') and "cant&lt;at" in html and html.count("<span") == 6
    blocks_ = [(x.id, x.block, x.block_unit) for x in R.depth_blocks(r).orderBy("pos").collect()]
    assert [b for _, b, _ in blocks_] == [1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4]
    lines = R.depth_html(r, colours).first().html.split("\n")
    assert len(lines) == 4 and lines[1].startswith('<div style="margin-left: 2.0em; margin-bottom: 0.35em;">')
    assert R.depth_html(r, colours, cap=0).first().html.count("<div") == 2
    assert R.depth_html(r, colours, indent=2).first().html.split("\n")[0].startswith('<div style="margin-left: 0em')
    with pytest.raises(ValueError):
        R.depth_html(r, colours, cap=-1)
    diagram = R.mermaid(r, colours).first().diagram.split("\n")
    assert diagram[0] == "graph BT" and '    t6["cant&lt;at"]' in diagram and '    t9_implied["elided sum"]' in diagram and "    t0 -->|subject| t6" in diagram
    assert diagram[-1] == "    class t9_implied implied;" and any(x.startswith("    classDef vu0 fill:#82bbff,stroke:#2a78d6,color:#000000;") for x in diagram)
    assert R.mermaid_warnings(r).count() == 0 and R.console_lines(r).count() == 12
    assert {x.id: x.max_depth for x in G.max_depth(r).withColumnRenamed("doc_id", "id").collect()} == {"p": 1}


def test_depth_html_reads_its_rows_once(spark, tmp_path):
    toks = [
        tok("p", 0, "q", '"', "punctuation", r1="v"), tok("p", 1, "v", "it & it", unit="v", r1="root", l1="unit verb"), tok("p", 2, "w", "dum", unit="w", r1="v", l1="unit verb"), tok("p", 3, "x", "sit", r1="w"),
        tok("p", 4, "e", "que", "enclitic", r1="x"), tok("p", 5, "z", "ne", unit="z", r1="w", l1="unit verb"), tok("p", 6, "i", None, "implied sum", unit="i", r1="root"), tok("p", 7, "y", None, r1="v"), tok("p", 8, "u", '"', "punctuation", r1="v"),
        tok("only", 0, "d", "a", unit="d", r1="f"), tok("only", 1, "f", "b", unit="f", r1="d"), tok("late", 3, "a", None, "implied sum"),
        *(tok("many", k, f"m{k}", f"w{k}", unit=f"m{k}", r1="root" if k < 2 else f"m{k // 2}") for k in range(40)),
    ]
    r = resolved(spark, toks).cache()
    colours = G.unit_colours(r)

    def by_chunks(cap):
        """The blocks of `depth_blocks`, and the spacing of `join_classes` within them."""
        fill = {(c.doc_id, c.unit_id): c for c in colours.collect()}
        deep = {(x.doc_id, x.id): x.depth for x in r.where("is_anchor").collect()}
        blocks_ = R.depth_blocks(r).cache()
        sep = {(x.doc_id, x.id): x.sep for x in R.join_classes(blocks_, "block").collect()}
        out = {}
        for x in blocks_.orderBy("doc_id", "pos").collect():
            d = deep.get((x.doc_id, x.block_unit)) or 0
            if cap is None or d <= cap:
                c, text = fill.get((x.doc_id, x.unit_id)), (x.text or "").replace("&", "&amp;").replace('"', "&quot;")
                lit = c is not None and x.tokentype == "lexical"
                body = out.setdefault(x.doc_id, {}).setdefault(x.block, [f'<div style="margin-left: {d * 2.0}em; margin-bottom: 0.35em;">'])
                if (x.doc_id, x.id) in sep:
                    body.append(sep[x.doc_id, x.id] + (f'<span style="background-color: {c.fill}; color: {c.ink};">{text}</span>' if lit else text))
        return {doc: "\n".join("".join(b) + "</div>" for b in bs.values()) for doc, bs in out.items()}

    for cap in (None, 0, 1):
        want = by_chunks(cap)
        assert {x.doc_id: x.html for x in R.depth_html(r, cap=cap).collect()} == want
        assert {x.doc_id: x.html for x in R.depth_html(r, colours, cap=cap).collect()} == want
    assert want["late"] == '<div style="margin-left: 0.0em; margin-bottom: 0.35em;"></div>'

    graph(spark, toks).write.parquet(f"{tmp_path}/tokengraph.parquet")
    from vinculum.plans.reference import depth_html_capped

    df = depth_html_capped(spark, str(tmp_path))
    assert {x.doc_id: x.html for x in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 0 and plan.count("MapInArrow") == 3 and plan.count("Relation ") == 1


def test_texts_in_parts(monkeypatch):
    pieces = [("a", "</div>\n<div>x"), ("a", ""), ("a", "yé"), ("b", "</div>\n<div>"), ("c", "</div>\n<div>1"), ("c", "</div>\n<div>2"), ("c", "3")]
    want = [("a", "<div>xyé</div>"), ("b", "<div></div>"), ("c", "<div>1</div>\n<div>23</div>")]
    told = lambda batches: [tuple(x.values()) for b in batches for x in b.to_pylist()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string())], ["doc_id", "text"])
    for size in (1, 2, 3, 7):
        cut = [batch(pieces).slice(k, size) for k in range(0, 7, size)]
        assert told(R._wholes(iter(cut))) == want
        for most in (1, 5, 1000):
            monkeypatch.setattr(R, "_LONG", most)
            parts = told(R._parts(iter(cut)))
            assert told(R._wholes(iter([batch([(d, t) for d, _, t in parts])]))) == want and len({x[:2] for x in parts}) == len(parts)
    assert told(R._wholes(iter([]))) == []


def test_long_documents_by_row_numbers(spark):
    r = random.Random(7)
    labels = ["unit verb", "circumstantial participle", "ablative absolute", "subject", None]

    def document(doc, n, near):
        ids = [f"t{k}" for k in range(n)]
        some = lambda k: r.choice([None, "root", "gone", ids[max(0, k - 1)], r.choice(ids[max(0, k - near) : k + near])])
        return [tok(doc, k, i, unit=r.choice([None, None, None, i, "elsewhere"]), r1=some(k), l1=r.choice(labels), r2=some(k), l2=r.choice(labels)) for k, i in enumerate(ids)]

    docs = [document(f"d{k}", r.choice([1, 3, 9, 40]), r.choice([2, 40])) for k in range(150)]
    chain = [tok("chain", k, f"t{k}", unit=f"t{k}" if k == 299 else None, r1=f"t{k + 1}") for k in range(300)] + [tok("lost", k, f"t{k}", r1=f"t{k + 1}") for k in range(300)]
    rows_ = [(t[0], t[3], t[7], t[8], t[9], t[10], t[11]) for d in docs for t in d] + [(t[0], t[3], t[7], t[8], t[9], t[10], t[11]) for t in chain]
    rows_.sort(key=lambda x: x[0])
    table_ = pa.Table.from_arrays([pa.array([x[k] for x in rows_], pa.string()) for k in range(7)], G._NEED)
    for size in (5, 1000):
        told = [[tuple(x.values()) for b in G._resolve_sorted(iter(table_.to_batches(max_chunksize=size)), most) for x in b.to_pylist()] for most in (10**6, 0, 20)]
        assert len(told[0]) == len(rows_) and told[1] == told[0] and told[2] == told[0]
    assert {x[11] for x in told[0]} == {None, "cycle", "no_governor"}
    toks = [t for d in docs[:40] for t in d]
    assert rows(resolved(spark, toks, many_rows=2)) == rows(resolved(spark, toks))


def test_absolute_cycle_and_coordination(spark):
    toks = [
        tok("a", 0, "n", "urbe", r1="v", l1="ablative absolute"), tok("a", 1, "p", "capta", unit="p", r1="n", l1="circumstantial participle"), tok("a", 2, "v", "fugit", unit="v", r1="root", l1="unit verb"),
        tok("c", 0, "x", "x", r1="y"), tok("c", 1, "y", "y", r1="x"), tok("c", 2, "m", "m", unit="m", r1="k", l1="unit verb"), tok("c", 3, "k", "k", unit="k", r1="m", l1="unit verb"), tok("c", 4, "o", "o", unit="o", r1=None),
        tok("k", 0, "e", "et", r1="a1", l1="coordinating conjunction", r2="b1", l2="coordinating conjunction"), tok("k", 1, "a1", "it", unit="a1", r1="root"), tok("k", 2, "b1", None, r1="a1"),
        tok("k", 3, "e2", "et", r1="a1", l1="coordinating conjunction", r2="b1", l2="coordinating conjunction"),
    ]
    r = resolved(spark, toks).cache()
    unit = {(x.doc_id, x.id): x.unit_id for x in r.collect()}
    assert unit["a", "n"] == "p" and unit["c", "x"] is None and unit["c", "y"] is None
    told = {(x.anchor, x.code) for x in G.depth_warnings(r).where("doc_id = 'c'").collect()}
    assert told == {("m", "cycle"), ("o", "no_governor")}
    co = G.unanchored_coordination(G.latest(graph(spark, toks))).collect()
    assert len(co) == 1 and co[0].conjunction == "e" and co[0].unanchored == "b1" and "b1 (None), which does not" in co[0].message


def random_tokens(r, doc, n, acyclic):
    ids = [f"t{k}" for k in range(n)]
    pick = lambda k: r.choice([None, "root", "gone", *(ids[:k] if acyclic else ids)])
    return [tok(doc, k, i, unit=r.choice([None, None, i]), r1=pick(k), l1=r.choice(["subject", "genitive", "ablative absolute"]), r2=r.choice([None, pick(k)]), l2="coordinating conjunction") for k, i in enumerate(ids)]


def test_units_random(spark):
    r = random.Random(8)
    docs = {f"d{k}": random_tokens(r, f"d{k}", 12, k % 2 == 0) for k in range(30)}
    got = {(x.doc_id, x.id): x.unit_id for x in resolved(spark, [t for d in docs.values() for t in d]).collect()}
    for d, toks in docs.items():
        want = units_by_recursion(toks)
        assert {i: got[d, i] for i in want} == want, d


def test_rounds_equal_one_task(spark):
    """Documents too large for one task are resolved by joins, with the same result where there are no loops."""
    r = random.Random(4)
    toks = [t for k in range(3) for t in random_tokens(r, f"d{k}", 14, True)] + passage()
    cols = ["doc_id", "id", "unit_id", "is_anchor", "parent", "depth", "problem"]
    assert rows(resolved(spark, toks, whole_doc_rows=1).select(cols)) == rows(resolved(spark, toks).select(cols))


def test_rounds_equal_one_task_on_loops(spark):
    """Both ways give the same on loops: the value a loop reaches, the token that stays without one, where a cycle is told."""
    r = random.Random(12)
    toks = [tok("l", 0, "a", r1="b"), tok("l", 1, "b", r1="a", r2="c"), tok("l", 2, "c", unit="c", r1="root")] + [t for k in range(12) for t in random_tokens(r, f"d{k}", 9, False)]
    cols = ["doc_id", "id", "unit_id", "is_anchor", "parent", "depth", "problem"]
    large = resolved(spark, toks, whole_doc_rows=1).select(cols).cache()
    assert [x.unit_id for x in large.where("doc_id = 'l'").orderBy("id").collect()] == ["c", "c", "c"]
    assert rows(large) == rows(resolved(spark, toks).select(cols))


def test_rounds_on_long_chains(spark):
    """A chain of thousands takes a logarithm of joins; dead ends behind each other and fallbacks are told apart."""
    n = 300
    toks = [tok("c", 0, "t0", unit="t0", r1="root")] + [tok("c", k, f"t{k}", r1=f"t{k - 1}") for k in range(1, n)]
    toks += [tok("x", 0, "dead", r1=None)] + [tok("x", k, f"d{k}", r1=f"d{k - 1}" if k > 1 else "dead") for k in range(1, 12)] + [tok("x", 90, "alive", unit="u", r1="root"), tok("x", 91, "both", r1="d11", r2="alive"), tok("x", 92, "after", r1="both")]
    cols = ["doc_id", "id", "unit_id", "is_anchor", "parent", "depth", "problem"]
    got = resolved(spark, toks, whole_doc_rows=1).select(cols).cache()
    assert got.where("doc_id = 'c' and unit_id = 't0'").count() == n and {x.id: x.unit_id for x in got.where("unit_id = 'u'").collect()} == {"alive": "u", "both": "u", "after": "u"}
    assert rows(got) == rows(resolved(spark, toks).select(cols))


def test_documents_over_batches(spark):
    """Documents that go on over Arrow batches are resolved as wholes, and all columns are kept."""
    r = random.Random(21)
    toks = [t for k in range(30) for t in random_tokens(r, f"d{k}", 9, True)]
    want = rows(resolved(spark, toks))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert rows(resolved(spark, toks)) == want and len(want) == len(toks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_extra_columns(spark):
    empty = G.latest(graph(spark, []))
    assert G.resolve(empty).count() == 0 and R.surface_text(empty).count() == 0 and G.edge_triples(empty).count() == 0
    extra = G.latest(graph(spark, passage())).withColumns({"block": F.lit(1), "n": F.lit(2), "value": F.lit("v")})
    assert R.surface_text(extra).count() == 1 and G.resolve(extra).count() == 12


def test_scan_chunks(spark):
    r = random.Random(6)
    data = [(r.choice(["a", "b", None]), k, r.choice([None, 1, 2]), r.choice([None, "x", "y"])) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id string, pos int, v int, s string")
    got = {(x.doc_id, x.pos): (x.total, x.prior) for x in scan(df, sums={"total": F.coalesce("v", F.lit(0))}, lasts={"prior": F.col("s")}, chunk=4).collect()}
    for key in ("a", "b", None):
        total, prior = 0, None
        for d, p, v, s in data:
            if d == key:
                total += v or 0
                assert got[d, p] == (total, prior)
                prior = s or prior


def test_validate(spark):
    tokens = spark.createDataFrame([("d", "t0"), ("d", "t1"), ("d", "root")], "doc_id string, id string")
    g = G.latest(graph(spark, [tok("d", 0, "t0", None), tok("d", 1, "t1", "a", "implied sum"), tok("d", 2, "zz", "b", r1="nope", r2="root"), tok("d", 3, "new", None, "implied sum")]))
    units = spark.createDataFrame([("d", 0, "new"), ("d", 1, "lost")], "doc_id string, vu_pos int, id string")
    told = C.validate(tokens, g, units)
    assert [x.code for x in told.orderBy("phase", "ord", "sub").collect()] == ["root_id", "no_text", "reused_id", "implied_text", "unknown_id", "unknown_target", "unknown_unit"]
    with pytest.raises(ValueError, match="'root' is reserved"):
        C.raise_first(told)
    assert rows(C.missing_tokens(tokens, g)) == [("d", "root")]
    assert C.illegal_fields(G.latest(graph(spark, [tok("d", 0, "t0", "a|b"), tok("d", 1, "t1", "a\nb")])), ["text", "lemma"]).count() == 2


TOKENS = "doc_id string, sent_idx int, pos int, id string, text string, citation string"
UNITS = "doc_id string, vu_pos int, id string, syntactic_type string, semantic_type string"


def analysis(spark, doc="p"):
    toks = passage(doc)
    real = [t for t in toks if t[4] != "implied sum"]
    tokens = spark.createDataFrame([(doc, int(k > 6), k, t[3], t[5], "1.1" if k < 4 else None) for k, t in enumerate(real)], TOKENS)
    units = spark.createDataFrame([(doc, 0, "t6", "independent", "intransitive"), (doc, 1, "t3", "dependent", "intransitive")], UNITS)
    return tokens, units, G.latest(graph(spark, toks))


def test_round_trip(spark, tmp_path):
    tokens, units, g = analysis(spark)
    assert C.contiguity(tokens, g).count() == 0 and sinks.analysis_warnings(tokens, units, g).count() == 0
    content = sinks.serialise(tokens, units, g).first().content
    path = tmp_path / "a.txt"
    path.write_text(content, encoding="utf-8")
    g2, u2, s2 = blocks.read_analyses(spark, str(path))
    assert [(x.id, x.text, x.verbalunit, x.related1, x.context) for x in g2.orderBy("pos").collect()][:4] == [("t0", "Puer", None, "t6", "1.1"), ("t1", "(", None, None, "1.1"), ("t2", "cum", None, "t6", "1.1"), ("t3", "luceret", "t3", "t2", "1.1")]
    assert u2.count() == 2 and [(x.first_id, x.last_id) for x in s2.orderBy("sent_idx").collect()] == [("t0", "t6"), ("t7", "t10")]
    slices, of = C.split_by_sentence(tokens, g, units)
    assert slices.count() == 12 and of.count() == 2
    with pytest.raises(ValueError, match="bar or a line break"):
        sinks.serialise(tokens, units, g.withColumn("text", F.lit("a|b")))
    shuffled = tokens.withColumn("pos", -F.col("pos"))
    assert C.contiguity(shuffled, g).count() == 2
    sinks.write_files(sinks.serialise(tokens, units, g), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first().value.startswith("#!sentences\n")


def codes(spark, read, texts):
    """For each text the codes of its problems in order; all texts are read in one go."""
    lines = blocks.lines_of(spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "k string, v string"), "k", "v")
    got = [(x.doc_id, x.code) for x in read(lines)[-1].orderBy("doc_id", "phase", "ord", "sub").collect()]
    return [[c for d, c in got if d == f"f{k}"] for k in range(len(texts))]


HEAD = {k: f"{k}\n{v}\n" for k, v in blocks.ANALYSIS.items()}


def test_analysis_problems(spark):
    s, u, t = HEAD["#!sentences"], HEAD["#!verbal_units"], HEAD["#!tokens"]
    good = "|t0|lexical|a||||||\n"
    cases = {
        t + good + u + s: [],
        s + u + t: [],
        t + good + t + good + u + s: ["duplicate_id"],
        "x|y\n" + t + u + s: ["stray"],
        t + u: ["missing_block"],
        t + u + "#!sentences\n": ["no_header"],
        "#!tokens\n" + u + t + s: ["no_header"],
        "#!tokens\nid\n" + u + s: ["header"],
        t + "|t0|odd|a||||||\n||lexical|a||||||\n|x\n" + u + s: ["bad_value", "no_id", "columns"],
        t + good + u + "1|t0|dependent|intransitive\n|t9|dependent|intransitive\n|t0|odd|intransitive\n" + s: ["context", "unknown_id", "bad_value"],
        t + good + "|t1|lexical|b||||||\n" + u + s + "|t1||t0\n||||\n|t0|9|t1\n|t0||t7\n": ["order", "columns", "context", "unknown_id"],
    }
    assert codes(spark, blocks.analyses, list(cases)) == list(cases.values())


def test_passage_problems(spark, tmp_path):
    h = "#!ctsdata\nurn|text\n"
    cases = {
        h + "urn:cts:a:b:1|x\n\n" + h + "urn:cts:a:b:2|y": [],
        h: [],
        "": ["missing_block"],
        h + "a|b|c\n|x\nurn:cts:a:b:1|\nurn:cts:b|x\nurn:cts:a:b:|x\n": ["columns", "no_urn", "no_text", "urn_parts", "no_citation"],
        "x|y\n#!ctsdata\n#!ctsdata\nurn;text\n": ["stray", "no_header", "header"],
        h + "urn:cts:a:b:1|x\u0085urn:cts:a:b:2|y": [],  # U+0085 is a line break for the reader
    }
    assert codes(spark, blocks.passages, list(cases)) == list(cases.values())
    lines = blocks.lines_of(spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(cases)], "k string, v string"), "k", "v")
    assert sorted(x.path for x in blocks.passages(lines)[0].collect()) == ["f0", "f0", "f5", "f5"]
    (tmp_path / "bad.cex").write_text("#!ctsdata\n", encoding="utf-8")
    with pytest.raises(ValueError, match="too early"):
        blocks.read_passages(spark, str(tmp_path / "bad.cex"))


def test_metric(spark):
    _, units, g = analysis(spark)
    one = lambda df: [round(x, 4) for x in df.drop("doc_id").first()]
    assert one(M.scores(g, g, units, units)) == [1, 1, 1, 1]
    assert M.feedback(M.scores(g, g, units, units), M.problems(g, g, units, units)).first().feedback.startswith("Perfect match")
    swapped = g.select("doc_id", "id", "pos", "tokentype", "text", "lemma", "verbalunit", F.col("related2").alias("related1"), F.col("relationship2").alias("relationship1"), F.col("related1").alias("related2"), F.col("relationship1").alias("relationship2"))
    assert one(M.scores(g, swapped, units, units))[1] == 1
    less, more = g.where("id <> 't8'"), g.withColumn("related2", F.when(F.col("id") == "t0", "t8")).withColumn("relationship2", F.when(F.col("id") == "t0", "genitive"))
    assert one(M.scores(g, less, units, units))[:2] == [round(22 / 24, 4), round(6 / 7, 4)]
    assert one(M.scores(g, more, units, units))[1] == round(7 / 8, 4)
    nothing = M.scores(g, g.limit(0), units, units.limit(0))
    assert one(nothing) == [0, 0, 0, 0]
    assert {x.code for x in M.problems(g, less, units, units.where("id = 't6'")).collect()} == {"missing_token", "missing_relation", "missing_unit"}
    twice = g.unionByName(g.where("id = 't0'").withColumn("pos", F.lit(99)).withColumn("tokentype", F.lit("numeral")))
    assert one(M.scores(g, twice, units, units))[0] == 1 and M.problems(g, twice, units, units).first().code == "repeated_id"
    s = M.summary(M.scores(g, g, units, units).unionByName(spark.createDataFrame([("failed", None, None, None, None)], "doc_id string, field_score double, relation_score double, vu_score double, score double"))).first()
    assert s.n == 2 and s.mean == 0.5 and s.min == 0


def test_board(spark, tmp_path):
    base = {c: None for c in L.COLUMNS}
    row = lambda label, stage, mean: tuple({**base, "label": label, "provider": "p", "stage": stage, "mean": mean}.values())
    old = spark.createDataFrame([row("a", "baseline", 0.1), row("z", "gepa", 0.2)], L.SCHEMA)
    new = spark.createDataFrame([row("a", "baseline", 0.9), row("b", "gepa", 0.3), row("b", "baseline", 0.4)], L.SCHEMA)
    board = L.upsert(old, new, spark.createDataFrame([("b", 0), ("a", 1)], "label string, rank int"))
    assert [(x.label, x.stage, x.mean) for x in board.orderBy("order_key").collect()] == [("b", "baseline", 0.4), ("b", "gepa", 0.3), ("a", "baseline", 0.9), ("z", "gepa", 0.2)]
    L.write_board(board, str(tmp_path / "board"))
    assert L.read_board(spark, str(tmp_path / "board")).count() == 4 and L.read_board(spark, str(tmp_path / "none")).count() == 0
    gate = {x.label: x.go for x in L.gate(new, old, 0.5).collect()}
    assert gate == {"a": True, "b": False}
    ex = spark.createDataFrame([("s1",), ("s2",)], "slug string")
    train, held = L.split(ex, ex.where("slug = 's2'"))
    assert rows(train) == [("s1",)] and rows(held) == [("s2",)]
    with pytest.raises(RuntimeError):
        L.split(ex, spark.createDataFrame([("s9",)], "slug string"))


def test_budget(spark, tmp_path):
    assert B.estimate(0) == 700 and B.estimate(1000) == 8192 and B.estimate(3, floor=2000) == 2000
    with pytest.raises(ValueError):
        B.estimate(-1)
    assert B.calibration(str(tmp_path / "no.json"))["source"] == "fallback"
    (tmp_path / "c.json").write_text('{"intercept": 1, "slope": 2}')
    assert B.calibration(str(tmp_path / "c.json"))["slope"] == 2.0
    df = spark.createDataFrame([(0,), (10,), (-1,), (None,)], "n int")
    assert [x.b for x in df.select(B.budget(F.col("n")).alias("b")).collect()] == [700, B.estimate(10), None, None]
    pts = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.5)], "x double, y double")
    fit = B.fit_strict(pts, "x", "y")
    assert abs(fit["slope"] - 2.25) < 1e-9 and fit["sample_size"] == 3 and abs(fit["max_residual"] - 1 / 6) < 1e-9
    with pytest.raises(ValueError):
        B.fit_strict(pts.limit(1), "x", "y")


def test_segment_and_analyse(spark):
    src = spark.createDataFrame([("d", 0, "1.1", "M. Tullius venit. Cum"), ("d", 1, "1.2", "luna luceret, cantat! Tune vides?"), ("d", 1, "1.2", "luna luceret, cantat! Tune vides?"), ("e", 0, "", None)], "doc_id string, unit_pos int, citation string, text string")
    t = S.segment(src)
    got = t.where("doc_id = 'd'").orderBy("pos").collect()
    assert [x.text for x in got][:4] == ["M.", "Tullius", "venit", "."] and [x.id for x in got] == [f"t{k}" for k in range(len(got))]
    assert [x.sent_idx for x in got] == [0] * 4 + [1] * 6 + [2] * 3 and got[5].citation == "1.2"
    assert rows(S.token_rows(S.sentence_arrays(t)).select("doc_id", "sent_idx", "id")) == rows(t.select("doc_id", "sent_idx", "id"))
    assert [x for x, _ in S.rule_segments([("", "Videsne arma virumque? Itaque?")], True)[0]] == ["Vides", "ne", "arma", "virum", "que", "?"]
    g = A.combined(A.analyse(t, A.canned({})))
    assert g.count() == t.count() and [x.id for x in g.where("doc_id = 'd'").orderBy("pos").collect()][:3] == ["t0", "t1", "t2"]
    assert S.as_source(spark, "abc").first().text == "abc"
    told = A.analyse_sources(src, lambda p, ts, _: {"tokengraph": [{"id": i, "tokentype": "lexical", "text": x, "related1": "zz"} for i, x in ts], "verbalunits": [{"id": ts[0][0], "syntactic_type": "independent", "semantic_type": "transitive"}], "reasoning": p[:2]})
    assert told.results.where("doc_id = 'd'").count() == 3 and told.results.where("reasoning = 'M.'").count() == 1 and told.units.where("doc_id = 'd'").count() == 3
    assert {x.code for x in told.problems.collect()} == {"unknown_target"} and rows(told.graph.select("doc_id", "pos", "id")) == rows(t.select("doc_id", "pos", "id"))


def test_segment_by_rule_is_distributed(spark):
    """Running counts over units give what one call a document gives, enclitics included."""
    r = random.Random(3)
    words = ["Videsne", "armaque", "virum", ".", "?", "!", "Kal.", "M.", "Itaque", "silvane", "x", "?!", ""]
    units = [(f"d{k % 3}", k // 3, f"{k}", " ".join(r.choices(words, k=r.randrange(0, 9)))) for k in range(90)]
    src = spark.createDataFrame([*units, units[0], (None, 0, "", "x."), ("d0", None, "", "x.")], "doc_id string, unit_pos int, citation string, text string")
    for enclitics in (False, True):
        want = rows(S.segment_by(src, lambda u: S.rule_segments(u, enclitics)))  # noqa: B023
        assert rows(S.segment(src, enclitics)) == want and len(want) > 100
    assert S.segment(src.limit(0)).count() == 0


def test_lines_by_splits(spark, tmp_path):
    """Files read by many splits have the lines of Python's splitlines."""
    r = random.Random(5)
    texts = {f"f{k}.txt": "".join(r.choice(["a", "b|c", "\n", "\r\n", "\n\n", "é", "x" * 30, "\u2028"]) for _ in range(r.randrange(1, 300))) + "z" for k in range(4)} | {"empty.txt": "", "end.txt": "a\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = {}
        for x in blocks.read_lines(spark, str(tmp_path)).orderBy("path", "line_no").collect():
            got.setdefault(x.path.rsplit("/", 1)[1], []).append(x.line)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {n: t.splitlines() for n, t in texts.items() if t}


def test_records_of_runs(spark, tmp_path):
    """Calibration, choice, run summary, harvest, dumps and records."""
    samples = spark.createDataFrame([(1.0, 30.0, None), (2.0, 50.0, None), (3.0, 9000.0, None), (4.0, 70.0, "failed")], "num_tokens double, completion_tokens double, error string")
    record = B.calibrate(samples, str(tmp_path / "c.json"), "some/model")
    assert abs(record["slope"] - 20) < 1e-9 and record["sample_size"] == 2 and B.calibration(str(tmp_path / "c.json"))["intercept"] == record["intercept"] and "T" in record["calibrated_at"]
    with pytest.raises(ValueError):
        B.calibrate(samples.limit(1), str(tmp_path / "d.json"), "m")
    board = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "label string, rank int")
    assert [x.label for x in L.choose(board, board, limit=2).collect()] == ["b", "c"] and L.choose(board, board.where("rank > 1")).count() == 2
    files = spark.createDataFrame([("p", 0, "u"), ("p", 1, "v"), ("p", 2, "w"), ("q", 0, "u")], "path string, row_pos int, urn string")
    assert rows(L.pick(files, files.where("row_pos <> 1").orderBy(F.desc("row_pos")).select("urn"), "urn", "row_pos").select("path", "urn", "picked")) == [("p", "u", 0), ("p", "w", 1), ("q", "u", 0)]
    scored = spark.createDataFrame([("s1", 0.5, 0.5, 0.5, 0.5, None), ("s2", None, None, None, None, "ValueError: x")], "slug string, score double, field_score double, relation_score double, vu_score double, error string")
    calls = spark.createDataFrame([(1, 0.25), (2, None), (3, 0.5)], "seq int, cost double")
    run = L.run_summary(scored, calls, 12.34, since=1).first()
    assert run.problems == {"s2": "ValueError: x"} and run.n == 2 and run.n_calls == 2 and run.line == "mean=0.250  min=0.000  max=0.500  fields=0.250  relations=0.250  verbal-expr=0.250  (12.3s, 2 calls, $0.5000)"
    toks = passage()
    g = G.latest(graph(spark, toks))
    given = g.where("tokentype <> 'implied sum'").select("doc_id", F.lit(0).alias("sent_idx"), "pos", "id", "text", "context")
    units = g.where("verbalunit = id").select("doc_id", F.col("pos").alias("vu_pos"), "id", F.lit("independent").alias("syntactic_type"), F.lit("transitive").alias("semantic_type"))
    dump = R.console_dump(given, units, g).orderBy("section", "ord").collect()
    assert dump[0].line == "Tokens:" and [x.line for x in dump if x.section in (2, 4)] == ["", "Verbal expressions:", "", "Token graph:"] and len(dump) == 5 + given.count() + units.count() + g.count()
    slugs = spark.createDataFrame([("p", "slug", ["t"], None)], "doc_id string, slug string, tags array<string>, passage string")
    assert sinks.harvest(given, g, units, slugs).first().slug == "slug"
    with pytest.raises(ValueError):
        sinks.harvest(given.limit(0), g, units, slugs)
    with pytest.raises(ValueError):
        sinks.harvest(given, g.limit(0), units, slugs, skip_validation=True)
    assert sinks.harvest(given.limit(0), g, units, slugs, skip_validation=True).count() == 1
    back, told = gold_rows(sinks.sparse_examples(g, units).withColumnRenamed("doc_id", "slug"))
    cols = ["doc_id", "pos", "id", "text", "tokentype", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"]
    assert rows(back.select(cols)) == rows(g.select(cols)) and rows(told.select("id", "syntactic_type")) == rows(units.select("id", "syntactic_type"))
    assert gold_rows(spark.createDataFrame([("a", None), ("b", "no json"), ("c", "{}")], "slug string, answer string"))[0].count() == 0
    r = G.resolve(g)
    assert sinks.save_diagrams(r, G.unit_colours(r), str(tmp_path / "dia")).count() == 0 and spark.read.parquet(str(tmp_path / "dia")).first().diagram.endswith(";\n")
    s = blocks.reconstructed(g, spark.createDataFrame([("p", 0, toks[0][3], toks[3][3]), ("p", 1, toks[3][3], toks[0][3])], "doc_id string, sent_idx int, first_id string, last_id string"))
    assert [[t.id for t in x.tokens] for x in s.collect()] == [[t[3] for t in toks[:4]]]


def test_retry():
    toks = [("t0", "a"), ("t1", "b")]
    calls = []

    def cut(_, t, size):
        calls.append(size)
        return {"tokengraph": [{"id": i} for i, _ in (t if size >= 2000 else t[:1])]}

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = A.with_retry(cut, "a b", toks, initial=1000)
        assert calls == [1000, 2000] and got["missing"] == [] and len(said) == 1
        assert A.with_retry(cut, "a b", toks, initial=100, max_retries=1)["missing"] == ["t1"]
        assert A.with_retry(cut, "a b", toks, initial=8192)["attempts"] == [8192]

        def broken(*_):
            raise A.ParseFailure(truncated=False)

        with pytest.raises(A.ParseFailure):
            A.with_retry(broken, "a b", toks)


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c d e", "..x y!"), ("a b", "---"), (None, None)], "t string, f string")
    got = df.select(X.preview(F.col("t")).alias("p"), X.safe_filename(F.col("f")).alias("n")).collect()
    assert [(x.p, x.n) for x in got[:2]] == [("a b c d…", "x_y"), ("a b", "passage")]
    base, cited = X.split_urn(F.lit("urn:cts:a:b:1.2"))
    assert tuple(df.select(base, cited).first()) == ("urn:cts:a:b:", "1.2")


def test_vocabulary(spark):
    g = G.latest(graph(spark, [tok("d", 0, "a", kind="odd", r1="root", l1="unit verb", r2="b", l2="subj.")]))
    units = spark.createDataFrame([("d", 0, "a", "aside", "linking verb")], UNITS)
    cover = {(x.field, x.value): x.seen for x in G.vocabulary_coverage(g, units).collect()}
    assert len(cover) == 43 and cover["relationship", "unit verb"] == 1 and cover["relationship", "subject"] == 0 and cover["syntactic_type", "aside"] == 1
    assert rows(G.unknown_values(g)) == [("relationship", "subj.", 1), ("tokentype", "odd", 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cex").write_text("#!ctsdata\nurn|text\nurn:cts:a:b:1|x\nbad\n", encoding="utf-8")
    q = stream_passages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 1 and spark.read.parquet(str(tmp_path / "out" / "problems")).count() == 1
