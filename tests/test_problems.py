"""Orphans, rejects, hierarchies and term counts against brute force, with nulls, ties, repeats and empty tables."""

import random

from pyspark.sql import functions as F

from tests.helpers import GRAPH, at, graph, rows, tok
from vinculum.operators import hierarchy as H
from vinculum.operators import orphans as O
from vinculum.operators import rejects as R
from vinculum.operators import termcounts as T

VU = "doc_id string, vu_pos int, context string, token string, syntactic_type string, semantic_type string, loaded_at timestamp_ntz"


def orphan_cases(tokens, vus):
    rec, vrec = {}, {}
    for t in tokens:
        k = (t[0], t[3])
        old = rec.get(k, (t[12], False, set(), set()))
        rec[k] = (min(old[0], t[12]), old[1] or t[13] is not None, old[2] | {t[8]}, old[3] | {t[7]})
    for v in vus:
        if v[3] is not None:
            vrec[v[0], v[3]] = min(vrec.get((v[0], v[3]), v[6]), v[6])
    live = {k: v[0] for k, v in rec.items() if not v[1]}
    refs = [("tokengraph", d, i, f, x, v[0]) for (d, i), v in rec.items() if not v[1] for f, xs in (("related1", v[2] - {"root"}), ("verbalunit", v[3])) for x in xs if x is not None]
    refs += [("verbal_units", d, i, "token", i, t) for (d, i), t in vrec.items()]
    return sorted({(s, t.strftime("%Y-%m"), d, i, f) for s, d, i, f, x, t in refs if (d, x) not in live or live[d, x] > t}, key=repr)


def test_orphans_random(spark):
    r = random.Random(5)
    for seed in range(2):
        tokens = [tok(r.choice("ab"), k, f"t{r.randrange(60)}", unit=r.choice([None, f"t{r.randrange(70)}"]), r1=r.choice([None, "root", f"t{r.randrange(70)}"]), day=r.choice([0, 0, 0.5, 20, 40, 41]), gone=r.choice([None] * 9 + [50])) for k in range(150)]
        # copies of one record agree in their references
        seen = {}
        tokens = [t if (t[0], t[3]) not in seen and not seen.update({(t[0], t[3]): t}) else (*seen[t[0], t[3]][:12], t[12], t[13]) for t in tokens]
        vus = [("a", k, None, r.choice([None, f"t{r.randrange(80)}"]), "independent", "intransitive", at(r.choice([0, 20, 40]))) for k in range(40)]
        found = O.find_orphans(*O.token_references(graph(spark, tokens), spark.createDataFrame(vus, VU)), buckets=3)
        assert rows(found) == orphan_cases(tokens, vus), seed


def test_orphans_edges(spark):
    none = O.find_orphans(*O.token_references(spark.createDataFrame([], GRAPH), spark.createDataFrame([], VU)))
    assert none.count() == 0
    refs = spark.createDataFrame([("s", None, "a", "f", "x", at(0)), ("s", "d", "b", "f", None, at(0)), ("s", "d", "c", "f", "x", None), ("s", "d", "e", "f", "gone", None)], "src_table string, doc_id string, rec_id string, field string, target string, loaded_at timestamp_ntz")
    parents = spark.createDataFrame([("d", "x", at(9), 1), (None, "x", at(0), 1)], "doc_id string, id string, loaded_at timestamp_ntz, period int")
    # a null document matches nothing; a reference without a time is an orphan only if its parent is missing
    assert rows(O.find_orphans(refs, parents)) == [("s", "2024-01", None, "a", "f"), ("s", None, "d", "e", "f")]


def test_hot_key(spark):
    """A third of all references name one key, which comes late for half of them."""
    tokens = [tok("d", 0, "hub", day=10.5)] + [tok("d", k, f"t{k}", r1="hub", day=10 if k % 2 else 11) for k in range(1, 400)]
    found = O.find_orphans(*O.token_references(graph(spark, tokens), spark.createDataFrame([], VU)))
    assert {r.rec_id for r in found.collect()} == {f"t{k}" for k in range(1, 400, 2)}


LINES = [
    ("#!ctsdata", None), ("urn|text", None), ("urn:cts:a:b:1|Salve.", "ok"), ('urn:cts:a:b:2|"""Quid | agis?"" inquit."', "ok"), ('urn:cts:a:b:3|"open', "quoting"), ('urn:cts:a:b:4|"x"y', "quoting"),
    ("urn:cts:a:b:5|a|b", "column_count"), ("", None), ("urn:cts:a:b|x", "bad_urn"), ("urn:cts:a::6|x", "bad_urn"), ("urn:cts:a:b c:6|x", "bad_urn"), ("urn:cts:a:b:7| 　", "bad_text"), ("urn:cts:a:b:8|x�", "bad_text"), ("urn:cts:a:b:9|a \"b\" c", "ok"),
    ("#!verbal_units", None), ("context|token|syntactic_type|semantic_type", None), ("1.2|t1|dependent|intransitive", "ok"), ("|t1|dependent|intransitive", "ok"), ("1.2.3.4|t1|a|b", "bad_context"), ("#REF!|t1|a|b", "bad_context"), ("1|2", "column_count"),
    ("#!sentences", None), ("context_begin|first_token|context_end|last_token", None), ("1|t0|X|t1", "bad_context"), ("1|t0|ep.2|t1", "ok"), ('"1"|t0|1|t1', "ok"),
]


def test_rejects(spark):
    raw = [(7, k + 1, line) for k, (line, _) in enumerate(LINES)]
    raw += [raw[4], (7, None, "x"), (None, 1, "#!ctsdata"), (8, 1, "data before a label"), (8, 2, None)]
    df = spark.createDataFrame(raw, "file_id long, line_no int, line string")
    loaded, bad = R.split_rows(df)
    assert rows(bad) == sorted([(7, k + 1, why) for k, (_, why) in enumerate(LINES) if why not in (None, "ok")], key=repr)
    assert sorted(x.line_no for x in loaded.collect()) == [k + 1 for k, (_, why) in enumerate(LINES) if why == "ok"]
    passages = {x.citation: x.text for x in R.typed_block(loaded, "#!ctsdata").collect()}
    assert passages["2"] == '"Quid | agis?" inquit.' and passages["9"] == 'a "b" c'
    assert R.typed_block(loaded, "#!verbal_units").where("context is null").count() == 1


def test_rejects_chunks_and_long_fields(spark):
    """Block state crosses chunks; a long quoted field with very many quotes does not overflow."""
    body = [(1, 1, "#!ctsdata"), (1, 2, "urn|text")] + [(1, k, f"urn:cts:a:b:{k}|" + ("ok" if k % 5 else "")) for k in range(3, 200)] + [(1, 200, "urn:cts:a:b:200|" + '"' + 'a""' * 60_000 + '"')]
    df = spark.createDataFrame(body, "file_id long, line_no int, line string")
    lines = R.block_lines(df, chunk=8)
    assert lines.count() == 198
    bad = R.failures(R.parse_fields(lines))
    assert {x.line_no for x in bad.collect()} == {k for k in range(3, 200) if k % 5 == 0}
    assert R.split_rows(spark.createDataFrame([], "file_id long, line_no int, line string"))[1].count() == 0


def test_loops(spark):
    links = [("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a"), ("d", "x", "a"), ("d", "y", "x"), ("d", "s", "s"), ("e", "p", "q"), ("e", "q", "r")] + [("f", f"n{k}", f"n{k + 1}") for k in range(40)]
    df = spark.createDataFrame(links, "doc_id string, id string, parent string")
    assert rows(H.loop_nodes(df)) == [("d", "a"), ("d", "b"), ("d", "c"), ("d", "s")]
    assert H.loop_nodes(df.where("doc_id = 'zz'")).count() == 0


def test_hierarchy_random(spark):
    r = random.Random(3)
    ids = [f"n{k}" for k in range(80)]
    up = {i: r.choice(ids) for i in ids if r.random() < 0.8}
    nodes = spark.createDataFrame([("d", i) for i in ids], "doc_id string, id string")
    tree = H.hierarchy(nodes, spark.createDataFrame([("d", i, p) for i, p in up.items()], "doc_id string, id string, parent string"))

    def chain(i):
        out = [i]
        while out[-1] in up:
            if up[out[-1]] in out:
                return None
            out.append(up[out[-1]])
        return out[::-1]

    got = {x.id: x for x in tree.collect()}
    assert len(got) == len(ids)
    for i in ids:
        c = chain(i)
        assert got[i].path == (">".join(c) if c else None) and got[i].depth == (len(c) - 1 if c else None) and got[i].root == (c[0] if c else None)
        j, seen = i, []
        while j in up and j not in seen:
            seen.append(j)
            j = up[j]
        assert got[i].on_loop == (c is None and j == i)
    below = H.descendants(tree)
    want = sorted((("d", a, i, len(chain(i)) - 1 - k)) for i in ids if chain(i) for k, a in enumerate(chain(i)[:-1]))
    assert sorted(map(tuple, below.collect())) == want
    assert {x.id: x.n_descendants for x in H.descendant_counts(tree).collect()} == {a: sum(1 for w in want if w[1] == a) for a in {w[1] for w in want}}


def test_token_parents(spark):
    g = graph(spark, [tok("d", 0, "t0", r1="root", r2="t1"), tok("d", 1, "t1", r1="gone", r2="t0"), tok("d", 2, "t2", r1="t1", r2="t0"), tok("d", 2, "t2", r1="t1", r2="t0", day=3), tok("d", 3, "t3"), tok(None, 0, "t9", r1="t0"), tok("d", 4, None, r1="t0")])
    nodes, links = H.token_parents(g)
    assert nodes.count() == 4 and rows(links) == [("d", "t1", "t0"), ("d", "t2", "t1")]


def test_terms(spark):
    r = random.Random(1)
    data = [(r.choice(["d1", "d2", "d3", None]), r.choice(["a", "b", "c", "", None]), r.choice(["x", None])) for _ in range(80)]
    df = spark.createDataFrame(data, "doc_id string, lemma string, relationship1 string")
    want = {}
    for d, a, b in data:
        for f, v in (("lemma", a), ("relationship1", b)):
            if v is not None:
                want.setdefault((f, v), []).append(d)
    got = {(x.field, x.term): (x.occurrences, x.documents) for x in T.count_terms(df, ["lemma", "relationship1"]).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert T.count_terms(df.limit(0), ["lemma"]).count() == 0


def test_marks(spark):
    docs = spark.createDataFrame([(f"d{k}",) for k in range(9)], "doc_id string")
    terms = spark.createDataFrame([("f", "two", 5, 2), ("f", "third", 5, 3), ("f", "more", 5, 4)], "field string, term string, occurrences long, documents long")
    assert {x.term: x.mark for x in T.mark_terms(terms, docs).collect()} == {"two": "rare", "third": None, "more": "common"}


def test_store_equals_recount(spark, tmp_path):
    """Added, changed and deleted records in signed deltas give what counting everything again gives."""
    r = random.Random(2)
    store, state = T.TermCountStore(spark, str(tmp_path / "counts"), buckets=4), {}
    for step in range(3):
        add, drop = [], []
        for k in range(30):
            i = r.randrange(40)
            if i in state and r.random() < 0.5:
                drop.append(state.pop(i))
            new = (f"d{i % 7}", r.choice("abcde"))
            if i in state:
                drop.append(state[i])
            state[i] = new
            add.append(new)
        frame = lambda x: spark.createDataFrame(x, "doc_id string, lemma string")
        store.apply(T.record_terms(frame(add), ["lemma"]).unionByName(T.record_terms(frame(drop), ["lemma"], -1)))
        now = T.count_terms(frame(list(state.values())), ["lemma"])
        assert rows(store.terms()) == rows(now), step
    # all records of every term deleted: the terms are gone
    store.apply(T.record_terms(frame(list(state.values())), ["lemma"], -1))
    assert store.terms().count() == 0
    changes = store.apply(T.record_terms(frame([("d1", "a")]), ["lemma"]))
    assert changes.where("d_documents = 1 and d_occurrences = 1").count() == 1
    assert F is not None


def test_store_out_of_order(spark, tmp_path):
    """A deletion that comes before its addition takes it away; layers are added up, and old ones and manifests go."""
    frame = lambda x: spark.createDataFrame(x, "doc_id string, lemma string")
    store = T.TermCountStore(spark, str(tmp_path / "counts"), buckets=2, layers=2)
    store.apply(T.record_terms(frame([("d1", "a")]), ["lemma"], -1))
    assert rows(store.terms()) == [] and rows(store.pairs()) == [("lemma", "a", "d1", -1)]
    store.apply(T.record_terms(frame([("d1", "a"), ("d2", "a"), ("d2", "a")]), ["lemma"]))
    assert rows(store.terms()) == [("lemma", "a", 2, 1)]
    for k in range(4):
        store.apply(T.record_terms(frame([(f"e{k}", "b")]), ["lemma"]))
    assert rows(store.terms()) == [("lemma", "a", 2, 1), ("lemma", "b", 4, 4)] and len(store.manifest()[1]) <= 2
    assert len(list((tmp_path / "counts" / "pairs").iterdir())) <= 5 and len([m for m in (tmp_path / "counts" / "manifest").iterdir() if m.name[0] == "v"]) == 2
    store.apply(T.record_terms(frame([]), ["lemma"]))
    assert store.terms().count() == 2
