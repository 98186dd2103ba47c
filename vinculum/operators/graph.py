"""Token graphs: edges, verbal-unit assignment, subordination depth, coordination, colours."""

from __future__ import annotations


import tempfile
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinculum.operators.hierarchy import hierarchy
from vinculum.runtime import cut
from vinculum.schemas import IMPLIED, PALETTE, ROOT, vocabulary

FIELDS = ["pos", "tokentype", "text", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"]
WHOLE_DOC_ROWS = 3_000_000
MANY_ROWS = 200_000
MAX_DOUBLINGS = 64
ROUNDS = 64


def latest(tokengraph: DataFrame, extra: tuple[str, ...] = ("context",), without: tuple[str, ...] = ()) -> DataFrame:
    """One row a record (doc_id, id): its first delivery. Rows with null doc_id or id are left out, and the fields of `without`."""
    fields = [f for f in (*FIELDS, *extra) if f not in without]
    kept = tokengraph.where(F.col("doc_id").isNotNull() & F.col("id").isNotNull()).groupBy("doc_id", "id").agg(F.min_by(F.struct(*fields), "loaded_at").alias("v"))
    return kept.select("doc_id", "id", *[F.col("v")[f].alias(f) for f in fields])


def edges(graph: DataFrame) -> DataFrame:
    """doc_id, pos, src, slot, label, dst: the two relation slots as rows; slots with a null label or target give none."""
    slots = F.array(*[F.struct(F.lit(k).alias("slot"), F.col(f"relationship{k}").alias("label"), F.col(f"related{k}").alias("dst")) for k in (1, 2)])
    rows = graph.select("doc_id", "pos", F.col("id").alias("src"), F.explode(slots).alias("e")).select("doc_id", "pos", "src", "e.slot", "e.label", "e.dst")
    return rows.where(F.col("label").isNotNull() & F.col("dst").isNotNull())


def edge_triples(graph: DataFrame) -> DataFrame:
    """Distinct (doc_id, src, label, dst)."""
    return edges(graph).select("doc_id", "src", "label", "dst").distinct()


def vocabulary_coverage(graph: DataFrame, units: DataFrame) -> DataFrame:
    """field, value, seen: how often each allowed value stands in the data; a value with 0 is not covered."""
    seen = (
        edges(graph).select(F.lit("relationship").alias("field"), F.col("label").alias("value"))
        .unionByName(graph.select(F.lit("tokentype").alias("field"), F.col("tokentype").alias("value")))
        .unionByName(units.select(F.lit("syntactic_type").alias("field"), F.col("syntactic_type").alias("value")))
        .unionByName(units.select(F.lit("semantic_type").alias("field"), F.col("semantic_type").alias("value")))
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return F.broadcast(vocabulary(graph.sparkSession)).join(seen, ["field", "value"], "left").select("field", "value", F.coalesce("n", F.lit(0)).cast("long").alias("seen"))


def unknown_values(graph: DataFrame) -> DataFrame:
    """field, value, n: labels and token types outside the vocabularies."""
    used = edges(graph).select(F.lit("relationship").alias("field"), F.col("label").alias("value")).unionByName(graph.select(F.lit("tokentype").alias("field"), F.col("tokentype").alias("value")))
    return used.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(vocabulary(graph.sparkSession)), ["field", "value"], "left_anti")


def reverse_links(graph: DataFrame, label: str) -> DataFrame:
    """doc_id, id, source: the token that points at `id` by `label`; the last by (pos, slot) where there are several."""
    e = edges(graph).where((F.col("label") == label) & (F.col("dst") != ROOT))
    return e.groupBy("doc_id", "dst").agg(F.max_by("src", F.struct("pos", "slot")).alias("source")).withColumnRenamed("dst", "id")


# --- resolution inside one document, in the order the annotation scheme prescribes ---


def _depths(anchors: list, depth: dict, parent: dict) -> tuple[dict, dict]:
    """(depths, problems) of anchors in list order; depth has those of the roots, parent the governors of all others."""
    problem: dict = {}
    for a in anchors:
        path: dict = {}
        i = a
        while i not in depth and i not in path:
            path[i] = None
            if parent[i] is None:
                problem[i] = "no_governor"
                depth[i] = None
                break
            i = parent[i]
        if i in path and i not in depth:
            problem[i] = "cycle"
            depth[i] = None
        for j in reversed(path):
            if j not in depth:
                above = depth[parent[j]]
                depth[j] = None if above is None else above + 1
    return depth, problem


def _resolve_document(doc: str, rows: list[tuple]) -> list[tuple]:
    """The resolved columns for the tokens of one document, given in list order as _NEED without doc_id and pos."""
    by = {r[0]: r for r in rows}
    verb_at, participle_at = {}, {}
    for i, _, r1, l1, r2, l2 in rows:
        for r, label in ((r1, l1), (r2, l2)):
            if r is not None and r != ROOT:
                if label == "unit verb":
                    verb_at[r] = i
                elif label == "circumstantial participle":
                    participle_at[r] = i

    def candidates(i: str) -> list:
        _, _, r1, l1, r2, l2 = by[i]
        return [verb_at.get(i), participle_at.get(i) if "ablative absolute" in (l1, l2) else None, r1, r2]

    def first(known: dict, terminal, follow) -> None:  # noqa: ANN001
        """Fills `known`: depth first, the first candidate that gives a value; a token reached again gives none."""
        for r in rows:
            if r[0] in known:
                continue
            stack, open_ = [(r[0], None)], set()
            while stack:
                i, todo = stack[-1]
                if todo is None:
                    value = terminal(i)
                    if value is not None:
                        known[i] = value
                        stack.pop()
                        continue
                    open_.add(i)
                    todo = [c for c in follow(i) if c is not None and c in by]
                    stack[-1] = (i, todo)
                while todo:
                    c = todo[0]
                    if c in known:
                        if known[c] is not None:
                            known[i] = known[c]
                            break
                        todo.pop(0)
                    elif c in open_:
                        todo.pop(0)
                    else:
                        break
                if i in known or not todo:
                    known.setdefault(i, None)
                    open_.discard(i)
                    stack.pop()
                else:
                    stack.append((todo[0], None))

    units: dict = {}
    first(units, lambda i: by[i][1], candidates)
    anchors = [r[0] for r in rows if r[1] == r[0]]

    def chase(start: str | None) -> str | None:
        seen, stack = set(), [start]
        while stack:
            i = stack.pop()
            if i is None or i in seen or i not in by:
                continue
            seen.add(i)
            if by[i][1] == i:
                return i
            stack += [by[i][4], by[i][2]]
        return None

    parent = {}
    for a in anchors:
        if by[a][2] != ROOT:
            p = chase(by[a][2])
            parent[a] = p if p is not None and p != a else ((q if q != a else None) if (q := chase(by[a][4])) is not None else None)
    depth, problem = _depths(anchors, {a: 0 for a in anchors if by[a][2] == ROOT}, parent)
    return [(doc, r[0], units[r[0]], r[1] == r[0], parent.get(r[0]), depth.get(r[0]), problem.get(r[0])) for r in rows]


_NEED = ["doc_id", "id", "verbalunit", "related1", "relationship1", "related2", "relationship2"]
_RESOLVED = "unit_id string, is_anchor boolean, parent string, depth int, problem string"
_RESOLVED_ARROW = [("unit_id", pa.string()), ("is_anchor", pa.bool_()), ("parent", pa.string()), ("depth", pa.int32()), ("problem", pa.string())]
_PROBLEMS = ["no_governor", "cycle"]


def components(links: DataFrame) -> DataFrame:
    """doc_id, id, comp for every id in links (doc_id, id, other): the least id connected with it, whatever the direction.

    Large and small stars by turns, each round halving distances: every id ends as a leaf of its component's least one.
    """
    both = lambda e: e.unionByName(e.select("doc_id", F.col("id").alias("other"), F.col("other").alias("id")))
    star = links.select("doc_id", F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct()
    loose = star.where("id = other").select("doc_id", "id", F.col("id").alias("comp"))
    edges_ = cut(star.where("id <> other"))
    last = None
    while True:
        near = both(edges_)
        least = near.groupBy("doc_id", "id").agg(F.least(F.min("other"), F.col("id")).alias("m"))
        far = near.join(least, ["doc_id", "id"]).where("other > id").select("doc_id", F.col("other").alias("id"), F.col("m").alias("other")).where("id <> other").distinct()
        low = far.groupBy("doc_id", "id").agg(F.min("other").alias("m"))
        tied = far.join(low, ["doc_id", "id"]).where("other <> m").select("doc_id", F.col("other").alias("id"), F.col("m").alias("other"))
        edges_ = cut(tied.unionByName(low.select("doc_id", "id", F.col("m").alias("other"))).distinct())
        now = tuple(edges_.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "id", "other").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    leaves = edges_.select("doc_id", "id", F.col("other").alias("comp"))
    known = leaves.unionByName(edges_.select("doc_id", F.col("other").alias("id"), F.col("other").alias("comp"))).distinct()
    return known.unionByName(loose.join(known, ["doc_id", "id"], "left_anti"))


def _unit_values(rows: list[tuple]) -> dict:
    """Values of tokens (id, candidates (id, value if known)) in list order: depth first, a token reached again gives none."""
    by = {i: [(c["c"], c["value"]) for c in cs] for i, cs in rows}
    known: dict = {}
    for start in by:
        stack, open_ = [start], set()
        todo = {}
        while stack:
            i = stack[-1]
            if i in known:
                stack.pop()
                continue
            if i not in open_:
                open_.add(i)
                todo[i] = iter(by[i])
                at = None
            else:
                at = known.get(todo[i, "at"])
            while at is None and (nxt := next(todo[i], None)) is not None:
                c, at = nxt
                if at is None and c not in open_:
                    if c not in known:
                        todo[i, "at"] = c
                        stack.append(c)
                        break
                    at = known[c]
            else:
                known[i] = at
                open_.discard(i)
                stack.pop()
    return known


def _reached_values(rows: list[tuple]) -> dict:
    """Values of tokens (as `_unit_values`) each by a search of its own: the first value met in depth."""
    by = {i: [(c["c"], c["value"]) for c in cs] for i, cs in rows}
    known: dict = {}
    for start in by:
        seen, stack, value = set(), [(start, None)], None
        while stack and value is None:
            i, value = stack.pop()
            if value is None and i not in seen and known.get(i, i) is not None:
                seen.add(i)
                stack += by[i][::-1]
        known[start] = value
        if value is None:
            known.update(dict.fromkeys(seen))
    return known


def _loop_entries(rows: list[tuple]) -> dict:
    """Of anchors (id, [governor]) that lead into one loop: where the walk from the first in list order comes round."""
    by = {i: cs[0]["c"] for i, cs in rows}
    seen, i = set(), rows[0][0]
    while i not in seen:
        seen.add(i)
        i = by[i]
    return {j: "cycle" if j == i else None for j in by}


def _settle(value: np.ndarray, cands: np.ndarray, on_loops) -> np.ndarray:  # noqa: ANN001
    """Of each row of a document the row whose value it takes, -1 for none: as `resolve_rounds`, over row numbers.

    value: the row's own number on terminals, else -2. cands: four or fewer rows of candidates in order, -1 for none.
    What neither leads to a terminal nor to nothing after `ROUNDS` rounds, loops mostly, goes to `on_loops` in list order.
    """
    value, n, wide = value.copy(), len(value), len(cands)
    later = np.cumsum((cands >= 0)[::-1], axis=0, dtype=np.int8)[::-1]  # candidates from here on
    at = np.zeros(n, np.int8)
    for _ in range(ROUNDS):
        todo = np.flatnonzero(value == -2)
        moved = False
        for _ in range(wide):
            on = todo[at[todo] < wide]
            c = cands[at[on], on]
            gone = on[(c < 0) | (value[c] == -1)]
            at[gone] += 1
            moved |= len(gone) > 0
        spent = at[todo] == wide
        value[todo[spent]] = -1
        todo = todo[~spent]
        if not len(todo):
            break
        jump, forced = np.arange(n, dtype=np.int32), np.ones(n, bool)
        jump[todo] = cands[at[todo], todo]
        forced[todo] = later[at[todo], todo] == 1
        for _ in range(n.bit_length()):
            if not (value[jump[todo]] == -2).any():
                break
            forced[todo] &= forced[jump[todo]]
            jump[todo] = jump[jump[todo]]
        told = value[jump[todo]]
        sure = (told >= 0) | ((told == -1) & forced[todo])
        value[todo[sure]] = told[sure]
        if not moved and not sure.any():
            break
    todo = np.flatnonzero(value == -2)
    if len(todo):
        left = ((i, [int(c) for c in cands[:, i] if c >= 0 and value[c] != -1]) for i in todo.tolist())
        known = on_loops([(i, [{"c": c, "value": int(value[c]) if value[c] >= 0 else None} for c in cs]) for i, cs in left])
        value[todo] = [-1 if (v := known[i]) is None else v for i in todo.tolist()]
    return value


def _resolve_long(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """As `_resolve_document` over the rows of one long document: by row numbers instead of rows as objects, about 110 bytes a row."""
    n = rows.num_rows
    ids = rows.column("id").combine_chunks()
    own, related, label = rows.column("verbalunit"), [rows.column("related1"), rows.column("related2")], [rows.column("relationship1"), rows.column("relationship2")]
    true = lambda x: x.fill_null(False).to_numpy()
    to = [pc.index_in(r, value_set=ids).fill_null(-1).to_numpy() for r in related]
    root = [true(pc.equal(r, ROOT)) for r in related]

    def pointing(name: str) -> np.ndarray:
        """The last row that points at each row by a label, -1 for none."""
        last = np.full(n, -1, np.int32)
        for r, none, la in zip(to, root, label):
            src = np.flatnonzero(true(pc.equal(la, name)) & ~none & (r >= 0))
            np.maximum.at(last, r[src], src.astype(np.int32))
        return last

    absolute = true(pc.equal(label[0], "ablative absolute")) | true(pc.equal(label[1], "ablative absolute"))
    number = np.arange(n, dtype=np.int32)
    unit = _settle(np.where(own.is_valid().to_numpy(), number, -2), np.stack([pointing("unit verb"), np.where(absolute, pointing("circumstantial participle"), -1), *to]), _unit_values)
    anchor = true(pc.equal(own, rows.column("id")))
    reach = _settle(np.where(anchor, number, -2), np.stack(to), _reached_values)
    up = [np.where(r >= 0, reach[r], -1) for r in to]
    up = [np.where(u == number, -1, u) for u in up]
    up = np.where(anchor & ~root[0], np.where(up[0] >= 0, up[0], up[1]), -1)
    anchors = np.flatnonzero(anchor).tolist()
    depth, problem = _depths(anchors, {a: 0 for a in np.flatnonzero(anchor & root[0]).tolist()}, dict(zip(anchors, (None if p < 0 else p for p in up[anchor].tolist()))))
    deep, said = np.full(n, -1, np.int32), np.full(n, -1, np.int8)
    deep[anchors] = [-1 if (x := depth[a]) is None else x for a in anchors]
    said[list(problem)] = [_PROBLEMS.index(x) for x in problem.values()]
    nulls = lambda x: pa.array(x, mask=x < 0)
    own = own.combine_chunks()
    start = 0
    for batch in rows.to_batches():
        here = slice(start, start := start + batch.num_rows)
        told = [own.take(nulls(unit[here])), pa.array(anchor[here]), ids.take(nulls(up[here])), nulls(deep[here]), pa.array(_PROBLEMS).take(nulls(said[here]))]
        for (name, _), values in zip(_RESOLVED_ARROW, told):
            batch = batch.append_column(name, values)
        yield batch


class _Spool:
    """The rows of one long document in a file without a name; read back by mapping it, so that they need no memory."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        self.doc, schema = batches[0].column("doc_id")[0], batches[0].schema
        self.file = tempfile.NamedTemporaryFile()
        self.out = pa.ipc.new_file(self.file.name, schema)
        for b in batches:
            self.out.write_batch(b)

    def told(self) -> Iterator[pa.RecordBatch]:
        self.out.close()
        with self.file, pa.memory_map(self.file.name) as mapped:
            yield from _resolve_long(pa.ipc.open_file(mapped).read_all())


def _resolve_sorted(batches: Iterator[pa.RecordBatch], many_rows: int = MANY_ROWS) -> Iterator[pa.RecordBatch]:
    """Adds the resolved columns, document by document, to rows sorted by doc_id and pos; a document may go on over batches.

    Of a document of more than `many_rows` rows only numbers are kept in memory.
    """

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, each in groupby(zip(*(rows.column(c).to_pylist() for c in _NEED)), key=lambda r: r[0]):
            out += [r[2:] for r in _resolve_document(doc, [r[1:] for r in each])]
        for (name, kind), values in zip(_RESOLVED_ARROW, zip(*out)):
            rows = rows.append_column(name, pa.array(values, kind))
        yield from rows.combine_chunks().to_batches()

    open_: list[pa.RecordBatch] = []
    long: _Spool | None = None
    for batch in batches:
        if long is not None:
            more = pc.sum(pc.equal(batch.column("doc_id"), long.doc)).as_py() or 0
            long.out.write_batch(batch.slice(0, more))
            if more == batch.num_rows:
                continue
            yield from long.told()
            long, batch = None, batch.slice(more)
        if not batch.num_rows:
            continue
        docs = batch.column("doc_id")
        last = pc.index(docs, docs[-1]).as_py()  # the rows before that of the batch's last document are whole
        if last or (open_ and open_[-1].column("doc_id")[0] != docs[0]):
            open_.append(batch.slice(0, last))
            yield from told(pa.Table.from_batches([b for b in open_ if b.num_rows]))
            open_ = []
        open_.append(batch.slice(last))
        if sum(b.num_rows for b in open_) > many_rows:
            long, open_ = _Spool(open_), []
    if long is not None:
        yield from long.told()
    if open_:
        yield from told(pa.Table.from_batches(open_))


def _by_component(pending: DataFrame, values) -> DataFrame:  # noqa: ANN001
    """doc_id, id, value: `values` over each component of pending (doc_id, id, pos, cs), in list order.

    cs: candidates (c, value) in order; those without value are pending as well.
    """
    links = pending.select("doc_id", "id", F.explode("cs").alias("c")).where("c.value is null").select("doc_id", "id", F.col("c.c").alias("other"))
    sorted_ = pending.join(components(links), ["doc_id", "id"]).repartition("doc_id", "comp").sortWithinPartitions("doc_id", "comp", "pos").select("doc_id", "comp", "id", "cs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.string()), ("id", pa.string()), ("value", pa.string())])

        def told(key: tuple, rows: list) -> pa.RecordBatch:
            v = values(rows)
            ids = [i for i, _ in rows]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array([v[i] for i in ids], pa.string())], schema=schema)

        key, rows = None, []
        for batch in batches:
            for d, comp, i, cs in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, comp) != key:
                    if rows:
                        yield told(key, rows)
                    key, rows = (d, comp), []
                rows.append((i, cs))
        if rows:
            yield told(key, rows)

    return sorted_.mapInArrow(run, "doc_id string, id string, value string")


def _follow(pending: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id, id, value, forced for the pending tokens whose first candidates lead to a settled token, by pointer doubling.

    value: the settled token's; forced: no token on the way there had another candidate left.
    """
    nothing = F.lit(None).cast("string")
    live = cut(pending.select("doc_id", "id", F.col("cands")[0].alias("jump"), (F.size("cands") == 1).alias("forced")))
    ends = done.select("doc_id", F.col("id").alias("jump"), nothing.alias("next"), F.lit(True).alias("over"), "value", F.lit(True).alias("far"))
    out = live.select("doc_id", "id", nothing.alias("value"), "forced").limit(0)
    for _ in range(MAX_DOUBLINGS):
        on = live.select("doc_id", F.col("id").alias("jump"), F.col("jump").alias("next"), F.lit(False).alias("over"), nothing.alias("value"), F.col("forced").alias("far"))
        step = cut(live.join(ends.unionByName(on), ["doc_id", "jump"]).select("doc_id", "id", F.col("next").alias("jump"), (F.col("forced") & F.col("far")).alias("forced"), "over", "value"))
        told = step.where("over")
        if told.isEmpty():
            return out
        out = out.unionByName(told.select("doc_id", "id", "value", "forced"))
        ends = ends.unionByName(told.select("doc_id", F.col("id").alias("jump"), nothing.alias("next"), F.lit(True).alias("over"), "value", F.col("forced").alias("far")))
        live = step.where("not over").select("doc_id", "id", "jump", "forced")
    raise RuntimeError("chains of candidates not followed to their ends")


def resolve_rounds(nodes: DataFrame, on_loops=_unit_values, max_rounds: int = 1000) -> DataFrame:  # noqa: ANN001
    """doc_id, id, value: first non-null along ordered candidates, for documents too large for one task.

    nodes: doc_id, id, pos, value (set on terminals), cands (ids in order). First candidates are followed to their ends by
    pointer doubling, so a chain of any length takes a logarithm of joins. A token takes the value that its first candidate
    leads to; it has none where each on the way has no other candidate; and it drops a first candidate known to have
    none. A round is as many joins as the longest chain has doublings; there are as many rounds as drops behind each
    other, and an error after `max_rounds`. Where nothing moves any more, the rest are loops and what waits for them:
    `on_loops` settles each component of them in list order, as it would be within the whole document.
    """
    ids = nodes.select("doc_id", F.col("id").alias("c"))
    open_ = nodes.where(F.col("value").isNull())
    known = open_.select("doc_id", "id", "pos", F.posexplode("cands").alias("prio", "c")).where("c is not null").join(ids, ["doc_id", "c"]).groupBy("doc_id", "id").agg(F.first("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("prio", "c"))).alias("cs"))
    pending = cut(known.select("doc_id", "id", "pos", F.col("cs.c").alias("cands")))
    done = cut(nodes.where(F.col("value").isNotNull()).select("doc_id", "id", "value").unionByName(open_.join(pending, ["doc_id", "id"], "left_anti").select("doc_id", "id", "value")))
    for _ in range(max_rounds):
        told = cut(_follow(pending, done).where("value is not null or forced").select("doc_id", "id", "value"))
        done = done.unionByName(told)
        none = done.where("value is null").select("doc_id", F.col("id").alias("c"), F.lit(True).alias("none"))
        left = pending.join(told.select("doc_id", "id"), ["doc_id", "id"], "left_anti").withColumn("c", F.col("cands")[0]).join(none, ["doc_id", "c"], "left")
        step = cut(left.select("doc_id", "id", "pos", F.when(F.col("none"), F.slice("cands", 2, 1 << 20)).otherwise(F.col("cands")).alias("cands"), F.coalesce("none", F.lit(False)).alias("dropped")))
        spent = step.where("size(cands) = 0")
        done = done.unionByName(spent.select("doc_id", "id", F.lit(None).cast("string").alias("value")))
        pending = step.where("size(cands) > 0").select("doc_id", "id", "pos", "cands")
        if step.where("dropped").isEmpty():
            break
    else:
        raise RuntimeError(f"candidates not settled after {max_rounds} rounds")
    if not pending.isEmpty():
        each = pending.select("doc_id", "id", "pos", F.posexplode("cands").alias("prio", "c")).join(done.select("doc_id", F.col("id").alias("c"), F.struct("value").alias("hit")), ["doc_id", "c"], "left")
        some = each.where("hit is null or hit.value is not null").groupBy("doc_id", "id").agg(F.first("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("prio", "c", F.col("hit.value").alias("value")))).alias("cs"))
        done = cut(done.unionByName(_by_component(some, on_loops)))
    return done


def _resolve_large(graph: DataFrame) -> DataFrame:
    verb, part = reverse_links(graph, "unit verb").withColumnRenamed("source", "verb"), reverse_links(graph, "circumstantial participle").withColumnRenamed("source", "part")
    absolute = F.coalesce(F.col("relationship1") == "ablative absolute", F.lit(False)) | F.coalesce(F.col("relationship2") == "ablative absolute", F.lit(False))
    g = cut(graph.join(verb, ["doc_id", "id"], "left").join(part, ["doc_id", "id"], "left"))
    units = resolve_rounds(g.select("doc_id", "id", "pos", F.col("verbalunit").alias("value"), F.array("verb", F.when(absolute, F.col("part")), "related1", "related2").alias("cands")))
    anchor = F.coalesce(F.col("verbalunit") == F.col("id"), F.lit(False))
    reach = resolve_rounds(g.select("doc_id", "id", "pos", F.when(anchor, F.col("id")).alias("value"), F.array("related1", "related2").alias("cands")), _reached_values)
    anchors = g.where(anchor).select("doc_id", "id", "pos", "related1", "related2")
    for k in (1, 2):
        anchors = anchors.join(reach.select("doc_id", F.col("id").alias(f"related{k}"), F.col("value").alias(f"p{k}")), ["doc_id", f"related{k}"], "left")
    up = F.when(F.col("related1") != ROOT, F.coalesce(F.when(F.col("p1") != F.col("id"), F.col("p1")), F.when(F.col("p2") != F.col("id"), F.col("p2")))).otherwise(F.when(F.col("related1").isNull() & (F.col("p2") != F.col("id")), F.col("p2")))
    anchors = cut(anchors.select("doc_id", "id", "pos", (F.col("related1") == ROOT).alias("is_root"), up.alias("parent")))
    tree = hierarchy(anchors.select("doc_id", "id"), anchors.where("parent is not null").select("doc_id", "id", "parent"))
    roots = anchors.where("is_root").select("doc_id", F.col("id").alias("root"), F.lit(True).alias("good"))
    deep = tree.join(roots, ["doc_id", "root"], "left").select("doc_id", "id", F.when(F.col("good"), F.col("depth")).alias("depth"))
    round_ = cut(anchors.join(tree.where("on_loop or into_loop").select("doc_id", "id"), ["doc_id", "id"]).select("doc_id", "id", "pos", F.array(F.struct(F.col("parent").alias("c"), F.lit(None).cast("string").alias("value"))).alias("cs")))
    cycle = cut(_by_component(round_, _loop_entries)).withColumnRenamed("value", "cycle") if not round_.isEmpty() else round_.select("doc_id", "id", F.lit(None).cast("string").alias("cycle"))
    told = anchors.join(deep, ["doc_id", "id"]).join(cycle, ["doc_id", "id"], "left").select("doc_id", "id", "parent", "depth", F.when(F.col("cycle").isNotNull(), F.col("cycle")).when(~F.coalesce("is_root", F.lit(False)) & F.col("parent").isNull(), "no_governor").alias("problem"), F.lit(True).alias("is_anchor"))
    return units.withColumnRenamed("value", "unit_id").join(told, ["doc_id", "id"], "left").select("doc_id", "id", "unit_id", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), "parent", F.col("depth").cast("int"), "problem")


def resolve(graph: DataFrame, whole_doc_rows: int = WHOLE_DOC_ROWS, many_rows: int = MANY_ROWS) -> DataFrame:
    """The graph with unit_id, is_anchor, parent, depth, problem.

    unit_id: the verbal unit of each token, the first that resolves of: its own; that of the verb pointing at it by
    `unit verb`; if it is an ablative absolute, that of the participle pointing at it; that of related1; that of related2.
    parent and depth (anchors only): the governing anchor and the number of anchors above; 0 where related1 is `root`;
    null, with problem `cycle` or `no_governor` where it starts, if no root is reached.

    Documents of up to `whole_doc_rows` rows are resolved each in one task, in list order, so that its memory has a bound:
    those of more than `many_rows` by row numbers, their rows in a file. Larger ones by pointer doubling over all tasks, with the same result. Duplicate ids must have been removed (`latest`).
    """
    schema = T.StructType([*graph.schema.fields, *T.StructType.fromDDL(_RESOLVED).fields])
    whole = lambda df: df.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(partial(_resolve_sorted, many_rows=many_rows), schema)
    large = cut(graph.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole_doc_rows).select("doc_id"))
    if large.isEmpty():
        return whole(graph)
    big = cut(graph.join(large, "doc_id", "left_semi"))
    return whole(graph.join(large, "doc_id", "left_anti")).unionByName(big.join(_resolve_large(big.select(*_NEED, "pos")), ["doc_id", "id"]).select(*schema.names))


def unit_sizes(resolved: DataFrame) -> DataFrame:
    """doc_id, unit_id, tokens, lexical for each verbal unit."""
    return resolved.where("unit_id is not null").groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tokentype") == "lexical").alias("lexical"))


def depth_warnings(resolved: DataFrame) -> DataFrame:
    """doc_id, anchor, code, message for anchors whose depth could not be told."""
    a = F.concat(F.lit("'"), F.col("id"), F.lit("'"))
    cycle = F.concat(F.lit("cycle detected resolving the governing verbal expression for "), a, F.lit(" -- leaving its depth (and its parent's) unresolved"))
    none = F.concat(F.lit("could not find a governing verbal expression for "), a, F.lit(" -- leaving its depth unresolved"))
    return resolved.where("problem is not null").select("doc_id", F.col("id").alias("anchor"), F.col("problem").alias("code"), F.when(F.col("problem") == "cycle", cycle).otherwise(none).alias("message"))


def max_depth(resolved: DataFrame) -> DataFrame:
    """doc_id, max_depth: the greatest depth of any anchor, null where none has one."""
    return resolved.groupBy("doc_id").agg(F.max("depth").alias("max_depth"))


def unanchored_coordination(graph: DataFrame) -> DataFrame:
    """doc_id, pos, conjunction, anchored, unanchored, message: two-sided coordinations of which just one side is an anchor.

    Of several conjunctions with the same two targets the first counts.
    """
    co = "coordinating conjunction"
    two = graph.where((F.col("related1") != ROOT) & (F.col("related2") != ROOT) & (F.col("relationship1") == co) & (F.col("relationship2") == co))
    one = two.groupBy("doc_id", "related1", "related2").agg(F.min_by(F.struct("pos", "id", "text"), "pos").alias("t")).select("doc_id", "related1", "related2", "t.*")
    side = graph.select("doc_id", "id", "text", F.coalesce(F.col("verbalunit") == F.col("id"), F.lit(False)).alias("is_anchor"))
    for k in (1, 2):
        one = one.join(side.select("doc_id", F.col("id").alias(f"related{k}"), F.struct("text").alias(f"text{k}"), F.col("is_anchor").alias(f"anchor{k}")), ["doc_id", f"related{k}"], "left").withColumn(f"anchor{k}", F.coalesce(f"anchor{k}", F.lit(False)))
    name = lambda k: F.when(F.col(f"text{k}").isNotNull(), F.coalesce(F.concat(F.lit("'"), F.col(f"text{k}.text"), F.lit("'")), F.lit("None"))).otherwise(F.concat(F.lit("'"), F.col(f"related{k}"), F.lit("'")))
    odd = one.where("anchor1 <> anchor2")
    yes, no = F.when(F.col("anchor1"), F.col("related1")).otherwise(F.col("related2")), F.when(F.col("anchor1"), F.col("related2")).otherwise(F.col("related1"))
    yes_text, no_text = F.when(F.col("anchor1"), name(1)).otherwise(name(2)), F.when(F.col("anchor1"), name(2)).otherwise(name(1))
    own = F.coalesce(F.concat(F.lit("'"), F.col("text"), F.lit("'")), F.lit("None"))
    message = F.concat(
        F.col("id"), F.lit(" ("), own, F.lit(") coordinates "), yes, F.lit(" ("), yes_text, F.lit("), which anchors its own verbal unit, with "), no, F.lit(" ("), no_text,
        F.lit("), which does not -- if this conjunction is meant to join two verbal expressions (rather than a noun/adjective/prepositional-phrase pair), "), no, F.lit(" is likely missing its own verbalunitid and 'unit verb'/'root' (or dependent-clause) relation."),
    )
    return odd.select("doc_id", "pos", F.col("id").alias("conjunction"), yes.alias("anchored"), no.alias("unanchored"), message.alias("message"))


def unit_colours(resolved: DataFrame) -> DataFrame:
    """doc_id, unit_id, rank, slot, fill, stroke, ink: palette slots by first appearance among non-punctuation tokens."""
    firsts = resolved.where("unit_id is not null and tokentype <> 'punctuation'").groupBy("doc_id", "unit_id").agg(F.min("pos").alias("first"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "unit_id")) - 1).withColumn("slot", F.col("rank") % len(PALETTE))
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in PALETTE]), F.col("slot") + 1)
    return ranked.select("doc_id", "unit_id", "rank", "slot", pick(0).alias("fill"), pick(1).alias("stroke"), pick(2).alias("ink"))


def colour_warnings(colours: DataFrame) -> DataFrame:
    """doc_id, units, message for documents with more units than colours."""
    n = colours.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units")).where(F.col("units") > len(PALETTE))
    return n.select("doc_id", "units", F.concat(F.col("units").cast("string"), F.lit(f" verbal units but only {len(PALETTE)} distinct colors -- colors repeat and may be ambiguous between units")).alias("message"))


def real_tokens(graph: DataFrame) -> DataFrame:
    """doc_id, pos, id, text of the tokens with surface text."""
    return graph.where(~F.col("tokentype").isin(IMPLIED)).select("doc_id", "pos", "id", "text")


