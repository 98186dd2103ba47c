"""Small builders and brute-force versions the operators are held against."""

from datetime import datetime, timedelta

GRAPH = "doc_id string, pos int, context string, id string, tokentype string, text string, lemma string, verbalunit string, related1 string, relationship1 string, related2 string, relationship2 string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
T0 = datetime(2024, 1, 10)


def at(days: float) -> datetime:
    return T0 + timedelta(days=days)


def tok(doc, pos, i, text="x", kind="lexical", lemma=None, unit=None, r1=None, l1=None, r2=None, l2=None, day=0.0, gone=None):
    return (doc, pos, None, i, kind, text, lemma, unit, r1, l1, r2, l2, at(day), None if gone is None else at(gone))


def graph(spark, rows):
    return spark.createDataFrame(rows, GRAPH)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def units_by_recursion(tokens):
    """Memoised depth-first resolution of verbal units in list order, for one document."""
    by = {t[3]: t for t in tokens}
    verb, part = {}, {}
    for t in tokens:
        for r, label in ((t[8], t[9]), (t[10], t[11])):
            if r not in (None, "root"):
                if label == "unit verb":
                    verb[r] = t[3]
                elif label == "circumstantial participle":
                    part[r] = t[3]
    done, active = {}, set()

    def go(i):
        if i not in by:
            return None
        if i in done:
            return done[i]
        t = by[i]
        if t[7] is not None:
            done[i] = t[7]
            return t[7]
        if i in active:
            return None
        active.add(i)
        out = None
        for c in (verb.get(i), part.get(i) if "ablative absolute" in (t[9], t[11]) else None, t[8], t[10]):
            out = go(c) if c is not None else None
            if out is not None:
                break
        active.discard(i)
        done[i] = out
        return out

    for t in tokens:
        go(t[3])
    return done
