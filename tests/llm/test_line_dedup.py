import re
from collections import defaultdict

from quern.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


def read(line):
    """Tokens of a line; those with digits are one mark, but in lines of fewer than four."""
    tokens = [x for x in re.split(r"[\x20\x09-\x0d]+", line) if x]
    return tuple("<*>" if len(tokens) > 3 and re.search("[0-9]", x) else x for x in tokens)


def agree(a, b):
    """Whether two lines of one leaf agree in three quarters of their runs of tokens."""
    n = min(8, len(a) - 3)
    runs = lambda t: [t[3:][len(t[3:]) * k // n : len(t[3:]) * (k + 1) // n] for k in range(n)]
    return n > 0 and sum(x == y for x, y in zip(runs(a), runs(b))) >= 0.75 * n


def plain(rows, docs_at_least=5):
    """[(doc_id, text)] with recurring lines dropped, by comparing all pairs of a leaf; also lines and drops."""
    where = defaultdict(list)
    for r, (d, t) in enumerate(rows):
        for i, line in enumerate((t or "").split("\n")):
            if read(line):
                where[read(line)].append((d is None, d or 0, r, i))
    leaves, drop = defaultdict(list), set()
    for tokens in where:
        leaves[len(tokens), tokens[:3]].append(tokens)
    docs = lambda places: len({p[2] for p in places})
    is_text = lambda t: t.count("<*>") <= len(t) / 4
    for members in leaves.values():
        left = set(members)
        while left:
            template, edge = [], [left.pop()]
            while edge:
                template.append(edge.pop())
                near = {t for t in left if agree(t, template[-1])}
                left -= near
                edge += near
            places = [p for t in template for p in where[t]]
            one = len(template) == 1
            if one and len(template[0]) < 4 and len(" ".join(template[0]).encode()) < 60:
                need = max(30, docs_at_least)
            elif all(map(is_text, template)) and (one or len(template[0]) > 50):
                need = min(2, docs_at_least)
            else:
                need = docs_at_least
            if docs(places) >= need:
                drop |= {p[2:] for p in places} - {min(places)[2:]}
            elif not one:  # equal texts among the lines of a template that doesn't recur
                for t in template:
                    if is_text(t) and docs(where[t]) >= 2:
                        drop |= {p[2:] for p in where[t]} - {min(where[t])[2:]}
    out = []
    for r, (d, t) in enumerate(rows):
        every = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(every) if (r, i) not in drop]
        out.append((d, None if t is None else "\n".join(kept), len(every), len(every) - len(kept)))
    return out


def check(df, rows, **more):
    got = line_dedup.without_recurring(df, counts=("n_lines", "n_dropped"), **more).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, *more.values())))


def test_whole_table(spark):
    got = queries.queries()["op9_line_dedup"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows)))
    assert sum(r["n_dropped"] for r in got) > 20


def test_templates_generalise(spark):
    rows = [(i, f"Posted on 2024-01-{i:02} by user{i} with pleasure\nonly here {i} " + "x" * i + " y\nshort line") for i in range(20)]
    rows += [(100 + i, f"We thank our sponsor {name} for the kind help given in all these years") for i, name in enumerate(["Ann", "Bob", "Cy", "Di", "Ed", "Flo"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    check(df, rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_recurring(df).collect()}
    assert got[0].startswith("Posted") and not got[5].startswith("Posted") and got[5].endswith("short line")
    assert got[100] and not any(got[i] for i in range(101, 106))


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(odd_docs, rows, docs_at_least=2)
    out = line_dedup.without_recurring(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert line_dedup.without_recurring(odd_docs.limit(0)).count() == 0
