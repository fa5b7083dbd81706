"""Line deduplication by a log-template tree.

Lines are parsed to a fixed depth: the number of tokens, then the LEADING first tokens, lead to a leaf. Tokens
with digits are variable fields and read as one mark. The rest of a line is cut into FIELDS consecutive runs
of tokens. Lines under TOKENS tokens, such as whole passages in scripts without spaces, are read as they are. In each leaf lines that agree in AGREE of
the runs belong to one template, whatever their other runs hold, directly or through other lines; so a leaf has as
many templates as it needs. Lines agree if they meet at one of the keys that each makes of every large enough set of
its runs: no pairs are compared, and hot leaves are split.

A generalised template, or one that is mostly variable fields, recurs if DOCS documents or more have it; one line's
masked text recurs from SAME documents on, as does a long line's template. Its first line (of the least id) stays where it is, so
that no passage is lost from the corpus; in all other places its lines are dropped.

A line is a row of fixed width from the first step on, so texts are read once to parse and once to rewrite.
Counts are combined before shuffles, and hot leaves and templates meet tables of one row each in joins that
Spark can split.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.common import Q, components, cut, dealt_anew, drop, per_batch, row_id, scratch, slices, stored

LEADING, FIELDS, AGREE = 3, 8, 0.75
#: Lines of fewer tokens and bytes are short: chance repeats them, so they recur only from OFTEN documents on.
TOKENS, BYTES, OFTEN = 4, 60, 30
DOCS, SAME = 5, 2
#: Tokens of a long line, and the share of a line's tokens up to which variable fields leave it one text.
LONG, VARIED = 50, 0.25
MARK = b"<*>"
#: Lines that are parsed before they are handed on.
LINES = 50_000

_DIGIT = re.compile(rb"[0-9]")


def parse(line: bytes) -> tuple[int, int, list[int], bool, bool, bool] | None:
    """(leaf, exact, fields, text, long, short) of a line, None if it is blank: signed hashes, whether its masked text
    is enough to tell it by, and whether it is long or short."""
    tokens = line.split()
    if not tokens:
        return None
    few = len(tokens) < TOKENS
    if not few and _DIGIT.search(line):
        tokens = [MARK if _DIGIT.search(t) else t for t in tokens]
    rest = tokens[LEADING:]
    n = min(FIELDS, len(rest))
    cuts = [len(rest) * k // n for k in range(n + 1)] if n else []
    fields = [xxhash.xxh32_intdigest(b" ".join(rest[a:b])) - (1 << 31) for a, b in zip(cuts, cuts[1:])]
    leaf = xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:LEADING]))
    text = tokens.count(MARK) <= VARIED * len(tokens)
    joined = b" ".join(tokens)  # what is said of the line follows from this alone, so that equal ones agree in it
    return leaf - (1 << 63), xxhash.xxh64_intdigest(joined) - (1 << 63), fields, text, text and len(tokens) > LONG, few and len(joined) < BYTES


_LINES = f"{Q}row long, {Q}id long, line int, first boolean, leaf long, exact long, fields array<int>, text boolean, long boolean, short boolean"


def lines(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row of each line that is parsed; first: no line before it in its document has the same masked text."""

    def made(rows: list) -> pa.RecordBatch:
        names = [f"{Q}row", f"{Q}id", "line", "first", "leaf", "exact", "fields", "text", "long", "short"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 10, kinds)], names)

    def over(batches):
        rows = []
        for b in slices(batches):
            for row, id_, t in zip(*(c.to_pylist() for c in b.columns)):
                seen = set()
                for i, line in enumerate((t or b"").split(b"\n")):
                    p = parse(line)
                    if p:
                        rows.append((row, id_, i, p[:2] not in seen, *p))
                        seen.add(p[:2])
                    if len(rows) >= LINES:
                        yield made(rows)
                        rows = []
        yield made(rows)

    cols = [row_id().alias(f"{Q}row"), F.col(id).cast("long").alias(f"{Q}id"), F.col(text).cast("binary").alias("text")]
    return docs.select(*cols).mapInArrow(over, _LINES)


def _subsets(n: int) -> list[int]:
    """Sets of AGREE of n runs, as bits. None if they are all n: lines that agree there are equal."""
    most = math.ceil(AGREE * n)
    return [sum(1 << i for i in x) for x in itertools.combinations(range(n), most)] if most < n else []


def agreeing(exact: DataFrame) -> DataFrame:
    """(node, root): exact lines that agree with others of their leaf, and the least that they reach."""
    shared = exact.groupBy("leaf").agg(F.min("exact").alias("a"), F.max("exact").alias("z")).filter("a <> z").select("leaf", "a")
    some = exact.select("leaf", "exact", "fields").join(dealt_anew(shared, "leaf"), "leaf").filter(F.size("fields") > 0)
    cases = " ".join(f"WHEN {n} THEN array({', '.join(map(str, _subsets(n)))})" for n in range(1, FIELDS + 1) if _subsets(n))
    keys = some.withColumn("set", F.expr(f"explode(CASE size(fields) {cases} END)"))
    held = "transform(fields, (x, i) -> if((set & shiftleft(1, i)) != 0, x, null))"
    keys = keys.select("exact", F.expr(f"xxhash64(leaf, set, {held})").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("exact").alias("hub"), F.max("exact").alias("z")).filter("hub <> z").select("key", "hub")
    return components(keys.join(dealt_anew(hubs, "key"), "key").select("exact", "hub"), "exact", "hub", exact)


def recurring(parsed: DataFrame, docs_at_least: int = DOCS) -> DataFrame:
    """(row, line) of the lines to drop. parsed: lines(), cut."""
    with scratch(parsed.sparkSession) as keep:
        exact = parsed.groupBy("leaf", "exact").agg(F.sum(F.col("first").cast("long")).alias("n"), *(F.first(c).alias(c) for c in ("fields", "text", "long", "short")))
        exact = cut(exact, parsed)
        roots = dealt_anew(agreeing(exact).withColumnRenamed("node", "exact"), "exact")
        templates = exact.join(roots, "exact", "left").select("leaf", "exact", "n", "text", "long", "short", F.coalesce("root", "exact").alias("template"))
        # Documents that a template and that an exact line needs. Templates that no count can bring there end here.
        same = min(SAME, docs_at_least)
        sizes = templates.groupBy("leaf", "template").agg(F.sum("n").alias("most"), F.count(F.lit(1)).alias("lines"), F.every("text").alias("t"), F.every("long").alias("l"), F.every("short").alias("s"))
        sizes = sizes.withColumn("need", F.when(F.col("s"), max(OFTEN, docs_at_least)).when(F.col("l") | (F.col("t") & (F.col("lines") == 1)), same).otherwise(docs_at_least)).filter(F.col("most") >= F.when(F.col("s"), F.col("need")).otherwise(same))
        alone = (F.col("lines") > 1) & F.col("text") & (F.col("n") >= same)
        templates = templates.join(dealt_anew(sizes.select("leaf", "template", "lines", "need"), "leaf", "template"), ["leaf", "template"]).select("leaf", "exact", "template", "need", alone.alias("alone"))
        at = [f"{Q}row", f"{Q}id", "line"]
        placed = keep(cut(parsed.join(templates, ["leaf", "exact"]).select("leaf", "exact", "template", "need", "alone", "first", *at), parsed))
    place = F.struct(F.col(f"{Q}id").isNull().alias("none"), F.col(f"{Q}id").alias("id"), F.col(f"{Q}row").alias("row"), F.col("line").alias("line"))
    firsts = placed.filter("first")
    per_doc = firsts.groupBy("leaf", "template", f"{Q}row").agg(F.min(f"{Q}id").alias(f"{Q}id"), F.min("line").alias("line"), F.first("need").alias("need"))
    often = per_doc.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.first("need").alias("need"), F.min(place).alias("stays")).filter("docs >= need")
    often = dealt_anew(often.select("leaf", "template", F.col("stays.row").alias("r"), F.col("stays.line").alias("l")), "leaf", "template")
    alike = firsts.filter("alone").groupBy("leaf", "exact").agg(F.min(place).alias("stays"))
    alike = dealt_anew(alike.select("leaf", "exact", F.col("stays.row").alias("er"), F.col("stays.line").alias("el")), "leaf", "exact")
    met = placed.join(often, ["leaf", "template"], "left").join(alike, ["leaf", "exact"], "left")
    stays = F.when(F.col("r").isNotNull(), F.struct("r", "l")).otherwise(F.struct(F.col("er").alias("r"), F.col("el").alias("l")))
    met = met.withColumn("stays", stays).filter("stays.r IS NOT NULL")
    return met.filter((F.col(f"{Q}row") != F.col("stays.r")) | (F.col("line") != F.col("stays.l"))).select(f"{Q}row", "line")


def without_recurring(docs: DataFrame, text: str = "text", id: str = "doc_id", docs_at_least: int = DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the recurring lines taken out of text; rows all stay, and columns as they are.

    Lines end at \\n; those that stay keep their bytes and order. Null texts stay null. A text may become empty.
    Null ids come last when the first place of a template is looked for. counts: names of two columns to
    add, the number of lines and of lines dropped. An empty table gives an empty result.
    """
    docs = stored(docs)
    parsed = cut(lines(docs, text, id), docs)
    drops = recurring(parsed, docs_at_least)
    drop(parsed)
    drops = drops.groupBy(f"{Q}row").agg(F.collect_list("line").alias(f"{Q}drops"))
    rows = docs.drop(*(counts or ())).withColumn(f"{Q}row", row_id()).join(drops, f"{Q}row", "left").drop(f"{Q}row")
    at, kept = rows.columns.index(text), [x for x in rows.columns if x != f"{Q}drops"]
    drops_at = rows.columns.index(f"{Q}drops")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, n, gone = [], [], []
        for t, d in zip(b.column(at).to_pylist(), b.column(drops_at).to_pylist()):
            if t is not None and d:
                every, d = t.split("\n"), set(d)
                n.append(len(every))
                t = "\n".join(x for i, x in enumerate(every) if i not in d)
            else:
                n.append(0 if t is None else t.count("\n") + 1)
            texts.append(t)
            gone.append(len(d or ()))
        columns = [pa.array(texts, b.column(at).type) if i == at else c for i, c in enumerate(b.columns) if i != drops_at]
        extra = [pa.array(np.array(x, np.int64)) for x in (n, gone)] if counts else []
        return pa.RecordBatch.from_arrays([*columns, *extra], [*kept, *(counts or ())])

    fields = [x for x in rows.schema.fields if x.name != f"{Q}drops"]
    return per_batch(rows, f, StructType([*fields, *(StructField(c, LongType()) for c in counts or ())]))
