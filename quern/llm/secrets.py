"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams. The index has postings of the trigrams
that the rules ask for. A rule's candidates are the documents in the intersection of the postings of one of
its sets of trigrams; they alone are matched against it. A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import trigrams
from quern.llm.common import Q, cut, row_id


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share. A match counts if its group has least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in their order. Runs of hexadecimal digits are taken whole, so asking for 24
#: at once finds the runs that have as many.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that are found besides: token prefixes of public services, signed web tokens and private key headers.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def _clauses(rules) -> list[tuple[int, int, frozenset[str]]]:
    """(rule, clause, trigrams)."""
    queries = [trigrams.query(r.pattern) for r in rules]
    return [(i, j, s) for i, q in enumerate(queries) if q is not None for j, s in enumerate(q)]


def _key(id: str, text: str) -> Column:
    """Of a row, for the index. Rows that share it are candidates together, which costs a scan and no result."""
    return F.xxhash64(F.col(id), F.col(text))


def index(docs: DataFrame, rules=BASE + MORE, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Postings (trigram, key) of the trigrams that the rules ask for."""
    asked = sorted({t for _, _, s in _clauses(rules) for t in s})
    rows = docs.select(_key(id, text).alias("key"), F.lower(text).alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked]), lambda t: t.isNotNull())
    return rows.select("key", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, rules=BASE + MORE) -> DataFrame:
    """(key, rules): rules as the set bits of a LONG. Postings are intersected by or-ing each clause's trigrams
    together, in each task before the shuffle."""
    spark = postings.sparkSession
    clauses = [(i, j, t, 1 << b, (1 << len(s)) - 1) for i, j, s in _clauses(rules) for b, t in enumerate(sorted(s))]
    asked = spark.createDataFrame(clauses, "rule int, clause int, trigram string, bit long, every long")
    met = postings.join(F.broadcast(asked), "trigram").groupBy("key", "rule", "clause", "every").agg(F.bit_or("bit").alias("bits"))
    return met.filter("bits = every").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _hits(rule: Rule, number: int, text: Column) -> Column:
    """Matches in order: (kind, i, gap before, length, counts). \\G ties each match to the end of the last one."""
    whole = F.lit(f"(?s)\\G(.*?)({rule.pattern})")
    parts = [F.regexp_extract_all(text, whole, F.lit(g)) for g in (1, 2, rule.group + 2)]
    struct = lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.char_length(x["0"]).alias("gap"), F.char_length(x["1"]).alias("n"), (F.char_length(x["2"]) >= rule.least).alias("counts"))
    return F.transform(F.arrays_zip(*[p.alias(str(k)) for k, p in enumerate(parts)]), struct)


def scan(docs: DataFrame, rules=BASE + MORE, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every row: spans as an array of (start, kind number, end), in order, code points,
    end exclusive. Null texts count as empty. Null ids and repeated rows each keep their row; an empty table
    gives an empty result.
    """
    found = cut(candidates(index(docs, rules, text, id), rules).withColumnRenamed("key", f"{Q}key"))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), row_id().alias("row"), _key(id, text).alias(f"{Q}key"))
    rows = rows.join(found, f"{Q}key", "left")
    indexed = {i for i, _, _ in _clauses(rules)}
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,counts:boolean>>")

    def asked(i: int, rule: Rule) -> Column:
        if i in indexed:
            return F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
        return F.col("text").rlike(rule.pattern)

    every = F.concat(*[F.when(asked(i, r), _hits(r, i, F.col("text"))).otherwise(none) for i, r in enumerate(rules)])
    hits = rows.select("row", "doc_id", F.explode_outer(every).alias("h")).select("row", "doc_id", "h.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = hits.withColumn("end", end.cast("int"))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("n")).alias("start"), "kind", "end"))
    return spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).select("doc_id", "spans")


def digests(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    rules = BASE + MORE
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return scan(docs, rules, text, id).select("doc_id", *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _found_by_sql(i: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""SELECT row, {i} AS kind, unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap,
       unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(regexp_extract_all(text, '{p}', {r.group})) AS part,
       generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i, {r.least} AS least FROM d"""


_NAMES = "[" + ", ".join(f"'{r.kind}'" for r in BASE + MORE) + "]"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({" UNION ALL ".join(_found_by_sql(i, r) for i, r in enumerate(BASE + MORE))}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM h),
s AS (SELECT row, kind, stop - length(hit) AS start, {_NAMES}[kind + 1] || ':' || (stop - length(hit)) || ':' || stop AS span FROM e WHERE length(part) >= least)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN s USING (row) GROUP BY d.row, doc_id
"""
