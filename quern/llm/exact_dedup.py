"""Exact duplicates by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of BLOCK bytes. Equal blocks get the same integer name: blocks are sorted, and a
block's name is the number of its first place. Then adjacent names are paired and pairs are named in the
same way, until each text has a single name: texts of the same number of levels have the same name if and
only if they are equal, byte for byte. No hash decides anything; blocks are sorted by a hash first, as numbers
sort faster than text.

Each text is shuffled once, in blocks. Places of a block that has more than LIMIT of them, or 1/SHARE of all, are
dealt to parts of that many; each part names the block by its own first place, and the parts' first places of a
block, a row each, are sorted once more for its name. So no task sorts more of one block, whatever its share of the
corpus. Pairs are narrow, and are named by a join whose hot keys Spark can split.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Q, cut, dealt_anew, row_id, stored
from quern.order import asked_whole

#: Bytes of a block. Most documents are one block; longer ones take log2(blocks) levels.
BLOCK = 4096
#: Places of one block that are sorted together: 1/SHARE of all, but at least FEW and at most LIMIT.
SHARE, FEW, LIMIT = 1000, 32, 1 << 20


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is empty. lower() is that for ASCII alone, and much faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, ascii_uppercase, ascii_lowercase))


def _places(docs: DataFrame, text: str, id: str, block: int) -> DataFrame:
    """(row, id, sha, n, pos, at, h, block) of every block; at numbers blocks by their place in docs, h is a hash."""
    low = lowered(F.col(text)).alias("low")
    rows = docs.select(row_id().alias("row"), F.col(id).cast("long").alias("id"), low)
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("low") / block)).cast("int"))
    every = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    sha = F.when(F.col("pos") == 0, F.sha2(F.col("low").cast("binary"), 256))
    every = every.withColumns({"at": row_id(), "sha": sha, "block": F.expr(f"substring(cast(low AS binary), pos * {block} + 1, {block})")})
    return every.select("row", "id", "sha", "n", "pos", "at", F.xxhash64("block").alias("h"), "block")


def _hot(places: DataFrame, share: int, few: int) -> list:
    """(h, parts) of the hashes with too many places for one part: fewer than share of them, or one for each LIMIT
    places if that is more."""
    counts = places.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    limit = counts.agg(F.greatest(F.lit(float(few)), F.least(F.sum("c") / share, F.lit(float(LIMIT)))).alias("most"))
    hot = counts.crossJoin(F.broadcast(limit)).filter("c > most")  # of one row
    return hot.select("h", F.ceil(F.col("c") / F.col("most")).cast("int").alias("parts")).collect()


def _name_blocks(places: DataFrame, share: int, few: int) -> DataFrame:
    """(row, id, sha, n, pos, at, name) of every place; sha and id with a text's first block only."""
    hot = _hot(places, share, few)
    cols = ["row", "id", "sha", "n", "pos", "at"]

    def first(at: str, *keys: str) -> Column:
        return F.first(at).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))

    if not hot:
        return places.select(*cols, first("at", "h", "block").alias("name"))
    parts = places.sparkSession.createDataFrame(hot, "h long, parts int")
    dealt = places.join(F.broadcast(parts), "h", "left").withColumn("part", F.expr("pmod(at, coalesce(parts, 1))"))
    local = asked_whole(dealt.withColumn("local", first("at", "h", "part", "block")))
    firsts = local.filter("parts IS NOT NULL AND at = local").select("local", first("local", "h", "block").alias("name"))
    firsts = dealt_anew(firsts.filter("name <> local"), "local")
    return local.join(firsts, "local", "left").select(*cols, F.coalesce("name", "local").alias("name"))


def _pair_up(level: DataFrame, docs: DataFrame) -> DataFrame:
    """The next level of (row, id, sha, pos, n, at, name), for texts of more than one name."""
    side = F.col("pos") % 2
    left, right = F.max(F.when(side == 0, F.col("name"))), F.max(F.when(side == 1, F.col("name")))
    firsts = [F.max(F.when(side == 0, F.col(c))).alias(c) for c in ("id", "sha")]
    pairs = level.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(F.ceil(F.first("n") / 2).cast("int").alias("n"), *firsts, F.min("at").alias("at"), left.alias("l"), right.isNull().alias("alone"), F.coalesce(right, F.lit(0)).alias("r"))
    pairs = asked_whole(pairs)
    names = dealt_anew(pairs.groupBy("l", "r", "alone").agg(F.min("at").alias("name")), "l", "r", "alone")
    return cut(pairs.join(names, ["l", "r", "alone"]).select("row", "id", "sha", "pos", "n", "at", "name"), docs)


def identities(docs: DataFrame, text: str = "text", id: str = "doc_id", block: int = BLOCK, share: int = SHARE, few: int = FEW) -> DataFrame:
    """(row, id, sha, level, name) of every row of docs, stored(): equal texts, and no others, agree in level and name."""
    level, at = cut(_name_blocks(_places(docs, text, id, block), share, few), docs), 0
    most, out = level.agg(F.max("n")).first()[0] or 1, None
    while True:
        done = level.filter("n = 1").select("row", "id", "sha", F.lit(at).alias("level"), "name")
        out = done if out is None else out.unionByName(done)
        if most <= 1:
            return out
        most, at = -(-most // 2), at + 1
        level = _pair_up(level.filter("n > 1"), docs)


def exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", block: int = BLOCK, share: int = SHARE, few: int = FEW) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs.

    Texts are equal when identical after lower-casing A-Z; null is empty. Of equal texts the row with the
    largest id stays (null ids last; of equal ids one row). An empty table gives an empty result.
    """
    named = identities(stored(docs), text, id, block, share, few)
    groups = named.groupBy("level", "name").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    joined = named.join(dealt_anew(groups, "level", "name"), ["level", "name"])
    return joined.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with the row that stays of each group of equal texts; columns as they are."""
    docs = stored(docs)
    named = identities(docs, text, id)
    keep = named.groupBy("level", "name").agg(F.max(F.struct("id", "row"))["row"].alias(f"{Q}row")).select(f"{Q}row")
    return docs.withColumn(f"{Q}row", row_id()).join(keep, f"{Q}row", "left_semi").drop(f"{Q}row")


_LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_LOW} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(low) AS text_sha256
FROM d WINDOW same AS (PARTITION BY low)
"""
