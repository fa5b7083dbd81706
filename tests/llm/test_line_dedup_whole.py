"""Lines that fewer documents share, short lines and leaves of several templates."""

from quern.llm import line_dedup


def dropped(spark, lines):
    """Places (document, line) that are dropped of [[line, ...]]; each document also has a line of its own."""
    rows = [(i, "\n".join([*x, f"own{'x' * i} text of document alone"])) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.without_recurring(df).collect()}
    return [(i, k) for i, x in enumerate(lines) for k, line in enumerate(x) if line not in got[i]]


def test_two_documents_share_a_passage(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    altered = passage.replace("wab", "other")
    table = [f"{i} 2{i} 3{i} 4{i}" for i in range(2)]
    assert dropped(spark, [[passage], ["a line of this one only"], [passage], ["we all like it here", table[0]], ["we all like it here", table[1]]]) == [(2, 0), (4, 0)]
    assert dropped(spark, [[passage], [altered]]) == [(1, 0)]  # long: generalised from two documents on
    ad = "we thank our sponsor {} for the kind help given in all these years"
    assert dropped(spark, [[ad.format(x)] for x in ("ann", "bob", "cy", "cy")]) == [(3, 0)]  # one text twice, the template four times


def test_short_lines_and_scripts_without_spaces(spark):
    chinese = "".join(chr(0x4E00 + i * 37 % 2000) for i in range(300)) + "2024"
    lines = [["All rights reserved.", f"{i}"] for i in range(31)] + [["Yes."] for _ in range(29)]
    lines[3].append(chinese)
    lines[40].append(chinese)
    lines[41].append(chinese[:-1] + "5")
    assert dropped(spark, lines) == [*((i, 0) for i in range(1, 31)), (40, 1)]


def test_a_leaf_has_several_templates(spark):
    fixed = "We thank our readers of many years who never once left us all alone"
    footer = "We thank our sponsor {} for the kind help given in all these years"
    names = [f"n{chr(97 + i)}" for i in range(7)]
    got = dropped(spark, [[fixed] for _ in range(9)] + [[footer.format(x)] for x in names])
    assert got == [*((i, 0) for i in range(1, 9)), *((i, 0) for i in range(10, 16))]
