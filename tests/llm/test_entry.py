import re

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "fingerprint", "component_id"],
    2: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    3: ["query_id", "rank", "vec_id", "score"],
    4: ["doc_id", "held_out", "score", "predicted"],
    5: ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"],
    6: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    7: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    8: ["doc_id", "held_out", "lang_pred", "score"],
    9: ["doc_id", "text", "n_lines", "n_dropped"],
    10: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


def test_each_operator_has_one_query(spark):
    names = [q for q in __spark_entry__.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    for q in names:
        assert __spark_entry__.queries()[q](spark, SF).columns == COLUMNS[int(q[2:].split("_")[0])]


def test_types_of_the_digests(spark):
    kinds = {q: dict(__spark_entry__.queries()[q](spark, SF).dtypes) for q in ("op2_exact_dedup", "op3_neighbours", "op4_toxicity", "op6_secrets", "op7_bpe", "op10_token_counts")}
    assert kinds["op2_exact_dedup"]["group_size"] == "bigint" and kinds["op2_exact_dedup"]["kept"] == "boolean"
    assert kinds["op3_neighbours"] == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert kinds["op4_toxicity"] == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert {kinds["op6_secrets"][c] for c in ("n_assign", "n_access", "n_hex")} == {"bigint"} == {kinds["op7_bpe"]["n_tokens"], kinds["op10_token_counts"]["n_bytes"]}
    assert kinds["op10_token_counts"]["over_limit"] == "boolean"
