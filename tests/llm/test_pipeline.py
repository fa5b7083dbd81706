import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, mixing, toxicity
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_shingles import near_copies
from tests.oracle import in_duckdb

SF = "/root/testdata/sf0.001"


def test_run_is_its_stages_one_by_one(spark, tmp_path):
    """run() against plain versions of the stages; the classifier's weights are taken, its scores made anew."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    w = dict(zip(model.index.tolist(), model.weight.tolist()))
    rows = [r for r in docs.collect() if 1 / (1 + 2.718281828459045 ** -(model.bias + sum(w.get(i, 0) for i in toxicity.features(r["text"]).tolist()))) < 0.3]
    assert 0 < len(rows) < docs.count()
    lined = [t for _, t, _, _ in plain_lines([(r["doc_id"], r["text"]) for r in rows])]
    first = near_copies([(r["doc_id"], t) for r, t in zip(rows, lined)])
    kept = [(r["doc_id"], t, r["lang"], r["source"], len(t)) for r, t in zip(rows, lined) if r["doc_id"] in first]
    assert 0 < len(kept) < len(rows)
    spark.createDataFrame(kept, docs.schema).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    part = next((tmp_path / "documents.parquet").glob("part-*"))
    columns, mixed = in_duckdb(mixing.SQL.replace("documents", f"read_parquet('{part}')"), SF)
    want = sorted(r[:5] for r in mixed)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "token_ids"]
    out = got.collect()
    assert sorted(tuple(r)[:5] for r in out) == want
    c = bpe.codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert all(b"".join(c.vocabulary.tokens[i] for i in r["token_ids"]).decode() == r["text"] for r in out)


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, 0, 1), (2, None, 1), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, odd_docs.limit(0)):
        docs = docs.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"), "row", "k")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.mode("overwrite").parquet(str(tmp_path / f"{i}"))
            before = spark.read.parquet(str(tmp_path / f"{i}"))
            docs = stage(spark, before, str(tmp_path))
            assert docs.columns[: len(before.columns)] == before.columns
            docs.count()
