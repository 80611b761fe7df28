"""The registered queries on the smallest tables, and the stages on odd rows."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm.common import materialise
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"],
    "op2_tokenfile": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op4_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_classifier": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    """Contracted columns, and a row for every row of the table."""
    table = {"op3_urls": "pages", "op9_warc": "pages"}.get(name, "documents")
    id_ = QUERIES[name](spark, SF)
    assert id_.columns == COLUMNS[name]
    rows = id_.collect()
    if name == "op4_chat":
        assert {r.conv_id for r in rows} == {-1} | {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()}
        return
    given = spark.read.parquet(f"{SF}/{table}.parquet")
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in given.select(id_.columns[0]).collect())
    if name == "op9_warc":
        held = {r.page_id: r for r in rows}
        assert all(held[r.refers_to].record_type == "response" and held[r.refers_to].payload_digest == r.payload_digest for r in rows if r.record_type == "revisit")
    if name == "op10_classifier":
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
        tested = [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
        assert not tested or sum(r.predicted == y for r, y in tested) / len(tested) > 0.85


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, a very long text, ties and repeated rows, and columns of clashing names."""
    good = lambda k: f"The {k} river ran past the old mill and under a bridge.\nPeople of town {k} walked there in the evening."
    rows = [(k, good(f"w{k}a"), "en", "s", len(good(f"w{k}a"))) for k in range(30)]
    rows += [(None, good("nobody"), None, None, None), (100, None, "en", "s", 0), (101, "", "en", None, 0), (5, good("w5a"), "en", "s", None), (102, "\n".join(" ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}{k}" for j in range(12)) + "." for k in range(3000)) + " The river ran past.", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("id", "n", "class", "root", "_n", "u", "key", "host", "failed", "item")})
    path = str(tmp_path)
    spark.createDataFrame([(k, 1) for k in range(20)] + [(None, 0), (100, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "river ran past")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, path), "stage")
        found = docs.collect()
        if name != "byte-level BPE":
            assert docs.columns == columns
            if name == "benchmark decontamination":  # the short texts have more than a share of hit words
                assert [r.doc_id for r in found] == [102] and "river ran past" not in found[0].text and found[0].n_chars == len(found[0].text)
            else:
                assert Counter(r.doc_id for r in found) == {i: 2 if i == 5 and name.startswith("quality") else 1 for i in [*range(30), None, 102]}
    assert [r.doc_id for r in found] == [102] and found[0].n_tokens > 36_000
