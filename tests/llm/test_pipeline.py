"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import test_operators as brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from lectern.llm import crf, decontam  # noqa: E402
from lectern.llm.common import materialise  # noqa: E402


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Clean, junk, copied and contaminated documents; a host that is mostly bad."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "ku", "li", "mo", "re", "sa"]) for _ in range(rng.randrange(1, 4)))
    line = lambda n=9: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(word() + "x" for _ in range(40))
    docs, labels = [], []
    for k in range(400):
        lines = [line() for _ in range(rng.randrange(3, 9))]
        source = "bad" if k % 20 == 3 else f"s{k % 4}"
        bad = k % 7 == 0
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        elif k % 20 == 3 and k > 20:
            lines = ["two words"]
        elif k % 31 == 1:
            lines.insert(1, passage)
        elif k % 31 == 2:
            lines = [line() for _ in range(60)] + [" ".join(passage.split()[:14])]
        elif k % 9 == 4 and k > 9:
            lines = docs[k - 9][1].split("\n")
        docs.append((k, "\n".join(lines), "en", source, len("\n".join(lines))))
        labels.append((k, int("!!" not in docs[-1][1]), 0))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    of = lambda df: {r.doc_id: r for r in df.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = of(docs)
        docs = materialise(stage(spark, docs, sf), "stage")
        steps[name] = (before, of(docs), docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    assert all(c == columns for _, _, c in [*steps.values()][:-1])

    before, after, _ = steps["quality rules"]
    fails = {i: (lambda m: m[0] < 10 or 100 * m[4] > 20 * m[0])(brute.measured(r.text)) for i, r in before.items()}
    assert {i for i in before if not fails[i] and before[i].source != "bad"} == set(after)

    before, after, _ = steps["quality classifier"]
    assert set(before) - set(after) == {i for i in before if labels[i] == 0}

    before, after, _ = steps["MinHash near-dedup"]
    assert set(after) == {i for i, _, c in brute.linked([(i, r.text) for i, r in sorted(before.items())]) if i == c}

    before, after, _ = steps["benchmark decontamination"]
    automaton = decontam.Automaton([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    hits = {i: sum(e - s for s, e in automaton.find(decontam.words(r.text))[0]) for i, r in before.items()}
    assert any(hits.values()) and set(after) == {i for i, r in before.items() if not hits[i] or 20 * hits[i] < len(decontam.words(r.text))}
    assert all(not automaton.find(decontam.words(r.text))[0] and r.n_chars == len(r.text) for r in after.values())
    assert all(after[i].text == before[i].text for i in after if not hits[i]) and any(hits[i] for i in after)

    before, after, _ = steps["byte-level BPE"]
    assert set(before) == set(after) and corpus_pipeline.run(spark, sf).count() == len(after)


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "stage")
        assert docs.count() == 0


def test_scores_of_null_texts(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = crf.fit(["a b c.", "A!! B!!"], [1, 0], 0.8)
    assert len({r._score for r in crf.score_table(frame, model).collect()}) == 1
