import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from aerolens.llm import common, toxicity
from tests.llm import edge
from tests.llm.test_lines import brute
from tests.llm.test_mixing import expected_targets
from tests.llm.test_simhash import components, jaccard


@pytest.fixture(scope="module")
def results(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, docs, sf), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns_and_names(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mix", "pack"]
    assert all(after.columns == before.columns for before, after in results[:-1])


def test_toxic_documents_go_and_others_stay(spark, sf, results):
    before, after = results[0]
    model = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    scores, _ = toxicity.score_texts([t for _, t in plain(before)], model, {})
    assert plain(after) == [x for x, s in zip(plain(before), scores) if s < corpus_pipeline.TOXIC]


def test_lines(results):
    before, after = results[1]
    assert plain(after) == brute(plain(before), 10)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_document_of_each_group(results):
    before, after = results[2]
    rows, kept = plain(before), dict(plain(after))
    texts = dict(rows)
    root = components(texts, lambda a, b: texts[a].split() == texts[b].split() or (abs(len(texts[a]) - len(texts[b])) < 0.3 * len(texts[a]) and jaccard(texts[a], texts[b]) >= 0.8))
    left = {}
    for i, r in root.items():
        left.setdefault(r, []).append(i in kept)
    assert all(any(g) for g in left.values())
    assert np.mean([sum(g) == 1 for g in left.values()]) >= 0.98


def test_mix_comes_near_its_targets(results):
    before, after = results[3]
    sizes, taken = {}, {}
    for df, into in ((before, sizes), (after, taken)):
        for r in df.collect():
            into[r.source] = into.get(r.source, 0) + len(r.text.encode().split())
    for s, want in expected_targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= 64 + 0.02 * want


def test_packed_ids(results):
    before, after = results[4]
    rows = after.collect()
    assert sum(r.length for r in rows) == sum(len(r.ids) for r in rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.length for r in rows if r.start == 0) > 0 and len(rows) >= before.count()


def test_registered_and_awkward_rows(spark, tmp_path):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    docs = edge.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("some", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (rows > 0) == (name == "some")
