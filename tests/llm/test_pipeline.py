"""The corpus pipeline, stage by stage, and the registered queries."""
from collections import Counter

import __spark_entry__ as E
import corpus_pipeline
from fixtures import rows, stored
from test_text_operators import brute_components, brute_lines, tokens

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = list(E.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF)
        after = [tuple(r) for r in out.collect()]
        if name == "packing":
            assert out.columns[:3] == ["doc_id", "start", "length"] and len(after) >= 1
            break
        assert out.columns == docs.columns
        if name in ("toxicity", "ngram_join"):
            assert Counter(after) <= Counter(before)
        if name == "ngram_join":
            assert {r[0] for r in after} == {c for (_, _, c) in brute_components(before)}
        if name == "line_dedup":
            removed = brute_lines(before)
            for r in after:
                text = next(b[1] for b in before if b[0] == r[0])
                assert r[1] == "\n".join(x for k, x in enumerate(text.split("\n")) if (r[0], k) not in removed)
        if name == "mixing":
            total = sum(len(tokens(b[1])) for b in before)
            assert abs(sum(len(tokens(a[1])) for a in after) - 1.5 * total) < 0.01 * total
        docs = stored(spark, after, docs.schema)


def test_stages_take_awkward_rows(spark, tmp_path):
    docs = stored(spark, rows()).select("doc_id", "text", "lang", "source", "n_chars")
    for data in (docs, docs.limit(0)):
        sf = str(tmp_path / f"sf{data.count()}")
        data.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        assert (corpus_pipeline.run(spark, sf).count() > 0) == (data.count() > 0)
