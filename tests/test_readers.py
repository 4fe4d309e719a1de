"""Readers over files written from the provided tables."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexkit.sources import readers as RD
from lexkit.sources import testdata as td


def test_passages_tsv_and_jsonl(spark):
    d = tempfile.mkdtemp(prefix="lexkit-rd-")
    docs = td.table(spark, SF_SMALL, "documents").select("doc_id", "text", "source").orderBy("doc_id").limit(20).collect()
    tsv = os.path.join(d, "p.tsv")
    with open(tsv, "w") as f:
        f.write("id\ttext\ttitle\n")
        for r in docs:
            f.write('%d\t"%s"\t%s\n' % (r["doc_id"], r["text"].replace('"', '""'), r["source"]))
    got = RD.read_passages(spark, tsv).orderBy(F.col("id").cast("int")).collect()
    assert len(got) == 20 and got[0]["text"] == docs[0]["text"] and got[3]["title"] == docs[3]["source"]
    jl = os.path.join(d, "p.jsonl")
    with open(jl, "w") as f:
        for r in docs:
            f.write(json.dumps({"id": str(r["doc_id"]), "title": r["source"], "text": r["text"]}) + "\n")
    assert RD.read_passages(spark, jl).count() == 20


def test_qa_examples_maxload_and_shards(spark):
    d = tempfile.mkdtemp(prefix="lexkit-qa-")
    conv = td.table(spark, SF_SMALL, "conversations").orderBy("conv_id", "turn").limit(30).collect()
    ex = [{"question": r["text"], "positive_ctxs": [{"title": "", "text": r["text"]}]} for r in conv]
    p1, p2 = os.path.join(d, "a.jsonl"), os.path.join(d, "b.json")
    with open(p1, "w") as f:
        for e in ex[:20]:
            f.write(json.dumps(e) + "\n")
    with open(p2, "w") as f:
        json.dump(ex[20:], f)
    allrows = RD.read_qa_examples(spark, [p1, p2])
    assert allrows.count() == 30
    assert [r["question"] for r in allrows.orderBy("_row").collect()] == [e["question"] for e in ex]
    assert RD.read_qa_examples(spark, [p1, p2], maxload=25).count() == 25
    shard = RD.read_qa_examples(spark, [p1, p2], maxload=25, rank=1, world=2).orderBy("_row").collect()
    assert [r["_row"] for r in shard] == list(range(0, 25, 2))


def test_index_idf_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="lexkit-ix-")
    v = td.vectors(spark, SF_SMALL)
    RD.write_index(v.select("vec_id", "embedding"), os.path.join(d, "ix"))
    assert RD.read_index(spark, os.path.join(d, "ix")).count() == v.count()
    from lexkit.operators import lexical as L
    idf = L.build_idf(td.table(spark, SF_SMALL, "documents"))
    RD.write_idf(idf, os.path.join(d, "idf"))
    assert RD.read_idf(spark, os.path.join(d, "idf")).count() == idf.count()


def test_shard_files(spark):
    d = tempfile.mkdtemp(prefix="lexkit-sh-")
    df = td.table(spark, SF_SMALL, "documents").select("doc_id")
    for i in range(3):
        df.filter(F.col("doc_id") % 3 == i).coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
        src = [f for f in os.listdir(os.path.join(d, f"part{i}")) if f.endswith(".parquet")][0]
        os.link(os.path.join(d, f"part{i}", src), os.path.join(d, f"shard{i}.parquet"))
    assert RD.read_shards(spark, d, "full").count() == df.count()
    assert RD.read_shards(spark, d, "single").count() == df.filter(F.col("doc_id") % 3 == 0).count()
    assert RD.read_shards(spark, d, "split", rank=2, world=3).count() == df.filter(F.col("doc_id") % 3 == 2).count()
