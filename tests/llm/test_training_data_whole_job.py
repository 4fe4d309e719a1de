"""Work that operators once left undone."""
import numpy as np
import pytest
from fixtures import stored

from lexkit.llm import near_vectors, substrings

DOCS = "doc_id bigint, text string"
VECTORS = "vec_id bigint, embedding array<double>, label int"


def cleaned(spark, data):
    return {r["doc_id"]: r["text"] for r in substrings.without_repeats(stored(spark, data, DOCS)).collect()}


def test_repeated_line_of_short_sentences_goes(spark):
    talk = " ".join(f"Said {w} to me. Why not, {w}?" for w in "abcdefgh")
    mixed = "Yes indeed. " + " ".join(f"w{i}" for i in range(20)) + ". No, never. Oh well!"
    got = cleaned(spark, [(1, f"first words\n{talk}\n{mixed}"), (2, f"other start\n{mixed.upper()}\nmiddle\n{talk}\nYes indeed.")])
    assert got[1] == f"first words\n{talk}\n{mixed}"
    assert got[2].split() == "other start middle Yes indeed.".split()


def test_repeated_verse_and_paragraph_go(spark):
    verse = "\n".join(f"roses are {w}" for w in "abcdef")
    long = " ".join(f"x{i}" for i in range(15))
    rest = " ".join(f"y{i}" for i in range(15))
    got = cleaned(spark, [(1, f"{long}\n{verse}\n{rest}\n\nHead line\n{long}z\nsigned me\n\nend"),
                          (2, f"A title\n\n{verse}\n\n{rest}2\r\n\r\nHead line\r\n{long}z\r\nsigned me\r\n\r\nHead line"),
                          (3, verse.replace("\n", " "))])
    assert got[2].split() == ["A", "title", *f"{rest}2".split(), "Head", "line"]
    assert got[3] == verse.replace("\n", " ")


def test_short_pieces_stay_outside_repeated_units(spark):
    data = [(1, "Good day. Who is it?"), (2, "Good day. Who is it? " + " ".join(f"a{i}" for i in range(9)) + "."), (3, "Good day. Who is it?")]
    assert cleaned(spark, data) == dict(data)


def test_spans_of_pieces_are_the_words(spark):
    line = "Émile, come. No — I won't. Then stay there! Well, I may."
    rows = substrings.repeated_units(stored(spark, [(1, line), (2, f"é {line}"), (3, f"ü\n {line} ")], DOCS)).collect()
    assert [(r["doc_id"], r["kept_doc_id"], r["kept_start"], r["words"]) for r in rows] == [(3, 1, 0, len(line.split()))]
    assert f"ü\n {line} "[rows[0]["start"]:rows[0]["end"]] == line


def clumps(pairs=6, size=20, d=32, seed=1):
    """Pairs of tight clumps, the two of a pair linked at 0.98 to 0.99."""
    rng = np.random.default_rng(seed)
    v = []
    for _ in range(pairs):
        a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
        for centre in (a, 0.9835 * a + np.sqrt(1 - 0.9835**2) * b):
            v += list(centre + rng.normal(scale=0.0005, size=(size, d)))
    v += list(rng.normal(size=(60, d)))
    v = np.array(v)
    return v[rng.permutation(len(v))]


def brute_links(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    comp = np.arange(len(v))
    while True:
        low = np.where(near, comp[None], len(v)).min(1)
        if (low == comp).all():
            return {i: (int(near[i].sum()) - 1, int(comp[i])) for i in range(len(v))}
        comp = low


@pytest.mark.parametrize("blind", [False, True])
def test_links_between_clumps_that_fill_their_lists(spark, monkeypatch, blind):
    v = clumps()
    if blind:       # the descent gives nothing, and the exact comparison is all there is
        monkeypatch.setattr(near_vectors, "K", 0)
        monkeypatch.setattr(near_vectors, "descend", lambda nodes, graph, k, buckets: (graph, spark.createDataFrame([], "src bigint, dst bigint")))
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(stored(spark, rows, VECTORS), k=8).collect()}
    assert got == brute_links(v)


def test_audit_counts_small_groups_like_large_ones(spark):
    big, small = np.eye(8)[0] + np.random.default_rng(0).normal(scale=0.001, size=(300, 8)), np.eye(8)[1:4]
    v = np.concatenate([big, small, small + 0.001])
    nodes = spark.createDataFrame([(i, 1, x.tolist(), 1) for i, x in enumerate(v)], "id bigint, label bigint, vector array<double>, copies bigint")
    comp = spark.createDataFrame([(i, 0) for i in range(300)], "id bigint, component bigint")
    linked = spark.createDataFrame([(i, 299) for i in range(300)], "id bigint, n bigint")
    assert not near_vectors.enough_found(nodes, comp, linked)


def test_audit_is_not_outweighed_by_copies(spark):
    """Two near vectors with many copies hide, by weight, what two clumps lose."""
    v = np.array([x for x in clumps(pairs=1, size=12) if np.linalg.norm(x) < 1.5])
    assert len(v) == 24
    few = stored(spark, [(i, x.tolist(), 1) for i, x in enumerate(v)], VECTORS)
    many = spark.range(60_000).selectExpr(
        "id + 1000 vec_id", "transform(sequence(1, 32), i -> IF(i = 1, 1D, IF(i = 2, CAST(id % 2 AS double) / 100, 0D))) embedding", "2 label")
    rows = near_vectors.near_vectors(few.unionByName(many), k=8).filter("vec_id < 1000").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == brute_links(v)
