"""Packing, toxicity, mixing, sharding, line dedup, LM scoring, substring dedup
and the n-gram join against brute force, on rows of every awkward kind."""
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import COLUMNS, rows, stored, words
from pyspark.sql import functions as F

from lexkit.llm import language_model, line_dedup, mixing, ngram_join, packing, sharding, substrings, toxicity
from lexkit.llm.flatwords import WORD_PATTERN, Words, shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = tokens(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return stored(spark, data)


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark, [])


def test_words_and_shingles(data):
    import pyarrow as pa
    texts = [r[1] for r in data]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [len(tokens(t)) for t in texts]
    known = {}
    for h, t in zip(w.hash.tolist(), [x for t in texts for x in tokens(t)], strict=True):
        assert known.setdefault(t, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def named_ids(text):
    """The named tokenizer as its file has it, special token included."""
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_named_tokenizer(data):
    import pyarrow as pa
    texts = [r[1] for r in data] + ["a  b", " a", "a ", "x\n y", "  ", "a  b", "don't  stop"]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext|", "é<|endoftext|>  y"]
    want = [named_ids(t or "") for t in texts]
    ids, counts = packing.Encoder().texts(pa.array(texts))
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    path = grid[np.argsort(key)]
    assert len(set(key.tolist())) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_a_row_repeated_often_is_split(spark):
    """Rows equal in everything are dealt over the partitions by their number."""
    docs = stored(spark, [(None, "one two three " * 20)] * 400, "doc_id bigint, text string")
    parts = {r["sequence_id"] >> 40 for r in packing.pack(docs).collect()}
    assert len(parts) > 4


def test_pack_round_trip(docs, data):
    got = packing.pack(docs).collect()
    want = Counter((r[0], tuple([*named_ids(r[1] or ""), 1])) for r in data)
    by_sequence = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"] > 0
        pieces[(r["doc_id"], r["start"])].append((ids, r["doc_tokens"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    made = Counter()
    for (doc, start), starts in pieces.items():
        if start == 0:
            for ids, total in starts:
                whole = list(ids)
                while len(whole) < total:
                    whole += pieces[(doc, len(whole))][0][0]
                made[(doc, tuple(whole))] += 1
    assert made == want


def test_pack_empty(empty):
    assert packing.pack(empty).count() == 0


def test_shards(docs, data):
    out = sharding.shard_rows(docs, "doc_id", sharding.record_size()).collect()
    assert Counter((r["doc_id"], r["text"], r["row"]) for r in out) == Counter((r[0], r[1], r[5]) for r in data)
    n = Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) <= set(range(8))
    for s in n:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n[s]))


def test_shards_agree_between_runs_and_take_an_empty_table(docs, empty):
    runs = [{(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in
             sharding.shard_rows(docs, "doc_id", sharding.record_size()).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    assert sharding.shard_rows(empty, "doc_id", sharding.record_size()).count() == 0


def test_fisher_yates_is_a_permutation():
    p = sharding.fisher_yates(1000, np.random.default_rng(1))
    assert sorted(p.tolist()) == list(range(1000)) and (p != np.arange(1000)).sum() > 900


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(5)
    size, pi = rng.integers(0, 900, 500), np.full(500, 0.37)
    out = mixing.flight(pi, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-4


def fill(sizes, weights):
    total, level, capped = 1.5 * sum(sizes.values()), 0.0, set()
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weights[s] for s in free)
        over = {s for s in free if 2 * sizes[s] <= level * weights[s]}
        if not over:
            break
        capped |= over
    return {s: min(2 * sizes[s], level * weights[s]) for s in sizes}


def test_mix_meets_targets(docs, data):
    out = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(tokens(r[1]))) for r in data)
    sizes = Counter()
    for r in data:
        sizes[r[3]] += len(tokens(r[1]))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 2
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_mix_in_many_blocks(spark):
    d = stored(spark, [(i, "w " * (i % 50 + 1), "en", "hot", 0, 1, "", 1, 1, "") for i in range(900)])
    units = d.selectExpr("doc_id", "1 AS copy", "source", "cast(length(text) / 2 as bigint) AS size", "0.3D AS pi", "900L AS n")
    out = mixing.cube_sample(units, block_rows=20).collect()
    assert len(out) == 900 and sum(1e-9 < r["pi"] < 1 - 1e-9 for r in out) <= 1
    want = 0.3 * sum(i % 50 + 1 for i in range(900))
    assert abs(sum(r["pi"] * r["size"] for r in out) - want) < 1e-3


def test_copies_of_a_row_repeated_often_are_numbered_in_ranges(spark):
    grouped = spark.createDataFrame([(1, "a", 3, 25), (2, None, 4, 10), (None, "a", 0, 1), (3, "b", 5, 11)],
                                    "doc_id long, source string, size long, m long")
    got = [tuple(r) for r in mixing.numbered_copies(grouped, most=10).collect()]
    want = [(d, s, z, i) for d, s, z, m in map(tuple, grouped.collect()) for i in range(1, m + 1)]
    assert Counter(got) == Counter(want)


def test_entries_of_a_slice_are_the_words_and_their_beginnings():
    import pyarrow as pa
    w = Words(pa.array(["Abcdefgh ab. abcde", None, "abcde"]))
    lists = [(kind, doc.tolist(), h.tolist()) for kind, doc, h in toxicity._entry_lists(w)]
    assert [k for k, _, _ in lists] == [0] + [1] * len(toxicity.PREFIX_BYTES)
    assert lists[0][1] == [0, 0, 0, 2] and lists[0][2][2] == lists[0][2][3]
    assert lists[1][1] == [0, 0, 2] and len(set(lists[1][2])) == 1      # abcd, three times
    lexicons = [[np.sort(np.array(lists[0][2][2:3], np.uint64))], [np.sort(np.array(lists[1][2][:1] + lists[4][2], np.uint64))]]
    hits = toxicity.hit_counts(pa.array(["Abcdefgh ab. abcde", None, "abcde"]), lexicons)
    assert hits.tolist() == [[1, 3, 3], [0, 0, 0], [1, 1, 1]]


def test_apply_mix_takes_what_mix_says(docs):
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(tokens(r["text"]))
    for r in mixed.collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want


def test_mix_empty(empty):
    mixed = mixing.mix(empty)
    assert mixed.count() == 0 and mixing.apply_mix(empty, mixed).count() == 0


def brute_lines(data):
    """Removed (doc_id, line_no), later matches of earlier lines by Jaccard."""
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    seen, removed = [], Counter()
    for i in order:
        for k, line in enumerate((data[i][1] or "").split("\n")):
            w = tuple(tokens(line.lower()))
            if not w:
                continue
            s = frozenset(w[a:a + 5] for a in range(max(len(w) - 4, 1)))
            if any(4 * len(s & o) >= 3 * len(s | o) for o in seen):
                removed[(data[i][0], k)] += 1
            seen.append(s)
    return removed


def test_line_matches(docs, data):
    got = Counter((r["doc_id"], r["line_no"]) for r in line_dedup.line_matches(docs).collect())
    assert got == brute_lines(data)


def test_short_lines_and_blanks(spark):
    """A line of under five words is one token; blanks and case do not tell lines apart."""
    texts = ["ok then go\nOK\tthen  go \nok then", "\x0bok then\r\nÉ a b c d e f\n\n \n", "é a b c d e f\nok  then go x", "ok then go x"]
    data = [(i, x, "en", "s", 0, 1, "", 1, 1, "") for i, x in enumerate(texts)]
    got = Counter((r["doc_id"], r["line_no"]) for r in line_dedup.line_matches(stored(spark, data)).collect())
    assert got == brute_lines(data) == Counter([(0, 1), (1, 0), (2, 0), (3, 0)])


def test_near_lines(spark):
    import random
    rng = random.Random(1)
    base = [words(rng, 60, 5000) for _ in range(6)]
    data = []
    for i in range(80):
        w = base[i % 6].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        data.append((i, words(rng, 9, 5000) + "\n" + " ".join(w), "en", "s", 0, 1, "", 1, 1, ""))
    got = Counter((r["doc_id"], r["line_no"]) for r in line_dedup.line_matches(stored(spark, data)).collect())
    assert got == brute_lines(data) and len(got) > 20


def test_lines_are_tokenised_once(docs, data, monkeypatch):
    """Splitting and hashing the words is most of the work: every later step reads the written tokens."""
    passes = []
    hashed = line_dedup.hashed_words
    monkeypatch.setattr(line_dedup, "hashed_words", lambda lines: passes.append(1) or hashed(lines))
    got = Counter((r["doc_id"], r["line_no"]) for r in line_dedup.line_matches(docs).collect())
    assert got == brute_lines(data) and len(passes) == 1


def test_line_dedup_plan_stays_short_when_every_bucket_is_counted(spark):
    """The driver keeps many texts of a plan: the table of rarities must not fill them."""
    rng = np.random.default_rng(3)
    lines = [(i, " ".join(map(str, rng.integers(0, 10**6, 300))), "en", "s", 0, 1, "", 1, 1, "") for i in range(1500)]
    codes = line_dedup.rarity_codes(line_dedup.lines_of(stored(spark, lines), "doc_id", "text"))
    plan = spark.range(1).select(F.get(codes, F.col("id").cast("int")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 600_000


def test_without_matches_keeps_clean_documents(docs, data):
    out = line_dedup.without_matches(docs)
    kept = out.collect()
    assert out.columns == docs.columns
    removed = brute_lines(data)
    for r in kept:
        if r["doc_id"] is not None and not any(k[0] == r["doc_id"] for k in removed):
            assert r["text"] == next(x[1] for x in data if x[0] == r["doc_id"])
    # the copies of 4 and the repeated rows of 8 have nothing left; wordless rows stay
    ids = [r["doc_id"] for r in kept]
    assert 5 not in ids and ids.count(8) == 1 and {100, 101, 102, 103} <= set(ids)
    again = line_dedup.line_matches(stored(out.sparkSession, [tuple(r) for r in kept]))
    assert again.count() == 0


def test_lines_empty(empty):
    assert line_dedup.line_matches(empty).count() == 0 and line_dedup.without_matches(empty).count() == 0


def test_language_model_counts_and_base(docs, data):
    got = language_model.score_texts(docs).collect()
    text = {}
    count = Counter()
    for r in data:
        fold = -1 if r[0] is None else zlib.crc32(str(r[0]).encode()) % 7
        if fold != 2:
            count.update([*tokens(r[1]), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in data:
        t = [*tokens(r[1]), None]
        want[(r[0], len(t), sum(count[w] > 0 for w in t), n,
              round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert not text


def test_language_model_is_a_distribution():
    """Mixture weights of a bucket add up to one and EM raises the likelihood."""
    rng = np.random.default_rng(0)
    grid = np.stack([rng.integers(0, 6, 200), rng.integers(-1, 40, 200), rng.integers(10, 60, 200), rng.integers(1, 50, 200)], 1)
    w = language_model.fit_weights(grid, 1000)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0
    p = np.stack([np.where(grid[:, i] < 0, 0, 2.0 ** (-(grid[:, i] + 0.5) / language_model.GRID)) for i in (1, 2)]
                 + [np.full(200, 1 / 1001)], 1)
    ll = lambda x: (np.log((x[grid[:, 0]] * p).sum(1)) * grid[:, 3]).sum()
    start = np.tile([0.3, 0.6, 0.1], (language_model.BUCKETS, 1))
    start[0] = [0, 0.8, 0.2]
    assert ll(w) > ll(start)


def test_language_model_empty(empty):
    assert language_model.score_texts(empty).count() == 0


def brute_units(data):
    order = sorted((i for i in range(len(data)) if data[i][0] is not None), key=lambda i: data[i][0])
    seen, removed = {}, Counter()
    for i in order:
        t = data[i][1] or ""
        spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        unit = []
        for j, x in enumerate(spans):
            unit.append(x)
            last = j + 1 == len(spans)
            if x[2][-1] in ".!?" or last or re.search("[\n\r]", t[x[1]:spans[j + 1][0]]):
                if len(unit) >= 8:
                    key = tuple(u[2].translate(LOWER) for u in unit)
                    if key in seen:
                        removed[(data[i][0], unit[0][0], unit[-1][1], seen[key][0], seen[key][1])] += 1
                    else:
                        seen[key] = (data[i][0], unit[0][0])
                unit = []
    return removed


def test_repeated_units(docs, data):
    got = Counter((r["doc_id"], r["start"], r["end"], r["kept_doc_id"], r["kept_start"])
                  for r in substrings.repeated_units(docs).collect() if r["doc_id"] is not None)
    assert got == brute_units(data)


def test_without_repeats(docs, data):
    spans = defaultdict(list)
    for (i, start, end, _, _), n in brute_units(data).items():
        spans[i].append((start, end))
    for r in substrings.without_repeats(docs).collect():
        if r["doc_id"] is None or r["doc_id"] == 8:
            continue
        text = next(x[1] for x in data if x[0] == r["doc_id"])
        assert [(s["start"], s["end"]) for s in r["removed"]] == sorted(spans[r["doc_id"]])
        for start, end in sorted(spans[r["doc_id"]], reverse=True):
            text = text[:start] + text[end:]
        assert r["text"] == text


def test_units_empty(empty):
    assert substrings.repeated_units(empty).count() == 0


def brute_components(data):
    sets = [shingles(r[1]) for r in data]
    par = list(range(len(data)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                par[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(data)):
        groups[find(i)].append(i)
    out = Counter()
    for g in groups.values():
        ids = [data[i][0] for i in g if data[i][0] is not None]
        for i in g:
            out[(data[i][0], len(sets[i]), min(ids) if ids else None)] += 1
    return out


def test_ngram_components(docs, data):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect())
    assert got == brute_components(data)


def test_ngram_chains_and_clusters(spark):
    """Near copies that link through one another, and two clusters that share a passage."""
    import random
    rng = random.Random(8)
    data = []
    for c in range(3):
        text = words(rng, 120, 9000).split()
        for i in range(25):
            if i % 5 == 4:
                text[rng.randrange(120)] = f"drift{c}x{i}"
            w = list(text)
            w[rng.randrange(120)] = f"own{c}x{i}"
            data.append((c * 100 + i, " ".join(w), "en", "s", 0, 1, "", 1, 1, ""))
    passage = words(rng, 60, 9000)
    data += [(900 + i, passage + " " + words(rng, 40 + i, 9000), "en", "s", 0, 1, "", 1, 1, "") for i in range(30)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(stored(spark, data)).collect())
    assert got == brute_components(data)


def test_one_per_component(docs, data):
    out = ngram_join.one_per_component(docs)
    want = brute_components(data)
    assert out.columns == docs.columns
    ids = Counter(r["doc_id"] for r in out.collect())
    assert all(n == 1 for i, n in ids.items() if i is not None)
    assert {i for i in ids if i is not None} == {c for (i, _, c) in want if c is not None}


def test_ngram_empty(empty):
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.one_per_component(empty).count() == 0


def labelled(spark, n=400, seed=2):
    import random
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = words(rng, rng.randrange(20, 80), 900).split()
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilesome", "grumpest", "nastoid", "nastical"])
        data.append((i, " ".join(w), "en", "s", 0, 1, "", 1, 1, ""))
        labels.append((i, 1, int(bad)))
    data += rows()[60:]
    return stored(spark, data), spark.createDataFrame([*labels, (None, None, None), (3, 0, None)], "doc_id bigint, quality int, toxic int"), data


def test_toxicity_held_out_accuracy(spark):
    docs, labels, data = labelled(spark)
    got = toxicity.score_texts(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]) > 0.9


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    score = lambda lab: {(r["doc_id"], r["score"]) for r in toxicity.score_texts(docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_toxicity_filter_and_unlearnable(spark, docs, empty):
    d, labels, _ = labelled(spark)
    kept = toxicity.without_toxic(d, labels)
    assert kept.columns == d.columns
    bad = {i for i in range(0, 400, 5)}
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(bad & ids) < 8 and len(set(range(400)) - bad - ids) < 8
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in toxicity.score_texts(docs, none).collect()} == {0.0}
    assert toxicity.without_toxic(docs, none).count() == docs.count()
    assert toxicity.score_texts(empty, labels).count() == 0


def test_pattern_votes_round_trip():
    v = np.random.default_rng(0).integers(-1, 2, (50, toxicity.VOTERS))
    assert (toxicity.pattern_votes(toxicity.pattern_code(v)) == v).all()


def test_word_pattern_and_columns():
    assert WORD_PATTERN == r"[^\x20\x09-\x0D]+" and COLUMNS.startswith("doc_id")
