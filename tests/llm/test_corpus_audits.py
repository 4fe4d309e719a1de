"""Benchmark decontamination, source divergence and cross-tokenizer alignment
against brute force, on rows of every awkward kind."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import rows, stored, words

from lexkit.llm import alignment, decontamination, divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, doc_id int, items string"


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return stored(spark, data)


@pytest.fixture(scope="module")
def empty(spark):
    return stored(spark, [])


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def items_of(data):
    rng = random.Random(5)
    out = []
    for k, i in enumerate((4, 9, 12, 20, 31)):          # passages of documents, of all lengths
        w = plain_words(data[i][1])
        a = rng.randrange(0, max(1, len(w) - 25))
        out.append((k, " ".join(words(rng, 3).split() + w[a:a + (25, 12, 10, 9, 4)[k]] + words(rng, k).split()).upper()))
    return out + [(10, "two words"), (11, "漢字 É ü"), (12, words(rng, 40)), (13, None), (14, " . "), (None, "x" * 5000),
                  (1, out[1][1]), (15, out[0][1]), (2, "two words")]


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (50, 2), (300, 3), (200, 1)):
        codes = np.append(rng.integers(0, kinds, n), kinds)
        want = sorted(range(n + 1), key=lambda i: codes[i:].tolist())  # noqa: B023
        assert decontamination.suffix_order(codes.astype(np.int64)).tolist() == want


def brute_hits(data, items, window=10):
    wins = defaultdict(set)
    for name, text in items:
        w = plain_words(text)
        for j in range(len(w) - min(window, len(w)) + 1 if w else 0):
            wins[tuple(w[j:j + window])].add("" if name is None else str(name))
    out = []
    for i, text, *_ in data:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in wins:
                    found |= wins[tuple(w[p:p + n])]
                    hit |= set(range(p, p + n))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_words", [decontamination.BLOCK_WORDS, 40])
def test_hits_equal_brute_force(spark, docs, data, block_words):
    items = items_of(data)
    table = stored(spark, [(i, t, 1, "x") for i, t in items], ITEMS)
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"])
           for r in decontamination.hits(docs, table, block_words=block_words).collect()]
    want = brute_hits(data, items)
    assert sorted(got, key=str) == sorted(want, key=str) and sum(n > 0 for _, _, n, _ in want) > 5
    left = decontamination.decontaminated(docs, table, block_words=block_words)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _, n, _ in want if not n)


def test_longest_matches(spark, docs, data):
    items = [(i, t) for i, t in items_of(data) if i is not None]
    table = stored(spark, [(i, t, 1, "x") for i, t in items], ITEMS)
    got = {(r["doc_id"], r["start"], r["item_id"], r["item_start"], r["n_words"])
           for r in decontamination.longest_matches(docs, table).collect()}
    want = set()
    for i, text, *_ in data:
        w = plain_words(text)
        for name, item in items:
            v = plain_words(item)
            need = min(10, len(v))
            at = defaultdict(list)
            for q, x in enumerate(v):
                at[x].append(q)
            for p in range(len(w)):
                for q in at.get(w[p], ()):
                    if p and q and w[p - 1] == v[q - 1]:
                        continue
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= need:
                        want.add((i, p, str(name), q, n))
    assert got == want and len(want) > 5


def test_hits_of_empty_tables(spark, docs, empty, data):
    none = stored(spark, [], ITEMS)
    assert decontamination.hits(empty, stored(spark, [(1, "a b", 1, "")], ITEMS)).count() == 0
    got = decontamination.hits(docs, none).collect()
    assert len(got) == len(data) and all(not r["spans"] and not r["items"] for r in got)
    assert decontamination.longest_matches(docs, none).count() == 0


def brute_audit(data, min_docs):
    f = lambda p, q: (p - q) ** 2 // (p + q)
    texts = [(lang or "", source or "", [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
             for _, text, lang, source, *_ in data]
    out = []
    for lang in {x[0] for x in texts}:
        mine = [(s, w) for g, s, w in texts if g == lang]
        df = Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in df.items() if n >= min_docs]
        sources = sorted({s for s, _ in mine})
        count = {s: Counter(t for g, w in mine if g == s for t in w) for s in sources}
        count[None] = sum(count.values(), Counter())
        p = {}
        for s, c in count.items():
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(r, sum(f(p[s][t], p[r][t]) for t in kept)) for r in sources if r != s]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if count[s][t] > 0 and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return out


def audit_rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("min_docs", [1, 3, 10, 10_000])
def test_audit_equals_brute_force(docs, data, min_docs):
    # letters alone make the same term of all numbered words: also test with many terms
    assert audit_rows(divergence.audit(docs, min_docs=min_docs)) == sorted(brute_audit(data, min_docs))


def test_audit_of_many_terms(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    data = [(i, " ".join(rng.choice(vocabulary[:20 + 15 * (i % 9)]) for _ in range(rng.randrange(0, 60))), f"l{i % 2}", f"s{i % 9}")
            for i in range(300)]
    table = stored(spark, data, "doc_id bigint, text string, lang string, source string")
    assert audit_rows(divergence.audit(table)) == sorted(brute_audit(data, 10))


def test_tree_shares_paths():
    """A node-ancestor combination is computed for all terms that share it; cutting the tree changes no sum."""
    paths = sorted([[(0, 1), (1, 2), (2, 1)], [(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 5)], [(1, 2), (2, 1)], [(0, 3), (2, 1)]])
    share, zero = lambda s, n: 1000 * (n + 2 + s), lambda s: 2000 + 1000 * s

    def sums(part, times):
        items = [x for p in part for x in p]
        column = lambda f: np.array([f(s, n) for s, n in items], np.int64)
        out = divergence.tree_corrections(
            np.zeros(len(part), np.int64), np.cumsum([0] + [len(p) for p in part]), column(lambda s, n: s), column(lambda s, n: n),
            column(share), column(lambda s, n: zero(s)), np.array(times, np.int64))
        return Counter(dict(zip(zip(*[x.tolist() for x in out[:3]], strict=True), out[3].tolist(), strict=True)))

    times = [2, 1, 4, 3, 7]
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = Counter()
    for p, m in zip(paths, times, strict=True):
        for j, (r, n) in enumerate(p):
            for s, k in p[:j]:
                a, b, a0, b0 = share(s, k), share(r, n), zero(s), zero(r)
                want[0, s, r] += m * (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0))
    cut = sums(paths[:2], times[:2])
    cut.update(sums(paths[2:], times[2:]))
    assert sums(paths, times) == want == cut


def test_audit_of_an_empty_table(empty):
    assert divergence.audit(empty).count() == 0


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    found, count = [], Counter()
    for i, text in texts:
        groups, links, ids = [], [], ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = ([bytes(byte[c] for c in a.id_to_token(k)) for k in ids[0]],
                   [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]])
            if any(b"".join(x) != (" " + text).encode() for x in raw):
                ids = [], []
            else:
                ends = [np.cumsum([len(x) for x in side]) for side in raw]
                starts = [np.concatenate([[0], e[:-1]]) for e in ends]
                last = (0, 0)
                for e in np.intersect1d(*ends):
                    now = [int(np.searchsorted(x, e)) + 1 for x in ends]
                    groups.append("|".join(",".join(map(str, side[x:y])) for side, x, y in zip(ids, last, now, strict=True)))
                    last = now
                for k, (s, e) in enumerate(zip(starts[0], ends[0], strict=True)):
                    lo, hi = np.searchsorted(ends[1], s, side="right"), np.searchsorted(starts[1], e)
                    links += [(ids[0][k], ids[1][j]) for j in range(lo, hi)]
        count.update(links)
        found.append((i, ids, groups, links))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(i, len(x), len(y), len(g), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, (x, y), g, links in found]


def test_alignment_equals_brute_force(spark, data):
    more = [" lead", "tail ", " ", "   ", "x▁y", "a\x00b", "　x y", "a  b  c\n d", "</s> <0x41> <unk> <|endoftext|>", "日本語 テキスト " * 50,
            "é " * 10, "don't  I'll\tx", "  x  y", "naïve café́", "🎉 🎉🎉 x"]
    data = [*data, *[(200 + i, t, "en", "s", 1, 1, "b", 1, 1, "l") for i, t in enumerate(more)]]
    got = alignment.align_documents(stored(spark, data)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    want = brute_alignment([(r[0], r[1]) for r in data])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r[1] == 0 and t[1] for r, t in zip(want, data, strict=True))           # a text that does not come back


def test_a_slice_alone(data):
    import pyarrow as pa
    texts = [r[1] for r in data]
    doc, window, pair = alignment.slice_rows("0", pa.array(range(len(texts)), pa.int64()), pa.array(texts), alignment.tokenizers())
    want = brute_alignment(enumerate(texts))
    assert doc.column("groups_sha256").to_pylist() == [w[-1] for w in want]
    assert sum(pair.column("n").to_pylist()) == sum(w[4] for w in want)


def test_alignment_of_an_empty_table(empty):
    assert alignment.align_documents(empty).count() == 0
