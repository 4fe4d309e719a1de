"""Independent DuckDB SQL for every registered query that SQL can express.

The tables documents, benchmark, embeddings, ... are views over the same
parquet files.  Each string here is written from the operator definitions,
not generated from the Spark plans.
"""

from __future__ import annotations

from lexkit.functions.text import TOKEN_PATTERN

ORACLE: dict[str, str] = {}

TOK = TOKEN_PATTERN


def _tok(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOK}', 0)"


CORPUS = ("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN source ELSE '' END AS title, text, lang, source "
          "FROM documents")
DOC_TEXT = "CASE WHEN length(title) > 0 THEN title || ' ' || text ELSE text END"

# corpus tokens, postings, statistics, query terms
BASE_CTES = f"""
corpus AS ({CORPUS}),
dt AS (SELECT doc_id, lang, {_tok('lower(' + DOC_TEXT + ')')} AS toks FROM corpus),
dl AS (SELECT doc_id, len(toks) AS dl FROM dt),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) GROUP BY doc_id, token),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
dft AS (SELECT token, count(*) AS df FROM post GROUP BY token),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('lower(text)')}) AS token FROM benchmark)
"""

BM25_TF = "(post.tf * 2.6e0 / (post.tf + 1.6e0 * (0.25e0 + 0.75e0 * dl.dl / st.avgdl)))"
IDF = "ln(1e0 + (st.n - dft.df + 0.5e0) / (dft.df + 0.5e0))"


def bm25_run(depth: int, query_filter: str = "") -> str:
    """CTEs ending in run(query_id, doc_id, score, rank)."""
    return f"""{BASE_CTES},
qw AS (SELECT qt.query_id, qt.token, {IDF} AS weight FROM qt JOIN dft USING (token), st {query_filter}),
sc AS (SELECT qw.query_id, post.doc_id, sum(qw.weight * {BM25_TF}) AS score
       FROM post JOIN qw USING (token) JOIN dl USING (doc_id), st GROUP BY qw.query_id, post.doc_id),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
        FROM sc) WHERE rank <= {depth})"""


QRELS_SELECT = """SELECT b.item_id AS query_id, d.doc_id, 1 AS relevance
  FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text)"""
QRELS_CTE = f"qrels AS ({QRELS_SELECT})"

ORACLE["bm25_top10"] = f"""WITH {bm25_run(10)}
SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM run"""

ORACLE["bm25_block_max"] = f"""WITH {bm25_run(10).replace("qt AS (SELECT DISTINCT item_id AS query_id, unnest(" + _tok('lower(text)') + ") AS token FROM benchmark)",
    "qt AS (SELECT DISTINCT query_id, unnest(" + _tok('lower(text)') + """) AS token FROM (SELECT 'b' || item_id::VARCHAR AS query_id, text FROM benchmark
      UNION ALL SELECT 'c:' || conv_id::VARCHAR || ':' || turn::VARCHAR, text FROM conversations WHERE role = 'user'))""")}
SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM run"""

ORACLE["bm25_batch_avgdl"] = f"""WITH {bm25_run(10).replace("/ st.avgdl)", "/ bl.avgdl)").replace("JOIN dl USING (doc_id), st GROUP", "JOIN dl USING (doc_id) JOIN bl USING (doc_id), st GROUP").replace("\nst AS (", """
bl AS (
  SELECT doc_id, avg(dl) OVER (PARTITION BY r // 128) AS avgdl FROM (SELECT c.doc_id, dl.dl, row_number() OVER (
    ORDER BY coalesce(length(CASE WHEN length(title) > 0 THEN title || ' ' || text ELSE text END), 0) DESC, c.doc_id) - 1 AS r
    FROM corpus c JOIN dl USING (doc_id))),
st AS (""", 1)}
SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM run"""

ORACLE["qrels_contains"] = f"""WITH {QRELS_CTE} SELECT query_id, doc_id, relevance::INTEGER AS relevance FROM qrels"""

ORACLE["term_frequency"] = f"""WITH {BASE_CTES}
SELECT post.doc_id, token, tf, dl.dl::BIGINT AS dl FROM post JOIN dl USING (doc_id)"""

ORACLE["term_presence"] = f"""WITH {BASE_CTES} SELECT query_id, token FROM qt"""

ORACLE["idf_table"] = f"""WITH {BASE_CTES}
SELECT token, df, round({IDF}, 6) AS idf FROM dft, st"""

ORACLE["doc_length"] = f"""WITH {BASE_CTES}
SELECT doc_id, dl::BIGINT AS dl, round((SELECT avgdl FROM st), 6) AS avgdl FROM dl"""

ORACLE["corpus_size"] = """SELECT source AS dataset, count(*) AS n_rows FROM documents GROUP BY ROLLUP (source)"""


def _metrics_sql(run_cte: str, depth_ks: tuple[int, ...], group: str = "") -> str:
    """Metric CTEs over run(query_id, doc_id, score, rank[, dataset]) and qrels."""
    ks = ", ".join(str(k) for k in depth_ks)
    g = f"{group}, " if group else ""
    gj = f" AND r.{group} = q.{group}" if group else ""
    return f"""{run_cte},
{QRELS_CTE.replace('qrels AS', 'qrels0 AS')},
qrels AS (SELECT {('c.' + group + ', ') if group else ''}q.query_id, q.doc_id, q.relevance FROM qrels0 q
          {'JOIN corpus c USING (doc_id)' if group else ''}),
judged_docs AS (SELECT DISTINCT {g}doc_id FROM qrels),
nrel AS (SELECT {g}query_id, count(*) AS nrel FROM qrels WHERE relevance > 0 GROUP BY ALL),
rel AS (SELECT r.*, coalesce(q.relevance, 0) AS relevance,
               CASE WHEN coalesce(q.relevance, 0) > 0 THEN 1 ELSE 0 END AS is_rel,
               CASE WHEN j.doc_id IS NULL THEN 1 ELSE 0 END AS is_hole
        FROM run r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id{gj}
        LEFT JOIN judged_docs j ON r.doc_id = j.doc_id{' AND r.' + group + ' = j.' + group if group else ''}),
rel2 AS (SELECT *, sum(is_rel) OVER (PARTITION BY {g}query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_rel FROM rel),
ks AS (SELECT unnest([{ks}]) AS k),
got AS (SELECT {g}query_id, k, sum(relevance / log2(rank + 1)) AS dcg, sum(is_rel) AS hits,
               sum(CASE WHEN is_rel = 1 THEN cum_rel / rank ELSE 0 END) AS ap_sum,
               min(CASE WHEN is_rel = 1 THEN rank END) AS first_rel, sum(is_hole) AS holes
        FROM rel2 JOIN ks ON rank <= k GROUP BY ALL),
ideal AS (SELECT {g}query_id, k, sum(relevance / log2(irank + 1)) AS idcg FROM
          (SELECT *, row_number() OVER (PARTITION BY {g}query_id ORDER BY relevance DESC, doc_id) AS irank
           FROM qrels WHERE relevance > 0) JOIN ks ON irank <= k GROUP BY ALL),
base AS (SELECT * FROM (SELECT DISTINCT {g}query_id FROM run) INTERSECT SELECT DISTINCT {g}query_id FROM qrels),
pq AS (SELECT {'b.' + group + ', ' if group else ''}b.query_id, ks.k,
          CASE WHEN coalesce(i.idcg, 0) > 0 THEN coalesce(gt.dcg, 0) / i.idcg ELSE 0 END AS ndcg,
          CASE WHEN coalesce(n.nrel, 0) > 0 THEN coalesce(gt.ap_sum, 0) / n.nrel ELSE 0 END AS ap,
          CASE WHEN coalesce(n.nrel, 0) > 0 THEN coalesce(gt.hits, 0) / n.nrel ELSE 0 END AS recall,
          coalesce(gt.hits, 0) / ks.k AS precision,
          coalesce(1e0 / gt.first_rel, 0) AS rr,
          CASE WHEN coalesce(n.nrel, 0) > 0 THEN coalesce(gt.hits, 0) / least(n.nrel, ks.k) ELSE 0 END AS rcap,
          coalesce(gt.holes, 0) / ks.k AS hole
       FROM base b CROSS JOIN ks
       LEFT JOIN got gt ON gt.query_id = b.query_id AND gt.k = ks.k{' AND gt.' + group + ' = b.' + group if group else ''}
       LEFT JOIN ideal i ON i.query_id = b.query_id AND i.k = ks.k{' AND i.' + group + ' = b.' + group if group else ''}
       LEFT JOIN nrel n ON n.query_id = b.query_id{' AND n.' + group + ' = b.' + group if group else ''}),
nj AS (SELECT {g}count(DISTINCT query_id) AS n_judged FROM qrels {'GROUP BY ' + group if group else ''}),
sums AS (SELECT {g}k, count(*) AS n_eval, sum(ndcg) AS ndcg, sum(ap) AS ap, sum(recall) AS recall,
                sum(precision) AS precision, sum(rr) AS rr, sum(rcap) AS rcap, sum(hole) AS hole
         FROM pq GROUP BY ALL),
metrics AS (
  {' UNION ALL '.join(
      f"SELECT {('s.' + group + ', ') if group else ''}'{name}' AS metric, k, round(s.{c} / {'nj.n_judged' if c in ('rr', 'rcap', 'hole') else 's.n_eval'}, 5) * 100 AS value "
      f"FROM sums s {'JOIN nj USING (' + group + ')' if group else ', nj'}"
      for c, name in (("ndcg", "NDCG"), ("ap", "MAP"), ("recall", "Recall"), ("precision", "P"),
                      ("rr", "MRR"), ("rcap", "R_cap"), ("hole", "Hole")))})"""


_EVAL_KS = (1, 3, 5, 10, 100, 1000)
_JUDGED_ONLY = f"WHERE qt.query_id IN (SELECT query_id FROM ({QRELS_SELECT}))"

ORACLE["bm25_eval"] = f"""WITH {_metrics_sql(bm25_run(1000, _JUDGED_ONLY), _EVAL_KS)}
SELECT metric, k::BIGINT AS k, round(value, 6) AS value FROM metrics"""

ORACLE["metric_report"] = f"""WITH {_metrics_sql(bm25_run(1000, _JUDGED_ONLY), _EVAL_KS)}
SELECT metric || '@' || k::VARCHAR AS name, format('{{:.1f}}', value) AS value FROM metrics"""

ORACLE["exclude_self"] = f"""WITH {bm25_run(10).replace('qt AS (', 'qt0 AS (').replace('qw AS (', f"""holder AS (SELECT query_id, min(doc_id) AS own FROM ({QRELS_SELECT}) GROUP BY query_id),
owner AS (SELECT own, min(query_id) AS query_id FROM holder GROUP BY own),
qt AS (SELECT coalesce(own, -1 - qt0.query_id) AS query_id, token FROM qt0 LEFT JOIN owner USING (query_id)),
qw AS (""").replace('JOIN dl USING (doc_id), st GROUP', 'JOIN dl USING (doc_id), st WHERE qw.query_id <> post.doc_id GROUP')}
SELECT query_id, doc_id, rank::BIGINT AS rank FROM run"""

ORACLE["learned_fill_zero"] = f"""WITH {BASE_CTES},
qw AS (SELECT qt.query_id, qt.token, {IDF} - 8e0 AS weight FROM qt JOIN dft USING (token), st),
sc AS (SELECT qw.query_id, post.doc_id, sum(qw.weight * (post.tf / (post.tf + exp(0e0)))) AS score
       FROM post JOIN qw USING (token) GROUP BY qw.query_id, post.doc_id),
every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(sc.score, 0e0) AS score FROM benchmark b CROSS JOIN documents d
          LEFT JOIN sc ON sc.query_id = b.item_id AND sc.doc_id = d.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM every) WHERE rank <= 10"""

ORACLE["learned_top10"] = f"""WITH {BASE_CTES},
qw AS (SELECT qt.query_id, qt.token, {IDF} AS weight FROM qt JOIN dft USING (token), st),
sc AS (SELECT qw.query_id, post.doc_id, sum(qw.weight * (post.tf / (post.tf + exp(0e0)))) AS score
       FROM post JOIN qw USING (token) GROUP BY qw.query_id, post.doc_id),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
        FROM sc) WHERE rank <= 10)
SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM run"""


def _by_lang_sql() -> str:
    ks = _EVAL_KS
    run = f"""{BASE_CTES.replace('dl AS (SELECT doc_id, len(toks) AS dl FROM dt)', 'dl AS (SELECT doc_id, lang, len(toks) AS dl FROM dt)')},
q0 AS ({QRELS_SELECT}),
lq AS (SELECT DISTINCT c.lang, q0.query_id FROM q0 JOIN corpus c USING (doc_id)),
lpost AS (SELECT post.*, dl.lang, dl.dl FROM post JOIN dl USING (doc_id)),
lst AS (SELECT lang, count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl GROUP BY lang),
ldf AS (SELECT lang, token, count(*) AS df FROM lpost GROUP BY lang, token),
lqw AS (SELECT lq.lang, qt.query_id, qt.token, ln(1e0 + (lst.n - ldf.df + 0.5e0) / (ldf.df + 0.5e0)) AS weight, lst.avgdl
        FROM qt JOIN lq USING (query_id) JOIN ldf ON ldf.lang = lq.lang AND ldf.token = qt.token JOIN lst ON lst.lang = lq.lang),
sc AS (SELECT lqw.lang, lqw.query_id, p.doc_id,
              sum(lqw.weight * (p.tf * 2.6e0 / (p.tf + 1.6e0 * (0.25e0 + 0.75e0 * p.dl / lqw.avgdl)))) AS score
       FROM lpost p JOIN lqw ON p.lang = lqw.lang AND p.token = lqw.token GROUP BY ALL),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
        FROM sc) WHERE rank <= {max(ks)})"""
    return f"""WITH {_metrics_sql(run, ks, group='lang')}
SELECT metric, k::BIGINT AS k, round(avg(value), 6) AS value, count(*)::BIGINT AS members FROM metrics GROUP BY metric, k"""


ORACLE["bm25_eval_by_lang"] = _by_lang_sql()


# ---------------------------------------------------------------- text functions

from lexkit.functions.text import (  # noqa: E402
    ARTICLES, ASCII_PUNCTUATION, NORM_DELETE, NORM_MAP, NORM_MULTI, RUN_SEP)


def sql_str(s: str) -> str:
    """A string literal spelled with chr() so no character needs escaping."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")" if s else "''"


def sql_normalize_text(x: str) -> str:
    src = "".join(chr(cp) for out, cps in NORM_MAP.items() for cp in cps) + "".join(chr(c) for c in NORM_DELETE)
    dst = "".join(out for out, cps in NORM_MAP.items() for _ in cps)
    e = f"translate({x}, {sql_str(src)}, {sql_str(dst)})"
    for a, b in NORM_MULTI:
        e = f"replace({e}, {sql_str(a)}, {sql_str(b)})"
    return e


_WORD = r"\p{L}\p{N}\p{M}_"
_ART = ("regexp_replace(@X@, '(^|[^" + _WORD + "])(" + "|".join(ARTICLES) + ")([^" + _WORD + "]|$)', "
        "'\\1 \\3', 'g')")
_WS = r"[\s\x{0B}\x{85}\p{Z}]+"


def sql_normalize_answer(x: str) -> str:
    t = f"translate(lower({x}), {sql_str(ASCII_PUNCTUATION)}, '')"
    # RE2 has no Unicode word boundary: match the boundary characters and put
    # them back; two passes catch articles whose boundary the previous match used
    t = _ART.replace("@X@", _ART.replace("@X@", t))
    return f"trim(regexp_replace({t}, '{_WS}', ' ', 'g'))"


def sql_answer_tokens(n: str) -> str:
    return f"(CASE WHEN length({n}) = 0 THEN []::VARCHAR[] ELSE string_split({n}, ' ') END)"


def sql_token_run(toks: str) -> str:
    return f"(chr(1) || array_to_string({toks}, chr(1)) || chr(1))"


assert RUN_SEP == chr(1)

#: The Latin-1 letters of each combining mark, and their bases.
LATIN_MARKS = [(0x300, "\u00c0\u00c8\u00cc\u00d2\u00d9\u00e0\u00e8\u00ec\u00f2\u00f9", "AEIOUaeiou"),
               (0x301, "\u00c1\u00c9\u00cd\u00d3\u00da\u00dd\u00e1\u00e9\u00ed\u00f3\u00fa\u00fd", "AEIOUYaeiouy"),
               (0x302, "\u00c2\u00ca\u00ce\u00d4\u00db\u00e2\u00ea\u00ee\u00f4\u00fb", "AEIOUaeiou"),
               (0x303, "\u00c3\u00d1\u00d5\u00e3\u00f1\u00f5", "ANOano"),
               (0x308, "\u00c4\u00cb\u00cf\u00d6\u00dc\u00e4\u00eb\u00ef\u00f6\u00fc\u00ff", "AEIOUaeiouy"),
               (0x30A, "\u00c5\u00e5", "Aa"), (0x327, "\u00c7\u00e7", "Cc")]


def sql_nfd(x: str) -> str:
    """Accents put in as ``nfd_decompose`` does, then decomposed form by form."""
    steps = [("a", "\u00e1"), ("e", "\u1ec1"), ("i", "\u00ef\u0323"), ("o", "\u01ed"), ("u", "\u01d6"),
             ("q", "q\u0307\u0323"), (".", "\ud558"), (",", "\uac01"),
             ("\u1ec1", "e\u0302\u0300"), ("\u00ef\u0323", "i\u0323\u0308"), ("\u01ed", "o\u0328\u0304"),
             ("\u01d6", "u\u0308\u0304"), ("q\u0307\u0323", "q\u0323\u0307"), ("\ud558", "\u1112\u1161"),
             ("\uac01", "\u1100\u1161\u11a8")]
    steps += [(c, b + chr(mark)) for mark, letters, bases in LATIN_MARKS for c, b in zip(letters, bases, strict=True)]
    for a, b in steps:
        x = f"replace({x}, {sql_str(a)}, {sql_str(b)})"
    return x


ORACLE["nfd_decompose"] = f"""SELECT conv_id, turn, length(n) AS n_chars_nfd, md5(n) AS nfd_md5
FROM (SELECT conv_id, turn, {sql_nfd('text')} AS n FROM conversations)"""

ORACLE["normalize_text"] = f"""SELECT doc_id, md5({sql_normalize_text('text')}) AS norm_md5,
  length({sql_normalize_text('text')})::BIGINT AS n_chars FROM documents"""

ORACLE["simple_tokenize"] = f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, chr(1))) AS tokens_md5
FROM (SELECT doc_id, {_tok('lower(text)')} AS t FROM documents)"""

ORACLE["preprocess_corpus"] = f"""WITH corpus AS ({CORPUS})
SELECT doc_id, md5(lower({sql_normalize_text(DOC_TEXT)})) AS text_md5 FROM corpus"""

ORACLE["normalize_answer"] = f"""SELECT conv_id, turn, md5(n) AS norm_md5, len({sql_answer_tokens('n')})::BIGINT AS n_words
FROM (SELECT conv_id, turn, {sql_normalize_answer('text')} AS n FROM conversations)"""


# ---------------------------------------------------------------- answers (V9)

def _qa_hits_sql() -> str:
    return f"""{bm25_run(100)},
ctxs AS (SELECT run.query_id AS question_id, run.rank - 1 AS ctx_pos, d.text FROM run JOIN documents d USING (doc_id)),
cr AS (SELECT question_id, ctx_pos, text IS NULL AS is_null,
              {sql_token_run(_tok('lower(nfc_normalize(text))'))} AS trun FROM ctxs),
ar AS (SELECT question_id, len(t) AS alen, {sql_token_run('t')} AS arun
       FROM (SELECT item_id AS question_id, {_tok('lower(nfc_normalize(text))')} AS t FROM benchmark)),
hits AS (SELECT cr.question_id, cr.ctx_pos,
                bool_or(NOT cr.is_null AND ar.alen IS NOT NULL AND (ar.alen = 0 OR contains(cr.trun, ar.arun))) AS hit
         FROM cr LEFT JOIN ar USING (question_id) GROUP BY ALL),
first AS (SELECT question_id, min(CASE WHEN hit THEN ctx_pos END) AS first_hit, count(*) AS n_ctx FROM hits GROUP BY ALL),
wq AS (SELECT max(n_ctx) AS w, (SELECT count(*) FROM benchmark) AS nq FROM first),
curve AS (SELECT k, (SELECT count(*) FROM first WHERE first_hit IS NOT NULL AND first_hit + 1 <= k) AS hits
          FROM (SELECT unnest(range(1, (SELECT w FROM wq) + 1)) AS k))"""


ORACLE["answer_hits"] = f"""WITH {_qa_hits_sql()}
SELECT question_id::BIGINT AS question_id, ctx_pos::BIGINT AS ctx_pos, hit FROM hits"""

ORACLE["answer_hits_curve"] = f"""WITH {_qa_hits_sql()}
SELECT k::BIGINT AS k, hits::BIGINT AS hits, round(hits / nq, 6) AS recall FROM curve, wq"""

ORACLE["answer_recall_at_k"] = f"""WITH {_qa_hits_sql()}
SELECT k::BIGINT AS k, round(hits / nq * 100e0, 6) AS recall FROM curve, wq WHERE k IN (5, 10, 20, 100)"""


# ---------------------------------------------------------------- reader

READER_CTES = f"""
preds AS (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS pred_id, conv_id, turn, text AS prediction
          FROM conversations WHERE role = 'assistant'),
users AS (SELECT conv_id, turn AS t_turn, text AS truth FROM conversations WHERE role = 'user'),
pairs AS (SELECT p.pred_id, u.t_turn AS truth_id, p.prediction AS pred, u.truth FROM preds p JOIN users u
          ON u.conv_id = p.conv_id AND (u.t_turn = p.turn - 1 OR u.t_turn = p.turn + 1)),
np AS (SELECT pred_id, truth_id, {sql_normalize_answer('pred')} AS npred, {sql_normalize_answer('truth')} AS ntruth FROM pairs),
tk AS (SELECT pred_id, truth_id, {sql_answer_tokens('npred')} AS pt, {sql_answer_tokens('ntruth')} AS tt,
              npred = ntruth AS em FROM np),
pc AS (SELECT pred_id, truth_id, tok, count(*) AS cp FROM (SELECT pred_id, truth_id, unnest(pt) AS tok FROM tk) GROUP BY ALL),
tc AS (SELECT pred_id, truth_id, tok, count(*) AS ct FROM (SELECT pred_id, truth_id, unnest(tt) AS tok FROM tk) GROUP BY ALL),
common AS (SELECT pred_id, truth_id, sum(least(cp, ct)) AS same FROM pc JOIN tc USING (pred_id, truth_id, tok) GROUP BY ALL),
f AS (SELECT tk.pred_id, tk.truth_id, tk.em, coalesce(c.same, 0) AS same, len(pt) AS np, len(tt) AS nt
      FROM tk LEFT JOIN common c USING (pred_id, truth_id)),
f1 AS (SELECT pred_id, em, CASE WHEN same = 0 THEN 0e0
              ELSE 2 * (same / np) * (same / nt) / ((same / np) + (same / nt)) END AS f1 FROM f),
per AS (SELECT pred_id, max(em::INTEGER) AS em, max(f1) AS f1 FROM f1 GROUP BY pred_id)"""

ORACLE["reader_scores"] = f"""WITH {READER_CTES}
SELECT pred_id, em::BIGINT AS em, round(f1, 6) AS f1 FROM per"""

ORACLE["reader_eval"] = f"""WITH {READER_CTES}
SELECT count(*) AS n, round(avg(em) * 100, 6) AS em, round(avg(f1) * 100, 6) AS f1 FROM per"""


# ---------------------------------------------------------------- vectors

VEC_CTES = """
ev AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
cent AS (SELECT label, dim, avg(x) AS value FROM ev GROUP BY ALL),
cn AS (SELECT label, sqrt(sum(value * value)) AS cnorm FROM cent GROUP BY ALL),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS vnorm FROM ev GROUP BY ALL),
dots AS (SELECT ev.vec_id, ev.label, sum(ev.x * cent.value) AS dot FROM ev JOIN cent USING (label, dim) GROUP BY ALL),
cosv AS (SELECT dots.vec_id, dots.label, dot, dot / (vnorm * cnorm) AS cos FROM dots JOIN vn USING (vec_id) JOIN cn USING (label))"""

ORACLE["label_centroids"] = f"""WITH {VEC_CTES}
SELECT label::BIGINT AS label, dim::BIGINT AS dim, round(value, 6) AS value FROM cent"""

ORACLE["masked_pooling"] = f"""WITH {VEC_CTES},
sq AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, dim, x, (vec_id % 4 <> 3 AND (vec_id // 16) % 5 <> 4) AS used FROM ev)
SELECT seq::BIGINT AS seq, dim::BIGINT AS dim, round(arg_min(x, pos), 6) AS first,
       round(avg(x) FILTER (used), 6) AS mean, round(avg(x) FILTER (used), 6) AS grouped FROM sq GROUP BY seq, dim"""

ORACLE["vector_cosine"] = f"""WITH {VEC_CTES}
SELECT vec_id, round(dot, 6) AS dot, round(cos, 6) AS cos, round(cos, 6) AS cos_normed FROM cosv"""

ORACLE["embedding_spread"] = f"""WITH {VEC_CTES}
SELECT label::BIGINT AS label, round(avg(sd), 6) AS spread FROM
  (SELECT label, dim, stddev_samp(x) AS sd FROM ev GROUP BY ALL) GROUP BY label"""

ORACLE["flat_ip_search"] = f"""WITH {VEC_CTES},
ip AS (SELECT cent.label AS query_id, ev.vec_id, sum(ev.x * cent.value) AS score FROM ev JOIN cent USING (dim) GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, vec_id::VARCHAR AS vec_id, round(score, 6) AS score, rank::BIGINT AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM ip)
WHERE rank <= 10"""

ORACLE["rank_agreement"] = f"""WITH {VEC_CTES},
lists AS (SELECT label AS list_id, vec_id,
            row_number() OVER (PARTITION BY label ORDER BY round(cos, 9) DESC, vec_id) - 1 AS gold,
            row_number() OVER (PARTITION BY label ORDER BY round(cos, 2) DESC, vec_id) - 1 AS pos FROM cosv),
ks AS (SELECT unnest([1, 5, 10, 20]) AS k),
inv AS (SELECT a.list_id, count(b.vec_id) AS inversions FROM lists a LEFT JOIN lists b
        ON a.list_id = b.list_id AND a.pos < b.pos AND a.gold > b.gold GROUP BY ALL),
avgk AS (SELECT list_id, k, avg(CASE WHEN gold < k THEN 1e0 ELSE 0e0 END) AS avg_topk FROM lists JOIN ks ON pos < k GROUP BY ALL),
idxk AS (SELECT list_id, k, coalesce(max(CASE WHEN gold < k THEN pos + 1 END), count(*)) AS idx_topk
         FROM lists CROSS JOIN ks GROUP BY ALL)
SELECT list_id::BIGINT AS list_id, k::BIGINT AS k, round(avg_topk, 6) AS avg_topk, idx_topk::BIGINT AS idx_topk,
       inversions::BIGINT AS inversions
FROM avgk JOIN idxk USING (list_id, k) JOIN inv USING (list_id)"""


# ---------------------------------------------------------------- sampling

from lexkit.functions.hashing import sql_uniform as U  # noqa: E402
from lexkit.plans.catalog import (  # noqa: E402
    AUG_P, BOS, CHUNK_LENGTH, CROP, EOS, MASK_ID, PAD_BATCH, PQ_BITS, PQ_M, PQ_ROUNDS, REPLACE_RANGE,
    SAMPLED_BATCH, SEED)

TOKEN_CORPUS_CTES = f"""
toks AS (SELECT source AS dataset_id, doc_id AS row_id, {_tok('lower(text)')} AS t FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT unnest(t) AS token FROM toks)),
occ AS (SELECT row_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks),
idl AS (SELECT row_id, list(id ORDER BY pos) AS ids FROM occ JOIN vocab USING (token) GROUP BY row_id),
corpus_ids AS (SELECT dataset_id, row_id, coalesce(idl.ids, []::BIGINT[]) AS ids FROM toks LEFT JOIN idl USING (row_id))"""


def _md5ids(x: str) -> str:
    return f"md5(array_to_string({x}, ','))"


def _crop_sql(tag: str) -> str:
    lo, hi = CROP
    ratio = f"({lo!r}e0 + {hi - lo!r}e0 * {U(SEED, tag + ':ratio', 'row_id')})" if "e" not in repr(hi - lo) \
        else f"({lo!r} + {hi - lo!r} * {U(SEED, tag + ':ratio', 'row_id')})"
    ln = f"floor(len(chunk)::DOUBLE * {ratio})::BIGINT"
    st = f"floor({U(SEED, tag + ':start', 'row_id')} * (len(chunk) - {ln} + 1))::BIGINT"
    return f"list_slice(chunk, {st} + 1, {st} + {ln})"


ORACLE["token_corpus"] = f"""WITH {TOKEN_CORPUS_CTES}
SELECT dataset_id, row_id, len(ids)::BIGINT AS n_ids, {_md5ids('ids')} AS ids_md5 FROM corpus_ids"""

ORACLE["pair_crops"] = f"""WITH {TOKEN_CORPUS_CTES},
offs AS (SELECT dataset_id, floor({U(SEED, 'offset', 'dataset_id', '1')} * {CHUNK_LENGTH})::BIGINT AS "offset"
         FROM (SELECT DISTINCT dataset_id FROM corpus_ids)),
ch AS (SELECT c.dataset_id, c.row_id, o."offset", list_slice(c.ids, o."offset" + 1, o."offset" + {CHUNK_LENGTH}) AS chunk
       FROM corpus_ids c JOIN offs o USING (dataset_id)),
cr AS (SELECT *, {_crop_sql('q')} AS q, {_crop_sql('k')} AS k FROM ch)
SELECT dataset_id, row_id, "offset"::BIGINT AS "offset", len(chunk)::BIGINT AS chunk_len, len(q)::BIGINT AS q_len,
       len(k)::BIGINT AS k_len, {_md5ids('q')} AS q_md5, {_md5ids('k')} AS k_md5 FROM cr"""


def _augment_sql() -> str:
    lo, hi = REPLACE_RANGE
    return f"""WITH {TOKEN_CORPUS_CTES},
el AS (SELECT row_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM corpus_ids),
eu AS (SELECT *, {U(SEED, 'del', 'row_id', 'i')} AS u_del, {U(SEED, 'rep', 'row_id', 'i')} AS u_rep,
              {U(SEED, 'rep:id', 'row_id', 'i')} AS u_repid, {U(SEED, 'mask', 'row_id', 'i')} AS u_mask,
              {U(SEED, 'shuf', 'row_id', 'i')} AS u_shuf, {U(SEED, 'shuf:perm', 'row_id', 'i')} AS u_perm FROM el),
ch AS (SELECT row_id, i, x, row_number() OVER (PARTITION BY row_id ORDER BY i) AS a,
              row_number() OVER (PARTITION BY row_id ORDER BY u_perm, i) AS b FROM eu WHERE u_shuf < {AUG_P}e0),
sh AS (SELECT t.row_id, t.i, s.x AS nx FROM ch t JOIN ch s ON s.row_id = t.row_id AND s.b = t.a),
agg AS (SELECT eu.row_id,
          list(x ORDER BY eu.i) FILTER (WHERE u_del > {AUG_P}e0) AS del,
          list(CASE WHEN u_rep > {AUG_P}e0 THEN x ELSE ({lo} + floor(u_repid * {hi - lo + 1}))::INTEGER END ORDER BY eu.i) AS rep,
          list(CASE WHEN u_mask > {AUG_P}e0 THEN x ELSE {MASK_ID} END ORDER BY eu.i) AS msk,
          list(coalesce(sh.nx, x) ORDER BY eu.i) AS shuf
        FROM eu LEFT JOIN sh ON sh.row_id = eu.row_id AND sh.i = eu.i GROUP BY eu.row_id),
bt AS (SELECT row_id, ids, (row_number() OVER (ORDER BY row_id) - 1) // {PAD_BATCH} AS batch FROM corpus_ids),
wd AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM bt)
SELECT wd.row_id,
  {_md5ids('coalesce(agg.del, [])')} AS del_md5, {_md5ids('coalesce(agg.rep, [])')} AS rep_md5,
  {_md5ids('coalesce(agg.msk, [])')} AS mask_md5, {_md5ids('coalesce(agg.shuf, [])')} AS shuf_md5,
  {_md5ids(f'list_concat([{BOS}], ids, [{EOS}])')} AS bos_eos_md5, {_md5ids(f'list_concat([{BOS}], ids)')} AS add_md5,
  width::BIGINT AS width, {_md5ids('list_resize(ids, width, 0)')} AS padded_md5,
  len(ids)::BIGINT AS mask_sum
FROM wd LEFT JOIN agg USING (row_id)"""


ORACLE["augmentations"] = _augment_sql()

_SIZES = "sizes AS (SELECT source AS dataset_id, count(*) AS n FROM documents GROUP BY ALL)"


def _probs_sql(c: float) -> str:
    return f"""(SELECT dataset_id, n, p0 / sum(p0) OVER () AS prob FROM
      (SELECT dataset_id, n, pow(n / sum(n) OVER (), {c!r}e0) AS p0 FROM sizes))"""


ORACLE["sampling_probs"] = f"""WITH {_SIZES}
{' UNION ALL '.join(f"SELECT dataset_id, {c!r}e0 AS coeff, round(prob, 6) AS prob FROM {_probs_sql(c)}" for c in (0.0, 0.5, 1.0))}"""

ORACLE["dataset_draws"] = f"""WITH {_SIZES},
iv AS (SELECT dataset_id, n, sum(prob) OVER (ORDER BY dataset_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
       FROM {_probs_sql(0.5)}),
iv2 AS (SELECT dataset_id, n, coalesce(lag(hi) OVER (ORDER BY dataset_id), 0e0) AS lo,
               CASE WHEN row_number() OVER (ORDER BY dataset_id DESC) = 1 THEN 1e0 ELSE hi END AS hi FROM iv),
draws AS (SELECT doc_id AS draw_id, {U(SEED, 'dataset', 'doc_id')} AS u, {U(SEED, 'row', 'doc_id')} AS u2 FROM documents),
picked AS (SELECT draw_id, iv2.dataset_id, floor(u2 * n)::BIGINT AS row_pos FROM draws JOIN iv2 ON u >= lo AND u < hi),
pos AS (SELECT source AS dataset_id, doc_id AS row_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_pos
        FROM documents)
SELECT draw_id, dataset_id, row_id FROM picked JOIN pos USING (dataset_id, row_pos)"""



def _pq_sql() -> str:
    """CTEs of the codebooks c0..cR of all sub-spaces, the codes and the scores."""
    k = 2 ** PQ_BITS
    width = f"((SELECT count(DISTINCT dim) FROM ev) // {PQ_M})"
    def near(i: int) -> str:
        return f"""SELECT vec_id, sub, code FROM (SELECT vec_id, sub, code,
      row_number() OVER (PARTITION BY vec_id, sub ORDER BY round(d, 9), code) AS rn FROM
      (SELECT sv.vec_id, sv.sub, c.code, sum((sv.x - c.v) * (sv.x - c.v)) AS d FROM sv JOIN c{i} c USING (sub, j) GROUP BY ALL))
      WHERE rn = 1"""
    ctes = [f"sv AS MATERIALIZED (SELECT vec_id, dim // {width} AS sub, dim % {width} AS j, x FROM ev)",
            f"""start AS MATERIALIZED (SELECT vec_id, rn - 1 AS code FROM (SELECT vec_id, row_number() OVER (
      ORDER BY {U(SEED, 'pq', 'vec_id')}, vec_id) AS rn FROM embeddings) WHERE rn <= {k})""",
            "c0 AS MATERIALIZED (SELECT sub, code, j, x AS v FROM sv JOIN start USING (vec_id))"]
    for i in range(PQ_ROUNDS):
        ctes += [f"a{i} AS MATERIALIZED ({near(i)})",
                 f"""c{i + 1} AS MATERIALIZED (SELECT c.sub, c.code, c.j, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN
      (SELECT sub, code, j, avg(x) AS v FROM a{i} JOIN sv USING (vec_id, sub) GROUP BY ALL) n USING (sub, code, j))"""]
    return ",\n".join([*ctes, f"codes AS MATERIALIZED ({near(PQ_ROUNDS)})",
                       f"""lut AS (SELECT cent.label AS query_id, c.sub, c.code, sum(cent.value * c.v) AS ip
      FROM (SELECT label, dim // {width} AS sub, dim % {width} AS j, value FROM cent) cent JOIN c{PQ_ROUNDS} c USING (sub, j) GROUP BY ALL),
pqs AS (SELECT query_id, vec_id, sum(ip) AS score FROM codes JOIN lut USING (sub, code) GROUP BY ALL)"""])


ORACLE["pq_search"] = f"""WITH {VEC_CTES},
{_pq_sql()}
SELECT query_id::BIGINT AS query_id, vec_id::VARCHAR AS vec_id, rank::BIGINT AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pqs) WHERE rank <= 10"""


def _sampled_idf_sql() -> str:
    """CTEs ending in sampled(token, df, idf): one epoch of draws, whole batches."""
    lo, hi = CROP
    ratio = f"({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {U(SEED, 'k:ratio', 'draw_id')})"
    return f"""{_SIZES},
siv AS (SELECT dataset_id, n, sum(prob) OVER (ORDER BY dataset_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
        FROM {_probs_sql(0.0)}),
siv2 AS (SELECT dataset_id, n, coalesce(lag(hi) OVER (ORDER BY dataset_id), 0e0) AS lo,
                CASE WHEN row_number() OVER (ORDER BY dataset_id DESC) = 1 THEN 1e0 ELSE hi END AS hi FROM siv),
sdraw AS (SELECT unnest(range((SELECT count(*) // {SAMPLED_BATCH} * {SAMPLED_BATCH} FROM documents))) AS draw_id),
spick AS (SELECT draw_id, dataset_id, floor({U(SEED, 'row', 'draw_id')} * n)::BIGINT AS row_pos
          FROM (SELECT draw_id, {U(SEED, 'dataset', 'draw_id')} AS u FROM sdraw) JOIN siv2 ON u >= lo AND u < hi),
stok AS (SELECT source AS dataset_id, {_tok('lower(text)')} AS t,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_pos FROM documents),
soff AS (SELECT dataset_id, floor({U(SEED, 'offset', 'dataset_id', '1')} * {CHUNK_LENGTH})::BIGINT AS "offset"
         FROM (SELECT DISTINCT dataset_id FROM stok)),
schunk AS (SELECT draw_id, list_slice(t, "offset" + 1, "offset" + {CHUNK_LENGTH}) AS chunk
           FROM spick JOIN stok USING (dataset_id, row_pos) JOIN soff USING (dataset_id)),
slen AS (SELECT *, floor(len(chunk)::DOUBLE * {ratio})::BIGINT AS length FROM schunk),
scrop AS (SELECT draw_id, list_slice(chunk, st + 1, st + length) AS crop FROM
          (SELECT *, floor({U(SEED, 'k:start', 'draw_id')} * (len(chunk) - length + 1))::BIGINT AS st FROM slen) WHERE length > 0),
sdf AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT draw_id, unnest(crop) AS token FROM scrop) GROUP BY token),
sampled AS (SELECT token, coalesce(df, 0) AS df,
                   ln(1e0 + ((SELECT count(*) FROM documents) - coalesce(df, 0) + 0.5e0) / (coalesce(df, 0) + 0.5e0)) AS idf
            FROM (SELECT DISTINCT unnest(t) AS token FROM stok) LEFT JOIN sdf USING (token))"""


ORACLE["idf_sampled"] = f"""WITH {_sampled_idf_sql()}
SELECT token, df::BIGINT AS df, round(idf, 6) AS idf FROM sampled"""

ORACLE["stored_bm25_eval"] = f"""WITH {_sampled_idf_sql()},
{_metrics_sql(bm25_run(1000, _JUDGED_ONLY), _EVAL_KS).replace(f"SELECT qt.query_id, qt.token, {IDF} AS weight FROM qt JOIN dft USING (token), st",
                                                              "SELECT qt.query_id, qt.token, sampled.idf AS weight FROM qt JOIN sampled USING (token)")}
SELECT metric, k::BIGINT AS k, round(value, 6) AS value FROM metrics"""

ORACLE["shuffle_order"] = f"""SELECT doc_id, (row_number() OVER (ORDER BY {U(SEED, 'shuffle', 'doc_id')}, doc_id) - 1)::BIGINT AS order_pos
FROM documents"""

ORACLE["batch_layout"] = f"""WITH o AS (SELECT doc_id, len({_tok('lower(text)')}) AS ntok,
     row_number() OVER (ORDER BY {U(SEED, 'shuffle', 'doc_id')}, doc_id) - 1 AS r FROM documents),
b AS (SELECT doc_id, ntok, r // 32 AS batch, r % 32 AS pos_in_batch FROM o
      WHERE r // 32 < (SELECT count(*) // 32 FROM documents))
SELECT doc_id, batch::BIGINT AS batch, pos_in_batch::BIGINT AS pos_in_batch,
       max(ntok) OVER (PARTITION BY batch)::BIGINT AS width FROM b"""

ORACLE["shards"] = """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
p AS (SELECT *, n // 3 AS q, n % 3 AS rem FROM o)
SELECT doc_id, ((r + 1) % 3)::BIGINT AS rr_shard,
  (CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END)::BIGINT AS contiguous_shard FROM p"""

ORACLE["maxload_rows"] = "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100"


# ---------------------------------------------------------------- fine-tuning examples

from lexkit.plans.catalog import FT_BATCH, FT_HARD_OFFSETS, FT_HARD_RATIO, FT_N_NEG, FT_NEG_OFFSETS  # noqa: E402


def _ft_sql() -> str:
    neg_d = ", ".join(str(d) for d in FT_NEG_OFFSETS)
    hard_d = ", ".join(str(d) for d in FT_HARD_OFFSETS)
    draws = " + ".join(f"(CASE WHEN {U(SEED, 'nhard', 'ex_id', str(j))} < {FT_HARD_RATIO!r}e0 THEN 1 ELSE 0 END)"
                       for j in range(FT_N_NEG))
    return f"""
asst AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
users AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
ex AS (SELECT u.conv_id, u.turn, u.conv_id::VARCHAR || ':' || u.turn::VARCHAR AS ex_id, u.question, a.text AS gold
       FROM users u JOIN asst a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
negl AS (SELECT ex.ex_id, a.text, row_number() OVER (PARTITION BY ex.ex_id ORDER BY d.d) - 1 AS i
         FROM ex CROSS JOIN (SELECT unnest([{neg_d}]) AS d) d
         JOIN asst a ON a.conv_id = ex.conv_id + d.d AND a.turn = ex.turn + 1),
hardl AS (SELECT ex.ex_id, a.text, row_number() OVER (PARTITION BY ex.ex_id ORDER BY d.d) - 1 AS i
          FROM ex CROSS JOIN (SELECT unnest([{hard_d}]) AS d) d
          JOIN asst a ON a.conv_id = ex.conv_id AND a.turn = ex.turn + d.d),
cnt AS (SELECT ex.ex_id, (SELECT count(*) FROM negl WHERE negl.ex_id = ex.ex_id) AS n_negs,
               (SELECT count(*) FROM hardl WHERE hardl.ex_id = ex.ex_id) AS n_hards,
               {draws} AS draws FROM ex),
k AS (SELECT ex_id, least(draws, n_hards) AS nh, least({FT_N_NEG} - least(draws, n_hards), n_negs) AS nr FROM cnt),
picked AS (
  SELECT ex_id, 0 AS grp, rk, text FROM (SELECT negl.ex_id, negl.text,
      row_number() OVER (PARTITION BY negl.ex_id ORDER BY {U(SEED, 'rand', 'negl.ex_id', 'negl.i')}, negl.i) AS rk
      FROM negl) r JOIN k USING (ex_id) WHERE rk <= nr
  UNION ALL
  SELECT ex_id, 1 AS grp, rk, text FROM (SELECT hardl.ex_id, hardl.text,
      row_number() OVER (PARTITION BY hardl.ex_id ORDER BY {U(SEED, 'hard', 'hardl.ex_id', 'hardl.i')}, hardl.i) AS rk
      FROM hardl) h JOIN k USING (ex_id) WHERE rk <= nh),
negs AS (SELECT ex_id, list({sql_normalize_text('text')} ORDER BY grp, rk) AS negatives FROM picked GROUP BY ex_id),
fx AS (SELECT ex.ex_id, {sql_normalize_text('question')} AS query, {sql_normalize_text('gold')} AS gold,
              coalesce(negs.negatives, []::VARCHAR[]) AS negatives FROM ex LEFT JOIN negs USING (ex_id))"""


ORACLE["finetune_examples"] = f"""WITH {_ft_sql()}
SELECT ex_id, md5(query) AS query_md5, md5(gold) AS gold_md5, len(negatives)::BIGINT AS n_neg,
       md5(array_to_string(negatives, chr(1))) AS negs_md5 FROM fx"""

ORACLE["finetune_collate"] = f"""WITH {_ft_sql()},
b AS (SELECT *, (row_number() OVER (ORDER BY ex_id) - 1) // {FT_BATCH} AS batch,
             (row_number() OVER (ORDER BY ex_id) - 1) % {FT_BATCH} AS pib FROM fx),
bs AS (SELECT *, count(*) OVER (PARTITION BY batch) AS bsize FROM b),
nx AS (SELECT batch, pib, bsize, ex_id, unnest(negatives) AS text, generate_subscripts(negatives, 1) AS ni FROM bs)
SELECT batch::BIGINT AS batch, pib::BIGINT AS passage_pos, true AS is_gold, ex_id, md5(gold) AS text_md5 FROM bs
UNION ALL
SELECT batch::BIGINT, (bsize + row_number() OVER (PARTITION BY batch ORDER BY pib, ni) - 1)::BIGINT, false, ex_id, md5(text)
FROM nx"""


# ---------------------------------------------------------------- contrastive statistics

from lexkit.plans.catalog import CT_BATCH, CT_QUEUE_BATCHES, CT_SMOOTHING, CT_TEMPERATURE, LEX_BATCH  # noqa: E402

CT_ROWS = f"""{VEC_CTES},
rws AS (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1) // {CT_BATCH} AS batch,
               (row_number() OVER (ORDER BY vec_id) - 1) % {CT_BATCH} AS pos FROM embeddings),
qe AS (SELECT r.batch, r.pos, ev.dim, ev.x FROM rws r JOIN ev USING (vec_id)),
ke AS (SELECT r.batch, r.pos, c.dim, c.value AS x FROM rws r JOIN cent c USING (label)),
spread AS (SELECT q.batch, q.stdq, k.stdk FROM
  (SELECT batch, avg(sd) AS stdq FROM (SELECT batch, dim, stddev_samp(x) AS sd FROM qe GROUP BY ALL) GROUP BY batch) q
  JOIN (SELECT batch, avg(sd) AS stdk FROM (SELECT batch, dim, stddev_samp(x) AS sd FROM ke GROUP BY ALL) GROUP BY batch) k
  USING (batch))"""


def _ce_sql(scores: str, pos_expr: str) -> str:
    """Per-query CE with temperature and label smoothing from (batch, qi, cand, score)."""
    return f"""z AS (SELECT batch, qi, cand, score / {CT_TEMPERATURE!r}e0 AS z, {pos_expr} AS pos FROM {scores}),
zm AS (SELECT batch, qi, max(z) AS m, avg(z) AS mz, max(CASE WHEN cand = pos THEN z END) AS zpos FROM z GROUP BY ALL),
lse AS (SELECT z.batch, z.qi, zm.m + ln(sum(exp(z.z - zm.m))) AS lse, any_value(zm.mz) AS mz, any_value(zm.zpos) AS zpos
        FROM z JOIN zm USING (batch, qi) GROUP BY z.batch, z.qi, zm.m),
am AS (SELECT batch, qi, cand = pos AS hit FROM (SELECT *, row_number() OVER (PARTITION BY batch, qi ORDER BY round(z, 9) DESC, cand) AS rn
       FROM z) WHERE rn = 1),
per AS (SELECT batch, avg({1 - CT_SMOOTHING!r}e0 * (lse - zpos) + {CT_SMOOTHING!r}e0 * (lse - mz)) AS loss,
               avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) * 100 AS accuracy
        FROM lse JOIN am USING (batch, qi) GROUP BY batch)"""


_CT_SELECT = """SELECT batch::BIGINT AS batch, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy,
       round(stdq, 6) AS stdq, round(stdk, 6) AS stdk FROM per JOIN spread USING (batch)"""

ORACLE["inbatch_contrastive"] = f"""WITH {CT_ROWS},
sc AS (SELECT q.batch, q.pos AS qi, k.pos AS cand, sum(q.x * k.x) AS score FROM qe q JOIN ke k USING (batch, dim) GROUP BY ALL),
{_ce_sql('sc', 'qi')}
{_CT_SELECT}"""

ORACLE["moco_contrastive"] = f"""WITH {CT_ROWS},
own AS (SELECT q.batch, q.pos AS qi, 0 AS cand, sum(q.x * k.x) AS score FROM qe q JOIN ke k USING (batch, pos, dim) GROUP BY ALL),
negs AS (SELECT q.batch, q.pos AS qi, k.batch AS kb, k.pos AS kp, sum(q.x * k.x) AS score FROM qe q JOIN ke k
         ON k.dim = q.dim AND k.batch < q.batch AND k.batch >= q.batch - {CT_QUEUE_BATCHES} GROUP BY ALL),
sc AS (SELECT batch, qi, cand, score FROM own UNION ALL
       SELECT batch, qi, row_number() OVER (PARTITION BY batch, qi ORDER BY kb, kp) AS cand, score FROM negs),
{_ce_sql('sc', '0')}
{_CT_SELECT}"""


def _lexical_sql() -> str:
    return f"""{TOKEN_CORPUS_CTES},
offs AS (SELECT dataset_id, floor({U(SEED, 'offset', 'dataset_id', '1')} * {CHUNK_LENGTH})::BIGINT AS "offset"
         FROM (SELECT DISTINCT dataset_id FROM corpus_ids)),
ch AS (SELECT c.dataset_id, c.row_id, list_slice(c.ids, o."offset" + 1, o."offset" + {CHUNK_LENGTH}) AS chunk
       FROM corpus_ids c JOIN offs o USING (dataset_id)),
cr AS (SELECT row_id, {_crop_sql('q')} AS q, {_crop_sql('k')} AS k FROM ch),
ord AS (SELECT row_id, q, k, row_number() OVER (ORDER BY {U(SEED, 'shuffle', 'row_id')}, row_id) - 1 AS r FROM cr),
bt AS (SELECT row_id, q, k, r // {LEX_BATCH} AS batch, r % {LEX_BATCH} AS pos FROM ord
       WHERE r // {LEX_BATCH} < (SELECT count(*) // {LEX_BATCH} FROM cr)),
dtok AS (SELECT doc_id, {_tok('lower(text)')} AS t FROM documents),
ndocs AS (SELECT count(*)::DOUBLE AS n FROM dtok),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM dtok) GROUP BY token),
w AS (SELECT vocab.id AS token, ln(1e0 + (ndocs.n - df.df + 0.5e0) / (df.df + 0.5e0)) AS weight
      FROM df JOIN vocab USING (token), ndocs),
dtf AS (SELECT batch, pos AS d, token, count(*) AS tf FROM (SELECT batch, pos, unnest(k) AS token FROM bt) GROUP BY ALL),
qp AS (SELECT DISTINCT batch, pos AS q, unnest(q) AS token FROM bt),
sc AS (SELECT dtf.batch, d, q, sum(w.weight * (tf / (tf + exp(0e0)))) AS score
       FROM dtf JOIN qp USING (batch, token) JOIN w USING (token) GROUP BY ALL),
dense AS (SELECT a.batch, a.pos AS d, b.pos AS q, coalesce(sc.score, 0e0) AS score FROM bt a JOIN bt b USING (batch)
          LEFT JOIN sc ON sc.batch = a.batch AND sc.d = a.pos AND sc.q = b.pos),
rm AS (SELECT batch, d, max(score) AS m FROM dense GROUP BY ALL),
rce AS (SELECT x.batch, x.d, rm.m + ln(sum(exp(x.score - rm.m))) - max(CASE WHEN x.d = x.q THEN x.score END) AS ce
        FROM dense x JOIN rm USING (batch, d) GROUP BY x.batch, x.d, rm.m),
cm AS (SELECT batch, q, max(score) AS m FROM dense GROUP BY ALL),
cce AS (SELECT x.batch, x.q, cm.m + ln(sum(exp(x.score - cm.m))) - max(CASE WHEN x.d = x.q THEN x.score END) AS ce
        FROM dense x JOIN cm USING (batch, q) GROUP BY x.batch, x.q, cm.m),
hit AS (SELECT batch, d, q = d AS h FROM (SELECT *, row_number() OVER (PARTITION BY batch, d ORDER BY round(score, 9) DESC, q) AS rn
        FROM dense) WHERE rn = 1)"""


ORACLE["lexical_validate"] = f"""WITH {_lexical_sql()}
SELECT r.batch::BIGINT AS batch, round(r.ce_d + c.ce_q, 6) AS loss, round(h.acc, 6) AS acc FROM
  (SELECT batch, avg(ce) AS ce_d FROM rce GROUP BY batch) r
  JOIN (SELECT batch, avg(ce) AS ce_q FROM cce GROUP BY batch) c USING (batch)
  JOIN (SELECT batch, avg(CASE WHEN h THEN 1e0 ELSE 0e0 END) AS acc FROM hit GROUP BY batch) h USING (batch)"""


# ---------------------------------------------------------------- training, weights, statistics

def _idf_sql(name: str, where: str = "") -> str:
    return f"""{name} AS (SELECT token, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)), 9) AS weight FROM
  (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tok('lower(text)')}) AS token
     FROM documents {where}) GROUP BY token),
  (SELECT count(*)::DOUBLE AS n FROM documents {where}))"""


_W2 = f"{_idf_sql('wa', "WHERE lang = 'en'")}, {_idf_sql('wb')}"

ORACLE["lr_schedule"] = """WITH b AS (SELECT DISTINCT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS step FROM documents),
t AS (SELECT count(*) AS total FROM b)
SELECT step::BIGINT AS step,
  round(CASE WHEN step < 12 THEN (1 - 0e0) * step / 12e0
        ELSE greatest(0e0, 1e0 + (0e0 - 1) * (step - 12e0) / greatest(1, total - 12)::DOUBLE) END, 6) AS lr_linear,
  round(CASE WHEN step < 12 THEN step / 12e0
        ELSE 0.1e0 + (1e0 - 0.1e0) * cos(pi() / 2e0 * ((step - 12e0) / greatest(1, total - 12)::DOUBLE)) END, 6) AS lr_cosine
FROM b, t"""

ORACLE["momentum_weights"] = f"""WITH {_W2}
SELECT token, round(wa.weight * 0.9e0 + wb.weight * {1 - 0.9!r}e0, 6) AS weight FROM wa JOIN wb USING (token)"""

ORACLE["param_count"] = f"""WITH {_idf_sql('wb')} SELECT round((count(*) + 1) / 1e6, 6) AS params_m FROM wb"""

ORACLE["vocab_ranking"] = f"""WITH {_idf_sql('wb')}
SELECT token, (row_number() OVER (ORDER BY weight DESC, token) - 1)::BIGINT AS rank FROM wb"""

ORACLE["top_weights"] = f"""WITH {_W2} SELECT token, weight FROM wb ORDER BY weight DESC, token LIMIT 100"""

ORACLE["bottom_weights"] = f"""WITH {_W2} SELECT token, weight FROM wb ORDER BY weight ASC, token LIMIT 100"""

ORACLE["smallest_magnitude"] = f"""WITH {_W2}, sg AS (SELECT token, round(wa.weight - wb.weight, 9) AS weight FROM wa JOIN wb USING (token))
SELECT token, weight FROM sg ORDER BY abs(weight), token LIMIT 100"""

ORACLE["tail_of_top"] = f"""WITH {_W2}, top AS (SELECT token, weight FROM wb ORDER BY weight DESC, token LIMIT 100)
SELECT token, weight FROM top ORDER BY weight ASC, token DESC LIMIT 10"""

ORACLE["compare_rankings"] = f"""WITH {_W2}, {TOKEN_CORPUS_CTES},
ob AS (SELECT token, row_number() OVER (ORDER BY weight DESC, token) - 1 AS rank FROM wb),
top AS (SELECT token FROM wa ORDER BY weight DESC, token LIMIT 100),
bot AS (SELECT token FROM wa ORDER BY weight ASC, token LIMIT 100)
SELECT round(avg(rank), 6) AS mean_rank, round(avg(id), 6) AS mean_token_id, count(*) AS n, 'top' AS side
  FROM top JOIN ob USING (token) JOIN vocab USING (token)
UNION ALL
SELECT round(avg(rank), 6), round(avg(id), 6), count(*), 'bottom' FROM bot JOIN ob USING (token) JOIN vocab USING (token)"""

ORACLE["decode_tokens"] = f"""WITH {_W2}, top AS (SELECT token, weight FROM wb ORDER BY weight DESC, token LIMIT 20)
SELECT string_agg(token, ' ' ORDER BY weight DESC, token) AS text FROM top"""

ORACLE["weighted_average"] = """SELECT event_type AS key, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS avg,
  sum(1 + user_id % 3)::BIGINT AS total_weight FROM events GROUP BY event_type"""

ORACLE["stream_document_frequency"] = f"""SELECT token, count(*) AS df FROM
  (SELECT DISTINCT doc_id, unnest({_tok('lower(text)')}) AS token FROM documents) GROUP BY token"""

ORACLE["stream_weighted_average"] = ORACLE["weighted_average"]


# ---------------------------------------------------------------- file sources end to end

ORACLE["passages_tsv"] = f"""WITH corpus AS ({CORPUS})
SELECT doc_id, md5(title) AS title_md5, md5(text) AS text_md5 FROM corpus"""

ORACLE["beir_files_eval"] = ORACLE["bm25_eval"]

ORACLE["qa_results_recall"] = f"""WITH {_qa_hits_sql()},
fq AS (SELECT b.item_id AS question_id, b.item_id % 2 AS half,
              f.first_hit, coalesce(f.n_ctx, 0) AS n_ctx
       FROM benchmark b LEFT JOIN first f ON f.question_id = b.item_id),
fw AS (SELECT half, max(n_ctx) AS w, count(*) AS nq FROM fq GROUP BY half),
rc AS (SELECT fw.half, ks.k, any_value(nq) AS nq, count(CASE WHEN first_hit + 1 <= ks.k THEN 1 END) AS hits
       FROM fw JOIN (SELECT unnest([5, 10, 20, 100]) AS k) ks ON ks.k <= fw.w JOIN fq USING (half) GROUP BY fw.half, ks.k)
SELECT k::BIGINT AS k, string_agg(format('{{:.1f}}', 100e0 * hits / nq), chr(9) ORDER BY half) AS "values" FROM rc GROUP BY k"""

from lexkit.plans.catalog import QA_MAXLOAD, QA_RANK, QA_WORLD  # noqa: E402

ORACLE["qa_examples_files"] = f"""WITH asst AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
ex AS (SELECT u.conv_id::VARCHAR || ':' || u.turn::VARCHAR AS ex_id, u.conv_id, u.turn, u.text AS question
       FROM conversations u JOIN asst a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
o AS (SELECT *, row_number() OVER (ORDER BY ex_id) - 1 AS rn FROM ex),
hc AS (SELECT o.rn, count(h.turn) AS n_hard FROM o LEFT JOIN asst h
       ON h.conv_id = o.conv_id AND (h.turn = o.turn + 3 OR h.turn = o.turn + 5) GROUP BY o.rn)
SELECT o.rn::BIGINT AS row, md5(o.question) AS question_md5, hc.n_hard::BIGINT AS n_hard
FROM o JOIN hc USING (rn) WHERE o.rn < {QA_MAXLOAD} AND (o.rn + 1) % {QA_WORLD} = {QA_RANK}"""

ORACLE["token_corpora_files"] = ORACLE["token_corpus"]
