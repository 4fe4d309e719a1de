"""Operator 5, line dedup: exact set-similarity join over lines, native.

Only DataFrame and SQL functions: the work stays in the JVM.

A line's tokens are its distinct 5-word shingles (words lower-cased), as hashes of
48 bits; a line of fewer words has one token, all its words.  Two lines match when the Jaccard similarity of their
token sets is at least 0.75; of a match the later line, by (document, line), is
removed.

1. The text is read, split and hashed once: every line is written with its
   digest and its tokens, and all later steps read those.  Equal strings (by a
   128-bit digest of the line) are one class with its earliest occurrence; every
   other occurrence is a later match of that one.  Lines that differ in case or
   blanks only are classes with equal token sets.
2. Tokens are ordered by rarity.  Rarity is the count, over the whole corpus, of
   a token's hash bucket: a table of fixed size (2 ** 16 counts) that tells
   common tokens, whatever the size of the corpus.  Any one order gives the same
   result; this one puts tokens of very common passages last.
3. Matching lines share one of their first n - ceil(0.75 n) + 1 tokens.  Prefix
   tokens are counted (combined before the shuffle); a class lists itself under
   those of its tokens that more than one class has.
4. Every class is verified against the earliest class of its lists (length and
   positional filter first).  A match settles it, so a group of thousands of
   near copies costs a star of pairs and not all of them.
5. Classes still unsettled meet every earlier class of their lists that passes
   the filters; Jaccard is verified on the full token sets.

The result names one earlier line that a removed line matches: the best of those
it was verified against, not necessarily the best of all.  Links are not listed.

Defined cases: null and empty texts and wordless lines have no line; a null id
ranks after all others; repeated rows are later occurrences; a line's removal
never depends on whether the line it matches is itself removed; an empty table
gives an empty table; texts and lines of any length are whole; other columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexkit.llm.common import checked_broadcast, documents, free_names, numbered
from lexkit.operators.joins import MAX_BROADCAST_ROWS
from lexkit.session import discard, materialize, written

WORDS = 5
NUM, DEN = 3, 4
BUCKET_BITS = 16
LEADERS = 2
LAST = (1 << 63) - 1
TOKEN_BITS = 48
# tokens hardly repeat; this version packs numbers into as many bits as they have
PACKED = {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}


def _words(line: Column) -> Column:
    """Lower-cased words of a line (split at [\\x20\\x09-\\x0D])."""
    for blank in ("\t", "\x0b", "\x0c", "\r"):
        line = F.replace(line, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(F.lower(line), " "), "")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, row, line_no, line): line breaks are line feeds."""
    row, = free_names(docs, "_row")
    src = numbered(docs, row).select(F.col(key).cast("bigint").alias("doc_id"), F.col(row).alias("row"), F.col(text).alias("text"))
    return src.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def digested(lines: DataFrame) -> DataFrame:
    """``lines`` with the two halves of the line's digest."""
    return lines.withColumn("d1", F.xxhash64("line")).withColumn("d2", F.xxhash64(F.lit(7), "line"))


def _token(*hashes: Column | str) -> Column:
    """48 bits, so that the written tokens take three quarters of the disk."""
    return F.shiftrightunsigned(F.xxhash64(*hashes), 64 - TOKEN_BITS)


def _shingle(i: Column) -> Column:
    return _token(*[F.get("h", i + k) for k in range(WORDS)])


def hashed_words(lines: DataFrame) -> DataFrame:
    """``lines`` with ``h``, the hashes of their words.

    No filter on ``h`` may follow: it would be pushed below the projection and
    compute ``h`` once more for every shingle."""
    return lines.withColumn("h", F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))


def token_sets(lines: DataFrame) -> DataFrame:
    """``lines`` with ``words``, their number, and ``tokens``, their distinct
    shingle hashes (empty for a line without words)."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - WORDS), _shingle))
    none = F.slice(F.array(F.lit(0).cast("bigint")), 1, 0)
    return hashed_words(lines).select("*", F.size("h").alias("words"), F.when(F.size("h") >= WORDS, some).when(
        F.size("h") > 0, F.array(_token("h"))).otherwise(none).alias("tokens")).drop("h")


def tokenised(lines: DataFrame) -> tuple[DataFrame, str]:
    """The written table of all lines and its path: id, first (its place), d1, d2, words, n, tokens."""
    sets = token_sets(digested(lines)).select(occurrence().alias("first"), "d1", "d2", "words", F.size("tokens").alias("n"), "tokens")
    return written(sets.withColumn("id", F.monotonically_increasing_id()), **PACKED)


def _bucket(token: Column) -> Column:
    return F.shiftright(token, TOKEN_BITS - BUCKET_BITS).cast("int")


def rarity_codes(lines: DataFrame) -> Column:
    """Array of 2 ** 16 small numbers, the logarithm of each bucket's count, as a
    literal: its size does not depend on the corpus, but the driver keeps it in every
    text of the plan, so it is as short as it can be.  Lines of under five words are
    not counted: their token is alone in its set.  ``lines`` may have their tokens."""
    sets = lines if "tokens" in lines.columns else token_sets(lines)
    seen = sets.filter(F.col("words") >= WORDS).select(F.explode("tokens").alias("token")).groupBy(
        _bucket(F.col("token")).alias("b")).agg(F.floor(8 * F.log2(F.count(F.lit(1)) + 1)).alias("code"))
    codes = ["0"] * (1 << BUCKET_BITS)
    for b, code in seen.collect():
        codes[b] = str(code)
    return F.split(F.lit(",".join(codes)), ",").cast("array<smallint>")


def copies_of(sets: DataFrame) -> DataFrame:
    """(id, first, kept): every later occurrence of an equal line, with the earliest one."""
    again = (sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("occurrences"))
                 .filter("occurrences > 1").select("d1", "d2", "kept"))
    return (sets.select("id", "d1", "d2", "first").join(checked_broadcast(materialize(again)), ["d1", "d2"])
                .filter(F.col("first") != F.col("kept")).select("id", "first", "kept"))


def classes(sets: DataFrame, copies: DataFrame, codes: Column) -> DataFrame:
    """One row per distinct line with words: id, first (earliest occurrence), n, prefix."""
    high = lambda t: F.shiftleft(F.get(codes, _bucket(t)).cast("bigint"), TOKEN_BITS)
    # never null, and Spark knows it: the numbers are sorted as they are
    order = lambda t: F.coalesce(high(t).bitwiseOR(t), F.lit(0).cast("bigint"))
    n = F.col("n")
    return (sets.filter("n > 0").join(checked_broadcast(copies.select("id")), "id", "left_anti")
                .select("id", "first", "n", F.slice(F.sort_array(F.transform("tokens", order)), F.lit(1),
                                                    n - F.ceil(n * NUM / DEN).cast("int") + 1).alias("prefix")))


def occurrence() -> Column:
    """Order of lines: document (null last), line, row."""
    return F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("line_no").alias("line"), F.col("row").alias("row"))


def _length_ok(a: str, b: str) -> Column:
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _position_ok(na: str, pa: str, nb: str, pb: str) -> Column:
    need = F.ceil((F.col(na) + F.col(nb)) * NUM / (NUM + DEN))
    return F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb)) >= need


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs whose token sets reach the threshold."""
    def side(x: str) -> DataFrame:
        return full.select(F.col("id").alias(x), F.col("tokens").alias("t" + x))

    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    sized = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"), F.size("ta").alias("na"),
                        F.size("tb").alias("nb")).withColumn("either", F.col("na") + F.col("nb") - F.col("common"))
    return sized.filter(F.col("common") * DEN >= F.col("either") * NUM).select(
        "a", "b", (F.col("common") / F.col("either")).alias("similarity"))


def sets_of(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The rows of ``full`` that are in any of the written pairs (a, b)."""
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    return full.join(checked_broadcast(ids), "id")


def line_matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per removed line: doc_id, row, line_no, kept_doc_id, kept_row,
    kept_line_no, similarity (an earlier line that it matches)."""
    sets, sets_path = tokenised(lines_of(docs, key, text))
    # later occurrences of a class match its first one and leave the join
    copies = materialize(copies_of(sets))
    table, table_path = written(classes(sets, copies, rarity_codes(sets)), **PACKED)
    # tokens that more than one class has; the others list nobody
    shared = materialize(table.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m"))
                         .filter("m > 1").select("token"))
    lists = materialize(table.select("id", "first", "n", F.posexplode("prefix").alias("pos", "token"))
                        .join(checked_broadcast(shared), "token"))
    # the sets of the classes in any list; the others have no match
    full = written(sets.select("id", "tokens").join(checked_broadcast(materialize(lists.select("id").distinct())), "id"), **PACKED)[0]
    discard(docs.sparkSession, sets_path, table_path)
    lead = materialize(lists.groupBy("token").agg(F.min(F.struct("first", "id", "n", "pos")).alias("x"))
                       .select("token", F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("x.pos").alias("pa")))
    star = (lists.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "token")
                 .join(lead, "token").filter((F.col("a") != F.col("b")) & _length_ok("na", "nb") & _position_ok("na", "pa", "nb", "pb"))
                 .groupBy("b", "a").agg(F.count(F.lit(1)).alias("shared"))
                 .withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(F.col("shared").desc(), "a")))
                 .filter(F.col("place") <= LEADERS).select("a", "b"))
    star = materialize(star)
    settled = materialize(verified(star, sets_of(star, full)))
    open_ = (lists.join(settled.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
                  .select(F.col("id").alias("b"), F.col("first").alias("fb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "token"))
    earlier = lists.select(F.col("id").alias("a"), F.col("first").alias("fa"), F.col("n").alias("na"), F.col("pos").alias("pa"), "token")
    rest = materialize(open_.join(earlier, "token")
                 .filter((F.col("fa") < F.col("fb")) & _length_ok("na", "nb") & _position_ok("na", "pa", "nb", "pb"))
                 .select("a", "b").distinct().join(star, ["a", "b"], "left_anti"))
    near = settled.unionByName(verified(rest, sets_of(rest, full))).groupBy("b").agg(
        F.max(F.struct("similarity", F.negative("a").alias("a"))).alias("x")).select(
        F.col("b").alias("id"), "x.similarity", F.negative("x.a").alias("a"))
    places = lists.select("id", "first").distinct()
    near = (near.join(places, "id").join(places.select(F.col("id").alias("a"), F.col("first").alias("kept")), "a")
                .select("first", "kept", "similarity"))
    out = near.unionByName(copies.select("first", "kept", F.lit(1.0).alias("similarity")))
    name = lambda c: F.when(F.col(c) == LAST, F.lit(None)).otherwise(F.col(c)).cast("bigint")
    return out.select(name("first.doc").alias("doc_id"), F.col("first.row").alias("row"), F.col("first.line").alias("line_no"),
                      name("kept.doc").alias("kept_doc_id"), F.col("kept.row").alias("kept_row"),
                      F.col("kept.line").alias("kept_line_no"), "similarity")


def without_matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed lines; documents that lose all their words
    are dropped, documents that had none are kept."""
    row, gone, cut = free_names(docs, "_row", "_gone", "_cut")
    removed = materialize(line_matches(docs, key, text).select(F.col("row").alias(row), "line_no").distinct()
                          .groupBy(row).agg(F.collect_list("line_no").alias(gone)))
    rows, numbers = removed.agg(F.count(F.lit(1)), F.sum(F.size(gone))).first()
    if rows <= MAX_BROADCAST_ROWS and (numbers or 0) <= 4 * MAX_BROADCAST_ROWS:
        removed = F.broadcast(removed)
    j = numbered(docs, row).join(removed, row, "left")
    keep = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(gone), i))
    j = j.withColumn(cut, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(keep, "\n")))
    return (j.filter(F.col(gone).isNull() | F.col(cut).rlike(r"[^\x20\x09-\x0D]"))
             .withColumn(text, F.col(cut)).select(*docs.columns))


def op5_set_similarity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed line, with the earlier line it matches."""
    return line_matches(documents(spark, sf_dir)).drop("row", "kept_row")
