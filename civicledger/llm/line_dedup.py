"""Line dedup with DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicledger.llm.common import BLANKS, lower_ascii, sha256_text, staged, texts

HOT_SHARE = 1000         # a line with more than one in so many of all repeated lines is hot; there are fewer than that


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _row_key() -> list[Column]:
    """doc_id and a hash of the text stand for a row: repeated rows share their decisions, rows that
    share only the doc_id do not."""
    return [F.col("doc_id"), F.xxhash64("text").alias("__th")]


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """Per row: a 128-bit hash for each line whose key is long enough, null for the others, by position."""
    def hashed(line: Column) -> Column:
        k = line_key(line)
        return F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit("line"), k).alias("b")))
    long_enough = F.char_length("text") >= min_chars
    return (texts(docs).filter(long_enough)
            .select(*_row_key(), F.transform(F.split("text", "\n", -1), hashed).alias("__hs")))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Positions of the lines to drop, per row that has any.

    Distinct hashes of a row are counted once (array_distinct, no shuffle) and combined before the shuffle.
    Rows that share a doc_id are one document: what they count too much is taken off again, which touches
    the rows of repeated ids only. Only frequent hashes meet the lines again. Hot ones, of which there are
    fewer than ``HOT_SHARE`` by definition, are broadcast and their lines never move; a hash that is not
    hot has at most that share of the lines, so the join by key is even without salts.
    """
    hs = staged(line_hashes(docs, min_chars), "lines")
    repeated = staged(hs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("__id")), "repeated")
    once = lambda d: d.select("doc_id", F.explode(F.array_distinct("__hs")).alias("h")).filter("h is not null").select("doc_id", "h.a", "h.b")
    surplus = (once(hs.join(repeated, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"))
               .groupBy("doc_id", "a", "b").agg((1 - F.count("*")).alias("w")).filter("w < 0"))
    counted = once(hs).withColumn("w", F.lit(1).cast("long")).unionByName(surplus)
    frequent = staged(counted.groupBy("a", "b").agg(F.sum("w").alias("n"), F.max("doc_id").alias("__last")).filter(F.col("n") >= min_docs), "frequent")
    everything = frequent.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > everything
    hot, others = frequent.filter(is_hot).drop("n"), frequent.filter(~is_hot).drop("n")
    lines = (hs.select("doc_id", "__th", F.posexplode("__hs").alias("__pos", "h")).filter("h is not null")
             .select("doc_id", "__th", "__pos", "h.a", "h.b"))
    met = lines.join(F.broadcast(hot), ["a", "b"]).unionByName(lines.join(F.broadcast(hot), ["a", "b"], "left_anti").join(others, ["a", "b"]))
    stays = F.col("doc_id").eqNullSafe(F.col("__last"))
    return met.filter(~stays).groupBy("doc_id", "__th").agg(F.collect_set("__pos").alias("__drop"))


def _kept_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, with __lines, __dropped (null where no line goes) and __kept,
    the text that stays. The struct keeps the caller's column names apart from these."""
    drop = dropped_positions(docs, min_chars, min_docs).select(F.col("doc_id").alias("__id"), F.col("__th").alias("__h"), F.col("__drop").alias("__dropped"))
    d = (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
         .withColumn("__text", F.coalesce("row.text", F.lit(""))).withColumn("__th", F.xxhash64("__text")))
    joined = d.join(drop, F.col("row.doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    positions = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_sort(F.array_except(positions, "__dropped")), lambda i: F.col("__lines")[i])
    return (joined.withColumn("__lines", F.split("__text", "\n", -1))
            .withColumn("__kept", F.when(F.col("__dropped").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row.

    A line whose key has at least ``min_chars`` code points and stands in at least ``min_docs``
    documents is dropped everywhere but in the rows with the largest doc_id holding it, which keep all its
    occurrences. Null or empty texts have one empty line. A null doc_id is smaller than any other (a
    line held only by rows without id stays). Rows of one doc_id count as one
    document, and so do all rows without id; each row is returned.
    """
    return _kept_lines(docs.select("doc_id", "text"), min_chars, min_docs).select(
        F.col("row.doc_id").alias("doc_id"), F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("__kept").alias("text"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with those lines taken out of the text. All rows stay, even where no line is left; a null
    text stays null, other columns stay as they are, but n_chars follows the text."""
    kept = _kept_lines(docs, min_chars, min_docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("__kept"))
    return kept.select(*[text.alias(c) if c == "text" else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                         else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text")).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
f AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id < f.last AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
