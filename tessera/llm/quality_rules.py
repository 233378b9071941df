"""Quality rules: base counts of each text and the frequency of its lines over a host's documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, lower_ascii, salted_join, table, text_or_empty

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and the base counts, all long, and base_failed.

    Three-word windows are found twice by sorting their hashes with their places; the places are then sorted again, so that the
    covered words are counted in n log n steps, however long a text is.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_t")).withColumn("_w", _words(F.col("_t")))
    at = lambda i: F.get("_w", i.cast("int"))
    windows = words.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(
            F.size("_w") >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"),
    )
    again = windows.withColumn(
        "_p",
        F.array_sort(F.transform(
            F.filter("_s", lambda x, k: (F.get("_s", k - 1)["h"].eqNullSafe(x["h"])) | (F.get("_s", k + 1)["h"].eqNullSafe(x["h"]))),
            lambda x: x["i"],
        )),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    ).cast("long")
    return again.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised(line: Column) -> Column:
    """Lower case, digits as one 0, one space between words: lines that differ in a date or a count are the same line."""
    return F.trim(F.regexp_replace(F.regexp_replace(lower_ascii(line), SPACE, " "), "[0-9]+", "0"))


def line_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each line with a word: doc_id, host, line (the hash of its normal form), line_words."""
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.explode(F.filter(F.split(text_or_empty(text_col), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).alias("_l"),
    )
    return lines.select("doc_id", "host", F.xxhash64(normalised(F.col("_l"))).alias("line"), F.size(_words(F.col("_l"))).cast("long").alias("line_words"))


def frequent_lines(lines: DataFrame, max_docs: int, host_docs: DataFrame, max_share: float) -> DataFrame:
    """(host, line) of lines in over max_docs and over max_share of the host's distinct documents, which host_docs (host, host_docs) counts.
    Two steps, so that no key's rows meet before they are counted."""
    often = lines.select("host", "line", "doc_id").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    return often.join(host_docs, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).drop("host_docs")


def documents_per_host(docs: DataFrame, id_col: str, host_col: str) -> DataFrame:
    """host, host_docs: its distinct documents; null ids are one document, as in the line counts."""
    own = docs.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(id_col).alias("doc_id")).distinct()
    return own.groupBy("host").agg(F.count("*").alias("host_docs"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_docs: int = 5, min_left: float = 0.5, salts: int = 64, max_share: float = 0.005,
) -> DataFrame:
    """Base counts and the verdict of the cross-document line rule.

    Lines are normalised and hashed. A line is removed where over max_share of the host's distinct documents hold it, and over max_docs of
    them, the floor for small hosts; a document that keeps under min_left of its words is depleted. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words (long), base_failed, n_line_words_removed (long), kept.

    A null text is empty: no words, so base_failed. A null host is a host of its own (""). Null ids are kept and treated as one
    document in the line counts. Repeated rows each get a row; they count as one document, since ids are counted once. Long texts are
    read whole. There are no ties to settle: a share or count equal to a limit is not over it. Empty tables give empty results; other columns are
    neither read nor returned.
    """
    base = base_counts(docs, id_col, text_col)
    lines = line_rows(docs, id_col, text_col, host_col)
    often = frequent_lines(lines, max_docs, documents_per_host(docs, id_col, host_col), max_share).select("host", "line", F.lit(True).alias("_often"))
    left = salted_join(lines, often, ["host", "line"], salts, F.xxhash64("doc_id"), "left")
    removed = left.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sum("line_words").alias("_all"), F.sum(F.when(F.col("_often"), F.col("line_words")).otherwise(0)).alias("_lost")
    )
    lost, words = F.coalesce("_lost", F.lit(0)), F.coalesce("_all", F.lit(0))
    return base.join(removed, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        *base.columns,
        lost.cast("long").alias("n_line_words_removed"),
        (~F.col("base_failed") & ((words - lost) >= min_left * words)).alias("kept"),
    )


def without_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 5, max_share: float = 0.005, salts: int = 64,
) -> DataFrame:
    """docs with the lines that quality_rules counts as frequent taken out of its texts; other lines keep their place and their form.

    No row goes: null and empty texts, null ids and repeated rows stay. A null host is a host of its own. An empty table gives an empty
    result. Columns of any other name pass through.
    """
    lines = line_rows(docs, id_col, text_col, host_col)
    often = frequent_lines(lines, max_docs, documents_per_host(docs, id_col, host_col), max_share).select("host", "line")
    hit = salted_join(lines, often, ["host", "line"], salts, F.xxhash64("doc_id")).groupBy("doc_id", "host").agg(F.collect_set("line").alias("gone"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"))
    both = row.join(hit, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_host") == F.col("host")), "left")
    text = F.col(f"row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normalised(x)))), "\n")
    return both.select(*[F.when(F.col("gone").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') host, coalesce(text, '') txt FROM documents),
w AS (SELECT doc_id, txt, list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM t),
g AS (SELECT doc_id, i, ws[i:i+2] tri FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM r) GROUP BY doc_id),
ln AS (SELECT doc_id, host, unnest(string_split(txt, chr(10))) l FROM t),
good AS (SELECT doc_id, host, l,
  trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) norm,
  len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) lw
  FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) n FROM good GROUP BY doc_id),
hd AS (SELECT host, count(DISTINCT doc_id) h FROM t GROUP BY 1),
freq AS (SELECT host, norm FROM good JOIN hd USING (host) GROUP BY host, norm, h HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > 0.005::DOUBLE * h),
lost AS (SELECT g.doc_id, sum(lw) allw, coalesce(sum(lw) FILTER (WHERE f.norm IS NOT NULL), 0) lostw FROM good g LEFT JOIN freq f ON g.host = f.host AND g.norm = f.norm GROUP BY 1),
b AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT word_chars,
  (length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols,
  coalesce(dup.n, 0)::BIGINT n_dup_lines, coalesce(rep.n, 0)::BIGINT n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT b.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) base_failed, coalesce(lostw, 0)::BIGINT n_line_words_removed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(allw, 0) - coalesce(lostw, 0) >= 0.5 * coalesce(allw, 0) kept
FROM b LEFT JOIN lost USING (doc_id)
"""
