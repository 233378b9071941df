"""License scans by diagonal voting: word k-grams of documents are joined to places in templates, and votes add up along offset diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import cut, lower_ascii, table, text_or_empty
from tessera.llm.license_texts import SENTENCES, TEXTS

#: What separates words, and the base phrases with their labels.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words a gram: of phrases and sentences, and of whole license texts.
SHORT, LONG = 2, 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), BREAK), lambda w: w != "")


def _hashes(words: Column, k: int) -> Column:
    """The hashes of an array's rolling k-grams, by place."""
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def _grams(words: Column, hashes: Column, k: int, wanted: Column | None = None) -> Column:
    """Place, k, hash, first and last word of the k-grams, or of those whose hashes are in `wanted`."""
    gram = lambda i: F.struct(
        i.alias("at"), F.lit(k).alias("k"), F.get(hashes, i).alias("gram"), F.get(words, i).alias("w"), F.get(words, i + k - 1).alias("z")
    )
    places = F.sequence(F.lit(0), F.size(hashes) - 1)
    places, some = (places, F.size(hashes) > 0) if wanted is None else (F.filter(places, lambda i: F.array_contains(wanted, F.get(hashes, i))), F.size(wanted) > 0)
    none = F.array().cast("array<struct<at:int,k:int,gram:bigint,w:string,z:string>>")
    return F.when(some, F.transform(places, gram)).otherwise(none)


def template_grams(spark: SparkSession, phrases: dict[str, str], sentences: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """A row for each place of each template: its gram, k, first and last word, label, size, and base. Its size is that of the fixed lists."""
    rows = [(True, SHORT, p, label) for p, label in phrases.items()] + [(False, SHORT, p, label) for p, label in sentences.items()] + [(False, LONG, p, label) for label, p in texts.items()]
    t = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "template int, base boolean, k int, wording string, label string").withColumn("_w", words_of(F.col("wording")))
    grams = F.when(F.col("k") == SHORT, _grams(F.col("_w"), _hashes(F.col("_w"), SHORT), SHORT)).otherwise(_grams(F.col("_w"), _hashes(F.col("_w"), LONG), LONG))
    return t.select("template", "label", "base", F.size("_w").alias("size"), F.explode(grams).alias("g")).select(
        "template", "label", "base", "size", F.col("g.k").alias("k"), F.col("g.at").alias("place"), F.col("g.gram").alias("gram"), F.col("g.w").alias("_tw"), F.col("g.z").alias("_tz")
    )


def _known(templates: DataFrame) -> dict[int, set[int]]:
    """The template hashes by k; there are as many as the fixed lists have places."""
    out: dict[int, set[int]] = {SHORT: set(), LONG: set()}
    for r in templates.select("k", "gram").collect():
        out[r.k].add(r.gram)
    return out


def spans(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, texts: dict[str, str] = TEXTS, slip: int = 3, min_share: float = 0.85, text_col: str = "text",
) -> DataFrame:
    """The verified spans: _row, label, base, start, end (words, end exclusive), share (of the template's grams that voted).

    A gram votes where its hash and its first and last word are those of the template's place, so that the words of a run of votes are
    compared one by one; grams whose hash no template has are left in their arrays, never rows. A base phrase is found where all its grams vote on one diagonal. For a template, each diagonal is merged with
    those at most `slip` words away (a twentieth of a longer template's words), so a span is at most that much longer than the template;
    it counts where the merged votes have min_share of the places, at the strongest diagonal of its neighbourhood.
    """
    t = template_grams(docs.sparkSession, phrases, sentences, texts)
    known = {k: F.array(*[F.lit(h) for h in sorted(hs)]).cast("array<bigint>") for k, hs in _known(t).items()}
    w = docs.select("_row", words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("_w"))
    w = w.select("_row", "_w", *[_hashes(F.col("_w"), k).alias(f"_h{k}") for k in known])
    # One column after another and no filter on them, not even the one that explode implies: a pushed filter repeats all steps for each word.
    w = w.select("*", *[F.array_intersect(f"_h{k}", known[k]).alias(f"_x{k}") for k in known])
    grams = w.select("_row", F.explode_outer(F.concat(*[_grams(F.col("_w"), F.col(f"_h{k}"), k, F.col(f"_x{k}")) for k in known])).alias("g")).select("_row", "g.*")
    votes = grams.join(F.broadcast(t), ["gram", "k"]).where((F.col("w") == F.col("_tw")) & (F.col("z") == F.col("_tz")))
    # Places are counted, not votes: rows that share a row key vote once each for the same span.
    diagonals = cut(votes.groupBy("_row", "template", "label", "base", "size", "k", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places")), "diagonals")
    all_places = F.col("size") - (F.col("k") - 1)
    exact = diagonals.where(F.col("base") & (F.size("places") == all_places))
    exact = exact.select("_row", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("share"))
    reach = F.greatest(F.lit(slip), F.floor(F.col("size") / 20)).cast("int")
    most = max([slip, *(len(x.split()) // 20 for x in texts.values())])
    near = Window.partitionBy("_row", "template").orderBy("diagonal").rangeBetween(-most, most)
    own = F.struct(F.size("places").alias("n"), (-F.col("diagonal")).alias("d"), F.col("diagonal"), "places")
    around = diagonals.where(~F.col("base")).withColumn("_list", F.collect_list(own).over(near)).withColumn("_near", F.filter("_list", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= reach))
    found = around.where(F.array_max("_near")["d"] == -F.col("diagonal"))
    ends = F.flatten(F.transform("_near", lambda x: F.transform(x["places"], lambda p: p + x["diagonal"])))
    found = found.withColumn("share", F.size(F.array_distinct(F.flatten(F.col("_near.places")))) / all_places).where(F.col("share") >= min_share)
    found = found.select("_row", "label", "base", F.array_min(ends).alias("start"), (F.array_max(ends) + F.col("k")).alias("end"), "share")
    return exact.unionByName(found)


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, texts: dict[str, str] = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's share, else 0).

    Null and empty texts have no words, no labels ('') and score 0. Repeated rows are told apart by a row key, so each gets its own row;
    null ids are kept. A long text is read whole, as one array of words. Of neighbouring diagonals with equal votes the smallest counts.
    Other columns are neither read nor returned, so their names cannot clash. Empty tables give empty results.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # One row for each (id, text): repeated rows carry equal results, so their key may be shared.
    keyed = d.withColumn("_row", F.struct(F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "doc_id", "text")))
    s = spans(keyed.select("_row", "text"), phrases, sentences, texts).distinct()
    base = F.col("base")
    per = s.groupBy("_row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(base, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"), F.max("share").alias("score"),
    )
    n = keyed.select("doc_id", "_row", F.size(words_of(text_or_empty())).cast("long").alias("n_words"))
    return n.join(per, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for the rows of op5: grams are compared as words, diagonals in pairs."""
    rows = [(True, SHORT, p, label) for p, label in PHRASES.items()] + [(False, SHORT, p, label) for p, label in SENTENCES.items()] + [(False, LONG, p, label) for label, p in TEXTS.items()]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n    ".join(f"({n}, {str(base).lower()}, {k}, {quoted(p)}, {quoted(label)})" for n, (base, k, p, label) in enumerate(rows))
    word = lambda x: rf"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH template(template, base, k, wording, label) AS (
  VALUES {values}
), t AS (
  SELECT *, len(ws) AS size FROM (SELECT template, base, k, label, {word("wording")} AS ws FROM template)
), place AS (
  SELECT template, base, k, label, size, i AS place, array_to_string(ws[i + 1 : i + k], ' ') AS gram FROM (SELECT *, unnest(range(size - k + 1)) AS i FROM t)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {word("coalesce(text, '')")} AS ws FROM documents
), gram AS (
  SELECT r, k, i, array_to_string(ws[i + 1 : i + k], ' ') AS gram FROM (SELECT r, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM d, (VALUES ({SHORT}), ({LONG})) AS s(k))
), diagonal AS (
  SELECT r, template, base, label, size - k + 1 AS places, greatest(3, size // 20) AS reach, i - place AS g, count(DISTINCT place) AS n, list(DISTINCT place) AS seen
  FROM gram JOIN place USING (k, gram) GROUP BY ALL
), near AS (
  SELECT a.r, a.template, a.label, a.places, a.g, max(struct_pack(n := b.n, g := -b.g)) AS best, len(list_distinct(flatten(list(b.seen)))) / a.places AS share
  FROM diagonal a JOIN diagonal b ON a.r = b.r AND a.template = b.template AND abs(a.g - b.g) <= a.reach WHERE NOT a.base GROUP BY a.r, a.template, a.label, a.places, a.g
), span AS (
  SELECT r, label, base, g AS start, 1.0::DOUBLE AS share FROM diagonal WHERE base AND n = places
  UNION ALL SELECT r, label, false, g, share FROM near WHERE best.g = -g AND share >= 0.85
), found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM span GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)
"""


ORACLE = _oracle()
