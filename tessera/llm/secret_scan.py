"""Secret scans over an incremental blob ledger: every version of a text is addressed by its content, only pairs of a blob and a rule
version that the ledger has not seen are scanned, and findings are joined back to all paths."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_batches, table, text_or_empty

#: Rule sets by version; of each rule its kind, pattern, least characters of the value and the value's group, in order. The
#: versions are scanned and kept apart, so that a change of the added rules rescans no blob for the base ones.
RULE_SETS = {
    "base-1": [
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ],
    "added-1": [
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
        ("google", r"AIza[A-Za-z0-9_-]{35}", 39, 0),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, 0),
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20, 0),
    ],
}
BASE = [kind for kind, *_ in RULE_SETS["base-1"]]
#: Kinds in the order in which spans that start together are listed.
KINDS = [kind for rules in RULE_SETS.values() for kind, *_ in rules]
_COMPILED = {version: [(kind, re.compile(p if kind != "hex" else r"[0-9a-f]{24,}"), least, group) for kind, p, least, group in rules] for version, rules in RULE_SETS.items()}
_KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
_LEDGER = "blob string, version string, spans array<struct<kind:string,start:int,end:int>>"


def find(text: str, versions: Iterable[str] = RULE_SETS) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed. Runs of 24 and more hex digits are what [0-9a-f]+ finds and the
    length rule keeps, since runs are maximal."""
    found = []
    for version in versions:
        for kind, pattern, least, group in _COMPILED[version]:
            if kind == "assign" and not _KEYWORD.search(text):
                continue
            found += [(m.start(), KINDS.index(kind), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for blob, versions, text in zip(b["blob"], b["versions"], b["text"]):
            rows += [(blob, v, [{"kind": k, "start": a, "end": z} for k, a, z in find(text, [v])]) for v in versions]
        yield pd.DataFrame(rows, columns=["blob", "version", "spans"])


def address(text_col: str = "text") -> Column:
    """The content address of a text; a null is the empty text."""
    return F.sha2(text_or_empty(text_col).cast("binary"), 256)


def scan_new(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text", versions: Iterable[str] = RULE_SETS) -> DataFrame:
    """(blob, version, spans) of the pairs of a blob of docs and a rule version that the ledger has not: the rows to append to it.

    Blobs are narrowed to the unseen ones before any text is shuffled, and each is scanned once, for all its unseen versions."""
    wanted = F.array(*[F.lit(v) for v in versions])
    blobs = small_batches(docs).select(address(text_col).alias("blob"), text_or_empty(text_col).alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("versions", wanted)
    else:
        seen = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set("version").alias("_seen"))
        blobs = blobs.join(seen, F.col("blob") == F.col("_blob"), "left").withColumn("versions", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("versions") > 0)
    once = blobs.groupBy("blob").agg(F.first("versions").alias("versions"), F.first("text").alias("text"))
    return once.mapInPandas(_scan, _LEDGER)


def scanned(docs: DataFrame, ledger_path: str | None = None, text_col: str = "text", versions: Iterable[str] = RULE_SETS) -> DataFrame:
    """(blob, spans) of every blob of docs that has a span, all versions' spans in order, after the ledger was brought up to date.

    The ledger is a table of (blob, version, spans), read again after what is new was appended; pairs that two writers append at the
    same time are equal. Without a path a fresh ledger in the shared folder is used.
    """
    spark, versions = docs.sparkSession, list(versions)
    if ledger_path is None:
        ledger = cut(scan_new(docs, None, text_col, versions), "blob-ledger")
    else:
        try:
            old = spark.read.schema(_LEDGER).parquet(ledger_path)
        except Exception as e:  # the first call finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        cut(scan_new(docs, old, text_col, versions), "blob-ledger-new").write.mode("append").parquet(ledger_path)
        ledger = spark.read.schema(_LEDGER).parquet(ledger_path)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("s.kind"))
    one = ledger.where(F.col("version").isin(versions) & (F.size("spans") > 0)).select("blob", F.explode("spans").alias("s"))
    spans = one.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end")))).alias("spans"))
    return spans


def secret_scan(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", versions: Iterable[str] = RULE_SETS) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex (long), base_sha256, spans, blob.

    Every row is a path of its text, a historical version among others if docs holds several rows for one id. ledger_path is a table that
    earlier calls wrote; this call appends what it scans. A null text is empty; an empty text has no spans ('' and the hash of '').
    Repeated rows and copies are one blob, scanned once, and each gets its row. Null ids are kept. Long texts are scanned whole. Spans
    that start at one place stand in the order of KINDS. Empty tables give empty results. Other columns are neither read nor returned.
    """
    found = scanned(docs, ledger_path, text_col, versions)
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    own = F.filter(spans, lambda s: s["kind"].isin(BASE))
    of_kind = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in BASE]
    paths = docs.select(F.col(id_col).alias("doc_id"), address(text_col).alias("blob"))
    # The paths of a much copied blob are narrow rows on the side that adaptive execution splits; each blob has one row of findings.
    return paths.join(found, "blob", "left").select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), "blob")


def _replaced(texts: pd.Series, spans: pd.Series) -> list[str | None]:
    out = []
    for text, found in zip(texts, spans):
        if text is None or found is None:
            out.append(text)
            continue
        parts, at = [], 0
        for s in found:
            if s["start"] >= at:
                parts += [text[at : s["start"]], "[SECRET]"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]))
    return out


def redacted_documents(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span of its texts replaced by [SECRET], and n_chars, where docs has it, set to the new length.

    The spans come from the ledger by content address; only texts with spans meet Python again. No row goes: null and empty texts, null
    ids and repeated rows stay as they are. An empty table gives an empty result. Columns of any other name pass through.
    """

    @F.pandas_udf("string")
    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(_replaced(texts, spans), index=texts.index, dtype=object)

    found = scanned(docs, ledger_path, text_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), address(text_col).alias("blob"))
    both = row.join(found, "blob", "left")
    text = F.col(f"row.`{text_col}`")
    # Clean texts reach Python as nulls, and the rows are shuffled once.
    both = both.withColumn("new", F.coalesce(replace(F.when(F.col("spans").isNotNull(), text), F.col("spans")), text))
    fields = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return both.select(*[c.alias(name) for name, c in fields.items()])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are paths of a ledger that starts empty: each distinct text is scanned once for each of the two rule versions."""
    return secret_scan(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of op7. A match starts where the gaps and matches before it end.
ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), rule(rank, kind, own, pattern, least, grp) AS (
  VALUES (1, 'assign', true, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6, 2),
    (2, 'access', true, 'AKIA[A-Z0-9]+', 20, 0), (3, 'hex', true, '[0-9a-f]+', 24, 0),
    (4, 'github', false, 'gh[pousr]_[A-Za-z0-9]{36,}', 40, 0), (5, 'slack', false, 'xox[abprs]-[A-Za-z0-9-]{10,}', 15, 0),
    (6, 'google', false, 'AIza[A-Za-z0-9_-]{35}', 39, 0), (7, 'jwt', false, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 30, 0),
    (8, 'pem', false, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 20, 0)
), m AS (
  SELECT r, rank, kind, own, least, regexp_extract_all(x, pattern) AS whole, CASE grp WHEN 2 THEN regexp_extract_all(x, pattern, 2) ELSE regexp_extract_all(x, pattern) END AS val, string_split_regex(x, pattern) AS gap
  FROM t, rule WHERE regexp_matches(x, pattern)
), p AS (
  SELECT r, rank, kind, own, least, unnest(whole) AS w, unnest(val) AS v, unnest(gap[: len(whole)]) AS g, unnest(range(len(whole))) AS i FROM m
), s AS (
  SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY r, rank ORDER BY i) AS z FROM p
), f AS (
  SELECT r, rank, kind, own, z - length(w) AS a, concat(kind, ':', z - length(w), ':', z) AS span FROM s WHERE length(v) >= least
), d AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY a, rank) FILTER (own) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans
  FROM f GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(x) AS blob
FROM t LEFT JOIN d USING (r)
"""
