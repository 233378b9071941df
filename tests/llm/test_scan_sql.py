"""License and secret scans and suffix dedup against DuckDB SQL, on made-up rows."""

import duckdb
import pandas as pd
import pytest

from helpers import frame
from tessera.llm import license_scan, secret_scan, suffix_dedup
from tessera.llm.license_texts import SENTENCES, TEXTS

PASSAGE = " ".join(f"word{k * 7919 % 997}é" for k in range(90))
SECRETS = [
    'é🙂 PassWord"\' : "abc123" token=short secret=long-enough/==',
    "AKIA" + "Z9" * 10 + " akia" + "Z9" * 10 + " AKIA" + "Z9" * 7,
    "ghp_" + "aB3" * 12 + "0 xoxb-12345-abcdefghij AIza" + "x_-9" * 9,
    "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl -----BEGIN RSA PRIVATE KEY-----\napi_key=0123456789abcdef0123456789abcdef",
    "ſecret=abcdefgh to\u212aen=abcdefgh " + "deadbeef" * 3 + "g" + "ab" * 11,
    "token=token=token=abcdef secret : \'xx\' secret:yyyyyyyy",
]
COPIES = ["a" + PASSAGE, "é" + PASSAGE + "é", PASSAGE[:350], "x" * 900, PASSAGE[3:] + "\x00" + PASSAGE[:600], "🙂" * 120 + "b", "🙂" * 120 + "c"]
MIT = TEXTS["mit"].split()
LICENSES = [
    "GNU Lesser General Public License" + " General Public License" * 3, " ".join(MIT[:40] + ["new", "words"] + MIT[40:90] + MIT[92:]), " ".join(MIT[: len(MIT) // 2]), "under the CC BY, cc by cc\x00by MIT license",
    *(f"é {t} y " * 2 for t in TEXTS.values()), *(t.upper() for t in SENTENCES),
]


@pytest.mark.parametrize("operator, sql, texts", [(license_scan.license_scan, license_scan.ORACLE, LICENSES), (secret_scan.secret_scan, secret_scan.ORACLE, SECRETS), (lambda d: suffix_dedup.suffix_dedup(d).drop("spans"), suffix_dedup.ORACLE, COPIES)])
def test_same_as_sql(spark, odd_rows, operator, sql, texts):
    short = [(i, t if t is None else t[:20_000], s) for i, t, s in odd_rows]
    rows = short + [(100 + k, t, "a") for k, t in enumerate(texts)]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string")}))
    rel, df = c.sql(sql), operator(frame(spark, rows))
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    got, want = sorted((tuple(r[x] for x in rel.columns) for r in df.collect()), key=key), sorted(rel.fetchall(), key=key)
    assert got == want
