"""Base counts, licenses, secrets, quality, mixing: against brute force, and with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import SF, frame
from tessera.llm import license_scan, mixing, quality_classifier, quality_rules, secret_scan


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w, t = words_of(text), text or ""
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd_rows, documents):
    for rows in (odd_rows, documents):
        got = quality_rules.quality_rules(frame(spark, rows), max_docs=2).collect()
        want = Counter((i, *base(t)) for i, t, _ in rows)
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)


def test_frequent_lines_deplete(spark):
    own = lambda k: " ".join(f"u{chr(97 + k)}x{j}" for j in range(60))
    shared = " ".join(f"common{j}" for j in range(200))
    rows = [(k, f"{shared} {k}\n{own(k)}", "h") for k in range(5)] + [(9, own(9), "h"), (10, shared + "\n" + own(10), "other")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), max_docs=3).collect()}
    assert [got[k].kept for k in (0, 4, 9, 10)] == [False, False, True, True]
    assert got[0].n_line_words_removed == 201


def test_quality_rules_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = c.sql(quality_rules.ORACLE)
    df = quality_rules.op2_quality_rules(spark, SF)
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_license_scan(spark, odd_rows, documents):
    for rows in (odd_rows, documents):
        got = license_scan.license_scan(frame(spark, rows)).collect()
        want = Counter()
        for i, t, _ in rows:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            hits = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            at = [k for k, _ in hits] or [None]
            want[(i, len(w), len(hits), min(at) if hits else None, max(at) if hits else None, ",".join(sorted({x for _, x in hits})))] += 1
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)


def test_license_templates_need_their_words(spark):
    rows = [(1, "x Released under the MIT License. y", "a"), (2, "Licensed under CC BY-NC 4.0.", "a"), (3, "under the sun", "a")]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == {1: "mit", 2: "cc-by,cc-by-nc-4.0", 3: ""}


def test_license_scan_of_repeated_rows(spark):
    text = "under the MIT License ok. GNU General Public License, licensed under CC BY 4.0"
    got = license_scan.license_scan(frame(spark, [(1, text, "a"), (1, text, "a"), (None, text, "b"), (None, text, "b")])).collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [(3, 2, 11, "cc-by,gpl,mit")] * 4
    assert len({r.labels for r in got}) == 1


def brute_secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    names = ["assign", "access", "hex"]
    return [sum(k == n for _, k, _ in out) for n in range(3)], hashlib.sha256(",".join(f"{names[k]}:{a}:{z}" for a, k, z in sorted(out)).encode()).hexdigest()


def test_secret_scan(spark, odd_rows, documents):
    more = [(20, "token: abc\ntoken: abcdef, AKIAshort AKIA" + "Z" * 16 + " ghp_" + "a1" * 20, "a")]
    for rows in (odd_rows + more, documents):
        got = secret_scan.secret_scan(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter((i, *brute_secrets(t)[0], brute_secrets(t)[1]) for i, t, _ in rows)
    assert "github" in {kind for kind, _, _ in secret_scan.find(more[0][1])}


def test_ledger_scans_only_what_is_new(spark, odd_rows, tmp_path):
    path = str(tmp_path / "ledger")
    secret_scan.secret_scan(frame(spark, odd_rows[:6]), path, versions=["base-1"]).collect()
    first = spark.read.parquet(path).count()
    assert first == len({t or "" for _, t, _ in odd_rows[:6]})
    new = secret_scan.scan_new(frame(spark, odd_rows), spark.read.parquet(path)).collect()
    assert {r.version for r in new} == {"base-1", "added-1"} and len({(r.blob, r.version) for r in new}) == len(new)
    got = secret_scan.secret_scan(frame(spark, odd_rows), path).collect()
    assert sorted(map(str, got)) == sorted(map(str, secret_scan.secret_scan(frame(spark, odd_rows)).collect()))
    assert len(got) == len(odd_rows) and spark.read.parquet(path).count() == 2 * len({t or "" for _, t, _ in odd_rows}) == first + len(new)
    assert secret_scan.scan_new(frame(spark, odd_rows), spark.read.parquet(path)).isEmpty()


def test_added_spans_and_historical_versions(spark, tmp_path):
    key, later = "ghp_" + "a1" * 20, "xoxb-" + "1234567890ab"
    history = [(1, f"v1 {key} AIza{'b' * 35} end", "a"), (1, f"v2 {later} -----BEGIN RSA PRIVATE KEY-----", "a"), (1, "v3 clean", "a"), (2, f"v1 {key} AIza{'b' * 35} end", "b"), (3, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "b")]
    want = Counter()
    for i, t, _ in history:
        spans = []
        for kind, pattern in (("github", "gh[pousr]_[A-Za-z0-9]{36,}"), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"), ("google", "AIza[A-Za-z0-9_-]{35}"), ("jwt", r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----")):
            spans += [(m.start(), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t, re.A)]
        want[(i, ",".join(s for _, s in sorted(spans + [(m.start(), f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]{24,}", t)])))] += 1
    got = secret_scan.secret_scan(frame(spark, history), str(tmp_path / "ledger")).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == want


def test_redaction(spark):
    df = secret_scan.redacted_documents(frame(spark, [(1, "a password = abcdef123 b", "s"), (2, None, "s"), (3, "clean", "s")]))
    assert [(r.text, r.n_chars) for r in df.orderBy("doc_id").collect()] == [("a [SECRET] b", 12), (None, None), ("clean", 5)]


def test_redaction_of_odd_rows(spark, odd_rows):
    docs = frame(spark, odd_rows + [(30, "token: abcdef token: abc secret=abcdefg", "a")])
    got = secret_scan.redacted_documents(docs)
    assert got.columns == docs.columns and secret_scan.redacted_documents(docs.limit(0)).isEmpty()
    rules = [r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"]

    def plain(t):
        for rule in rules:
            t = re.sub(rule, "[SECRET]", t) if t else t
        return t

    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter((r.doc_id, plain(r.text), r.source) for r in docs.collect())


def test_quality_classifier(spark):
    df = quality_classifier.op6_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    got = df.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


@pytest.mark.parametrize("label_rows", [[], [(4, 1)], [(4, 1), (7, 0), (7, None), (None, 1)]])
def test_quality_classifier_odd(spark, odd_rows, label_rows):
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int")
    got = quality_classifier.quality_classifier(frame(spark, odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(r.score is not None for r in got)
    assert quality_classifier.quality_classifier(frame(spark, []), labels).isEmpty()


def test_temperature():
    tokens = {"a": 900, "b": 50, "c": 50}
    spread = lambda w: -sum(x * math.log(x) for x in w.values())
    a, w = mixing.temperature(tokens, 1000, 0.9, 100)
    assert 0 < a < 1 and abs(spread(w) - 0.9 * math.log(3)) < 1e-6
    b, v = mixing.temperature(tokens, 1000, 0.9, 2)
    assert b > a and abs(max(v[s] * 1000 / t for s, t in tokens.items()) - 2) < 1e-6
    assert mixing.temperature({"a": 5}, 5, 0.9, 4)[1] == {"a": 1.0}


def test_mixing_meets_quotas(spark, documents, odd_rows):
    docs = frame(spark, documents)
    got = mixing.mix_sources(docs, budget_ratio=1.5, blocks=8).collect()
    tokens = Counter()
    for _, t, s in documents:
        tokens[s] += max(1, len(words_of(t)))
    budget, used, longest = 1.5 * sum(tokens.values()), Counter(), max(max(1, len(words_of(t))) for _, t, _ in documents)
    _, weights = mixing.temperature(dict(tokens), budget, 0.95, 4.0)
    for r in got:
        used[r.source] += r.tokens
    assert all(weights[s] * budget - longest < used[s] <= weights[s] * budget + 1e-6 for s in tokens)
    copies = {(r.doc_id, r.copy) for r in got}
    assert len(copies) == len(got) and all(c == 1 or (d, c - 1) in copies for d, c in copies) and all(0 <= r.slot <= 1.2 for r in got)
    assert mixing.mix_sources(frame(spark, [])).isEmpty()
    kept = mixing.mixed(frame(spark, odd_rows))
    assert kept.columns == docs.columns and kept.count() > 0


def test_odd_tables_are_empty(spark):
    none = frame(spark, [])
    for make in (quality_rules.quality_rules, license_scan.license_scan, secret_scan.secret_scan):
        assert make(none).isEmpty()


@pytest.mark.parametrize("ratio, entropy", [(0.7, 0.95), (1.5, 0.6), (1.0, 0.99)])
def test_mixing_against_a_plain_version(spark, documents, odd_rows, ratio, entropy):
    """Which copies are taken: whole rounds, then blocks in their order while they fit, then documents of the last block in theirs."""
    blocks, seed = 4, 11
    rows = [(i, t, s) for i, t, s in documents + odd_rows if i is not None]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    docs = frame(spark, rows)
    keys = docs.selectExpr("doc_id", "coalesce(source, '') AS s", f"pmod(xxhash64({seed}, doc_id), {blocks}) AS b", f"xxhash64({seed + 1}, doc_id) AS o")
    keys = keys.selectExpr("*", f"xxhash64({seed + 2}, s, cast(b AS int)) AS r").collect()
    size = {i: max(1, len(words_of(t))) for i, t, _ in rows}
    total = Counter()
    for k in keys:
        total[k.s] += size[k.doc_id]
    _, weights = mixing.temperature(dict(total), ratio * sum(total.values()), entropy, 4.0)
    want = Counter()
    for s, t in total.items():
        own, quota = [k for k in keys if k.s == s], weights[s] * ratio * sum(total.values())
        rounds, room = int(quota // t), quota % t
        want.update({k.doc_id: rounds for k in own})
        for k in sorted(own, key=lambda k: (k.r, k.b, k.o)):
            if size[k.doc_id] > room:
                break
            want[k.doc_id] += 1
            room -= size[k.doc_id]
    got = mixing.mix_sources(docs, budget_ratio=ratio, entropy=entropy, blocks=blocks, seed=seed)
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert Counter(r.doc_id for r in mixing.mixed(docs, budget_ratio=ratio, entropy=entropy, blocks=blocks, seed=seed).collect()) == +want
