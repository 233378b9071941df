"""Labels that the scan adds, against a plain version that compares words."""

import re
from collections import defaultdict

from helpers import frame
from tessera.llm import license_scan
from tessera.llm.license_texts import SENTENCES, TEXTS


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_labels(text):
    w, found = words(text), {label for p, label in license_scan.PHRASES.items() if f" {p} " in f" {' '.join(words(text))} "}
    best = float(bool(found))
    for template, label, k in [(p, label, 2) for p, label in SENTENCES.items()] + [(p, label, 5) for label, p in TEXTS.items()]:
        t, at = words(template), defaultdict(set)
        slip = max(3, len(t) // 20)
        where = defaultdict(list)
        for p in range(len(t) - k + 1):
            where[tuple(t[p : p + k])].append(p)
        for i in range(len(w) - k + 1):
            for p in where.get(tuple(w[i : i + k]), ()):
                at[i - p].add(p)
        for d in at:
            near = {x: places for x, places in at.items() if abs(x - d) <= slip}
            if d == min(near, key=lambda x: (-len(near[x]), x)):
                share = len(set().union(*near.values())) / (len(t) - k + 1)
                if share >= 0.85:
                    found.add(label)
                    best = max(best, share)
    return ",".join(sorted(found)), best


def test_labels(spark, odd_rows, documents):
    lesser = "GNU Lesser General Public License"
    mit = TEXTS["mit"].split()
    edited = " ".join(mit[:40] + ["new", "words"] + mit[40:90] + mit[92:])
    rows = [(1, lesser, "a"), (2, lesser + " General Public License" * 3, "a"), (3, edited, "a"), (4, " ".join(mit[: len(mit) // 2]), "a"), (5, None, "a"), (6, "licensed under the under the cc by 4 0", "a")]
    rows += [(100 + k, f"x {t} y " * 2, "b") for k, t in enumerate(TEXTS.values())] + [(200 + k, t.upper(), "b") for k, t in enumerate(SENTENCES)]
    for part in (rows, odd_rows, documents):
        got = license_scan.license_scan(frame(spark, part)).collect()
        want = {(i, *brute_labels(t)) for i, t, _ in part}
        assert len(got) == len(part) and {(r.doc_id, r.labels, r.score) for r in got} == want
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert "lgpl" in got[1] and "lgpl" in got[2] and "mit" in got[3]
    assert all(label in got[100 + k] for k, label in enumerate(TEXTS))


def test_spans_are_bounded(spark):
    rows = frame(spark, [(1, "general public license " * 500 + "gnu lesser general public license " * 3, "a")])
    got = license_scan.spans(rows.selectExpr("doc_id AS _row", "text")).where("NOT base").collect()
    assert {r.label for r in got} == {"lgpl"} and all(r.end - r.start <= 5 + 2 * 3 for r in got)
