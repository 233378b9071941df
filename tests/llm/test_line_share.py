"""Line limits as a share of a host's documents do not depend on the size of the table."""

from helpers import frame
from tessera.llm import quality_rules


def rows(copies):
    """Per copy 10 documents of host h and 4 of a null host: line a stands in 6 of 10, line b in 1 of 10, line n in all 4."""
    line = lambda tag, n: " ".join(f"{tag}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(n))
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    out = []
    for k in range(10 * copies):
        out.append((k, "\n".join([line("own" + letters(k), 60), *([line("a", 90)] if k % 10 < 6 else []), *([line("b", 5)] if k % 10 == 9 else [])]), "h"))
    return out + [(100_000 + k, line("n" + letters(k), 60) + "\n" + line("n", 8), None) for k in range(4 * copies)]


def test_share_of_a_host(spark):
    for copies in (1, 20):
        docs = rows(copies)
        got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, docs), max_docs=3, max_share=0.5).collect()}
        want = {i: 8 if s is None else 90 if i % 10 < 6 else 0 for i, _, s in docs}
        assert {i: r.n_line_words_removed for i, r in got.items()} == want
        assert all(got[i].kept == (want[i] < 90) for i in want)


def test_lines_are_removed(spark, odd_rows):
    docs = rows(2)
    got = {r.doc_id: r for r in quality_rules.without_frequent_lines(frame(spark, docs), max_docs=3, max_share=0.5).collect()}
    for i, t, s in docs:
        lines = t.split("\n")
        want = lines[:1] if s is None or i % 10 < 6 else lines
        assert got[i].text == "\n".join(want) and got[i].source == s
    odd = frame(spark, odd_rows)
    same = quality_rules.without_frequent_lines(odd)
    assert same.columns == odd.columns and sorted(map(str, same.collect())) == sorted(map(str, odd.collect()))
    assert quality_rules.without_frequent_lines(odd.limit(0)).isEmpty()


def test_the_rule_rejects_documents_of_the_query(spark):
    """On whole tables with groups of copies the query's own limits act beyond the base rules."""
    own = lambda k: " ".join(f"o{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{j}x" for j in range(70))
    copied = "\n".join(" ".join(f"c{chr(97 + k)}{j}y" for j in range(30)) for k in range(4))
    docs = [(k, own(k) + "\n" + own(k + 300), "h") for k in range(300)] + [(1000 + k, f"{copied}\nlast {own(k)}"[: len(copied) + 40], "h") for k in range(8)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert sorted(i for i, kept in got.items() if not kept) == [1000 + k for k in range(8)]
