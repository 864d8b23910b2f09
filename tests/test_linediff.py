"""Shortest scripts against brute force, their tables, and cuts at anchors."""

import random

import pytest

from tessellary.operators import linediff


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, row[j + 1] = row[j + 1], corner + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def kept(a, b, script):
    """Lines kept by a script, which must lead from a to b step by step."""
    i = j = 0
    for kind, x, y in script:
        assert (x, y) == (i, j)
        assert kind != "equal" or a[x] == b[y]
        i, j = i + (kind != "insert"), j + (kind != "delete")
    assert (i, j) == (len(a), len(b))
    return sum(kind == "equal" for kind, _, _ in script)


@pytest.mark.parametrize("traced", [0, 1, 2, 5, 1000])
def test_scripts_are_shortest(monkeypatch, traced):
    monkeypatch.setattr(linediff, "TRACED", traced)
    rng = random.Random(traced)
    for n in range(600):
        letters = "ab" if n % 3 else "abcdefgh"
        a, b = (rng.choices(letters, k=rng.randint(0, 14)) for _ in range(2))
        assert kept(a, b, linediff.shortest_script(a, b)) == common(a, b)


def test_forward_search_prefers_deletions_first():
    kinds = [k[0] for k, _, _ in linediff.shortest_script(list("abcabba"), list("cbabac"))]
    assert kinds == list("ddeieedei")


def test_many_lines_take_little_memory():
    import tracemalloc

    rng = random.Random(1)
    a = [f"line {i}" for i in range(20_000)]
    b = [f"line {i + rng.randint(-3, 3)}" for i in range(20_000)]
    tracemalloc.start()
    script = linediff.shortest_script(a, b)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert kept(a, b, script) > 5_000


def test_anchors_rise_in_both_texts():
    assert linediff.anchors(list("abcdxx"), list("bacdxe")) in ([(0, 1), (2, 2), (3, 3)], [(1, 0), (2, 2), (3, 3)])
    assert linediff.anchors([], ["a"]) == []


PAIRS = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x"), (3, "", ""), (4, "x\n\ny", None), (5, "same", "same"), (5, "k\nk", "k")]


def test_tables_of_changes(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAIRS], "k int, old string, new string, type string")
    got = sorted(map(tuple, linediff.changes(df, "k", "old", "new").select("k", "type", "old_line", "new_line", "content").collect()), key=str)
    assert got == sorted(
        [(1, "removed", 2, None, "b"), (1, "added", None, 3, "d"), (2, "added", None, 1, "x"), (4, "removed", 1, None, "x"), (4, "removed", 2, None, ""),
         (4, "removed", 3, None, "y"), (5, "removed", 2, None, "k")], key=str)
    counted = sorted(map(tuple, linediff.counts(df.where("k < 5"), "k", "old", "new").collect()))
    assert counted == [(1, 1, 1, 2 / 3), (2, 1, 0, 0.0), (3, 0, 0, 1.0), (4, 0, 3, 0.0)]
    assert linediff.counts(df.where("k > 9"), "k", "old", "new").collect() == []


def test_anchored_parts_make_valid_scripts(spark):
    rng = random.Random(4)
    a = [f"u{i}" if i % 3 else rng.choice("pq") for i in range(300)]
    b = [x for x in a if rng.random() > 0.2] + ["end"]
    df = spark.createDataFrame([(1, "\n".join(a), "\n".join(b))], "k int, old string, new string")
    rows = linediff.changes(df, "k", "old", "new", anchored_over=40).collect()
    assert len({r.part for r in rows}) > 3
    gone, come = {r.old_line for r in rows}, {r.new_line for r in rows}
    assert [x for i, x in enumerate(a, 1) if i not in gone] == [x for j, x in enumerate(b, 1) if j not in come]


def test_hunks_and_texts(spark):
    old = "\n".join(f"l{i}" for i in range(1, 31))
    new = old.replace("l2\n", "L2\n").replace("l5\n", "").replace("l20\n", "l20\nextra & <new>\n")
    changed = linediff.changes(spark.createDataFrame([(7, old, new)], "k int, old string, new string"), "k", "old", "new")
    found = linediff.hunks(changed, "k")
    got = [(r.hunk, r.start, r.old_count, r.new_count, r.lines) for r in found.orderBy("hunk").collect()]
    assert got == [(1, 2, 2, 1, ["-l2", "+L2", "-l5"]), (2, 20, 0, 1, ["+extra & <new>"])]
    assert linediff.unified_texts(found, "k").first().diff == "@@ -2,2 +2,1 @@\n-l2\n+L2\n-l5\n@@ -20,0 +20,1 @@\n+extra & <new>"
    html = [r.html for r in linediff.html_rows(changed).orderBy("place").collect()]
    assert html[-1].endswith('<td class="line-num new">20</td><td class="line-content"><span class="diff-marker">+</span>extra &amp; &lt;new&gt;</td></tr>')
    assert html[0].startswith('<tr class="diff-removed"><td class="line-num old">2</td><td class="line-num new"></td>')
