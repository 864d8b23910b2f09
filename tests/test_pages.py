"""Sections of two versions, and texts in parts."""

from tessellary.operators import pages

OLD = "intro\n# A\nsame\n\n## B\nold line\nkept\n# Gone\nx\n# Twice\nfirst\n# Twice\nlast"
NEW = "# A\n\nsame  \n## B\nkept\nnew line\n# Come\ny\n# Twice\nlast"


def test_four_kinds_of_sections(spark):
    df = spark.createDataFrame([(1, OLD, NEW, 0), (2, None, "# N\nz", 0), (3, "plain", None, 0)], "k int, a string, b string, title int")
    got = sorted((r.k, r.title, r.change, r.removed, r.added) for r in pages.section_diff(df, "k", "a", "b").collect())
    assert got == [
        (1, "A", "unchanged", [], []), (1, "B", "modified", ["old line"], ["new line"]), (1, "Come", "added", [], []), (1, "Gone", "deleted", [], []),
        (1, "Twice", "unchanged", [], []), (2, "N", "added", [], []),
    ]


def test_parts():
    assert list(pages.parts_of("a" * 25, 10)) == ["a" * 10, "a" * 10, "a" * 5]
    assert list(pages.parts_of("a" * 9 + "\n" + "b" * 9, 10)) == ["a" * 9, "\n" + "b" * 9]
    assert list(pages.parts_of("top\n## One\nx\n## Two\nyyyyyyyyyyyyyyyyyyyyyyyy\n## Three\n", 25)) == ["top\n## One\nx", "## Two\nyyyyyyyyyyyyyyyyyyyyyyyy", "## Three"]
    for n in range(1, 40):
        text = "".join("\n" if i % 7 == 6 else "x" for i in range(100))
        assert "".join(pages.parts_of(text, n)) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x" * 25)], "n int, t string").withColumnRenamed("n", "id")
    got = [(r.id, r.n, len(r.part)) for r in pages.split_texts(df, "id", "t", 10).collect()]
    assert got == [(1, 0, 0), (3, 0, 10), (3, 1, 10), (3, 2, 5)]
