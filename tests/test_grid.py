"""Table cells by coordinates."""

import numpy as np
from pyspark.sql import functions as F

from cutline.functions import grid
from cutline.operators import pages


def cells(spark, html):
    df = spark.createDataFrame([(html,)], "html string").select(grid.grid_cells("html").alias("c"))
    return [r.asDict() for r in df.first()["c"]]


def test_spans_and_nested_tables(spark):
    html = (
        "<table><tr><td rowspan=2>A<td colspan='2'>B<br>b</td></tr><tr><td>B1</td><th>B2"
        "<tr><td>v0<td><table><tr><td>in &amp; side</table>v1</td><td>v2</td></tr></table><td>stray</td>"
    )
    got = [(c["grid"], c["parent"], c["row"], c["col"], c["rows"], c["cols"], c["text"]) for c in cells(spark, html)]
    assert got == [
        (0, -1, 0, 0, 2, 1, "A"), (0, -1, 0, 1, 1, 2, "B\nb"), (0, -1, 1, 1, 1, 1, "B1"), (0, -1, 1, 2, 1, 1, "B2"),
        (0, -1, 2, 0, 1, 1, "v0"), (0, -1, 2, 1, 1, 1, "v1"), (1, 5, 0, 0, 1, 1, "in & side"), (0, -1, 2, 2, 1, 1, "v2"),
    ]
    df = spark.createDataFrame([(html,)], "html string").withColumn("c", grid.grid_cells("html"))
    at = lambda word: grid.first_cell(F.col("c"), lambda x: x == word)
    row = df.select(
        grid.below(F.col("c"), at("A"))["text"].alias("a"), grid.below(F.col("c"), at("B2"))["text"].alias("b"),
        grid.right_of(F.col("c"), at("A"))["text"].alias("r"), grid.right_of(F.col("c"), at("v0"), 2)["text"].alias("s"),
        grid.right_of(F.col("c"), at("v2")).alias("none"), grid.below(F.col("c"), at("absent")).alias("absent"),
    ).first()
    assert tuple(row) == ("v0", "v2", "B\nb", "v2", None, None)


def test_odd_pages(spark):
    for html in (None, "", "plain", "<td>x", "<table>", "<tr><table><![foo[ <td", "</table></td><script><td></script>"):
        assert cells(spark, html) == []
    assert [c["text"] for c in cells(spark, "<table><td rowspan=x colspan=-1>a<script>b</script><![if x]>c")] == ["a\nc"]
    assert [c["text"] for c in cells(spark, "<table><td>a<!--[if IE]><td>no<![endif]--><td>b")] == ["a", "b"]
    deep = "<table><tr><td>" * 2000 + "x"
    assert len(cells(spark, deep)) == 2000 and cells(spark, deep)[-1]["text"] == "x"
    wide = cells(spark, "<table><tr><td rowspan=0 colspan=5000>a<td>b<tr><td>c</table>")
    assert [(c["row"], c["col"], c["rows"], c["cols"]) for c in wide] == [(0, 0, 65534, 1000), (0, 1000, 1, 1), (1, 1000, 1, 1)]


def test_grids_equal_a_painted_board(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        board, html, want = {}, "", []
        for r in range(8):
            html += "<tr>"
            for _ in range(int(rng.integers(0, 5))):
                rows, cols, c = int(rng.integers(1, 4)), int(rng.integers(1, 4)), 0
                taken = [k for (y, k) in board if y == r]
                starts = [w[1] + w[3] for w in want if w[0] == r]
                c = max(starts, default=0)
                while c in taken:
                    c += 1
                board |= {(r + y, c + x): len(want) for y in range(rows) for x in range(cols)}
                html += f"<td rowspan={rows} colspan={cols}>{len(want)}</td>"
                want.append((r, c, rows, cols))
            html += "</tr>"
        got = [(c["row"], c["col"], c["rows"], c["cols"]) for c in cells(spark, f"<table>{html}</table>")]
        assert got == want


def test_details_inside_a_layout_table(spark):
    inner = (
        "<table><tr><td>00101</td></tr><tr><td colspan=2>學群類別</td><td>第一類</td></tr>"
        "<tr><td rowspan=2>國文<br>英文<br>數學A</td><td rowspan=2>均標<br>前標<br>--</td><td>1、百分比<br>2、級分</td></tr><tr><td>x</td></tr></table>"
    )
    html = f"<table><tr><td>menu</td><td>{inner}</td></tr></table>"
    row = pages.star_details(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").first()
    assert (row["program_code"], row["group_name"]) == ("00101", "第一類")
    assert [tuple(r) for r in row["requirements"]] == [("國文", "均標"), ("英文", "前標"), ("數學A", "--")]
    assert row["tie_break_items"] == ["百分比", "級分"]


def test_plain_pages_read_as_by_the_full_parser(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = ["<table>", "</table>", "<TR>", "</tr>", "<td>", "<td colspan=2>", "<TD RowSpan='2' nowrap>", '<td colspan="3" colspan=1 rowspan= 2>', "<th rowspan>", "</td >",
              "</td x>", "<br/>", "<br>", "a\nb", " > ", "<", "&amp;", "<!-- <td> -->", "<script>", "</script>", "<title>", "x", "<b class=a-b>", "<td/>", "<td\ncolspan=2\n>", "<td colspan=2rowspan=2>"]
    weights = np.array([0.3 if p in ("<", "&amp;", "<!-- <td> -->", "<script>", "</script>", "<title>", "</td x>", "<br/>", "<td/>") else 3 for p in pieces])
    pages_ = ["".join(rng.choice(pieces, rng.integers(1, 25), p=weights / weights.sum())) for _ in range(4000)]
    plain = [grid._plain_tags(p) is not None for p in pages_]
    got = [grid._read(p) for p in pages_]
    monkeypatch.setattr(grid, "_plain_tags", lambda html: None)
    assert got == [grid._read(p) for p in pages_]
    assert 500 < sum(plain) < 3800


def test_programme_pages_of_one_row_group_are_read_by_many_tasks(spark, sf):
    from cutline.plans import shapes

    for query in (shapes.programme_details, shapes.page_grids):
        assert query(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_of_one_template_are_laid_out_once(monkeypatch):
    placed, place = [], grid._Cells._place
    monkeypatch.setattr(grid._Cells, "_place", lambda self, *a: (placed.append(1), place(self, *a))[1])
    template = "<table><caption>of one template</caption><tr><td rowspan=2>{0}<br> {1} <td>{2}\n{0}<tr><td>{1}</table>"
    for i in range(500):
        places, texts = grid._read(template.format(f"a{i}", "" if i % 3 else f"b{i}", i))
        assert np.frombuffer(places, np.int32).reshape(-1, 6).tolist() == [[0, -1, 0, 0, 2, 1], [0, -1, 0, 1, 1, 1], [0, -1, 1, 1, 1, 1]]
        assert texts == ([f"a{i}", f"{i}\na{i}", ""] if i % 3 else [f"a{i}\nb{i}", f"{i}\na{i}", f"b{i}"])
    assert len(placed) == 3
