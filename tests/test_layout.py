from corpusgraph.operators import layout
from tests.conftest import rows

BOX = "source_file string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
TABLE = "source_file string, page int, table_no int, x0 double, y0 double, x1 double, y1 double, markdown string"


def test_blocks_inside_tables(spark):
    t = spark.createDataFrame([("f", 1, 0, 0.0, 0.0, 10.0, 10.0, "m" * 21), ("f", 1, 1, 100.0, 0.0, 110.0, 10.0, "short")], TABLE)
    blocks = [("f", 1, 0, 0.0, 0.0, 10.0, 20.0, "half"), ("f", 1, 1, 0.0, 0.0, 10.0, 19.0, "more"), ("f", 1, 2, 10.0, 0.0, 20.0, 10.0, "touch"), ("f", 2, 3, 0.0, 0.0, 5.0, 5.0, "page"), ("f", 1, 4, 100.0, 0.0, 105.0, 5.0, "small table"), ("f", 1, 5, 3.0, 3.0, 3.0, 3.0, "point")]
    kept = layout.drop_blocks_inside_tables(spark.createDataFrame(blocks, BOX), t)
    assert {r.text for r in kept.collect()} == {"half", "touch", "page", "small table", "point"}


def test_figures_take_the_caption_of_their_place(spark):
    images = spark.createDataFrame([("f.pdf", 1, 0, 10, 10, 9000, "png"), ("f.pdf", 1, 1, 200, 200, 9000, "png"), ("f.pdf", 1, 2, 200, 200, 9000, "jpg"), ("f.pdf", 1, 3, 200, 200, 4999, "jpg")], "source_file string, page int, figure_index int, width int, height int, n_bytes long, ext string")
    text = spark.createDataFrame([("f.pdf", 1, "Figure 1. a\n\nFigure 9. b\n\n")], "source_file string, page int, raw_text string")
    got = rows(layout.figure_chunks(images, text, "out/"), "text", "figure_save_path")
    assert got == [("Figure 9. b", "out/f_page1_fig2.png"), ("illustration on the page1", "out/f_page1_fig3.jpg")]


def test_chunks_are_numbered_without_gaps_at_any_partitioning(spark):
    t = spark.createDataFrame([("a.pdf", 2, 0, 0.0, 0.0, 1.0, 1.0, "t" * 30), ("b.pdf", 1, 0, 0.0, 0.0, 1.0, 1.0, "u" * 30)], TABLE)
    blocks = spark.createDataFrame([(f"{f}.pdf", p, b, 50.0, 50.0, 60.0, 60.0, f"{f}{p}{b} " + "words " * 100) for f in "ab" for p in (1, 2) for b in (0, 1)], BOX)
    want = None
    for n in (1, 7):
        got = layout.assemble_chunks(layout.table_chunks(t.repartition(n)), layout.text_chunks(blocks.repartition(n), t)).orderBy("index").collect()
        assert [r["index"] for r in got] == list(range(len(got)))
        assert [r.modality for r in got] == ["text"] * (len(got) - 2) + ["table"] * 2
        want = want or got
        assert got == want


def test_empty_layout(spark):
    t, b = spark.createDataFrame([], TABLE), spark.createDataFrame([], BOX)
    assert layout.assemble_chunks(layout.table_chunks(t), layout.text_chunks(b, t)).count() == 0
