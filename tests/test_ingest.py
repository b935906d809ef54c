from lodestrata.plans.ingest import ingest
from lodestrata.schema import PAGE, TOC


def text(y, t, no=0):
    return (50.0, float(y), 300.0, float(y) + 12, t, 9.0, 0, no)


def test_pages_to_chunks(spark):
    grid = (50.0, 300.0, 300.0, 400.0, [["Bit", "Name"], ["0", "ready"], [None, "busy"], ["i", None]])
    pages = [
        ("x-B51.pdf", "5.1", 1, 600.0, 800.0, [text(100, "Contents of it")], [], [], []),
        ("x-B51.pdf", "5.1", 2, 600.0, 800.0, [text(10, "running header"), text(100, "1 Bus"), text(120, "The bus is wide."), text(305, "inside the table"), text(500, "Table 4 - Status bits of it"), text(520, "1.1 Lines"), text(540, "There are eight lines.")], [], [], [grid]),
        ("x-B51.pdf", "5.1", 3, 600.0, 800.0, [text(100, "and they go on here."), text(350, "clk"), text(460, "Figure 2 - Timing of the bus")], [(40.0, 300.0, 400.0, 440.0, 50400.0, 9)], [], []),
        ("x-B51.pdf", "5.1", 4, 600.0, 800.0, [text(100, "CMD: a command of the bus"), text(130, "HPI: high priority interrupt")], [], [], []),
    ]
    toc = [("x-B51.pdf", 0, 1, "1 Bus", 2), ("x-B51.pdf", 1, 2, "1.1 Lines", 2), ("x-B51.pdf", 2, 1, "2 Terms", 4)]
    got = ingest(spark.createDataFrame(pages, PAGE), spark.createDataFrame(toc, TOC)).orderBy("content_type", "page_start", "chunk_index").collect()
    by = lambda k: [r for r in got if r.content_type == k]
    assert [(r.term, r.section_path) for r in by("definition")] == [("CMD", ["2"]), ("HPI", ["2"])]
    assert by("figure")[0].raw_text == "[Figure: Figure 2 - Timing of the bus]\nclk"
    tables = sorted(by("table"), key=lambda r: r.is_row_chunk)
    assert tables[0].raw_text == "| Bit | Name |\n| --- | ---- |\n| 0 | ready |\n| 0 | busy |" and tables[0].figure_caption == "Table 4 - Status bits of it"
    assert tables[1].parent_chunk_id == tables[0].chunk_id and tables[1].raw_text.startswith("**Register Context: Table 4")
    texts = sorted(by("text"), key=lambda r: (r.page_start, r.chunk_index))
    assert any("eight lines.\nand they go on" in r.raw_text for r in texts) and not any("running header" in r.raw_text or "inside the table" in r.raw_text for r in texts)
    assert all(r.text.startswith("[eMMC 5.1 | ") for r in got) and len({r.chunk_id for r in got}) == len(got)
    assert any(r.is_front_matter and r.page_start == 1 for r in texts)
