from __future__ import annotations

from tessella.llm.scan_repair import Unit, head_key, page_form, repair_scans, roman, skeleton

CORPUS = ["the manifold kept its northern ticket while the salinity policy covered a well-sealed reading and a manual", "the observation was temporary and the well-sealed archive exceeded the agreed window", "Open points were listed and the committee revised the permanent catalogue before the deep-water survey"]


def test_forms_of_page_numbers():
    assert page_form("Page 3 of 9") == ("of", 3, "") and page_form("- 7 -") == ("dashed", 7, "") and page_form("[l2]") == ("boxed", 12, "")
    assert page_form("NOTES, ULM   31") == ("text_page", 31, "NOTES, ULM") and page_form("12 | Deep log") == ("bar_text", 12, "Deep log")
    assert page_form("the log showed 31") is None and page_form("") is None and roman("xiv") == 14
    assert skeleton("po1icy") == skeleton("policy") and skeleton("rnanual") == skeleton("manual")


def pages(n, head="Deep salinity policy, Ulm", foot="- {} -"):
    out = []
    for p in range(n):
        out += [head if p != 1 else head.replace("i", "1"), *[f"body line {p} {k} of the manual" for k in range(8)], "", foot.format(p + 4), ""]
    return out


def test_furniture_without_known_pages():
    lines = pages(4)
    unit = Unit(lines, [None] * len(lines))
    unit.find_furniture(set())
    assert {lines[i] for i in unit.furniture} == {x for x in lines if x.startswith("Deep") or x.startswith("-") or "sal1n1ty" in x or "pol1cy" in x}


def test_lists_of_numbers_are_no_page_numbers():
    lines = ["Readings taken in order:", "4", "5", "6", "", *["a body line here"] * 9]
    unit = Unit(lines, [None] * len(lines))
    unit.find_furniture(set())
    assert not unit.furniture


def run(frame, text, blocks=()):
    pdfs = frame([(1, text), (1, text), (2, None), (3, "")], "doc_id bigint, text string", "unit", "parts")
    rows = frame(list(blocks), "block_id string, doc_id bigint, block_index bigint, page_number bigint, text string")
    got = repair_scans(pdfs, rows, frame([(t,) for t in CORPUS], "text string")).collect()
    return {(r.source_table, x.record_id, x.line_no, x.defect) for r in got for x in r.defects}, {r.source_table: list(r.paragraphs) for r in got if r.paragraphs}


def test_cut_and_misread_words(frame):
    text = "the man-\nifold kept its northcrn ticket\nand a well-\nsealed reading of the tempo rary\nsalin¬\nity policy"
    found, paragraphs = run(frame, text)
    assert {(line, d) for _, _, line, d in found} == {(0, "broken_word"), (1, "misread"), (3, "misread"), (4, "broken_word")}
    assert paragraphs["parsed_pdfs"] == ["the manifold kept its northern ticket and a well-sealed reading of the temporary salinity policy"]


def test_words_cut_between_blocks_and_pages(frame):
    blocks = [("b0", 7, 0, 1, "the perma-"), ("b1", 7, 1, 1, "Page 1 of 2"), ("b2", 7, 2, 2, "nent catalogue"), ("b2", 7, 2, 2, "nent catalogue"), ("b3", 7, 3, 2, None), ("b4", 7, 4, 2, "Page 2 of 2")]
    found, paragraphs = run(frame, "", blocks)
    assert found == {("document_blocks", "b0", 0, "broken_word"), ("document_blocks", "b1", 0, "furniture"), ("document_blocks", "b4", 0, "furniture")}
    assert paragraphs["document_blocks"] == ["the permanent catalogue"]


def test_empty_tables(frame):
    none = frame([], "doc_id bigint, text string")
    assert repair_scans(none, frame([], "block_id string, doc_id bigint, block_index bigint, page_number bigint, text string"), frame([], "text string")).count() == 0


def test_heads_that_many_files_share():
    """A company's name at every page edge is furniture however many files have it; a shared heading isn't."""
    head, heading = "Confidential - Ulm Works", "Limits of use"
    common = {head_key(head), head_key(heading)}
    texts, known = [], []
    for p in range(6):
        page = [head, *[heading] * (p in (1, 2)), *[f"body line {p} {k} of the manual" for k in range(8)]]
        texts, known = texts + page, known + [p] * len(page)
    paged = Unit(texts, known)
    paged.find_furniture(common)
    assert [texts[i] for i in sorted(paged.furniture)] == [head] * 6
    numbered = [x for p in range(4) for x in (head, *[f"body line {p} {k} of the manual" for k in range(4)], heading, "more of the body here", "and the last line", f"- {p + 1} -", "")]
    bare = [x for p in range(5) for x in (head, *[f"body line {p} {k} of the manual" for k in range(9)])]
    for lines, n in ((numbered, 8), (bare, 5)):
        unit = Unit(lines, [None] * len(lines))
        unit.find_furniture(common)
        assert {lines[i] for i in unit.furniture} >= {head} and heading not in {lines[i] for i in unit.furniture} and len(unit.furniture) == n


def test_a_shared_head_goes_from_every_file(frame):
    head = "Annual Report of Ulm Works"
    blocks = [(f"{d}-{p}-{k}", d, 10 * p + k, p, t) for d in range(3, 15) for p in range(1, 5) for k, t in enumerate((head, f"the log of file {d} opened on sheet {p}", "and the manual kept its reading"))]
    found, paragraphs = run(frame, "", blocks)
    assert {r for _, r, _, d in found if d == "furniture"} == {b for b, *_, t in blocks if t == head}
    assert not any(head in p for p in paragraphs["document_blocks"])


def furniture(pages_of_lines, known=False):
    lines = [(p, t) for p, page in enumerate(pages_of_lines, 1) for t in page]
    unit = Unit([t for _, t in lines], [p if known else None for p, _ in lines])
    unit.find_furniture(set())
    return [unit.texts[i] for i in sorted(unit.furniture)]


def page(p, *foot, n=12):
    return [*[f"body line {p} {k} of the manual" for k in range(n)], *foot, ""]


def test_numbers_on_both_sides_of_unread_ones():
    for read in ((1, 2, 5, 6, 7), (1, 2, 3, 8, 9, 10, 14)):
        got = furniture([page(p, *([str(p)] if p in read else []), n=12 + p % 3) for p in range(1, 15)])
        assert got == [str(p) for p in read]
    assert furniture([page(p, *([f"{p} | Deep log"] if p in (2, 4, 8, 10, 12) else []), n=12) for p in range(1, 13)]) == [f"{p} | Deep log" for p in (2, 4, 8, 10, 12)]
    # far numbers out of proportion to their distance are none of pages
    lone = [page(p, *([str(p)] if p < 4 else []), n=12) for p in range(1, 8)]
    lone[5].insert(6, "940")
    assert furniture(lone) == ["1", "2", "3"]


def test_numbers_that_restart_in_a_part():
    numbers = [*range(1, 8), *range(1, 5), *range(1, 4)]
    for known in (False, True):
        assert furniture([page(p, str(n)) for p, n in enumerate(numbers, 1)], known) == [str(n) for n in numbers]


def test_heads_that_change_by_chapter():
    heads = ["Deep salinity policy", "Northern ticket archive", "Committee of the survey", "Permanent catalogue", "Warm manifold reading"]
    paged = [[heads[p // 8], *[f"body line {p} {k} of the manual" for k in range(8)]] for p in range(40)]
    assert furniture(paged, True) == [heads[p // 8] for p in range(40)]
    # headings far apart are none, nor is one that stands at another edge
    for far in ({3: 0, 20: 0}, {3: 0, 4: 9}):
        lines = [[f"body line {p} {k} of the manual" for k in range(9)] for p in range(40)]
        for p, at in far.items():
            lines[p].insert(at, "Open points")
        assert furniture(lines, True) == []


def test_heads_and_text_over_the_cut_into_stretches(frame):
    """A file of 256 pages, of which the last is a stretch of its own, and a head that starts on the page before a cut."""
    blocks = [(f"{p}-{k}", 7, 2 * p + k, p, t) for p in range(1, 257) for k, t in enumerate(("Deep salinity policy" if p < 255 or p == 256 else "Deep salinity p0licy", f"the log of sheet {p} opened"))]
    found, _ = run(frame, "", blocks)
    assert {r for _, r, _, d in found if d == "furniture"} == {f"{p}-0" for p in range(1, 257)}
    other = [(f"{p}-{k}", 8, 2 * p + k, p, t) for p in range(200, 262) for k, t in enumerate(("Deep salinity policy" if p < 255 else "Northern ticket archive", f"the log of sheet {p} opened"))]
    pdfs = frame([], "doc_id bigint, text string")
    rows = repair_scans(pdfs, frame(other, "block_id string, doc_id bigint, block_index bigint, page_number bigint, text string"), frame([(t,) for t in CORPUS], "text string")).collect()
    assert {x.record_id for r in rows for x in r.defects if x.defect == "furniture"} == {f"{p}-0" for p in range(200, 262)}
    text = " ".join(x for r in rows for x in r.paragraphs)
    assert [text.count(f"sheet {p} opened") for p in range(200, 262) if p != 256] == [1] * 61
