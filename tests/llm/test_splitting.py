from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import splitting as S


def check(text, limit, overlap):
    parts = S.split(text, limit, overlap)
    assert parts[0][0] == parts[0][1] == 0 and parts[-1][2] == len(text)
    for (a, b, c), (d, e, f) in zip(parts, parts[1:]):
        assert e == c and a <= d <= e < f
        assert e - d <= overlap
        # less overlap only to start at a boundary, which has white space, a line end or a sentence end before it
        if e - d < min(overlap, c - a):
            assert text[d - 1].isspace() or text[d - 1] in "\f.!?…。!?”’」』);:,,;:、"
    assert all(c - a <= limit for a, _, c in parts)
    assert "".join(text[b:c] for _, b, c in parts) == text
    return parts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword ", "Sentence end. ", "\n", "\n\n", "# head\n", "## sub\n", "- item\n", "中文句子。", "x" * 70, "a, ", "\f", "é́", "```\ncode\n```\n"]), max_size=120))
def test_pieces_cover_the_text(words):
    check("".join(words), 120, 20)


def test_headings_stay_with_their_sections():
    text = "".join(f"# H{i}\n" + "Some words of a section. " * 12 + "\n" for i in range(8))
    for _, b, _ in check(text, 700, 50)[1:]:
        assert text[b:].startswith("# H")


def test_unbroken_text_is_cut_exactly():
    parts = check("x" * 5000, 2400, 200)
    assert [(b - a, c - a) for a, b, c in parts][:2] == [(0, 2400), (200, 2400)]


def test_combining_marks_stay():
    text = "é" * 3000
    assert all(text[b] != "́" for _, b, _ in check(text, 2400, 200))


def test_rows(spark):
    long = "Words of a text that goes on. " * 200
    rows = [(1, "p", "T", 3, 6, 9, long, "a", 1), (1, "p", "T", 3, 6, 9, long, "b", 1), (2, None, None, None, None, None, long, "a", 1), (3, "p", "T", 1, 1, 0, None, "a", 1), (4, "p", "T", 1, 1, 0, "x" * 2400, "a", 1), (5, "p", "T", 1, 1, 0, "😀" * 2401, "a", 1)]
    df = spark.createDataFrame(rows, "chunk_id bigint, paper_id string, section_title string, page_start bigint, page_end bigint, ord bigint, text string, indexed_at string, piece int")
    out = S.pieces(df).orderBy("chunk_id", "piece").collect()
    assert {r.chunk_id for r in out} == {1, 2, 5}
    one = [r for r in out if r.chunk_id == 1]
    assert [r.piece for r in one] == list(range(len(one))) and all(len(r.text) <= 2400 and r.ord == 9 and r.section_title == "T" for r in one)
    pages = [r.page_start for r in one]
    assert pages[0] == 3 and pages == sorted(pages) and pages[-1] <= 6
    assert "".join(r.text[r.own_start :] for r in one) == long
    assert all(r.page_start is None for r in out if r.chunk_id == 2)
    assert S.pieces(df.limit(0)).count() == 0
    assert {r.chunk_id for r in S.pieces(df, whole=True).collect()} == {1, 2, 4, 5}


def test_form_feeds_tell_the_page():
    assert S._page("a\fb\fc", 4, 5, 9) == 7 and S._page("a\fb", 2, 5, 5) == 5


def test_the_end_of_a_long_section_is_not_merged_with_the_next_one():
    text = "# A\n" + "Words of the long section go on here. " * 20 + "\n# B\nShort words of B.\n# C\nShort words of C.\n"
    parts = check(text, 400, 40)
    assert [text[b:] for _, b, _ in parts][-1].startswith("# B") and text[parts[-1][1] : parts[-1][2]].count("# ") == 2


def test_lists_are_nodes_and_their_inner_items_stay_with_them():
    items = "".join(f"- item {i} of the outer list\n  - inner {i} a\n  - inner {i} b\n" for i in range(8))
    text = "Some lines before the list.\nAnother line.\n" + items + "A line after the list.\n"
    for _, b, _ in check(text, 260, 0)[1:]:
        assert text[b:].startswith("- item") or text[b:].startswith("A line after")
