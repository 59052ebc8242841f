from hypothesis import given
from hypothesis import strategies as st

from parchment.functions import text as T


def test_headings_start_passages_and_keep_their_trail():
    text = "# One\n" + "word " * 60 + "\n## Two\n" + "more " * 60 + "\n"
    got = T.split_passages(text)
    assert [p[1] for p in got] == ["One", "One > Two"]
    assert all(text[a:b] == c for _, _, c, a, b in got)


@given(st.text(alphabet="ab #\n.", max_size=400))
def test_passages_cover_all_words(text):
    got = T.split_passages(text, target=40, longest=80, shortest=10)
    assert "".join("".join(p[2].split()) for p in got) == "".join(text.split())
    assert all(text[a:b] == c and b - a <= 80 for _, _, c, a, b in got)


def test_quotes_are_found_exactly_then_leniently():
    text = "He said: “the *first*   motion was carried by the whole house” and left."
    assert T.find_quote(text, "the whole house") == (text.index("the whole"), text.index("the whole") + 15)
    a, b = T.find_quote(text, 'the first motion was carried by the whole house"')
    assert text[a:b].startswith("the *first*")
    assert T.find_quote("no no", "no") is None
    assert T.find_quote("abc", " ") is None


def test_citations_are_checked_and_renumbered():
    quotes = [("a", "alpha text"), ("b", "missing"), ("a", "beta text")]
    out, kept, rejected = T.renumber_citations("X [3], y [2] and z [1] [3].", quotes, {"a": "alpha text and beta text", "b": ""})
    assert (out, kept, rejected) == ("X [1], y and z [2] [1].", [2, 0], 1)


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_diffs_rebuild_both_sides(a, b):
    got = T.line_diff("\n".join(a), "\n".join(b))
    before = [x for kind, lines in got["ops"] if kind != "add" for x in lines]
    after = [x for kind, lines in got["ops"] if kind != "remove" for x in lines]
    assert "\n".join(before) == "\n".join(a) and "\n".join(after) == "\n".join(b)


def test_large_diffs_are_coarse():
    assert T.line_diff("a\nb\nc", "d\ne\nf", cells=4)["coarse"]


def test_names_cells_and_tabs():
    assert T.name_key("  José-Luis  O'Brien 3") == "jose luis o brien"
    assert T.parse_csv_line('a, "b ""q"", c" ,d') == ["a", 'b "q", c', "d"]
    assert T.workbook_sheets("a,b\n1,2\n\fSecond\nc") == [("", "a,b\n1,2"), ("Second", "c")]
