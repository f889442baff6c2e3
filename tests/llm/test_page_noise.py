from hypothesis import given, settings
from hypothesis import strategies as st

from corvath.llm import page_noise as pn


def distance(a, b):
    """Edits, two characters for one and one for two."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, old = [i], rows[-1]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y), old[j - 2] + 1 if j > 1 else 99, rows[-2][j - 1] + 1 if i > 1 else 99))
        rows.append(row)
    return rows[-1][-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=25, unique=True), st.text("abc", min_size=1, max_size=6))
def test_retrieval_is_complete(words, query):
    found = dict(pn.Trie((w, 1) for w in words).near(query))
    assert set(found) == {w for w in words if distance(w, query) <= pn.MAX_ERRORS}


def test_confusions():
    assert pn.confusions("month", "montb") == ["h>b"]
    assert pn.confusions("most", "rnost") == ["m>rn"]
    assert pn.confusions("every", "cvcry") == ["e>c", "e>c"]
    assert pn.confusions("page", "pages") is None


CLEAN = [f"the editor reads every document of the month and the well-known index holds {w} records" for w in ("many", "few", "old", "new")] * 3
PAGES = [
    (["d1"], 0, [3, 4], "p. 3\nReport on Old Maps\nThe editor reads every docu-\nment of the rnonth and the well-\nknown index.\n\n12\n99\n40\n"),
    (["d1"], 1, [5], "Report on Old Maps   [5]\nThe index holds many rec­\n\nords. He had 5 of them."),
    (["d2"], 0, None, "The editor reads 1234 documents.\nKelvor reads it."),
    (["d3"], 0, None, "The docurnent holds rnany records."),  # a confusion counts where three words show it
]


def tables(spark):
    documents = [(f"n{i}", "note", "text/plain", t) for i, t in enumerate(CLEAN)] + [("d1", "Report on Old Maps", "application/pdf", None), ("d2", "x", "application/pdf", ""), ("d3", "y", "application/pdf", ""), (None, None, None, None)]
    chunks = [(f"{d[0]}-{i}", d[0], i, t, (p,)) for d, i, p, t in PAGES] + [("d1-0", "d1", 0, PAGES[0][3], ([3, 4],)), ("null", "d2", 1, None, None), ("none", "n1", 0, "p. 1\nrnonth", None)]
    return (
        spark.createDataFrame(documents, "id string, title string, mime_type string, raw_content string"),
        spark.createDataFrame(chunks, "id string, document_id string, chunk_index int, content string, location_meta struct<pages: array<int>>"),
    )


def test_noise_and_reflow(spark):
    noise, pages, _ = pn.page_noise(*tables(spark))
    got = {(r.chunk_id, r.noise, r.right) for r in noise.collect()}
    assert {x[:2] for x in got} == {("d1-0", "hyphenation"), ("d1-0", "misread"), ("d1-0", "running_header"), ("d1-0", "page_number"), ("d1-1", "running_header"), ("d1-1", "page_number"), ("d1-1", "hyphenation"), ("d3-0", "misread")}
    assert ("d1-0", "misread", "month") in got and ("d1-0", "hyphenation", "document") in got
    clean = {r.chunk_id: r for r in pn.cleaned(noise, pages).collect()}
    assert clean["d1-0"].content.startswith("The editor reads every document of the month and the well-known index.")
    assert clean["d1-1"].content == "The index holds many records. He had 5 of them."
    assert clean["d2-0"].content == "The editor reads 1234 documents. Kelvor reads it." and clean["d2-0"].noises == []
    assert clean["d3-0"].content == "The document holds many records."
    assert set(clean) == {"d1-0", "d1-1", "d2-0", "d3-0"}


def test_empty(spark):
    documents, chunks = tables(spark)
    noise, pages, _ = pn.page_noise(documents.limit(0), chunks.limit(0))
    assert noise.count() == 0 and pn.cleaned(noise, pages).count() == 0


def test_headers_of_any_length_and_script():
    for header in ("年度报告", "التقرير", "acta", "IR", "notes on x"):
        texts = [f"{header}\n\nWhat page {'a' * k} says.\nIt goes on {'b' * k}.\n\n{header}\n\nAnd then {'c' * k} ends.\nSo it is {'d' * k}." for k in range(1, 5)]
        assert pn.repeats_of(texts) == [header]
        assert pn.Headers(None, [header], []).match(header)
    assert pn.Headers("Acta.pdf", [], []).match("ACTA") and not pn.Headers("Acta.pdf", [], []).match("Actas")
    overlap = ["one two\nthree\n\nshared", "shared\n\nfour\nfive"]
    assert pn.repeats_of(overlap) == []


def test_page_number_beside_an_unknown_header():
    lines = ["So it ended.", "", "12   Unknown head", "", "It went on."]
    headers = pn.Headers("Another title of it", [], [])
    assert pn.furniture(lines, [12], headers)[2] == (False, True)
    assert pn.furniture(lines, [13], headers)[2] == (False, False)
    assert "Unknown head" in pn.reflow("\n".join(lines), [12], headers, None, None, set(), {}) and "12" not in pn.reflow("\n".join(lines), [12], headers, None, None, set(), {})


def test_context_decides_at_each_occurrence(spark):
    clean = ["the bear found a bottle in the basket at the border"] * 9 + ["they hear a handle and a helmet fall in the harbor"] * 9
    documents = [(f"n{i}", "note", "text/plain", t) for i, t in enumerate(clean)] + [("d1", "a", "application/pdf", None)]
    chunks = [("c", "d1", 0, "The dear found a dottle, a dasket and a dorder; they dear a dandle, a delmet and a darbor.", None)]
    noise, pages, _ = pn.page_noise(
        spark.createDataFrame(documents, "id string, title string, mime_type string, raw_content string"),
        spark.createDataFrame(chunks, "id string, document_id string, chunk_index int, content string, location_meta struct<pages: array<int>>"),
    )
    assert {(r.before, r.right) for r in noise.where("form = 'dear'").collect()} == {("the", "bear"), ("they", "hear")}
    assert pn.cleaned(noise, pages).first().content == "The bear found a bottle, a basket and a border; they hear a handle, a helmet and a harbor."


def test_roman_page_numbers():
    lines = ["The preface goes", "", "xiv", "", "on to mix", "i) one"]
    assert [n for _, n in pn.furniture(lines, [3], pn.Headers("T", [], []))] == [False, False, True, False, False, False]
    assert not pn.marker("mix", [3]) and not pn.marker("", [3])
