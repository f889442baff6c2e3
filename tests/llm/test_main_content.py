import random

from corvath.llm import main_content as mc


def site(domain, n, seed):
    rng = random.Random(seed)
    pages = []
    for i in range(n):
        title = f"{rng.choice(['How', 'Why'])} {rng.choice('Ann Bob Cid'.split())} moved {rng.randint(1, 900)} boxes {i}"
        top = [f"Home | News | About {domain}", "We use cookies on this site."] if rng.random() < 0.8 else ["We use cookies on this site."]
        lines, noise = [], []

        def put(text, bad):
            lines.append(text)
            if bad:
                noise.append(len(lines))

        for t in top:
            put(t, True)
        put("", False)
        put(title, False)
        put(f"Written by {rng.choice(['Mia Oak', 'Tom Elm', 'Jo Ash'])}", True)
        put("", False)
        word = lambda: "".join(rng.choice("aeioustrn") for _ in range(7))
        for _ in range(rng.randint(1, 3)):
            put(f"The {word()} tells of {rng.randint(0, 10**6)} {word()} that {word()} never did.", False)
            put("", False)
            if rng.random() < 0.5:
                put("SHARE THIS PAGE" if rng.random() < 0.3 else "Share this  page", True)
                put("", False)
        put(f"Chapter {word()}", False)
        put("", False)
        put("Most read", True)
        for _ in range(2):
            put(f"The {rng.choice('red blue old'.split())} {''.join(rng.choice('aeioust') for _ in range(9))}", True)
        put("", False)
        put(f"Copyright {rng.randint(1990, 2024)} {domain}", True)
        pages.append((f"{domain}-{i}", title, "\n".join(lines), noise))
    return pages


def frames(spark, pages):
    documents = spark.createDataFrame([(d, t, "web", x) for d, t, x, _ in pages] + [("nul", "t", "web", None), ("note", "t", "note", "We use cookies on this site."), (None, "t", "web", "x"), ("empty", None, "web", ""), ("alone", "t", "web", "One line.")], "id string, title string, source_type string, raw_content string")
    sites = spark.createDataFrame([(d, d.rpartition("-")[0]) for d, *_ in pages] + [("empty", "a.x"), (pages[0][0], "zz")], "document_id string, domain string")
    return documents, sites


def test_noise_of_two_sites(spark, monkeypatch):
    pages = site("a.x", 60, 1) + site("b.y", 25, 2)
    documents, sites = frames(spark, pages)
    for size in (1000, 20):  # one group for each host, or several
        monkeypatch.setattr(mc, "GROUP_PAGES", size)
        out, wrappers = mc.extract(documents, sites)
        got = {r.document_id: r for r in out.collect()}
        assert set(got) == {d for d, *_ in pages} | {"empty", "alone"}
        for d, title, text, noise in pages:
            assert list(got[d].noise) == noise, (text, list(got[d].noise), noise)
            assert got[d].article.startswith(title)
        assert got["empty"].article == "" and got["alone"].article == "One line."
    heads = [r for r in wrappers.collect() if r.list_head]
    assert len(heads) == 2 and all(r.present == r.pages - (r.host == "a.x") for r in heads)


def test_slots_of_varying_lines_between_constants(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(8))
    pages = []
    for i in range(40):
        title = f"Report {word()} {word()}"
        body = [f"The {word()} tells of {word()} and {word()}.", "", f"Chapter {word()}"]
        related = ["Related pages", ""] + [f"The {word()} of {word()}" for _ in range(3)] + ["", "Subscribe to our letter"]
        lines = ["Home | News | About", "", title, "", *body, "", *related, *([] if i % 4 else ["", "Legal notice"])]
        start = lines.index("Related pages")
        noise = [1] + [k + 1 for k, x in enumerate(lines) if k >= start and x]
        pages.append((f"c.z-{i}", title, "\n".join(lines), noise))
    got = {r.document_id: list(r.noise) for r in mc.extract(*frames(spark, pages))[0].collect()}
    assert all(got[d] == noise for d, _, _, noise in pages)
    # the order that the alignment finds decides: the same tokens, united as a set, don't part the slots
    united = {r.document_id: list(r.noise) for r in mc.extract(*frames(spark, pages), aligned=lambda wrapper, stream: sorted({*wrapper, *stream} - {1}))[0].collect()}
    assert united != got


def test_align_makes_optionals():
    assert mc.align([5, 1, 7], [5, 6, 1, 7]) == [5, 6, 1, 7]
    assert mc.align([], [5, 1]) == [5, 1]


def test_empty(spark):
    documents, sites = frames(spark, site("a.x", 1, 1))
    out, wrappers = mc.extract(documents.limit(0), sites.limit(0))
    assert out.count() == 0 and wrappers.count() == 0
