import random

import pytest

from corvath.llm import encodings as en

SENTENCES = (
    "Der Händler löscht die Übersicht — später prüft er das Gerät.|Le modèle décrit déjà l’écart ; la requête coûte 3 €.|El cálculo corrige la opinión según el índice, ¿por qué?"
    "|Запрос проверяет архив и заголовок — позже.|Сервер хранит черновик, список и журнал.|Książka śledzi źródło i późną wersję łącza.|At 20 °C the note says “recent weights”… it’s the page."
    "|A função contém o número e a coleção à noite.|検索の索引は毎朝、保存する文書を比較する。"
).split("|")
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp437")]


def spoil(text, true, read):
    table = {b: c for c, b in en.table_of(read).items() if read != "cp1252" or len(c.encode("cp1252", "ignore"))} if read != "latin-1" else {b: chr(b) for b in range(128, 256)}
    return "".join(table.get(b, chr(b)) for b in text.encode(true))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(600):
        language = rng.randrange(len(SENTENCES))
        lines = [" ".join(SENTENCES[language] for _ in range(rng.randint(1, 3))) for _ in range(4)]
        text, bad = "\n".join(lines), None
        if i % 12 == 0:
            true, read = rng.choice(WRONG)
            try:
                part = rng.choice([slice(0, 4), slice(1, 2)])
                spoiled = lines[:]
                spoiled[part] = [spoil(x, true, read) for x in lines[part]]
                if spoiled != lines:
                    bad = "\n".join(spoiled)
            except UnicodeEncodeError:
                pass
        rows.append(("document", f"d{i}", bad or text))
        if bad:
            truth[f"d{i}"] = text
    rows += [("document", "null", None), ("chunk", "empty", ""), ("chunk", "plain", "just ASCII ? text"), ("chunk", "lost", "le relev� r�p�te"), ("chunk", None, "caf�")]
    return rows, truth


def test_found_and_restored(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_kind string, record_id string, text string, run int")
    got = en.wrongly_decoded(df, en.learn(en.runs_by_source(df))).collect()
    found = {r.record_id: r for r in got}
    assert {None, "lost"} <= set(found)
    hits = set(found) - {None, "lost"}
    assert len(hits & set(truth)) >= 0.95 * len(truth) and len(hits - set(truth)) <= 0.05 * len(truth)
    exact = sum(found[k].restored == truth[k] for k in hits & set(truth))
    assert exact >= 0.9 * len(truth)
    assert found["lost"].lost_lines == 1 and found["lost"].restored == "le relev� r�p�te"


def test_empty(spark):
    df = spark.createDataFrame([], "record_kind string, record_id string, text string")
    assert en.wrongly_decoded(df, en.learn(en.runs_by_source(df))).count() == 0


def test_tables_turn_back():
    assert en.undo_utf8("Ã©tÃ© â€™", "cp1252") == "été ’"
    assert "Çàãîëîâîê".translate(en.single_swap("cp1252", "cp1251")) == "Заголовок"
    assert en.undo_wide("é", "cp1252", "shift_jis") == "é"


def test_a_source_with_an_unknown_cipher(spark):
    """Letters replaced as no code page does: only the mapping that is learned for the source brings them back."""
    rng = random.Random(11)
    special = sorted({c for x in SENTENCES[:3] for c in x if not c.isascii()})
    cipher = str.maketrans(dict(zip(special, rng.sample([chr(c) for c in range(0x2500, 0x2580)], len(special)))))
    rows, truth = [], {}
    for i in range(900):
        lines = "\n".join(" ".join(rng.sample(SENTENCES[rng.randrange(3)].split(), 4)) for _ in range(5))
        own = i % 15 == 0
        rows.append(("document", f"d{i}", lines.translate(cipher) if own else lines, "odd" if own else f"s{i % 7}"))
        if own and lines.translate(cipher) != lines:
            truth[f"d{i}"] = lines
    df = spark.createDataFrame(rows, "record_kind string, record_id string, text string, source string")
    runs = en.runs_by_source(df)
    model = en.learn(runs)
    learned = en.ciphers(runs, model)
    assert [r.source for r in learned.collect()] == ["odd"]
    got = {r.record_id: r.restored for r in en.wrongly_decoded(df, model, learned).collect()}
    assert sum(got.get(k) == v for k, v in truth.items()) >= 0.8 * len(truth) and len(set(got) - set(truth)) <= 0.01 * len(rows)
    without = {r.record_id: r.restored for r in en.wrongly_decoded(df, model).collect()}
    assert not sum(without.get(k) == v for k, v in truth.items())
