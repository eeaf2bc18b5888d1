"""Wrongly decoded text: round trips and clean texts left alone."""

import random

import pytest

from caselode.llm.mojibake import character_model, explaining, fewest_pairs, garbled_texts, learn_transformations, read_back, repair_text, twin_keys, utf8_lines

CLEAN = {
    "de": ["Die Überprüfung ergab {n} Treffer für die größte Akte.", "Größe und Schlüssel wurden gründlich geprüft, schöne Grüße aus dem Büro Nr. {n}."],
    "fr": ["Le scellé no {n} a été vérifié dès l’arrivée du colis à Noël.", "La société a copié {n} pièces récupérées après la pause."],
    "es": ["¿Quién abrió la cápsula {n}? El técnico comparó el buzón según la señal.", "El almacén quedó vacío y la compañía añadió {n} imágenes."],
    "ru": ["Проф. Berg опечатала {n} записей, потому что журнал был проверен.", "Ночная смена вернула около {n} снимков."],
    "ja": ["受付は証拠袋{n}番を開きましたが、封印を再確認します。", "担当者は「作業を止めてください。」と{n}回言いました。"],
    "zh": ["取证小组真的登记了{n}条聊天记录吗？镜像文件没有变化。", "夜班人员午饭之前封存了第{n}号证物袋。"],
    "en": ["The tag on the image reads “No. {n}”, and that was that.", "Plain ASCII line number {n}."],
}
LEGIT = ["☃ ✓ {n} → 14 🔒 plan.db", "Σ = {n} ± 47 µm, Θ ≈ 51°", "│ AÇÃO │ SÃO BRAZ │ {n} € │", "ﾌｧｲﾙ {n}", "ÜBER © {n} ®", "À: Berg {n}"]
WRONG = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "cp1252"), ("es", "cp1252", "cp1251"), ("de", "cp1252", "cp437"), ("ru", "cp1251", "koi8-r"), ("ru", "koi8-r", "cp1251"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("zh", "gbk", "cp1252"), ("ja", "utf-8", "cp1252"), ("en", "utf-8", "cp1252")]


def wrong(text, written_in, read_as):
    out = []
    for b in text.encode(written_in):
        try:
            out.append(bytes([b]).decode(read_as))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.fixture(scope="module")
def result(spark):
    rng, rows, truth = random.Random(4), [], {}
    for i in range(1500):
        if i % 10 == 0:
            text = rng.choice(LEGIT).format(n=rng.randint(1, 999))
        else:
            text = "\n".join(t.format(n=rng.randint(1, 9999)) for t in rng.choice(list(CLEAN.values())))
        rows.append((i, text, "clash"))
    for k in range(220):
        lang, a, b = WRONG[k % len(WRONG)]
        line = CLEAN[lang][0].format(n=rng.randint(1, 9999))
        clean = f"Plain first line {k}.\n{line}\nlast"
        rows.append((5000 + k, f"Plain first line {k}.\n{wrong(line, a, b)}\nlast", "clash"))
        truth[5000 + k] = clean
    twice = CLEAN["fr"][0].format(n=7)
    rows += [(6000, wrong(wrong(twice, "utf-8", "cp1252"), "utf-8", "cp1252"), ""), (6001, "Das d�rfte gen�gen!", ""), (6002, "The clerk left.".encode("utf-16-be").decode("utf-16-le"), "")]
    truth |= {6000: twice, 6001: "Das d�rfte gen�gen!", 6002: "The clerk left."}
    rows += [(7000, None, ""), (7001, "", ""), (7002, "ascii " * 50_000, ""), (None, "Grüße", "")]
    df = spark.createDataFrame(rows, "item_id bigint, text string, repaired string")
    return {r["item_id"]: r for r in garbled_texts(df).collect()}, truth, df


def test_found(result):
    got, truth, _ = result
    assert len(set(got) & set(truth)) >= 0.97 * len(truth)
    assert set(got) <= set(truth)


def test_repaired(result):
    got, truth, _ = result
    right = [got[i]["repaired"] == t for i, t in truth.items() if i in got]
    assert sum(right) >= 0.97 * len(right)
    assert not got[6001]["recovered"] and got[6000]["recovered"]


def test_learned_transformations_find_most(result):
    _, truth, df = result
    got = {r["item_id"]: r["repaired"] for r in garbled_texts(df, others=False).collect()}
    # swapped bytes leave no ASCII character to join on, so no twin can show them
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.9 * len(truth)
    texts = df.select("text").where("text is not null")
    learned = learn_transformations(texts, character_model(texts))
    assert {("cp1252", "utf-8"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1252", "gbk")} <= learned and len(learned) <= 14


def test_twins():
    clean, garbled = "Größe {} geprüft.", wrong("Größe {} geprüft.", "utf-8", "cp1252")
    assert twin_keys(garbled.format(17))[0] == twin_keys(clean.format(3))[1] != twin_keys(clean.format(3))[0]
    assert ("cp1252", "utf-8") in explaining(garbled.format(17), clean.format(3))
    assert explaining(clean.format(1), clean.format(2)) == [] == explaining("a ö b", "a ü b")
    a, b, c = ("cp1252", "utf-8"), ("iso8859-15", "utf-8"), ("cp1251", "koi8-r")
    assert fewest_pairs({(a, b): 9, (a,): 1, (c,): 2}, 3) == {a} and fewest_pairs({}, 3) == frozenset()


def test_empty(spark):
    assert garbled_texts(spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_read_back():
    assert read_back("GrÃ¶ÃŸe", "cp1252", "utf-8") == "Größe"
    assert read_back("Größe", "cp1252", "utf-8") is None
    assert utf8_lines("GrÃ¶ÃŸe\nGröße\nx") == "Größe\nGröße\nx"


def test_frequent_garbling_is_read_back(spark):
    rng = random.Random(5)
    ru = [t.format(n=n) for n in range(300) for t in CLEAN["ru"]]
    bad = [wrong(rng.choice(ru), "koi8-r", "cp1251") for _ in range(400)]
    model = character_model(spark.createDataFrame([(t,) for t in ru + bad], "text string"))
    good = CLEAN["ru"][0].format(n=12345)
    text = wrong(good, "koi8-r", "cp1251")
    assert model.score(text) > -7.5  # likely by itself
    assert repair_text(text, model, frozenset({("cp1251", "koi8-r")})) == (good, True)
    assert repair_text(text, model, frozenset()) == (text, False)  # only what is learned finds it
