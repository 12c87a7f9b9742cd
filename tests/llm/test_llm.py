import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fakturnik.llm import abuse, addresses, boosting, encode, mojibake, names, packing, pii, scan_noise

PATH = encode.tokenizer_path()

# --- garbled text -------------------------------------------------------------------------------------

CLEAN = [
    "Prosimy o niezwłoczne uzupełnienie brakujących załączników do rozliczenia", "Wartość netto po korekcie pozostaje bez zmian, opóźnienie naliczone", "Zgłoszenie reklamacyjne złożono w dziale zakupów przed końcem miesiąca",
    "Różnica wynika z zaokrągleń podatku i nie przekracza pięć złotych", "Przesyłkę awizowano, adresat nie mieszka już pod adresem źródlana łąka", "Podpisano: kierownik działu, żółta teczka, świadectwo jakości części",
]


def test_undo_inverts_every_chain():
    word = "zażółćgęśląjaźń"
    for name, written, read, times in mojibake.CHAINS:
        table = {b: s for s, b in mojibake._bytes_of(read).items()}
        bad = word
        for _ in range(times):
            bad = "".join(table.get(b, chr(b)) for b in bad.encode(written, "replace"))
        if "?" not in bad:
            assert mojibake.undo(bad, written, read, times) == word, name
    assert mojibake.undo("São", "utf-8", "cp1252") is None


def pages(spark, texts):
    return spark.createDataFrame([(100 + i, 1, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, number int, text string, field string, word string")


def test_garbled_pages(spark):
    bad = [CLEAN[0].encode().decode("latin-1"), CLEAN[1].encode("cp1250").decode("cp1252"), "Wartość pomy�ki"]
    fine = ["Müller & Söhne GmbH", "São Lourenço – kawa", "znak ¶ i † w nawiasie", "cena ¼ ceny, 5 m³/h", None, "", "   "]
    df = pages(spark, CLEAN * 8 + fine * 3 + bad + [bad[0]])
    df = df.unionByName(df.filter("doc_id = 100"))
    none = spark.createDataFrame([], "doc_id bigint, text string")
    got = {r["doc_id"] for r in mojibake.found(df, none).collect()}
    start = 100 + 8 * len(CLEAN) + 3 * len(fine)
    assert got == {start, start + 1, start + 2, start + 3}
    fixed = {r["doc_id"]: r for r in mojibake.restore(df, none).collect()}
    assert fixed[start]["text"] == CLEAN[0] and fixed[start + 1]["text"] == CLEAN[1]
    assert not fixed[start + 2]["restorable"] and fixed[start]["restorable"]


def test_frequent_foreign_words_recruit_no_chain(spark):
    """A foreign word whose supposed inverse nobody writes stays, however many documents hold it and nothing else."""
    fine = ["Odbiorca Škoda Polska", "Odbiorca Müller & Söhne"] * 40
    df = pages(spark, CLEAN * 10 + fine + [CLEAN[0].encode().decode("cp1250", "replace")])
    none = spark.createDataFrame([], "doc_id bigint, text string, pdf_type string")
    got = {r["doc_id"] for r in mojibake.found(df, none).collect()}
    assert got == {100 + 10 * len(CLEAN) + len(fine)}


def test_garbled_letters_of_other_languages(spark):
    clean = ["Rechnung an Müller über größere Mengen", "élève à la française"]
    df = pages(spark, CLEAN * 4 + clean * 4 + [t.encode().decode("cp1252") for t in clean])
    none = spark.createDataFrame([], "doc_id bigint, text string")
    start = 100 + 4 * len(CLEAN) + 8
    fixed = {r["doc_id"]: r["text"] for r in mojibake.restore(df, none).collect()}
    assert fixed == {start: clean[0], start + 1: clean[1]}


def test_long_garbled_words_and_content_of_garbled_pages(spark):
    word = "niezwłoczneuzupełnienie" * 5
    garbled = word.encode().decode("cp1252")
    df = pages(spark, CLEAN * 4 + [garbled])
    own = 100 + 4 * len(CLEAN)
    contents = spark.createDataFrame([(100, CLEAN[0], "Text"), (own, f"dalej {garbled}\n\n{CLEAN[1]}", "Hybrid"), (None, None, None)], "doc_id bigint, text string, pdf_type string")
    assert {(r["doc_id"], r["number"]) for r in mojibake.found(df, contents).collect()} == {(own, 1), (own, 0)}


def test_garbled_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, number int, text string")
    assert mojibake.found(none, none).count() == 0


# --- personal data ------------------------------------------------------------------------------------


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, size=(600, 5)).astype(float)
    y = ((x[:, 0] == 1) & (x[:, 1] == 0)).astype(float)
    chance = boosting.fit(x, y, trees=20).chance(x)
    assert ((chance > 0.5) == y).mean() > 0.99


def test_held_out_spans():
    model = pii.model()
    x, y = pii.examples(400, seed=99)
    assert ((model.chance(x) > 0.5) == y).mean() > 0.93


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Prosimy o kontakt z Anną Kowalską... z Dorotą Zeticką, tel. 691-922-059.", {"person_name", "phone"}),
        ("Pisz na biuro (at) zimoge (kropka) example najpóźniej jutro.", {"email"}),
        ("Na prośbę Z. Robańskiej, 50020339754, dokumenty wydano.", {"person_name", "id_number"}),
        ("Siedziba i magazyn: ul. Papiernicza 82 lok. 11, 28-591 Świerkowo", {"address"}),
        ("Potwierdzenie zamówienia 669021612\nNIP: 748-222-57-05", set()),
        ("3 | krzesło model Jan | 17 | 134,87 | 709,67", set()),
        ("Prace przy ulicy Kolejowej zakończono zgodnie z harmonogramem", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_kinds(text, kinds):
    assert {k for k, _, _ in pii.select(text, pii.model())} == kinds


@pytest.mark.parametrize("name", ["Anna Nowak", "Dorota Wójcik", "A. Lis", "Robert Schmidt", "Nowak, Joanna", "Olga Lis-Wrona", "Oldze BugaĹ\x84skiej", "Tadeusza KiwoÃ…â€žskiego", "Iwona PasaĹ‚owska", "StanisĹ‚aw Nowak"])
def test_every_surname_is_a_candidate(name):
    text = f"Podpisano: {name}; dalej"
    assert ("person_name", 11, 11 + len(name)) in pii.candidates(text)


@pytest.mark.parametrize("name", ["Dorota Wójcik", "Robert Schmidt", "Oldze BugaĹ\x84skiej", "Tadeusza KiwoÃ…â€žskiego"])
def test_every_surname_is_judged(name):
    text = f"Rozmowę z {name} odnotowano w karcie."
    assert pii.redacted(text, pii.select(text, pii.model())) == "Rozmowę z [PERSON_NAME] odnotowano w karcie."


def test_recall_and_precision_of_held_out_spans():
    """Per kind over the thresholds chosen on other paragraphs; the sentences are the module's own, so this says little of other text."""
    model = pii.model()
    for wide in (0, 1):
        x, y = pii.examples(600, pii.MEASURING, wide=bool(wide))
        chance = model.chance(x)
        for k, kind in enumerate(pii.KINDS):
            own = (x[:, k] == 1) & (x[:, -1] == wide)
            if own.sum() > 50:
                hit, true = chance[own] > model.limit(kind, wide), y[own] > 0.5
                assert (hit & true).sum() / true.sum() > 0.8 and (hit & true).sum() / hit.sum() > 0.85, kind
    assert pii.least_errors(np.array([0.3, 0.55, 0.9]), np.array([0, 0, 1])) == 0.56


@pytest.mark.parametrize("text", ["Towar odebrano w miejscowości Klonowiska Wola bez zastrzeżeń", "Przyjęto w oddziale Dębiniska Wola"])
def test_towns_are_no_people(text):
    assert pii.select(text, pii.model()) == []


def test_long_words_are_candidates():
    surname = "Brzęczyszczykiewiczowskopodlasieckiewicz"
    assert ("person_name", 0, 5 + len(surname)) in pii.candidates(f"Anna {surname}") and ("address", 0, 4 + len(surname) + 2) in pii.candidates(f"ul. {surname} 7")


def test_redaction(spark):
    rows = spark.createDataFrame([(1, 1, "tel. 691-922-059 i dalej", "a"), (1, 1, "tel. 691-922-059 i dalej", "a"), (2, 1, None, "b"), (3, 1, "x " * 20000 + "biuro@a.example", "c")], "doc_id bigint, number int, text string, kinds string")
    got = {r["doc_id"]: r for r in pii.redact(rows, ["doc_id", "number"]).collect()}
    assert got[1]["text"] == "tel. [PHONE] i dalej" and got[2]["text"] is None and got[3]["kinds"] == ["email"] and got[3]["text"].endswith("[EMAIL]")
    assert pii.redact(rows.limit(0), ["doc_id"]).count() == 0


# --- scanned pages ------------------------------------------------------------------------------------


def test_furniture_by_place():
    text = ["Tekst pierwszy akapit", "31", "Razem: 5"]
    got = scan_noise.furniture([(1, ["Alfa S.A. | umowa dostawy   1", *text, "Strona 1 z 2"]), (2, ["Alfa S.A. | umowa dostavvy   2", *text, "- 2 -"]), (3, ["Lp. | Nazwa | Netto", *text])])
    assert got == [{0, 4}, {0, 4}, set()]


def test_furniture_without_a_sign_and_far_apart():
    text = ["Tekst pierwszy akapit", "Razem: 5"]
    pages = [(i, ["Raport kwartalny Beta", *text] if i % 2 else [f"Akapit {chr(96 + i)} bez nagłówka", *text]) for i in range(1, 6)]
    assert scan_noise.furniture(pages) == [{0} if i % 2 else set() for i in range(1, 6)]
    heading = "Spółdzielnia Pracy Wielobranżowa Konstantynopolitańczykowianeczka i Wspólnicy | rozliczenie kwartalne"
    far = [(i, [heading if i in (1, 9) else f"Akapit {chr(96 + i)}", *text]) for i in range(1, 10)]
    assert [i for i, gone in enumerate(scan_noise.furniture(far), 1) if 0 in gone] == [1, 9]
    assert scan_noise.furniture([(1, ["Zamówienie numer", *text]), (2, ["Zestawienie zbiorcze", *text])]) == [set(), set()]


def test_editor_joins_and_inserts():
    words = ["sprawdzono", "rozliczono", "dokumentacja", "zestawienie", "przekazano", "magazynie", "potwierdzenie", "zakończono", "uzupełniono", "dostarczono", "opłat", "nie"] * 3
    editor = scan_noise.train(words)
    assert all(editor.join_margin(*c) >= editor.join_limit for c in (("spraw", "-", "dzono"), ("rozli", "", "czono"), ("zesta", "¬", "wienie")))
    assert editor.join_margin("spraw", "-", "dzono") > editor.join_margin("nie", "", "Opłat")
    assert any(len(y) == 2 and y[0] == c for c, ys in editor.options.items() for y in ys)  # a sign kept with one inserted behind it


def test_long_words_are_edited():
    word = "konstantynopolitanczykowianeczkaprzedsiebiorstwo"
    editor = scan_noise.train([word])
    assert word in editor.proposals(word.replace("m", "rn", 1) if "m" in word else word.replace("d", "cl", 1)) and scan_noise.core(word + "x" * 60) != ""


def test_every_edit_is_proposed():
    editor, word = scan_noise.train(["uzgodniono", "rozdzielczą"]), "uzgoclniono"
    singles = {word[:at] + right + word[at + len(read) :] for right, read in scan_noise.CONFUSIONS for at in range(len(word)) if word.startswith(read, at)}
    pairs = {w[:at] + right + w[at + len(read) :] for w in ("uzgodniono",) for right, read in scan_noise.CONFUSIONS for at in range(5, len(w)) if w.startswith(read, at)}
    untrained = scan_noise.Editor()
    assert len(singles) > 8 and singles | pairs <= {*editor.proposals(word), word} and singles | pairs <= {*untrained.proposals(word), word}


def test_scan_cases(spark):
    clean = "Ponownie sprawdzono zaległą notę odsetkową w dziale zakupów bez dodatkowych opłat oraz numer dokumentu"
    ocr = [(i, 1, clean, None) for i in range(30)] + [(50, 1, "Ponownie spraw-\ndzono zaległą notę\nbez dodat\nkowych opłat", None), (51, 1, "w dzia1e zakupóvv bez opłat", None), (52, 1, "zdawczo-\nodbiorczy numer", None), (53, 1, None, None), (54, 1, "", None)]
    ocr += [(60 + i, 1, "protokół zdawczo-odbiorczy numer", None) for i in range(5)] + [(51, 1, "w dzia1e zakupóvv bez opłat", None)]
    o = spark.createDataFrame(ocr, "doc_id bigint, page_no int, text string, kind string")
    b = spark.createDataFrame([], "doc_id bigint, box_id int, page_no int, text string")
    e = spark.createDataFrame([(50, "Ponownie spraw-\ndzono", "image"), (51, None, "image")], "doc_id bigint, raw_text string, source_type string")
    got = {(r["record_table"], r["doc_id"], r["kind"]) for r in scan_noise.found(o, b, e).collect()}
    assert {("ocr_results", 50, "hyphenation"), ("extract_results", 50, "hyphenation"), ("ocr_results", 51, "misread")} <= got
    assert not any(d in (52, 53, 54) or d < 30 for _, d, _ in got)
    assert {("ocr_results", 51, 1, "misread")} <= {tuple(r) for r in scan_noise.found(o, b, e).select("record_table", "doc_id", "item", "kind").collect()}
    text = {(r["record_table"], r["doc_id"]): r["text"] for r in scan_noise.repaired(o, b, e).collect()}
    assert text["ocr_results", 50].startswith("Ponownie sprawdzono zaległą notę bez dodatkowych opłat")
    assert "dziale" in text["ocr_results", 51]


@pytest.mark.parametrize("step", [scan_noise.tokens, scan_noise.furniture_lines])
def test_a_worker_holds_few_words_of_a_large_batch(step):
    lines = [{"item": 1, "text": "Alfa S.A. | umowa dostawy   1"}, *({"item": 1, "text": f"zaległą notę odsetkową w dziale {i}"} for i in range(30)), {"item": 1, "text": "Strona 1 z 2"}]
    docs = [{"record_table": "ocr_results", "doc_id": i, "pages": [{"page": 1, "lines": lines}]} for i in range(2_000)]
    batch, peaks, rows = pa.RecordBatch.from_pylist(docs), [], []

    class Worker:
        """Stands in for a worker of Spark that is sent one batch."""

        def run(self, f, given):
            tracemalloc.start()
            for out in f(given):
                rows.append(len(out))
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

        mapInArrow = lambda self, f, schema: self.run(f, iter([batch]))  # noqa: E731, N815
        mapInPandas = lambda self, f, schema: self.run(f, (b.to_pandas() for b in [batch]))  # noqa: E731, N815

    step(Worker())
    assert sum(rows) == (360_000 if step is scan_noise.tokens else 4_000) and peaks[0] < 8e6


# --- names and addresses ------------------------------------------------------------------------------


def test_edit_distance():
    assert [names.distance(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abcd", "abxd"), ("abcdef", "xyzdef"))] == [0, 1, 1, 3]


def entity(spark, rows):
    df = spark.createDataFrame([(i, n, None, c, "clash") for i, (n, c) in enumerate(rows)], "party_id bigint, name string, nip string, city string, entity string")
    return {r["party_id"]: r["entity"] for r in names.classes(df.unionByName(df.limit(2))).collect()}


def test_variants_meet(spark):
    rows = [
        ("Firma Handlowa Detipulaze Sp. z o.o.", "A"), ("F.H. Detipulaze", None), ("DETIPULAZE SP Z OO - FH", None), ("Detipualze spółka z ograniczoną odpowiedzialnością", None),
        ("Biuro Rachunkowe Wotesumowe Chemia Sp.k.", None), ("B.R. Wotesumowe Chem. sp. k.", None), ("Biuro Rachunkowe Wotesumowe Tekstylia sp. k.", None),
        ("Agnieszka Gamoroziczak", "B"), ("Gamoroziczak, Aga", None), ("A. Gamoroziczak", None), ("Agniesska Gamorozizcak", None), ("Bartosz Gamoroziczak", None),
        (None, None), ("", None), ("n/d", None), ("brak", None),
    ]
    got = entity(spark, rows)
    same = lambda *ids: len({got[i] for i in ids}) == 1
    assert same(0, 1, 2, 3) and same(4, 5) and got[4] != got[6] and same(7, 8, 9, 10) and got[7] != got[11]
    assert not any(i in got for i in (12, 13, 14, 15))


def test_parts_in_any_order_meet(spark):
    rows = [
        ("Piotr Nowak", None), ("Nowak Piotr", None), ("P. Nowak", None), ("Apteka Zdrowie", None), ("Zdrowie Apteka", None), ("Zdrowie Aptekka", None), ("Kowal-Bud", None), ("Kowalbud", None),
        ("Apteka Radość", None), ("Wiktor Kmieć", None), ("Kmieć Wiktor", None), ("Karol Kmieć", None),
    ]
    got = entity(spark, rows)
    same = lambda *ids: len({got[i] for i in ids}) == 1
    assert same(0, 1, 2) and same(3, 4, 5) and same(6, 7) and same(9, 10) and len({got[i] for i in (0, 3, 6, 8, 9, 11)}) == 6


def test_long_names_are_indexed(spark):
    long = "przedsiebiorstwowielobranzowo" * 3
    rows = [(long, None)] * 3 + [(long[:30] + "x" + long[30:], None), (long[:80] + long[81:], None), (long[:40][::-1] + long[40:], None)]
    got = entity(spark, rows)
    assert got[0] == got[3] == got[4] != got[5]
    r = np.random.default_rng(2)
    for n in (39, 40, 41, 42, 60, 101):
        word = "".join(r.choice(list("abcdefg"), n))
        for _ in range(20):
            w = list(word)
            for _ in range(2):
                at = int(r.integers(0, len(w) - 1))
                kind = int(r.integers(0, 4))
                if kind == 0:
                    w[at] = "x"
                elif kind == 1:
                    del w[at]
                elif kind == 2:
                    w.insert(at, "y")
                else:
                    w[at], w[at + 1] = w[at + 1], w[at]
            assert names.deletions(word) & names.deletions("".join(w))


def test_token_assignment():
    assert names.tokens_apart("jan kowal", "kowal jan") == 0 and names.tokens_apart("apteka zdrowie", "zdrowie aptekka") == 1
    assert names.tokens_apart("kowal bud", "kowalbud") == 0 and names.tokens_apart("jan kowal", "jan mazur") == 3


def test_no_names(spark):
    none = spark.createDataFrame([], "party_id bigint, name string, nip string, city string")
    assert names.found(none).count() == 0


def test_places(spark):
    codes = spark.createDataFrame([("16-546", "Piaskostaw"), ("62-471", "Wilczęcin")], "postal_code string, city string")
    rows = [
        ("ul. prof. Bartosza Badeczaka 35A", "62-471", "Wilczęcin", None), ("ULICA B. BADECZAKA 35 a", None, "WILCZECIN", None), (None, None, None, "62-471 Wilczęcin; ul. Badeczaka 35A, Polska"), ("Badeczka 35A", "62471", None, None),
        ("ul. prof. Bartosza Badeczaka 35A/2", "62-471", "Wilczęcin", None), ("ul. prof. Bartosza Badeczaka 35A", None, "Piaskostaw", None), (None, None, None, "Badeczaka 35A m. 2 Wilczęcin"),
        (None, None, None, "brak adresu"), (None, None, None, None), ("ul. Lipowa", "62-471", None, None),
    ] + [("ul. Badeczaka 7", "62-471", None, None)] * 3
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "addr_id bigint, street string, postal_code string, city string, raw string, place string")
    got = {r["addr_id"]: r["place"] for r in addresses.places(df.unionByName(df.limit(1)), codes).collect()}
    assert got[0] == got[1] == got[2] == got[3] and got[4] == got[6] != got[0] and got[5] != got[0]
    assert not any(i in got for i in (7, 8, 9))
    pairs = {(r[0], r[1]) for r in addresses.found(df, codes).collect()}
    assert {(0, 1), (0, 2), (1, 2), (4, 6)} <= pairs and all(a < b for a, b in pairs)
    assert addresses.found(df.limit(0), codes).count() == 0


def test_towns_are_told_by_postal_district_and_streets_may_be_long(spark):
    codes = spark.createDataFrame([("16-546", "Piaskostaw"), ("62-471", "Wilczęcin")], "postal_code string, city string")
    street = "Chrząszczyżewoszyckiegołękołodzkiegokonstantynopolitańska"
    rows = [("ul. Badeczaka 7", "62-471", "Wilczęcin", None), ("Badeczaka 7", "62-999", None, None), ("Badeczaka 7", "80-999", None, None)]
    rows += [(f"{street} {n}", "62-471", None, None) for n in (3, 4, 5)] + [(f"{street[:20]}{street[21:]} 3", "62-471", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "addr_id bigint, street string, postal_code string, city string, raw string")
    got = {r["addr_id"]: r["place"] for r in addresses.places(df, codes).collect()}
    assert got[0] == got[1] != got[2] and got[3] == got[6]
    many = spark.range(addresses.REFERENCE_ROWS + 1).selectExpr("cast(id as string) postal_code", "'x' city")
    with pytest.raises(ValueError, match="postal codes"):
        addresses.places(df, many)


# --- tokens -------------------------------------------------------------------------------------------

TEXTS = ["Zażółć gęślą jaźń 👍🏽", "", None, " ", "<|endoftext|> zwykły tekst", "a" * 50_000, "日本\r\n\t"]


def test_encoding_round_trip(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.ids(df).collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[4]
    back = {r["doc_id"]: r["text"] for r in encode.texts(encode.ids(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    for r in encode.spans(df).collect():
        text, tokens = (TEXTS[r["doc_id"]] or ""), r["tokens"]
        assert [t["id"] for t in tokens] == got[r["doc_id"]]
        for t in tokens:
            assert encode.vocabulary_bytes(PATH)[t["id"]] == text.encode()[t["byte_start"] : t["byte_end"]]
            assert 0 <= t["char_start"] < t["char_end"] <= len(text)
    assert "".join(encode.pieces_of(got[0], PATH)) == TEXTS[0]
    assert encode.ids(df.limit(0)).count() == 0


def test_packing(spark):
    r = np.random.default_rng(4)
    sizes = [(i, int(n)) for i, n in enumerate(r.integers(1, 1500, size=400))] + [(900, 0), (901, 512), (902, 1024)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens int")
    kinds = spark.createDataFrame([("small", 512), ("medium", 2048)], "container_kind string, capacity_tokens int")
    rows = packing.pack(df, kinds).toPandas()
    for kind, capacity in (("small", 512), ("medium", 2048)):
        own = rows[rows.container_kind == kind]
        held = own[own.container_id.notna()].groupby("container_id").tokens.sum()
        assert held.max() <= capacity and held.sum() / (len(held) * capacity) > 0.97
        assert own.groupby("doc_id").tokens.sum().to_dict() == dict(sizes)
        for doc, n in sizes:
            assert (own.doc_id == doc).sum() == max(1, -(-n // capacity))
    assert packing.pack(df.limit(0), kinds).count() == 0 and packing.pack(df, kinds.limit(0)).count() == 0
    with pytest.raises(ValueError, match="kinds"):
        packing.pack(df, spark.range(packing.KINDS + 1).selectExpr("cast(id as string) container_kind", "cast(id + 1 as int) capacity_tokens"))
    texts = spark.createDataFrame([(1, "Ala ma kota"), (1, "Ala ma kota"), (2, None), (3, "")], "doc_id bigint, text string")
    one = packing.pack_texts(texts, kinds.limit(1)).collect()
    assert sorted((r["doc_id"], r["container_id"] is None) for r in one) == [(1, False), (2, True), (3, True)]
    assert packing.fill_report(packing.pack_texts(texts, kinds), kinds).count() == 2


# --- abusive passages ---------------------------------------------------------------------------------


def test_disguises():
    assert abuse.normal("K U R W A!") == "kurwa!" and abuse.normal("d.u.p.ę") == "dupe" and abuse.normal("fuuuuck") == "fuck" and "idiota" in abuse.normal("id1ota")
    assert abuse.normal("Sp. z o.o. NIP 123-456") == "sp. z o.o. nip 9-9"


def test_gram_hashes_do_not_cross_sentences():
    a, fa = abuse.grams(["abc", "xyz"])
    b, fb = abuse.grams(["xyz"])
    assert sorted(fa[a == 1]) == sorted(fb)


def test_held_out_abuse(spark):
    bad = ["wynoś się stąd, ty skończony idioto", "jesteście bandą oszustów i debili", "zabiję was wszystkich, gnoje"]
    good = ["Prosimy o zapłatę faktury w terminie", "Towar odebrano bez zastrzeżeń", "Świnie rzeźne i bydło, cena za kilogram"]
    rows = [(i, f"{good[i % 3]} numer {i}. {bad[i % 3] if i % 4 == 0 else good[(i + 1) % 3]}.", "s") for i in range(60)] + [(98, None, "s"), (99, "  ", None), (97, "ty debilu, zabiję cię", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "a", int(i % 4 == 0)) for i in range(40)] + [(41, "a", 1), (41, "b", 0), (42, "a", None)], "doc_id bigint, annotator string, abusive int")
    got = {r["doc_id"]: r["score"] for r in abuse.scores(docs, labels).collect()}
    held = range(40, 60)
    assert np.mean([(got[i] > 0.5) == (i % 4 == 0) for i in held]) >= 0.95
    assert got[98] == 0 and got[99] == 0 and got[97] > 0.5
    assert abuse.source_rates(docs, labels).agg(F.sum("documents")).first()[0] == 63


UNSEEN_ABUSE = ["Mam nadzieję, że zgnijesz w piekle", "Rozwalę ci ten głupi łeb", "You filthy whore, get lost", "Ich breche dir alle Knochen, du Schwein", "Zobaczysz, połamię ci obie nogi", "Pokaż dupę, laska"]
UNSEEN_HARMLESS = ["Towar dotarł uszkodzony, jestem bardzo niezadowolony", "The delivery was late again, this is unacceptable", "Leider ist die Ware beschädigt", "Suka labradora, szczepienie", "Piersi z kurczaka 2 kg", "Śmieci należy segregować", "Pana pies pogryzł kuriera"]


def test_unseen_sentences_by_the_seeds():
    ordinary = [*CLEAN, "Please confirm the delivery of the goods", "The invoice was paid on Friday", "Die Rechnung ist noch offen", "Wir bitten um Zahlung der Ware", "Towar odebrano, jestem zadowolony z obsługi", "Paczka dotarła bez uszkodzeń"]
    model = abuse.train([(f"{x}. {y}.", 0.0) for x in ordinary for y in ordinary if x < y])
    rate = lambda texts: model.score(model.rate([abuse.normal(t) for t in texts])) > 0.5
    assert rate(UNSEEN_ABUSE).mean() >= 0.8 and rate(UNSEEN_HARMLESS).mean() <= 0.15


def test_usual_sentences_of_positive_documents_stay_harmless():
    """A sentence that every document may hold is no passage, though by chance only positive documents of the sample hold it."""
    usual, r = "prosimy o zwrot podpisanego egzemplarza.", np.random.default_rng(3)
    words = "oferta dostawa paleta protokół saldo kwartał magazyn termin rabat kurier umowa korekta".split()
    plain = lambda: " ".join(r.choice(words, 6)) + ". "
    bad = ["ty skończony idioto. ", "spierdalaj, gnoju. ", "zabiję cię, frajerze. "]
    rows = [(plain() + plain() + (bad[i % 3] + usual * (i < 20) if i % 4 == 0 else ""), float(i % 4 == 0)) for i in range(120)]
    model = abuse.train(sorted(rows), {usual: 0.1} | {abuse.normal(b).strip(): 0.02 for b in bad})
    rate = lambda t: float(model.score(model.rate([abuse.normal(t)]))[0])
    assert rate(usual) < 0.5 < rate("zabiję cię, gnoju")
    right, found, positive = model.held_out
    assert right == found == positive == 30


def test_threshold_is_the_one_of_least_errors():
    assert abuse.best_threshold([(0.9, True), (0.8, True), (0.7, False), (0.1, False)]) == (0.7, (2, 2, 2))
    assert abuse.best_threshold([]) == (0.5, (0, 0, 0))


def test_long_texts_are_scored_whole(spark):
    docs = spark.createDataFrame([(1, "Prosimy o zapłatę. " * 3000 + "ty skurwysynu, zabiję cię", "s"), (2, "Prosimy o zapłatę. " * 3000, "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, annotator string, abusive int")
    got = {r["doc_id"]: r["score"] for r in abuse.scores(docs, labels).collect()}
    assert got[1] > 0.5 > got[2]
