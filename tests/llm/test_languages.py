import numpy as np
import pytest

from kolonnade.llm import languages as L

LINES = {
    "en": ["The value of the column is stored with the name of the table.", "This report counts all rows that were changed before the weekly load.", "A second reviewer compares the address of the customer with the old archive."],
    "de": ["Der Wert der Spalte wird mit dem Namen der Tabelle gespeichert.", "Dieser Bericht zählt alle Zeilen, die vor dem Abgleich geändert wurden.", "Eine zweite Prüferin vergleicht die Adresse des Kunden mit dem alten Archiv."],
    "fr": ["La valeur de la colonne est enregistrée avec le nom de la table.", "Ce rapport compte toutes les lignes qui ont changé avant le chargement.", "Une seconde relectrice compare l'adresse du client avec l'ancienne archive."],
    "es": ["El valor de la columna se guarda con el nombre de la tabla.", "Este informe cuenta todas las filas que cambiaron antes de la carga.", "Una segunda revisora compara la dirección del cliente con el archivo antiguo."],
    "it": ["Il valore della colonna viene salvato con il nome della tabella.", "Questo rapporto conta tutte le righe che sono cambiate prima del caricamento.", "Una seconda revisora confronta l'indirizzo del cliente con il vecchio archivio."],
    "pt": ["O valor da coluna é guardado com o nome da tabela.", "Este relatório conta todas as linhas que mudaram antes da carga.", "Uma segunda revisora compara o endereço do cliente com o arquivo antigo."],
    "nl": ["De waarde van de kolom wordt met de naam van de tabel bewaard.", "Dit rapport telt alle rijen die voor het laden zijn veranderd.", "Een tweede beoordelaar vergelijkt het adres van de klant met het oude archief."],
    "ru": ["Значение столбца хранится вместе с названием таблицы.", "Этот отчёт считает все строки, которые изменились перед загрузкой.", "Вторая рецензентка сравнивает адрес клиента со старым архивом."],
}
NOUNS = {"en": "harbour ticket wagon lease", "de": "Hafen Fahrkarte Wagen Mietvertrag", "fr": "port billet wagon bail", "es": "puerto billete vagón contrato", "it": "porto biglietto vagone contratto", "pt": "porto bilhete vagão contrato", "nl": "haven kaartje wagon huurcontract", "ru": "гавань билет вагон договор"}


def corpus(noise=0.1):
    rng = np.random.default_rng(3)
    out, codes = [], list(LINES)
    for x in codes:
        for k in range(40):
            text = " ".join(rng.permutation(LINES[x])[: 1 + k % 3])
            out.append((len(out), text, x if rng.random() > noise else codes[rng.integers(len(codes))]))
    return out


SHAPE = "doc_id long, text string, lang string, label string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(frame(spark, corpus()))


def test_codewords_are_far_apart():
    code = L.codewords(8)
    far = (L.BITS - code @ code.T)[~np.eye(8, dtype=bool)] / 2
    assert far.min() >= 5 and code.shape == (8, L.BITS)


def test_held_out_sentences(model):
    reader = model.reader()
    ok = n = 0
    for x, lines in LINES.items():
        for line in lines:
            ws = L.natural_words(line.lower()) + NOUNS[x].lower().split()
            np.random.default_rng(n).shuffle(ws)
            ok += model.languages[reader.read([ws[:7]])[0][0]] == x
            n += 1
    assert ok >= 0.95 * n


def test_relabelled(spark, model):
    en, de, fr = (" ".join(LINES[x]) for x in ("en", "de", "fr"))
    rows = [
        (1, en, "en"), (2, en, "English"), (3, en, "EN_us"), (4, en, None), (5, de, "en"), (6, en + " " + LINES["de"][0], "en"), (7, "SELECT a FROM b WHERE c = 'und der die das'", None), (8, "", "de"), (9, None, "de"),
        (None, en, "de"), (10, fr, "und"), (11, fr + "\n```sql\nSELECT the FROM of WHERE this = 'that'\n```", "fr-CA"), (12, en, "xx"), (12, en, "xx"), (13, de * 2000, "deu"),
    ]
    got = sorted(map(tuple, L.relabelled(frame(spark, rows), model).collect()))
    assert got == [(4, "en"), (5, "de"), (6, "de"), (6, "en"), (10, "fr"), (12, "en")]


def test_segments_carry_place_and_confidence(spark, model):
    text = LINES["en"][0] + "\n" + LINES["ru"][1]
    rows = sorted(L.sentence_languages(frame(spark, [(1, text, None)]), model).collect(), key=lambda r: r["begin"])
    assert [(r["lang"], text[r["begin"] : r["end"]]) for r in rows] == [("en", LINES["en"][0]), ("ru", LINES["ru"][1])]
    assert all(0.9 <= r["confidence"] <= 1 and not r["ambiguous"] for r in rows)


def test_stretches_are_merged(spark, model):
    text = " ".join(LINES["en"]) + " Hm. " + " ".join(LINES["de"][:2]) + "\n" + LINES["ru"][1]
    rows = sorted(L.language_stretches(frame(spark, [(1, text, None), (1, text, None), (2, LINES["fr"][0], None), (3, None, None), (4, "SELECT a FROM b", None)]), model).distinct().collect(), key=lambda r: (r["doc_id"], r["begin"]))
    assert [(r["doc_id"], r["lang"], r["n_sentences"]) for r in rows] == [(1, "en", 4), (1, "de", 2), (1, "ru", 1), (2, "fr", 1)]
    assert text[rows[1]["begin"] : rows[1]["end"]].strip() == " ".join(LINES["de"][:2]) and all(0.5 < r["confidence"] <= 1 for r in rows)


def test_short_sentences_and_documents_without_a_sure_one(spark, model):
    got = {(r["doc_id"], r["lang"]): r["confidence"] for r in L.document_languages(frame(spark, [(1, "Das wird gespeichert.", "en"), (2, "Zzz.", "en"), (3, LINES["nl"][0] + " Ja.", "en")]), model).collect()}
    assert got[1, "de"] > 0.5 and got[3, "nl"] > 0.9 and {d for d, _ in got} == {1, 2, 3} and len(got) == 3
    assert min(v for (d, _), v in got.items() if d == 2) < L.SURE_SHORT


def test_few_words_are_ambiguous_or_unread(model):
    assert list(L.sentences("")) == []
    assert model.reader().read([["zzz", "qqq", "xxx", "kkk"]])[1][0] < 0.999


def test_without_documents_or_labels(spark):
    assert L.relabelled(frame(spark, [])).count() == 0
    assert L.relabelled(frame(spark, [(1, "no label at all here.", None)])).count() == 0


def test_function_words_label_what_is_clear():
    assert L.seeded(L.natural_words(LINES["nl"][0])) == "nl" and L.seeded(["harbor"]) is None
