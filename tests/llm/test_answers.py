import pytest
from pyspark.sql import functions as F

from kolonnade.llm import answers as A
from tests.llm.test_languages import LINES

PROMPT = "Explain which column fits the request.\nroute_list_7(price, city, owner)\nThis report counts all rows that were changed before the weekly load.\nWhich column holds the cost centre when nobody says where to look?"
GERMAN = "Erkläre, welche Spalte zur Anfrage passt.\nDer Wert der Spalte wird mit dem Namen der Tabelle gespeichert.\nWelche Spalte enthält den Preis, wenn niemand einen Ort nennt?"
EN, DE, FR = (" ".join(LINES[x]) for x in ("en", "de", "fr"))


def train():
    from kolonnade.llm import languages

    return languages.train([(x, line) for x, lines in LINES.items() for line in lines * 3])


@pytest.fixture(scope="module")
def judge():
    return A.Judge(train())


@pytest.mark.parametrize(
    "content,prompt,defect",
    [
        (None, PROMPT, "empty"), ("", PROMPT, "empty"), ("​ \xa0\n", PROMPT, "empty"), ("```sql\n\n```", PROMPT, "empty"), ("```\n```", PROMPT, "empty"), ("...", PROMPT, "empty"), ("null", PROMPT, "empty"), ('""', PROMPT, "empty"), ("{}", PROMPT, "empty"),
        ("I'm sorry, but I can't help with this request.", PROMPT, "refusal"), ("As a language model, I must decline to produce this queryat this time. The request mentions t_1.", PROMPT, "refusal"), ("Es tut mir leid, aber hier muss ich passen.", GERMAN, "refusal"),
        ("Por desgracia, debo rechazar esta consulta.", PROMPT, "refusal"), ('{"decision": null, "reason_summary": "I have to refuse this one."}', PROMPT, "refusal"),
        ("Sorry for the long list of columns; price is the one to use.", PROMPT, None), ("I cannot tell from the schema alone, so the safer choice is city.", PROMPT, None),
        (PROMPT, PROMPT, "copy"), (PROMPT.lower().replace("\n", " "), PROMPT, "copy"), ("> " + PROMPT.replace("\n", "\n> "), PROMPT, "copy"), ("Sure! Here is the answer: Which column holds the cost centre when nobody says where to look?", PROMPT, "copy"),
        ("\n".join(reversed(PROMPT.split("\n"))), PROMPT, "copy"), (PROMPT[:-40], PROMPT, "copy"),
        ("Which column holds the cost centre when nobody says where to look?\nThe owner column does, as the second reviewer wrote in the old archive last week.", PROMPT, None),
        ("city", PROMPT, None), ("route_list_7.price", PROMPT, None), ("ADD_EDGE", PROMPT, None), ("SELECT price, city FROM route_list_7 WHERE owner = 'x'", PROMPT, None),
        (DE, PROMPT, "language"), (EN, GERMAN, "language"), (DE, GERMAN, None), (EN, PROMPT, None), (FR, PROMPT + " Please reply in French.", None), (EN, PROMPT + " Please reply in French.", "language"), (EN, GERMAN + " Bitte auf Englisch antworten.", None),
    ],
)
def test_defects(judge, content, prompt, defect):
    assert judge.defect(content, prompt) == defect


REASONS = "The data behind this request belongs to another department and its owner has not agreed to any use so far. "


@pytest.mark.parametrize(
    "content,defect",
    [
        # Long ones, and ones that decline late.
        ("I'm sorry for the delay. " + REASONS * 3 + "For these reasons I cannot provide an answer to this. " + REASONS * 4, "refusal"),
        ("Thank you for asking. I have read the request with care. I can't help with this request.", "refusal"),
        (REASONS * 8 + "I must decline to produce this query.", "refusal"),
        ("Because the owner of the data has not agreed to any use by people outside of the department and nobody there could be reached before the end of the week, I cannot comply with this request.", "refusal"),
        ('{"decision": null, "confidence": 0.0, "reason_summary": "' + REASONS * 6 + 'I have to refuse this one."}', "refusal"),
        (REASONS * 4 + "I can't answer this question.\nYou could use another column of the table or ask the owner instead.", "refusal"),
        # Answers in spite of a sentence that declines.
        ("I can't answer this question for all years. For the last one:\n```sql\nSELECT price FROM route_list_7\n```", None),
        ('{"decision": "ADD_EDGE", "reason_summary": "I can\'t answer this question for all years."}', None),
        ("I can't answer this question for all years. Use route_list_7.price for the last one, or route_list_7 as a whole.", None),
    ],
)
def test_refusals_of_any_length(judge, content, defect):
    assert judge.defect(content, PROMPT + "\nroute_list_7.price, route_list_7.city") == defect


def test_refusal_in_the_prompt_is_none(judge):
    asked = PROMPT + "\nI can't answer this question."
    assert not judge.refuses("The note reads as follows.\nI can't answer this question.", asked)


def test_common_subsequence():
    a, b = "a b c d e f".split(), "b x d a f".split()

    def slow(a, b):
        if not a or not b:
            return 0
        return 1 + slow(a[1:], b[1:]) if a[0] == b[0] else max(slow(a[1:], b), slow(a, b[1:]))

    assert A.common_subsequence(a, b) == slow(a, b) == 3
    assert A.common_subsequence([], b) == 0


RS = "ingest_seq long, request_id string, model string, content string, ok boolean, error string, prompt string"
QS = "request_id string, prompt string, content string, defect string"


def test_table(spark):
    lines = [(100 + i, f"fill{i}", "m", " ".join(LINES["en"][k % 3] for k in range(i % 3 + 1)), True, "", "p") for i in range(60)]
    rows = [
        (1, " A ", "m", "", True, "", "p"), (2, "a", "m", EN + " The value of the colu", True, "", "p"), (2, "a", "m", EN + " The value of the colu", True, "", "p"), (3, "b", "m", None, False, "429", "p"), (4, "none", "m", "", True, "", "p"),
        (5, None, "m", "", True, "", "p"), (6, "c", "m", "", True, "", "p"), (None, "a", "m", "", True, "", "p"), (7, "a", "m", EN, False, "IncompleteRead", "p"), (8, "d", "m", "x " * 100_000 + "end.", True, "", "p"),
    ]
    asked = [("a", PROMPT, "c", "d"), ("A", PROMPT, "c", "d"), ("b", PROMPT, "", ""), ("c", None, "", ""), ("d", PROMPT, "", ""), (None, PROMPT, "", "")] + [(f"fill{i}", PROMPT, "", "") for i in range(60)]
    got = sorted(map(tuple, A.defective(spark.createDataFrame(rows + lines, RS), spark.createDataFrame(asked, QS)).collect()))
    assert got == [(1, "empty"), (2, "truncated"), (3, "empty")]


def test_empty_tables(spark):
    assert A.defective(spark.createDataFrame([], RS), spark.createDataFrame([], QS)).count() == 0


def test_short_copies_and_short_prose(judge):
    assert judge.copies("Which city?", "Use the table tours.\nWhich city?") and judge.copies("price of tours", "price of tours")
    assert not judge.copies("city", "city") and not judge.copies("tour city", "Which tour city is meant?")
    assert judge.languages(["unit price", None, ""]) == [None, None, None]


def test_several_prompts_of_a_request(spark):
    r = spark.createDataFrame([(1, "a", "Which price is the right one for this question here?"), (2, "a", "price_1")], "ingest_seq long, request_id string, content string").withColumn("model", F.lit("m"))
    q = spark.createDataFrame([(" A", "Which price is the right one for this question here?"), ("a", "Name a column."), ("a", None)], "request_id string, prompt string")
    assert sorted(map(tuple, A.defective(r, q).collect())) == [(1, "copy")]


def test_words_of_a_sound_answer_are_taken_once(monkeypatch):
    from kolonnade.llm import answers

    taken, real = [], answers.words
    judge = answers.Judge(None)
    monkeypatch.setattr(answers, "words", lambda t: taken.append(t) or real(t))
    content, prompt = "The ledger keeps one row for each delivery of the depot.", "Which column holds the price of a part?"
    assert judge.first(content, prompt) is None and taken == [content]
    assert judge.first(f"Sure, here is the question: {prompt}", prompt) == "copy"
    # The quick counts of templates say the same as counting each.
    for text in [*answers.REFUSALS.strip().splitlines(), "I can help you", "no answer here", prompt, content]:
        ws = real(text)
        assert judge.may_decline(ws) == any(judge.enough(k, len(v & set(ws))) for k, v in enumerate(judge.vocabulary))
    assert judge.asked("Bitte ANTWORTE auf Deutſch.") == "de" and judge.asked("Answer in Englısh.") == "en" and judge.asked("Answer now.") is None
