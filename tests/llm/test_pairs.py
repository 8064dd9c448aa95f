import pytest
from loomgraph.llm import pairs as p
from loomgraph.sources.tables import table


@pytest.mark.parametrize("text", [None, "", " \n\t", "  ", "​", "[]", "{}", '""', "**", "-", "<p></p>", "```\n```", "```json\n\n```", "N/A", "null", "None"])
def test_empty(text):
    assert p.is_empty(text)


@pytest.mark.parametrize("text", ["0", "Yes", "null check", "- a", "✓", "```\nx\n```", "否"])
def test_not_empty(text):
    assert not p.is_empty(text)


@pytest.mark.parametrize(
    "text",
    ["I'm sorry, but I can't help with this request.", "Hello. I must decline to answer this question. Thank you for your understanding.", "Leider kann ich dabei nicht helfen.",
     "Je suis désolé, mais je ne peux pas vous aider.", "Извините, но я не могу помочь с этим.", "申し訳ありませんが、お手伝いできません。", "Non posso rispondere a questa domanda."],
)
def test_refusal(text):
    assert p.is_refusal(text)


@pytest.mark.parametrize(
    "text",
    ['"I can\'t help with this request" stands in ConfigHandler as a constant.', "I'm unable to find a test for loadNode, so it is not covered.", "Unfortunately loadNode cannot be removed.",
     "I cannot answer that in general. In BatchStore the limit of 20 rows applies.", "Sorry for the length, but the report is used in 57 places."],
)
def test_no_refusal(text):
    assert not p.is_refusal(text)


def test_copy():
    ask = "You review code. What happens to the branch if BatchPlanner is restarted during cancelShipment?\n\nvoid f() {\n    a = 1;\n}"
    for text in ("What happens to the branch if BatchPlanner is restarted during cancelShipment?", "Question: what happens to the branch when BatchPlanner is restarted during cancelShipment?",
                 "> WHAT HAPPENS TO THE BRANCH IF BATCHPLANNER IS  RESTARTED during cancelShipment", ask):
        assert p.is_copy(ask, text), text
    for text in ("void f() {\n    a = 1;\n    b = 2;\n}", "The branch is dropped if BatchPlanner is restarted during cancelShipment.", "BatchPlanner", "Yes", ""):
        assert not p.is_copy(ask, text), text
    assert not p.is_copy("", "some words that stand nowhere else")


def test_languages_on_held_out_documents(spark, data):
    documents = table(spark, data("sf0.01"), "documents")
    model = p.fit_languages(documents.filter("doc_id % 2 = 0"))
    held = [r for r in documents.filter("doc_id % 2 = 1 and text is not null and lang in ('de','es','fr','it','ja','pt','ru','en') and doc_kind = 'chat'").collect()]
    texts = [p.prose(r.text) for r in held]
    found = p.languages(texts, model)
    told = [(p.LANGUAGES[f], r.lang) for f, r in zip(found, held) if f >= 0]
    assert len(told) > 0.9 * len(held) > 30 and sum(a == b for a, b in told) >= 0.9 * len(told)  # some labels are wrong
    clean = ["O erro acontece porque o contador não reinicia", "Der Fehler entsteht, weil der Zähler nicht zurückgesetzt wird", "La modification touche environ cent lignes et aucune autre interface"]
    assert [p.LANGUAGES[k] for k in p.languages([p.prose(t) for t in clean], model)] == ["pt", "de", "fr"]


def test_defects_of_rows(spark, data):
    model = p.fit_languages(table(spark, data("sf0.01"), "documents"))
    long_ = "The scheduler reads the table before it starts the next run of the batch. "
    rows = [
        (1, "Why?", None, True, 1), (1, "Why?", None, True, 2), (2, "Why?", None, False, 1), (3, "Why?", "  ", False, 1), (4, None, "x" * 50, None, 1),
        (5, "Warum wird der Zähler nicht zurückgesetzt, wenn die Liste leer ist?", long_, True, 1), (6, "Warum wird der Zähler nicht gesetzt? Bitte antworte auf Englisch.", long_, True, 1),
        (7, "Describe the data flow of the nightly batch.", long_ * 500, True, 1), (8, "Why does it fail?", "Sorry, I am not able to assist with that.", True, 1), (None, None, None, None, None),
    ]
    calls = spark.createDataFrame(rows, "id bigint, prompt string, response string, success boolean, defect int")
    assert sorted((r.id or 0, r.defect) for r in p.pair_defects(calls, model).distinct().collect()) == [(0, "empty"), (1, "empty"), (5, "language"), (8, "refusal")]
    assert p.pair_defects(spark.createDataFrame([], calls.schema), model).count() == 0


def test_no_defect_ends_at_a_length():
    for text in (" " * 500, "\u200b" * 300, "<p></p>" * 60, " " * 300 + "null", "```\n\n```\n" * 40):
        assert p.is_empty(text), text
    assert not p.is_empty(" " * 300 + "0") and not p.is_empty("<p></p>" * 60 + "no answer is null")
    no = "I cannot help with this request. "
    for text in (no + "Thank you for your patience and understanding. " * 30, "I cannot help with request 123e4567-e89b-12d3-a456-426614174000 of 2025-01-01 12:30:00.", no + "\n```\n```"):
        assert p.is_refusal(text), text
    assert p.is_refusal(no + "\n```java\nint a = 1;\n```", "Review this:\nint a = 1;")
    assert not p.is_refusal(no + "\n```java\nint a = 1;\n```") and not p.is_refusal("The limit of 20 rows applies. " * 40 + no)
    assert p.is_copy("Why does it fail?", "why does it FAIL ?") and p.is_copy("Why?", "> Why?" + " " * 200)
    assert not p.is_copy("Why?", "Why not?") and not p.is_copy("Yes or no?", "Yes")


@pytest.mark.parametrize(
    "text",
    ["I only deal with general questions and therefore skip this one.", "Please ask another assistant; requests like this one are closed to me.", "Answering this is not permitted for me.",
     "Apologies, this topic is off limits for me.", "That is something I have to leave unanswered.", "This request goes against my instructions, so there will be no answer from my side.",
     "For safety reasons no answer is given to this prompt.", "No comment on that, I'm afraid.", "Questions about private repositories are outside of my remit.",
     "As a language model I have no permission to review material of this kind.", "My guidelines do not allow me to complete this task.", "Não tenho permissão para responder a este pedido.",
     "Мне не разрешено отвечать на этот запрос.", "Non mi è permesso rispondere a questa richiesta.", "Dazu bin ich nicht befugt. Mir ist eine Antwort nicht gestattet.", "No tengo permiso para responder."],
)
def test_refusal_by_permission_or_remit(text):
    assert p.is_refusal(text)


def test_refusal_by_what_many_prompts_get(spark, data):
    model = p.fit_languages(table(spark, data("sf0.01"), "documents"))
    ask = ["Why does it fail?", "Name the callers.", "Describe the nightly batch.", "Is the policy loaded?"]
    said = ["Sorry, that stays with the owner.", "The policy is loaded at the start."]
    rows = [(i, q, said[0], True) for i, q in enumerate(ask)] + [(10 + i, q, said[1], True) for i, q in enumerate(ask[:2])] + [(20, ask[0], "Sorry, nobody knows.", True)] * 5
    calls = spark.createDataFrame(rows, "id bigint, prompt string, response string, success boolean")
    assert sorted({(r.id, r.defect) for r in p.pair_defects(calls, model).collect()}) == [(i, "refusal") for i in range(4)]


def test_nothing_depends_on_length():
    """Size is no criterion: long blanks, a refusal of many sentences, and a prompt that is said twice or quoted."""
    asked = "Why does the nightly job fail when the ledger is empty?"
    assert all(p.is_empty(c * 300) for c in (" ", "-", "\u200b\n", "<p></p>", "()"))
    long = " ".join(["I'm sorry, but I cannot help with this request."] * 20)
    assert len(long) > 900 and p.is_refusal(long, asked)
    assert not p.is_refusal(long + " The nightly job fails because the empty ledger is read before it is filled.", asked)
    for copy in (asked + "\n" + asked, f'You asked: “{asked}”', f'"{asked}"', " ".join([asked] * 30), "Hi?"):
        assert p.is_copy(asked if copy != "Hi?" else "hi?", copy), copy
    assert not p.is_copy(asked, "The job reads the ledger first.")


def test_prompts_teach_the_model(spark):
    """Prompts of a kind that no document has are learnt from their pairs."""
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("El libro mayor está vacío y el proceso termina con un error", "es"), ("Il registro è vuoto e il processo finisce con un errore nel sistema", "it")] * 20)]
    pairs = [(i, "Descrivi brevemente come collabora con", "Il registro è vuoto e il processo finisce con un errore nel sistema", True) for i in range(30)]
    documents, calls = spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(pairs, "id bigint, prompt string, response string, success boolean")
    assert p.pair_defects(calls, p.fit_languages(documents, calls)).filter("defect = 'language'").count() == 0
