import pytest

from tektonis.llm import sentences as S

MODELS = {
    "de": S.Model([("a", "z", ""), ("a", "b", ""), ("a", "d", ""), ("a", "h", ""), ("a", "vgl", ""), ("a", "abb", ""), ("a", "nr", ""), ("a", "usw", ""), ("s", "die", ""), ("s", "das", ""), ("c", "vgl", "abb"), ("c", "##", "dezember")]),
    "en": S.Model([("a", "e.g", ""), ("a", "fig", ""), ("a", "a.m", ""), ("a", "etc", ""), ("s", "the", "")]),
    "ru": S.Model([("a", "г", ""), ("a", "рис", ""), ("s", "сколько", "")]),
}


def parts(text):
    return [text[a:b] for a, b in S.sentences(text, MODELS)]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []),
        ("  \n ", []),
        ("Ohne Punkt", ["Ohne Punkt"]),
        ("Die Wand ist z. B. auf der Seite 5,2 cm dick. Die Decke (vgl. Abb. 3.4) hält.", ["Die Wand ist z. B. auf der Seite 5,2 cm dick.", "Die Decke (vgl. Abb. 3.4) hält."]),
        ("Am 3. Dezember 1990 war es im 4. Obergeschoss nass. Das Werk lieferte Nägel usw. Die Fugen riss.", ["Am 3. Dezember 1990 war es im 4. Obergeschoss nass.", "Das Werk lieferte Nägel usw.", "Die Fugen riss."]),
        ("„Ist die Wand noch trocken?“, fragte der Trupp. „Die Wand bleibt offen.“ So lautete der Hinweis.", ["„Ist die Wand noch trocken?“, fragte der Trupp.", "„Die Wand bleibt offen.“", "So lautete der Hinweis."]),
        ('"Is the wall dry?" asked the team before the survey. The report states: "The wall needs lime." pH readings fell ... but rose.', ['"Is the wall dry?" asked the team before the survey.', 'The report states: "The wall needs lime."', "pH readings fell ... but rose."]),
        ("At 7 a.m. the sensor of the wall showed 3.6. See Fig. 4 of the plan.", ["At 7 a.m. the sensor of the wall showed 3.6.", "See Fig. 4 of the plan."]),
        ("Notes on the wall\n\n(1) The wall is wet.\n(2) No.", ["Notes on the wall", "(1) The wall is wet.", "(2) No."]),
        ("The wall of the northern house was wet in the spring of that year and\nstayed wet until autumn. The roof of the northern house was tight in\nspring.", ["The wall of the northern house was wet in the spring of that year and\nstayed wet until autumn.", "The roof of the northern house was tight in\nspring."]),
        ("勘察组问：“墙还干燥吗？”为什么缺少板？“底板要敞开！”工长写道。厚约5.5厘米……但并未受潮。", ["勘察组问：“墙还干燥吗？”", "为什么缺少板？", "“底板要敞开！”工长写道。", "厚约5.5厘米……但并未受潮。"]),
        ("調査班は「まだ乾いているか？」と尋ねた。本当か？", ["調査班は「まだ乾いているか？」と尋ねた。", "本当か？"]),
        ("ผนังทำจากแผ่นหนา 28.6 ซม. ตามแผ่นหน้า33 จริงหรือ", ["ผนังทำจากแผ่นหนา 28.6 ซม.", "ตามแผ่นหน้า33", "จริงหรือ"]),
        ("मोटाई 26.6 से.मी. है। सच?", ["मोटाई 26.6 से.मी. है।", "सच?"]),
        ("В 1990 г. слой сняли. К 1958 г. Сколько слоёв? «Стена сухая», — записала бригада.", ["В 1990 г. слой сняли.", "К 1958 г.", "Сколько слоёв?", "«Стена сухая», — записала бригада."]),
        ("Γιατί λείπει το υλικό; Αλήθεια;", ["Γιατί λείπει το υλικό;", "Αλήθεια;"]),
        ("¿De verdad? ¡Nadie esperaba la placa!", ["¿De verdad?", "¡Nadie esperaba la placa!"]),
        ("« Le toit est-il sec ? » demanda l'équipe. « Le mur exige une lame. » Non.", ["« Le toit est-il sec ? » demanda l'équipe.", "« Le mur exige une lame. »", "Non."]),
        ("هل ما زال الجدار جافا؟ لا. سأل الفريق: «هل هو جاف؟»", ["هل ما زال الجدار جافا؟", "لا.", "سأل الفريق: «هل هو جاف؟»"]),
    ],
)
def test_sentences(text, want):
    assert parts(text) == want


def test_learns_abbreviations(spark):
    rows = [(i, f"The wall is approx. {i} cm thick, e.g. at the rear. The roof of house {i} holds. It was seen at approx. {i} places of the town.") for i in range(60)]
    rows += [(100, None), (101, " "), (102, "The wall " * 20000 + "ends.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS sent_no", "'x' AS word", "'y' AS lang")
    model = {(r.kind, r.word) for r in S.learn(docs).where("lang = 'en'").collect()}
    assert {("a", "approx"), ("a", "e.g")} <= model and ("a", "holds") not in model
    got = S.split_documents(docs)
    assert got.columns == ["doc_id", "sent_no", "start_char", "end_char"]
    out = sorted(map(tuple, got.where("doc_id < 100").collect()))
    assert len(out) == 180 and got.where("doc_id = 102").count() == 1 and got.where("doc_id IN (100, 101)").count() == 0
    joined = S.split_documents(docs, model_limit=0)  # the way for models too large to send
    assert sorted(map(tuple, joined.where("doc_id < 100").collect())) == out
    assert S.split_documents(docs.limit(0)).count() == 0


MIXED = [
    "The wall of the house was seen by the team and is dry. Das Haus wurde am 4. Obergeschoss und der Decke vgl. Abb. 3 mit der Wand nass. The roof is in the plan.",
    "Die Wand ist nass und der Putz ist lose. The sensor of the wall was seen at the rear, e.g. Fig. 4 of the plan and Fig. 5. —The roof was dry. Das Dach ist dicht usw. Die Fuge riss.",
    "The report of the house is in Nr. 7. das Dach und die Wand der Reihe ist in der 3. Etage. the end of it is \u201cetc.\u201d The wall was wet.",
    "В 1990 г. слой сняли. The wall of the house was in Fig. 3 of the plan. Die Wand ist im 4. Obergeschoss und der Decke nass.",
]


def test_joined_models_split_alike(spark):
    """Mixed languages: the way for large models gives what the broadcast gives."""
    found = [(lang, k, w, n) for lang, m in MODELS.items() for k, ws in (("a", m.abbr), ("s", m.start)) for w in ws for n in [""]] + [(lang, "c", w, n) for lang, m in MODELS.items() for w, n in m.pair]
    model = spark.createDataFrame([*found, ("fr", "a", "nirgends", "")], "lang string, kind string, word string, next string")
    docs = spark.createDataFrame([*enumerate(MIXED), (None, MIXED[1])], "doc_id bigint, text string")
    rows = lambda limit: sorted(map(tuple, S.split_documents(docs, model=model, model_limit=limit).collect()), key=str)
    sent = rows(200_000)
    assert rows(0) == sent and len(sent) > 10
