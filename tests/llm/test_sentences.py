import pytest

from rankloom.llm import sentences as st


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as lang", "2 as word", "3 as start", "4 as sentence")


def units(spark, texts):
    out = {}
    for r in st.sentences(frame(spark, texts)).orderBy("doc_id", "start_char").collect():
        assert texts[r.doc_id][r.start_char : r.end_char] == r.sentence == r.sentence.strip()
        out.setdefault(r.doc_id, []).append(r.sentence)
    return out


PLAIN = st.Cutter(frozenset(), {})


def cut(text, cutter=PLAIN):
    return [text[s:e] for s, e in cutter.cut(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("One. Two! Three?\n\nFour", ["One.", "Two!", "Three?", "Four"]),
    ("It rose to 3.14 in v1.2.3 of a.json. Then it fell.", ["It rose to 3.14 in v1.2.3 of a.json.", "Then it fell."]),
    ("“Is it exact?” asked Ann. Yes.", ["“Is it exact?” asked Ann.", "Yes."]),
    ("She said: “One. Two.” Then she left.", ["She said: “One. Two.”", "Then she left."]),
    ("It works (it does. Really!) well. (Note this.) Good.", ["It works (it does. Really!) well.", "(Note this.)", "Good."]),
    ("Really?! Yes... and more. End", ["Really?!", "Yes... and more.", "End"]),
    ("We saw:\n- one thing\n- two. Things\n\nDone.", ["We saw:", "- one thing", "- two. Things", "Done."]),
    ("A line that\nwraps here. Next.\r\n\r\nTitle\r\rText.", ["A line that\nwraps here.", "Next.", "Title", "Text."]),
    ("一。二！「三。」と言う。四", ["一。", "二！", "「三。」と言う。", "四"]),
    ("作者写道：“好。”然后走了。", ["作者写道：“好。”", "然后走了。"]),
    ("¿Qué? ¡Sí! «¿Es exacto?», dijo.", ["¿Qué?", "¡Sí!", "«¿Es exacto?», dijo."]),
    ("Γιατί; Ναι.", ["Γιατί;", "Ναι."]),
    ("यह है। वह था।", ["यह है।", "वह था।"]),
    ("หนึ่งสอง สามสี่ ปี พ.ศ. 25 แล้ว", ["หนึ่งสอง", "สามสี่", "ปี พ.ศ. 25 แล้ว"]),
    ("لماذا؟ نعم.", ["لماذا؟", "نعم."]),
    ("It ends.Another starts.", ["It ends.", "Another starts."]),
    ("An unclosed (bracket. Goes on.", ["An unclosed (bracket.", "Goes on."]),
])
def test_cutting(text, want):
    assert cut(text) == want


def test_abbreviations_are_learned(spark):
    names = ["Alba", "Boro", "Cato", "Dena", "Egon", "Fila", "Gero", "Hana", "Ilka", "Juno"]
    texts = [f"The test by Dr. {n} ran. We saw approx. {i} rows. The end came! We left it to Dr. {names[-i % 10]} then.\n\nThe rest, e.g. {n.lower()}, stays." for i, n in enumerate(names * 30)]
    got = units(spark, texts)
    assert got[0] == ["The test by Dr. Alba ran.", "We saw approx. 0 rows.", "The end came!", "We left it to Dr. Alba then.", "The rest, e.g. alba, stays."]
    assert all(len(v) == 5 for v in got.values())


def test_texts_that_give_nothing(spark):
    assert units(spark, [None, "", "  \n\t ", " 　"]) == {}
    assert st.sentences(frame(spark, ["x"]).limit(0)).count() == 0


def test_long_text_and_offsets_in_code_points(spark):
    text = "😀 Ok. " * 20_000
    got = units(spark, [text])[0]
    assert len(got) == 20_000 and set(got) == {"😀 Ok."}


def test_model_as_a_table_gives_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    broadcast, joined = (sorted(map(tuple, st.sentences(docs, model_limit=n).collect())) for n in (10**6, 0))
    assert broadcast and broadcast == joined


def test_language_counts_all_letters():
    half = "слово " * 3000 + "word " * 3800
    assert st.language_of(half) == "latin" and st.language_of(half + "слово" * 60) == "cyrillic"
    assert st.language_of("der Hund und die Katze") == "de" and st.language_of("") == "latin"


def test_long_runs_are_one_type():
    long = "x" * 5000
    assert st.type_before(long + ".", 5000, 0) == "##long"
    assert st.type_before("(etc.", 4, 0) == "etc" and st.type_before("3,55.", 4, 0) == "#.#" and st.type_before(" .", 1, 0) == ""
    cutter = st.Cutter(frozenset(), {})
    assert cutter.cut(f"{long}. {long}. End") == [(0, 5001), (5002, 10003), (10004, 10007)]
    assert len(cutter.cut("a.)" * 200_000)) >= 1
