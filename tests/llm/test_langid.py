import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import langid

WEIGHTS = np.random.default_rng(3).normal(-9, 1, (len(langid.SIZES) * langid.BUCKETS, 2)).astype(np.float32)
MODEL = langid.Model(("de", "en"), WEIGHTS, np.ones((len(langid.SCRIPTS), 2), bool))


def labelled(text):
    names, share, spans = langid._label_batch(MODEL, pa.array([text, "a word"], pa.large_string()))
    assert names[1] in MODEL.languages
    return names[0], share[0], spans[0].as_py()


@pytest.mark.parametrize("times", [1, 20, 67, 500])
@pytest.mark.parametrize("sign", ["\u2500", "\u2014 ", "\u2192", "\U0001f600 ", "12 ", "\uff01", "\u00d7"])
def test_a_text_without_a_letter_of_any_length(sign, times):
    assert labelled(sign * times) == ("und", 0.0, [])


@pytest.mark.parametrize("letter", ["a", "Z", "\u00e9", "\u0436", "\u4e2d"])
def test_a_letter_behind_many_symbols(letter):
    assert labelled("\u2500" * 500 + " " + letter)[0] in MODEL.languages


def test_ascii_letters_are_told_from_their_neighbours():
    for sign in "@[`{":
        assert labelled(sign * 300)[0] == "und"


def test_more_languages_than_a_byte_counts(spark):
    draw = np.random.default_rng(5)
    words = {f"L{i:03}": ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(300)}
    rows = [(i, lang, " ".join(mine)) for i, (lang, mine) in enumerate(words.items())]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"), id_col="doc_id", text_col="text", lang_col="lang")
    assert len(model.languages) == 300
    names, _, spans = langid._label_batch(model, pa.array([" ".join(draw.permutation(words[lang])) for lang in model.languages], pa.large_string()))
    assert names == list(model.languages)
    assert [s[0]["lang"] for s in spans.to_pylist()] == names


def test_scripts_part_words_without_blanks(spark):
    rows = [(i, *x) for i, x in enumerate([("en", "the cat and the dog sat there"), ("ru", "кошка и собака сидят там"), ("zh", "猫和狗坐在那里")] * 3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"), id_col="doc_id", text_col="text", lang_col="lang")
    text = "thecatandthedog猫和狗坐在那里кошкаисобака"
    _, _, spans = langid._label_batch(model, pa.array([text], pa.large_string()))
    raw = text.encode()
    assert [(s["lang"], raw[s["start"] : s["end"]].decode()) for s in spans.to_pylist()[0]] == [("en", text[:15]), ("zh", text[15:22]), ("ru", text[22:])]
