"""Letters and scripts over all of Unicode."""

import numpy as np

from rewardforge.llm import language


def learn(**texts):
    """A model of one text per language."""
    langs = sorted(texts)
    made = []
    for lang in langs:
        cp = language._code_points(texts[lang])
        _, cells, _, scripts = language._trigrams(cp, language._is_letter(cp))
        made.append(np.r_[np.bincount(cells, minlength=language.CELLS), np.bincount(scripts, minlength=language.N_SCRIPTS)])
    table = np.stack(made, axis=1)
    return language.LanguageModel(langs, table[: language.CELLS], table[language.CELLS :])


def script(char):
    return language.SCRIPT_NAMES[np.searchsorted(language.SCRIPT_STARTS, ord(char), side="right") - 1]


def test_letters_and_scripts_beyond_the_basic_plane():
    cp = np.array([ord(c) for c in "a😀𝄞𠀀\U0010ffffش"], dtype=np.uint32)
    assert language._is_letter(cp).tolist() == [True, False, False, True, False, True]
    want = {"😀": "other", "𝐀": "other", "Ａ": "latin", "ｚ": "latin", "ｱ": "kana", "ﾡ": "hangul", "ﷲ": "arabic", "ﻻ": "arabic", "ﬁ": "latin", "\ufb2a": "hebrew", "𠀀": "han"}
    assert {c: script(c) for c in want} == want


def test_emoji_are_no_letters():
    model = learn(de="hund geht nach hause " * 40, fr="chien rentre maison " * 40)
    arabic = learn(ar="كتاب مدرسة بيت " * 40, de="hund geht nach hause " * 40)
    for m in (model, arabic):
        assert language._label(m, ["😀🎉 🚀", "😀", "\U0001f1e9\U0001f1ea"], language.SWITCH_COST) == [("und", 0.0, [])] * 3
    text = "hund geht😀 nach🎉hause"
    got = language._label(arabic, [text], language.SWITCH_COST)[0]
    assert got == ("de", 1.0, [{"lang": "de", "start": 0, "end": len(text)}])
    assert len(model.words(language._code_points(text))[0]) == 4 and model.words(language._code_points("geht😀"))[1].tolist() == [4]


def test_more_languages_than_a_byte_holds():
    wanted = [150, 150, 3, 199, 199]
    scores = np.full((len(wanted), 200), -50.0, dtype=np.float32)
    scores[np.arange(len(wanted)), wanted] = 0.0
    assert language.viterbi([scores], 4.0)[0].tolist() == wanted
