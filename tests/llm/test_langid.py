from __future__ import annotations

from collections import Counter

from veritally.llm import langid

ENGLISH = "the quick brown fox jumps over the lazy dog and then it was all that they could have done with this".split()
GERMAN = "der schnelle braune fuchs springt nicht auf den faulen hund und dann war das alles was wir machen konnten".split()


def model() -> langid.Model:
    han = {"zh": "我们今天去学校读书然后回家吃饭", "ja": "私達毎日電車会社行仕事終後帰"}
    return langid.Model({"en": Counter(dict.fromkeys(ENGLISH, 50)), "de": Counter(dict.fromkeys(GERMAN, 50))} | {k: Counter({langid.features_of(p): 50 for p in langid.pieces((v * 3).encode())}) for k, v in han.items()})


def test_words_joined_by_other_blanks_and_marks_are_words():
    own = model()
    for joint in " ", "　", "，", "—":
        text = joint.join(ENGLISH[:12] + GERMAN * 3)
        assert own.predict(text) == own.predict(" ".join(ENGLISH[:12] + GERMAN * 3))
        assert own.predict(text)[0] == "de"


def test_language_changes_inside_a_run_without_blanks():
    own = model()
    chinese, japanese = "我们今天去学校读书然后回家吃饭" * 6, "私達毎日電車会社行仕事終後帰" * 12
    lang, share = own.predict(chinese + japanese)
    assert lang == "ja" and abs(share - len(japanese) / len(chinese + japanese)) < 0.1
    labels, weights = own.label((chinese + japanese).encode().split())
    assert len(set(labels.tolist())) == 2 and weights.sum() == len(chinese + japanese)
    assert len(labels) == len(langid.words_of(chinese + japanese))


def test_every_ngram_of_a_long_run_is_in_one_piece():
    letters = "".join(chr(97 + i * i % 26) for i in range(171))
    got = Counter(g for p in langid.pieces(letters.encode()) for g in langid.ngrams(langid.features_of(p)))
    assert got == Counter(langid.ngrams(letters)[:-1])
    assert sum(langid.weight_of(langid.features_of(p)) for p in langid.pieces(letters.encode())) == 171


def test_junk_of_letters_has_no_support():
    own = model()
    own.floor = 0.5
    assert own.keeps(" ".join(ENGLISH)) and own.keeps(" ".join(GERMAN)) and own.keeps("我们今天去学校读书")
    assert not own.keeps("xq zvkj wqx jjkq vzzx qkw") and not own.keeps("12 34") and not own.keeps(None)
    assert own.support(" ".join(ENGLISH)) > own.support("the xq zvkj wqx") > own.support("zvkj wqx qqq")
    blank = langid.Model({})
    assert blank.keeps("any letters") and not blank.keeps("12") and not blank.keeps("")


def test_words_split_at_changes_of_script():
    assert [p.decode() for p in langid.pieces("abcпривет漢字かな".encode())] == ["abc", "привет", "漢字", "かな"]
    assert langid.pieces("déjà".encode()) == ["déjà".encode()]


def test_rows_of_many_words_are_those_of_each_ngram_in_order():
    own = model()
    words = [*ENGLISH, *GERMAN, "我们今天去学校", "x", "é", "th\u0000e q", " theq\u0000uic", "straße"]
    rows, sizes = own._rows(words)
    ends = sizes.cumsum()
    for x, end, n in zip(words, ends.tolist(), sizes.tolist(), strict=True):
        grams = langid.ngrams(x)
        assert n == len(grams)
        for g, row in zip(grams, rows[end - n : end].tolist(), strict=True):
            known = own.logs[row].any() or row < len(own.logs) - 1
            assert known == any(g in langid.ngrams(w) for counts in (ENGLISH, GERMAN) for w in counts) or any(c > "　" for c in g)


def test_words_of_several_texts_are_scored_together(monkeypatch):
    texts = [" ".join(ENGLISH), " ".join(GERMAN), "12 3a4 b", "", "我们今天去学校读书" * 9, "der,die déjà " * 9]
    alone, together, calls = model(), model(), []
    lists = [t.encode().translate(langid.ALNUM_BYTES).split() for t in texts]
    monkeypatch.setattr(langid, "LEARNED", 7)
    together.meet(lists)
    monkeypatch.setattr(together, "_learn", lambda words: calls.append([w for w in words if b"\0" not in w and w.isascii()]))
    assert list(map(alone.predict, texts))[:4] == list(map(together.told, lists[:4])) and not any(calls)
    monkeypatch.undo()
    assert list(map(alone.predict, texts)) == list(map(together.told, lists))
    assert list(map(alone.support, texts)) == list(map(together.support, texts))
    monkeypatch.setattr(langid, "MAX_WORDS", 5)
    together.meet(lists)
    assert list(map(alone.predict, texts)) == list(map(together.told, lists))
