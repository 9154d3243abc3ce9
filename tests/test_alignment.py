from lexmill.operators.alignment import annotate, annotated, candidate_readings, common_readings, coverage, kana_match, morphemes

KANJI = {"劇": ["げき"], "場": ["じょう", "ば"], "版": ["はん"], "化": ["か", "け", "ば.ける"], "粧": ["しょう"], "山": ["さん", "やま"], "人": ["じん", "ひと"], "口": ["こう", "くち"], "行": ["いく", "ゆ.く", "こう"], "煩": ["わずら.わす"], "民": ["みん"], "主": ["しゅ"], "学": ["がく"], "校": ["こう"]}


def spans(spelling, reading):
    status, found = annotate(spelling, reading, KANJI)
    return status, [(s.spelling, s.reading) for s in found]


def test_samples():
    assert spans("劇場版", "げきじょうばん") == ("Valid", [("劇", "げき"), ("場", "じょう"), ("版", "ばん")])
    assert spans("化粧", "けしょう") == ("Valid", [("化", "け"), ("粧", "しょう")])
    assert spans("山々", "やまやま") == ("Valid", [("山", "やま"), ("々", "やま")])
    assert spans("人人", "ひとびと") == ("Valid", [("人", "ひと"), ("人", "びと")])
    assert spans("煩わす", "わずらはす") == ("Valid", [("煩", "わずら"), ("わ", "は"), ("す", "す")])
    assert spans("を格", "ヲカク") == ("Valid", [("を", "を"), ("格", "カク")])
    assert spans("学校", "がっこう") == ("Valid", [("学", "がっ"), ("校", "こう")])
    assert spans("民主主", "みんしゅしゅ") == ("Valid", [("民", "みん"), ("主", "しゅ"), ("主", "しゅ")])


def test_statuses():
    assert annotate("abc", "あ", KANJI)[0] == "Invalid"
    assert annotate("", "", KANJI)[0] == "Invalid"
    assert annotate("々山", "さん", KANJI)[0] == "IterationMark"
    assert annotate("か", "き", KANJI)[0] == "Unknown"
    assert annotate("山", "", KANJI)[0] == "Unknown"
    assert annotate("山" * 12 + "か", "さん" * 30 + "き", {})[0] == "Unknown"  # wildcards everywhere, and yet soon over


def test_match_kinds():
    assert kana_match("は", "ぱ", "start") == "Voicing" and kana_match("は", "ぱ") is None
    assert kana_match("つ", "っ", "end") == "Glottalisation" and kana_match("す", "し", "end") == "Stem"
    assert kana_match("お", "を") == "OldKana" and kana_match("う", "ー") == "LongVowelMark" and kana_match("ケ", "が") == "KatakanaGa"
    assert kana_match("*", "ん") == "Wildcard" and kana_match("あ", "あ") == "Identical"


def test_candidates():
    assert candidate_readings(["た.べる", "ショク", "-ば.ける"], 2) == ["たべる", "ショク", "ばける", "たべ", "ばけ", "た", "ば", "*", "**"]


def test_tables(spark):
    words = spark.createDataFrame([("1", "劇場版", "げきじょうばん"), ("2", "abc", "あ"), ("3", None, "あ"), ("4", "山", None), ("1", "劇場版", "げきじょうばん")], "variant_id string, spelling string, reading string").selectExpr("*", "1 as status")
    a = annotated(words, KANJI)
    assert sorted((r.variant_id, r.status or "") for r in a.collect()) == [("1", "Valid"), ("1", "Valid"), ("2", "Invalid"), ("3", ""), ("4", "")]
    assert sorted((r.morpheme_index, r.spelling, r.reading, r.underlying_reading) for r in morphemes(a).collect()) == [(0, "劇", "げき", "げき"), (1, "場", "じょう", "じょう"), (2, "版", "ばん", "はん")]
    assert {r.status: r.words for r in coverage(a).collect()} == {"Valid": 2, "Invalid": 1, "None": 2}
    assert [(r.spelling, r.times) for r in common_readings(a, 2).collect()] == [("劇", 2), ("場", 2), ("版", 2)]
    assert annotated(words.limit(0), KANJI).count() == 0
