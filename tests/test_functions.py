import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import times

H, D = 3600, 86400


@pytest.mark.parametrize("seconds,words", [
    (4, "a few seconds"), (5, "5 seconds"), (44, "44 seconds"), (45, "a minute"), (89, "a minute"), (90, "a minute"), (119, "a minute"), (120, "2 minutes"), (44 * 60, "44 minutes"), (45 * 60, "an hour"), (89 * 60, "an hour"), (90 * 60, "an hour"),
    (21 * H, "21 hours"), (22 * H, "a day"), (35 * H, "a day"), (36 * H, "a day"), (8 * D, "a week"), (9 * D, "9 days"), (25 * D, "25 days"), (26 * D, "a month"), (32 * D, "a month"), (33 * D, "a month"), (60 * D, "2 months"), (300 * D, "10 months"), (330 * D, "a year"), (17 * 30 * D, "a year"), (18 * 30 * D, "2 years"),
])
def test_relative_time(spark, seconds, words):
    assert spark.range(1).select(times.relative_time(F.lit(seconds))).first()[0] == words


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_labels(spark):
    assert one(spark, times.due_label(F.lit(-5))) == "5 seconds ago" and one(spark, times.due_label(F.lit(7200))) == "in 2 hours" and one(spark, times.due_label(F.lit(0))) == "right now"
    assert one(spark, times.poll_interval(F.lit(10))) == 10 and one(spark, times.poll_interval(F.lit(-1000))) == 200 and one(spark, times.poll_interval(F.lit(2 * D))) is None
    assert [one(spark, times.refresh_interval(F.lit(x).cast("long"))) for x in (None, 1, 30, 500)] == [60, 10, 30, 60]
    assert one(spark, times.decoration_colour(F.lit(True), F.lit("Learning"))) == "rgb(153 27 27)" and one(spark, times.decoration_colour(F.lit(False), F.lit(None).cast("string"))) is None
    assert one(spark, times.reading_position(F.lit(1), F.lit(3))) == "33.3%"


def test_text(spark):
    assert one(spark, T.katakana_to_hiragana(F.lit("カタヶーヷ漢a"))) == "かたゖーヷ漢a"
    assert [one(spark, T.is_ideograph(F.lit(x))) for x in ("漢", "々", "〇", "𠮷", "a")] == [True, False, False, True, False]
    assert one(spark, T.is_japanese(F.lit("漢字かなカナー々"))) and not one(spark, T.is_japanese(F.lit("漢a"))) and not one(spark, T.is_japanese(F.lit("")))
    assert one(spark, T.count_japanese(F.lit("漢a字、か"))) == 3
    assert one(spark, T.is_punctuation(F.lit("。"))) and not one(spark, T.is_punctuation(F.lit("。。")))
    assert one(spark, T.clean_title(F.lit("本（一）【二】。三"), F.lit("h"))) == "本" and one(spark, T.clean_title(F.lit(None).cast("string"), F.lit("h"))) == "h"
    assert one(spark, T.lemma_spelling(F.lit("a-b-c"))) == "a" and one(spark, T.lemma_disambiguation(F.lit("a-b-c"))) == "b-c" and one(spark, T.lemma_disambiguation(F.lit("a"))) is None
    assert one(spark, T.null_if_blank(F.lit("*"))) is None and one(spark, T.html_escape(F.lit("<a&'/\">"))) == "&lt;a&amp;&#x27;&#x2F;&quot;&gt;"
    assert one(spark, T.uuid_of(F.lit(258))) == "00000000-0000-0000-0000-000000000102"
    assert one(spark, T.normalised_path(F.lit("a/./b/../c"))) == "a/c" and one(spark, T.normalised_path(F.lit("/../a"))) == "/a"
    assert one(spark, T.dictionary_language(F.lit("旺文社"))) == "ja"
