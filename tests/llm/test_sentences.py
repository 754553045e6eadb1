"""Sentence boundaries."""

import pytest

from factloom.llm.sentences import nonspace_ends, sentence_ends, sentences, spans

CASES = [
    ["The filing was prepared by Pennaval Ltd.", "Did it fail, or was it ‘audited’ from the start?", "Margaret B. Rake said so."],
    ["Advisers (e.g. J. Toldovic and St. Yamorena & Co.) agreed.", "The U.S. office grew vs. the plan.", "The gates close at 9 p.m.", "In Pellhaven, it was 9:34 p.m. IST on Monday."],
    ['"The operator carried out!" wrote Mrs. Ostelund.', "(A fuller account is given in Annex 6.)", "A review came."],
    ["Am 9. März 2017 begann der Betrieb.", "Die Wartung, z. B. an Anlage Nr. 3, lief.", "Der Ausschuss prüfte u. a. die Verträge."],
    ["« La saison sera calme », a indiqué Mme Grenholt.", "Le délai sera-t-il respecté ?", "Selon M. Dufrayne, voir l'art. 3."],
    ["Sambarova asked: “Will it recover?”", "The 5.78 Gwh.", "The x of 2.10 crore sq. ft.", "The end."],
    ["قال المدير: «نحن راضون».", "وصل نحو 560 طلب.", "هل يكفي؟", "نعم"],
]


@pytest.mark.parametrize("want", CASES)
def test_with_blanks(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in spans(text)] == want


@pytest.mark.parametrize("want", [["他说：“我们满意。”", "指数从4.5升至1.2。", "完"], ["担当者は「満足している」と述べました。", "在庫は？", "Inc.の売"]])
def test_without_blanks(want):
    text = "".join(want)
    assert [text[a:b] for a, b in spans(text)] == want


def test_lines_thai_and_nothing():
    assert [n for n in nonspace_ends(" a.\n\n \nb c\nd")] == [2, 4]
    assert nonspace_ends("A b.\nc d", line_ends=False) == []
    assert nonspace_ends("สวัสดี ครับ\nดี") == [6, 10]
    assert nonspace_ends(None) == nonspace_ends("") == nonspace_ends(" \n ") == [] == spans(None)


def test_very_long_texts():
    text = "(" * 20000 + " One two. Three four." * 20000
    assert len(nonspace_ends(text)) == 39999


def test_offsets_count_no_blanks(spark):
    rows = [("a", "One two. Three  four. Five"), ("a", "One two. Three  four. Five"), ("b", None), (None, "A. B"), ("c", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert sorted(map(tuple, sentence_ends(df, "id", "text", True).collect())) == [("a", 7), ("a", 17)]
    assert sorted(map(tuple, sentences(df, "id", "text", True).select("sentence_no", "sentence").collect())) == [(1, "One two."), (2, "Three  four."), (3, "Five")]
