import pytest
from pyspark.sql import functions as F

from factloom.llm import sentences


def cut(text, lang=None):
    return [text[a:b] for a, b in sentences.spans(text, lang)]


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["See Fig. 3 and Eq. (2) for it, i.e. at 4.5 steps.[12]", "Dr. A. Foo et al. report 3 p.m. vs. 4 a.m. in it.", "p3 levels stay etc.", "5.2 of them do!"]),
        ("en", ["Reviewers asked: “Does it hold? Is 2.9 real?” and we repeated it.", "Foo asked, “Is it late?”", "He left."]),
        ("en", ["All were re-read ... and kept.", "The U.S. arm fell by 3% (cf. Sec. 2.1).", "Next one"]),
        ("de", ["Am 18. März kam z. B. die Nr. 5 (vgl. Abb. 2) hinzu.", "Prof. Dr. Foo u. a. melden ca. 3,5 %, d. h. mehr.", "„Sie ist da. Mehr nicht“, schrieb er."]),
        ("fr", ["Voir la fig. 6 : il monte d’env. 3,2 % !", "M. Foo et le Dr. Bar, p. ex., c.-à-d. eux.", "« Le seuil reste. Rien ne change », note Foo."]),
        ("es", ["En EE. UU. el núm. 9 quedó, p. ej. así.", "¿Basta la fig. 2?", "¡Sí!", "La Dra. Foo y el Sr. Bar van."]),
        ("ru", ["В 540 г. для него взяли, напр. это, т. е. мало.", "«он не важен. Важен тот», — пишет Иванов.", "См. рис. 5, где А и др. сравнивают."]),
        ("ar", ["كتب Foo: «العينة هي المبكرة. لا حاجة» عن Bar بقيمة 44.9.", "راجع د. Foo نحو 3.2 سجل.", "هل تكفي؟"]),
        ("hi", ["“नमूना बड़ा है। Foo नहीं चाहिए”, Bar ने लिखा।", "डॉ. Baz ने 3.5 देखा।", "क्या है?"]),
    ],
)
def test_spaced_scripts(lang, parts):
    assert cut(" ".join(parts), lang) == parts
    assert cut("  " + "\n".join(parts) + " \n", lang) == parts  # line breaks are spaces


def test_names_that_end_like_abbreviations():
    parts = ["Sin embargo, bajó con Sixbafield-M.", "La Dra. Foo usa Vozba-S.", "¿Basta el Foo+?", "Luego sí."]
    for lang in ("es", "en", None):
        assert cut(" ".join(parts), lang) == parts
    assert cut("M. Foo arrive.", "fr") == ["M. Foo arrive."] and cut("It is in group M. Next it was S. That was all.", "en") == ["It is in group M. Next it was S. That was all."]
    assert cut("We took the arm z. The next one was h. That was it.", "en") == ["We took the arm z.", "The next one was h.", "That was it."]


def test_straight_quotation_marks():
    assert cut('He said "It works. Really well." and left. Then "no." She stayed.') == ['He said "It works. Really well." and left.', 'Then "no."', "She stayed."]
    assert cut('A 5" disk. It is 3" wide. So') == ['A 5" disk.', 'It is 3" wide.', "So"]
    long = "It works. " * 60
    assert len(cut(f"He said “{long}")) == 1 and len(cut(f"He said “this\n\n{long}")) > 50


def test_years_and_decimals():
    assert cut("So it was (see Smith et al. 2020). Next Foo et al. (2019) said it.") == ["So it was (see Smith et al. 2020).", "Next Foo et al. (2019) said it."]
    assert cut("It was 0.5. alpha was 0.2. The v2.1 kit") == ["It was 0.5.", "alpha was 0.2.", "The v2.1 kit"]


def test_unspaced_scripts():
    parts = ["共有5个来自Foo（v2.1）……其余稳定。", "Foo写道：“样本是晚期的。不需要它。”并重复了3次。", "够吗？", "见图3！"]
    assert cut("".join(parts), "zh") == parts
    parts = ["Fooは「投与群は安定だ。Barは要らない。」と述べた。", "図6のとおり効く！", "終わり"]
    assert cut("".join(parts), None) == parts
    parts = ["Foo ได้ค่า 0.62 บน Bar อยู่ 59.7 จุด", "นอกจากนี้มันลด ร้อยละ 8.0 จาก Baz จำนวน 6 ครั้ง", "รูปที่ 529 แสดงว่า Foo ลดใน Bar ถึง 44.6", "Qux ตรวจจำนวน 6 รายการของ Foo ที่ 2.86"]
    assert cut(" ".join(parts), "th") == parts


def test_lost_space_and_rest():
    assert cut("It ends in N-7B.The next one. And a cut-off re") == ["It ends in N-7B.", "The next one.", "And a cut-off re"]
    assert cut("Value 3.5 stays. v2.Next") == ["Value 3.5 stays.", "v2.", "Next"]


def test_odd_values(gold):
    df = gold({"context": None}, {"context": ""}, {"context": " \n "}, {"context": "One. Two.", "lang": "EN"}, {"context": "One. Two.", "lang": "xx"}, {"context": "A b. " * 20_000})
    df = df.select("*", *[F.lit("q").alias(c) for c in ("k", "t", "l", "start_pos")])
    got = sentences.sentences(df).groupBy("row_id").count().collect()
    assert {r.row_id: r["count"] for r in got} == {4: 2, 5: 2, 6: 20_000}
    assert sentences.sentences(df.limit(0)).count() == 0


def test_spans_cover_the_text():
    text = "Ein Satz. „Noch einer. Und“ mehr.  Ende\n\n# Titel\n\nText. 完了。了"
    got = sentences.spans(text, "de")
    inside = "".join(text[a:b] for a, b in got)
    assert "".join(inside.split()) == "".join(text.split())
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:], strict=False))
