import pytest

from sparkloka.llm.sentences import segment, sentences

CASES = [
    ("id", "Dr. Ana buka di Jl. Mawar No. 5, dll. yang enak.|Murah!|Sudah pkl. 06.30 s.d. 21.00."),
    ("id", "Ada bakso, soto, dll.|Habis hujan, jalan becek... makanya sepi."),
    ("id", '"Enak sekali! Mantap." teriak Budi pertama.|Harga Rp. 56.000, murah...|Katanya tutup.'),
    ("id", "tetap juara! 🔥🔥|kemarin, transfernya a.n. budi, bukan ke rekening."),
    ("id", "sambil tertawa.|Aplikasi kasir masih ver. 4.3.5 (bosan! sekali) terus."),
    ("id", "Judul tanpa titik\n\n|Baris satu\nbaris dua."),
    ("id", "Baris satu\r\nmasih sama.\r\n \r\n|Baru."),
    ("id", "Cek a.example/menu?id=83 atau info@b.example ya. |Kata A. Budi begitu."),
    ("id", "yang dijual es, dll. yg murah. |menunya soto, dll. |habis."),
    ("en", 'Mr. X et al. came at 7.30 a.m. and left.|"Is it fresh?" asked Yudi.|Why e.g. now?! |It opened at 9 a.m.|Then it closed.'),
    ("de", "„Ist das frisch?“, fragte Xaver.|Am 12. Juni z.B. usw. für wenig Geld.|Es gibt Tee usw.|Gut!"),
    ("nl", 'Je vindt er thee, koek enz.|"Is dat vers?" vroeg Y, o.a. omdat mevr. Z kwam.'),
    ("ru", "Там рис и т.д. по низкой цене.|«Это свежее?» — спросил Xano.|В 2024 г. на ул. Y, д. 5 открыли.|Принесли рис.|Там чай и т.д.|Закрыто."),
    ("zh", "老板娘说：“今天卖完了。明天再来吧。”|“新鲜吗？”客人问X的老板。|有汤……等等（周日休息！），不错。😍|好！"),
    ("ja", "店長は「売り切れです。また来てください。」と言いました。|「新鮮ですか？」と客が聞きました。|麺、抹茶…など。"),
    ("th", "ร้าน Abc บริการช้ามาก |ต้องรอ 29 นาที |อร่อยมาก 👍🏽 |ถูก"),
    ("ar", "قال: «نفدت. تعالوا غدًا».|يقول د. رامون نعم.|«هل هذا طازج؟» سأل الزبون."),
    ("hi", 'मालिक ने कहा, "आज सब बिक गया। कल आइए।"|डॉ. रमोन ने बताया।|"क्या यह ताज़ा है?" ग्राहक ने पूछा।'),
]


@pytest.mark.parametrize("lang, marked", CASES)
def test_boundaries(lang, marked):
    parts = marked.split("|")
    text = "".join(p if p.endswith(("\n", " ")) or lang in ("zh", "ja") or (i + 1 < len(parts) and p.endswith("tertawa.")) else p + " " for i, p in enumerate(parts))
    got = [text[a:b] for a, b in segment(text, lang)]
    assert got == [p.strip() for p in parts]


@pytest.mark.parametrize("text", [None, "", "  \n\n ", "tanpa tanda", "?!", '"belum tutup. Ya', "((( a. B", "x" * 300_000, "A. " * 20_000])
def test_all_but_white_space_is_covered(text):
    spans = segment(text, None)
    kept = "".join((text or "")[a:b] for a, b in spans)
    assert "".join(kept.split()) == "".join((text or "").split())
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_frame(spark):
    rows = [(1, "Aa bb. Cc dd.", "id", 0), (2, None, None, 0), (3, "", "xx", 0), (3, "E.", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, sent_start int")
    assert sorted(tuple(r) for r in sentences(df).collect()) == [(1, 0, 6), (1, 7, 13), (3, 0, 2)]
    assert sentences(df.limit(0)).count() == 0 and sentences(df.select("doc_id", "text")).count() == 3
