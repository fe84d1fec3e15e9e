"""Wrongly decoded text: clean text of many languages, exact round trips, and the tables."""

from __future__ import annotations

import pytest

from quarrylight.llm import catalog, encoding
from tests.conftest import rows

with open(encoding.MODEL, "rb") as _f:
    REPAIRER = encoding.repairer(_f.read())
REPAIR = REPAIRER.repair

CLEAN = [
    "Le théâtre brûlé coûte 350 € à Kalarman, où l’été ferme déjà la forêt.",
    "Für die Größe der Straße müßte man zunächst prüfen, ob es schön ist.",
    "¿Dónde está la montaña? Así que la lección quedó española y rápida.",
    "ATENÇÃO: A ESTAÇÃO NÃO fecha até amanhã, então há coleção.",
    "Właściciel żółw mówi, że wieś jest ciężka i późna, koło łąki.",
    "Новая мельница в городе была закрыта после долгой зимы.",
    "Η παλιά γέφυρα κοντά στην πόλη είναι πάντα ήσυχη.",
    "The Ðorrin and Þelva dialects keep the sounds æ and â apart 🙂.",
    "At √2 ≈ 1.414 the ±2 °C range of the gauge is reached, see § 4.",
    "Sizes up to 5×7 cm fit the naïve layout of the İzel press of Røsinnor.",
    "The menu of the café lists a crème brûlée for £6 and a naïve jalapeño dip.",
    "It’s the keeper’s “first” loom — and the city of Zelusvèn or Elettâ then waits.",
    "Prices start at €12 – roughly ½ of what the ÂGE D’OR line asked before.",
    "D’après la matière, l’été reste créé même si la forêt dépasse.",
]


def misread(text, read_as):
    return "".join(encoding._TABLES[read_as][b] for b in text.encode())


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert REPAIR(text) == (False, text, 0)


@pytest.mark.parametrize("read_as", ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"])
@pytest.mark.parametrize("text", CLEAN[:7])
def test_utf8_round_trip(text, read_as):
    assert REPAIR(misread(text, read_as)) == (True, text, 1)


@pytest.mark.parametrize("text", CLEAN[:5])
def test_two_layers(text):
    assert REPAIR(misread(misread(text, "cp1252"), "cp1252"))[:2] == (True, text)


@pytest.mark.parametrize(("text", "written_in", "read_as"), [(CLEAN[0], "cp1252", "mac_roman"), (CLEAN[1], "cp1252", "cp1251"), (CLEAN[2], "cp1252", "cp1251"), (CLEAN[4], "cp1250", "cp1252"), (CLEAN[5], "cp1251", "cp1252"), (CLEAN[5], "koi8-r", "cp1251")])
def test_other_encodings(text, written_in, read_as):
    garbled, restored, _ = REPAIR(text.encode(written_in).decode(read_as))
    assert garbled and restored == text


def test_part_of_a_text_and_lost_characters():
    both = CLEAN[0] + " " + misread(CLEAN[2], "cp1252")
    assert REPAIR(both)[:2] == (True, CLEAN[0] + " " + CLEAN[2])
    for lost in ("As� que la lecci�n", "The clerk�s house", "The old scholar of the town doesnât need it at the end of the day", "müÃte die StraÃe zÃ¤hlen"):
        assert REPAIR(lost)[0]


def test_encoding_edges(spark):
    long = misread(CLEAN[0] + " ", "cp1252") * 3000
    data = [(1, None, "x"), (2, "", "x"), (3, misread(CLEAN[1], "cp1252"), None), (3, misread(CLEAN[1], "cp1252"), None), (None, "a", "b"), (4, long, "x")]
    df = spark.createDataFrame(data, "line_no bigint, text string, restored string")
    found = rows(encoding.repair_encoding(df).select("line_no", "garbled", "layers"))
    assert found == sorted([(1, False, 0), (2, False, 0), (3, True, 1), (3, True, 1), (None, False, 0), (4, True, 1)], key=repr)
    assert encoding.repair_encoding(df.limit(0)).count() == 0


#: Text of languages, scripts and signs, looked at while the operators were made; for others see ``test_held_out``.
OTHERS = {
    'japanese': '昨日は友達と一緒に、駅前の小さな喫茶店でコーヒーを飲みながら、来年の旅行について話しました。',
    'chinese': '我们昨天在图书馆里读了一本关于古代历史的书，觉得非常有意思。',
    'korean': '우리는 어제 도서관에서 오래된 역사책을 읽었고, 매우 재미있다고 생각했습니다.',
    'arabic': 'ذهبنا أمس إلى المكتبة وقرأنا كتابًا قديمًا عن تاريخ المدينة.',
    'hebrew': 'אתמול הלכנו לספרייה וקראנו ספר ישן על ההיסטוריה של העיר.',
    'hindi': 'कल हम पुस्तकालय गए और शहर के इतिहास के बारे में एक पुरानी किताब पढ़ी।',
    'thai': 'เมื่อวานเราไปห้องสมุดและอ่านหนังสือเก่าเกี่ยวกับประวัติศาสตร์ของเมือง',
    'vietnamese': 'Hôm qua chúng tôi đến thư viện và đọc một cuốn sách cũ về lịch sử của thành phố.',
    'ukrainian': 'Вчора ми ходили до бібліотеки й читали стару книжку про історію міста. Він її ще не бачив у Києві.',
    'turkish': "Dün kütüphaneye gittik ve şehrin tarihi hakkında eski bir kitap okuduk; çocuğun ağabeyi İstanbul'da yaşıyor.",
    'czech': 'Příliš žluťoučký kůň úpěl ďábelské ódy. Včera jsme šli do knihovny a četli starou knihu.',
    'slovak': 'Včera sme išli do knižnice a čítali sme starú knihu o dejinách mesta, ktorá bola veľmi dôležitá.',
    'romanian': 'Ieri am fost la bibliotecă și am citit o carte veche despre istoria orașului, când încă ploua și țipau copiii.',
    'hungarian': 'Az őszi hűvös szél fúj, és a könyvtárban egy régi könyvet olvastunk a város történetéről.',
    'italian': "È già così tardi? Perché non c'è più caffè nella città, né può esserci.",
    'dutch': 'De coördinatie van de zeeën en één geïnteresseerde reünie; hij zei: «ja, hóór».',
    'finnish': 'Eilen kävimme kirjastossa ja luimme vanhan kirjan kaupungin historiasta, jossa hän pyysi lisää äänekkäästi.',
    'swedish': 'Igår gick vi till biblioteket och läste en gammal bok om stadens historia på Åland i två månader.',
    'danish': 'I går gik vi på biblioteket og læste en gammel bog om byens historie på øen Ærø.',
    'icelandic': 'Í gær fórum við á bókasafnið og lásum gamla bók um sögu bæjarins; það var ágætt þótt Þórður væri þreyttur.',
    'irish': 'Poblacht na hÉireann: bhí an tÚdarás i nGaillimh, agus dúirt sé go raibh sé ró-mhall.',
    'welsh': "Mae'r tŷ ar lan y môr â'r tân ynghynn, a dŵr oer yn yr afon gyda chi mân.",
    'catalan': 'El col·legi il·lustra la paral·lela: ahir vam llegir un llibre antic sobre la història de la ciutat.',
    'lithuanian': 'Vakar ėjome į biblioteką ir skaitėme seną knygą apie miesto istoriją, kuri buvo labai įdomi ąžuolų šešėlyje.',
    'latvian': 'Vakar mēs gājām uz bibliotēku un lasījām vecu grāmatu par pilsētas vēsturi, kas šķita ļoti gaŗa.',
    'croatian': 'Jučer smo išli u knjižnicu i čitali staru knjigu o povijesti grada, što je bilo vrlo važno i đavolski teško.',
    'bulgarian': 'Вчера ходихме в библиотеката и четохме стара книга за историята на града.',
    'serbian': 'Јуче смо ишли у библиотеку и читали стару књигу о историји града, што је било врло важно.',
    'persian': 'دیروز به کتابخانه رفتیم و کتابی قدیمی دربارهٔ تاریخ شهر می\u200cخواندیم.',
    'georgian': 'გუშინ ბიბლიოთეკაში წავედით და ქალაქის ისტორიის შესახებ ძველი წიგნი წავიკითხეთ.',
    'armenian': 'Երեկ գնացինք գրադարան և կարդացինք քաղաքի պատմության մասին հին գիրք։',
    'esperanto': 'Hieraŭ ni iris al la biblioteko kaj legis malnovan libron pri la historio de la urbo, ĉar ĝi ŝajnis ĵus aperinta.',
    'yoruba': 'Ọjọ́ kan ni ọ̀rẹ́ mi lọ sí ilé ìwé, ó sì ka ìwé àtijọ́ nípa ìtàn ìlú náà.',
    'portuguese': '—É verdade que não há pão? —Ontem fomos à biblioteca e lemos um livro antigo sobre a história da cidade; então são três.',
    'russian capitals': 'ВЧЕРА МЫ ХОДИЛИ В БИБЛИОТЕКУ. Её подъём ещё не начался, и моё объявление исчезло.',
    'check marks': 'Install the package ✓ then restart → done; see № 5 and the ★ rating of the ☕ shop.',
    'ipa': 'The word is said /ˈwɔːtə/ or [ˈwɑɾɚ], and thing is /θɪŋ/ in most of the dialects.',
    'mathematics': 'Let α ∈ ℝ and ε > 0; then ∀x ∃δ: |f(x) − f(y)| ≤ ε·‖x‖² with ΔT ≈ 5 µm and Σxᵢ.',
    'dashes': 'It was late—very late—and the well…known keeper said it was 5–10 °C at 37°, £5/€6 or ½ of that…perhaps.',
    'polish': 'Żółć, ŁÓDŹ i źdźbło: wczoraj poszliśmy do biblioteki, żeby przeczytać starą książkę o historii miasta.',
}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_no_language_is_garbled(name):
    assert REPAIR(OTHERS[name]) == (False, OTHERS[name], 0)


def test_misread_languages_are_restored():
    """UTF-8 of every language read in every encoding: all are found, and 98 in 100 come back exactly."""
    found = [(REPAIR(misread(t, r)), t) for t in OTHERS.values() for r in encoding.READ_AS]
    assert all(g for (g, _, _), _ in found)
    assert sum(restored == t for (_, restored, _), t in found) >= 0.98 * len(found)


def test_single_byte_misreads():
    """Text of one single-byte encoding read as another, where signs or scripts show it."""
    hits = exact = n = 0
    for text in OTHERS.values():
        for written_in in encoding.WRITTEN_IN[1:]:
            for read_as in encoding.READ_AS:
                try:
                    other = "".join(encoding._TABLES[read_as][b] for b in text.encode(written_in))
                except UnicodeEncodeError:
                    continue
                if other != text and read_as != written_in:
                    garbled, restored, _ = REPAIR(other)
                    n, hits, exact = n + 1, hits + garbled, exact + (restored == text)
    assert n > 100 and hits >= 0.8 * n and exact >= 0.6 * n


def test_planted_in_the_tables(spark, small):
    """Clean texts of the collection, read wrongly, come back as they were."""
    texts = [r["text"] for r in encoding.beyond_ascii(spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/collection.parquet")).select("text").collect()]
    clean = [t for t in texts if REPAIR(t) == (False, t, 0)]
    assert len(clean) > 500
    for read_as in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"):
        found = [(REPAIR(misread(t, read_as)), t) for t in clean]
        assert sum(g for (g, _, _), _ in found) >= 0.995 * len(found), read_as
        assert sum(restored == t for (_, restored, _), t in found) >= 0.97 * len(found), read_as


def test_queries_agree(spark, small):
    """What is restored is found, and a restored text is clean when it is looked at again."""
    found = {r[0] for r in catalog.p1_found(spark, small).collect()}
    restored = catalog.p1_restored(spark, small).collect()
    texts = dict(rows(spark.read.parquet(f"{small}/collection.parquet").select("line_no", "text")))
    assert found and restored and {r["line_no"] for r in restored} <= found
    assert all(REPAIR(texts[r["line_no"]]) == (True, r["restored"], r["layers"]) for r in restored)
    assert sum(REPAIR(r["restored"])[0] for r in restored) <= 0.02 * len(restored)
