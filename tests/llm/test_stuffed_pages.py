import random

import numpy as np
import pytest

from terrakite.llm.stuffed_pages import Lexicon, Structure, curves, found_pages, language, spectra, stuffed_pages


@pytest.fixture(scope="module")
def structure():
    return Structure()


STUFFED = [
    "cheap lidar kit, buy scan app, best tripod price, " * 10,
    "\n".join(f"https://www.place{i}.example/item/{i}?ref=9" for i in range(20)),
    "#tripod #lidar_kit #scanapp #maps " * 8,
    "<tag>tripod</tag> <tag>lidar</tag> " * 12,
    "SKU A1234 | lidar kit | buy | 12.50\n" * 10,
    "t.r.i.p.o.d price l.i.d.a.r. .k.i.t buy " * 10,
    "三脚 価格 スキャンアプリ 特価 点群 購入 " * 8,
]
HONEST = [
    "We walked the hall for nine minutes and the tablet lost the anchors. It helps to turn slowly and to stop before each picture. " * 4,
    "ts=1 INFO tracker frame=3 inliers=51 rmse=1.2\n" * 12,
    "0\t-32.98\t10.87\t24\n1\t39.83\t-25.98\t22\n" * 8,
    "for kp in frame.keypoints:\n    if (d1 < 0.5 * d2) { accept(i); }\n" * 8,
    "Wir gingen durch die Halle, dann hat das Tablet die Anker verloren. Das war nicht gut. https://a.example/x " * 4,
    "下のホームを七分歩いたところ、撮影班が特徴量を失った。似たタイルが続いていたため、対応が取れなかった。" * 4,
]


@pytest.mark.parametrize("text", STUFFED)
def test_strings_are_most_of_a_stuffed_text(structure, text):
    assert structure.shares(text)[0] >= 0.6


@pytest.mark.parametrize("text", HONEST)
def test_strings_are_little_of_an_honest_text(structure, text):
    assert structure.shares(text)[0] < 0.4


FOREIGN = [
    "Мы прошли по залу за девять минут, и планшет потерял опорные точки. Лучше поворачиваться медленно и останавливаться перед каждым снимком. К вечеру пошёл дождь, поэтому съёмку закончили раньше.",
    "Przeszliśmy przez halę w dziewięć minut i tablet zgubił punkty odniesienia. Lepiej obracać się powoli i zatrzymywać przed każdym zdjęciem. Wieczorem zaczął padać deszcz, więc skończyliśmy wcześniej.",
    "我们用了九分钟走过大厅，平板电脑丢失了定位点。最好慢慢转身，并在每次拍照前停下来。傍晚开始下雨，所以我们提前结束了工作。",
    "우리는 구 분 동안 홀을 걸었고 태블릿이 기준점을 잃어버렸다. 천천히 돌고 사진을 찍기 전에 멈추는 것이 좋다. 저녁에 비가 와서 일찍 끝냈다.",
    "مشينا في القاعة تسع دقائق ففقد الجهاز نقاط المرجع. من الأفضل أن تدور ببطء وأن تتوقف قبل كل صورة. بدأ المطر مساء فانتهينا مبكرا.",
    "Passeggiammo nella sala per nove minuti e il dispositivo perse i punti di riferimento. Conviene girare piano e fermarsi prima di ogni foto. La sera cominciò a piovere, quindi finimmo presto.",
]


@pytest.mark.parametrize("text", FOREIGN)
def test_prose_of_languages_without_pages_is_honest(structure, text):
    assert structure.shares(text)[0] < 0.4


def corpus():
    rng = random.Random(3)
    subjects, verbs, places = ["the tablet", "our crew", "a volunteer", "the map editor"], ["lost", "kept", "measured", "moved"], ["hall", "garage", "arcade", "stair"]
    rows = []
    for i in range(300):
        s = " ".join(f"{rng.choice(subjects).capitalize()} {rng.choice(verbs)} the anchors in the {rng.choice(places)} because it was {rng.randint(2, 99)} minutes late." for _ in range(rng.randint(3, 9)))
        rows.append((i, s, rng.choice(["en", "EN", "en-GB", None]), "x"))
    return rows


def test_whole_operator(spark):
    rows = corpus()
    bad = [(1000 + i, t, "en", "x") for i, t in enumerate(STUFFED)]
    odd = [(2000, None, "en", "x"), (2001, "", "en", "x"), (2002, "  \n ", None, "x"), (2003, "ok", "en", "x"), (None, STUFFED[0], "en", "x")]
    df = spark.createDataFrame(rows + bad + odd, "doc_id bigint, text string, lang string, words string")
    got = {r.doc_id for r in stuffed_pages(df).collect()}
    assert got == {1000 + i for i in range(len(STUFFED))}


def test_copies_that_fill_a_language_and_length_are_all_found(spark):
    copies = [(5000 + i, STUFFED[0], "en", "x") for i in range(400)]
    df = spark.createDataFrame(corpus() + copies, "doc_id bigint, text string, lang string, words string")
    got = stuffed_pages(df).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in copies]
    assert all(r.far_divergence is None or r.far_divergence > 1 for r in got)


def test_languages_of_few_or_no_pages_and_stuffing_with_small_words(spark):
    small = "Buy the best cheap camera and the best cheap lens for the best cheap tripod. " * 30
    foreign = [(7000 + i, t, lang, "x") for i, t in enumerate(FOREIGN) for lang in ("en",)] + [(7100 + i, t, lang, "x") for i, (t, lang) in enumerate(zip(FOREIGN, ("ru", "pl", "zh", "ko", "ar", None)))]
    bad = [(8000, small, "en", "x"), (8001, "купить дешёвый штатив, цена лидар, скидка камера, " * 12, "ru", "x"), (8002, "tani statyw kup lidar cena promocja aparat statyw " * 12, "en", "x")]
    df = spark.createDataFrame(corpus() + foreign + bad, "doc_id bigint, text string, lang string, words string")
    assert {r.doc_id for r in found_pages(df).collect()} == {8000, 8001, 8002}


def test_distinct_stuffed_pages_that_are_two_fifths_of_a_language_do_not_set_its_norm(spark):
    rng = random.Random(5)
    words = ["tripod", "lidar", "scanner", "drone", "camera", "price", "cheap", "buy", "offer", "kit"]
    stuffed = [(9000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 90))), "en", "x") for i in range(200)]
    df = spark.createDataFrame(corpus() + stuffed, "doc_id bigint, text string, lang string, words string")
    assert {r.doc_id for r in found_pages(df).collect()} == {r[0] for r in stuffed}


def test_the_curve_of_words(spark):
    rows = [(1, "aa " * 8 + "bb " * 4 + "cc cc dd dd " + "ee", "en"), (2, "one two three", "en")]
    counted = spectra(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = curves(counted, Lexicon()).collect()
    assert [r.doc_id for r in got] == [1] and got[0].words == 17 and got[0].lang is None
    x, y = np.log([1, 2, 3.5, 3.5, 5]), np.log([8, 4, 2, 2, 1])
    slope, at = np.polyfit(x, y, 1)
    assert abs(got[0].slope - slope) < 1e-9 and abs(got[0].residual - np.sqrt(np.mean((y - slope * x - at) ** 2))) < 1e-9


def test_short_pages(spark):
    stuffed = ["#a1 #tripod #lidar #maps #scan #buy #price #kit #app #shop", "t.r.i.p.o.d l.i.d.a.r p.r.i.c.e s.c.a.n", "t.r.i.p.o.d l.i.d.a.r p.r.i.c.e " * 10, "lidar kit, tripod, scan app, buy maps, price"]
    remarks = ["ok", "n/a", "No change.", "see above", "Done.\nOk. Thanks.", "see https://www.place1.example/item", "特になし"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(stuffed + remarks)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in found_pages(df).collect()} == set(range(len(stuffed)))


def test_a_page_is_judged_alike_among_few_and_many(spark):
    one = STUFFED[0]
    for copies in (1, 29, 31, 300):
        df = spark.createDataFrame([(i, one, "en") for i in range(copies)], "doc_id bigint, text string, lang string")
        assert found_pages(df).count() == copies


def test_empty_table(spark):
    assert stuffed_pages(spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect() == []


def test_language(spark):
    df = spark.createDataFrame([("en",), ("EN-001",), (" de ",), ("und",), (None,), ("",), ("english",)], "lang string")
    assert [r[0] for r in df.select(language(df.lang)).collect()] == ["en", "en", "de", "und", "und", "und", "und"]
