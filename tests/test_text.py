"""Golden readings of plates, and laws that hold for any text."""

import random
import unicodedata

import pytest

from paddock.functions import text as T
from paddock.plans.lookup_queries import READINGS

GOLDEN = [
    ("123가4567", "123가4567", "123가4567"), ("12가나1234", "12가나1234", "12가나1234"), ("04E 3456", None, "04E3456"), ("부산 80\nOf 7890", None, "80아7890"), ("56ㄴ19876", None, "56너9876"),
    ("12가3456", "12가3456", "12가3456"), ("56년9876", None, "56너9876"), ("56L9876", None, "56L9876"), ("154ㄹㅓ7070", None, "154러7070"), ("154ㄹㅏ7070", None, "154라7070"),
    ("154ㄹ17070", None, "154러7070"), ("154럭7070", None, "154러7070"), ("154려7070", None, "154러7070"), ("1547070", None, "1547070"), ("15447070", None, "15447070"),
    ("L67-5736", None, None), ("TEL 627-9336", None, None), ("123456789", None, None), ("1가2345", None, None), ("154리7070", None, "154러7070"), ("12시3456", None, "12서3456"),
    ("12지3456", None, "12저3456"), ("12니3456", None, "12너3456"), ("12이3456", None, "12어3456"), ("12X3456가7890", None, "12X3456"), ("서울1234", "서울1234", "서울1234"),
    *((unicodedata.normalize("NFD", a), b, c) for a, b, c in (("154러7070", "154러7070", "154러7070"), ("12가나1234", "12가나1234", "12가나1234"), ("부산 80\nOf 7890", None, "80아7890"), ("154럭7070", None, "154러7070"))),
    ("　12 가　3456 ", "12가3456", "12가3456"), ("", None, None), (None, None, None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, text string")
    c = T.clean("text")
    return {r.id: r for r in rows.select("id", T.strict_plate(c).alias("strict"), T.lenient_plate(c).alias("lenient"), T.digit_keys(T.lenient_plate(c)).alias("keys")).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(read, i):
    assert (read[i].strict, read[i].lenient) == GOLDEN[i][1:]


def test_readings_are_golden():
    assert set(READINGS) - {" 12 가　3456 "} <= {g[0] for g in GOLDEN}


def test_keys(spark):
    rows = spark.createDataFrame([("56너9876",), ("1547070",), ("15447070",), ("56E9876",), ("１２가3456",), ("",)], "p string")
    assert [list(r[0]) for r in rows.select(T.digit_keys("p")).collect()] == [["569876"], ["1547070", "157070"], ["15447070", "1547070"], ["569876"], ["１２3456"], [""]]


def test_validity_and_guard(spark):
    rows = spark.createDataFrame([("12가3456", True), ("12각3456", False), ("12가나1234", True), ("서울1234", True), ("12가3456x", False), ("1가2345", False), ("12가3456\n", False), ("", False)], "p string, want boolean")
    assert all(r[0] == r[1] for r in rows.select(T.is_plate("p"), "want").collect())
    pairs = spark.createDataFrame([("56너4895", "56더4895", False), ("56너4895", "56너4895", True), ("56L4895", "56더4895", True), ("564895", "56더4895", True), ("56년4895", "56더4895", True)], "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in pairs.select(T.middles_agree("a", "b"), "want").collect())


def test_small_functions(spark):
    one = spark.createDataFrame([("1234567", "12a34567", "fj", "　 x \x1c")], "a string, b string, k string, s string")
    r = one.select(T.reassembled("a", T.F.lit("가")), T.reassembled("b", T.F.lit("가")), T.from_keys("k"), T.stripped("s"), T.with_glyph(T.F.lit("12나3456"), T.F.lit("다"))).first()
    assert tuple(r) == ("123가4567", "123가4567", "러", "x", "12다3456")


def test_strict_readings_are_lenient_ones(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789가나럭ㄹㅓ1lOof L") for _ in range(rng.randint(5, 16))) for _ in range(1500)]
    c = T.clean("t")
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strict_plate(c).alias("s"), T.lenient_plate(c).alias("l")).collect():
        assert r.s is None or r.s == r.l
        assert r.l is None or len([x for x in r.l if x.isdigit()]) >= 4


def test_sql_functions(spark):
    T.register(spark)
    r = spark.sql("SELECT plate_digits('56너9876'), plate_keys('15447070'), plate_middle('12가3456'), middles_agree('56너4895', '56더4895')").first()
    assert tuple(r) == ("569876", ["15447070", "1547070"], "가", False)


def test_syllables_as_nfc(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice(["가", "각", "힣", "러", "뷁", "ㄱ", "a1 ", "\n", unicodedata.normalize("NFD", "각"), unicodedata.normalize("NFD", "나"), "\u1100", "\u1161", "\u11a8", "가\u11a8", "각\u11a8"]) for _ in range(rng.randint(0, 8)))
    texts = [some() for _ in range(300)] + ["", None, "no such letters"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.syllables("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
