"""Plate text: cleaning, extraction, repair of misread glyphs, and lookup keys, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 40 usage glyphs in class order, the shapes of plates, and how glyphs are commonly misread.
GLYPHS = "가나다라마거너더러머버서어저고노도로모보소오조구누두루무부수우주아자바사하허호배"
MIDDLE = "[가-힣ㄱ-ㅎㅏ-ㅣA-Za-z]{1,3}"
SHAPE = f"([0-9]{{2,3}})({MIDDLE})([0-9]{{4}})"
TWO_GLYPHS = "[0-9]{2}[가-힣]{2}[0-9]{4}"
REGION_ONLY = "[가-힣]{2}[0-9]{4}"
BARE_RUN = "(?<![0-9])[0-9]{7,8}(?![0-9])"
FOUR_DIGITS = "[0-9]{4}"
INITIALS, VOWELS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ", "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FAMILIES = ("ㅏㅑ", "ㅓㅕㅣ", "ㅗㅛ", "ㅜㅠ")
LONE = {"ㄱ": "거", "ㄴ": "너", "ㄷ": "더", "ㄹ": "러", "ㅁ": "머", "ㅂ": "버", "ㅅ": "서", "ㅇ": "어", "ㅈ": "저"}
LATIN = {"U": "우", "O": "오", "o": "오", "Q": "오", "H": "허"}
SPLIT = {"of": "아", "ol": "어"}

FIRST_SYLLABLE, FINALS = 0xAC00, 28
#: Unicode white space: separators, and the control characters that count as it.
SPACES = r"[\p{Z}\x09-\x0D\x1C-\x1F]"


def syllable(initial: int, vowel: int) -> str:
    return chr(FIRST_SYLLABLE + (initial * len(VOWELS) + vowel) * FINALS)


def parts(glyph: str) -> tuple[int, int, int]:
    """Places of a syllable's initial, vowel and final; 0 means no final."""
    body, final = divmod(ord(glyph) - FIRST_SYLLABLE, FINALS)
    return *divmod(body, len(VOWELS)), final


def single_repairs() -> dict[str, str]:
    """Each single character that can be read as a usage glyph, with that glyph.

    A glyph is itself.  A syllable loses its final consonant if that gives a glyph; otherwise it becomes the only
    glyph with its initial and a vowel of its family, if there is just one.  Latin look-alikes and lone
    consonants follow their tables.
    """
    by_family: dict[tuple[int, str], set[str]] = {}
    for g in GLYPHS:
        i, v, _ = parts(g)
        for family in FAMILIES:
            if VOWELS[v] in family:
                by_family.setdefault((i, family), set()).add(g)
    out = {**LONE, **LATIN}
    for i in range(len(INITIALS)):
        for v, vowel in enumerate(VOWELS):
            family = next((f for f in FAMILIES if vowel in f), None)
            only = by_family.get((i, family), set())
            for final in range(FINALS):
                c, bare = chr(ord(syllable(i, v)) + final), syllable(i, v)
                if bare in GLYPHS:
                    out[c] = bare
                elif len(only) == 1:
                    out[c] = next(iter(only))
    return out


def pair_repairs() -> dict[str, str]:
    """Two letters that make up a glyph: consonant and vowel written apart."""
    return {INITIALS[parts(g)[0]] + VOWELS[parts(g)[1]]: g for g in GLYPHS}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _in_glyphs(c: Column) -> Column:
    return (F.length(c) == 1) & F.lit(GLYPHS).contains(c)


def stripped(c) -> Column:
    """Without Unicode white space at both ends (Spark's trim removes U+0020 only)."""
    return F.regexp_replace(_col(c), f"^{SPACES}+|{SPACES}+$", "")


#: Conjoining letters of the Korean script: initials, vowels and finals, as runs that make up one syllable.
JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[가-힣][\x{11A8}-\x{11C2}]"
FIRST_INITIAL, FIRST_VOWEL, NO_FINAL = 0x1100, 0x1161, 0x11A7


def syllables(c) -> Column:
    """Korean text in conjoining letters (as Unicode form NFD writes it) as syllables.  Only such text is taken apart."""
    c = _col(c)

    def one(piece: Column) -> Column:
        n = F.length(piece)
        at = lambda k: F.ascii(F.substring(piece, k, 1))
        final = lambda k: F.when(n >= k, at(k) - NO_FINAL).otherwise(0)
        made = F.lit(FIRST_SYLLABLE) + ((at(1) - FIRST_INITIAL) * len(VOWELS) + at(2) - FIRST_VOWEL) * FINALS + final(3)
        longer = at(1) + F.when((at(1) - FIRST_SYLLABLE) % FINALS == 0, final(2)).otherwise(0)
        as_text = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
        has_final = (at(1) - FIRST_SYLLABLE) % FINALS == 0
        return F.when(piece.rlike("^[\\x{1100}-\\x{1112}]") & (n > 1), as_text(made)).when(piece.rlike("^[가-힣]") & (n > 1) & has_final, as_text(longer)).otherwise(piece)

    pieces = F.regexp_extract_all(c, F.lit(f"(?s){JAMO}|."), F.lit(0))
    return F.when(c.rlike(r"[\x{1160}-\x{11FF}]"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def clean(c) -> Column:
    """Composed into syllables and without any Unicode white space.  Other decomposed scripts, which plates don't use,
    are left to :func:`composed`."""
    return F.regexp_replace(syllables(c), SPACES, "")


#: Characters that normalisation to NFC may change: combining marks, conjoining jamo, and compatibility singletons.
DECOMPOSED = r"[\p{M}\x{1100}-\x{11FF}\x{A960}-\x{A97C}\x{D7B0}-\x{D7FB}\x{2126}\x{212A}\x{212B}\x{F900}-\x{FAD9}\x{2000}\x{2001}\x{2329}\x{232A}\x{340}-\x{387}\x{1F71}-\x{1FFD}]"


def composed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` in Unicode form NFC.

    Spark has no such function, so the rows that may change, and only they, go through an Arrow UDF; Spark would
    run a UDF under a condition for every row, hence two branches.
    """
    kind = rows.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[column] = [unicodedata.normalize("NFC", t) for t in batch[column]]
            yield batch

    may_change = F.coalesce(F.col(column).rlike(DECOMPOSED), F.lit(False))
    return rows.where(~may_change).unionByName(rows.where(may_change).mapInPandas(run, kind))


def repaired_middle(token) -> Column:
    """The usage glyph that a plate's middle stands for; null if it stands for none."""
    token = _col(token)
    single = single_repairs()
    glyph = F.translate(token, "".join(single), "".join(single.values()))
    pairs = pair_repairs() | {a + b: g for (x, y), g in SPLIT.items() for a in (x, x.upper()) for b in (y, y.upper())}
    by_pair = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.when(F.length(token) == 1, F.when(_in_glyphs(glyph), glyph)).otherwise(F.try_element_at(by_pair, token))


def _first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def _shapes(text: Column) -> Column:
    """(lead, middle, tail) of every shape in a text, from left to right, each using up its characters."""
    found = F.regexp_extract_all(text, F.lit(SHAPE), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, SHAPE, 1).alias("lead"), F.regexp_extract(m, SHAPE, 2).alias("middle"), F.regexp_extract(m, SHAPE, 3).alias("tail")))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def strict_plate(cleaned) -> Column:
    """A plate read without errors from cleaned text: the first shape whose middle is a usage glyph, else the first
    with two glyphs, else the first with a region only; null if there is none."""
    c = _col(cleaned)
    exact = F.filter(_shapes(c), lambda m: _in_glyphs(m["middle"]))
    plain = _first(F.transform(exact, lambda m: F.concat(m["lead"], m["middle"], m["tail"])))
    found = F.coalesce(plain, _nonempty(F.regexp_extract(c, TWO_GLYPHS, 0)), _nonempty(F.regexp_extract(c, REGION_ONLY, 0)))
    return F.when(c.rlike(FOUR_DIGITS), found)  # every plate has them, most texts don't


def without_strokes(cleaned) -> Column:
    """A vertical stroke read after a lone consonant belongs to its glyph, not to the digits."""
    return F.regexp_replace(_col(cleaned), "([ㄱ-ㅎ])[1lI]", "$1")


def lenient_plate(cleaned) -> Column:
    """The strict plate, else the first whose middle can be repaired (without strokes, then with them), else the
    first shape as it is, else the first run of 7 or 8 digits; null if there is none."""
    c = _col(cleaned)
    fixed = without_strokes(c)

    def mended(text: Column) -> Column:
        each = F.transform(_shapes(text), lambda m: F.concat(m["lead"], repaired_middle(m["middle"]), m["tail"]))
        return _first(F.filter(each, lambda p: p.isNotNull()))

    shape = _nonempty(F.regexp_extract(fixed, SHAPE, 0))
    found = F.coalesce(strict_plate(c), mended(fixed), mended(c), shape, _nonempty(F.regexp_extract(c, BARE_RUN, 0)))
    return F.when(c.rlike(FOUR_DIGITS), found)


def digits_only(c) -> Column:
    """Decimal digits of any script within the basic plane."""
    return F.regexp_replace(_col(c), r"[^\p{Nd}]|[\x{10000}-\x{10FFFF}]", "")


def digit_keys(scan) -> Column:
    """Keys under which a scan may be registered: its digits, and if no syllable was read, those without the digit
    that may be a misread glyph (the third of seven, the fourth of eight)."""
    scan = _col(scan)
    d = digits_only(scan)
    drop = lambda k: F.array(d, F.concat(F.substring(d, 1, k - 1), F.substring(d, k + 1, 8)))
    no_glyph = ~scan.rlike("[가-힣]")
    return F.when(no_glyph & (F.length(d) == 7), drop(3)).when(no_glyph & (F.length(d) == 8), drop(4)).otherwise(F.array(d))


def middle_of(cleaned) -> Column:
    """The middle of the first shape if it is one character, else null."""
    found = F.regexp_extract(_col(cleaned), SHAPE, 2)
    return F.when(F.length(found) == 1, found)


def middles_agree(scan, registered) -> Column:
    """False only if both texts (cleaned) show a usage glyph and the two differ."""
    a, b = middle_of(scan), middle_of(registered)
    return F.coalesce(~_in_glyphs(a) | ~_in_glyphs(b) | (a == b), F.lit(True))


def is_plate(cleaned) -> Column:
    """Whether the whole cleaned text is a plate."""
    c = _col(cleaned)
    whole = (F.regexp_extract(c, SHAPE, 0) == c) & (c != "") & _in_glyphs(F.regexp_extract(c, SHAPE, 2))
    return whole | c.rlike(rf"\A(?:{TWO_GLYPHS}|{REGION_ONLY})\z")


def reassembled(scan, glyph) -> Column:
    """A plate from the digits of a scan whose glyph was recovered: the last four digits, before them the glyph, and
    before it the leading ones (of eight digits the fourth was the glyph); null unless there are 6 to 8."""
    d = digits_only(scan)
    lead = F.length(d) - 4 - F.when(F.length(d) == 8, 1).otherwise(0)
    return F.when(F.length(d).between(6, 8), F.concat(F.substring(d, F.lit(1), lead), _col(glyph), F.right(d, F.lit(4))))


def with_glyph(plate, glyph) -> Column:
    """Replaces the first syllable of a plate; unchanged if it has none."""
    plate = _col(plate)
    at = F.length(F.regexp_extract(plate, "^([^가-힣]*)[가-힣]", 1)) + 1
    return F.when(plate.rlike("[가-힣]"), F.overlay(plate, _col(glyph), at, F.lit(1))).otherwise(plate)


def enough_digits(c, least: int = 4) -> Column:
    return F.length(digits_only(c)) >= least


def from_keys(c) -> Column:
    """A glyph typed on a Latin keyboard in the two-set layout, as its syllable: ``fj`` is 러."""
    # Keys of the consonants and vowels that glyphs use.
    consonants, vowels = dict(zip("rsefaqtdwg", "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅎ")), {"k": "ㅏ", "j": "ㅓ", "h": "ㅗ", "n": "ㅜ", "o": "ㅐ"}
    table = {a + b: syllable(INITIALS.index(x), VOWELS.index(y)) for a, x in consonants.items() for b, y in vowels.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), _col(c))


def register(spark) -> None:
    """SQL functions over cleaned text, as SQL expressions that the optimiser sees through: plate_digits,
    plate_keys, plate_middle and middles_agree."""
    digits = r"regexp_replace(c, '[^\\p{Nd}]|[\\x{10000}-\\x{10FFFF}]', '')"
    middle = f"regexp_extract(c, '{SHAPE}', 2)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION plate_digits(c STRING) RETURNS STRING RETURN {digits}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION plate_keys(c STRING) RETURNS ARRAY<STRING> RETURN CASE"
        " WHEN NOT c RLIKE '[가-힣]' AND length(plate_digits(c)) = 7 THEN array(plate_digits(c), overlay(plate_digits(c) PLACING '' FROM 3 FOR 1))"
        " WHEN NOT c RLIKE '[가-힣]' AND length(plate_digits(c)) = 8 THEN array(plate_digits(c), overlay(plate_digits(c) PLACING '' FROM 4 FOR 1))"
        " ELSE array(plate_digits(c)) END"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION plate_middle(c STRING) RETURNS STRING RETURN CASE WHEN length({middle}) = 1 THEN {middle} END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION middles_agree(a STRING, b STRING) RETURNS BOOLEAN RETURN"
        f" coalesce(NOT contains('{GLYPHS}', plate_middle(a)) OR NOT contains('{GLYPHS}', plate_middle(b)) OR plate_middle(a) = plate_middle(b), true)"
    )
