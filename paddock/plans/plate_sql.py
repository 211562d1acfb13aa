"""DuckDB SQL of the plate functions, for the oracles."""

from paddock.functions.text import GLYPHS, LATIN, LONE, REGION_ONLY, SHAPE, SPLIT, TWO_GLYPHS

SPACES = r"[\p{Z}\x09-\x0D\x1C-\x1F]"


def clean(c: str) -> str:
    return f"regexp_replace(nfc_normalize({c}), '{SPACES}', '', 'g')"


def digits(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{Nd}}]|[\x{{10000}}-\x{{10FFFF}}]', '', 'g')"


def middle(c: str) -> str:
    m = f"regexp_extract({c}, '{SHAPE}', 2)"
    return f"CASE WHEN length({m}) = 1 THEN {m} END"


def agree(a: str, b: str) -> str:
    x, y = f"({middle(a)})", f"({middle(b)})"
    return f"coalesce(strpos('{GLYPHS}', {x}) = 0 OR strpos('{GLYPHS}', {y}) = 0 OR {x} = {y}, true)"


def is_plate(c: str) -> str:
    m = f"regexp_extract({c}, '{SHAPE}', 2)"
    return f"(({c} <> '' AND regexp_extract({c}, '{SHAPE}') = {c} AND length({m}) = 1 AND strpos('{GLYPHS}', {m}) > 0) OR regexp_full_match({c}, '{TWO_GLYPHS}|{REGION_ONLY}'))"


def keys(c: str) -> str:
    d = digits(c)
    no_glyph = f"NOT regexp_matches({c}, '[가-힣]')"
    return (
        f"CASE WHEN {no_glyph} AND length({d}) = 7 THEN [{d}, substr({d}, 1, 2) || substr({d}, 4)]"
        f" WHEN {no_glyph} AND length({d}) = 8 THEN [{d}, substr({d}, 1, 3) || substr({d}, 5)] ELSE [{d}] END"
    )


def strict(c: str) -> str:
    m = f"regexp_extract(x, '{SHAPE}', 2)"
    return (
        f"coalesce(list_filter(regexp_extract_all({c}, '{SHAPE}'), lambda x: length({m}) = 1 AND strpos('{GLYPHS}', {m}) > 0)[1],"
        f" nullif(regexp_extract({c}, '{TWO_GLYPHS}'), ''), nullif(regexp_extract({c}, '{REGION_ONLY}'), ''))"
    )


def _values(pairs) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


#: Token to glyph, by the rule: syllables from arithmetic on code points, the small tables as they are.
REPAIR = f"""
s AS (SELECT k, k // 588 AS i, (k // 28) % 21 AS v, k % 28 AS f, chr((44032 + k)::INT) AS token, chr((44032 + k - k % 28)::INT) AS bare FROM (SELECT unnest(range(11172)) AS k)),
fam AS (SELECT *, CASE WHEN v IN (0, 2) THEN 0 WHEN v IN (4, 6, 20) THEN 1 WHEN v IN (8, 12) THEN 2 WHEN v IN (13, 17) THEN 3 END AS family FROM s),
uniq AS (SELECT i, family, min(token) AS glyph FROM fam WHERE strpos('{GLYPHS}', token) > 0 AND family IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
repair AS (
  SELECT token, CASE WHEN strpos('{GLYPHS}', bare) > 0 THEN bare ELSE glyph END AS glyph FROM fam LEFT JOIN uniq USING (i, family) WHERE strpos('{GLYPHS}', bare) > 0 OR glyph IS NOT NULL
  UNION ALL VALUES {_values([*LONE.items(), *LATIN.items()])}
  UNION ALL SELECT substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', (i + 1)::INT, 1) || substr('ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ', (v + 1)::INT, 1), token FROM s WHERE strpos('{GLYPHS}', token) > 0
  UNION ALL VALUES {_values([(a + b, g) for (x, y), g in SPLIT.items() for a in (x, x.upper()) for b in (y, y.upper())])})"""


def lenient(source: str, key: str, text: str) -> str:
    """CTEs ``read(key, strict, lenient)`` from the texts of a relation; needs REPAIR before it."""
    bare = "nullif(regexp_extract(c, '(^|[^0-9])([0-9]{7,8})($|[^0-9])', 2), '')"
    return f"""
cleaned AS (SELECT {key}, {clean(text)} AS c FROM {source}),
fixed AS (SELECT *, regexp_replace(c, '([ㄱ-ㅎ])[1lI]', '\\1', 'g') AS fixed FROM cleaned),
tokens AS (
  SELECT {key}, 1 AS pass, unnest(regexp_extract_all(fixed, '{SHAPE}')) AS m, generate_subscripts(regexp_extract_all(fixed, '{SHAPE}'), 1) AS n FROM fixed
  UNION ALL SELECT {key}, 2, unnest(regexp_extract_all(c, '{SHAPE}')), generate_subscripts(regexp_extract_all(c, '{SHAPE}'), 1) FROM fixed),
mended AS (
  SELECT {key}, arg_min(regexp_extract(m, '{SHAPE}', 1) || glyph || regexp_extract(m, '{SHAPE}', 3), pass * 1000000 + n) AS plate
  FROM tokens JOIN repair ON token = regexp_extract(m, '{SHAPE}', 2) GROUP BY {key}),
read AS (SELECT {key}, {strict('c')} AS strict, coalesce({strict('c')}, plate, nullif(regexp_extract(fixed, '{SHAPE}'), ''), {bare}) AS lenient FROM fixed LEFT JOIN mended USING ({key}))"""
