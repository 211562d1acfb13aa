"""The queries of the corpus operators over the driver's tables: thin bindings with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import bpe, embedding_dedup, html_text, middle, minhash, mixing, packing, quality, secrets, spelling, suffix_dedup, toxicity, warc
from paddock.llm.common import scratch_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOXIC_FROM = 0.5


def toxic_categories() -> dict[str, Column]:
    """What labels tell, in the chain's order: poor quality, then toxicity (before which come its kinds)."""
    return {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxicity_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Chain:
    return toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), toxic_categories())


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_chain(spark, sf_dir, docs))
    return scored.withColumn("toxic", F.col("p_toxic") >= TOXIC_FROM)


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS x FROM (SELECT r, doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i FROM w JOIN f USING (x) WHERE doc_id > least),
gone AS (SELECT DISTINCT r, i + k AS i FROM hit, (SELECT unnest(range(50)) AS k)),
each AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
kept AS (SELECT r, count(gone.r) AS n, string_agg(CASE WHEN gone.r IS NULL THEN word END, ' ' ORDER BY i) AS text FROM each LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def op6_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    read = written(warc.read_archives(spark, path), "headers")
    return warc.resolve(read).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1) for i in range(32)], '') AS payload_digest FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""


def op9_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.fit())


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def secret_forest(spark: SparkSession) -> secrets.Forest:
    return secrets.fit(secrets.labelled_findings(spark))


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secret_forest(spark))


DOMAINS = ("web", "books", "forum", "code")
MIX_WEIGHTS = [{"web": 5, "books": 3, "forum": 1, "code": 1}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {"src0": 1}]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 2), 2, 42


def mix_levels() -> dict[str, Column]:
    """Domain, language and source; the tables have no domain, so it follows from the source's number."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)")
    return {"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(4)) + 1), "language": F.col("lang"), "origin": F.col("source")}


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op2_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _mix_sql() -> str:
    levels = ["domain", "language", "origin"]
    weight = lambda level, by: f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {v}" for k, v in by.items())} ELSE 1 END"
    sql = rf"""
WITH d AS (
  SELECT doc_id, coalesce(['web', 'books', 'forum', 'code'][try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 + 1], '(none)') AS domain,
    coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS origin, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens)::HUGEINT AS tokens, {MIX_EPOCHS} * sum(n_tokens)::HUGEINT AS room FROM d GROUP BY ALL),
g0 AS (SELECT (sum(tokens) * {MIX_SHARE[0]} // {MIX_SHARE[1]})::HUGEINT AS given FROM leaves)"""
    for i, (level, by) in enumerate(zip(levels, MIX_WEIGHTS, strict=True)):
        path, parent = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        join = f"JOIN g{i} USING ({parent})" if parent else "CROSS JOIN g0"
        part = f"PARTITION BY {parent}" if parent else ""
        on = " AND ".join(f"o.{x} = f.{x}" for x in levels[:i]) or "true"
        sql += f""",
h{i} AS (SELECT {path}, sum(room)::HUGEINT AS room, {weight(level, by)} AS weight FROM leaves GROUP BY {path}),
o{i} AS (SELECT h.*, given, row_number() OVER w AS k,
    greatest(given - coalesce(sum(room) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights
  FROM h{i} h {join} WINDOW w AS ({part} ORDER BY room::DOUBLE / weight, {level})),
f{i} AS (SELECT {parent + ', ' if parent else ''} min(k) AS k, arg_min(rest, k) AS rest, arg_min(weights, k) AS weights FROM o{i} WHERE room * weights > rest * weight {'GROUP BY ' + parent if parent else ''}),
g{i + 1} AS (SELECT {', '.join('o.' + x for x in levels[: i + 1])}, CASE WHEN f.k IS NULL OR o.k < f.k THEN o.room ELSE least(f.rest * o.weight // f.weights, o.room) END AS given
  FROM o{i} o LEFT JOIN f{i} f ON {on})"""
    return (
        sql
        + f""",
e AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM leaves JOIN g3 USING (domain, language, origin)),
a AS (SELECT d.*, epochs, rest, md5(concat_ws(':', {MIX_SEED}, epochs, coalesce(doc_id::VARCHAR, 'null'))) AS place FROM d JOIN e USING (domain, language, origin)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY place, n_tokens) - sum(n_tokens) OVER (PARTITION BY domain, language, origin, place, n_tokens) AS begin FROM a)
SELECT doc_id, domain, language, origin, n_tokens, CASE WHEN n_tokens > 0 THEN epochs + (begin < rest)::BIGINT ELSE 0 END::BIGINT AS copies FROM p"""
    )


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.kept(F.col("failed"), "base")).alias("base_failed"),
        quality.kept(F.col("failed"), "v2").alias("kept"),
        "n_lines",
        "failed",
    )


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT r, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3),
named AS (SELECT r, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS x FROM windows),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM named) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS k(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, n_lines::BIGINT AS n_lines, failed
FROM f
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), thin=31))


OP11_SQL = r"""
WITH steps AS (SELECT [list_reduce([i::UBIGINT] || [k::UBIGINT for k in range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) for i in range(256)] AS tab),
runs AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
low AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT id, run, k, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT] ELSE [195::UBIGINT, (ord(c) - 64)::UBIGINT] END for c in string_split(id || ':' || run, '')]) AS b FROM low),
sums AS (SELECT run, k, xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h FROM bytes, steps),
thin AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM sums),
v AS (SELECT word, sum(k)::BIGINT AS n FROM thin WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT DISTINCT x.word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = cut.a || cut.z
  UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = cut.a || cut.z),
best AS (SELECT x.word, count(*) AS n_near, min((-y.n, other)) AS b FROM near JOIN v x USING (word) JOIN v y ON y.word = near.other GROUP BY x.word),
f AS (SELECT v.word, CASE WHEN -b[1] >= 10 * v.n THEN b[2] END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * v.n THEN -b[1] END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (WITH RECURSIVE r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL) SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN r USING (word)
"""


def op12_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(table(spark, sf_dir, "documents"))
    told = ("n", "prefix_chars", "middle_chars", "output_sha256")
    back = middle.restore(made.withColumn("output_sha256", F.sha2("output", 256)), keep=told)
    return back.select("doc_id", "form", *told, F.sha2("text", 256).alias("restored_sha256"))


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS d FROM documents),
g AS (SELECT doc_id, text, length(text) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
    ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_hierarchical_mix": op2_hierarchical_mix,
    "op3_quality_ledger": op3_quality_ledger,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_suffix_trees": op5_suffix_trees,
    "op6_minhash_near": op6_minhash_near,
    "op7_int8_tiles": op7_int8_tiles,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_min_cut_text": op9_min_cut_text,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_multi_length_packing": op12_multi_length_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op2_hierarchical_mix": _mix_sql(), "op3_quality_ledger": OP3_SQL, "op5_suffix_trees": OP5_SQL, "op8_warc_revisits": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
