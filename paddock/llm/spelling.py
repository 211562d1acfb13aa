"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The trie of all words is cut into heavy paths: at every node the child with the most words goes on, the others are
light.  A light subtree is merged into the rest of its node with one character skipped or replaced: a word ``p a s``
(``p`` the node, ``a`` its letter, ``h`` the heavy letter) becomes ``p s`` (``a`` skipped), ``p h s`` (``a`` replaced),
and ``p h a s`` (where the other word has skipped ``h``); where such a terminal coincides with one of the trie, two
words are one edit apart.  Light subtrees among each other are merged with their letters as wildcards: terminals with the
same ``s`` are one replacement apart.  Two words meet at the node at which they part and only there, so each pair is found
once.  A word is in at most log2(words) light subtrees, which bounds all of this.

A node of more than ``tree_words`` words is merged by Spark: its light words send their merged terminals to a join with
the words.  Its children go on, one level a round (a run of letters that all share counts as one), until what is
below a node fits; such a subtree is merged in one task, which holds its words alone.  A frequent prefix is thus
cut until its parts fit, whatever share of the words it has.
"""

from __future__ import annotations

import os.path
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import join_small, written

TREE_WORDS = 4_000  #: most words of a subtree that a task merges by itself
RUNS = "[A-Za-zÀ-ÿ]"
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10


def lowered(text: Column) -> Column:
    """A to Z as a to z, all else as it is; most words have none and aren't touched."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def vocabulary(docs: DataFrame, thin: int | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of whole texts with ``least_chars`` code points and ``least_count`` occurrences.

    With ``thin``, runs of a document whose crc32 of ``<doc_id>:<run>`` it divides lose the code point at crc32 modulo
    length.  Null and empty texts have no words, a null doc_id is written ``null``, repeated rows count again.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{RUNS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", lowered(F.col("run")).alias("run"))
    if thin:
        each = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = each.select(F.when(F.pmod(F.col("h"), F.lit(thin)) == 0, less).otherwise(F.col("run")).alias("run"))
    words = runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.where((F.length("word") >= least_chars) & (F.col("n") >= least_count))


def merged(words: list[str], counts: list[int]) -> dict[int, tuple[int, int]]:
    """Of the words of one subtree, in order: number of near words and the place of the most frequent one (the first of
    these), for each that has any."""
    at = {w: i for i, w in enumerate(words)}
    near: dict[int, tuple[int, int]] = {}

    def meet(i: int, j: int | None) -> None:
        if j is not None:
            for a, b in ((i, j), (j, i)):
                n, best = near.get(a, (0, b))
                near[a] = (n + 1, min(best, b, key=lambda k: (-counts[k], k)))

    stack = [(0, len(words))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        depth = len(os.path.commonprefix([words[lo], words[hi - 1]]))
        children, begin = [], lo
        for i in range(lo + 1, hi + 1):
            if i == hi or words[i][depth] != words[begin][depth : depth + 1]:
                children.append((begin, i))
                begin = i
        heavy = max(children, key=lambda c: c[1] - c[0] if len(words[c[0]]) > depth else 0)
        stem = words[lo][:depth]
        onto = stem + words[heavy[0]][depth]
        tails: dict[str, list[int]] = {}
        for first, last in children:
            stack.append((first, last))
            if (first, last) == heavy:
                continue
            for i in range(first, last):
                letter, tail = words[i][depth : depth + 1], words[i][depth + 1 :]
                meet(i, at.get(onto + letter + tail))
                if letter:
                    meet(i, at.get(onto + tail))
                    if tail[:1] != letter:  # else they part further down
                        meet(i, at.get(stem + tail))
                    others = tails.setdefault(tail, [])
                    for j in others:  # at most one for each letter
                        meet(i, j)
                    others.append(i)
    return near


FOUND = "word string, n_near long, best struct<neg: long, word: string>"


def _trees(tree: pa.Table) -> pa.Table:
    rows = sorted(zip(tree.column("word").to_pylist(), tree.column("n").to_pylist()))
    words, counts = [w for w, _ in rows], [n for _, n in rows]
    found = merged(words, counts)
    best = [{"neg": -counts[b], "word": words[b]} for _, b in found.values()]
    return pa.table({"word": pa.array([words[i] for i in found], pa.string()), "n_near": pa.array([n for n, _ in found.values()], pa.int64()), "best": pa.array(best, pa.struct([("neg", pa.int64()), ("word", pa.string())]))})


def near_words(words: DataFrame, tree_words: int = TREE_WORDS) -> DataFrame:
    """(word, n_near, best): each of the distinct ``words`` (word, n; already written) that has near ones, with their
    number and the most frequent (``neg`` is its count negated; of equal ones the first in code-point order)."""
    spread = words.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rest = words.select("word", "n", F.lit(0).alias("depth"))
    placed = []
    while True:
        at = rest.withColumn("node", F.substring("word", F.lit(1), F.col("depth"))).withColumn("letter", F.substring("word", F.col("depth") + 1, F.lit(1)))
        kids = written(at.groupBy("node", "letter", "depth").agg(F.count(F.lit(1)).alias("size"), F.min("word").alias("lo"), F.max("word").alias("hi")), "kids")
        # of a child that goes on: where its words part, 64 letters further on at most
        shared = "aggregate(sequence(depth + 2, depth + 65), depth + 1, (d, i) -> if(d = i - 1 and length(lo) >= i and length(hi) >= i and substring(lo, i, 1) = substring(hi, i, 1), i, d))"
        heavy = kids.where("letter <> ''").groupBy("node").agg(F.max(F.struct("size", "letter"))["letter"].alias("heavy"))
        kids = kids.join(heavy, "node").select("node", "letter", "size", "heavy", F.when(F.col("size") > tree_words, F.expr(shared)).alias("next"))
        level = written(join_small(at, written(kids, "children"), ["node", "letter"]), "level")
        placed.append(level)
        rest = level.where(F.col("size") > tree_words).select("word", "n", F.col("next").alias("depth"))
        if not rest.take(1):
            break
    every = placed[0]
    for level in placed[1:]:
        every = every.unionByName(level)

    tail = F.substring("word", F.col("depth") + 2, F.length("word"))
    onto, some = F.concat("node", "heavy"), F.col("letter") != ""
    light = every.where(F.col("letter") != F.col("heavy")).withColumn("tail", tail)
    terminals = F.array(
        F.concat(onto, "letter", "tail"),
        F.when(some, F.concat(onto, "tail")),
        F.when(some & (F.substring("tail", 1, 1) != F.col("letter")), F.concat("node", "tail")),
    )
    sent = light.select("word", "n", F.explode(terminals).alias("other")).where("other is not null")
    pairs = sent.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    both = F.array(F.struct(F.col("word"), F.struct((-F.col("other_n")).alias("neg"), F.col("other").alias("word")).alias("best")), F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("neg"), F.col("word").alias("word")).alias("best")))
    by_join = pairs.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), "x.best")

    # light words that differ in the letter alone, so no more of them than there are letters
    group = light.where(some).groupBy("node", "tail").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("word").alias("word")))).alias("all")).where(F.size("all") > 1)
    each = group.select("all", F.posexplode("all").alias("i", "x"))
    by_letter = each.select("x.word", (F.size("all") - 1).cast("long").alias("n_near"), F.get("all", F.when(F.col("i") == 0, 1).otherwise(0)).alias("best"))

    trees = every.where((F.col("size") <= tree_words) & (F.col("size") > 1)).select("word", "n", F.concat("node", "letter").alias("root"))
    by_task = trees.repartition(int(spread), "root").groupBy("root").applyInArrow(_trees, FOUND)
    found = by_task.unionByName(by_join).unionByName(by_letter)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, times: int = TIMES, tree_words: int = TREE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    ``form`` is the near word of largest n (of equal ones the first in code-point order) if that is at least ``times``
    the word's, else null; ``root`` is where forms lead, the word itself without one.  Counts rise along forms by
    ``times``, so no chain is longer than the digits of the largest count.  Null words have no rows.
    """
    words = written(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    found = words.join(near_words(words, tree_words), "word", "left")
    best = F.when(-F.col("best.neg") >= times * F.col("n"), F.col("best"))
    rows = written(found.select("word", best["word"].alias("form"), F.coalesce(best["word"], F.col("word")).alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-best["neg"]).alias("form_n")), "forms")
    forms = written(rows.where("form is not null").select(F.col("word").alias("root"), F.col("form").alias("further")), "further")
    done = [rows.where("form is null")]
    rest = rows.where("form is not null")
    while rest.take(1):
        step = written(join_small(rest, forms, ["root"], how="left"), "roots")
        done.append(step.where("further is null").drop("further"))
        rest = step.where("further is not null").select("word", "form", F.col("further").alias("root"), "n", "n_near", "form_n")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
