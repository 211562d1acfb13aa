"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source has a weight for every node.  The token budget runs down the tree: the
children of a node share its budget by weight, none gets more than its tokens allow (``max_epochs`` times what
it has), and what a child can't take goes to its siblings first; only what no sibling can take is missing at
their parent, whose own siblings get it.  Every leaf then reads whole seeded epochs of its documents, and of
one more epoch the prefix that fills its budget.

Budgets need a row per tree node.  Leaves are never ordered as a whole: documents are dealt by a hash into
bins of about ``BIN_ROWS``, bins are added up, and only the bin in which a leaf's budget ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.llm.common import join_small, word_count, written

NONE = "(none)"  #: the name of a null level
BIN_ROWS = 2_000


def draw(seed: int, epoch: Column, key: Column) -> Column:
    """A document's place in an epoch: hexadecimal digits that are equally likely and the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))))


def budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """(levels..., tokens, rows, budget) from (levels..., tokens, rows): whole tokens for each leaf.

    ``weights`` has a dict for each level; a name that it lacks weighs 1, and 0 excludes a node.  Arithmetic is
    on whole numbers; rounding down leaves less than a token per node unassigned.
    """
    nodes = leaves
    for level, by_name in zip(levels, weights, strict=True):
        weight = F.lit(1)
        for name, value in by_name.items():
            weight = F.when(F.col(level) == name, F.lit(int(value))).otherwise(weight)
        nodes = nodes.withColumn(f"_weight_{level}", weight.cast("long"))
    # a node can take what its leaves can; an excluded node takes nothing
    open_ = F.lit(True)
    for level in levels:
        open_ = open_ & (F.col(f"_weight_{level}") > 0)
    nodes = nodes.withColumn("_room", F.when(open_, F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    given = None
    for i, level in enumerate(levels):
        path, parent = levels[: i + 1], levels[:i]
        here = nodes.groupBy(*path).agg(F.sum("_room").alias("room"), F.first(f"_weight_{level}").alias("weight"))
        here = here.withColumn("given", F.lit(budget).cast("long")) if given is None else here.join(given, parent)
        given = _shared(here, parent, level).select(*path, F.col("share").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "budget"), levels)


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``share``: the parent's ``given`` by ``weight``, at most ``room`` each, shortages shared among the rest.

    In the order of room per weight, children are full as long as their fair share of what is left exceeds their
    room; from the first one that isn't on, none is.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    useful = F.when(F.col("weight") > 0, F.col("room").cast("double") / F.col("weight")).otherwise(F.lit(0.0))
    order = group.orderBy("_full_at", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    some = children.withColumn("_full_at", useful)
    some = some.withColumn("_left", F.greatest(F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0)), F.lit(0))).withColumn("_weights", F.sum("weight").over(after))
    full = F.col("room").cast("decimal(38,0)") * F.col("_weights") <= F.col("_left").cast("decimal(38,0)") * F.col("weight")
    some = some.withColumn("_full", full)
    first = F.min(F.when(~F.col("_full"), F.struct("_full_at", name, "_left", "_weights"))).over(group)
    some = some.withColumn("_first", first)
    fair = F.expr("cast(cast(_first._left as decimal(38,0)) * weight div nullif(_first._weights, 0) as bigint)")
    is_full = F.col("_first").isNull() | (F.struct("_full_at", name) < F.struct("_first._full_at", f"_first.{name}"))
    return some.withColumn("share", F.when(is_full, F.col("room")).otherwise(F.least(F.coalesce(fair, F.lit(0)), F.col("room"))))


def shares(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: int | None = None, share: tuple[int, int] | None = None, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per leaf: what decides how often each of its documents enters (see :func:`taken`)."""
    names = list(levels)
    each = written(_tokens(docs, levels, id_col, text_col).select("_id", *names, "n_tokens"), "mix")
    leaves = written(each.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    if budget is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = total * share[0] // share[1]
    got = budgets(leaves, names, weights, budget, max_epochs)
    got = got.withColumn("epochs", F.expr("coalesce(budget div nullif(tokens, 0), 0)")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    got = written(got.withColumn("bins", F.expr(f"rows div {BIN_ROWS} + 1")), "budgets")

    dealt = _drawn(join_small(each, got, names), seed)
    bins = dealt.groupBy(*names, "_bin").agg(F.sum("n_tokens").alias("_tokens"), F.first("rest").alias("_rest"))
    before = F.coalesce(F.sum("_tokens").over(Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = written(bins.withColumn("_before", before), "bins")
    full = bins.groupBy(*names).agg(F.max(F.when((F.col("_rest") > 0) & (F.col("_before") + F.col("_tokens") <= F.col("_rest")), F.col("_bin"))).alias("full_bin"))
    ends = bins.where((F.col("_before") < F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_tokens")))  # a bin per leaf at most
    cuts = written(full.join(ends.select(*names, F.col("_bin").alias("_end"), "_before"), names, "left"), "cuts")

    # rows that tie (the same id and size) begin together, and so enter together
    upto = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("_at", "n_tokens")) - F.sum("n_tokens").over(Window.partitionBy(*names, "_at", "n_tokens"))
    cut = join_small(dealt, cuts, names).where("_bin = _end").withColumn("_begin", F.col("_before") + upto)
    last = cut.where(F.col("_begin") < F.col("rest")).groupBy(*names).agg(F.max(F.struct("_at", "n_tokens")).alias("last"))
    return written(got.select(*names, "epochs", "rest", "bins").join(cuts.select(*names, "full_bin"), names).join(last, names, "left"), "shares")


def _tokens(docs: DataFrame, levels: dict[str, Column], id_col: str, text_col: str) -> DataFrame:
    named = {n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in levels.items()}
    return docs.withColumns({**named, "_id": F.col(id_col), "n_tokens": word_count(F.col(text_col))})


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    at = rows.withColumn("_at", draw(seed, F.col("epochs"), F.col("_id")))
    return at.withColumn("_bin", F.expr("conv(substr(_at, 1, 8), 16, 10) * bins div 4294967296"))


def taken(docs: DataFrame, leaves: DataFrame, levels: dict[str, Column], seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the level names, ``n_tokens`` and ``copies``: the whole epochs of the leaf, plus one where the
    document begins within the prefix of the last epoch; a column of these names is replaced, any other stays what it is.
    ``leaves`` comes from :func:`shares` with the same
    arguments; it has a row per leaf, so texts stay where they are unless leaves are too many to broadcast."""
    # the columns of documents travel in one, so that none can be taken for another
    named = {n: F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()}
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("n_tokens"), *named.values())
    rows = _drawn(join_small(slim, leaves, list(levels)), seed)
    enters = F.coalesce(F.col("_bin") <= F.col("full_bin"), F.lit(False)) | F.coalesce(F.struct("_at", "n_tokens") <= F.col("last"), F.lit(False))
    copies = F.when(F.col("n_tokens") > 0, F.col("epochs") + enters.cast("long")).otherwise(F.lit(0)).cast("long")
    told = {**{n: F.col(n) for n in levels}, "n_tokens": F.col("n_tokens"), "copies": copies}
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in told]
    return rows.select(*kept, *[c.alias(n) for n, c in told.items()])


def mix(docs: DataFrame, levels: dict[str, Column], weights: list[dict[str, int]], budget: int | None = None, share: tuple[int, int] | None = None, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, levels..., n_tokens, copies): how often each document enters the mixture, a row per input row.

    Tokens are words.  The budget is ``budget`` tokens, or ``share`` (numerator, denominator) of all.  Null ids are
    drawn as the text ``null``, null levels form a branch named ``(none)``, documents without words never enter;
    rows of one id and size enter together.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[c.alias(n) for n, c in levels.items()])
    same = {n: F.col(n) for n in levels}
    leaves = shares(slim, same, weights, budget, share, max_epochs, seed, "doc_id", "_text")
    return taken(slim, leaves, same, seed, "doc_id", "_text").select("doc_id", *levels, "n_tokens", "copies")
