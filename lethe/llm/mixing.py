"""Mixing sources to target weights: hierarchical token budgets over a domain - language - source tree.

A budget of tokens goes down the tree. At each node the children share it in proportion to their weights;
a child whose subtree cannot supply its share gives what it has, and the shortage goes to its siblings
first. Only where all children of a node are exhausted does the node itself fall short, which its own
siblings then make up, because a node's capacity is the sum over its leaves. A leaf then takes whole epochs
of its documents and, of the last epoch, a prefix of exactly the tokens that are left, in an order
seeded by epoch. All of it is DataFrame work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import saved, sized_broadcast

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("mx_domain", "mx_lang", "mx_source")
#: Leaves (rows of the tree) that may be broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 100_000


def n_tokens(text: Column) -> Column:
    """Number of words; none in a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_domain() -> Column:
    """The domain of a row of documents in the queries: the source's number modulo 4; 'none' without a number."""
    number = F.expr("try_cast(regexp_extract(source, '[0-9]+$', 0) as bigint)")
    return F.coalesce(F.concat(F.lit("domain"), F.pmod(number, F.lit(4)).cast("string")), F.lit("none"))


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``alloc`` to children(parent..., child, w, cap, budget): whole tokens that sum to min(budget, caps).

    Water filling: children in the order of cap / w; one whose proportional share of what is left reaches
    its cap takes the cap, the others split the rest, first children by name getting the odd tokens.
    A child of weight 0 gets nothing.
    """
    rows = children.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(0.0)))
    whole = Window.partitionBy(*parent)
    order = whole.orderBy("ratio", child)
    rows = rows.withColumn("b", F.least("budget", F.sum("cap").over(whole)))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    big = lambda c: c.cast("decimal(38,0)")
    rows = rows.withColumn("full", big(F.col("cap")) * after <= big(F.col("w")) * (F.col("b") - before))
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0).cast("long"))).over(whole)
    weight = F.sum(F.when(F.col("full"), F.lit(0).cast("long")).otherwise(F.col("w"))).over(whole)
    rows = rows.withColumn("left", F.col("b") - taken).withColumn("wu", weight)
    rows = rows.withColumn("base", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast((cast(w as decimal(38,0)) * left) div wu as bigint)")))
    odd = F.col("b") - F.sum("base").over(whole)
    nth = F.row_number().over(whole.orderBy(F.col("full").cast("int"), child))
    rows = rows.withColumn("alloc", F.col("base") + F.when(~F.col("full") & (nth <= odd), 1).otherwise(0))
    return rows.drop("ratio", "b", "full", "left", "wu", "base")


def leaf_budgets(rows: DataFrame, weights: tuple[Column, Column, Column], budget: Column | int, max_epochs: int) -> DataFrame:
    """(domain, language, source, tokens, alloc, full_epochs, rest) of each leaf of rows(LEVELS..., n_tokens)."""
    leaf = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("leaf_cap", F.col("tokens") * max_epochs)
    above: list[str] = []
    leaf = leaf.withColumn("root_", F.lit(0))
    total = leaf.groupBy("root_").agg(F.sum("tokens").alias("t"))
    given = total.select("root_", (budget(F.col("t")) if callable(budget) else F.lit(budget)).cast("long").alias("budget"))
    for level, weight in zip(LEVELS, weights, strict=True):
        keys = ["root_", *above]
        nodes = leaf.groupBy(*keys, level).agg(F.sum("leaf_cap").alias("cap")).withColumn("w", weight.cast("long")).join(given, keys)
        given = share(nodes, keys, level).select(*keys, level, F.col("alloc").alias("budget"))
        above.append(level)
    out = leaf.join(given, ["root_", *LEVELS]).select(*LEVELS, "tokens", F.col("budget").alias("alloc"))
    full = F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("full_epochs", full).withColumn("rest", F.col("alloc") - F.col("full_epochs") * F.col("tokens"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with mx_key: the order of a document in its leaf's last epoch; doc_id and text break ties."""
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return rows.withColumn("mx_key", F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mx_full").cast("string"), shown)).alias("m"), shown.alias("d"), F.col("mx_text").alias("t")))


def tree(docs: DataFrame, domain: Column) -> DataFrame:
    """docs with its leaf, its number of tokens and a digest of its text; a null language or source is 'none'."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return docs.withColumns({"mx_domain": domain, "mx_lang": none("lang"), "mx_source": none("source"), "mx_text": F.md5(text), "mx_tokens": n_tokens(F.col("text").cast("string"))})


def decided(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], budget, max_epochs: int, seed: int) -> DataFrame:
    """docs with mx_full (whole epochs), mx_prefix (tokens of the next epoch) and the columns of ``tree``.

    The place where a leaf's last epoch ends is found without ordering the leaf: tokens are summed by leading
    digits of the order key, about the square root of the number of rows of them, and only the rows of the one
    group that holds the end are ordered. Every row is then compared with its leaf's end.
    """
    full = tree(docs, domain)
    rows = saved(full.select("doc_id", *LEVELS, "mx_text", F.col("mx_tokens").alias("n_tokens")), "tokens")
    leaves = saved(leaf_budgets(rows, weights, budget, max_epochs), "leaves")
    n, n_leaves = rows.count(), leaves.count()
    digits = max(1, round(math.log(max(n, 1), 16) / 2))
    small = sized_broadcast(leaves.select(*LEVELS, F.col("full_epochs").alias("mx_full"), "rest"), n_leaves, BROADCAST_LEAVES)
    keyed = _keyed(rows.join(small, list(LEVELS)).where("n_tokens > 0 and rest > 0"), seed).withColumn("mx_group", F.substring("mx_key.m", 1, digits))
    place = [*LEVELS, "rest"]
    sums = keyed.groupBy(*place, "mx_group").agg(F.sum("n_tokens").alias("s"))
    upto = F.sum("s").over(Window.partitionBy(*place).orderBy("mx_group"))
    ends = saved(sums.withColumn("upto", upto).where("upto - s < rest and rest <= upto").select(*LEVELS, "mx_group", (F.col("upto") - F.col("s")).alias("start")), "ends")
    held = keyed.join(sized_broadcast(ends, n_leaves, BROADCAST_LEAVES), [*LEVELS, "mx_group"])
    upto = F.col("start") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("mx_key").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("upto", upto).where("upto - n_tokens < rest and rest <= upto")
    cuts = held.groupBy(*LEVELS).agg(F.min(F.struct("mx_key", (F.col("rest") - F.col("upto") + F.col("n_tokens")).alias("n"))).alias("mx_cut"))
    cuts = saved(leaves.select(*LEVELS, F.col("full_epochs").alias("mx_full")).join(cuts, list(LEVELS), "left"), "cuts")
    out = _keyed(full.join(sized_broadcast(cuts, n_leaves, BROADCAST_LEAVES), list(LEVELS)), seed)
    key, cut = F.col("mx_key"), F.col("mx_cut.mx_key")
    prefix = F.when(cut.isNull() | (key > cut), 0).when(key == cut, F.col("mx_cut.n")).otherwise(F.col("mx_tokens")).cast("long")
    return out.withColumn("mx_prefix", prefix).drop("mx_cut", "mx_key", "mx_text")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space included."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, domain: Column, weights: tuple[Column, Column, Column], budget, max_epochs: int = 1, seed: int = 11) -> DataFrame:
    """The mixed corpus: a row of docs' columns for every epoch a document is in, the last one's text cut to its prefix.

    docs needs doc_id, text, lang and source. Null texts and texts without words hold no tokens and are not drawn.
    A null doc_id is ordered as an empty one; rows equal in doc_id and text are cut alike. An empty table
    gives an empty one. n_chars, where docs has it as a number, is that of the text returned.
    """
    rows = decided(docs, domain, weights, budget, max_epochs, seed)
    times = F.array_repeat(F.lit(False), F.col("mx_full").cast("int"))
    times = F.when(F.col("mx_tokens") == 0, F.array().cast("array<boolean>")).when(F.col("mx_prefix") > 0, F.concat(times, F.array(F.lit(True)))).otherwise(times)
    rows = rows.withColumn("mx_last", F.explode(times))
    cut = F.col("mx_last") & (F.col("mx_prefix") < F.col("mx_tokens"))
    rows = rows.withColumn("text", F.when(cut, first_words(F.col("text").cast("string"), F.col("mx_prefix"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: Target weights of the queries. A domain's falls with its number; languages and sources as given, 1 elsewhere.
WEIGHTS = (
    lambda: F.when(F.col("mx_domain") == "domain0", 4).when(F.col("mx_domain") == "domain1", 3).when(F.col("mx_domain") == "domain2", 2).otherwise(1),
    lambda: F.when(F.col("mx_lang") == "en", 6).when(F.col("mx_lang").isin("de", "fr"), 2).otherwise(1),
    lambda: F.when(F.col("mx_source").isin("src1", "src2"), 2).otherwise(1),
)
MAX_EPOCHS, SEED = 2, 11


def half(tokens: Column) -> Column:
    """The queries' budget: half of all tokens."""
    return F.floor(tokens / 2)


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its leaf, its tokens and what the mixture takes of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = decided(docs, source_domain(), tuple(w() for w in WEIGHTS), half, MAX_EPOCHS, SEED)
    taken = F.col("mx_full") * F.col("mx_tokens") + F.col("mx_prefix")
    return rows.select("doc_id", F.col("mx_domain").alias("domain"), F.col("mx_lang").alias("lang"), F.col("mx_source").alias("source"), F.col("mx_tokens").alias("n_tokens"), F.col("mx_full").alias("full_epochs"), F.col("mx_prefix").alias("prefix_tokens"), taken.alias("taken_tokens"))


def _share_sql(level: int) -> str:
    """One level of water filling for the oracle: tree{level}(keys..., budget) from the level above."""
    names = ["d", "l", "s"]
    keys, child = names[:level], names[level]
    part = ", ".join(["1", *keys])
    weight = {"d": "CASE d WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END", "l": "CASE WHEN l = 'en' THEN 6 WHEN l IN ('de', 'fr') THEN 2 ELSE 1 END", "s": "CASE WHEN s IN ('src1', 'src2') THEN 2 ELSE 1 END"}[child]
    above = "(SELECT CAST(floor(sum(n) / 2) AS BIGINT) AS budget FROM toks)" if not level else f"tree{level - 1}"
    using = "ON true" if not level else f"USING ({', '.join(keys)})"
    cols = ", ".join([*keys, child])
    return f"""
a{level} AS (SELECT {cols}, sum(n) * {MAX_EPOCHS} AS cap, any_value({weight}) AS w FROM toks GROUP BY {cols}),
b{level} AS (SELECT *, least(budget, sum(cap) OVER (PARTITION BY {part})) AS b FROM a{level} JOIN {above} q{level} {using}),
c{level} AS (SELECT *, cap * sum(w) OVER (PARTITION BY {part} ORDER BY CAST(cap AS DOUBLE) / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
   <= w * (b - coalesce(sum(cap) OVER (PARTITION BY {part} ORDER BY CAST(cap AS DOUBLE) / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS full_ FROM b{level}),
e{level} AS (SELECT *, CASE WHEN full_ THEN cap ELSE (w * (b - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {part}))) // nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {part}), 0) END AS base FROM c{level}),
tree{level} AS (SELECT {cols}, base + CASE WHEN NOT full_ AND row_number() OVER (PARTITION BY {part} ORDER BY CAST(full_ AS INT), {child}) <= b - sum(base) OVER (PARTITION BY {part}) THEN 1 ELSE 0 END AS budget FROM e{level}),"""


ORACLE_SQL = rf"""
WITH toks AS (
  SELECT doc_id, coalesce('domain' || CAST(TRY_CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 4 AS VARCHAR), 'none') AS d,
    coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n
  FROM documents),{_share_sql(0)}{_share_sql(1)}{_share_sql(2)}
leaf AS (SELECT d, l, s, budget, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS fe FROM tree2 JOIN (SELECT d, l, s, sum(n) AS tokens FROM toks GROUP BY d, l, s) t USING (d, l, s)),
run AS (SELECT doc_id, d, l, s, n, fe, budget - fe * tokens AS rest,
  sum(n) OVER (PARTITION BY d, l, s ORDER BY md5('{SEED}:' || CAST(CAST(fe AS BIGINT) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) - n AS begin_
  FROM toks JOIN leaf USING (d, l, s))
SELECT doc_id, d AS "domain", l AS lang, s AS source, CAST(n AS BIGINT) AS n_tokens, CAST(fe AS BIGINT) AS full_epochs,
  CAST(greatest(0, least(n, rest - begin_)) AS BIGINT) AS prefix_tokens, CAST(fe * n + greatest(0, least(n, rest - begin_)) AS BIGINT) AS taken_tokens
FROM run
"""
