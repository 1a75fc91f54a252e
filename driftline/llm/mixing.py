"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

Leaves are (domain, language, source). A token budget is shared out from the
root: among domains by weight, then among a domain's languages, then among a
language's sources. A node can take no more than its leaves hold times the number
of epochs allowed; what one can't take goes to its siblings by weight, and only
when all siblings are full does less reach the parent, so its own siblings get
the rest. A leaf's budget is met by whole epochs of all its documents and, of the
next epoch, the longest prefix in a seeded order that fits in the tokens left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEAF = ["domain", "lang", "source"]
#: Hexadecimal digits of the order key that make a bucket of the prefix search.
_BUCKET_DIGITS = 3


@dataclass(frozen=True)
class MixParams:
    """Weights by name at each level (default 1; 0 leaves a node out), budget in thousandths of all tokens."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    budget_permille: int = 900
    max_epochs: int = 3
    seed: str = "mix-1"


def tokens(text: str | Column) -> Column:
    r"""Number of words `[^\x20\x09-\x0D]+`; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v)])
    return F.coalesce(named[F.col(column)], F.lit(1)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `alloc`: each parent's `budget` over its children by `weight`, none above `cap`, whole tokens.

    In ascending order of cap / weight the full nodes come first: one is full if
    its cap is at most its share of what earlier full ones leave. The rest divide
    the remainder by weight. Up to one token a node is lost to rounding.
    """
    live = nodes.where("weight > 0")
    order = [(F.col("cap") / F.col("weight")).asc(), F.col(name).asc()]
    upto = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - (F.sum("cap").over(upto) - F.col("cap"))
    share = F.sum("weight").over(whole) - (F.sum("weight").over(upto) - F.col("weight"))
    step = live.select("*", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)).alias("_n"), left.alias("_left"), share.alias("_share"))
    step = step.withColumn("_first", F.min(F.when(F.col("cap") * F.col("_share") > F.col("_left") * F.col("weight"), F.col("_n"))).over(whole))
    at_first = F.col("_n") == F.col("_first")
    step = step.withColumn("_l", F.max(F.when(at_first, F.col("_left"))).over(whole)).withColumn("_s", F.max(F.when(at_first, F.col("_share"))).over(whole))
    full = F.col("_first").isNull() | (F.col("_n") < F.col("_first"))
    alloc = F.when(full, F.col("cap")).otherwise(F.expr("(greatest(_l, 0L) * weight) div _s"))
    return step.withColumn("alloc", alloc).drop("_n", "_left", "_share", "_first", "_l", "_s")


def budgets(supply: DataFrame, p: MixParams) -> DataFrame:
    """(domain, lang, source, supply, alloc) from the leaves' token counts (`supply`)."""
    leaves = supply.withColumn("cap", F.col("supply") * F.lit(p.max_epochs))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("budget", F.expr(f"(sum(supply) over () * {p.budget_permille}L) div 1000L")).withColumn("root", F.lit(0))
    domains = water_fill(domains.withColumn("weight", _weight("domain", p.domains)), ["root"], "domain").select("domain", F.col("alloc").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("weight", _weight("lang", p.langs))
    langs = water_fill(langs, ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    sources = leaves.join(langs, ["domain", "lang"]).withColumn("weight", _weight("source", p.sources))
    return water_fill(sources, ["domain", "lang"], "source").select(*LEAF, "supply", "alloc")


def _leafed(docs: DataFrame, domain: Column, p: MixParams, id_col: str, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    return [
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(domain, F.lit("none")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("none")).alias("source"),
    ]


def _key(p: MixParams) -> Column:
    """Place of a document in its leaf's unfinished epoch."""
    return F.md5(F.concat_ws(":", F.lit(p.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _chosen(p: MixParams) -> Column:
    """Copies of a row joined to its leaf's cut: whole epochs, and one more up to the cut."""
    key = F.col("_key")
    bucket = F.substring(key, 1, _BUCKET_DIGITS)
    more = (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & (key <= F.col("cut_key")))
    return F.when(F.col("n_tokens") == 0, F.lit(0)).otherwise(F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(more.cast("long"), F.lit(0))).cast("long")


def cuts(light: DataFrame, p: MixParams) -> DataFrame:
    """One row a leaf: whole epochs and the last key of the prefix (`cut_bucket`, `cut_key`).

    The prefix is searched in two steps, over the token sums of key buckets and
    then inside the one bucket where the budget runs out, so a leaf with a third
    of all documents isn't sorted in one task.
    """
    supply = light.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply"))
    plan = budgets(supply, p).withColumn("epochs", F.when(F.col("supply") > 0, F.expr("alloc div supply")).otherwise(F.lit(0)).cast("long"))
    plan = materialise(plan.withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("supply")))
    keyed = light.where("n_tokens > 0").join(plan.select(*LEAF, "epochs", "rest").where("rest > 0"), LEAF).withColumn("key", _key(p))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, _BUCKET_DIGITS))
    sums = keyed.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(run))
    crossing = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))).select(*LEAF, "bucket", (F.col("upto") - F.col("n")).alias("before"))
    crossing = materialise(crossing)
    inside = keyed.join(crossing, [*LEAF, "bucket"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key")))
    last = inside.where(F.col("upto") <= F.col("rest")).groupBy(*LEAF).agg(F.max("key").alias("cut_key"))
    cut = crossing.select(*LEAF, F.col("bucket").alias("cut_bucket")).join(last, LEAF, "left")
    return materialise(plan.join(cut, LEAF, "left"))


def mix(docs: DataFrame, domain: Column, p: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) for each row; copies says how often it is in the mix.

    A null domain or source is a node `none`, a null language `und`. A null or
    wordless text has no tokens and no copies. Rows with equal ids in a leaf have
    one place in the order and are taken together or not at all.
    """
    light = materialise(docs.select(*_leafed(docs, domain, p, id_col, text_col, lang_col, source_col), tokens(text_col).alias("n_tokens")))
    plan = cuts(light, p).select(*LEAF, "epochs", "cut_bucket", "cut_key")
    return light.join(plan, LEAF, "left").withColumn("_key", _key(p)).select("doc_id", *LEAF, "n_tokens", _chosen(p).alias("copies"))


def select(docs: DataFrame, domain: Column, p: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` in the mix, each as often as it has copies, with the columns of `docs`.

    The leaves' cuts are joined to the rows where they are; texts aren't shuffled.
    """
    own = docs.columns
    leafed = _leafed(docs, domain, p, id_col, text_col, lang_col, source_col)
    light = materialise(docs.select(*leafed, tokens(text_col).alias("n_tokens")))
    plan = cuts(light, p).select(*LEAF, "epochs", "cut_bucket", "cut_key")
    held = docs.select(F.struct(*own).alias("_row"), *leafed, tokens(text_col).alias("n_tokens"))
    out = held.join(plan, LEAF, "left").withColumn("_key", _key(p)).withColumn("copies", _chosen(p)).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def sql(domain: str, p: MixParams) -> str:
    """DuckDB SQL for `mix` over the table documents; `domain` is a SQL expression."""
    def weights(column: str, w: dict[str, int]) -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END" if w else "1"

    def fill(source: str, parent: str, name: str) -> str:
        by, order = f"PARTITION BY {parent}", f"ORDER BY CAST(cap AS DOUBLE) / weight, {name}"
        rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return f"""SELECT *, CASE WHEN f IS NULL OR n < f THEN cap ELSE (greatest(l, 0) * weight) // s END AS alloc FROM (
          SELECT *, max(CASE WHEN n = f THEN remaining END) OVER ({by}) AS l, max(CASE WHEN n = f THEN share END) OVER ({by}) AS s FROM (
            SELECT *, min(CASE WHEN cap * share > remaining * weight THEN n END) OVER ({by}) AS f FROM (
              SELECT *, row_number() OVER ({by} {order}) AS n, budget - (sum(cap) OVER ({by} {order} {rows}) - cap) AS remaining,
                sum(weight) OVER ({by}) - (sum(weight) OVER ({by} {order} {rows}) - weight) AS share
              FROM ({source}) WHERE weight > 0)))"""

    return rf"""WITH light AS (
        SELECT doc_id, coalesce({domain}, 'none') AS domain, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source,
          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM documents),
      leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS supply, CAST(sum(n_tokens) AS HUGEINT) * {p.max_epochs} AS cap FROM light GROUP BY ALL),
      d AS ({fill(f"SELECT 0 AS root, domain, sum(cap) AS cap, ((SELECT sum(supply) FROM leaves) * {p.budget_permille}) // 1000 AS budget, {weights('domain', p.domains)} AS weight FROM leaves GROUP BY domain", "root", "domain")}),
      g AS ({fill(f"SELECT x.domain, x.lang, sum(x.cap) AS cap, max(d.alloc) AS budget, {weights('x.lang', p.langs)} AS weight FROM leaves x JOIN d ON x.domain = d.domain GROUP BY x.domain, x.lang", "domain", "lang")}),
      s AS ({fill(f"SELECT x.domain, x.lang, x.source, x.supply, x.cap, g.alloc AS budget, {weights('x.source', p.sources)} AS weight FROM leaves x JOIN g ON x.domain = g.domain AND x.lang = g.lang", "domain, lang", "source")}),
      plan AS (SELECT domain, lang, source, supply, alloc, CASE WHEN supply > 0 THEN alloc // supply ELSE 0 END AS epochs FROM s),
      keyed AS (SELECT a.*, coalesce(b.epochs, 0) AS epochs, coalesce(b.alloc - b.epochs * b.supply, 0) AS rest,
          md5(concat_ws(':', '{p.seed}', CAST(CAST(b.epochs AS BIGINT) AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key
        FROM light a LEFT JOIN plan b ON a.domain = b.domain AND a.lang = b.lang AND a.source = b.source),
      summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed)
      SELECT doc_id, domain, lang, source, n_tokens, CAST(CASE WHEN n_tokens = 0 THEN 0 ELSE epochs + (CASE WHEN upto <= rest THEN 1 ELSE 0 END) END AS BIGINT) AS copies FROM summed"""
