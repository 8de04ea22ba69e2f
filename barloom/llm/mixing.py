"""Mixing sources to target weights by iterative proportional fitting (operator 1), native functions only.

Documents are summed into cells of source, language and topic. The cells' token weights are raked in
turn to the target shares of each margin until all margins agree; the ratio of raked to present
weight, scaled so that the largest is 1, is the probability with which a document of the cell is
drawn. Expected tokens of the sample then have the target shares in all three margins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.base import stage, whole_text, without, words_of

MARGINS = ("source", "lang", "topic")
SMALL = 10_000  # cells up to this number are broadcast, more are joined by hash
SMALL_MARGIN = 1_000  # values of a margin up to this number are a literal in the plan, more are a table
TOLERANCE = 1e-13  # of the shares of each margin

# Topics by a mark in the text, first match counts (fixed values of this library).
TOPICS = (("licence", ("License", "license", "Copyright", "copyright")), ("table", (" | ",)), ("shouting", ("!!",)), ("contact", ("@", " +")))


RESULTS = ("mx_source", "mx_lang", "mx_topic", "mx_tokens", "mx_draw", "mx_probability", "mx_kept")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, marks in reversed(TOPICS):
        out = F.when(reduce(Column.__or__, [text.contains(m) for m in marks]), name).otherwise(out)
    return out


def described(docs: DataFrame, seed: str = "") -> DataFrame:
    """docs plus mx_source, mx_lang, mx_topic, mx_tokens and mx_draw; columns of these names are replaced."""
    docs = without(docs, RESULTS)
    text = whole_text()
    return docs.withColumns({
        "mx_source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "mx_lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")),
        "mx_topic": topic_of(text), "mx_tokens": words_of(text), "mx_draw": draw(F.col("doc_id"), text, seed)})


def target_shares(cells: DataFrame, margin: str, power: float, wanted: dict[str, float] | None) -> DataFrame:
    """Target share of each value of a margin: given weights, or present tokens to a power (under 1: flatter)."""
    sums = cells.groupBy(f"mx_{margin}").agg(F.sum("tokens").alias("present")).where("present > 0")
    if wanted:
        pick = F.lit(0.0)
        for value, weight in wanted.items():
            pick = F.when(F.col(f"mx_{margin}") == value, float(weight)).otherwise(pick)
        sums = sums.withColumn("goal", pick)
    else:
        sums = sums.withColumn("goal", F.pow(F.col("present").cast("double"), F.lit(power)))
    total = sums.agg(F.sum("goal").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select(f"mx_{margin}", (F.col("goal") / F.col("all")).alias("target"))  # total is one row


class Factors:
    """Raking factor of each value of a margin, by which cells are multiplied.

    Up to `small` values are a literal map in the plan; more are a written table that cells meet by a
    sorted join. Either way a step of the raking reads the fixed cells and the factors of the step
    before, so no plan grows with the rounds.
    """

    def __init__(self, margin: str, goals: DataFrame, small: int) -> None:
        self.key, self.goals, self.few = f"mx_{margin}", goals, goals.count() <= small
        self.name, self.now = f"_f_{margin}", None

    def applied(self, cells: DataFrame) -> DataFrame:
        if self.now is None:
            return cells.withColumn(self.name, F.lit(1.0))
        if self.few:
            pairs = [F.lit(x) for kv in self.now for x in kv]
            return cells.withColumn(self.name, F.element_at(F.create_map(*pairs), F.col(self.key)))
        return cells.join(self.now.hint("merge"), self.key)

    def fitted(self, cells: DataFrame, others: list[Factors]) -> float:
        """Fit to the target under the other margins' factors; returns how far off the margin was."""
        for o in others:
            cells = o.applied(cells)
        weight = reduce(Column.__mul__, [F.col(o.name) for o in others], F.col("weight"))
        sums = cells.groupBy(self.key).agg(F.sum(weight).alias("_is")).join(self.goals.hint("merge"), self.key)
        sums = self.applied(sums).select(self.key, F.abs(F.col("_is") * F.col(self.name) - F.col("target")).alias("_off"), F.when(F.col("_is") > 0, F.col("target") / F.col("_is")).otherwise(0.0).alias(self.name))
        if self.few:
            rows = sums.collect()
            self.now = [(r[self.key], r[self.name]) for r in rows]
            return max(r["_off"] for r in rows)
        sums = stage(sums, "op1-factors")
        self.now = sums.drop("_off")
        return sums.agg(F.max("_off")).first()[0]


def raked(cells: DataFrame, powers: dict[str, float], wanted: dict[str, dict[str, float]], tolerance: float = TOLERANCE, rounds: int = 100, small: int = SMALL_MARGIN, strict: bool = True) -> DataFrame:
    """Cells with their raked weight; the rounds end where every margin is within `tolerance` of its target.

    The cells keep their present weight; each margin has one table of factors, fitted in turn to the
    cells times the factors of the other margins. A cell's raked weight is the product at the end. Targets
    that contradict each other are an error; without `strict`, the weights after `rounds` rounds count, of
    which the last margin is met.
    """
    total = cells.agg(F.sum("tokens").alias("all"))
    base = stage(cells.where("tokens > 0").crossJoin(F.broadcast(total)).withColumn("weight", F.col("tokens") / F.col("all")).drop("all"), "op1-weights")
    if base.isEmpty():
        return base
    factors = [Factors(m, stage(target_shares(cells, m, powers.get(m, 0.5), wanted.get(m)), f"op1-{m}"), small) for m in MARGINS]
    for _ in range(rounds):
        worst = max(f.fitted(base, [o for o in factors if o is not f]) for f in factors)
        if worst < tolerance:
            break
    else:
        if strict:
            raise RuntimeError(f"margins do not agree after {rounds} rounds (off by {worst:.3g}): the targets cannot be met together")
    for f in factors:
        base = f.applied(base)
    return base.withColumn("weight", reduce(Column.__mul__, [F.col(f.name) for f in factors], F.col("weight"))).drop(*[f.name for f in factors])


def draw(doc_id: Column, text: Column, seed: str = "") -> Column:
    """Even number in [0, 1) that depends on the document alone."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), text), F.lit(seed))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def drawn(rows: DataFrame, powers: dict[str, float] | None = None, wanted: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """Described rows plus mx_probability and mx_kept."""
    sums = rows.groupBy("mx_source", "mx_lang", "mx_topic").agg(F.sum("mx_tokens").alias("tokens"))
    cells = raked(stage(sums, "op1-cells"), powers or {}, wanted or {}, tolerance, strict=strict)
    ratio = cells.withColumn("ratio", F.col("weight") / F.col("tokens"))
    top = ratio.agg(F.max("ratio").alias("top"))
    chance = stage(ratio.crossJoin(F.broadcast(top)).select("mx_source", "mx_lang", "mx_topic", (F.col("ratio") / F.col("top")).alias("mx_probability")), "op1-chances")
    if chance.count() <= SMALL:
        chance = F.broadcast(chance)
    out = rows.join(chance, ["mx_source", "mx_lang", "mx_topic"], "left").withColumn("mx_probability", F.when(F.col("mx_tokens") > 0, F.coalesce("mx_probability", F.lit(0.0))).otherwise(0.0))
    return out.withColumn("mx_kept", F.col("mx_draw") < F.col("mx_probability")).select(*rows.columns, "mx_probability", "mx_kept")


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, wanted: dict[str, dict[str, float]] | None = None, seed: str = "", tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """docs plus mx_source, mx_lang, mx_topic, mx_tokens, mx_draw, mx_probability, mx_kept.

    docs: doc_id, text, lang, source, more columns allowed. Null lang or source is the value
    "unknown". A document without words weighs nothing and is not drawn. powers: exponent per margin
    (0.5 where none is given), wanted: given weights per margin, which replace the exponent; values
    that they leave out get nothing. Repeated rows are drawn together, as the draw depends on doc_id.
    Every margin ends within `tolerance` of its target share; see `raked` for targets that contradict each
    other. Columns of docs with the name of a result
    are replaced by it.
    """
    return drawn(described(docs, seed), powers, wanted, tolerance, strict)
