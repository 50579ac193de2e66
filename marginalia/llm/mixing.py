"""Mixing sources to target weights by Efraimidis-Spirakis sampling. [DataFrame operations only]

Each source gets a share of all words by its weight, at most ``most`` times its own size; what a
source can't use is shared among the others by weight. A source's whole epochs come first; the
rest of its target is drawn without replacement: a document's key is an exponential variate divided by
its quality weight, keys are sorted within the source, and sizes are prefix-summed up to the budget.

The order within a source is found in two steps, so that no task sees a whole source: sizes are summed
by ranges of the key (equal ones on the logistic scale of its logarithm, where no key is lost to rounding), and only the
range in which the budget ends is sorted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import written
from marginalia.llm.simhash import row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Signs that prose hardly has, runs of letters that end as words do, and the least weight.
NOISE_SIGNS, LETTERS, LEAST_WEIGHT = "%#$&*|!<>{}=_~^@\\", r"\p{L}+(?=[\s.,;:?]|$)", 0.05
#: A range of keys holds about so many documents of all sources.
ROWS_PER_RANGE = 1000
#: Up to so many sources the plan of the sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def quality_weight(text: Column, size: Column) -> Column:
    """1 for prose, down to 0.05: the share of words that are letters to their end, squared, less five times the share of
    signs that prose hardly has. ``size``: the text's words."""
    signs = (F.length(text) - F.length(F.translate(text, NOISE_SIGNS, ""))) / F.greatest(F.length(text), F.lit(1))
    plain = F.least(F.lit(1.0), F.regexp_count(text, F.lit(LETTERS)) / F.greatest(size, F.lit(1)))
    return F.greatest(F.lit(LEAST_WEIGHT), plain * plain - 5 * signs)


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, weight and target from rows (source, source_size): weights 1, 2, 3, repeating
    over the sources by code point, null last; a target is at most ``most`` times the source's size.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    cap = F.col("source_size") * most
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(by_need), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(by_need), F.lit(0))))
        # the first source, by need, that its cap doesn't bind: its level holds for all later ones
        .withColumn("free_level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("free_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free_level") * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, most: float = 3.0, seed: int = 29, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words), source_size, target of the source, taken: the document's words that
    the mix takes, repeats counted (whole epochs, then one more time, or a beginning, if it is drawn).

    ``weight``: a positive quality weight per row; the default looks at the text's words and signs. A null text has
    size 0 and takes 0; a null source is a source of its own. Rows that repeat a doc_id are drawn next to
    one another. Documents without words take 0; an empty table gives an empty result. Reruns agree. Other columns are not
    looked at; those in ``carried`` come along behind.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            size.alias("size"),
            (-F.log(uniform) / (quality_weight(text, size) if weight is None else weight)).alias("key"),
            *carried,
        ),
        "mixing-sizes",
    )
    ranges = max(64, rows.count() // ROWS_PER_RANGE)
    rows = rows.withColumn("range", F.least(F.floor(F.col("key") / (1 + F.col("key")) * ranges), F.lit(ranges - 1)))
    by_range = written(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mixing-ranges")

    sources = source_targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    r, s = by_range.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).alias("r"), sources.alias("s")
    last = (
        r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")))
        .where(F.col("before") <= F.col("rest"))
        .groupBy("s.source", "source_size", "target", "epochs", "rest")
        .agg(F.max_by("range", "range").alias("last_range"), F.max("before").alias("before"))
    )
    plan = written(last, "mixing-plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan

    joined = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    out = ["doc_id", F.col("d.source").alias("source"), "size", "source_size", "target"]
    taken = lambda words: [*out, words.alias("taken"), *carried]
    decided = joined.where(F.col("range") != F.col("last_range")).select(*taken(F.col("size") * (F.col("epochs") + (F.col("range") < F.col("last_range")).cast("long"))))
    within = Window.partitionBy("d.source").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    ending = joined.where(F.col("range") == F.col("last_range")).select(*taken(F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), left))))
    return decided.unionByName(ending)


def mixed_documents(docs: DataFrame, most: int = 3) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: each whole take is a row, and a part of a
    document is a row with the text's first words, a space between them. Documents that the mix doesn't take go.
    Rows are known by doc_id, source and text, so ids may repeat or lack; of rows alike in all three, each has its own take.
    """
    names, key = docs.columns, row_key("doc_id", "source", "text").alias("row_mixed")
    own = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("doc"), key)
    # Rows of one key are alike, so they have few different takes; each is counted.
    takes = mix(docs.select("doc_id", "source", "text", key), most=float(most), carried=("row_mixed",)).groupBy("row_mixed", "taken", "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("row_mixed").orderBy("taken", "size"))
    takes = takes.withColumn("upto", upto).groupBy("row_mixed").agg(F.sort_array(F.collect_list(F.struct("upto", "taken", "size"))).alias("takes"))
    nth = F.row_number().over(Window.partitionBy("row_mixed").orderBy(F.xxhash64("doc")))
    rows = own.join(takes, "row_mixed").withColumn("nth_mixed", nth).select("doc", F.element_at(F.filter("takes", lambda t: t["upto"] >= F.col("nth_mixed")), 1).alias("take"))
    taken, size = F.col("take.taken"), F.col("take.size")
    copies = F.when((size > 0) & (taken > 0), F.sequence(F.lit(1), F.ceil(taken / size).cast("int")))
    part = taken % size
    words = F.split(F.regexp_replace(F.col("doc.text"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    beginning = F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")
    rows = rows.select("doc", "take", F.explode(copies).alias("copy"))
    rows = rows.select(F.col("doc").withField("text", F.when((part > 0) & (F.col("copy") == F.ceil(taken / size)), beginning).otherwise(F.col("doc.text"))).alias("doc"))
    if "n_chars" in names:
        rows = rows.select(F.col("doc").withField("n_chars", F.length("doc.text").cast("long")).alias("doc"))
    return rows.select("doc.*")
