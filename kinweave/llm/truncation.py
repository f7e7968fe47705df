"""Texts cut off by field limits or in transfer.

Per source, the histograms of lengths in characters and in bytes are searched for spikes
at their upper end: a field limit piles up the texts that were longer.  A text at a spike
is cut unless it ends with terminal punctuation or with a closing line that could not
itself have been cut.  Away from the spikes the end of the text alone decides: it is open
if neither a sentence nor a complete closing line ends it, or if a mark stands for the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blank, control and zero-width characters that may follow the end of a text.
_BLANK = "".join(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0xAD, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF]))

_CLOSE = r"[\"'”’»›)\]*_]*"
#: Marks that stand for lost text.
_LOST = r"(…|\.\.+|\x{FFFD}|\[\s*(…|\.\.+)?\s*\]?|\(\s*(…|\.\.+)?\s*\)?)$"
#: Abbreviations whose full stop does not end a sentence.
_ABBREVIATED = r"(^|[\s(\[«\"])(?iu:f|op|spr|ark|fol|col|p|pp|no|vol|ca|st|ф|оп|спр|арк|стор|с|кол|р|ст|д|sygn|syg|k|ks|s|nr|zob)\.$"
_SENTENCE = rf"[.!?]{_CLOSE}$"
_BEFORE = rf"(^|\n|[.!?…]{_CLOSE}\s+)"
#: Closing lines that show by themselves that nothing is missing.
_SEALED = rf"{_BEFORE}\s*(0 TRLR|\* ?\* ?\*|\[[^\[\]\n]+\]|\([^()\n]+\)|«[^«»\n]+»|„[^„”\n]+”|\"[^\"\n]+\"|(?iu:amen|амінь|finis))$"
#: Closing lines that a cut could also have left: names, dates and references.
_NAME = r"\n\s*\p{Lu}[\p{L}\p{M}'’ʼ\-]+ \p{Lu}[\p{L}\p{M}'’ʼ\-]+( \p{Lu}[\p{L}\p{M}'’ʼ\-]+)?$"
_DATE = rf"{_BEFORE}\s*(\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}} \p{{L}}+ \d{{4}})$"
_REFERENCE = r"(^|\n|\s)(?iu:fol|ark|арк|col|k|p)\. ?\d+ ?(?iu:r|v|зв|об)$"


@dataclass(frozen=True)
class SpikeRule:
    """When a length counts as a field limit of its source."""

    least: int = 3  #: texts of that very length
    share: float = 0.01  #: of the source's texts
    beyond: float = 0.05  #: share of the source's texts that may be longer
    times: float = 4.0  #: the usual number of texts at one length near it
    near: int = 25


def _end(text: Column) -> Column:
    """The last line that says anything, whole, with the line break before it if there is one."""
    said = F.rtrim(text, F.lit(_BLANK))
    return F.when(F.contains(said, F.lit("\n")), F.concat(F.lit("\n"), F.substring_index(said, "\n", -1))).otherwise(said)


def length_spikes(documents: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """(source, unit, length, texts): field limits per source, in characters and in bytes.

    The histograms are aggregated over all texts before anything is compared, so one
    source with a third of all texts makes as many rows as it has lengths.
    """
    some = documents.filter(F.length(F.rtrim("text", F.lit(_BLANK))) > 0)
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")))
    histogram = some.select("source", F.explode(sizes).alias("x")).groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("texts"))
    within = W.partitionBy("source", "unit").orderBy("length")
    nearby = F.sum("texts").over(within.rangeBetween(-rule.near, rule.near)) - F.col("texts")
    longer = F.sum("texts").over(W.partitionBy("source", "unit").orderBy(F.desc("length"))) - F.col("texts")
    total = F.sum("texts").over(W.partitionBy("source", "unit"))
    return (
        histogram.withColumns({"nearby": nearby, "longer": longer, "total": total})
        .filter((F.col("texts") >= rule.least) & (F.col("texts") >= rule.share * F.col("total")) & (F.col("longer") <= rule.beyond * F.col("total")))
        .filter(F.col("texts") >= rule.times * F.greatest(F.col("nearby") / (2 * rule.near), F.lit(0.5)))
        .select("source", "unit", "length", "texts")
    )


def judged(documents: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Every document with ``at_limit`` (its length is a spike of its source) and ``truncated``.

    Null, empty and blank texts are not truncated; a null source is a source of its own;
    repeated documents are judged alike.
    """
    spikes = length_spikes(documents, rule).select(F.coalesce("source", F.lit("")).alias("from"), "unit", "length")
    limit = spikes.groupBy("from").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("length"))).alias("chars"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("length"))).alias("octets")
    )
    # one row per source, with at most 1 / share limits: far smaller than any text table
    rows = documents.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("from"), F.length("text").alias("n"), F.octet_length("text").alias("b"), _end(F.col("text")).alias("end"))
    seen = rows.join(F.broadcast(limit), "from", "left")
    at_limit = F.coalesce(F.array_contains("chars", F.col("n")) | F.array_contains("octets", F.col("b")), F.lit(False))
    end = F.col("end")
    sentence = end.rlike(_SENTENCE) & ~end.rlike(_ABBREVIATED)
    sealed = end.rlike(_SEALED)
    closing = end.rlike(_NAME) | end.rlike(_DATE) | end.rlike(_REFERENCE)
    lost = end.rlike(_LOST)
    whole = ~lost & (sentence | sealed | (closing & ~F.col("at_limit")))
    return seen.withColumn("at_limit", at_limit).select("doc_id", "source", "at_limit", F.coalesce((F.length("end") > 0) & ~whole, F.lit(False)).alias("truncated"))


def truncation_rates(documents: DataFrame, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """Per source: documents, truncated ones, those of them at a limit, and the rate."""
    cut = F.col("truncated").cast("int")
    return (
        judged(documents, rule).groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(cut).alias("truncated"), F.sum(cut * F.col("at_limit").cast("int")).alias("at_limit"))
        .withColumn("rate", F.col("truncated") / F.col("documents"))
    )
