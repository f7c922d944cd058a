"""Mixing sources to target weights.

With T the tokens of all texts of listed sources, each once, a source is given
min(target_share x T, max_repeats x its tokens); what a source falls short of is reported,
never made up by a sample of another.

1. Each text's size is counted with a public tokenizer and written once.
2. Per source and repeat, texts stand in a seeded random order; prefix sums of their tokens
   (two levels: totals of hash buckets, then rows within a bucket) cut them into blocks of
   equal tokens. No task ever orders a whole source.
3. Slot i of the schedule takes the van der Corput point of i, its binary digits mirrored,
   which the cumulative weights map to a source; the k-th slot of a source takes its k-th
   block. So every stretch of the mix holds the shares as nearly as its number of slots
   allows. The weights are the blocks placed and the slots a power of two from their number
   on (less than twice as many): over all slots every point of that grid comes once, so each
   source gets at least as many slots as it has blocks, however few these are. Points and
   bounds are whole numbers, exact at every size.
4. The report reads the finished mix: a source is short if its rows hold fewer tokens than
   its target share of T.

Source names are compared lower-cased, trimmed, with ``-`` and blanks as ``_``; texts of null or
unlisted sources and texts without tokens take no part. Rows that repeat a doc_id count as
texts of their own. Targets must be few (``MOST_SOURCES``); an empty target table or corpus gives
an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.encoding import TOKENIZERS, count_tokens
from siltstone.runtime import cut_lineage, shuffle_width

MOST_SOURCES = 10_000
SLOT_RUN = 4096


def source_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), "[-\\s]+", "_")


@dataclass(frozen=True)
class Quota:
    source: str
    share: float
    repeats: int
    texts: int
    available: int
    wanted: float
    quota: float

    @property
    def short(self) -> bool:
        """Whether the plan expects a shortfall; ``share_report`` reads it from the mix."""
        return self.available * self.repeats < self.wanted

    @property
    def passes(self) -> int:
        """How often its texts are gone through to fill the quota."""
        n = math.ceil(self.quota / self.available)
        return n + (n * self.available < self.quota)


@dataclass(frozen=True)
class Mix:
    sized: DataFrame
    quotas: list[Quota]
    rows: DataFrame


def plan_quotas(sized: DataFrame, targets: DataFrame) -> list[Quota]:
    """What each listed source is to give; one row for each source reaches the driver."""
    wanted = targets.where(F.col("source").isNotNull()).groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the target table")
    names = sized.sparkSession.createDataFrame([(r["source"],) for r in wanted], "source string")
    totals = {r["source"]: r for r in sized.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("texts")).collect()}
    total = sum(int(r["tokens"]) for r in totals.values())
    out = []
    for r in wanted:
        have = int(totals[r["source"]]["tokens"]) if r["source"] in totals else 0
        share, repeats = float(r["share"] or 0.0), int(r["repeats"] or 0)
        out.append(Quota(r["source"], share, repeats, int(totals[r["source"]]["texts"]) if have else 0, have, share * total, min(share * total, float(have * repeats))))
    return out


def mirrored(c: Column, bits: int) -> Column:
    """The lowest ``bits`` binary digits of a whole number in reverse order: its van der Corput point times 2^bits."""
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        c = F.shiftrightunsigned(c, step).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(c.bitwiseAND(F.lit(mask)), step))
    return F.shiftrightunsigned(F.shiftrightunsigned(c, 32).bitwiseOR(F.shiftleft(c, 32)), 64 - bits)


def slot_ranks(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """(source, k, slot): the slot of the k-th block of each source, for so many blocks a source."""
    count = sum(blocks.values())
    bits = max(1, (count - 1).bit_length())
    # A source's points are a range of whole numbers; ranges are cut into runs that spread over the tasks.
    ends, ranges = 0, []
    for source, n in blocks.items():
        ranges.append((source, (ends << bits) // count, ((ends + n) << bits) // count - 1))
        ends += n
    starts = spark.createDataFrame(ranges, "source string, low bigint, high bigint").withColumn("low", F.explode(F.sequence("low", "high", F.lit(SLOT_RUN).cast("bigint"))))
    runs = starts.repartition(max(shuffle_width(spark), (1 << bits) // (256 * SLOT_RUN)))
    points = runs.select("source", F.explode(F.sequence("low", F.least(F.col("low") + SLOT_RUN - 1, F.col("high")))).alias("point"))
    schedule = points.select("source", mirrored(F.col("point"), bits).alias("id")).withColumn("c", F.floor(F.col("id") / SLOT_RUN))
    counts = schedule.groupBy("source", "c").agg(F.count("*").alias("n"))
    offset = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("c")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("source", "c").orderBy("id"))
    return schedule.join(offset, ["source", "c"]).select("source", (F.col("before") + inner - 1).alias("k"), F.col("id").alias("slot"))


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, block_tokens: int = 2048, folder: str = TOKENIZERS) -> Mix:
    """Rows (slot, source, doc_id, repeat_no, tokens); ordered by slot they are the mix."""
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), source_name(source_col).alias("source"), F.col(text_col).alias("t"))
    sized = cut_lineage(count_tokens(named, ["doc_id", "source"], "t", folder))
    quotas = plan_quotas(sized, targets)
    giving = [q for q in quotas if q.quota > 0]
    empty = sized.select(F.lit(0).cast("bigint").alias("slot"), "source", "doc_id", F.lit(0).alias("repeat_no"), "tokens").where("false")
    if not giving:
        return Mix(sized, quotas, empty)
    plan = F.broadcast(docs.sparkSession.createDataFrame([(q.source, q.passes, q.available, q.quota) for q in giving], "source string, passes int, available bigint, quota double"))  # MOST_SOURCES rows at most
    buckets = max(16, min(65_536, sum(q.texts for q in giving) // 20_000))

    uses = sized.where(F.col("tokens") > 0).join(plan, "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    uses = uses.withColumn("h", F.xxhash64("doc_id", "repeat_no", F.lit(seed))).withColumn("b", F.pmod(F.shiftrightunsigned("h", 40), F.lit(buckets)).cast("int"))
    key = ["source", "repeat_no", "b"]
    sums = uses.groupBy(*key).agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source", "repeat_no").orderBy("b")) - F.col("s")).drop("s")
    inner = Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = uses.join(before, key).withColumn("at", F.col("before") + F.sum("tokens").over(inner) - F.col("tokens") + F.col("repeat_no") * F.col("available"))
    placed = placed.where(F.col("at") < F.col("quota"))
    placed = cut_lineage(placed.select("source", "doc_id", "repeat_no", "tokens", F.floor(F.col("at") / block_tokens).cast("bigint").alias("k")))

    blocks = {r["source"]: int(r["n"]) for r in placed.groupBy("source").agg((F.max("k") + 1).alias("n")).orderBy("source").collect()}
    ranked = slot_ranks(docs.sparkSession, blocks)
    # A text longer than a block leaves block numbers without a text, never a text without a slot.
    rows = placed.join(ranked, ["source", "k"]).select("slot", "source", "doc_id", "repeat_no", "tokens")
    return Mix(sized, quotas, rows)


def written(mix: Mix) -> Mix:
    """The mix with its rows written, for uses that read them more than once."""
    return Mix(mix.sized, mix.quotas, cut_lineage(mix.rows))


def share_report(mix: Mix) -> DataFrame:
    """(source, target_share, actual_share, available_tokens, used_tokens, short) of every listed source, from the rows of the mix."""
    spark = mix.rows.sparkSession
    plan = spark.createDataFrame([(q.source, q.share, q.available, q.wanted) for q in mix.quotas], "source string, target_share double, available_tokens bigint, wanted double")
    used = mix.rows.groupBy("source").agg(F.sum("tokens").alias("used"))
    rows = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used", F.lit(0)).cast("bigint")).withColumn("short", F.col("used_tokens") < F.col("wanted"))
    total = F.sum("used_tokens").over(Window.partitionBy())
    return rows.select("source", "target_share", F.round(F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0), 6).alias("actual_share"), "available_tokens", "used_tokens", "short")
