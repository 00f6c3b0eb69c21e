"""The plan of a batch of textures: analyse once, recommend, keep what saves, sum up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetspark.functions.dialect import SPARK
from assetspark.operators import rules


@dataclass(frozen=True)
class Options:
    """How far to go. cap and floor are sides in pixels, 0 for none; single keeps one level only."""

    strategy: str = "balanced"
    collapse: bool = True
    cap: int = 0
    single: bool = False
    floor: int = 0
    prefix: int = 192
    generate: bool = False

    def columns(self) -> dict:
        return {"strategy": F.lit(self.strategy), "collapse": F.lit(self.collapse), "cap": F.lit(self.cap).cast("long"), "single": F.lit(self.single), "floor": F.lit(self.floor).cast("long"), "prefix": F.lit(self.prefix).cast("long"), "generate": F.lit(self.generate)}


def candidates(textures: DataFrame, analysis: DataFrame) -> DataFrame:
    """textures with why they can't be optimised (unsupported) and what their surface holds, joined by vec_id.

    The analysis has a row for each distinct surface, however many textures share it.
    """
    classified = rules.apply(textures, rules.classify(SPARK))
    return classified.join(analysis.withColumnRenamed("tex_id", "vec_id"), "vec_id", "left")


def build(textures: DataFrame, analysis: DataFrame, options: Options = Options()) -> DataFrame:
    """Every texture with its recommendation, sizes and outcome: 'planned', 'already-efficient' or why it was skipped.

    A column prefix of the textures, the room before their headers, goes before the option's. An analysis may have a
    reason why a surface couldn't be looked at.
    """
    c = candidates(textures, analysis)
    c = c.withColumns({k: v for k, v in options.columns().items() if k not in textures.columns})
    if "reason" in analysis.columns:
        c = c.withColumn("unsupported", F.coalesce("unsupported", F.when(F.col("reason").isNotNull(), "cannot-decode")))
    planned = rules.predict(rules.recommend(c).withColumn("include", F.lit(True)))
    outcome = F.coalesce("unsupported", F.when(F.col("predicted_size") >= F.col("gpu_size"), "already-efficient"), F.lit("planned"))
    return planned.withColumn("outcome", outcome).withColumn("include", outcome == "planned")


#: What may be edited in a plan, and where the recommendation for it is kept.
EDITABLE = ("include", "to_format", "to_w", "to_h")


def with_recommendation(plan: DataFrame) -> DataFrame:
    """plan with the recommendation kept beside what may be edited."""
    return plan.withColumns({f"recommended_{c}": F.col(c) for c in EDITABLE})


def repredicted(plan: DataFrame) -> DataFrame:
    """plan with its sizes worked out again, as after an edit."""
    made = ("predicted_size", "predicted_stream_size", "to_chain")
    return rules.predict(plan.drop(*made))


def reset(plan: DataFrame, which: Column | bool = True) -> DataFrame:
    """plan with the rows of `which` back at their recommendation."""
    chosen = which if isinstance(which, Column) else F.lit(which)
    back = plan.withColumn("__reset", chosen)
    for c in EDITABLE:
        back = back.withColumn(c, F.when(F.col("__reset"), F.col(f"recommended_{c}")).otherwise(F.col(c)))
    return repredicted(back.drop("__reset"))


def is_recommended(plan: DataFrame) -> DataFrame:
    """plan with recommended: whether format and size are those of the recommendation."""
    return plan.withColumn("recommended", F.expr(" AND ".join(f"{c} = recommended_{c}" for c in EDITABLE[1:])))


def totals(plan: DataFrame) -> DataFrame:
    """Per bundle: entries planned and skipped, resident bytes before and after, bytes moved to the stream file."""
    kept = F.col("include")
    after = F.when(kept, F.col("predicted_size")).otherwise(F.col("gpu_size"))
    return plan.groupBy("bundle").agg(
        F.count("*").alias("n_textures"), F.count_if(kept).alias("n_planned"), F.count_if(~kept).alias("n_skipped"), F.sum("gpu_size").alias("bytes_before"), F.sum(after).alias("bytes_after"),
        F.count_if(kept & F.col("generates")).alias("n_generated"), F.count_if(kept & F.col("resident").isNotNull()).alias("n_streamed"),
        F.count_if(F.col("mips") > 1).alias("n_chained"), F.count_if(F.col("mips") <= 1).alias("n_chainless"), F.sum(F.when(kept, F.col("predicted_stream_size")).otherwise(0)).alias("added_stream_bytes"),
    )
