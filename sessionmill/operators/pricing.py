"""Price catalogue: flatten, one price per model, aliases, cost of usage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators.skew import join_facts, row_hash

# Provider tiers that decide which provider a model is listed under.
FIRST_TIER = (
    "openai", "anthropic", "google", "deepseek", "mistral", "cohere", "xai", "togetherai", "fireworks-ai", "groq",
)
SECOND_TIER = ("google-vertex", "azure", "amazon-bedrock", "cloudflare-workers-ai")

# Model names in logs that the catalogue lists under another name.
ALIASES = (
    ("accounts/fireworks/routers/kimi-k2p6-turbo", "kimi-k2.6"),
    ("accounts/fireworks/models/kimi-k2p6", "kimi-k2.6"),
)

CATALOGUE = (
    "map<string, struct<models: map<string, struct<name: string, "
    "cost: struct<input: string, output: string, cache_read: string, cache_write: string>>>>>"
)

def flatten_catalogue(documents: DataFrame) -> DataFrame:
    """One row per provider and model of catalogue documents (column ``value``)."""
    providers = documents.select(F.explode(F.from_json("value", CATALOGUE)).alias("provider", "entry"))
    models = providers.select("provider", F.explode("entry.models").alias("model_key", "model"))
    return models.select(
        "provider",
        "model_key",
        F.col("model.name").alias("name"),
        *[F.col(f"model.cost.{c}").try_cast("double").alias(c) for c in ("input", "output", "cache_read", "cache_write")],
    )


def price_per_model(offers: DataFrame) -> DataFrame:
    """One row per model: the best-tier provider, the highest of each price.

    Of several providers in the best tier the first by name is taken.
    """
    tier = (
        F.when(F.col("provider").isin(*FIRST_TIER), 1).when(F.col("provider").isin(*SECOND_TIER), 2).otherwise(3)
    )
    return offers.groupBy(F.col("model_key").alias("model")).agg(
        F.min_by("provider", F.struct(tier, "provider")).alias("provider"),
        F.max("name").alias("friendly_name"),
        F.max("input").alias("input_cost"),
        F.max("output").alias("output_cost"),
        F.max("cache_read").alias("cache_cost"),
        F.max("cache_write").alias("cache_write_cost"),
    )


def alias_frame(spark: SparkSession, extra: Iterable[tuple[str, str]] = ()) -> DataFrame:
    return spark.createDataFrame([*ALIASES, *extra], "raw_model string, api_model string")


def overlay_aliases(prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Prices under alias names, plus all prices whose own name is no alias."""
    listed = prices.columns[1:]
    renamed = aliases.join(prices, aliases["api_model"] == prices["model"]).select(
        aliases["raw_model"].alias("model"), *[prices[c] for c in listed]
    )
    plain = prices.join(aliases, prices["model"] == aliases["raw_model"], "left_anti")
    return renamed.unionByName(plain)


def with_prices(rows: DataFrame, prices: DataFrame, model: Column) -> DataFrame:
    """Left join on the model name; price columns arrive prefixed with ``p_``.

    Spark sends the prices to every executor if they turn out small enough. Else rows are dealt by model and by a hash of the
    row, so that neither the most used model nor the rows without one (they get a name of their own each) meet in one task.
    """
    renamed = prices.select(*[F.col(c).alias(f"p_{c}") for c in prices.columns if c != "friendly_name"])
    own = F.concat(F.lit("\u0000"), row_hash(rows).cast("string"))
    keyed = rows.withColumn("p_model", F.coalesce(model, own))
    return join_facts(keyed, renamed, ["p_model"]).drop("p_model").select(*rows.columns, *[c for c in renamed.columns if c != "p_model"])


def usage_cost(in_tok: Column, out_tok: Column, cache_read: Column, cache_write: Column | None = None) -> Column:
    """Dollars for token counts at the joined ``p_`` prices per million tokens.

    An unknown price counts as 0; an unknown cache-write price as the input price.
    """

    def price(*names: str) -> Column:
        return F.coalesce(*[F.col(f"p_{n}") for n in names], F.lit(0.0))

    dollars = in_tok * price("input_cost")
    if cache_write is not None:
        dollars = dollars + cache_write * price("cache_write_cost", "input_cost")
    dollars = dollars + out_tok * price("output_cost") + cache_read * price("cache_cost")
    return dollars / F.lit(1_000_000.0)


def recorded_or(recorded: Column, priced: Column) -> Column:
    """The recorded cost unless it is missing or zero."""
    return F.when(recorded.isNull() | (recorded == 0), priced).otherwise(recorded)
