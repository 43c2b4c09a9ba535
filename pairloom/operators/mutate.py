"""Enumerate, count and render first-order mutants."""

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.mutants import edits_sql, mutation_sites, render_edits

# Edits per rendered row, and characters of text it may grow to.
CHUNK = 64
CHUNK_CHARS = 1_000_000


def _planned(functions: DataFrame) -> DataFrame:
    return functions.withColumn("_sites", mutation_sites("code")).withColumn("_edits", F.expr(edits_sql("_sites")))


def mutant_plan(functions: DataFrame) -> DataFrame:
    """One row per mutant with what changes, without its text. Keeps all columns but the code.

    Outer, then filtered: for an inner explode Catalyst infers that the array
    is not empty and pushes that below the parser call, which then runs twice.
    """
    kept = [c for c in functions.columns if c != "code"]
    return (
        _planned(functions)
        .select(*kept, F.posexplode_outer("_edits").alias("mutant_idx", "_edit"))
        .where("mutant_idx is not null")
        .select(*kept, "mutant_idx", "_edit.operator", "_edit.node_type", "_edit.node_pos", "_edit.choice")
    )


def mutant_counts(functions: DataFrame, keys: list[str]) -> DataFrame:
    """Mutants per key and operator; nothing is rendered."""
    return mutant_plan(functions).groupBy(*keys, "operator").agg(F.count("*").alias("num_mutants"))


def mutants(
    functions: DataFrame, chunk: int = CHUNK, chunk_chars: int = CHUNK_CHARS, tasks: int | None = None
) -> DataFrame:
    """One row per mutant with its text.

    The edits of a function are cut into chunks and the chunks are scattered,
    so one long function is rendered by many tasks. A chunk makes at most
    ``chunk`` copies of the text, fewer of a long one. The number of tasks is
    explicit, else adaptive execution would size them by their small input
    rather than by the work and output, which are tens of times larger.
    """
    tasks = tasks or int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in functions.columns if c != "code"]
    edits = F.col("_edits")
    fitting = F.lit(chunk_chars) / F.greatest(F.length("code"), F.lit(1))
    step = F.greatest(F.lit(1), F.least(F.lit(chunk), fitting)).cast("int")
    starts = F.when(F.size(edits) > 0, F.sequence(F.lit(1), F.size(edits), step))
    chunked = (
        _planned(functions)
        .select(*kept, "code", "_edits", F.explode_outer(starts).alias("_start"))
        .where("_start is not null")
        .select(*kept, "code", "_start", F.slice("_edits", F.col("_start"), step).alias("_edits"))
        .repartition(tasks, "_start", "code", *kept)
    )
    rendered = F.posexplode(render_edits("code", "_edits")).alias("_at", "_m")
    return chunked.select(*kept, "_start", rendered).select(
        *kept,
        (F.col("_start") - 1 + F.col("_at")).alias("mutant_idx"),
        "_m.*",
        (F.col("_m.node_pos") == 0).alias("is_noop"),
    )
