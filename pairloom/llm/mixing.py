"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Raking scales the cells to
the target share of one dimension after the other until all hold. A document is
then kept with the probability of its cell, so that the expected tokens are a
given part of all and those of every margin stand in the target ratio.

No cell can give more than it has. Targets of levels that are short of tokens
become all that they have, and the other levels of the dimension share the rest
in their ratio (``reachable`` in ``margins``). Raking then is bounded: a full
cell stays at what it has, and the free cells of its level make up for it. The
factor of a level comes from sums over its cells; it never overshoots, so the
rounds settle.

Everything is DataFrame operations. Words are counted once; ``mixed`` looks at
a text again for its topic and whether it has a word.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.frames import BROADCAST_ROWS, small_or_dealt, tuned
from pairloom.session import stored

ROUNDS = 24
ROUNDS_AT_ONCE = 8
# Cells that one task rakes: short rows of some hundred bytes.
TOGETHER = 100_000
WORD = r"[^ \t\n\x0B\f\r]+"
KEEP = 0.5
POWER = 0.5
UNKNOWN = "unknown"
SALT = "mix"
DIMENSIONS = ("source", "lang", "topic")

# What marks a topic, in order of precedence.
TOPICS = (
    ("legal", ("icense", "opyright")),
    ("contact", ("@", "tel:", "+1-")),
    ("markup", ("%%%", "###", "!!", " | ")),
    ("technical", ("http", " = ", "{")),
)
OTHER_TOPIC = "prose"


def topic_of(text: Column, topics=TOPICS, other: str = OTHER_TOPIC) -> Column:
    out = None
    for name, marks in topics:
        has = None
        for mark in marks:
            one = F.contains(text, F.lit(mark))
            has = one if has is None else has | one
        out = F.when(has, name) if out is None else out.when(has, name)
    return F.coalesce(out.otherwise(other), F.lit(other))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, salt: str = SALT) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), id_col.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None, power: float, keep: float, total: float) -> DataFrame:
    """(level, _wanted, _target): shares that sum to one, given or a power of what there is, and what of them can be met."""
    present = cells.groupBy(dim).agg(F.sum("tokens").alias("_has")).where("_has > 0")
    if given is not None:
        # Levels without a target go, targets without documents can not be met.
        wanted = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dim} string, _raw double")
        present = present.join(wanted, dim).where("_raw > 0")
    else:
        present = present.withColumn("_raw", F.pow(F.col("_has") / F.lit(total), F.lit(power)))
    # One row for each level: in order of how short it is, levels give all they have as long as the share would ask for more.
    levels = stored(present.select(dim, "_raw", (F.col("_has") / F.lit(keep * total)).alias("_most")), f"mix-{dim}")
    sum_raw = float(levels.agg(F.sum("_raw")).first()[0] or 1.0)
    shortest = Window.orderBy(F.col("_most") / F.col("_raw"), dim)
    longest = Window.orderBy(F.desc(F.col("_most") / F.col("_raw")), F.desc(dim))
    given_before = F.coalesce(F.sum("_most").over(shortest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    asked_from = F.sum("_raw").over(longest.rowsBetween(Window.unboundedPreceding, 0))
    scaled = levels.withColumn("_scale", (F.lit(1.0) - given_before) / asked_from)
    # Each of these scales is a lower bound of the true one, and one of them is it.
    best = float(scaled.agg(F.max("_scale")).first()[0] or 0.0)
    return levels.select(dim, (F.col("_raw") / sum_raw).alias("_wanted"), F.least("_most", F.lit(best) * F.col("_raw")).alias("_target"))


def _step(cells: DataFrame, dim: str) -> DataFrame:
    """Scale the cells of each level of one dimension towards its target, full cells counted as what they have."""
    level = Window.partitionBy(dim)
    full = F.col("_y") >= F.col("_most")
    now, free, asked = (F.sum(c).over(level) for c in (F.least("_y", "_most"), F.when(full, 0.0).otherwise(F.col("_y")), F.col("_y")))
    target = F.col(f"_target_{dim}")
    by_all = F.when(F.col("_asked") > 0, target / F.col("_asked")).otherwise(0.0)
    by_free = F.lit(1.0) + (target - F.col("_now")) / F.col("_free")
    factor = F.when(F.col("_free") > 0, F.greatest(by_free, by_all)).when(target < F.col("_now"), by_all).otherwise(1.0)
    sums = cells.withColumns({"_now": now, "_free": free, "_asked": asked})
    return sums.withColumn("_y", F.col("_y") * factor).drop("_now", "_free", "_asked")


def raked_cells(
    cells: DataFrame,
    dims=DIMENSIONS,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = POWER,
    rounds: int = ROUNDS,
    keep: float = KEEP,
) -> DataFrame:
    """``cells`` (dims, tokens), stored, with ``fitted``: shares of the kept tokens, raked to the margins of every dimension.

    ``targets`` gives shares by dimension and level; a dimension without any is
    flattened: its shares to the given power. A cell without tokens, or with a
    level that has no target, gets zero. ``_wanted_`` and ``_target_`` columns
    have the targets as given and as they can be met.
    """
    found = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    total = float(found["tokens"] or 1)
    share = F.col("tokens").cast("double") / F.lit(total)
    state = cells.withColumns({"_y": share, "_most": share / F.lit(keep)})
    for d in dims:
        level = _targets(cells, d, (targets or {}).get(d), power, keep, total).withColumnsRenamed({"_wanted": f"_wanted_{d}", "_target": f"_target_{d}"})
        state = state.join(F.broadcast(level) if found["cells"] <= BROADCAST_ROWS else level, d, "left").fillna(0.0, [f"_wanted_{d}", f"_target_{d}"])
    if found["cells"] <= TOGETHER:
        # Cells that fit one task need no exchange between the dimensions.
        state = state.coalesce(1)
    for i in range(1, rounds + 1):
        for d in dims:
            state = _step(state, d)
        if i % ROUNDS_AT_ONCE == 0 and i < rounds:
            # Cuts the plan: it would grow with the rounds.
            state = stored(state, "mix-round")
            state = state.coalesce(1) if found["cells"] <= TOGETHER else state
    return stored(state.withColumn("fitted", F.least("_y", "_most")).drop("_y", "_most"), "mix-fitted")


def margins(fitted: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """(dimension, level, wanted, reachable, expected) of raked cells: shares asked for, that can be met by the level, and met."""
    out = None
    for d in dims:
        sums = [F.max(f"_wanted_{d}").alias("wanted"), F.max(f"_target_{d}").alias("reachable"), F.sum("fitted").alias("expected")]
        one = fitted.groupBy(F.col(d).alias("level")).agg(*sums).select(F.lit(d).alias("dimension"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _dimensions(id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> dict[str, Column]:
    text = F.col(text_col).cast("string")
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    return {
        "doc_id": F.col(id_col).cast("long"),
        "source": level(source_col),
        "lang": level(lang_col),
        "topic": topic_of(text) if topic is None else topic,
        "n_tokens": word_count(text),
    }


def _weights(rows: DataFrame, targets, power: float, rounds: int, keep: float) -> DataFrame:
    """(dims, probability) of every cell of the rows."""
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    fitted = raked_cells(cells, DIMENSIONS, targets, power, rounds, keep)
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 0)
    chance = F.when(F.col("tokens") > 0, F.lit(keep * total) * F.col("fitted") / F.col("tokens")).otherwise(0.0)
    return stored(fitted.select(*DIMENSIONS, F.round(F.least(F.lit(1.0), chance), 9).alias("probability")), "mix-weights")


def mixing_probabilities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = POWER,
    rounds: int = ROUNDS,
    keep: float = KEEP,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of every document with an id.

    A null source or language is the level ``unknown``. Documents without
    words have probability zero; rows that share id and cell are kept or
    dropped alike. Rows with a null id are left out.
    """
    tuned(docs.sparkSession)
    known = _dimensions(id_col, text_col, source_col, lang_col, topic)
    rows = stored(docs.select(*(c.alias(n) for n, c in known.items())).where("doc_id IS NOT NULL"), "mix-documents")
    chance = F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0)
    return (
        rows.join(small_or_dealt(_weights(rows, targets, power, rounds, keep)), list(DIMENSIONS))
        .select("doc_id", *DIMENSIONS, "n_tokens", chance.alias("probability"))
        .withColumn("kept", uniform(F.col("doc_id")) < F.col("probability"))
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    power: float = POWER,
    rounds: int = ROUNDS,
    keep: float = KEEP,
) -> DataFrame:
    """The sampled rows, all columns as they are; see ``mixing_probabilities``. Texts move only if the cells are too many to broadcast."""
    tuned(docs.sparkSession)
    known = _dimensions(id_col, text_col, source_col, lang_col, topic)
    rows = stored(docs.select(*(c.alias(n) for n, c in known.items())).where("doc_id IS NOT NULL"), "mix-documents")
    weights = _weights(rows, targets, power, rounds, keep).select(
        F.struct(*DIMENSIONS).alias("_mix_cell"), F.col("probability").alias("_mix_probability")
    )
    dealt = docs.withColumn("_mix_cell", F.struct(*(known[d].alias(d) for d in DIMENSIONS)))
    has_word = F.coalesce(F.rlike(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(False))
    kept = has_word & (uniform(known["doc_id"]) < F.col("_mix_probability"))
    return dealt.join(small_or_dealt(weights), "_mix_cell").where(kept).select(*docs.columns)


def oracle_sql(table: str = "documents", rounds: int = ROUNDS, power: float = POWER, keep: float = KEEP) -> str:
    """The rows of ``mixing_probabilities`` in plain SQL, every raking step written out."""

    def has(marks: tuple[str, ...]) -> str:
        return " OR ".join(f"contains(text, '{m}')" for m in marks)

    topics = " ".join(f"WHEN {has(marks)} THEN '{name}'" for name, marks in TOPICS)
    parts = [
        f"""r AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
  CASE {topics} ELSE '{OTHER_TOPIC}' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n_tokens FROM {table} WHERE doc_id IS NOT NULL)""",
        "s0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY 1, 2, 3)",
    ]
    most = f"sum(tokens) / ({keep} * (SELECT sum(tokens) FROM s0))"
    for d in DIMENSIONS:
        short = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        parts += [
            f"l_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM s0), {power}) AS raw, {most} AS most FROM s0 GROUP BY 1 HAVING sum(tokens) > 0)",
            f"k_{d} AS MATERIALIZED (SELECT *, (1.0 - coalesce(sum(most) OVER (ORDER BY most / raw, {d} {short}), 0)) / "
            f"sum(raw) OVER (ORDER BY most / raw DESC, {d} DESC ROWS UNBOUNDED PRECEDING) AS scale FROM l_{d})",
            f"t_{d} AS MATERIALIZED (SELECT {d}, least(most, (SELECT max(scale) FROM k_{d}) * raw) AS target FROM k_{d})",
        ]
    parts.append(
        f"y0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS y, tokens / sum(tokens) OVER () / {keep} AS most FROM s0)"
    )
    step = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            over = f"OVER (PARTITION BY s.{d})"
            sums = f"sum(least(y, most)) {over} AS now, sum(CASE WHEN y >= most THEN 0 ELSE y END) {over} AS free, sum(y) {over} AS asked"
            by_all = "CASE WHEN asked > 0 THEN target / asked ELSE 0 END"
            parts.append(
                f"y{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, most, y * CASE WHEN free > 0 THEN greatest(1.0 + (target - now) / free, {by_all}) "
                f"WHEN target < now THEN {by_all} ELSE 1.0 END AS y FROM (SELECT s.*, coalesce(t.target, 0) AS target, {sums} "
                f"FROM y{step} s LEFT JOIN t_{d} t ON s.{d} = t.{d}))"
            )
            step += 1
    chance = f"CASE WHEN tokens > 0 THEN {keep} * sum(tokens) OVER () * least(y, most) / tokens ELSE 0 END"
    parts.append(f"p AS (SELECT source, lang, topic, round(least(1.0, {chance}), 9) AS probability FROM y{step})")
    chance = "CASE WHEN n_tokens > 0 THEN probability ELSE 0 END"
    u = f"('0x' || substr(md5('{SALT}' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, n_tokens, {chance} AS probability, {u} < {chance} AS kept "
        "FROM r JOIN p USING (source, lang, topic)"
    )
