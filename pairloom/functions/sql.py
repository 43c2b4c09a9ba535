"""The parser and the mutator as SQL table functions.

SQL-bodied functions: Catalyst inlines them, so a LATERAL call becomes Arrow
steps and an explode, with column pruning, instead of a row-at-a-time Python
table function. Bodies keep to one SELECT over one explode: with anything
more, such as a WHERE, the call is planned as a join on the whole text.
"""

from pyspark.sql import SparkSession

from pairloom.functions.mutants import EDIT, edits_sql, mutation_sites, render_edits
from pairloom.functions.python_source import functions_of
from pairloom.operators.mutate import CHUNK, CHUNK_CHARS


def register(spark: SparkSession) -> None:
    """Adds five functions to the session.

    ``extract_functions(content)``: table of the functions of a file.
    ``mutation_edits(code)``: array of all edits, in mutant order.
    ``mutate_function(code, edits)``: table of the mutants these edits make::

        SELECT f.name, m.*
        FROM (SELECT *, mutation_edits(code) AS edits FROM functions) f,
             LATERAL mutate_function(f.code, f.edits) m

    One row of that holds all mutants of a function. For long functions cut the edits first;
    then a row holds at most ``CHUNK`` mutants or about ``CHUNK_CHARS`` characters of them.
    ``mutation_chunks(code, edits)``: table of ``start`` and ``part``, consecutive edits.
    ``mutate_chunk(code, start, part)``: table like that of ``mutate_function``, numbered from ``start``::

        SELECT f.name, m.*
        FROM (SELECT *, mutation_edits(code) AS edits FROM functions) f,
             LATERAL mutation_chunks(f.code, f.edits) c,
             LATERAL mutate_chunk(f.code, c.start, c.part) m
    """
    spark.udf.register("pairloom_functions", functions_of)
    spark.udf.register("pairloom_sites", mutation_sites)
    spark.udf.register("pairloom_render", render_edits)
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION extract_functions(content STRING)
        RETURNS TABLE (fn_pos INT, name STRING, code STRING)
        RETURN SELECT f.fn_pos, f.name, f.code
               FROM (SELECT explode(filter(pairloom_functions(content), f -> f.name IS NOT NULL)) AS f)
        """
    )
    edit = EDIT.simpleString()
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION mutation_edits(code STRING) RETURNS ARRAY<{edit}>
        RETURN {edits_sql('pairloom_sites(code)')}
        """
    )
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION mutate_function(code STRING, edits ARRAY<{edit}>)
        RETURNS TABLE (mutant_idx INT, operator STRING, node_type STRING, node_pos INT,
                       mutant STRING, is_noop BOOLEAN, is_valid BOOLEAN)
        RETURN SELECT i, m.operator, m.node_type, m.node_pos, m.code, m.node_pos = 0, m.is_valid
               FROM (SELECT posexplode(pairloom_render(code, edits)) AS (i, m))
        """
    )
    step = f"cast(greatest(1, least({CHUNK}, {CHUNK_CHARS} / greatest(length(code), 1))) as int)"
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION mutation_chunks(code STRING, edits ARRAY<{edit}>)
        RETURNS TABLE (start INT, part ARRAY<{edit}>)
        RETURN SELECT at - 1, slice(edits, at, {step})
               FROM (SELECT explode(if(size(edits) > 0, sequence(1, size(edits), {step}), array())) AS at)
        """
    )
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION mutate_chunk(code STRING, start INT, part ARRAY<{edit}>)
        RETURNS TABLE (mutant_idx INT, operator STRING, node_type STRING, node_pos INT,
                       mutant STRING, is_noop BOOLEAN, is_valid BOOLEAN)
        RETURN SELECT start + i, m.operator, m.node_type, m.node_pos, m.code, m.node_pos = 0, m.is_valid
               FROM (SELECT posexplode(pairloom_render(code, part)) AS (i, m))
        """
    )
