"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

# Rates beyond this are drawn as the sum of independent chunks of equal rate, so no table of steps and no row's copies in one task grow with a rate.
CHUNK = 64.0
# Sources whose steps are sent to all tasks, at some 1500 bytes each; more are joined by hash.
BROADCAST = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 52 bits, drawn by hashing; the same for the same parts everywhere."""
    text = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where double precision reaches one; for rates up to ``CHUNK``."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["steps"], F.array(total)).alias("steps"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["steps"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def repetition_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, source_col: str, total: int | None
) -> DataFrame:
    """(source, rows, rate) of every source: how often a row of it is to occur on average.

    Without ``weights`` all sources weigh the same. Sources that ``weights`` does not name get rate 0; weights of
    sources without rows are left out and the others scaled up. A null source is a source like any other, named None.
    """
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame(
            [(s, float(w)) for s, w in weights.items()], "given string, weight double"
        )
        weighed = counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("given")), "left").drop("given")
        weighed = weighed.fillna(0.0, ["weight"])
    weighed = durable(weighed)
    sums = weighed.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).first()
    wanted = float(total if total is not None else sums["rows"] or 0)
    share = F.col("weight") / F.lit(float(sums["weight"] or 1.0))
    return weighed.select("source", "rows", (share * wanted / F.col("rows")).alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Documents repeated so that sources reach target weights on average, in a random order.

    The number of copies of a row is the inverse of the Poisson distribution, with mean the repetition rate of its
    source, at a number hashed from seed and id; it needs no count of other rows and any
    executor draws it alike. A rate beyond ``CHUNK`` is drawn in chunks, whose copies are made in tasks of their own. Copies are then
    dealt to partitions by a hash of id and copy number and sorted by it within each: one shuffle of the data, in which a source of any
    size spreads over all partitions. Steps of at most ``BROADCAST`` sources travel to the rows instead of the rows to them.

    Returns the columns of ``docs``, ``copy_no`` (from 0) and ``shuffle_key``; columns of ``docs`` that have these names are
    replaced, all others keep their values, whatever their names. ``total`` is the number of rows aimed at, the number there are if None. A null
    id draws by its text, and rows alike in id draw alike. Null sources are one source. An empty table gives an empty result.
    """
    chunks = F.greatest(F.ceil(F.col("rate") / CHUNK), F.lit(1)).cast("int")
    rates = repetition_rates(docs, weights, source_col, total).select("source", "rate", chunks.alias("chunks"))
    steps = durable(rates.select(F.col("source").alias("of"), "chunks", poisson_steps(F.col("rate") / F.col("chunks")).alias("steps")))
    size = steps.agg(F.count("*").alias("n"), F.max("chunks").alias("most")).first()
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    kept = [c for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    rows = docs.select(own.alias("own"), name.alias("name"), F.col(f"`{source_col}`").alias("source"))
    rows = rows.join(F.broadcast(steps) if size["n"] <= BROADCAST else steps, F.col("source").eqNullSafe(F.col("of")))

    def drawn(chunk: Column | None) -> Column:
        u = uniform(F.lit(str(seed)), "name", *([] if chunk is None else [chunk.cast("string")]))
        return F.size(F.filter("steps", lambda p: p <= u))

    def copied(drawn_rows: DataFrame, first: Column) -> DataFrame:
        some = drawn_rows.where("copies > 0")
        return some.select("own", "name", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("copy_no"))

    made = copied(rows.where("chunks = 1").select("own", "name", drawn(None).alias("copies")), F.lit(0))
    if (size["most"] or 1) > 1:
        # The first chunk is drawn as an only one is; a chunk's copies are numbered after those of the chunks before.
        many = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.when(j == 0, drawn(None)).otherwise(drawn(j)))
        own_chunk = rows.where("chunks > 1").select("own", "name", many.alias("many"))
        start = F.aggregate(F.slice("many", F.lit(1), F.col("chunk")), F.lit(0), lambda a, x: a + x)
        dealt = own_chunk.select("own", "name", "many", F.posexplode("many").alias("chunk", "copies"))
        dealt = dealt.select("own", "name", "chunk", "copies", start.alias("start")).repartition(F.col("name"), F.col("chunk"))
        made = made.unionByName(copied(dealt, F.col("start")))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}#"), "name", F.col("copy_no").cast("string")).cast("binary"))
    made = made.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(kept)], "copy_no", key.alias("shuffle_key"))
    return made.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixing_sql(seed: int = 42) -> str:
    """The result of ``mix_sources`` over documents with equal weights, in DuckDB's SQL."""
    return f"""
    WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    whole AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate
              FROM counts),
    rates AS (SELECT source, greatest(ceil(rate / {CHUNK}), 1)::INTEGER AS chunks, rate / greatest(ceil(rate / {CHUNK}), 1) AS rate
              FROM whole),
    logs AS (SELECT source, rate, k, -rate + sum(CASE WHEN k > 0 THEN ln(rate) - ln(k::DOUBLE) ELSE 0 END)
                    OVER (PARTITION BY source ORDER BY k) AS log_p
             FROM (SELECT *, unnest(range(CAST(ceil(rate + 10 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rates)),
    steps AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs),
    chunked AS (SELECT documents.*, unnest(range(chunks)) AS j FROM documents JOIN rates ON documents.source IS NOT DISTINCT FROM rates.source),
    draws AS (SELECT *, CAST('0x' || substr(md5('{seed}|' || doc_id::VARCHAR || CASE WHEN j > 0 THEN '|' || j::VARCHAR ELSE '' END), 1, 13)
                        AS UBIGINT) / 4503599627370496.0::DOUBLE AS u FROM chunked),
    copies AS (SELECT doc_id, count(*) AS n FROM draws JOIN steps
               ON draws.source IS NOT DISTINCT FROM steps.source AND p <= u GROUP BY doc_id)
    SELECT doc_id, text, lang, source, n_chars, copy_no, md5('{seed}#|' || doc_id::VARCHAR || '|' || copy_no::VARCHAR) AS shuffle_key
    FROM (SELECT documents.*, CAST(unnest(range(copies.n)) AS INTEGER) AS copy_no FROM documents JOIN copies USING (doc_id))
    """
