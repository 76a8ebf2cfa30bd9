"""AGG-18 and 19: two engines that read the same screens, side by side: means, a verdict with its reasons, and where they disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..plans.catalog import query
from ..sources.captures import table

#: A record of the log (sources.sinks.read_log): what either engine read of a screen, whether the second one answered, and the overlap of their words.
LOG = "app string, a_chars long, b_chars long, a_lines long, b_lines long, a_doubled long, b_doubled long, a_ms long, b_ms long, overlap double, b_ok boolean"
FASTER, KEEPS_TEXT, AGREES, DOUBLES, THIN, DROP, OTHER, TOP_APPS = 0.9, 0.95, 0.85, 1.5, 100, 0.7, 0.7, 6


def verdicts(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each group of records (one for all without ``by``): counts, means over comparable records, verdict and reasons.

    verdict: switch, keep, no gain, or never answered where the second engine never did.  Reading less text, other words or doubling more rules a switch out,
    however fast; equal numbers are no reason for one.  thin: fewer than THIN comparable records.  Missing numbers count as 0.  An empty log gives no row by group.
    """
    ok = F.coalesce("b_ok", F.lit(False))
    mean = lambda c, places: F.round(F.avg(F.when(ok, F.coalesce(c, F.lit(0)))), places).alias(c)
    means = [mean(f"{e}_{c}", n) for c, n in (("chars", 0), ("lines", 1), ("doubled", 2), ("ms", 0)) for e in "ab"] + [mean("overlap", 3)]
    out = log.groupBy(*(by or [])).agg(F.count("*").alias("records"), F.count_if(ok).alias("comparable"), *means)
    out = out.withColumn("failed", F.col("records") - F.col("comparable"))
    faster, cleaner = F.col("b_ms") < F.col("a_ms") * FASTER, F.col("b_doubled") < F.col("a_doubled")
    less, differ, doubles = F.col("b_chars") < F.col("a_chars") * KEEPS_TEXT, F.col("overlap") < AGREES, F.col("b_doubled") > F.col("a_doubled") * DOUBLES
    bad = less | differ | doubles
    verdict = F.when(F.col("comparable") == 0, "never answered").when(bad, "keep").when(faster | cleaner, "switch").otherwise("no gain")
    reasons = F.array_compact(F.array(F.when(faster, "faster"), F.when(cleaner, "doubles less"), F.when(less, "reads less"), F.when(differ, "reads other words"), F.when(doubles, "doubles more")))
    return out.withColumns({"verdict": verdict, "reasons": F.when(F.col("comparable") > 0, reasons).otherwise(F.array().cast("array<string>")), "thin": F.col("comparable") < THIN})


def disagreements(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each group: comparable records in which the second engine doubles fewer or more words, those in which it reads 30 % less, and the apps with
    most records of an overlap below OTHER (ties by name)."""
    by = by or []
    ok = log.where(F.coalesce("b_ok", F.lit(False)))
    drop = F.col("b_chars") < DROP * F.col("a_chars")
    counts = ok.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("b_doubled") < F.col("a_doubled")).alias("improved"), F.count_if(F.col("b_doubled") > F.col("a_doubled")).alias("worse"), F.count_if(drop).alias("dropped"))
    apps = ok.where(F.col("overlap") < OTHER).groupBy(*by, F.coalesce("app", F.lit("")).alias("app")).agg(F.count("*").alias("k"))
    listed = apps.groupBy(*by).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("less"), "app"))), 1, TOP_APPS), lambda x: x.app).alias("apps"))
    if not by:
        return counts.crossJoin(F.broadcast(listed))  # two single rows
    return counts.join(listed.hint("merge"), by, "left").withColumn("apps", F.coalesce("apps", F.array().cast("array<string>")))


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (..., a, b: what two engines read) with the numbers of the log: characters, lines, doubled words and the overlap of their word sets (1 where both have none)."""
    words = {e: tokens(F.coalesce(e, F.lit(""))) for e in "ab"}
    out = pairs.withColumns({f"_{e}": w for e, w in words.items()})
    doubled = lambda w: F.size(F.filter(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: x == y), lambda x: x)).cast("long")
    lines = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")).cast("long")
    n = F.size(F.array_union("_a", "_b"))
    numbers: dict[str, Column] = {"overlap": F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect("_a", "_b")) / n)}
    for e in "ab":
        numbers |= {f"{e}_chars": F.length(F.coalesce(e, F.lit(""))).cast("long"), f"{e}_lines": lines(e), f"{e}_doubled": doubled(F.col(f"_{e}"))}
    return out.withColumns(numbers).drop("_a", "_b")


def _log(spark, sf_dir) -> DataFrame:
    """Documents 2n and 2n + 1 stand for what two engines read of a screen; ids stand for times, and every 17th screen got no answer."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), "source", "lang", "text")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    p = d.groupBy("pair").agg(pick(0, "source").alias("source"), pick(0, "lang").alias("app"), pick(0, "text").alias("a"), pick(1, "text").alias("b"), F.count("*").alias("n")).where("n = 2")
    return compared(p).withColumns({"a_ms": 400 + F.col("pair") % 7, "b_ms": 100 + F.col("pair") % 600, "b_ok": F.col("pair") % 17 != 0})


_T = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_LOG_SQL = (
    f"p AS (SELECT a.doc_id // 2 AS pair, a.source, a.lang AS app, a.text AS a, b.text AS b, {_T.format('a.text')} AS wa, {_T.format('b.text')} AS wb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0), "
    "l AS MATERIALIZED (SELECT *, pair % 17 <> 0 AS b_ok, 400 + pair % 7 AS a_ms, 100 + pair % 600 AS b_ms, len(a) AS a_chars, len(b) AS b_chars, CASE WHEN len(wa) + len(wb) = 0 THEN 1.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS overlap, "
    + ", ".join(f"len(list_filter(string_split({e}, chr(10)), lambda x: trim(x) <> '')) AS {e}_lines, len(list_filter(range(1, len(w{e})), lambda i: w{e}[i] = w{e}[i + 1])) AS {e}_doubled" for e in "ab") + " FROM p)"
)
_MEANS = ", ".join(f"round(avg({e}_{c}) FILTER (WHERE b_ok), {n}) AS {e}_{c}" for c, n in (("chars", 0), ("lines", 1), ("doubled", 2), ("ms", 0)) for e in "ab")


@query("reading_verdicts", f"WITH {_LOG_SQL}, m AS (SELECT source, count(*) AS records, count_if(b_ok) AS comparable, {_MEANS}, round(avg(overlap) FILTER (WHERE b_ok), 3) AS overlap FROM l GROUP BY 1) SELECT *, records - comparable AS failed, CASE WHEN comparable = 0 THEN 'never answered' WHEN b_chars < a_chars * 0.95 OR overlap < 0.85 OR b_doubled > a_doubled * 1.5 THEN 'keep' WHEN b_ms < a_ms * 0.9 OR b_doubled < a_doubled THEN 'switch' ELSE 'no gain' END AS verdict, "
       "CASE WHEN comparable = 0 THEN []::VARCHAR[] ELSE list_filter([CASE WHEN b_ms < a_ms * 0.9 THEN 'faster' END, CASE WHEN b_doubled < a_doubled THEN 'doubles less' END, CASE WHEN b_chars < a_chars * 0.95 THEN 'reads less' END, CASE WHEN overlap < 0.85 THEN 'reads other words' END, CASE WHEN b_doubled > a_doubled * 1.5 THEN 'doubles more' END], lambda x: x IS NOT NULL) END AS reasons, comparable < 100 AS thin FROM m")
def reading_verdicts(spark, sf_dir) -> DataFrame:
    """AGG-18 by source."""
    return verdicts(_log(spark, sf_dir), ["source"])


@query("reading_disagreements", f"WITH {_LOG_SQL}, c AS (SELECT source, count(*) AS n, count_if(b_doubled < a_doubled) AS improved, count_if(b_doubled > a_doubled) AS worse, count_if(b_chars < 0.7 * a_chars) AS dropped FROM l WHERE b_ok GROUP BY 1), k AS (SELECT source, app, count(*) AS k FROM l WHERE b_ok AND overlap < 0.7 GROUP BY 1, 2) "
       "SELECT c.*, coalesce((SELECT list(app ORDER BY k DESC, app)[1:6] FROM k WHERE k.source = c.source), []::VARCHAR[]) AS apps FROM c")
def reading_disagreements(spark, sf_dir) -> DataFrame:
    """AGG-19 by source, languages standing for apps."""
    return disagreements(_log(spark, sf_dir), ["source"])
