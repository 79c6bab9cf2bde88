"""Quality rules whose thresholds come from the data: one quantile sketch per language and source.

Everything is DataFrame functions. A first pass over the texts works out a few whole numbers a document,
which are written to the shared folder. Four rates follow from them (mean word length, symbols, repeated
lines, repeated words). A sketch of a rate is a histogram over log-linear buckets (a number less its
bits after the first six, so within 1/32 of it): counts by bucket, partly summed before the shuffle,
add up in any order to the same sketch. Source sketches are merged by language, and those for all
documents; a group of fewer than ``least`` documents takes its language's thresholds, or those of all.
The mean word length fails outside its quartiles by ``spreads`` times their distance and a slack. Most
documents have no symbols, repeated lines or repeated words at all, so these three rates go by their tail:
they fail above the 99th percentile plus its distance from the 90th and a small slack. Documents that fail
the fixed base rules are not learned from. The thresholds are joined to the documents by language and source.

NULL and empty texts have no words, so they fail the base. A NULL language or source is a group like
any other. Repeated rows and ids are rows of their own. An empty table gives none. Columns other than
the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpulse.llm.tables import SPACE, written

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Rate: per how many of what, slack, and whether low values fail too.
RATES: dict[str, tuple[str, int, str, int, bool]] = {
    "word_length": ("word_chars", 100, "n_words", 150, True),
    "symbol_rate": ("n_symbols", 1000, "n_words", 20, False),
    "dup_line_rate": ("n_dup_lines", 1000, "n_lines", 50, False),
    "repeat_rate": ("n_repeat_words", 1000, "n_words", 20, False),
}
BITS = 6


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Whole numbers of each text; in steps, so that no array is worked out twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        text.alias("text"),
    )
    none = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id", "lang", "source",
        F.when(trimmed == "", none).otherwise(F.split(trimmed, f"[{SPACE}]+")).alias("words"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    window = lambda at: F.xxhash64(*(F.get("words", at + k) for k in range(5)))
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), window)
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    kept = ["doc_id", "lang", "source", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    # Most texts repeat no window; only the others are sorted.
    rows = rows.select(
        *kept,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, at: F.struct(h.alias("h"), at.alias("at")))),
        ).alias("sorted"),
    )
    same = lambda x, at: F.coalesce(F.get("sorted", at)["h"] == x["h"], F.lit(False))
    rows = rows.select(
        *kept,
        F.sort_array(
            F.transform(
                F.filter("sorted", lambda x, at: same(x, at - 1) | same(x, at + 1)), lambda x: x["at"]
            )
        ).alias("places"),
    )
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda sofar, at: F.struct(
            at.alias("last"), (sofar["n"] + F.least(F.lit(5), at - sofar["last"])).alias("n")
        ),
        lambda sofar: sofar["n"],
    )
    return rows.select(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rate(name: str) -> Column:
    part, per, whole, _, _ = RATES[name]
    return F.expr(f"{per} * {part} div greatest({whole}, 1)")


def bucket(value: Column) -> Column:
    """The number less its bits after the first ``BITS``."""
    return value - value % F.expr("shiftleft(1L, value_bits)")


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, name, value (a bucket's least number), n."""
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), rate(name).alias("value")) for name in RATES))
    return (
        rows.where(~base_failed())
        .select("lang", "source", F.inline(pairs))
        .withColumn("value_bits", F.greatest(F.length(F.bin("value")) - BITS, F.lit(0)))
        .select("lang", "source", "name", bucket(F.col("value")).alias("value"))
        .groupBy("lang", "source", "name", "value")
        .agg(F.count("*").alias("n"))
    )


def limits(cells: DataFrame, keys: list[str], spreads: int) -> DataFrame:
    """For each group its number of documents and, by rate, the least and most allowed."""
    merged = cells.groupBy(*keys, "name", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "name")
    below, total = F.sum("n").over(group.orderBy("value")), F.sum("n").over(group)
    ranked = merged.select(*keys, "name", "value", below.alias("below"), total.alias("total"))
    quartiles = F.col("name").isin([name for name, rule in RATES.items() if rule[-1]])

    def percentile(middle: int, tail: int) -> Column:
        reached = 100 * F.col("below") >= F.when(quartiles, middle).otherwise(tail) * F.col("total")
        return F.min(F.when(reached, F.col("value")))

    found = ranked.groupBy(*keys, "name").agg(
        F.max("total").alias("total"), percentile(25, 90).alias("low"), percentile(75, 99).alias("high")
    )
    columns = [F.max("total").alias("n")]
    for name, (_, _, _, slack, two_sided) in RATES.items():
        reach = (spreads if two_sided else 1) * (F.col("high") - F.col("low")) + slack
        own = F.col("name") == name
        columns.append(F.max(F.when(own, F.col("high") + reach)).alias(f"{name}_most"))
        if two_sided:
            columns.append(F.max(F.when(own, F.col("low") - reach)).alias(f"{name}_least"))
    return found.groupBy(*keys).agg(*columns)


def thresholds(rows: DataFrame, least: int, spreads: int) -> DataFrame:
    """The limits that hold for each language and source."""
    cells = written(sketches(rows), "quality-sketches")
    by_source, by_lang = limits(cells, ["lang", "source"], spreads), limits(cells, ["lang"], spreads)
    names = [c for c in by_lang.columns if c not in ("lang", "n")]
    overall = limits(cells.withColumn("all", F.lit(0)), ["all"], spreads).first()
    by_lang = by_lang.select(F.col("lang").alias("of_lang"), F.col("n").alias("n_lang"), *(F.col(c).alias(f"lang_{c}") for c in names))
    joined = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")))
    chosen = [
        F.when(F.col("n") >= least, F.col(c))
        .when(F.col("n_lang") >= least, F.col(f"lang_{c}"))
        .otherwise(F.lit(overall[c] if overall else None).cast("long"))
        .alias(c)
        for c in names
    ]
    return joined.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *chosen)


def quality_rules(
    docs: DataFrame, least: int = 100, spreads: int = 4,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Features, base_failed, kept and the names of the rules that a document fails."""
    rows = written(features(docs, id_col, text_col, lang_col, source_col), "quality-features")
    # From files on both sides: a hot source can be split, or the small table broadcast when it is.
    allowed = written(thresholds(rows, least, spreads), "quality-thresholds")
    joined = rows.join(
        allowed,
        F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")),
        "left",
    )
    failed = [F.when(base_failed(), F.lit("base"))]
    for name, (*_, two_sided) in RATES.items():
        outside = rate(name) > F.col(f"{name}_most")
        if two_sided:
            outside |= rate(name) < F.col(f"{name}_least")
        failed.append(F.when(outside, F.lit(name)))
    return joined.select(
        "doc_id", "lang", "source", *FEATURES, base_failed().alias("base_failed"),
        F.array_compact(F.array(*failed)).alias("failed"),
    ).withColumn("kept", F.size("failed") == 0)
