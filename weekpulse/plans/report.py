"""All results of one report: one fact table, one pinned time, one selection."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpulse.functions import percent
from weekpulse.functions.display import display_table
from weekpulse.operators.many_times import period_sums_at
from weekpulse.operators.measures import ALL, MAIN, both_sides, compared
from weekpulse.operators.outer_join import joined_period_sums
from weekpulse.operators.period_sums import CUBE_KEYS, add_up, add_up_sets, period_sums
from weekpulse.operators.refreshed import kept_hours, same_days, since, unsettled_from
from weekpulse.plans import hourly, insights, totals
from weekpulse.sources.shared import new_folder, remove
from weekpulse.spec import ReportSpec, check_read_for

GRAINS = {
    0: "brand_feature",
    1: "brand",
    2: "feature",
    3: "total",
}


class Report:
    """Each method declares a DataFrame; nothing runs until its caller acts on it.

    A single result sums the fact rows at just the grain it needs. `cache()` is for reading
    several: it keeps the brand x feature x hour sums, from which every result is then derived.
    """

    def __init__(self, fact: DataFrame, spec: ReportSpec) -> None:
        check_read_for(fact, spec)
        self.fact = fact
        self.spec = spec
        self._cube: DataFrame | None = None
        self._folder: str | None = None

    def cache(self) -> Report:
        if self._cube is None:
            self._cube = period_sums(self.fact, self.spec, CUBE_KEYS).persist()
        return self

    def close(self) -> None:
        if self._cube is not None:
            self._cube.unpersist()
            self._cube = None
        if self._folder is not None:
            remove(self.fact.sparkSession, self._folder)
            self._folder = None

    def refresh(self, fact: DataFrame, as_of: datetime, unsettled_hours: int | None = None) -> Report:
        """The same report at a new time, dropping what was kept for the old one.

        The fact rows are given anew: the old ones may have been read for the old periods only. With
        `unsettled_hours`, hours that far before the end of a period are taken to have all their rows; a
        cached report on the same day then keeps their sums and reads only the hours after them.
        """
        cached, fresh = self._cube is not None, Report(fact, self.spec.at(as_of))
        if cached and unsettled_hours is not None and same_days(self.spec, fresh.spec):
            fresh._follow(self._cube, self.spec, unsettled_hours)
        elif cached:
            fresh.cache()
        self.close()
        return fresh

    def _follow(self, cube: DataFrame, before: ReportSpec, unsettled_hours: int) -> None:
        """The cube from an earlier one of the same days.

        It is written, so that refreshing again and again does not lengthen what it is derived from.
        """
        spark = self.fact.sparkSession
        hours = unsettled_from(before, self.spec, unsettled_hours)
        new = period_sums(since(self.fact, self.spec, hours), self.spec, CUBE_KEYS)
        sums = add_up(kept_hours(cube, hours).union(new), CUBE_KEYS)
        self._folder = new_folder(spark, "cube")
        sums.where("rows_today + rows_last_week > 0").select(
            *(F.col(f.name).cast(f.dataType) for f in cube.schema)
        ).write.parquet(self._folder)
        self._cube = spark.read.schema(cube.schema).parquet(self._folder)

    def summaries(self, step: timedelta, count: int) -> DataFrame:
        """The summary at `as_of` and `count` - 1 later times, `step` apart, from one scan."""
        sums = period_sums_at(self.fact, self.spec, step, count, ("brand", "feature"))
        rows = sums.select("as_of", "brand", "feature", *compared(MAIN, percent.rounded))
        return rows.orderBy("as_of", "brand", "feature")

    def sums(self, *keys: str) -> DataFrame:
        if self._cube is None:
            return period_sums(self.fact, self.spec, keys)
        return self._cube if keys == CUBE_KEYS else add_up(self._cube, keys)

    # Brand and feature

    def summary(self) -> DataFrame:
        return self._compare(self.sums("brand", "feature")).orderBy("brand", "feature")

    def summary_by_join(self) -> DataFrame:
        sums = joined_period_sums(self.fact, self.spec, ("brand", "feature"))
        return self._compare(sums).orderBy("brand", "feature")

    def combined(self) -> DataFrame:
        """The selected brands as one; a single brand has nothing to combine with."""
        if not self._combines():
            return self.summary()
        return self.sums("feature").select(
            "feature", self._combined_label(), *compared(MAIN, percent.zero_filled)
        )

    def by_brand(self) -> DataFrame:
        return totals.breakdown(self.sums("brand"), "brand")

    def by_feature(self) -> DataFrame:
        return totals.breakdown(self.sums("feature"), "feature")

    def by_brand_long(self) -> DataFrame:
        return totals.revenue_bars(self.by_brand(), "brand")

    def by_feature_long(self) -> DataFrame:
        return totals.revenue_bars(self.by_feature(), "feature")

    def multi_grain(self) -> DataFrame:
        """The same sums by brand and feature, by brand, by feature and in total.

        One aggregation over the finest sums. A row of zeros goes in with them, so that there is a
        total without any rows, too; the groups that have nothing but this row are left out.
        """
        keys = ("brand", "feature")
        sums = self.sums(*keys)
        zero = [F.lit(0 if f.name not in keys else None).cast(f.dataType).alias(f.name) for f in sums.schema]
        seed = sums.sparkSession.range(1).select(*zero)
        sums = add_up_sets(sums.union(seed), [keys, ("brand",), ("feature",), ()], keys)
        sums = sums.filter((F.col("grain_id") == 3) | (F.col("rows_today") + F.col("rows_last_week") > 0))
        names = F.create_map(*[F.lit(x) for grain in GRAINS.items() for x in grain])
        return sums.select(
            "brand", "feature", names[F.col("grain_id")].alias("grain"), *both_sides(MAIN)
        )

    def grid(self) -> DataFrame:
        """Every selected brand with every selected feature, zeros where there is no data."""
        brands, features = self.spec.selected_brands, self.spec.selected_features
        if not brands or not features:
            raise ValueError("a grid needs the brands and features to be listed")
        # Both lists are configuration, so the grid is a literal and not a join of data.
        cells = (
            self.fact.sparkSession.range(1)
            .select(F.explode(F.lit(list(brands))).alias("brand"))
            .select("brand", F.explode(F.lit(list(features))).alias("feature"))
        )
        sums = cells.join(self.sums("brand", "feature"), ["brand", "feature"], "left")
        return sums.select("brand", "feature", *compared(ALL, percent.plain_ratio))

    def percent_rules(self) -> DataFrame:
        return totals.percent_rules(self.sums("brand", "feature"))

    def display(self) -> DataFrame:
        return display_table(self.summary())

    # Totals

    def new_devices_totals(self) -> DataFrame:
        return totals.new_devices(self.sums())

    def kpi_totals(self) -> DataFrame:
        return totals.kpis(self.sums())

    def kpi_display(self) -> DataFrame:
        return totals.kpis_as_text(self.kpi_totals())

    def summary_with_totals(self) -> DataFrame:
        """The summary with the new-device scalars of the whole report on each row."""
        return self._with_totals(self._compare(self.sums("brand", "feature")))

    def combined_with_totals(self) -> DataFrame:
        return self._with_totals(self.combined())

    def data_summary(self) -> DataFrame:
        return self.sums("brand", "feature").agg(
            F.count("*").alias("n_rows"),
            F.count_distinct("brand").alias("n_brands"),
            F.count_distinct("feature").alias("n_features"),
        )

    def dimension_values(self) -> DataFrame:
        values = F.array(
            *[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in ("brand", "feature")]
        )
        found = self.sums("brand", "feature").select(F.inline(values)).distinct()
        return found.orderBy("dim", "value")

    # Hours

    def hourly(self) -> DataFrame:
        return self.sums(*CUBE_KEYS).select(*CUBE_KEYS, *both_sides(ALL)).orderBy("hour_of_day")

    def hourly_by_join(self) -> DataFrame:
        sums = joined_period_sums(self.fact, self.spec, CUBE_KEYS)
        return sums.select(*CUBE_KEYS, *both_sides(ALL)).orderBy("hour_of_day")

    def hourly_combined(self) -> DataFrame:
        """The same columns for one brand, which keeps its name, and for several."""
        if not self._combines():
            return self.sums(*CUBE_KEYS).select("feature", "hour_of_day", "brand", *both_sides(MAIN))
        return self.sums("feature", "hour_of_day").select(
            "feature", "hour_of_day", self._combined_label(), *both_sides(MAIN)
        )

    def new_devices_hourly(self) -> DataFrame:
        return hourly.new_devices(self.sums("hour_of_day"))

    def hourly_series(self, zone: str | None = None) -> DataFrame:
        """Chart lines by hour; with a zone, today's line ends at the hour it is there."""
        return hourly.series(self.sums("hour_of_day"), self.spec, zone)

    def hourly_shifted(self, by: int) -> DataFrame:
        return hourly.shifted(self.sums("hour_of_day"), by)

    # Insights

    def peak_hour(self) -> DataFrame:
        return insights.peak_hour(self.sums("hour_of_day"))

    def top_feature(self) -> DataFrame:
        return insights.top_feature(self.sums("feature"))

    def insights(self) -> DataFrame:
        return insights.insights(self.sums("feature", "hour_of_day"))

    def _compare(self, sums: DataFrame) -> DataFrame:
        return sums.select("brand", "feature", *compared(MAIN, percent.rounded))

    def _with_totals(self, rows: DataFrame) -> DataFrame:
        scalars = self.new_devices_totals().select(F.struct("*")).scalar()
        return rows.withColumn("totals", scalars).select("*", "totals.*").drop("totals")

    def _combines(self) -> bool:
        if not self.spec.selected_brands:
            raise ValueError("combining needs the brands to be listed")
        return len(self.spec.selected_brands) > 1

    def _combined_label(self):
        return F.lit(f"Combined ({len(self.spec.selected_brands)} brands)").alias("brand")
