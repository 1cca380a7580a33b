"""Study-shaped inputs derived from the benchmark's star-schema tables.

Every view is built from whole tables.  Calendar dates move 13 years ahead so
that seasons run from 2008 to 2014 and the study's cut-off years matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

YEAR_SHIFT = 13

# Order prices run evenly from 1,000 to 500,000.  The bands overlap, so that
# some surgeries are both reported and listed.
REPORTED_PRICES = (455_000, None)
LISTED_PRICES = (425_000, 480_000)
UNDATED_PRICES = (460_000, 464_000)

SEASON_LEVEL = {
    "1-URGENT": "MLB", "2-HIGH": "AAA", "3-MEDIUM": "AA", "4-NOT SPECIFIED": "A+", "5-LOW": "A",
}
REPORTED_LEVEL = {"1-URGENT": "Major", "2-HIGH": "Minor", "3-MEDIUM": "Amateur"}
LISTED_LEVEL = {
    "1-URGENT": "MLB", "2-HIGH": "AAA", "3-MEDIUM": "A", "4-NOT SPECIFIED": "HS", "5-LOW": "Ind",
}
PITCH_TYPE = {"click": "FF", "view": "SI", "error": "SL", "purchase": "CH", "signup": "FC"}


def _recode(name: str, mapping: dict[str, str]) -> Column:
    """Value per listed code, missing for any other; one expression call."""
    branches = " ".join(f"when '{old}' then '{new}'" for old, new in mapping.items())
    return F.expr(f"case {name} {branches} end")


class DriverViews:
    """Lazily built views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One scan definition per table, so its footer is read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def player(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        position = F.when(segment == "MACHINERY", "C").when(
            segment.isNull() | (segment != "FURNITURE"), "P"
        )
        return self.table("customer").select(
            F.col("c_custkey").alias("player_id"),
            F.col("c_name").alias("name_full"),
            position.alias("position"),
        )

    def _order_totals(self) -> DataFrame:
        """Lines and quantity per order, joined to the order's own columns."""
        per_order = self.table("lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")
        )
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("raw_year")
        )
        return orders.join(per_order, orders.o_orderkey == per_order.l_orderkey)

    def untyped(self) -> DataFrame:
        """Orders as columns of every type a file may hold, some with missing values."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.cast("int").alias("whole"),
            F.when(key % 7 != 0, key * 10_000_000_000).alias("long"),
            (F.col("o_totalprice") / 8).alias("fraction"),
            F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(key.cast("string"), F.lit(".5"))).alias("mixed_number"),
            F.when(key % 5 != 0, F.col("o_orderdate").cast("date")).alias("date"),
            F.when(key % 2 == 0, F.col("o_orderdate").cast("date").cast("string"))
            .otherwise(key.cast("string"))
            .alias("date_or_number"),
            F.when(key % 3 == 0, F.lit("NA")).otherwise(F.col("o_orderpriority")).alias("text"),
            F.lit(None).cast("string").alias("nothing"),
        )

    def season(self) -> DataFrame:
        rows = self._order_totals().select(
            (F.col("raw_year") + YEAR_SHIFT).alias("year"),
            _recode("o_orderpriority", SEASON_LEVEL).alias("level"),
            (F.lit(101) + F.col("o_custkey") % 5).cast("bigint").alias("league_id"),
            F.col("o_custkey").alias("player_id"),
            "o_orderkey",
            "lines",
            "quantity",
        )
        return rows.groupBy("year", "level", "league_id", "player_id").agg(
            F.countDistinct("o_orderkey").alias("games"),
            (4 * F.sum("lines")).alias("batters_faced"),
            F.sum("quantity").cast("bigint").alias("pitches"),
        )

    def season_download(self) -> DataFrame:
        """The season table under the column names a download would carry."""
        return self.season().withColumnsRenamed(
            {"games": "gamesPitched", "batters_faced": "battersFaced", "pitches": "numberOfPitches"}
        ).withColumn("positionAbbreviation", F.lit("P"))

    def season_by_file(self) -> DataFrame:
        """One row per season and pitcher; the role is unrecorded after a single game."""
        totals = self.season().groupBy("year", F.col("player_id").alias("pitcher_id")).agg(
            F.sum("batters_faced").alias("batters_faced"),
            F.sum("games").alias("games"),
            F.sum("pitches").alias("pitches"),
        )
        recorded = F.col("games") > 1
        role = F.when(F.col("pitches") >= 75 * F.col("games"), "starter").otherwise("reliever")
        return totals.select(
            "year", "pitcher_id", "batters_faced", F.when(recorded, role).alias("role")
        )

    def season_rows(self) -> DataFrame:
        """One row per season, level and pitcher, each with its own role or none."""
        recorded = F.col("games") > 1
        role = F.when(F.col("pitches") >= 75 * F.col("games"), "starter").otherwise("reliever")
        return self.season().select(
            "year",
            F.col("player_id").alias("pitcher_id"),
            "batters_faced",
            F.when(recorded, role).alias("role"),
        )

    def _tracking(self, flag: str, key: str) -> DataFrame:
        groups = (
            self.table("lineitem")
            .where(F.col("l_returnflag") == flag)
            .groupBy(
                F.col("l_partkey").alias(key),
                (F.year("l_shipdate") + YEAR_SHIFT).alias("year"),
            )
            .agg(
                F.sum("l_quantity").cast("bigint").alias("TotalPitches"),
                F.count(F.lit(1)).alias("lines"),
                F.round(90 + 40 * F.avg("l_discount"), 6).alias("velo"),
            )
        )
        velo = F.when(F.col("lines") != 4, F.col("velo")).alias("PrimaryFB_Velo")
        return groups.select(key, "year", "TotalPitches", velo)

    def majors_hawkeye(self) -> DataFrame:
        return self._tracking("A", "pitcher")

    def minors_hawkeye(self) -> DataFrame:
        return self._tracking("N", "pitcher")

    def minors_trackman(self) -> DataFrame:
        return self._tracking("R", "pitcher_id")

    def _surgery_rows(self, low: int, high: int | None) -> DataFrame:
        """Orders in a price band stand for surgeries; one narrow band is undated.

        A band without an upper end takes every dearer order.
        """
        shifted = F.add_months(F.col("o_orderdate").cast("date"), 12 * YEAR_SHIFT)
        undated = F.col("o_totalprice").between(*UNDATED_PRICES)
        date = F.when(~undated, shifted)
        in_band = F.col("o_totalprice") >= low
        if high is not None:
            in_band &= F.col("o_totalprice") < high
        return self.table("orders").where(in_band).withColumns(
            {"year": F.year(date), "date_surgery": F.date_format(date, "MM/dd/yy")}
        )

    def reported_injury(self) -> DataFrame:
        return self._surgery_rows(*REPORTED_PRICES).select(
            F.col("o_custkey").alias("player_id"),
            "year",
            "date_surgery",
            _recode("o_orderpriority", REPORTED_LEVEL).alias("level"),
        )

    def _listed(self) -> DataFrame:
        return self._surgery_rows(*LISTED_PRICES).select(
            F.col("o_custkey").alias("player_id"),
            _recode("o_orderpriority", LISTED_LEVEL).alias("level"),
            F.when(F.col("o_orderstatus") == "P", "C").otherwise("P").alias("position"),
            "date_surgery",
            "o_orderstatus",
        )

    def tommy_john(self) -> DataFrame:
        return self._listed().where(F.col("o_orderstatus").isin("F", "P")).drop("o_orderstatus")

    def internal_brace(self) -> DataFrame:
        return (
            self._listed().where(~F.col("o_orderstatus").isin("F", "P")).drop("o_orderstatus", "position")
        )

    def pitch(self) -> DataFrame:
        """Events as pitches; speeds carry a pitcher's and a game's own level and trend.

        The factors are binary fractions, so that every engine adds the same numbers.
        """
        game = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
        hour = F.hour("ts")
        pitcher_level = ((F.col("user_id") * 37) % 11 - 5) * F.lit(0.5)
        game_level = ((game * 5 + F.col("user_id") * 3) % 7 - 3) * F.lit(0.25)
        pitcher_trend = hour * ((F.col("user_id") * 13) % 5 - 2) * F.lit(0.03125)
        game_trend = hour * ((game * 3 + F.col("user_id")) % 3 - 1) * F.lit(0.015625)
        return self.table("events").select(
            game.alias("game_id"),
            (F.col("user_id") * 100 + hour).alias("event_index"),
            F.col("event_id").alias("play_index"),
            F.col("event_id").cast("string").alias("play_id"),
            _recode("event_type", PITCH_TYPE).alias("pitch_type"),
            (130 + F.col("value") / 50 + pitcher_level + game_level + pitcher_trend + game_trend).alias(
                "release_speed"
            ),
            F.col("user_id").alias("pitcher_id"),
        )

    def event(self) -> DataFrame:
        pitch = self.pitch().select("game_id", "event_index").distinct()
        return pitch.withColumn("inning", (F.col("event_index") % 100).cast("int"))

    def game(self) -> DataFrame:
        day = F.col("ts").cast("date")
        return self.table("events").select(
            F.datediff(day, F.lit("2024-01-01").cast("date")).cast("bigint").alias("game_id"),
            day.alias("date"),
        ).distinct()

    def biomechanics(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("org_movement_id"), F.col("label").alias("metric")
        )
