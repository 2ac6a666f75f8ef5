"""Contest-shaped views of the driver's tables.

Each view is a deterministic projection of whole tables, so a query and its SQL
check read the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtura.functions.labels import result, snapshot_for_date, with_edition
from fixtura.functions.prices import decimal_price
from fixtura.functions.weights import Tiers, day_number
from fixtura.operators.market import align_quotes
from fixtura.operators.metrics import log_loss
from fixtura.operators.ordered import number_rows
from fixtura.operators.squads import first_seen, team_pool
from fixtura.plans.backtest import numbered_repeats
from fixtura.plans.matrix import build_matrix
from fixtura.runtime import shuffled, sized_broadcast, stored_once, with_once, written

TIERS = Tiers(
    labels=(
        ("major_finals", ("1-URGENT",)),
        ("major_qual", ("2-HIGH",)),
        ("regional_champ", ("3-MEDIUM",)),
        ("friendly", ("4-NOT SPECIFIED",)),
        ("multisport", ("5-LOW",)),
    ),
    values={
        "major_finals": 1.0, "major_qual": 0.6, "regional_champ": 0.45,
        "friendly": 0.3, "multisport": 0.2, "default": 0.25,
    },
)
FIRST_YEAR, LAST_VERSION = 1995, 6
TEAM_ALIASES = {"Nation One": "NATION_1"}


def importance() -> Column:
    return TIERS.value(F.col("tournament"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_broadcast(table(spark, sf_dir, "nation"))


def raw_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item whose customer and supplier come from different nations."""
    nation = nations(spark, sf_dir)
    home = (
        table(spark, sf_dir, "orders")
        .join(sized_broadcast(table(spark, sf_dir, "customer")), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "o_orderpriority", F.col("n_name").alias("home_team"))
    )
    away = sized_broadcast(
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("away_team"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(shuffled(home), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(away, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter(F.col("home_team") != F.col("away_team"))
        .select(
            F.col("o_orderdate").cast("date").alias("match_date"),
            day_number(F.col("o_orderdate")).alias("day"),
            "home_team",
            "away_team",
            (F.col("l_quantity").cast("int") % 5).alias("home_score"),
            ((F.floor(F.col("l_discount") * 100 + 0.5).cast("int") + F.col("l_linenumber")) % 4).alias("away_score"),
            F.col("o_orderpriority").alias("tournament"),
            (F.col("l_returnflag") == "N").alias("neutral"),
            ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7)).alias("unplayed"),
        )
    )


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_contests(spark, sf_dir).drop("unplayed")


def team_number(name: str) -> Column:
    return F.substring(name, 8, 9).cast("int")


def unclean_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests whose unplayed rows have NULL scores."""
    rows = raw_contests(spark, sf_dir)
    scores = {c: F.when(~F.col("unplayed"), F.col(c)) for c in ("home_score", "away_score")}
    return rows.withColumns(scores).drop("unplayed")


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping former-name spans per team; the first row wins."""
    spans = F.array(
        *[
            F.struct(
                F.lit(no).alias("row_no"),
                F.concat(F.lit(prefix), F.col("n_name")).alias("current"),
                F.to_date(F.lit(start)).alias("start_date"),
                F.to_date(F.lit(end)).alias("end_date"),
            )
            for no, prefix, start, end in (
                (1, "NEW_", "1996-01-01", "1998-12-31"),
                (2, "ALT_", "1998-06-01", "1999-12-31"),
            )
        ]
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("former"), F.inline(spans))


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edition of the top competition per year in which rosters exist."""
    years = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return years.select(F.lit("Cup").alias("competition"), "year", F.concat(F.lit("Cup "), F.col("year")).alias("name"))


COMPETITIONS = {"1-URGENT": "Cup"}


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (team, edition, player): parts a nation's suppliers shipped in a year."""
    supplier = sized_broadcast(
        table(spark, sf_dir, "supplier")
        .join(nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("team"))
    )
    shipped = (
        table(spark, sf_dir, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("team", F.year("l_shipdate").alias("year"), F.col("l_partkey").alias("player_id"))
        .agg(F.min(F.col("l_shipdate").cast("date")).alias("seen"))
    )
    key = F.col("p_partkey")
    return shipped.join(shuffled(table(spark, sf_dir, "part")), F.col("player_id") == key).select(
        "team",
        F.concat(F.lit("Cup "), F.col("year")).alias("edition"),
        "year",
        "player_id",
        F.when(key % 40 != 0, F.col("p_brand")).alias("club"),
        F.element_at(F.array(*map(F.lit, ("GK", "DF", "MF", "FW"))), (key % 4 + 1).cast("int")).alias("position"),
        (17 + F.col("p_size") % 22).alias("age"),
        "seen",
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player's rating in every snapshot."""
    key, version = F.col("p_partkey"), F.col("version")
    return (
        table(spark, sf_dir, "part")
        .withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(LAST_VERSION))))
        .select(
            key.alias("player_id"),
            "version",
            (50 + (key * 7 + version * 3) % 45).cast("int").alias("overall"),
            (50 + (key * 7 + version * 3) % 45 + F.col("p_size") % 6).cast("int").alias("potential"),
        )
    )


def version_of(date: Column) -> Column:

    return snapshot_for_date(date, FIRST_YEAR, 0, LAST_VERSION)


PRICE_CYCLE = {
    "home": ("1.80", "+140", "-175", "260", "-"),
    "draw": ("3.40", "+230", "310", "3.10", "-"),
    "away": ("4.20", "-110", "+1,150", "2.05", "-"),
}


def price_texts(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One quote per distinct fixture: date shifted, sides swapped on even days, prices as text."""
    day = F.col("day")
    fixtures = (contests(spark, sf_dir) if rows is None else rows).select("day", "home_team", "away_team").distinct()
    swapped = day % 2 == 0

    def raw(name: Column) -> Column:
        return F.when(name == "NATION_1", "Nation One").when(name == "NATION_2", "Unknown").otherwise(name)

    def text(side: str) -> Column:
        return F.element_at(F.array(*map(F.lit, PRICE_CYCLE[side])), (day % 5 + 1).cast("int"))

    first = F.when(swapped, F.col("away_team")).otherwise(F.col("home_team"))
    second = F.when(swapped, F.col("home_team")).otherwise(F.col("away_team"))
    number = day.cast("bigint") * 10_000 + team_number("home_team") * 100 + team_number("away_team")
    return fixtures.select(
        number.alias("quote_no"),
        F.date_from_unix_date((day + day % 3 - 1).cast("int")).alias("match_date"),
        raw(first).alias("home_raw"),
        raw(second).alias("away_raw"),
        text("home").alias("text_home"),
        text("draw").alias("text_draw"),
        text("away").alias("text_away"),
    )


def quotes(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The quotes with decimal prices."""
    prices = {f"odds_{s}": decimal_price(F.col(f"text_{s}")) for s in PRICE_CYCLE}
    return with_once(price_texts(spark, sf_dir, rows), prices).select("quote_no", "match_date", "home_raw", "away_raw", *prices)


def fixture_days(rows: DataFrame) -> DataFrame:
    """What quotes are made for and aligned to: the distinct days and sides of contests, stored."""
    return stored_once(rows.select("day", "home_team", "away_team").distinct())


def _stage(date: str) -> Column:
    day = F.unix_date(date)
    return F.when(day % 4 == 0, F.concat(F.lit("Round "), (day % 3).cast("string")))


def _date_cell(date: str) -> Column:
    return F.concat(F.date_format(date, "d MMM yyyy"), F.coalesce(F.concat(F.lit(" - "), _stage(date)), F.lit("")))


def paste_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes as one-value-per-line pastes, one file per year; some blocks lack a score."""
    rows = price_texts(spark, sf_dir)
    scored = F.array(
        F.lit("Finished"), F.col("home_raw"), F.lit("2"), F.lit("–"), F.lit("1"), F.col("away_raw"),
        F.col("text_home"), F.col("text_draw"), F.col("text_away"),
    )
    bare = F.array(
        F.lit("Cancelled"), F.col("home_raw"), F.lit("–"), F.col("away_raw"), F.lit("-"), F.lit("-"), F.lit("-")
    )
    block = F.when(F.col("quote_no") % 11 == 0, bare).otherwise(scored)
    file = F.concat(F.lit("paste_"), F.year("match_date")).alias("file")
    chunk = F.unix_date("match_date").cast("bigint").alias("chunk")
    blocks = rows.select(file, chunk, F.col("quote_no"), F.posexplode(block).alias("i", "line")).select(
        "file", "chunk", (F.col("quote_no") * 10 + F.col("i")).alias("position"), "line"
    )
    heads = rows.select("match_date").distinct().select(
        file, chunk, F.posexplode(F.array(_date_cell("match_date"), F.lit("1"), F.lit("X"), F.lit("2"))).alias("i", "line")
    ).select("file", "chunk", F.col("i").cast("bigint").alias("position"), "line")
    return heads.unionByName(blocks).withColumn("source", F.col("file"))


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes as structured exports: the date cell is written on a day's first row only."""
    rows = price_texts(spark, sf_dir)
    file = F.concat(F.lit("export_"), F.year("match_date"))
    first = F.row_number().over(W.partitionBy("match_date").orderBy("quote_no")) == 1
    cells = rows.select(
        file.alias("file"),
        file.alias("source"),
        F.unix_date("match_date").cast("bigint").alias("chunk"),
        F.col("quote_no").alias("position"),
        F.when(first, _date_cell("match_date")).alias("date"),
        F.col("home_raw").alias("home_team"),
        F.col("away_raw").alias("away_team"),
        *[F.col(f"text_{s}").alias(f"odds_{s}") for s in PRICE_CYCLE],
    )
    return number_rows(cells, "file", "chunk", "position")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests with closed-form forecasts, market forecasts and form."""
    day = F.col("day")
    s, u = day % 7, day % 5
    total = (3 + s + u).cast("double")
    quoted = day % 13 != 0
    return contests(spark, sf_dir).withColumns(
        {
            "result": result(F.col("home_score"), F.col("away_score")),
            "ph": (1 + s) / total,
            "pd": 1 / total,
            "pa": (1 + u) / total,
            "book_ph": F.when(quoted, (1 + u) / total),
            "book_pd": F.when(quoted, 1 / total),
            "book_pa": F.when(quoted, (1 + s) / total),
            "home_form": F.when(day % 11 != 0, s / 6.0),
            "away_form": u / 4.0,
        }
    )


def fixture_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts at one row per (date, home, away): the mean losses of its contests."""
    rows = predictions(spark, sf_dir).dropna(subset=["book_ph"])
    label = F.col("result")
    return (
        rows.groupBy("day", "home_team", "away_team")
        .agg(
            F.avg(log_loss(label, F.col("ph"), F.col("pd"), F.col("pa"))).alias("model_loss"),
            F.avg(log_loss(label, F.col("book_ph"), F.col("book_pd"), F.col("book_pa"))).alias("market_loss"),
        )
        .withColumn("row_key", F.col("day").cast("bigint") * 10_000 + team_number("home_team") * 100 + team_number("away_team"))
    )


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People as one source writes them: plain, misspelt, or shouted with a captain mark."""
    key, name = F.col("p_partkey"), F.col("p_name")
    written = (
        F.when(key % 3 == 0, F.replace(name, F.lit("i"), F.lit("y")))
        .when(key % 3 == 1, F.concat(F.upper(name), F.lit(" (c)")))
        .otherwise(name)
    )
    return table(spark, sf_dir, "part").select(
        key.alias("target_id"), F.col("p_type").alias("block"), written.alias("player_name"), F.col("p_size").alias("dob")
    )


def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same people as the other source writes them: initial and surname, or surname first with club."""
    key, name = F.col("p_partkey"), F.col("p_name")
    first, last = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    return table(spark, sf_dir, "part").select(
        key.alias("candidate_no"),
        key.alias("candidate_id"),
        F.col("p_type").alias("block"),
        F.concat(F.substring(first, 1, 1), F.lit(". "), last).alias("short_name"),
        F.concat(last, F.lit(", "), first, F.lit(" "), F.col("p_brand")).alias("long_name"),
        F.when(key % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("dob"),
    )


def value_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a JSON history payload of its user."""
    point = F.struct(F.date_format("ts", "dd/MM/yyyy").alias("datum_mw"), F.col("value").alias("y"))
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.to_json(F.struct(F.array(point).alias("list"))).alias("payload")
    )


def value_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, five days before the last event."""
    return (
        table(spark, sf_dir, "events").groupBy("user_id")
        .agg(F.max(F.col("ts").cast("date")).alias("_last"))
        .select("user_id", F.date_sub("_last", 5).alias("as_of"))
    )


def flat_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters as scraped text: marks in names, birth date with age, some names missing."""
    key = F.col("player_id")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_id"), "p_name", "p_size")
    mark = F.when(key % 23 == 0, " (captain)").when(key % 29 == 0, "*").otherwise("")
    born = F.date_add(F.to_date(F.lit("1970-01-01")), key.cast("int") % 10_000)
    rows = rosters(spark, sf_dir).join(part, "player_id")
    flat = rows.select(
        F.col("p_size").cast("string").alias("No."),
        F.col("position").alias("Pos."),
        F.when(key % 31 != 0, F.concat(F.col("p_name"), mark)).alias("Player"),
        F.when(key % 37 == 0, F.lit("unknown")).otherwise(
            F.concat(F.date_format(born, "d MMMM yyyy"), F.lit(" (aged "), F.col("age"), F.lit(")"))
        ).alias("Date of birth (age)"),
        F.when(key % 3 == 0, "n/a").otherwise((key % 100).cast("string")).alias("Caps"),
        (key % 30).cast("string").alias("Goals"),
        F.col("club").alias("Club"),
        F.col("team").alias("country"),
        F.col("edition").alias("tournament"),
        key.alias("row_no"),
    )
    return flat


def tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edition dimension with fixed ids."""
    return editions(spark, sf_dir).select(
        (F.col("year") - FIRST_YEAR + 1).alias("tournament_id"), "name", "year", "competition",
        F.concat(F.col("year"), F.lit("_squads")).alias("wiki_page"),
    )


def edition_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests with the edition of the top competition in their year."""
    return with_edition(contests(spark, sf_dir), editions(spark, sf_dir), COMPETITIONS, {})


def matrix(spark: SparkSession, sf_dir: str, numbered: Sequence[str] = ()) -> DataFrame:
    """Feature matrix over all contests, with the contest table stored once.

    With ``numbered`` each row has a ``row_no``: its number among contests that are equal in these columns goes into it."""
    rows = edition_contests(spark, sf_dir)
    if numbered:
        # The matrix has venues as whole numbers.
        rows = numbered_repeats(rows.withColumn("neutral", F.col("neutral").cast("int")), numbered)
    stored = written(rows if numbered else rows.hint("rebalance"))
    roster = written(rosters(spark, sf_dir))
    pool = team_pool(first_seen(roster, F.col("seen")), ratings(spark, sf_dir))
    days = fixture_days(stored)
    book = align_quotes(quotes(spark, sf_dir, days), days, TEAM_ALIASES).resolved.drop("quote_no")
    return build_matrix(
        stored, importance(), roster, pool, version_of(F.col("match_date")), book,
        half_life=180.0, window_years=3, pair_half_life=180.0, keep=["row_no"] if numbered else [],
    )
