"""Every registered query. Each reads whole tables through ``fixtura.adapters``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura import adapters as A
from fixtura.functions import labels, names, prices, weights
from fixtura.operators import bootstrap, clean, form, goals, guards, linkage, market, metrics, ordered, softmax, squads, star
from fixtura.plans import backtest, matrix, models, reads, tuning
from fixtura.runtime import materialise, spread_out, stored_once, written
from fixtura.sources import pages, quotes as quote_files
from workload.registry import CHECKS, QUERIES, query, tidy
from workload.views import IMPORTANCE, sql

__all__ = ["CHECKS", "QUERIES"]

SHORT = {"hl": 180.0, "win": 1095}
LONG = {"hl": 730.0, "win": 3650}
AS_OF = dt.date(2001, 8, 2)
KEY = ["match_date", "home_team", "away_team"]


def r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


# ------------------------------------------------------------- as-of features


@query("rolling_form", sql(f"SELECT team, CAST(day AS BIGINT) AS day, {r('form')} AS form FROM form", "form", **SHORT))
def _(s: SparkSession, d: str) -> DataFrame:
    return tidy(form.team_form(A.contests(s, d), A.importance(), 180.0, window_years=3).select("team", "day", "form"))


@query(
    "goal_trend",
    sql(
        f"SELECT team, CAST(day AS BIGINT) AS day, {r('gs')} AS goals_scored, {r('gc')} AS goals_conceded,"
        f" {r('gs - gc')} AS goal_differential FROM form", "form", **LONG,
    ),
)
def _(s, d):
    return tidy(form.team_form(A.contests(s, d), A.importance()).drop("form"))


@query("head_to_head", sql(f"SELECT lo, hi, CAST(day AS BIGINT) AS day, {r('lo_share')} AS lo_share FROM h2h", "h2h", hl=180.0))
def _(s, d):
    return tidy(form.pair_record(A.contests(s, d), A.importance(), 180.0))


@query(
    "team_day_partials",
    sql(
        f"SELECT team, CAST(day AS BIGINT) AS day, n, {r('w')} AS w, {r('wo')} AS w_outcome, {r('ws')} AS w_scored,"
        f" {r('wc')} AS w_conceded FROM team_day", "team_day",
    ),
)
def _(s, d):
    return tidy(form.team_day_partials(A.contests(s, d), A.importance()))


@query("matches_per_team", sql("SELECT team, count(*) AS n_matches FROM sides GROUP BY team", "sides"))
def _(s, d):
    return tidy(form.matches_per_team(A.contests(s, d)))


@query("team_names", sql("SELECT DISTINCT team FROM sides", "sides"))
def _(s, d):
    return tidy(reads.list_teams(A.contests(s, d)))


# -------------------------------------------------------- weights and labels

WEIGHT = "greatest(pow(0.5, (DATE '2000-06-30' - match_date) / 365.0), 0.05) * imp"


@query(
    "match_weights",
    sql(
        f"SELECT CAST(match_date AS VARCHAR) AS match_date, tournament, count(*) AS n, {r(f'min({WEIGHT})')} AS match_weight,"
        f" {r(f'sum({WEIGHT})')} AS total FROM contests WHERE match_date <= DATE '2000-06-30' GROUP BY match_date, tournament",
        "contests",
    ),
)
def _(s, d):
    weighted = weights.with_match_weights(A.contests(s, d), "2000-06-30", 365.0, A.TIERS)
    return tidy(
        weighted.groupBy("match_date", "tournament").agg(
            F.count(F.lit(1)).alias("n"), F.min("match_weight").alias("match_weight"), F.sum("match_weight").alias("total")
        )
    )


@query(
    "importance_tiers",
    sql(
        "SELECT tournament, CASE tournament WHEN '1-URGENT' THEN 'major_finals' WHEN '2-HIGH' THEN 'major_qual'"
        " WHEN '3-MEDIUM' THEN 'regional_champ' WHEN '4-NOT SPECIFIED' THEN 'friendly' WHEN '5-LOW' THEN 'multisport'"
        f" ELSE 'default' END AS tier, {r('max(imp)')} AS importance, count(*) AS n FROM contests GROUP BY tournament",
        "contests",
    ),
)
def _(s, d):
    label = F.col("tournament")
    rows = A.contests(s, d).select("tournament", A.TIERS.name(label).alias("tier"), A.TIERS.value(label).alias("importance"))
    return tidy(rows.groupBy("tournament", "tier").agg(F.max("importance").alias("importance"), F.count(F.lit(1)).alias("n")))


@query(
    "tier_remap",
    sql(
        f"SELECT CAST(t AS BIGINT) AS trial_id, tournament, tier, {r('v * (1 + t) / 4.0')} AS value FROM (SELECT DISTINCT tournament,"
        " CASE tournament WHEN '1-URGENT' THEN 'major_finals' WHEN '2-HIGH' THEN 'major_qual' WHEN '3-MEDIUM' THEN 'regional_champ'"
        f" WHEN '4-NOT SPECIFIED' THEN 'friendly' WHEN '5-LOW' THEN 'multisport' END AS tier, {IMPORTANCE} AS v FROM contests),"
        " range(0, 4) x(t)", "contests",
    ),
)
def _(s, d):
    contests = A.contests(s, d)
    tiers = contests.select(A.TIERS.name(F.col("tournament")).alias("tier"), A.importance().alias("v")).distinct()
    trials = tiers.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("trial_id"), "tier", "v").select(
        "trial_id", "tier", (F.col("v") * (1 + F.col("trial_id")) / 4.0).alias("value")
    )
    return tidy(weights.tier_values_for_trials(contests, trials, A.TIERS))


@query(
    "result_labels",
    sql(
        "SELECT result, CAST(CASE result WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS BIGINT) AS code, neutral, count(*) AS n,"
        " CAST(sum(home_score - away_score) AS BIGINT) AS goal_gap FROM predictions GROUP BY ALL", "predictions",
    ),
)
def _(s, d):
    label = labels.result(F.col("home_score"), F.col("away_score"))
    rows = A.contests(s, d).withColumn("result", label)
    grouped = rows.groupBy("result", "neutral").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("home_score") - F.col("away_score")).alias("goal_gap")
    )
    return tidy(grouped.withColumn("code", labels.label_code(F.col("result"))))


@query(
    "snapshot_for_date",
    sql(
        "SELECT CAST(match_date AS VARCHAR) AS match_date, CAST(max(version) AS BIGINT) AS version FROM probe_days GROUP BY match_date",
        "probe_days",
    ),
)
def _(s, d):
    dates = A.contests(s, d).select("match_date").distinct()
    return tidy(dates.withColumn("version", A.version_of(F.col("match_date"))))


EDITIONS = (
    "SELECT c.*, e.edition FROM contests c LEFT JOIN (SELECT DISTINCT year(l_shipdate) AS y, 'Cup ' || year(l_shipdate) AS edition"
    " FROM lineitem) e ON c.tournament = '1-URGENT' AND year(c.match_date) = e.y"
)


@query(
    "edition_lookup",
    sql(f"SELECT edition, tournament, count(*) AS n, CAST(min(match_date) AS VARCHAR) AS first_date FROM ({EDITIONS}) GROUP BY ALL", "contests"),
)
def _(s, d):
    rows = A.edition_contests(s, d)
    return tidy(rows.groupBy("edition", "tournament").agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first_date")))


@query(
    "edition_starts",
    sql(
        f"SELECT edition, CAST(min(match_date) AS VARCHAR) AS start FROM ({EDITIONS}) WHERE edition IS NOT NULL GROUP BY edition"
        " HAVING year(min(match_date)) >= 1998", "contests",
    ),
)
def _(s, d):
    folds = backtest.edition_folds(A.edition_contests(s, d), 1998)
    return tidy(s.createDataFrame([(f.name, f.start) for f in folds], "edition string, start date"))


# ------------------------------------------------------------------- cleaning


def _renamed(select: str, where: str) -> str:
    side = (
        "coalesce((SELECT arg_min(current, row_no) FROM renames r WHERE r.former = c.{0}_team"
        " AND c.match_date BETWEEN r.start_date AND r.end_date), c.{0}_team) AS {0}"
    )
    inner = f"SELECT c.*, {side.format('home')}, {side.format('away')} FROM raw_contests c {where}"
    return sql(select.format(inner), "raw_contests", "renames")


@query(
    "renamed_teams",
    _renamed("SELECT home AS home_team, away AS away_team, CAST(day AS BIGINT) AS day, count(*) AS n FROM ({}) GROUP BY ALL", ""),
)
def _(s, d):
    rows = clean.current_names(A.contests(s, d), A.renames(s, d))
    return tidy(rows.groupBy("home_team", "away_team", "day").agg(F.count(F.lit(1)).alias("n")))


@query(
    "clean_contests",
    _renamed(
        "SELECT home AS home_team, away AS away_team, tournament, year(match_date) AS year, count(*) AS n,"
        " CAST(sum(home_score) AS BIGINT) AS home_goals, CAST(sum(away_score) AS BIGINT) AS away_goals FROM ({}) GROUP BY ALL",
        "WHERE NOT unplayed AND tournament <> '5-LOW' AND year(match_date) >= 1996",
    ),
)
def _(s, d):
    rows = clean.clean_contests(A.unclean_contests(s, d), A.renames(s, d), 1996, ("5-LOW",))
    return tidy(
        rows.groupBy("home_team", "away_team", "tournament", F.year("match_date").alias("year")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("home_score").alias("home_goals"), F.sum("away_score").alias("away_goals")
        )
    )


# -------------------------------------------------------------------- rosters

SHARES = ", ".join(f"{r(f'n_{p} / squad_size')} AS share_{p}" for p in ("gk", "df", "mf", "fw"))


@query(
    "squad_age_depth",
    sql(f"SELECT team, edition, {r('mean_age')} AS mean_age, squad_size, n_gk, n_df, n_mf, n_fw, {SHARES} FROM squad", "squad"),
)
def _(s, d):
    return tidy(squads.age_depth(A.rosters(s, d)))


@query(
    "club_concentration",
    sql(
        "SELECT team, edition, squad_size, CAST(largest_club_bloc AS BIGINT) AS largest_club_bloc,"
        f" CAST(top2_club_bloc AS BIGINT) AS top2_club_bloc, {r('club_hhi')} AS club_hhi,"
        f" CAST(same_club_pairs AS BIGINT) AS same_club_pairs, n_distinct_clubs, {r('same_club_pair_ratio')} AS same_club_pair_ratio"
        " FROM chemistry", "chemistry",
    ),
)
def _(s, d):
    return tidy(squads.club_concentration(A.rosters(s, d)))


SNAPSHOTS = {f"Cup {1995 + v}": v for v in range(7)}
ERA = (
    "SELECT x.team, x.edition, x.player_id, r.overall, r.potential FROM rosters x LEFT JOIN ratings r"
    " ON r.player_id = x.player_id AND r.version = x.year - 1995 WHERE x.year BETWEEN 1995 AND 2001"
)


@query(
    "era_rating_join",
    sql(
        f"SELECT team, edition, count(*) AS n, CAST(sum(overall) AS BIGINT) AS overall, CAST(max(potential) AS BIGINT) AS best FROM ({ERA})"
        " GROUP BY team, edition", "rosters", "ratings",
    ),
)
def _(s, d):
    rated = squads.era_ratings(A.rosters(s, d), A.ratings(s, d), SNAPSHOTS)
    return tidy(
        rated.groupBy("team", "edition").agg(
            F.count(F.lit(1)).alias("n"), F.sum("overall").alias("overall"), F.max("potential").alias("best")
        )
    )


@query(
    "squad_rating",
    sql(
        f"SELECT team, edition, {r('CASE WHEN count(overall) >= 11 THEN avg(overall) END')} AS mean_overall,"
        f" {r('CASE WHEN count(overall) >= 11 THEN avg(potential) END')} AS mean_potential, count(overall) AS n_rated"
        f" FROM ({ERA}) GROUP BY team, edition", "rosters", "ratings",
    ),
)
def _(s, d):
    return tidy(squads.mean_rating(squads.era_ratings(A.rosters(s, d), A.ratings(s, d), SNAPSHOTS)))


def _pool(s, d):
    return squads.team_pool(squads.first_seen(A.rosters(s, d), F.col("seen")), A.ratings(s, d))


def _team_days(s, d):
    return form.side_rows(A.contests(s, d), "match_date").select("team", "match_date").distinct()


@query(
    "pool_first_seen",
    sql(
        "SELECT team, player_id, CAST(min(seen) AS VARCHAR) AS first_seen FROM rosters GROUP BY team, player_id", "rosters",
    ),
)
def _(s, d):
    return tidy(squads.first_seen(A.rosters(s, d), F.col("seen")))


@query(
    "pool_rating",
    sql(
        f"SELECT team, CAST(match_date AS VARCHAR) AS match_date, n_rated, {r('pool_rating')} AS pool_rating FROM pool_rating",
        "pool_rating",
    ),
)
def _(s, d):
    return tidy(squads.pool_rating(_pool(s, d), _team_days(s, d), A.version_of(F.col("match_date"))))


@query(
    "rating_gap",
    sql(
        f"SELECT CAST(f.match_date AS VARCHAR) AS match_date, f.home_team, f.away_team, {r('h.pool_rating - a.pool_rating')} AS rating_gap"
        " FROM fixtures f LEFT JOIN pool_rating h ON h.team = f.home_team AND h.match_date = f.match_date"
        " LEFT JOIN pool_rating a ON a.team = f.away_team AND a.match_date = f.match_date", "fixtures", "pool_rating",
    ),
)
def _(s, d):
    fixtures = A.contests(s, d).select(*KEY).distinct()
    rated = squads.pool_rating(_pool(s, d), _team_days(s, d), A.version_of(F.col("match_date")))
    for side in ("home", "away"):
        one = rated.select("match_date", F.col("team").alias(f"{side}_team"), F.col("pool_rating").alias(side))
        fixtures = fixtures.join(one, ["match_date", f"{side}_team"], "left")
    return tidy(fixtures.select(*KEY, (F.col("home") - F.col("away")).alias("rating_gap")))


# ------------------------------------------------------------- quotes, market


@query(
    "odds_parse",
    sql(
        "SELECT text_home, text_draw, text_away, count(*) AS n, "
        + ", ".join(f"{r(f'max(odds_{x})')} AS odds_{x}" for x in ("home", "draw", "away"))
        + " FROM quotes GROUP BY ALL", "quotes",
    ),
)
def _(s, d):
    rows = A.price_texts(s, d)
    parsed = {f"odds_{x}": prices.decimal_price(F.col(f"text_{x}")) for x in ("home", "draw", "away")}
    return tidy(
        rows.withColumns(parsed).groupBy("text_home", "text_draw", "text_away", *parsed).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "devig",
    sql(f"SELECT quote_no, {r('ph')} AS ph, {r('pd')} AS pd, {r('pa')} AS pa FROM quotes LEFT JOIN named_quotes USING (quote_no)",
        "quotes", "named_quotes"),
)
def _(s, d):
    rows = A.quotes(s, d)
    triple = prices.fair_probabilities(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))
    return tidy(rows.select("quote_no", *[c.alias(p) for c, p in zip(triple, ("ph", "pd", "pa"))]))


@query(
    "canonical_teams",
    sql(
        "SELECT home_raw, CASE home_raw WHEN 'Nation One' THEN 'NATION_1' WHEN 'Unknown' THEN NULL ELSE home_raw END AS home,"
        " count(*) AS n FROM quotes GROUP BY ALL", "quotes",
    ),
)
def _(s, d):
    members = form.team_names(A.contests(s, d))
    named = market.canonical_teams(A.price_texts(s, d), members, {"home_raw": "home"}, A.TEAM_ALIASES)
    return tidy(named.groupBy("home_raw", "home").agg(F.count(F.lit(1)).alias("n")))


@query(
    "nearest_quotes",
    sql(
        "SELECT CAST(match_date AS VARCHAR) AS match_date, home_team, away_team, quote_no,"
        f" {r('book_ph')} AS book_ph, {r('book_pd')} AS book_pd, {r('book_pa')} AS book_pa FROM book", "book",
    ),
)
def _(s, d):
    rows = A.fixture_days(A.contests(s, d))
    return tidy(market.align_quotes(A.quotes(s, d, rows), rows, A.TEAM_ALIASES).resolved)


@query(
    "quote_review_queue",
    sql(
        "SELECT quote_no, home_raw, away_raw, home, away, 'team' AS reason FROM named_quotes WHERE home IS NULL OR away IS NULL"
        " UNION ALL SELECT quote_no, home_raw, away_raw, home, away, 'fixture' FROM named_quotes q"
        " WHERE home IS NOT NULL AND away IS NOT NULL AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.quote_no = q.quote_no)",
        "named_quotes", "matched",
    ),
)
def _(s, d):
    rows = A.fixture_days(A.contests(s, d))
    quotes = A.quotes(s, d, rows)
    found = market.align_quotes(quotes, rows, A.TEAM_ALIASES)
    raw = quotes.select("quote_no", "home_raw", "away_raw")
    lost = found.unknown_fixtures.drop("match_date").join(raw, "quote_no").withColumn("reason", F.lit("fixture"))
    return tidy(found.unknown_teams.withColumn("reason", F.lit("team")).unionByName(lost))


STAGED = (
    "SELECT *, CASE WHEN (match_date - DATE '1970-01-01') % 4 = 0 THEN 'Round ' || ((match_date - DATE '1970-01-01') % 3) END AS own_stage"
    " FROM quotes"
)
PRICED = ", ".join(f"{r(f'CASE WHEN quote_no % 11 <> 0 THEN odds_{x} END')} AS odds_{x}" for x in ("home", "draw", "away"))


@query(
    "paste_decode",
    sql(
        "SELECT 'paste_' || year(match_date) AS file, CAST(match_date AS VARCHAR) AS match_date, home_raw, away_raw,"
        f" {PRICED}, own_stage AS stage FROM ({STAGED})", "quotes",
    ),
)
def _(s, d):
    return tidy(quote_files.decode_paste(A.paste_lines(s, d)).drop("source", "ordinal", "competition"))


@query(
    "export_normalise",
    sql(
        "SELECT 'export_' || year(match_date) AS file, CAST(match_date AS VARCHAR) AS match_date, home_raw, away_raw, "
        + ", ".join(f"{r(f'odds_{x}')} AS odds_{x}" for x in ("home", "draw", "away"))
        + ", last_value(own_stage IGNORE NULLS) OVER (PARTITION BY year(match_date) ORDER BY match_date"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stage FROM ({STAGED})", "quotes",
    ),
)
def _(s, d):
    return tidy(quote_files.normalise_export(A.export_lines(s, d)).drop("source", "ordinal", "competition"))


@query(
    "quote_dedupe",
    sql(
        "SELECT CAST(match_date AS VARCHAR) AS match_date, home_raw, away_raw, min(quote_no) AS quote_no, round(arg_min(odds_home, quote_no), 6) + 0.0 AS odds_home FROM quotes"
        " GROUP BY match_date, home_raw, away_raw", "quotes",
    ),
)
def _(s, d):
    rows = A.quotes(s, d).select("match_date", "home_raw", "away_raw", "quote_no", "odds_home")
    later = rows.withColumns({"quote_no": F.col("quote_no") + 10**9, "odds_home": F.lit(9.99)})
    return tidy(ordered.keep_first(later.unionByName(rows), ["match_date", "home_raw", "away_raw"], ["quote_no"]))


@query(
    "source_audit",
    sql(
        "SELECT 'paste_' || year(match_date) AS source, count(*) AS n_rows, count(*) FILTER (odds_home IS NULL OR odds_home <= 1"
        " OR odds_draw IS NULL OR odds_draw <= 1 OR odds_away IS NULL OR odds_away <= 1) AS n_unusable,"
        " CAST(min(match_date) AS VARCHAR) AS first_date, CAST(max(match_date) AS VARCHAR) AS last_date FROM quotes GROUP BY 1", "quotes",
    ),
)
def _(s, d):
    tagged = A.quotes(s, d).withColumn("source", F.concat(F.lit("paste_"), F.year("match_date")))
    return tidy(quote_files.source_audit(tagged))


# --------------------------------------------------------- pages and valuations

LINK = r'(?s)<a\s[^>]*?href="([^"]+)"[^>]*>(.*?)</a>'


@query(
    "link_extract",
    "SELECT page_id, link, arg_min(text, pos) AS text, min(pos) AS pos FROM (SELECT page_id, link,"
    r" regexp_replace(regexp_replace(inner_html, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') AS text, pos FROM (SELECT page_id,"
    f" unnest(regexp_extract_all(html, '{LINK}', 1)) AS link, unnest(regexp_extract_all(html, '{LINK}', 2)) AS inner_html,"
    f" unnest(range(0, len(regexp_extract_all(html, '{LINK}', 1)))) AS pos FROM pages)) WHERE text <> '' GROUP BY page_id, link",
)
def _(s, d):
    return tidy(pages.extract_links(A.table(s, d, "pages"), LINK))


@query(
    "value_history_points",
    sql(f"SELECT user_id, event_id, CAST(value_date AS VARCHAR) AS value_date, {r('value')} AS value FROM value_points", "value_points"),
)
def _(s, d):
    return tidy(pages.value_points(A.value_payloads(s, d), "user_id", "payload", "event_id").drop("pos"))


@query(
    "value_asof",
    sql(
        "SELECT t.user_id, CAST(t.as_of AS VARCHAR) AS as_of,"
        f" {r('arg_max(p.value, p.event_id) FILTER (p.value_date = t.recent)')} AS value_recent,"
        f" {r('arg_max(p.value, p.event_id) FILTER (p.value_date = t.past)')} AS value_past FROM (SELECT t.user_id, t.as_of,"
        " max(p.value_date) FILTER (p.value_date <= t.as_of) AS recent, max(p.value_date) FILTER (p.value_date <= t.as_of - 10) AS past"
        " FROM (SELECT user_id, max(value_date) - 5 AS as_of FROM value_points GROUP BY user_id) t"
        " LEFT JOIN value_points p USING (user_id) GROUP BY t.user_id, t.as_of) t LEFT JOIN value_points p USING (user_id)"
        " GROUP BY t.user_id, t.as_of", "value_points",
    ),
)
def _(s, d):
    points = pages.value_points(A.value_payloads(s, d), "user_id", "payload", "event_id")
    return tidy(ordered.value_pair(points, A.value_targets(s, d), "user_id", 10, ["event_id", "pos"]))


# -------------------------------------------------------------- linkage and star


@query(
    "linkage_blocks",
    "SELECT p_type AS block, count(*) AS n, count(DISTINCT p_name) AS n_names, count(DISTINCT p_size) AS n_dates FROM part GROUP BY p_type",
)
def _(s, d):
    rows = A.link_targets(s, d).join(A.table(s, d, "part").select(F.col("p_partkey").alias("target_id"), "p_name"), "target_id")
    return tidy(
        rows.groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("p_name").alias("n_names"), F.countDistinct("dob").alias("n_dates")
        )
    )


@query(
    "name_keys",
    "SELECT p_partkey AS target_id, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'i', 'y') ELSE p_name END AS name_key FROM part",
)
def _(s, d):
    return tidy(A.link_targets(s, d).select("target_id", names.name_key(F.col("player_name")).alias("name_key")))


def _links(s, d):
    return linkage.best_candidates(A.link_targets(s, d), A.link_candidates(s, d), ["block"])


@query("linkage_best")
def _(s, d):
    return tidy(_links(s, d))


@query(
    "linkage_exact",
    "SELECT t.target_id, min(c.candidate_no) AS candidate_no FROM"
    " (SELECT p_partkey AS target_id, p_type AS block, p_size AS dob,"
    "  string_split(CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'i', 'y') ELSE p_name END, ' ') AS toks FROM part) t JOIN"
    " (SELECT p_partkey AS candidate_no, p_type AS block, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS dob,"
    "  list_append(string_split(p_name, ' '), NULL) AS toks,"
    "  [p_name[1], string_split(p_name, ' ')[-1]] AS short_toks,"
    "  list_concat(string_split(p_name, ' '), string_split(replace(lower(p_brand), '#', ' '), ' ')) AS long_toks FROM part) c"
    " ON t.block = c.block AND t.dob = c.dob AND (list_has_all(c.long_toks, t.toks) OR list_has_all(t.toks, c.short_toks)"
    "  OR list_has_all(c.short_toks, t.toks) OR list_has_all(t.toks, c.long_toks)) GROUP BY t.target_id",
)
def _(s, d):
    return tidy(_links(s, d).filter((F.col("name_score") == 1.0) & F.col("dob_match")).select("target_id", "candidate_no"))


@query("link_coverage")
def _(s, d):
    targets = A.link_targets(s, d)
    return tidy(linkage.coverage(targets, _links(s, d), "block"))


@query("link_review_queue")
def _(s, d):
    targets, candidates = A.link_targets(s, d), A.link_candidates(s, d)
    links = linkage.best_candidates(targets, candidates, ["block"])
    return tidy(linkage.review_queue(targets, links, candidates))


FLAT = (
    "SELECT *, CASE WHEN player_id % 31 <> 0 THEN p_name END AS player_name, player_id % 23 = 0 AND player_id % 31 <> 0 AS is_captain,"
    " CASE WHEN player_id % 37 <> 0 THEN DATE '1970-01-01' + CAST(player_id % 10000 AS INT) END AS born FROM rosters"
)


@query(
    "star_normalise",
    sql(
        "SELECT dense_rank() OVER (ORDER BY edition, team) AS squad_id, year - 1994 AS tournament_id, player_id AS row_key,"
        " player_name, is_captain, CAST(born AS VARCHAR) AS date_of_birth, CAST(CASE WHEN born IS NOT NULL THEN age END AS DOUBLE) AS age_at_tournament,"
        " CAST(CASE WHEN player_id % 3 <> 0 THEN player_id % 100 END AS DOUBLE) AS caps, position, CAST(p_size AS BIGINT) AS squad_number"
        f" FROM ({FLAT}) QUALIFY player_name IS NOT NULL", "rosters",
    ),
)
def _(s, d):
    flat = A.flat_rosters(s, d).withColumn("Club", F.col("row_no").cast("string"))
    built = star.normalise_rosters(flat, A.tournaments(s, d))
    return tidy(
        built.players.join(built.squads, "squad_id").select(
            "squad_id", "tournament_id", F.col("club").cast("bigint").alias("row_key"), "player_name", "is_captain",
            "date_of_birth", F.col("age_at_tournament").cast("double"), F.col("caps").cast("double"), "position", "squad_number",
        )
    )


@query(
    "star_appearances",
    sql(
        f"SELECT team, edition, position, count(*) AS n, {r('avg(CASE WHEN born IS NOT NULL THEN age END)')} AS mean_age FROM ({FLAT})"
        " WHERE player_name IS NOT NULL GROUP BY team, edition, position", "rosters",
    ),
)
def _(s, d):
    built = star.normalise_rosters(A.flat_rosters(s, d), A.tournaments(s, d))
    joined = squads.appearances(built.players, built.squads, built.tournaments)
    return tidy(
        joined.groupBy("team", "edition", "position").agg(
            F.count(F.lit(1)).alias("n"), F.avg("age_at_tournament").alias("mean_age")
        )
    )


@query("star_skipped", sql(f"SELECT count(*) AS skipped FROM ({FLAT}) WHERE player_name IS NULL", "rosters"))
def _(s, d):
    return tidy(star.normalise_rosters(A.flat_rosters(s, d), A.tournaments(s, d)).skipped)


# ------------------------------------------------------------ matrix and splits

MATRIX = (
    "SELECT f.match_date, f.home_team, f.away_team, f.tournament, f.edition, f.home_score, f.away_score, f.neutral, f.imp AS importance,"
    " hf.form AS home_form, af.form AS away_form, hf.gs AS home_gs, hf.gc AS home_gc, af.gs AS away_gs, af.gc AS away_gc,"
    " CASE WHEN f.home_team < f.away_team THEN p.lo_share ELSE 1 - p.lo_share END AS h2h,"
    " hs.mean_age AS home_mean_age, aws.mean_age AS away_mean_age, hs.squad_size AS home_squad_size, aws.squad_size AS away_squad_size,"
    " hc.club_hhi AS home_club_hhi, ac.club_hhi AS away_club_hhi, hc.same_club_pair_ratio AS home_same_club_pair_ratio,"
    " ac.same_club_pair_ratio AS away_same_club_pair_ratio, hc.largest_club_bloc AS home_largest_club_bloc,"
    " ac.largest_club_bloc AS away_largest_club_bloc, hp.pool_rating - ap.pool_rating AS rating_gap,"
    " hp.pool_rating AS home_pool_rating, ap.pool_rating AS away_pool_rating, b.book_ph, b.book_pd, b.book_pa,"
    " CASE WHEN f.home_score > f.away_score THEN 'H' WHEN f.home_score = f.away_score THEN 'D' ELSE 'A' END AS result"
    f" FROM ({EDITIONS}) f"
    " LEFT JOIN form hf ON hf.team = f.home_team AND hf.day = f.day LEFT JOIN form af ON af.team = f.away_team AND af.day = f.day"
    " LEFT JOIN h2h p ON p.lo = least(f.home_team, f.away_team) AND p.hi = greatest(f.home_team, f.away_team) AND p.day = f.day"
    " LEFT JOIN squad hs ON hs.team = f.home_team AND hs.edition = f.edition LEFT JOIN squad aws ON aws.team = f.away_team AND aws.edition = f.edition"
    " LEFT JOIN chemistry hc ON hc.team = f.home_team AND hc.edition = f.edition"
    " LEFT JOIN chemistry ac ON ac.team = f.away_team AND ac.edition = f.edition"
    " LEFT JOIN pool_rating hp ON hp.team = f.home_team AND hp.match_date = f.match_date"
    " LEFT JOIN pool_rating ap ON ap.team = f.away_team AND ap.match_date = f.match_date"
    " LEFT JOIN book b ON b.match_date = f.match_date AND b.home_team = f.home_team AND b.away_team = f.away_team"
)
MATRIX_VIEWS = ("contests", "form", "h2h", "squad", "chemistry", "pool_rating", "book")
DOUBLES = [
    "importance", "home_form", "away_form", "home_gs", "home_gc", "away_gs", "away_gc", "h2h", "home_mean_age", "away_mean_age",
    "home_club_hhi", "away_club_hhi", "home_same_club_pair_ratio", "away_same_club_pair_ratio", "rating_gap",
    "home_pool_rating", "away_pool_rating", "book_ph", "book_pd", "book_pa",
]
WHOLES = ["home_score", "away_score", "neutral"]
SIZES = ["home_squad_size", "away_squad_size", "home_largest_club_bloc", "away_largest_club_bloc"]


@query(
    "feature_matrix",
    sql(
        "SELECT CAST(match_date AS VARCHAR) AS match_date, home_team, away_team, tournament, edition, result, "
        + ", ".join(f"{r(c)} AS {c}" for c in DOUBLES) + ", " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in WHOLES)
        + ", " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SIZES)
        + f" FROM ({MATRIX})", *MATRIX_VIEWS, **SHORT,
    ),
)
def _(s, d):
    return tidy(A.matrix(s, d).withColumns({c: F.col(c).cast("double") for c in SIZES}))


@query(
    "matrix_health",
    sql(
        "SELECT count(*) AS n_rows, "
        + ", ".join(f"{r(f'''avg(CASE WHEN result = '{c}' THEN 1.0 ELSE 0.0 END)''')} AS share_{c.lower()}" for c in "HDA") + ", "
        + ", ".join(f"count(*) FILTER ({f} IS NULL) AS null_{f}" for f in matrix.FEATURES)
        + f" FROM ({MATRIX})", *MATRIX_VIEWS, **SHORT,
    ),
)
def _(s, d):
    return tidy(matrix.matrix_health(A.matrix(s, d)))


@query(
    "widest_form_gap",
    sql(
        f"SELECT CAST(match_date AS VARCHAR) AS match_date, home_team, away_team, {r('home_form')} AS home_form, {r('away_form')} AS away_form,"
        f" result FROM ({MATRIX}) WHERE home_form - away_form IS NOT NULL ORDER BY round(home_form - away_form, 12) DESC, match_date, home_team DESC,"
        " away_team DESC, result DESC LIMIT 1", *MATRIX_VIEWS, **SHORT,
    ),
)
def _(s, d):
    return tidy(matrix.widest_form_gap(A.matrix(s, d)))


@query(
    "temporal_split",
    sql(
        "SELECT CASE WHEN match_date < DATE '1998-01-01' THEN 'train' WHEN match_date < DATE '2000-01-01' THEN 'valid' ELSE 'test' END AS part,"
        " result, count(*) AS n FROM predictions GROUP BY ALL", "predictions",
    ),
)
def _(s, d):
    split = matrix.temporal_split(A.predictions(s, d), "1998-01-01", "2000-01-01")
    return tidy(split.groupBy("part", "result").agg(F.count(F.lit(1)).alias("n")))


# -------------------------------------------------------------------- metrics

TOP = "CASE WHEN x >= y AND x >= z THEN 'H' WHEN y >= z THEN 'D' ELSE 'A' END"
LOSS = "-ln(greatest(CASE result WHEN 'H' THEN x WHEN 'D' THEN y ELSE z END, 1e-15))"
BRIER = "pow(x - CASE WHEN result = 'H' THEN 1 ELSE 0 END, 2) + pow(y - CASE WHEN result = 'D' THEN 1 ELSE 0 END, 2) + pow(z - CASE WHEN result = 'A' THEN 1 ELSE 0 END, 2)"
SCORES = (
    f"{r(f'avg(CASE WHEN result = {TOP} THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r(f'avg({LOSS})')} AS log_loss, {r(f'avg({BRIER})')} AS brier"
)


def _two_models(s, d, *keep):
    rows = metrics.covered(A.predictions(s, d))
    triples = {
        "model": [F.col(p) for p in ("ph", "pd", "pa")],
        "market": [F.col(p) for p in ("book_ph", "book_pd", "book_pa")],
    }
    return metrics.long_forecasts(rows, triples, ["result", *keep])


@query("metrics_pooled", sql(f"SELECT model, count(*) AS n, {SCORES} FROM model_rows GROUP BY model", "model_rows"))
def _(s, d):
    return tidy(metrics.pooled(_two_models(s, d)))


@query(
    "model_vs_market",
    sql(
        f"SELECT tournament, year(match_date) AS year, model, count(*) AS n, {SCORES} FROM model_rows GROUP BY ALL", "model_rows",
    ),
)
def _(s, d):
    rows = _two_models(s, d, "tournament", "match_date").withColumn("year", F.year("match_date"))
    return tidy(metrics.pooled(rows, ("tournament", "year", "model")))


@query(
    "base_rates",
    sql(
        "SELECT " + ", ".join(f"{r(f'''avg(CASE WHEN result = '{c}' THEN 1.0 ELSE 0.0 END)''')} AS base_{p}" for c, p in zip("HDA", ("ph", "pd", "pa")))
        + " FROM predictions WHERE match_date < DATE '1999-01-01'", "predictions",
    ),
)
def _(s, d):
    return tidy(metrics.base_rates(A.predictions(s, d).filter(F.col("match_date") < "1999-01-01")))


@query(
    "recall_mix",
    sql(
        "SELECT class, " + r("coalesce(count(*) FILTER (result = class AND pick = class) / nullif(count(*) FILTER (result = class), 0), 0)")
        + " AS recall, " + r("count(*) FILTER (pick = class) / count(*)") + " AS picked_share FROM"
        " (SELECT result, CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pd >= pa THEN 'D' ELSE 'A' END AS pick FROM predictions),"
        " (VALUES ('H'), ('D'), ('A')) v(class) GROUP BY class", "predictions",
    ),
)
def _(s, d):
    pick = labels.top_class(F.col("ph"), F.col("pd"), F.col("pa"))
    return tidy(metrics.recall_and_mix(A.predictions(s, d), pick))


BINS = (
    "SELECT bin, count(*) AS n, avg(ph) AS predicted, avg(CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END) AS actual FROM"
    " (SELECT ph, result, len(list_filter(edges, lambda e: ph > e)) AS bin FROM predictions,"
    " (SELECT quantile_cont(ph, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM predictions)) GROUP BY bin"
)


@query(
    "reliability_bins",
    sql(f"SELECT bin, n, {r('predicted')} AS predicted, {r('actual')} AS actual, {r('abs(predicted - actual)')} AS gap FROM ({BINS})", "predictions"),
)
def _(s, d):
    return tidy(metrics.reliability(A.predictions(s, d)))


@query("calibration_error", sql(f"SELECT {r('sum(n * abs(predicted - actual)) / sum(n)')} AS ece FROM ({BINS})", "predictions"))
def _(s, d):
    return tidy(metrics.calibration_error(metrics.reliability(A.predictions(s, d))))


FAVOURITE = "CASE WHEN away_form > home_form THEN 'A' ELSE 'H' END"


@query(
    "upset_report",
    sql(
        f"SELECT count(*) AS n, {r('avg(CASE WHEN up THEN 1.0 ELSE 0.0 END)')} AS upset_share, {r('avg(p) FILTER (up)')} AS p_actual_upset,"
        f" {r('avg(p) FILTER (NOT up)')} AS p_actual_other FROM (SELECT CASE result WHEN 'H' THEN ph WHEN 'D' THEN pd ELSE pa END AS p,"
        f" result <> {FAVOURITE} AS up FROM predictions)", "predictions",
    ),
)
def _(s, d):
    return tidy(metrics.upset_report(A.predictions(s, d), labels.form_favourite(F.col("home_form"), F.col("away_form"))))


EVALUATED = (
    f"SELECT slice, p.*, ph AS x, pd AS y, pa AS z, {FAVOURITE} AS fav FROM predictions p, (VALUES ('all'), ('major')) v(slice)"
    " WHERE slice = 'all' OR tournament = '1-URGENT'"
)
FLAT_LOSS = "-ln(CASE result WHEN 'H' THEN 0.5 WHEN 'D' THEN 0.2 ELSE 0.3 END)"
FLAT_BRIER = BRIER.replace("x -", "0.5 -").replace("y -", "0.2 -").replace("z -", "0.3 -")


@query(
    "evaluate_block",
    sql(
        f"WITH e AS ({EVALUATED}) SELECT slice, 'model' AS predictor, count(*) AS n, {SCORES} FROM e GROUP BY slice"
        f" UNION ALL SELECT slice, 'form_favourite', count(*), {r('avg(CASE WHEN result = fav THEN 1.0 ELSE 0.0 END)')}, NULL, NULL FROM e GROUP BY slice"
        f" UNION ALL SELECT slice, 'always_home', count(*), {r('''avg(CASE WHEN result = 'H' THEN 1.0 ELSE 0.0 END)''')}, NULL, NULL FROM e GROUP BY slice"
        f" UNION ALL SELECT slice, 'base_rate', count(*), NULL, {r(f'avg({FLAT_LOSS})')}, {r(f'avg({FLAT_BRIER})')} FROM e GROUP BY slice",
        "predictions",
    ).replace(") WITH e AS", "), e AS"),
)
def _(s, d):
    rows = A.predictions(s, d)
    favourite = labels.form_favourite(F.col("home_form"), F.col("away_form"))
    return tidy(
        metrics.evaluate(
            rows, favourite, (0.5, 0.2, 0.3), {"all": F.lit(True), "major": F.col("tournament") == "1-URGENT"}
        )
    )


BOOT = 10_000
COUNT = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in bootstrap.poisson_limits())
DRAWS = (
    f"SELECT b, diff, {COUNT} AS c FROM (SELECT b, diff, (z * z + y) % 2147483647 AS u FROM"
    " (SELECT b, diff, y, (y * 48271 + b * 40692 + high) % 2147483647 AS z FROM"
    " (SELECT b, diff, high, (x * x + low + high) % 2147483647 AS y FROM (SELECT b, diff, low, high, (low * 48271 + b * 69621 + 12345) % 2147483647 AS x"
    f" FROM (SELECT diff, row_key % 2147483647 AS low, row_key // 2147483647 % 2147483647 AS high FROM fixture_loss), range(0, {BOOT}) t(b)))))"
)


@query(
    "bootstrap_ci",
    sql(
        "SELECT 'model - market' AS contrast, (SELECT count(*) FROM fixture_loss) AS n,"
        f" {r('(SELECT avg(diff) FROM fixture_loss)')} AS point, {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi,"
        " CASE WHEN quantile_cont(m, 0.025) > 0 THEN 'worse' WHEN quantile_cont(m, 0.975) < 0 THEN 'better' ELSE 'within noise' END AS verdict"
        f" FROM (SELECT b, sum(c * diff) / sum(c) AS m FROM ({DRAWS}) GROUP BY b)", "fixture_loss",
    ),
)
def _(s, d):
    rows = A.fixture_forecasts(s, d)
    losses = rows.select(
        "row_key",
        F.inline(
            F.array(
                F.struct(F.lit("model").alias("model"), F.col("model_loss").alias("loss")),
                F.struct(F.lit("market").alias("model"), F.col("market_loss").alias("loss")),
            )
        ),
    )
    diffs = bootstrap.paired_differences(losses, ["row_key"], [("model", "market")])
    return tidy(bootstrap.mean_interval(diffs, "diff", F.col("row_key"), BOOT, by=["contrast"]))


# ------------------------------------------------------------------ goal model

RHO = -0.05


def _rates(s, d):
    return A.contests(s, d).groupBy("home_team", "away_team", "neutral").agg(
        F.avg("home_score").alias("lambda_home"), F.avg("away_score").alias("lambda_away")
    )


@query(
    "scoreline_grid",
    sql(
        f"SELECT home_team, away_team, neutral, CAST(home_goals AS BIGINT) AS home_goals, CAST(away_goals AS BIGINT) AS away_goals, {r('p')} AS p FROM grid",
        "grid",
    ),
)
def _(s, d):
    return tidy(goals.scoreline_grid(_rates(s, d), RHO).drop("lambda_home", "lambda_away"))


@query(
    "wdl_collapse",
    sql(
        "SELECT home_team, away_team, neutral, " + r("sum(p) FILTER (home_goals > away_goals) / sum(p)") + " AS ph, "
        + r("sum(p) FILTER (home_goals = away_goals) / sum(p)") + " AS pd, " + r("sum(p) FILTER (home_goals < away_goals) / sum(p)")
        + " AS pa FROM grid GROUP BY ALL", "grid",
    ),
)
def _(s, d):
    triple = goals.outcome_probabilities(F.col("lambda_home"), F.col("lambda_away"), F.lit(RHO))
    return tidy(_rates(s, d).select("home_team", "away_team", "neutral", *[c.alias(p) for c, p in zip(triple, ("ph", "pd", "pa"))]))


@query(
    "top_scoreline",
    sql(
        "SELECT home_team, away_team, neutral, CAST(home_goals AS BIGINT) AS home_goals, CAST(away_goals AS BIGINT) AS away_goals FROM grid"
        " QUALIFY row_number() OVER (PARTITION BY home_team, away_team, neutral ORDER BY round(p, 12) DESC, home_goals, away_goals) = 1", "grid",
    ),
)
def _(s, d):
    top = goals.top_scoreline(F.col("lambda_home"), F.col("lambda_away"), F.lit(RHO))
    rows = _rates(s, d).withColumn("_top", top)
    return tidy(rows.select("home_team", "away_team", "neutral", "_top.*"))


def _fit(s, d) -> goals.GoalFit:
    rows = A.contests(s, d).withColumns({"fold": F.lit("all"), "importance": A.importance()})
    weight = weights.training_weight(F.col("match_date"), F.col("importance"), F.lit(AS_OF))
    return goals.fit_strengths(goals.likelihood_cells(rows, weight))


@query("poisson_strengths")
def _(s, d):
    return tidy(_fit(s, d).teams)


@query("poisson_totals")
def _(s, d):
    return tidy(_fit(s, d).totals)


FIT_ROWS = (
    "SELECT 'attack' AS term, home_team AS team, w * home_score AS v FROM weighed UNION ALL SELECT 'attack', away_team, w * away_score FROM weighed"
    " UNION ALL SELECT 'defence', away_team, w * home_score FROM weighed UNION ALL SELECT 'defence', home_team, w * away_score FROM weighed"
    " UNION ALL SELECT 'base', '', w * (home_score + away_score) FROM weighed"
    " UNION ALL SELECT 'home', '', CASE WHEN neutral THEN 0 ELSE w * home_score END FROM weighed"
)


@query(
    "poisson_score_equations",
    sql(
        "SELECT 'all' AS fold, term, team, round(sum(v), 2) + 0.0 AS value FROM (" + FIT_ROWS.replace(
            "weighed", "(SELECT *, greatest(pow(0.5, (DATE '2001-08-02' - match_date) / 3650.0), 0.05) * imp AS w FROM contests)"
        ) + ") GROUP BY term, team", "contests",
    ),
)
def _(s, d):
    rows = A.contests(s, d).withColumns({"fold": F.lit("all"), "importance": A.importance()})
    cells = materialise(goals.likelihood_cells(rows, weights.training_weight(F.col("match_date"), F.col("importance"), F.lit(AS_OF))))
    return tidy(goals.score_equations(cells, goals.fit_strengths(cells, tolerance=1e-9)), 2)


@query("strength_ranking")
def _(s, d):
    fit = _fit(s, d)
    best = goals.rank_teams(fit, "attack").withColumn("list", F.lit("top attack"))
    worst = goals.rank_teams(fit, "defence", 5, descending=False).withColumn("list", F.lit("bottom defence"))
    return tidy(best.unionByName(worst))


@query("predict_fixtures")
def _(s, d):
    fixtures = A.contests(s, d).select("home_team", "away_team", "neutral").distinct().withColumn("fold", F.lit("all"))
    return tidy(goals.predict(fixtures, _fit(s, d)))


@query(
    "rho_profile",
    sql(
        "SELECT CAST(k AS BIGINT) AS k, " + r("-sum(ln(t))") + " AS loss FROM (SELECT k, CASE WHEN home_score = 0 AND away_score = 0 THEN 1 - lambda_home * lambda_away * rho"
        " WHEN home_score = 0 THEN CASE WHEN away_score = 1 THEN 1 + lambda_home * rho ELSE 1 END"
        " WHEN home_score = 1 AND away_score = 0 THEN 1 + lambda_away * rho WHEN home_score = 1 AND away_score = 1 THEN 1 - rho ELSE 1 END AS t"
        " FROM contests JOIN rates USING (home_team, away_team, neutral), (SELECT k, (k - 5) * 0.02 AS rho FROM range(0, 11) g(k))) GROUP BY k",
        "contests", "rates",
    ),
)
def _(s, d):
    rows = A.contests(s, d).withColumn("fold", F.lit("all"))
    cells = goals.likelihood_cells(rows, F.lit(1.0)).join(_rates(s, d), ["home_team", "away_team", "neutral"])
    rho = (F.col("k") - 5) * F.lit(0.02)
    h, a = F.col("lambda_home"), F.col("lambda_away")
    loss = (
        F.col("w00") * F.log(1 - h * a * rho) + F.col("w01") * F.log(1 + h * rho)
        + F.col("w10") * F.log(1 + a * rho) + F.col("w11") * F.log(1 - rho)
    )
    spread = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    return tidy(spread.groupBy("k").agg((-F.sum(loss)).alias("loss")))


# ------------------------------------------------------------------- backtests


def _stored_matrix(s, d):
    return spread_out(A.matrix(s, d), written)


TRIPLE = ["ph", "pd", "pa"]
REFERENCES = [f"{kind}_{p}" for kind in ("book", "base") for p in TRIPLE]


def _summary(scored: DataFrame, by: list[str]) -> DataFrame:
    # The scores are read by several jobs, and a filter on a forecast would work it out again.
    return backtest.fold_scores(written(scored.select(*by, "result", *TRIPLE)), by).orderBy(*by)


QUOTED = (
    "quoted AS (SELECT c.*, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS result, year(match_date) AS y,"
    " book_ph, book_pd, book_pa FROM contests c LEFT JOIN book USING (match_date, home_team, away_team)),"
    " folds AS (SELECT DISTINCT y FROM quoted WHERE book_ph IS NOT NULL),"
    " known AS (SELECT f.y, count(*) FILTER (q.match_date < make_date(f.y, 1, 1) - 365) AS n_train, "
    + ", ".join(f"avg(CASE WHEN result = '{c}' THEN 1.0 WHEN result IS NOT NULL THEN 0.0 END) AS b{i}" for i, c in enumerate("HDA"))
    + " FROM folds f LEFT JOIN quoted q ON q.y < f.y GROUP BY f.y),"
    " asked AS (SELECT CAST(q.y AS VARCHAR) AS fold, q.*, n_train, b0, b1, b2 FROM quoted q JOIN known k ON k.y = q.y WHERE book_ph IS NOT NULL)"
)


@query("walk_forward_scores")
def _(s, d):
    table = _stored_matrix(s, d)
    scored = backtest.walk_forward(table, models.GoalModel(), backtest.edition_folds(table, 1997))
    return tidy(_summary(scored, ["fold"]))


@query("annual_scores")
def _(s, d):
    scored = backtest.annual_walk_forward(_stored_matrix(s, d), models.GoalModel())
    book = backtest.reference_forecasts(scored, "book").withColumn("model", F.lit("market"))
    base = backtest.reference_forecasts(scored, "base").withColumn("model", F.lit("base rate"))
    keep = ["fold", "model", "result", *TRIPLE]
    rows = scored.withColumn("model", F.lit("goals")).select(*keep).unionByName(book.select(*keep)).unionByName(base.select(*keep))
    return tidy(_summary(rows, ["fold", "model"]))


@query(
    "annual_references",
    sql(
        f"SELECT fold, 'market' AS model, count(*) AS n, 0 AS n_unscored, {SCORES} FROM (SELECT *, book_ph AS x, book_pd AS y_, book_pa AS z FROM asked) GROUP BY fold"
        .replace("y_", "y").replace("*, book_ph", "fold, result, book_ph")
        + " UNION ALL SELECT fold, 'base rate', n, n_unscored, accuracy, log_loss, brier FROM"
        " (SELECT fold, count(b0) AS n, count(*) - count(b0) AS n_unscored FROM asked GROUP BY fold) LEFT JOIN"
        f" (SELECT fold, {SCORES} FROM (SELECT fold, result, b0 AS x, b1 AS y, b2 AS z FROM asked WHERE b0 IS NOT NULL) GROUP BY fold) USING (fold)"
        " UNION ALL SELECT fold, 'goals', count(*) FILTER (n_train > 0), count(*) FILTER (n_train = 0), NULL, NULL, NULL FROM asked GROUP BY fold",
        "contests", "book",
    ).replace(") SELECT fold, 'market'", f"), {QUOTED} SELECT fold, 'market'", 1),
)
def _(s, d):
    scored = written(backtest.annual_walk_forward(_stored_matrix(s, d), models.GoalModel()).select("fold", "result", *TRIPLE, *REFERENCES))
    parts = [backtest.reference_forecasts(scored, p).withColumn("model", F.lit(m)) for p, m in (("book", "market"), ("base", "base rate"))]
    keep = ["fold", "model", "result", "ph", "pd", "pa"]
    table = _summary(parts[0].select(*keep).unionByName(parts[1].select(*keep)), ["fold", "model"])
    goals_ = backtest.fold_scores(scored).select("fold", F.lit("goals").alias("model"), "n", "n_unscored")
    return tidy(table.unionByName(goals_, allowMissingColumns=True))


@query("rating_ablation")
def _(s, d):
    table = _numbered_matrix(s, d)
    keep = ["row_no", "result", *TRIPLE]
    plain = written(backtest.annual_walk_forward(table, models.GoalModel()).select(*keep))
    rated = written(backtest.annual_walk_forward(table, models.GoalModel(use_rating=True)).select(*keep))
    both = backtest.compare({"plain": plain, "rated": rated}, ["row_no"])
    interval = backtest.contrasts(both, ["row_no"], [("rated", "plain")], BOOT)
    changed = backtest.changed_rows(plain, rated, ["row_no"]).select("n_changed")
    return tidy(interval.join(F.broadcast(changed)))


def _numbered_matrix(s, d):
    return spread_out(A.matrix(s, d, [*KEY, "tournament", "home_score", "away_score", "neutral"]), written)


@query("model_comparison")
def _(s, d):
    table = _numbered_matrix(s, d)
    keep = ["row_no", "tournament", "result", *TRIPLE]
    scored = {
        "goals": written(backtest.annual_walk_forward(table, models.GoalModel()).select(*keep, *REFERENCES)),
        "classifier": written(backtest.annual_walk_forward(table, models.SoftmaxModel()).select(*keep)),
    }
    scored |= {name: backtest.reference_forecasts(scored["goals"], prefix) for name, prefix in (("market", "book"), ("base rate", "base"))}
    pairs = [("goals", "classifier"), ("goals", "market"), ("classifier", "market"), ("classifier", "base rate")]
    views = {"all": F.lit(True), "finals": F.col("tournament") == "1-URGENT"}
    parts = [
        backtest.comparison({m: df.filter(rows) for m, df in scored.items()}, ["row_no"], pairs, BOOT).withColumn("block", F.lit(block))
        for block, rows in views.items()
    ]
    return tidy(parts[0].unionByName(parts[1]))


@query("feature_ablation")
def _(s, d):
    scored = backtest.ablation(_numbered_matrix(s, d), matrix.FEATURE_SETS)
    scored = {name: written(df.select("row_no", "result", *TRIPLE)) for name, df in scored.items()}
    pairs = [("base+squad", "base"), ("base+rating", "base"), ("full", "base"), ("full", "base+squad")]
    return tidy(backtest.comparison(scored, ["row_no"], pairs, BOOT))


@query("classifier_scores")
def _(s, d):
    table = _stored_matrix(s, d)
    folds = backtest.rolling_folds(1996, 2002, 2)
    scored = backtest.walk_forward(table, models.SoftmaxModel(), folds, by_edition=False)
    return tidy(_summary(scored, ["fold"]))


SOFTMAX_FOLDS = backtest.rolling_folds(1996, 2002, 2)
# Columns of the classifier in order: intercept, features (0 where missing), missing flags.
SOFTMAX_TERMS = {"intercept": "1.0"} | {f: f"coalesce(CAST({f} AS DOUBLE), 0)" for f in matrix.BASE_FEATURES} | {
    f"no {f}": f"CASE WHEN {f} IS NULL THEN 1.0 ELSE 0.0 END" for f in matrix.BASE_FEATURES
}


@query(
    "softmax_score_equations",
    sql(
        "SELECT fold, result AS class, unnest(" + str(list(SOFTMAX_TERMS)) + ") AS term, round(unnest([" + ", ".join(f"sum(w * {x})" for x in SOFTMAX_TERMS.values())
        + "]), 2) + 0.0 AS value FROM (SELECT fold, m.*, greatest(pow(0.5, (start - match_date) / 3650.0), 0.05) * importance AS w FROM (" + MATRIX + ") m, (VALUES "
        + ", ".join(f"('{f.name}', DATE '{f.start}')" for f in SOFTMAX_FOLDS) + ") v(fold, start) WHERE match_date < start - 365 AND result IS NOT NULL) GROUP BY fold, result",
        *MATRIX_VIEWS, **SHORT,
    ),
)
def _(s, d):
    rows = models.softmax_rows(backtest.learning_rows(_stored_matrix(s, d), SOFTMAX_FOLDS), matrix.BASE_FEATURES)
    jobs = {f.name: (f.name, range(2 * len(matrix.BASE_FEATURES))) for f in SOFTMAX_FOLDS}
    sums = softmax.score_equations(rows, softmax.fit_softmax(rows, jobs), jobs)
    names = F.array(*[F.lit(t) for t in SOFTMAX_TERMS])
    return tidy(
        sums.select(F.col("key").alias("fold"), F.substring(F.lit("HDA"), F.col("class_no") + 1, F.lit(1)).alias("class"), names[F.col("column_no")].alias("term"), "value"), 2
    )


@query("boosted_scores")
def _(s, d):
    table = _stored_matrix(s, d)
    folds = backtest.rolling_folds(1998, 2002, 2)
    return tidy(_summary(backtest.walk_forward(table, models.BoostedModel(), folds, by_edition=False), ["fold"]))


@query("trial_search")
def _(s, d):
    return tidy(tuning.search_goal_weighting(A.contests(s, d), A.TIERS, 8, backtest.rolling_folds(1998, 2002, 2)))


# Rolling folds of the search end where the held-out ones begin.
SEARCH_FOLDS, HELD_OUT_FOLDS = backtest.rolling_folds(1996, 2000, 1), backtest.rolling_folds(2000, 2002, 1)


def _weighting_search(s, d) -> tuple[DataFrame, DataFrame]:
    table = _numbered_matrix(s, d)
    return table, materialise(tuning.search_classifier_weighting(table, A.TIERS, 200, SEARCH_FOLDS, matrix.BASE_FEATURES))


@query("weighting_search")
def _(s, d):
    return tidy(_weighting_search(s, d)[1])


@query("weighting_verdict")
def _(s, d):
    table, log = _weighting_search(s, d)
    best = tuning.weighting_proposal(log).first()["trial_id"]
    trial = tuning.candidates(s, 200, hyper=False).filter(F.col("trial_id") == best).first().asDict()
    found = tuning.weighting_verdict(table, A.TIERS, trial, HELD_OUT_FOLDS, lambda: models.SoftmaxModel(list(matrix.BASE_FEATURES)), ["row_no"], BOOT)
    return tidy(found.withColumn("trial_id", F.lit(best)))


@query(
    "trial_ranking",
    sql(
        f"SELECT CAST(trial_id AS BIGINT) AS trial_id, {r('log_loss')} AS log_loss,"
        f" {r('min(log_loss) OVER (ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} AS best_before,"
        " coalesce(log_loss < min(log_loss) OVER (ORDER BY trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best_so_far"
        f" FROM (SELECT t AS trial_id, avg({LOSS}) AS log_loss FROM (SELECT result, k AS t, (ph + k * 0.1) / (1 + k * 0.3) AS x,"
        " (pd + k * 0.1) / (1 + k * 0.3) AS y, (pa + k * 0.1) / (1 + k * 0.3) AS z FROM predictions, range(0, 8) v(k)) GROUP BY t)",
        "predictions",
    ),
)
def _(s, d):
    rows = A.predictions(s, d).withColumn("trial_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    t = F.col("trial_id")
    blended = rows.withColumns({p: (F.col(p) + t * 0.1) / (1 + t * 0.3) for p in ("ph", "pd", "pa")})
    scored = metrics.pooled(blended, ("trial_id",)).select("trial_id", "log_loss")
    return tidy(tuning.trial_log(scored))


# ----------------------------------------------------------------- read queries


@query(
    "read_form",
    sql(
        "SELECT 'NATION_3' AS team, round(sum(g * o) / sum(g), 3) + 0.0 AS rolling_form FROM (SELECT imp * greatest(pow(0.5,"
        " (DATE '2001-08-02' - match_date) / 730.0), 0.05) AS g, CASE WHEN scored > conceded THEN 1.0 WHEN scored = conceded THEN 0.5 ELSE 0.0 END AS o"
        " FROM sides WHERE team = 'NATION_3' AND match_date < DATE '2001-08-02' AND match_date >= DATE '2001-08-02' - 3650)", "sides",
    ),
)
def _(s, d):
    return tidy(reads.rolling_form(A.contests(s, d), A.importance(), "NATION_3", AS_OF))


@query(
    "read_goal_trend",
    sql(
        "SELECT 'NATION_3' AS team, round(sum(g * scored) / sum(g), 3) + 0.0 AS goals_scored, round(sum(g * conceded) / sum(g), 3) + 0.0 AS goals_conceded,"
        " round(sum(g * (scored - conceded)) / sum(g), 3) + 0.0 AS goal_differential FROM (SELECT *, imp * greatest(pow(0.5,"
        " (DATE '2001-08-02' - match_date) / 730.0), 0.05) AS g FROM sides WHERE team = 'NATION_3' AND match_date < DATE '2001-08-02'"
        " AND match_date >= DATE '2001-08-02' - 3650)", "sides",
    ),
)
def _(s, d):
    return tidy(reads.goal_trend(A.contests(s, d), A.importance(), "NATION_3", AS_OF))


@query(
    "read_head_to_head",
    sql(
        "SELECT 'NATION_3' AS team_a, 'NATION_7' AS team_b, round(sum(g * o) / sum(g), 3) + 0.0 AS h2h_win_rate FROM (SELECT imp * greatest(pow(0.5,"
        " (DATE '2001-08-02' - match_date) / 3650.0), 0.05) AS g, CASE WHEN scored > conceded THEN 1.0 WHEN scored = conceded THEN 0.5 ELSE 0.0 END AS o"
        " FROM sides WHERE team = 'NATION_3' AND opponent = 'NATION_7' AND match_date < DATE '2001-08-02') HAVING count(*) > 0", "sides",
    ),
)
def _(s, d):
    return tidy(reads.head_to_head(A.contests(s, d), A.importance(), "NATION_3", "NATION_7", AS_OF))


@query(
    "read_squad",
    sql(
        "SELECT team, edition, round(mean_age, 3) + 0.0 AS mean_age, squad_size, n_gk, n_df, n_mf, n_fw, "
        + ", ".join(f"round(n_{p} / squad_size, 3) + 0.0 AS share_{p}" for p in ("gk", "df", "mf", "fw"))
        + " FROM squad WHERE team = 'NATION_3' AND edition = 'Cup 1998'", "squad",
    ),
)
def _(s, d):
    return tidy(reads.squad_age_depth(A.rosters(s, d), "NATION_3", "Cup 1998"))


@query(
    "read_chemistry",
    sql(
        "SELECT team, edition, squad_size, CAST(largest_club_bloc AS BIGINT) AS largest_club_bloc, CAST(top2_club_bloc AS BIGINT) AS top2_club_bloc,"
        " round(club_hhi, 3) + 0.0 AS club_hhi, CAST(same_club_pairs AS BIGINT) AS same_club_pairs, n_distinct_clubs,"
        " round(same_club_pair_ratio, 3) + 0.0 AS same_club_pair_ratio FROM chemistry WHERE team = 'NATION_3' AND edition = 'Cup 1998'", "chemistry",
    ),
)
def _(s, d):
    return tidy(reads.team_chemistry(A.rosters(s, d), "NATION_3", "Cup 1998"))


@query("read_editions", sql("SELECT DISTINCT edition FROM rosters", "rosters"))
def _(s, d):
    return tidy(reads.list_editions(A.rosters(s, d)))


# ---------------------------------------------------------------------- guards


@query(
    "guard_duplicate_fixtures",
    sql(
        "SELECT CAST(match_date AS VARCHAR) AS match_date, home_team, away_team, count(*) AS n FROM contests GROUP BY ALL HAVING count(*) > 1", "contests",
    ),
)
def _(s, d):
    return tidy(guards.duplicates(A.contests(s, d), KEY))


@query(
    "guard_edition_coverage",
    sql(
        "SELECT coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM"
        " (SELECT DISTINCT CAST(year AS BIGINT) AS v FROM rosters) a FULL JOIN range(1990, 2000) b(v) ON a.v = b.v WHERE a.v IS NULL OR b.v IS NULL",
        "rosters",
    ),
)
def _(s, d):
    return tidy(guards.coverage_gap(A.rosters(s, d), "year", range(1990, 2000)))


@query(
    "guard_unplayed",
    sql("SELECT count(*) AS n_source, count(*) FILTER (NOT unplayed) AS n_stored FROM raw_contests HAVING bool_or(unplayed)", "raw_contests"),
)
def _(s, d):
    raw = A.unclean_contests(s, d)
    return tidy(guards.row_count_gap(raw, raw.filter("home_score IS NOT NULL")))


@query(
    "guard_past_wall",
    sql(
        "SELECT home_team, count(*) AS n, CAST(min(match_date) AS VARCHAR) AS first FROM contests WHERE match_date >= DATE '2000-01-01' GROUP BY home_team",
        "contests",
    ),
)
def _(s, d):
    late = guards.scored_past_wall(A.contests(s, d), "2000-01-01")
    return tidy(late.groupBy("home_team").agg(F.count(F.lit(1)).alias("n"), F.min("match_date").alias("first")))


@query(
    "guard_improper",
    sql("SELECT CAST(day % 13 AS BIGINT) AS slot, count(*) AS n FROM predictions WHERE book_ph IS NULL OR abs(book_ph + book_pd + book_pa - 1) > 1e-9 GROUP BY 1", "predictions"),
)
def _(s, d):
    book = A.predictions(s, d).drop("ph", "pd", "pa").withColumnsRenamed({f"book_{p}": p for p in ("ph", "pd", "pa")})
    return tidy(guards.improper_probabilities(book).groupBy((F.col("day") % 13).cast("bigint").alias("slot")).agg(F.count(F.lit(1)).alias("n")))


@query(
    "guard_pool_dates",
    sql(
        "SELECT d.team, CAST(d.match_date AS VARCHAR) AS match_date, count(*) AS n_late FROM probe_days d"
        " JOIN pool p ON p.team = d.team AND p.version = d.version AND p.first_seen > d.match_date GROUP BY 1, 2",
        "probe_days", "pool",
    ),
)
def _(s, d):
    days = _team_days(s, d).withColumn("version", A.version_of(F.col("match_date")))
    # Players a team first fielded on one day are late together, so a day meets days and not players.
    first_days = _pool(s, d).groupBy("team", "version", "first_seen").agg(F.count(F.lit(1)).alias("n"))
    late = guards.unknown_at_match(days.join(first_days, ["team", "version"]))
    return tidy(late.groupBy("team", "match_date").agg(F.sum("n").alias("n_late")))


@query(
    "guard_aligned",
    sql(
        "SELECT 'left only' AS side, count(*) AS n FROM predictions WHERE book_ph IS NULL HAVING count(*) > 0", "predictions",
    ),
)
def _(s, d):
    rows = A.predictions(s, d)
    gaps = guards.misaligned(rows, metrics.covered(rows), ["day", "home_team", "away_team"])
    return tidy(gaps.groupBy("side").agg(F.count(F.lit(1)).alias("n")))
