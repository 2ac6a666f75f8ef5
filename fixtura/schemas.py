"""Table schemas; readers never infer."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_int, _text, _double, _date, _bool = (
    T.IntegerType(), T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType(),
)

CONTESTS = _struct(
    match_date=_date, home_team=_text, away_team=_text, home_score=_int, away_score=_int,
    tournament=_text, city=_text, country=_text, neutral=_bool,
)
FORMER_NAMES = _struct(current=_text, former=_text, start_date=_date, end_date=_date)
TOURNAMENTS = _struct(tournament_id=_int, name=_text, year=_int, competition=_text, wiki_page=_text)
SQUADS = _struct(squad_id=_int, tournament_id=_int, country=_text)
PLAYERS = _struct(
    player_appearance_id=_int, squad_id=_int, squad_number=_int, position=_text, player_name=_text,
    is_captain=_bool, date_of_birth=_date, age_at_tournament=_int, caps=_int, goals=_int, club=_text,
    transfermarkt_player_id=_text, sofifa_player_id=_int, rating_match_score=_double, rating_match_tier=_text,
)
# The source file holds 109 columns; these are the ones read.
RATINGS_SOURCE = _struct(
    player_id=_int, fifa_version=_int, update_as_of=_text, short_name=_text, long_name=_text,
    player_positions=_text, overall=_int, potential=_int, value_eur=_double, wage_eur=_double,
    age=_int, dob=_text, height_cm=_int, weight_kg=_int, club_name=_text, league_name=_text,
    league_level=_int, nationality_name=_text,
)
MATCH_ODDS = _struct(
    odds_id=_int, match_date=_date, home_team_raw=_text, away_team_raw=_text, odds_home=_double,
    odds_draw=_double, odds_away=_double, competition=_text, stage=_text, home_score=_double,
    away_score=_double, source=_text,
)
VALUE_HISTORY = T.StructType(
    [T.StructField("list", T.ArrayType(_struct(datum_mw=_text, y=_double)), True)]
)
PROPOSAL = T.StructType(
    [
        T.StructField(
            "config",
            T.StructType(
                [
                    T.StructField("tiers", T.MapType(_text, _double)),
                    T.StructField("half_life_days", _double),
                    T.StructField("min_weight", _double),
                    T.StructField("hyper", T.MapType(_text, _double)),
                ]
            ),
        ),
        T.StructField("validation", _struct(log_loss=_double, acc=_double, n=T.LongType())),
        T.StructField("baseline_validation", _struct(log_loss=_double, acc=_double, n=T.LongType())),
        T.StructField("search", _struct(seed=T.LongType(), k=T.LongType(), is_baseline=_bool)),
        T.StructField("held_out", _struct(point=_double, lo=_double, hi=_double, verdict=_text)),
    ]
)
