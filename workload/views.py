"""SQL text of the adapter views, composed into each check."""

IMPORTANCE = """CASE tournament WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.6 WHEN '3-MEDIUM' THEN 0.45
 WHEN '4-NOT SPECIFIED' THEN 0.3 WHEN '5-LOW' THEN 0.2 ELSE 0.25 END::DOUBLE"""

VIEWS = {
    "raw_contests": """
SELECT CAST(o.o_orderdate AS DATE) AS match_date,
 CAST(date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS INT) AS day,
 hn.n_name AS home_team, an.n_name AS away_team,
 CAST(l.l_quantity AS INT) % 5 AS home_score,
 (CAST(floor(l.l_discount * 100 + 0.5) AS INT) + l.l_linenumber) % 4 AS away_score,
 o.o_orderpriority AS tournament, l.l_returnflag = 'N' AS neutral,
 (l.l_linestatus = 'O' AND l.l_linenumber = 7) AS unplayed
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation hn ON c.c_nationkey = hn.n_nationkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation an ON s.s_nationkey = an.n_nationkey
WHERE hn.n_name <> an.n_name""",
    "contests": f"SELECT *, {IMPORTANCE} AS imp FROM raw_contests",
    "sides": """
SELECT home_team AS team, away_team AS opponent, day, home_score AS scored, away_score AS conceded, imp, match_date FROM contests
UNION ALL SELECT away_team, home_team, day, away_score, home_score, imp, match_date FROM contests""",
    "team_day": """
SELECT team, day, count(*) AS n, sum(imp) AS w,
 sum(imp * CASE WHEN scored > conceded THEN 1.0 WHEN scored = conceded THEN 0.5 ELSE 0.0 END) AS wo,
 sum(imp * scored) AS ws, sum(imp * conceded) AS wc
FROM sides GROUP BY team, day""",
    "pair_day": """
SELECT least(home_team, away_team) AS lo, greatest(home_team, away_team) AS hi, day, sum(imp) AS w,
 sum(imp * CASE WHEN home_score = away_score THEN 0.5
  WHEN (home_score > away_score) = (home_team < away_team) THEN 1.0 ELSE 0.0 END) AS wo
FROM contests GROUP BY 1, 2, 3""",
    "renames": """
SELECT n_name AS former, r.row_no, r.prefix || n_name AS current, r.s AS start_date, r.e AS end_date
FROM nation, (VALUES (1, 'NEW_', DATE '1996-01-01', DATE '1998-12-31'),
 (2, 'ALT_', DATE '1998-06-01', DATE '1999-12-31')) r(row_no, prefix, s, e)""",
    "rosters": """
SELECT n.n_name AS team, year(l.l_shipdate) AS year, 'Cup ' || year(l.l_shipdate) AS edition, p.p_partkey AS player_id,
 CASE WHEN p.p_partkey % 40 <> 0 THEN p.p_brand END AS club,
 (['GK','DF','MF','FW'])[p.p_partkey % 4 + 1] AS position, 17 + p.p_size % 22 AS age,
 p.p_name, p.p_size, min(CAST(l.l_shipdate AS DATE)) AS seen
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey GROUP BY ALL""",
    "ratings": """
SELECT p_partkey AS player_id, v AS version, 50 + (p_partkey * 7 + v * 3) % 45 AS overall,
 50 + (p_partkey * 7 + v * 3) % 45 + p_size % 6 AS potential FROM part, range(0, 7) t(v)""",
    "price_texts": """
SELECT CAST(day AS BIGINT) * 10000 + CAST(substr(home_team, 8) AS INT) * 100 + CAST(substr(away_team, 8) AS INT) AS quote_no,
 DATE '1970-01-01' + (day + day % 3 - 1) AS match_date, day,
 CASE a WHEN 'NATION_1' THEN 'Nation One' WHEN 'NATION_2' THEN 'Unknown' ELSE a END AS home_raw,
 CASE b WHEN 'NATION_1' THEN 'Nation One' WHEN 'NATION_2' THEN 'Unknown' ELSE b END AS away_raw,
 (['1.80','+140','-175','260','-'])[day % 5 + 1] AS text_home,
 (['3.40','+230','310','3.10','-'])[day % 5 + 1] AS text_draw,
 (['4.20','-110','+1,150','2.05','-'])[day % 5 + 1] AS text_away
FROM (SELECT DISTINCT day, home_team, away_team,
 CASE WHEN day % 2 = 0 THEN away_team ELSE home_team END AS a,
 CASE WHEN day % 2 = 0 THEN home_team ELSE away_team END AS b FROM contests)""",
    "quotes": """
SELECT *, ([1.8, 1 + 140 / 100.0, 1 + 100 / 175.0, 3.6, NULL]::DOUBLE[])[day % 5 + 1] AS odds_home,
 ([3.4, 3.3, 4.1, 3.1, NULL]::DOUBLE[])[day % 5 + 1] AS odds_draw,
 ([4.2, 1 + 100 / 110.0, 12.5, 2.05, NULL]::DOUBLE[])[day % 5 + 1] AS odds_away FROM price_texts""",
    "named_quotes": """
SELECT *, (1 / odds_home) / inv AS ph, (1 / odds_draw) / inv AS pd, (1 / odds_away) / inv AS pa,
 CASE home_raw WHEN 'Nation One' THEN 'NATION_1' WHEN 'Unknown' THEN NULL ELSE home_raw END AS home,
 CASE away_raw WHEN 'Nation One' THEN 'NATION_1' WHEN 'Unknown' THEN NULL ELSE away_raw END AS away
FROM (SELECT *, 1 / odds_home + 1 / odds_draw + 1 / odds_away AS inv FROM quotes WHERE odds_home IS NOT NULL)""",
    "fixtures": "SELECT DISTINCT day, match_date, home_team, away_team FROM contests",
    "matched": """
SELECT q.quote_no, q.ph, q.pd, q.pa, q.home, f.match_date, f.home_team, f.away_team,
 row_number() OVER (PARTITION BY q.quote_no ORDER BY abs(f.match_date - q.match_date), f.day, f.home_team) AS rn
FROM named_quotes q JOIN fixtures f ON f.home_team IN (q.home, q.away) AND f.away_team IN (q.home, q.away)
 AND least(f.home_team, f.away_team) = least(q.home, q.away)
 AND greatest(f.home_team, f.away_team) = greatest(q.home, q.away)
 AND f.match_date BETWEEN q.match_date - 3 AND q.match_date + 3
WHERE q.home IS NOT NULL AND q.away IS NOT NULL""",
    "book": """
SELECT match_date, home_team, away_team, quote_no,
 CASE WHEN home_team = home THEN ph ELSE pa END AS book_ph, pd AS book_pd,
 CASE WHEN home_team = home THEN pa ELSE ph END AS book_pa
FROM matched WHERE rn = 1
QUALIFY row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY quote_no) = 1""",
    "predictions": """
SELECT *, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS result,
 (1 + s) / t AS ph, 1 / t AS pd, (1 + u) / t AS pa,
 CASE WHEN day % 13 <> 0 THEN (1 + u) / t END AS book_ph, CASE WHEN day % 13 <> 0 THEN 1 / t END AS book_pd,
 CASE WHEN day % 13 <> 0 THEN (1 + s) / t END AS book_pa,
 CASE WHEN day % 11 <> 0 THEN s / 6.0 END AS home_form, u / 4.0 AS away_form
FROM (SELECT *, day % 7 AS s, day % 5 AS u, CAST(3 + day % 7 + day % 5 AS DOUBLE) AS t FROM contests)""",
    "model_rows": """
SELECT p.*, 'model' AS model, ph AS x, pd AS y, pa AS z FROM predictions p WHERE book_ph IS NOT NULL
UNION ALL SELECT p.*, 'market', book_ph, book_pd, book_pa FROM predictions p WHERE book_ph IS NOT NULL""",
    "squad": """
SELECT team, edition, avg(age) AS mean_age, count(*) AS squad_size,
 count(*) FILTER (position = 'GK') AS n_gk, count(*) FILTER (position = 'DF') AS n_df,
 count(*) FILTER (position = 'MF') AS n_mf, count(*) FILTER (position = 'FW') AS n_fw
FROM rosters GROUP BY team, edition""",
    "clubs": """
SELECT team, edition, club, count(*) AS c,
 row_number() OVER (PARTITION BY team, edition ORDER BY count(*) DESC, club) AS place
FROM rosters WHERE club IS NOT NULL GROUP BY team, edition, club""",
    "chemistry": """
SELECT s.team, s.edition, max(s.squad_size) AS squad_size, coalesce(max(c), 0) AS largest_club_bloc,
 coalesce(sum(c) FILTER (place <= 2), 0) AS top2_club_bloc,
 sum(c * c) / CAST(max(squad_size) * max(squad_size) AS DOUBLE) AS club_hhi,
 coalesce(sum(c * (c - 1) // 2), 0) AS same_club_pairs, count(c) AS n_distinct_clubs,
 coalesce(sum(c * (c - 1) // 2), 0) / nullif(max(squad_size) * (max(squad_size) - 1) / 2.0, 0) AS same_club_pair_ratio
FROM squad s LEFT JOIN clubs USING (team, edition) GROUP BY s.team, s.edition""",
    "pool": """
SELECT f.team, f.first_seen, r.version, r.overall
FROM (SELECT team, player_id, min(seen) AS first_seen FROM rosters GROUP BY 1, 2) f JOIN ratings r USING (player_id)""",
    "probe_days": """
SELECT DISTINCT team, match_date, day,
 CASE WHEN v >= 0 THEN least(v, 6) END AS version
FROM (SELECT *, year(match_date) - 1995 + CASE WHEN month(match_date) >= 9 THEN 1 ELSE 0 END AS v FROM sides)""",
    "pool_rating": """
SELECT p.team, p.match_date, p.day, count(o.overall) AS n_rated,
 CASE WHEN count(o.overall) >= 11 THEN avg(o.overall) END AS pool_rating
FROM probe_days p LEFT JOIN pool o ON o.team = p.team AND o.version = p.version AND o.first_seen <= p.match_date
WHERE p.version IS NOT NULL GROUP BY 1, 2, 3""",
    "form": """
SELECT a.team, a.day, sum(b.wo * g) / sum(b.w * g) AS form, sum(b.ws * g) / sum(b.w * g) AS gs,
 sum(b.wc * g) / sum(b.w * g) AS gc
FROM (SELECT a.team, a.day, b.w, b.wo, b.ws, b.wc, greatest(pow(0.5, (a.day - b.day) / {hl}), 0.05) AS g
 FROM team_day a JOIN team_day b ON a.team = b.team AND b.day < a.day AND b.day >= a.day - {win}) b
RIGHT JOIN team_day a USING (team, day) GROUP BY 1, 2""",
    "h2h": """
SELECT a.lo, a.hi, a.day, sum(b.wo * g) / sum(b.w * g) AS lo_share
FROM pair_day a LEFT JOIN (SELECT a.lo, a.hi, a.day, b.w, b.wo, greatest(pow(0.5, (a.day - b.day) / {hl}), 0.05) AS g
 FROM pair_day a JOIN pair_day b ON a.lo = b.lo AND a.hi = b.hi AND b.day < a.day) b USING (lo, hi, day)
GROUP BY 1, 2, 3""",
    "value_points": """
SELECT user_id, event_id, CAST(ts AS DATE) AS value_date, value FROM events""",
    "rates": """
SELECT home_team, away_team, neutral, avg(home_score) AS lambda_home, avg(away_score) AS lambda_away
FROM contests GROUP BY 1, 2, 3""",
    "goal_counts": """
SELECT g AS k, CASE WHEN g = 0 THEN 1.0 ELSE (SELECT product(x) FROM range(1, g + 1) r(x)) END AS fact
FROM range(0, 11) t(g)""",
    "grid": """
SELECT r.home_team, r.away_team, r.neutral, i.k AS home_goals, j.k AS away_goals, r.lambda_home, r.lambda_away,
 exp(-lambda_home) * pow(lambda_home, i.k) / i.fact * exp(-lambda_away) * pow(lambda_away, j.k) / j.fact
 * CASE WHEN i.k = 0 AND j.k = 0 THEN 1 - lambda_home * lambda_away * -0.05
  WHEN i.k = 0 AND j.k = 1 THEN 1 + lambda_home * -0.05 WHEN i.k = 1 AND j.k = 0 THEN 1 + lambda_away * -0.05
  WHEN i.k = 1 AND j.k = 1 THEN 1 - -0.05 ELSE 1 END AS p
FROM rates r, goal_counts i, goal_counts j""",
    "fixture_loss": """
SELECT day, home_team, away_team, avg(loss) FILTER (model = 'model') - avg(loss) FILTER (model = 'market') AS diff,
 CAST(day AS BIGINT) * 10000 + CAST(substr(home_team, 8) AS INT) * 100 + CAST(substr(away_team, 8) AS INT) AS row_key
FROM (SELECT *, -ln(greatest(CASE result WHEN 'H' THEN x WHEN 'D' THEN y ELSE z END, 1e-15)) AS loss FROM model_rows)
GROUP BY day, home_team, away_team""",
    "parts_linked": """
SELECT p_partkey, p_type, p_size, p_name, p_brand, string_split(lower(p_name), ' ') AS toks FROM part""",
}

NEEDS = {
    "contests": ["raw_contests"], "sides": ["contests"], "team_day": ["sides"], "pair_day": ["contests"],
    "price_texts": ["contests"], "quotes": ["price_texts"], "named_quotes": ["quotes"], "fixtures": ["contests"],
    "matched": ["named_quotes", "fixtures"], "book": ["matched"], "predictions": ["contests"],
    "model_rows": ["predictions"], "squad": ["rosters"], "clubs": ["rosters"], "chemistry": ["squad", "clubs"],
    "pool": ["rosters", "ratings"], "probe_days": ["sides"], "pool_rating": ["probe_days", "pool"],
    "form": ["team_day"], "h2h": ["pair_day"], "rates": ["contests"], "grid": ["rates", "goal_counts"],
    "fixture_loss": ["model_rows"],
}


def sql(select: str, *views: str, **values: float) -> str:
    """``select`` with the views it names, and theirs, as common table expressions."""
    order: list[str] = []

    def add(view: str) -> None:
        for needed in NEEDS.get(view, []):
            add(needed)
        if view not in order:
            order.append(view)

    for view in views:
        add(view)
    ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v].format(**values) if '{' in VIEWS[v] else VIEWS[v]})" for v in order)
    return (f"WITH {ctes} " if ctes else "") + select
