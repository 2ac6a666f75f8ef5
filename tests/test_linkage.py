import itertools
import random

import pytest

from fixtura.operators import linkage

NAMES = [
    "anna maria lopez", "ana maria lopez", "maria lopez", "lopez maria anna", "jon smith", "john smith", "jonathan smithe",
    "smith", "k o", "ko", "aaaaaaaa", "aaaaaaab", "thomas muller", "thomas mueller", "de la cruz juan", "juan cruz", "",
    "one two three four five six seven eight nine ten", "one two three four five six seven eight nine", "x y z",
]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if c == d else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def ratio(a, b):
    return 2 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def similarity(a, b):
    """Token-set ratio written out from its three string comparisons."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (s & t, s - t, t - s))
    if both and (not left or not right):
        return 1.0
    full = [" ".join(x for x in (both, y) if x) for y in (left, right)]
    gap = len(both) + 1 if both else 0
    best = 2 * (gap + subsequence(left, right)) / (len(full[0]) + len(full[1]))
    return max(best, ratio(both, full[0]), ratio(both, full[1])) if both else best


def brute(targets, candidates):
    out = {}
    for tid, block, name, dob in targets:
        best = None
        for no, cblock, short, long_, cdob in candidates:
            if cblock != block:
                continue
            score = max(similarity(name, short), similarity(name, long_))
            key = (dob is not None and dob == cdob, score)
            if best is None or key > best[0]:
                best = (key, no)
        if best is None:
            continue
        (match, score), no = best
        tier = "high" if match and score >= 0.9 else "medium" if (match and score >= 0.55) or (not match and score >= 0.9) else None
        if tier:
            out[tid] = (no, round(score, 9), match, tier)
    return out


@pytest.mark.parametrize("seed, parts", [(1, 2_000), (2, 3)])
def test_best_candidates_match_brute_force(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(linkage, "PART_NAMES", parts)
    rnd = random.Random(seed)

    def noisy(name):
        letters = list(name)
        if letters and rnd.random() < 0.4:
            letters.insert(rnd.randrange(len(letters) + 1), rnd.choice("abco"))
        return " ".join("".join(letters).split())

    dates = [1, 2, 3, None]
    targets = [(i, rnd.choice("PQ"), noisy(rnd.choice(NAMES)), rnd.choice(dates)) for i in range(120)]
    candidates = [
        (i, rnd.choice("PQ"), noisy(rnd.choice(NAMES)), noisy(rnd.choice(NAMES)), rnd.choice([1, 2, 4])) for i in range(60)
    ]
    # Some targets share no date with any candidate, so the name-only path is used.
    targets += [(500 + i, "P", noisy(n), 9) for i, n in enumerate(NAMES)]
    t = spark.createDataFrame(targets, "target_id long, block string, player_name string, dob int")
    c = spark.createDataFrame(candidates, "candidate_no long, block string, short_name string, long_name string, dob int")
    got = {
        r["target_id"]: (r["candidate_no"], round(r["name_score"], 9), r["dob_match"], r["tier"])
        for r in linkage.best_candidates(t, c, ["block"]).collect()
    }
    assert got == brute(targets, candidates)


def test_letter_pairs_cover_every_close_pair(spark):
    words = ["".join(w) for n in (9, 10) for w in itertools.islice(itertools.product("ab", repeat=n), 0, 1024, 37)]
    a = spark.createDataFrame([("P", w) for w in words], "block string, name string")
    b = spark.createDataFrame([("P", w, i) for i, w in enumerate(words)], "block string, name string, first long")
    got = {(r["name"], r["other"]) for r in linkage._near_pairs(a, b, ["block"]).collect()}
    assert {(x, y) for x in words for y in words if ratio(x, y) >= 0.9} <= got


def test_links_are_written_and_counted(spark):
    players = spark.createDataFrame(
        [(1, None, None, None), (2, 77, 0.5, "high")],
        "player_appearance_id long, sofifa_player_id long, rating_match_score double, rating_match_tier string",
    )
    links = spark.createDataFrame(
        [(1, 10, 1.0, True, "high"), (2, 11, 0.6, True, "medium")],
        "target_id long, candidate_no long, name_score double, dob_match boolean, tier string",
    )
    candidates = spark.createDataFrame([(10, 900), (11, 901)], "candidate_no long, candidate_id long")
    got = {r[0]: tuple(r)[1:] for r in linkage.apply_links(players, links, candidates).collect()}
    assert got == {1: (900, 1.0, "high"), 2: (77, 0.5, "high")}
    targets = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "target_id long, edition string")
    report = {r["edition"]: (r["total"], r["high"], r["review"], r["unlinked"]) for r in linkage.coverage(targets, links, "edition").collect()}
    assert report == {"x": (2, 1, 1, 0), "y": (1, 0, 0, 1), None: (3, 1, 1, 1)}


def test_both_sides_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    targets = spark.createDataFrame([(1, "x", "Ann Lee", 5), (2, "x", "Bo Ek", 6), (3, "x", None, 6)], "target_id long, block string, player_name string, dob int")
    candidates = spark.createDataFrame(
        [(1, "x", "A. Lee", "Lee, Ann", 5), (2, "x", "B. Ek", "Ek, Bo", 7), (2, "x", "B. Ek", "Ek, Bo", 7)],
        "candidate_no long, block string, short_name string, long_name string, dob int",
    )
    watched = [df.coalesce(1).mapInPandas(count, df.schema) for df in (targets, candidates)]
    links = {r.target_id: (r.candidate_no, r.name_score, r.dob_match) for r in linkage.best_candidates(*watched, ["block"]).collect()}
    assert links == {1: (1, 1.0, True), 2: (2, 1.0, False)}
    assert seen.value == 6
