import random

from newsloom.functions.udfs import partial_ratio_of, ratio_of
from newsloom.operators import resolution


def test_acronyms_one_letter_off(spark):
    r = random.Random(5)
    several = [" ".join(r.choice("abcd") + "x" for _ in range(r.randint(2, 9))) for _ in range(60)] + ["big blue sea green deep"]
    single = ["".join(r.choice("ABCD") for _ in range(r.randint(1, 10))) for _ in range(80)] + ["BBSGX"]
    got = {x.acronym: x["name"] for x in resolution.acronyms(spark.createDataFrame([(n,) for n in several + single], "name string")).collect()}
    want = {}
    for a in single:
        like = [n for n in several if ratio_of("".join(w[0] for w in n.split()).upper(), a) >= 0.8]
        if like:
            want[a] = min(like)
    assert got == want and got["BBSGX"] == "big blue sea green deep" and len(got) > 20


def test_best_match_loses_none(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(0, 9)))
    names = ["The European Commission", *{word() for _ in range(60)}]
    canonical = ["European Commission", *{word() for _ in range(60)}]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = {x["name"]: (x.canonical, x.score) for x in resolution.best_match(df(names), df(canonical)).collect()}
    want = {}
    for a in names:
        best = min((-partial_ratio_of(a, b), b) for b in canonical)
        if -best[0] >= 0.8:
            want[a] = (best[1], round(-best[0], 6))
    assert got == want and got["The European Commission"][0] == "European Commission"


def test_fuzzy_names_from_80_percent(spark, tmp_path):
    from newsloom import catalog

    spark.createDataFrame([("b", "alpha grid"), ("b", "alpha gxxd")], "p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    assert {x.canonical for x in catalog.QUERIES["fuzzy_names"](spark, str(tmp_path)).collect()} == {"alpha grid"}
