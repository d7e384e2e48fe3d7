"""Years asked for, against texts whose meaning is known: figures of other things must not count."""

from hirelake.operators import annotate as ann

#: Text, and the floor and ceiling that it asks for.
TEXTS = [
    ("You bring 3-5 years of relevant experience.", 3, 5),
    ("At least five (5) years of experience with Go.", 5, None),
    ("10 years of experience, or 6+ yrs experience with a degree.", 6, None),
    ("Experience of 4 years in sales.", 4, None),
    ("Experience: 2 to 4 years", 2, 4),
    ("3 years to 5 years of work experience", 3, 5),
    ("two or more years of hands-on experience", 2, None),
    ("7+ years’ experience in Java", 7, None),
    ("A minimum of 8 years building distributed systems.", 8, None),
    ("Minimum 2 years required.", 2, None),
    ("You have 6 years in a similar role.", 6, None),
    ("4 years working with databases.", 4, None),
    ("Up to 2 years experience.", 0, 2),
    ("Less than 3 years of experience.", 0, 3),
    ("A minimum of 6 years, up to 10 years of experience.", 6, None),
    # one requirement among figures of other things
    ("Founded 12 years ago. Requires 5+ years of experience building software.", 5, None),
    ("We have over 25 years of experience in retail. You need 2 years of experience.", 2, None),
    ("A 4-year degree and 3 years of experience.", 3, None),
    ("2 year fixed term contract. 6 years of experience needed.", 6, None),
    ("Age range: 28-35 years. 5-8 years' experience.", 5, 8),
    ("10 years (Master's degree with 6 years) related experience.", 6, None),
    ("You must be 18 years old and have 1 year of experience.", 1, None),
    # nothing asked
    ("Founded 12 years ago. Great team.", None, None),
    ("Celebrating 50 years of excellence.", None, None),
    ("You must be at least 21 years of age.", None, None),
    ("A contract of 2 years.", None, None),
    ("A 3-year apprenticeship awaits you.", None, None),
    ("Shares vest over 4 years.", None, None),
    ("You have lived in the country for 5 years.", None, None),
    ("In the last 10 years we grew tenfold.", None, None),
    ("5 years in lieu of a degree.", None, None),
    ("A salary review every 2 years.", None, None),
    ("Ideally 5 years leading teams.", None, None),
    ("160,000 years of experience in total.", None, None),
    ("45 years of experience.", None, None),
    ("", None, None), (None, None, None), ("No figures here.", None, None),
]


def drawn():
    """One requirement among noise, in all combinations."""
    asked = [("{} years of experience", None), ("at least {}+ years of professional experience", None), ("experience of {} years", None), ("a minimum of {} yrs in a related role with experience", None)]
    noise = ["Founded 30 years ago.", "You must be 18 years old.", "This is a 2 year contract.", "Our 10 years of growth speak.", "A 4-year degree helps.", "Shares vest over 3 years."]
    out = []
    for i, (a, _) in enumerate(asked):
        for j, n in enumerate(noise):
            for years in (1, 5, 12):
                said = a.format(years)
                out.append((f"{n} We ask for {said}. {noise[(j + i + 1) % 6]}", years, None))
    return out


def read(spark, texts):
    df = spark.createDataFrame([(i, None, t, "Clerk", None) for i, t in enumerate(texts)], "id int, experience string, description string, title string, company string")
    return {r["id"]: (r["min_years"], r["max_years"]) for r in ann.annotate_experience(df).collect()}


def test_texts(spark):
    cases = TEXTS + drawn()
    got = read(spark, [t for t, *_ in cases])
    wrong = [(t, (lo, hi), got[i]) for i, (t, lo, hi) in enumerate(cases) if got[i] != (lo, hi)]
    assert not wrong, wrong


def test_floors_of_the_firmest_kind(spark):
    df = spark.createDataFrame([(1, "5 years of experience, or 3 years of experience. Minimum 1 year required."), (2, "Minimum 4 years required."), (3, "Up to 4 years of experience.")], "id int, description string")
    df = df.selectExpr("*", "'Clerk' AS title", "CAST(NULL AS STRING) AS experience")
    assert {r["id"]: list(r["stated_floors"]) for r in ann.annotate_experience(df).collect()} == {1: [3, 5], 2: [4], 3: []}


def test_long_texts_and_one_pass(spark):
    df = spark.createDataFrame([(1, "We grow 3 years at a time and like words. " * 3000 + "You need 4 years of experience.", "Clerk", None)], "id int, description string, title string, experience string")
    out = ann.annotate_experience(df)
    assert out.first()["min_years"] == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and len(plan) < 100_000
