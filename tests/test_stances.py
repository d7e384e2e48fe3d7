"""Statements on sponsorship and relocation, in varied wordings of our own."""

import pytest

from hirelake.operators.stances import annotate_stances

NO, YES, MAY, MOVE = "refuses_sponsorship", "offers_sponsorship", "may_offer_sponsorship", "offers_relocation"

#: Statement and stances for a plain full-time engineer's job.
PLAIN = [
    ("We offer visa sponsorship.", [YES]),
    ("Visa sponsorship is available for this role.", [YES]),
    ("We are happy to sponsor work visas for the right person.", [YES]),
    ("The company will sponsor H-1B visas.", [YES]),
    ("Visa sponsorship: Yes", [YES]),
    ("Is visa sponsorship available? Yes", [YES]),
    ("We provide immigration support and visa sponsorship to all new hires.", [YES]),
    ("We sponsor international candidates.", [YES]),
    ("Green card sponsorship is offered after a year.", [YES]),
    ("We do not offer visa sponsorship.", [NO]),
    ("Unfortunately we are unable to sponsor visas at this time.", [NO]),
    ("Visa sponsorship: No", [NO]),
    ("Is visa sponsorship available? No", [NO]),
    ("Sponsorship is not available for this position.", [NO]),
    ("We can’t sponsor work permits.", [NO]),
    ("This position is not eligible for visa sponsorship.", [NO]),
    ("Applicants must be authorized to work in the U.S. without sponsorship.", [NO]),
    ("You must already be authorized to work in Germany.", [NO]),
    ("Candidates must currently hold a valid work permit.", [NO]),
    ("U.S. citizenship is required.", [NO]),
    ("Applicants must be U.S. citizens.", [NO]),
    ("Visa sponsorship is considered on a case-by-case basis.", [MAY]),
    ("We may offer visa sponsorship.", [MAY]),
    ("We offer visa sponsorship; however, it is not available for every role, depending on the visa.", [MAY]),
    ("Visa sponsorship is possible for this role; we support applicants with it.", [MAY]),
    ("We offer H-1B transfer sponsorship.", [MAY]),
    ("We offer sponsorship for new H-1B visas and transfers.", [YES]),
    # not about visas, or not a statement
    ("You will report to the executive sponsor of the project.", []),
    ("Work with sponsors of clinical trials and offer support.", []),
    ("We will sponsor your security clearance.", []),
    ("We sponsor football events and offer free lunch.", []),
    ("We hire without regard to race, religion, national origin or citizenship.", []),
    ("All applicants are considered regardless of gender, age, origin or citizenship.", []),
    ("Some positions require U.S. citizenship.", []),
    ("Citizenship is not required.", []),
    ("Available for work visa sponsorship?", []),
    ("The visa team builds tools.", []),
    # moving
    ("Relocation assistance is provided.", [MOVE]),
    ("We offer a generous relocation package.", [MOVE]),
    ("Relocation: Yes", [MOVE]),
    ("Relocation bonus and stipend.", [MOVE]),
    ("You must be willing to relocate to Berlin.", []),
    ("Are you ready to relocate?", []),
    ("No relocation assistance is available.", []),
    ("Relocation assistance is not provided.", []),
    ("Relocation: No", []),
    ("Lead the relocation of the data center.", []),
    ("Relocation support is at your own expense.", []),
    # several sentences
    ("We do not offer sponsorship. Relocation assistance is provided.", [MOVE, NO]),
    ("We offer visa sponsorship. Relocation support is available.", [MOVE, YES]),
    ("We offer visa sponsorship. We do not sponsor visas for interns.", [NO]),
    ("We sponsor visas. Visa sponsorship depends on the role and is decided case by case.", [MAY]),
    ("Relocation support is available. We do not offer relocation support abroad.", []),
    ("We are not a big company, but we offer visa sponsorship.", [YES]),
    ("We don't do dress codes; visa sponsorship is available.", [YES]),
    ("", []), (None, []), ("Nothing to see here.", []),
]

#: Statement, title, employment type, countries, stances and reasons.
SCOPED = [
    ("We offer visa sponsorship to full-time employees.", "Engineer", "Full time", None, [YES], []),
    ("We offer visa sponsorship to full-time employees.", "Engineer", "Part-time", None, [], []),
    ("We offer visa sponsorship to full-time employees only.", "Engineer", "Part-time", None, [NO], []),
    ("We offer visa sponsorship for senior roles.", "Senior Engineer", None, None, [YES], []),
    ("We offer visa sponsorship for senior roles.", "Engineer", None, None, [NO], []),
    ("We offer visa sponsorship for senior roles.", "Principal Engineer", None, None, [YES], []),
    ("We offer visa sponsorship in the United States.", "Engineer", None, ["US"], [YES], []),
    ("We offer visa sponsorship in the United States.", "Engineer", None, ["DE"], [], []),
    ("We offer visa sponsorship in Canada only.", "Engineer", None, ["DE"], [NO], []),
    ("We offer visa sponsorship in Germany.", "Engineer", None, [], [MAY], ["scope_unread"]),
    ("We offer visa sponsorship in Germany.", "Engineer", None, None, [MAY], ["scope_unread"]),
    ("Visa sponsorship is considered on a case-by-case basis.", "Engineer", None, None, [MAY], ["hedged"]),
    ("We offer H-1B transfer sponsorship.", "Engineer", None, None, [MAY], ["transfer_only"]),
]


def drawn():
    """Statements put together from parts whose meaning is known."""
    who = ["we", "our company", "the team"]
    refusals = ["cannot", "do not", "are unable to", "will not", "can't", "won't"]
    deeds = ["sponsor work visas", "provide visa sponsorship", "offer immigration sponsorship", "support H-1B sponsorship"]
    tails = ["", " for this position", " at this time", " to new hires"]
    out = []
    for i, w in enumerate(who):
        for j, d in enumerate(deeds):
            for k, t in enumerate(tails):
                out.append((f"{w.capitalize()} {refusals[(i + j + k) % 6]} {d}{t}.", [NO]))
                out.append((f"{w.capitalize()} {['will', 'can', 'gladly'][(i + k) % 3]} {d}{t}.", [YES]))
                out.append((f"{w.capitalize()} may {d}{t}, decided case by case.", [MAY]))
    for help_ in ("assistance", "support", "package", "allowance", "reimbursement", "stipend", "bonus", "budget"):
        for verb in ("offer", "provide", "include"):
            out += [(f"We {verb} relocation {help_}.", [MOVE]), (f"We do not {verb} any relocation {help_}.", [])]
    return out


def read(spark, rows):
    schema = "id long, description string, title string, employment_type string, countries array<string>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    return {r["id"]: (list(r["stances"]), list(r["may_offer_because"])) for r in annotate_stances(df).collect()}


def test_plain_and_drawn_statements(spark):
    cases = PLAIN + drawn()
    assert len(cases) > 200
    got = read(spark, [(text, "Software Engineer", "Full time", None) for text, _ in cases])
    wrong = [(text, want, got[i][0]) for i, (text, want) in enumerate(cases) if got[i][0] != sorted(want)]
    assert not wrong, wrong


def test_scopes_and_reasons(spark):
    got = read(spark, [r[:4] for r in SCOPED])
    wrong = [(r, got[i]) for i, r in enumerate(SCOPED) if got[i] != (r[4], r[5])]
    assert not wrong, wrong


def test_long_texts_and_tables_without_countries(spark):
    text = "We build things for people who like things. " * 2000 + "We do not offer visa sponsorship."
    df = spark.createDataFrame([(1, text, "Engineer", None)], "id long, description string, title string, employment_type string")
    assert annotate_stances(df).first()["stances"] == [NO] and annotate_stances(df.limit(0)).count() == 0


def test_read_in_one_pass_without_exchange(spark):
    df = spark.createDataFrame([(1, "x", "Engineer", None)], "id long, description string, title string, employment_type string")
    plan = annotate_stances(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("word", ["sponsor", "visa", "relocation"])
def test_many_mentions_of_one_word(spark, word):
    df = spark.createDataFrame([(1, f"{word} " * 300, "Engineer", None)], "id long, description string, title string, employment_type string")
    assert annotate_stances(df).first()["stances"] in ([], [YES])
