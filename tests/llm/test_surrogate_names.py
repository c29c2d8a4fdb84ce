"""Persons keep distinct and coreferent surrogates."""

from strata.llm import surrogates


def replaced(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in surrogates.replace_personal_data(d).orderBy("doc_id").collect()]


def test_persons_are_distinct_and_coreferent(spark):
    givens = [f"J{a}{b}n" for a in "aeiou" for b in "bdfgklm"]
    got = replaced(spark, [f"Mr {g} Smith" for g in givens] + [f"{t} {givens[0]} Smith" for t in ("Mr.", "Dr", "Prof.")])
    bare = [" ".join(x.split()[1:]) for x in got]
    assert len(set(bare[: len(givens)])) == len(givens)
    assert set(bare[len(givens) :]) == {bare[0]} and "Smith" not in "".join(got)


def test_whole_names_and_later_mentions(spark):
    texts = ["Mr John F. Kennedy came.", "Mr John Paul Smith came.", "Herr Dr. Müller kam.", "Mr J. Smith came.", "Mr John Smith came. Later Smith's wife met John Smith, and (Smith) smith I."]
    got = replaced(spark, texts)
    for x in got[:4]:
        assert not any(w in x for w in ("John", "Paul", "Kennedy", "Smith", "Müller"))
    assert got[2].startswith("Herr Dr. ") and got[2].endswith(" kam.") and got[0].endswith(" came.")
    given, surname = got[4].split()[1:3]
    assert got[4] == f"Mr {given} {surname} came. Later {surname}'s wife met {given} {surname}, and ({surname}) smith I."


def test_more_short_addresses_than_their_shape_has_surrogates(spark):
    # 'x@y.co' has 676 surrogates without growth.
    entities = spark.createDataFrame([("email", f"{a}@{b}.{t}", "latin", "n") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for t in ("co", "de")], "kind string, norm string, script string, gender string")
    got = [r.surrogate for r in surrogates.surrogate_map(entities, "k").collect()]
    assert len(got) == len(set(got)) == 1352


def test_parts_case_and_local_parts(spark):
    got = replaced(spark, ["Dr. Jane Smith-Jones came. SMITH-JONES left.", "Mr O'Neil came.", *[f"{c}@b.co" for c in "abcdefghijklmnopqrstuvwxyz"], "_@b.co"])
    surname = got[0].split()[2]
    assert surname.count("-") == 1 and all(w[0].isupper() and w[1:].islower() for w in surname.split("-"))
    assert got[0].endswith(f"{surname} came. {surname.upper()} left.")
    assert "'" in got[1].split()[1] and "Neil" not in got[1]
    for c, x in zip("abcdefghijklmnopqrstuvwxyz_", got[2:], strict=True):
        assert x.split("@")[0] != c


def test_given_names_learnt_from_titles(spark):
    texts = ["Mr John Miller came.", "Dr. John Baker came.", "John Smith alone wrote, and Smith knew.", "Paris Smith is a town.", "Then came John F. Kerry, by train.", "Ms Ada Lovelace", "Ada Byron"]
    got = replaced(spark, texts)
    assert "John" not in got[2] and "Smith" not in got[2] and got[2].endswith(" knew.")
    given, surname = got[2].split()[:2]
    assert got[2] == f"{given} {surname} alone wrote, and {surname} knew."
    assert got[3] == texts[3]  # a surname alone tells nothing in another text
    assert "Kerry" not in got[4] and "John" not in got[4] and got[4].startswith("Then came ")
    assert got[6] == "Ada Byron"  # one surname teaches nothing
    assert given in got[0] and given in got[1]


def test_shapes_of_digits_do_not_run_out(spark):
    # All numbers of three digits: their shape has no free surrogate at all.
    entities = spark.createDataFrame([("ssn", f"{i:03}", "latin", "n") for i in range(1000)] + [("ip", f"1.2.3.{i}", "latin", "n") for i in range(256)], "kind string, norm string, script string, gender string")
    got = surrogates.surrogate_map(entities, "k").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == 1256
    assert not {r.surrogate for r in got} & {r.norm for r in got}
