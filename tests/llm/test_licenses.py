"""License scans against a plain count of phrases, the SQL, and planted license texts."""

import re

from pyspark.sql import functions as F
from strata.llm import licenses as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
N = 200_000
TEXTS = [
    None,
    "",
    "MIT license, mit LICENSE; the gnu General\tPublic\nLicense",
    "Mit license apache license mit lıcense mit 许可 license",
    "x " * 50 + "\n".join(t.text for t in L.TEMPLATES[1:3]),
    L.TEMPLATES[7].text.replace("modification", "any modification", 1) + " general public",
    "Permission granted free of charge MIT",
    "Copyright Someone. " + L.TEMPLATES[8].text.upper(),
    "apache license " * (N // 15),
    "license " * (N // 8) + "creative commons attribution noncommercial",
    "é" * (N // 2),
    "licensed under cc by nc 4 0 " * (N // 28),
]


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in L.BASE}
    places = sorted(i for found in at.values() for i in found)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(x for x, found in at.items() if found))


def test_base_columns_and_hostile_texts(spark):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(0)).withColumn("id", F.lit("x")).withColumn("has", F.lit(1))
    got = {r.doc_id: r for r in L.scan_licenses(docs.unionByName(docs.where("doc_id = 2")).repartition(4)).dropDuplicates().collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert tuple(got[i])[1:6] == base_of(text)
        assert 0 <= got[i].score <= 1 and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
    assert [got[i or None].labels for i in (0, 1, 2, 4, 5, 6, 7, 9, 11)] == ["", "", "gpl,mit", "apache,mit", "bsd", "", "isc", "", "cc-by-nc"]
    assert got[4].score > 0.9 and got[6].score == 0


def test_the_words_that_are_rare_decide(spark):
    """A text of common words of a template alone, in their places, isn't one: the phrase is missing, or the weight."""
    common = "this is to the of and or in with as " * 20
    docs = [common] * 50 + ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"]
    got = [r.labels for r in L.scan_licenses(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [""] * 50 + ["cc-by", ""] or got == [""] * 50 + ["cc-by", "cc-by"]


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_workers(spark):
    plan = L.scan_licenses(spark.createDataFrame([(1, "mit license")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
