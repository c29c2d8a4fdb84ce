"""op4's counts by kind, whatever place a kind's spans have in the list."""

from strata.llm.secrets import op4_secret_scan


def test_counts_do_not_depend_on_places(spark, tmp_path):
    key, number = "AKIA" + "A" * 16, "0123456789abcdef" * 2
    texts = [number, f"{key} {number}", f"token=abcdef {number} PASSWORD: 'abcdefg' {key}", f"xoxb-1234567890 {number} {number}", "token=abc", None]
    want = [(0, 0, 1), (0, 1, 1), (2, 1, 1), (0, 0, 2), (0, 0, 0), (0, 0, 0)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in op4_secret_scan(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))
