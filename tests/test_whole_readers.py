from scholar_spark.sources import readers


def test_tagged_lines_stay_whole(spark, tmp_path):
    long = "x" * 1_000_010
    (tmp_path / "a.txt").write_text(f"FN Clarivate\nVR 1.0\nPT J\nTI {long}\nAB short\n   {long}\nER\n\nEF\n")
    row = readers.read_tagged(spark, str(tmp_path / "a.txt")).first()
    assert row["TI"] == long and row["AB"] == f"short {long}" and row["PT"] == "J"
