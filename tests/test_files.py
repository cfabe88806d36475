"""Reading subjects and writing results, there and back."""

from aliasflow.operators import reports
from aliasflow.sources import files


def test_texts_subjects_and_ledgers_there_and_back(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("line one\nline two\n")
    (folder / "b.txt").write_text("")
    texts = {r.path.rpartition("/")[2]: r for r in files.read_texts(spark, str(folder), "plan").collect()}
    assert texts["a.txt"].text == "line one\nline two\n" and {r.kind for r in texts.values()} == {"plan"} and len({r.doc_id for r in texts.values()}) == len(texts)
    subjects = spark.createDataFrame([(1, "p", 3, "snippet", "t", None, True)], files.SUBJECTS)
    subjects.write.parquet(str(tmp_path / "subjects"))
    assert files.read_subjects(spark, str(tmp_path / "subjects")).collect() == subjects.collect()
    ledger = spark.createDataFrame([(f"p{i % 9}", f"k{i}", f"Type{i}", "x") for i in range(50)], files.LEDGER)
    files.write_ledger(ledger, str(tmp_path / "ledger"))
    assert sorted(files.read_ledger(spark, str(tmp_path / "ledger")).collect()) == sorted(ledger.collect())


def test_exports_keep_their_line_ends(spark, tmp_path):
    names = spark.createDataFrame([(1, 0, 'a,"b"', "Type1", "TYPE"), (1, 1, "x", None, "TYPE"), (1, 2, "y", "str2", "LITERAL")], "doc_id long, ordinal int, original string, placeholder string, kind string")
    files.write_csv_texts(reports.mapping_csv(names), str(tmp_path / "csv"))
    said = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert said == b'Placeholder,Original,Kind\r\nType1,"a,""b""",TYPE\r\nstr2,y,LITERAL\r\n'
