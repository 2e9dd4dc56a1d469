import pytest
from docsql.llm import license_scan

from .data import COLUMNS, documents, table


@pytest.mark.parametrize("most", [1000, 0])
def test_variants_match(spark, most):
    mit = license_scan.KNOWN["MIT"]
    variants = {
        1: mit, 2: mit.upper().replace("\n", "\r\n  "), 3: mit.replace("Copyright (c) <year> <copyright holders>", "© 2020 Someone\nCopyright 2021, Others & Co."),
        4: mit.replace("sublicense", "sub-license").replace('"AS IS"', "'AS IS'"), 5: mit + " and more", 6: "Released under the MIT Licence", 7: "  ", 8: None,
        9: mit.replace("copyright holders be", "copyright owners be").replace("HOLDERS BE", "OWNERS BE"),
    }
    docs = spark.createDataFrame([(i, t, "", "", 0, 0, "", "") for i, t in variants.items()] + [(1, mit, "", "", 0, 0, "", "")], COLUMNS).withColumnRenamed("__row", "digest").withColumnRenamed("fp", "license_id")
    known = spark.createDataFrame([*license_scan.KNOWN.items(), (None, "x"), ("zz", mit), ("void", "  ")], "license_id string, text string")
    got = license_scan.license_scan(docs, known, broadcast_rows=most).collect()
    assert len(got) == len(variants) + 1
    found = {r.doc_id: r.license_id for r in got}
    assert found == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: None, 6: "notice-mit", 7: None, 8: None, 9: "MIT"}
    assert all(r.is_license == (r.license_id is not None) for r in got)


def test_whole_words_only(spark):
    mit = license_scan.KNOWN["MIT"]
    texts = {
        1: "This is for programmers.", 2: "This is for programrs.", 3: "licence licence licence, sub-licence & non-commercial", 4: "license license license sub license and noncommercial",
        5: "the owners", 6: "the holders", 7: "licenced", 8: "licensed", 9: mit.replace("distribute, sublicense", "distribute, sub license"), 10: "A" * 300000 + " licence", 11: "a" * 300000 + "\nLicense",
        12: license_scan.KNOWN["BSD-3-Clause"].replace("copyright holder nor", "copyright owner nor"), 13: license_scan.KNOWN["Apache-2.0-header"].replace("http:", "https:").replace("\n", "\n# "),
    }
    docs = spark.createDataFrame([(i, t, "", "", 0, 0, "", "") for i, t in texts.items()] * 2, COLUMNS)
    known = spark.createDataFrame(list(license_scan.KNOWN.items()), "license_id string, text string")
    got = license_scan.license_scan(docs, known).collect()
    digest, found = {r.doc_id: r.digest for r in got}, {r.doc_id: r.license_id for r in got}
    assert len(got) == 2 * len(texts) and len({(r.doc_id, r.digest) for r in got}) == len(texts)
    assert digest[1] != digest[2] and digest[5] != digest[6] and digest[7] != digest[8]
    assert digest[3] == digest[4] and digest[10] == digest[11]
    assert (found[9], found[12], found[13]) == ("MIT", "BSD-3-Clause", "Apache-2.0-header")


def test_query_equals_sql_where_texts_match(spark, tmp_path):
    import duckdb
    from docsql.llm.queries import oracle_sql, queries

    texts = [*license_scan.KNOWN.values(), "Released under the MIT Licence", "none", None, "", "whilst & sub-licence https://x"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries()["op8_license_scan"](spark, str(tmp_path)).select("doc_id", "digest", "license_id", "is_license").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT doc_id, digest, license_id, is_license FROM ({oracle_sql()['op8_license_scan']})").fetchall())
    assert got == want and sum(r[3] for r in got) == len(license_scan.KNOWN) + 1


def test_odd_and_empty_tables(spark):
    known = spark.createDataFrame(list(license_scan.KNOWN.items()), "license_id string, text string")
    assert license_scan.license_scan(table(spark, documents()), known).count() == len(documents())
    assert license_scan.license_scan(spark.createDataFrame([], COLUMNS), known).collect() == []
    assert not any(r.is_license for r in license_scan.license_scan(table(spark, documents()), known.limit(0)).collect())


def test_wrapped_lines_and_notices(spark):
    isc, mit, bsd = (license_scan.KNOWN[k] for k in ("ISC", "MIT", "0BSD"))
    wrapped = isc.replace("provided that the above copyright", "provided that the above\ncopyright")
    texts = {
        1: wrapped, 2: "/*\n * " + wrapped.replace("\n", "\n * ") + "\n */", 3: mit.replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE"), 4: " ".join(bsd.split()),
        5: mit.replace("Copyright (c) <year> <copyright holders>", "Copyright (c) Some Authors\r\nCopyright Other, Inc. 2019-2021\r\n(c) 2020 X\r\nCopyright [yyyy] [name]"),
        6: isc.replace("copyright notice and", "\n(c) notice and"), 7: mit.replace("The above copyright", "The above\rcopyright"), 8: isc.replace("provided that the above copyright notice and", "and"),
    }
    docs = spark.createDataFrame([(i, t, "", "", 0, 0, "", "") for i, t in texts.items()], COLUMNS)
    known = spark.createDataFrame(list(license_scan.KNOWN.items()), "license_id string, text string")
    found = {r.doc_id: r.license_id for r in license_scan.license_scan(docs, known).collect()}
    assert found == {1: "ISC", 2: "ISC", 3: "MIT", 4: "0BSD", 5: "MIT", 6: None, 7: "MIT", 8: None}
