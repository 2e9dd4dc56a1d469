import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest
from docsql.sources import dbapi, results
from docsql.sources.server import make_server

from tests.fixtures import fixture_engine


@pytest.fixture(scope="module")
def engine(spark):
    return fixture_engine(spark)


def test_dbapi(engine):
    cursor = dbapi.connect(engine).cursor()
    cursor.execute("SELECT title, berths FROM boat WHERE berths > ? ORDER BY berths", [1])
    assert [d[0] for d in cursor.description] == ["title", "berths"]
    assert cursor.fetchone() == ("Heron", 3) and cursor.fetchmany(5) == [("Plover", 7)] and cursor.fetchall() == []
    with pytest.raises(dbapi.Error):
        dbapi.connect(engine).cursor().fetchone()


def test_http(engine):
    server = make_server(engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/sql"
    ask = lambda path, body=None: urllib.request.urlopen(base + path, data=body.encode() if body else None).read().decode()
    sql = "SELECT title FROM boat ORDER BY berths"
    assert [h["_source"]["title"] for h in json.loads(ask("", json.dumps({"sql": sql})))["hits"]["hits"]] == ["Heron", "Plover"]
    assert ask("?format=csv&newLine=%7C", sql) == "title|Heron|Plover"
    assert ask("?format=csv&newLine=%7C&_id=true", sql) == "_id,title|b1,Heron|b2,Plover"
    assert json.loads(ask("", "SELECT /*! TRACK_TOTAL_HITS */ title FROM boat LIMIT 1"))["hits"]["total"]["value"] == 2
    assert ask(f"/explain?sql={urllib.parse.quote(sql)}").startswith("query")
    assert json.loads(ask("", "SELECT title FROM boat WHERE berths > 99"))["hits"] == {"hits": [], "total": {"value": 0, "relation": "eq"}, "max_score": None}
    engine.register_function("fails", lambda x: 1 // 0, "int")
    for text, code in (("DROP TABLE boat", 400), ('{"sql": ', 400), ('{"no": 1}', 400), ("SELECT nothing FROM boat", 400), ("SELECT fails(berths) AS f FROM boat", 500)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask("", text)
        assert e.value.code == code and "reason" in json.loads(e.value.read())
    server.shutdown()


def test_csv_sink(engine, spark, tmp_path):
    results.write_csv(engine.sql("SELECT name, skills FROM harbour WHERE home = 'Kelp Bay'"), str(tmp_path / "out"), separator=";")
    got = spark.read.csv(str(tmp_path / "out"), header=True, sep=";", escape='"')
    assert got.columns == ["name.first", "name.last", "name.rank", "name.shift", "skills"]
    assert {r["name.first"] for r in got.select("`name.first`").collect()} == {"Ilse", "Tomas"}
