import io
import json
import threading

import pytest
from pyarrow import flight

from tidemark import cli
from tidemark.engine import Engine
from tidemark.serving import QueryClient, QueryServer


@pytest.fixture
def engine(spark):
    out = Engine(spark)
    rows = [(i * 10**9, float(i), i % 2 == 0) for i in range(5)]
    out.catalog.register("m", lambda: spark.createDataFrame(rows, "t bigint, x double, y boolean"), "t", ["x", "y"])
    return out


def test_server_and_client(spark, engine):
    server = QueryServer(engine, port=0)
    threading.Thread(target=server.serve, daemon=True).start()
    client = QueryClient(port=server.port)
    try:
        got = client.query("with cols=[x, y] select y, x from m where ts >= '1970-01-01 00:00:03'")
        assert got.to_pydict() == {"ts": ["1970-01-01T00:00:03.000000000Z", "1970-01-01T00:00:04.000000000Z"], "y": [False, True], "x": [3.0, 4.0]}
        out = io.StringIO()
        client.run("with cols=[x, y], format=json select x from m where ts < '1970-01-01 00:00:02'", spark, out)
        assert json.loads(out.getvalue())["x"] == [0.0, 1.0]
        assert client.query("select * from m where ts > '1999-01-01'").num_rows == 0
        with pytest.raises(flight.FlightServerError, match="expected FROM"):
            client.query("select *")
    finally:
        client.close()
        server.shutdown()


def test_settings_and_statements(tmp_path):
    config = tmp_path / "c.json"
    config.write_text('{"port": 7}')
    env = {"TIDEMARK_PORT": "5", "TIDEMARK_HOST": "h"}
    assert cli.settings([], env)["port"] == "5"
    assert cli.settings(["--port", "6"], env)["port"] == "6"
    got = cli.settings(["--port", "6", "--config", str(config), "select 1"], env)
    assert (got["port"], got["host"], got["query"]) == ("7", "h", "select 1")
    assert list(cli.statements(io.StringIO("select *\nfrom a;\nselect * from b;\nselect c"))) == ["select *\nfrom a;", "select * from b;", "select c"]
