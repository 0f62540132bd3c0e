import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from papyrine import cli
from papyrine.plans.pipelines import Run
from papyrine.config import Settings
from papyrine.sources import fetch, search

XML = '<article article-type="research-article"><front><article-meta><article-id pub-id-type="pmc">{n}</article-id><title-group><article-title>Title {n}</article-title></title-group><abstract><p>About it.</p></abstract></article-meta></front></article>'


@pytest.fixture
def service():
    """A search over five ids in pages of two, and their texts: 3 is not there, 4 fails twice, 5 always."""
    asked = {"terms": [], "tries": {}}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            code, body = 200, b""
            if u.path == "/search":
                q = parse_qs(u.query)
                asked["terms"].append(q["term"][0])
                ids = ["1", "2", "3", "4", "5"][int(q["retstart"][0]) :][: min(2, int(q["retmax"][0]))]
                body = json.dumps({"esearchresult": {"count": "5", "idlist": ids}}).encode()
            else:
                n = u.path.rsplit("/", 1)[-1].removeprefix("PMC")
                asked["tries"][n] = asked["tries"].get(n, 0) + 1
                code = 404 if n == "3" else 503 if n == "5" or n == "4" and asked["tries"][n] < 3 else 200
                body = XML.format(n=n).encode("latin-1") + ("é".encode("latin-1") if n == "2" else b"")
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_search_service(spark, service):
    url, asked = service
    search.register(spark)
    read = lambda **o: [tuple(r) for r in spark.read.format("article_search").options(url=f"{url}/search", delay="0", query="heart", **o).load().collect()]
    assert read(year="2020", journal="J One") == [(f"PMC{i}", i) for i in range(1, 6)]
    assert asked["terms"][0] == 'heart AND open access[filter] AND 2020[pdat] AND "J One"[journal]'
    assert read(limit="3") == [(f"PMC{i}", i) for i in range(1, 4)]


@pytest.mark.parametrize("tasks", [1, 3])
def test_fetch_statuses(spark, service, tasks):
    url, _ = service
    found = spark.createDataFrame([(f"PMC{i}",) for i in (1, 2, 3, 4, 5, 1)] + [(None,)], "pmcid string")
    got = {r["pmcid"]: r for r in fetch.fetch(found, fetch.FromUrl(url + "/text/{pmcid}"), delay=0, retries=2, base=0.01, tasks=tasks).collect()}
    assert {k: (r["status"], r["attempts"]) for k, r in got.items()} == {"PMC1": ("fetched", 1), "PMC2": ("fetched", 1), "PMC3": ("missing", 1), "PMC4": ("fetched", 3), "PMC5": ("failed", 3)}
    assert got["PMC2"]["xml"].endswith("é") and "503" in got["PMC5"]["error"] and got["PMC3"]["xml"] is None
    assert fetch.fetch(found.limit(0), fetch.FromUrl(url), delay=0).count() == 0


def test_search_and_fetch_to_the_raw_stage(spark, service, tmp_path):
    url, _ = service
    run = Run(spark, Settings(data_dir=str(tmp_path), request_delay=0.0, max_retries=0))
    found = run.search("heart", url=f"{url}/search")
    out = run.ingest(found.select("pmcid"), run.fetch(found, fetch.FromUrl(url + "/{pmcid}"))).first()
    assert (out["total"], out["success"], out["failed"], out["invalid"]) == (5, 2, 3, 0)


def test_ingest_command_with_a_query(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    for n, year in (("1", 2020), ("2", 2021), ("3", 2020)):
        (src / f"PMC{n}.xml").write_text(XML.format(n=n))
        (src / f"{n}.json").write_text(json.dumps({"pmcid": n, "title": "Heart failure", "pub_year": year, "journal": "J"}))
    monkeypatch.setattr(cli, "stop_gently", lambda spark: None)
    assert cli.main(["ingest", "--source", str(src), "--query", "heart", "--year", "2020", "--data-dir", str(tmp_path / "d")]) == 0
    assert {r["pmcid"] for r in spark.read.parquet(str(tmp_path / "d" / "raw")).collect()} == {"PMC1", "PMC3"}
