import json
from dataclasses import replace

from papyrine import cli
from papyrine.config import Settings
from papyrine.operators import articles
from papyrine.plans.pipelines import Run
from papyrine.sources import files, search

FULL = """<?xml version="1.0"?><!DOCTYPE article PUBLIC "-//NLM//DTD JATS//EN" "JATS.dtd">
<article article-type="research-article"><front><journal-meta><journal-title>J One</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmc">1</article-id><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>A <i>fine</i> title</article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Ann B.</given-names></name></contrib><contrib contrib-type="author"><name><surname>Solo</surname></name></contrib><contrib contrib-type="editor"><name><surname>Ed</surname></name></contrib></contrib-group>
<pub-date pub-type="ppub"><year>2019</year></pub-date><pub-date pub-type="epub"><year>x</year></pub-date><permissions><license><license-p>Open &amp; free</license-p></license></permissions>
<abstract><p>Short abstract [1].</p></abstract><kwd-group><kwd>k1</kwd><kwd> </kwd></kwd-group></article-meta></front>
<body><p>loose</p><sec><title>Intro</title><p>Own text (Lee, 2020).</p><table-wrap id="T1"><caption><p>Cap</p></caption><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>x|y</td></tr></tbody></table></table-wrap><sec><title>Deep</title><p>Inner.</p></sec><sec><title>Empty</title></sec></sec>
<sec><title>Last</title><fig id="F1"><caption><p>Figure one</p></caption></fig><p>End.</p><table-wrap><table><tr><td>h</td></tr><tr><td>v</td></tr></table></table-wrap></sec></body>
<back><ref-list><ref>Ref A</ref><ref> </ref></ref-list></back></article>"""


def test_full_article():
    a = articles.article("PMC1", FULL)
    m = a["metadata"]
    assert (m["title"], m["authors"], m["pub_year"], m["license"], m["keywords"]) == ("A fine title", ["Ann B. Doe", "Solo"], 2019, "Open & free", ["k1"])
    assert [s["section_path"] for s in a["sections"]] == [["Intro"], ["Intro", "Deep"], ["Last"]]
    assert a["sections"][0]["content"] == "Own text." and [s["ord"] for s in a["sections"]] == [0, 1, 2]
    assert a["doc_tables"][0] == {"id": "T1", "caption": "Cap", "markdown": "| a | b |\n|---|---|\n| 1 | x\\|y |", "section": "Intro"}
    assert a["doc_tables"][1]["markdown"] == "| h |\n|---|\n| v |" and a["doc_tables"][1]["id"] == "table_1"
    assert a["figures"] == [{"id": "F1", "caption": "Figure one"}] and a["refs"] == ["Ref A"] and a["errors"] == [] and a["well_formed"]


def test_damaged_articles():
    cut = articles.article("PMC1", FULL[: FULL.index("</body>") - 30])
    assert not cut["well_formed"] and cut["metadata"]["title"] == "A fine title" and cut["errors"] == []
    assert articles.article("PMC1", "")["errors"] == ["empty_file"] and articles.article("PMC1", None)["errors"] == ["empty_file"]
    assert articles.article("PMC1", "<a/>")["errors"] == ["file_too_small"]
    assert articles.article("PMC2", FULL)["errors"] == ["missing_pmcid"]
    assert articles.article("PMC1", FULL.replace("<abstract><p>Short abstract [1].</p></abstract>", ""))["warnings"] == ["missing_abstract"]
    assert articles.article("PMC1", "plain text without any element " * 9)["errors"]
    head_only = FULL.replace("<tbody><tr><td>1</td><td>x|y</td></tr></tbody>", "")
    assert articles.article("PMC1", head_only)["doc_tables"][0]["markdown"] == "| a | b |\n|---|---|"


def test_stages_resume_and_force(spark, tmp_path):
    src = tmp_path / "xml"
    src.mkdir()
    (src / "PMC1.xml").write_text(FULL)
    (src / "PMC2.xml").write_bytes(FULL.replace('"pmc">1<', '"pmc">2<').replace("Short", "Kürz").encode("latin-1"))
    (src / "PMC3.xml").write_text("<article>too small</article>")
    run = Run(spark, replace(Settings(), data_dir=str(tmp_path / "data"), chunk_min_tokens=1, embedding_dim=32))
    raw = files.xml_files(spark, str(src))
    assert {r["pmcid"] for r in raw.collect()} == {"PMC1", "PMC2", "PMC3"} and files.xml_files(spark, str(src), "PMC1").count() == 1
    assert files.xml_files(spark, str(src), limit=2).count() == 2
    found = spark.createDataFrame([("PMC1",), ("PMC2",), ("PMC3",), ("PMC4",)], "pmcid string")
    first = run.ingest(found, raw).first()
    assert (first["success"], first["invalid"], first["failed"]) == (2, 1, 1)
    assert run.ingest(found, raw).first()["skipped"] == 2
    assert run.parse().first()["parsed"] == 2 and run.parse().first()["seen"] == 0
    chunked = run.chunk().first()
    assert chunked["documents"] == 2 and chunked["abstract_chunks"] == 2 and chunked["table_chunks"] == 4
    assert run.chunk().first()["documents"] == 0
    assert run.embed().first()["vectors"] > 0
    one = run.index().first()
    assert one["is_valid"] and one["skipped"] == 0
    assert run.index().first()["skipped"] == one["total_points"]
    assert run.index(force=True).first()["indexed"] == one["total_points"]
    assert run.index(recreate=True).first()["skipped"] == 0


def test_stage_without_input(spark, tmp_path):
    run = Run(spark, replace(Settings(), data_dir=str(tmp_path)))
    assert run.parse().first()["parsed"] == 0 and run.chunk().first()["documents"] == 0
    assert run.embed().first()["vectors"] == 0 and run.index().first()["indexed"] == 0


def test_search_source(spark, tmp_path):
    rows = [{"pmcid": 1, "title": "heart drug heart", "pub_year": 2020, "journal": "A"}, {"pmcid": "PMC2", "title": "heart", "pub_year": 2021, "journal": "B"}, {"pmcid": 3, "title": None}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    search.register(spark)
    read = lambda **o: [tuple(r) for r in spark.read.format("article_search").options(path=str(tmp_path), **o).load().collect()]
    assert read(query="heart") == [("PMC1", 1), ("PMC2", 2)]
    assert read(query="heart", year="2021") == [("PMC2", 1)] and read(query="none") == [] and len(read(query="heart", limit="1")) == 1


def test_search_response_and_retry():
    r = search.search_response('{"esearchresult": {"count": "2", "idlist": ["7", "PMC8"]}}')
    assert r["pmcids"] == ["PMC7", "PMC8"] and r["total_count"] == 2 and search.search_response("{}")["pmcids"] == []
    waits, calls = [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "ok"

    assert search.retrying(fetch, 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]


def test_routes(spark):
    import threading
    import urllib.error
    import urllib.request

    from papyrine import api

    s = api.server(spark)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda p: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{p}").read())
    assert get("/")["project"] == "papyrine" and get("/health") == {"status": "healthy"} and api.health(None)["status"] == "unhealthy"
    try:
        get("/none")
        raise AssertionError
    except urllib.error.HTTPError as e:
        assert e.code == 404
    s.shutdown()


def test_logs(tmp_path):
    from papyrine.log import stage_logger

    log = stage_logger("demo", str(tmp_path), console=False)
    log.info("fine")
    log.warning("odd")
    assert "fine" in (tmp_path / "demo.log").read_text() and (tmp_path / "demo_errors.log").read_text().count("\n") == 1


def test_settings_and_cli(tmp_path, capsys):
    assert Settings.from_env({"PAPYRINE_TOP_K": "7"}).top_k == 7
    assert cli.main(["setup", "--data-dir", str(tmp_path / "d")]) == 0 and (tmp_path / "d" / "raw").is_dir()
    assert cli.main(["check"]) in (0, 1)
    a = cli.parser().parse_args(["index", "--recreate", "--batch-size", "8"])
    assert a.recreate and a.batch_size == 8
