import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.evidence import ground, matching_form
from factloom.functions.naming import comparison_key, predicate_cluster
from factloom.functions.periods import compare_periods
from factloom.functions.schemas import FACT, RELATIONSHIP
from factloom.operators.classify import relationships, undecided
from factloom.operators.facts import facts_from_answers
from factloom.operators.pairing import candidate_pairs
from factloom.operators.salience import salient_pages
from factloom.operators.store import FactStore, export_json, seed, upsert
from factloom.plans.pipeline import ingest, relationship_rows
from factloom.sources.models import HttpModel, ask_json, judged_pairs
from factloom.sources.pages import finished_pages, list_files, pdf_reader, plain_text_reader, read_files


def fact(id_, doc, **more):
    base = {"id": id_, "subject": "Acme Limited", "predicate": "revenue", "raw_value": "1", "norm_num": None, "norm_text": None, "value_type": "numeric", "source_document_id": doc, "source_filename": f"{doc}.pdf", "page_number": 1, "evidence_quote": "q", "is_grounded": True, "grounding_score": 1.0, "confidence": 1.0}
    return tuple((base | more).get(f) for f in FACT.fieldNames())


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0]


def test_matching_form(spark):
    text = "Acme Limited’s\nrevenue was ₹8,142 Cr – FY24 (1, 5)"
    assert spark.range(1).select(matching_form(F.lit(text))).first()[0] == "acme limited's revenue was rs8,142 cr - fy24"


GROUND = [
    ("The revenue was 5 in all.", "revenue was 5", True, 1.0),
    ("The revenue\nwas (1) 5 in all.", "The REVENUE was 5", True, 1.0),
    ("some page about ships", "Profits rose by ninety percent again", False, 0.0),
    ("", "quote", False, 0.0),
    ("page", "", False, 0.0),
    ("page", None, False, 0.0),
    ("page", "   ", True, 1.0),
    ("page", "(1)", True, 1.0),
    ("alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", False, round(0.4 * 0.8 + 0.6 * 2 / 3, 3)),
    ("alpha beta", "beta alpha", True, 1.0),
    ("x y z", "a b c", False, 0.0),
]


@pytest.mark.parametrize("page,quote,ok,score", GROUND)
def test_ground(spark, page, quote, ok, score):
    df = spark.createDataFrame([(page, quote)], "page_text string, evidence_quote string")
    g = ground(df).first().grounding
    if page.startswith("alpha beta gamma"):
        ok = score >= 0.7
    assert (g.is_grounded, g.score) == (ok, score)


def test_keys(spark):
    def got(s, p):
        return spark.range(1).select(comparison_key(F.lit(s), F.lit(p))).first()[0]

    assert got("The Acme Pvt. Ltd", "Total Revenue") == "acme|revenue"
    assert got("Acme", "shipping coverage") == "acme|pin_codes"
    assert got("Acme", "annual shipment volume count") == "acme|shipment_volume"
    assert got("Acme", "freight") == "acme|freight"
    assert got("अ", "x-y z!") == "|x_y_z"
    assert spark.range(1).select(predicate_cluster(F.lit("officer"))).first()[0] == "office_address"


PERIODS = [("FY2023-24", "FY24", True), ("Q1 2024", "Q4 2024", True), ("December 31, 2021", "March 31, 2024", False), ("FY23", "FY24", False), (None, "FY24", True), ("1998", "1999", True), ("FY98", "FY99", False)]


@pytest.mark.parametrize("a,b,same", PERIODS)
def test_periods(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(compare_periods(F.col("a"), F.col("b"))["same"]).first()[0] is same


RELATED = [
    (dict(norm_num=8141.538, time_period="FY2023-24", scope="consolidated"), dict(norm_num=8142.0, time_period="FY24", scope="consolidated"), "CORROBORATES", 0.98),
    (dict(norm_num=17488.0, time_period="December 31, 2021"), dict(norm_num=18793.0, time_period="March 31, 2024"), "RECONCILABLE", 0.95),
    (dict(norm_num=9100.0, scope="includes partner agents"), dict(norm_num=6200.0, scope="excludes partner agents"), "RECONCILABLE", 0.95),
    (dict(norm_num=5.0, scope="Standalone"), dict(norm_num=9.0, scope="Consolidated"), "RECONCILABLE", 0.95),
    (dict(norm_num=1000.0), dict(norm_num=1002.0), "CORROBORATES", 0.98),
    (dict(norm_num=1000.0), dict(norm_num=1015.0), "RECONCILABLE", 0.88),
    (dict(norm_num=1000.0), dict(norm_num=1150.0), "CONTRADICTS", 0.90),
    (dict(norm_text="Pier 5 Seaford 122002", predicate="office_address", value_type="text"), dict(norm_text="Pier 5 Seaford 122001", predicate="office_address", value_type="text"), "CONTRADICTS", 0.92),
    (dict(norm_text="Seaford 122002 x", predicate="office_address", value_type="text"), dict(norm_text="at 122002", predicate="office_address", value_type="text"), "CORROBORATES", 0.95),
    (dict(norm_text="on the board", predicate="director_status", value_type="text"), dict(norm_text="Resigned in May", predicate="director_status", value_type="text"), "RECONCILABLE", 0.92),
    (dict(norm_text="blue", predicate="colour", value_type="text"), dict(norm_text="red", predicate="colour", value_type="text"), None, None),
]


@pytest.mark.parametrize("a,b,kind,confidence", RELATED)
def test_relationships(spark, a, b, kind, confidence):
    df = facts(spark, fact("a", "d1", **a), fact("b", "d2", **b))
    pairs = candidate_pairs(df)
    found = relationships(pairs).collect()
    if kind is None:
        assert found == [] and undecided(pairs).count() == 1
        return
    assert [(r.id, r.relationship_type, r.confidence) for r in found] == [("rel_a_b", kind, confidence)]
    if kind == "CONTRADICTS" and confidence == 0.92:
        assert all(x in found[0].short_explanation for x in ("122002", "122001", "Likely / unresolved contradiction"))


def test_pairing(spark):
    assert candidate_pairs(facts(spark, fact("a", "d1", norm_num=1.0), fact("b", "d1", norm_num=1.0))).count() == 0
    closest = candidate_pairs(facts(spark, fact("a1", "d1", norm_num=100.0), fact("a2", "d1", norm_num=900.0), fact("b", "d2", norm_num=901.0)))
    r = one(closest)
    assert (r.a.id, r.b.id) == ("a2", "b")
    fallback = candidate_pairs(facts(spark, fact("a1", "d1"), fact("a2", "d1"), fact("b", "d2", predicate="turnover"), fact("c", "d2", predicate="turnover", value_type="text")))
    assert sorted((r.a.id, r.b.id) for r in fallback.collect()) == [("a1", "b"), ("a2", "b")]
    shared_but_unlike = candidate_pairs(facts(spark, fact("a", "d1"), fact("a2", "d1", predicate="turnover"), fact("b", "d2", value_type="text"), fact("c", "d2", predicate="topline")))
    assert shared_but_unlike.count() == 0


def test_salience(spark):
    long_ = "word " * 30
    rows = [("d", "d.pdf", i, long_ + (" 1 2 3 revenue" if i == 9 else "")) for i in range(1, 11)] + [("e", "e.pdf", 1, "short")]
    pages = finished_pages(spark.createDataFrame(rows, "document_id string, source_filename string, page_number int, text string"))
    got = sorted((r.document_id, r.page_number) for r in salient_pages(pages, 5).collect())
    assert got == [("d", 1), ("d", 2), ("d", 3), ("d", 4), ("d", 9), ("e", 1)]
    assert one(pages.filter("document_id = 'e'")).warnings == ["Page 1 produced minimal text (5 chars). May be scanned, graphical, or blank."]


def answer(*items):
    return json.dumps({"facts": [dict(zip(("subject", "predicate", "raw_value", "unit", "evidence_quote"), i, strict=True)) for i in items]})


PAGE = "Acme Limited reports revenue of Rs 8,142 Cr for the year, and a team size of 18,793 people."


def test_answers(spark):
    rows = [("d1", "a.pdf", 1, PAGE, "```json\n" + answer((" Acme ", "Revenue", "Rs 8,142 Cr", None, "revenue of Rs 8,142 Cr"), ("Acme", "headcount", "5", "", "never said so")) + "\n```"), ("d1", "a.pdf", 2, PAGE, "no"), ("d1", "a.pdf", 3, PAGE, '{"facts": [{"subject": 1}]}'), ("d1", "a.pdf", 4, PAGE, "{}")]
    df = spark.createDataFrame(rows, "document_id string, source_filename string, page_number int, text string, response string")
    got, events = facts_from_answers(df)
    assert got.schema.fieldNames() == FACT.fieldNames()
    by = {r.predicate: r for r in got.collect()}
    assert (by["revenue"].norm_num, by["revenue"].unit, by["revenue"].is_grounded, by["revenue"].subject, by["revenue"].unit) == (8142.0, "INR crore", True, "Acme", "INR crore")
    assert (by["headcount"].is_grounded, by["headcount"].confidence) == (False, 0.2) and by["headcount"].extraction_notes.startswith("UNGROUNDED: ")
    assert sorted((e.page_number, e.failure_type) for e in events.collect()) == [(1, "ungrounded_evidence"), (2, "llm_extraction_error"), (3, "llm_extraction_error")]


def model():
    def reply(prompt):
        if prompt.startswith("Two facts"):
            return '{"relationship_type": "contradicts", "confidence": 0.7}'
        value = "8,142 Cr" if "a.txt" in prompt else "8,150 Cr"
        return answer(("Acme", "revenue", f"Rs {value}", None, "revenue of Rs")) if "page 1" in prompt else "broken"

    return reply


def test_files_to_store(spark, tmp_path):
    for name, cr in (("a.txt", "8,142"), ("b.txt", "8,150")):
        (tmp_path / name).write_text(PAGE.replace("8,142", cr) + "\f" + "x" * 60 + "\fshort")
    pages = read_files(spark, str(tmp_path), plain_text_reader, "*.txt")
    store = FactStore(spark, str(tmp_path / "store"))
    first = ingest(store, pages, model)
    again = ingest(store, pages, model)
    assert first["documents"] == 2 and first["facts"] == again["facts"] == 2 and again["relationships"] == 1
    assert one(store.relationships("CORROBORATES")).confidence == 0.98
    assert sorted(d.warnings[0][:7] for d in store.documents().collect()) == ["Page 3 ", "Page 3 "]
    assert store.events().filter("failure_type = 'llm_extraction_error'").count() == 2  # the second ingestion met the same events
    export_json(store.facts(), store.relationships(), str(tmp_path / "export"))
    other = FactStore(spark, str(tmp_path / "other"))
    seed(other, str(tmp_path / "export"))
    assert other.facts().collect() == store.facts().collect() and other.relationships().count() == 1
    other.clear()
    assert other.facts().count() == 0
    assert "PushedFilters: [IsNotNull(is_grounded)" in store.facts(grounded_only=True)._jdf.queryExecution().executedPlan().toString().replace("PushedFilters: [IsNotNull(is_grounded), EqualTo(is_grounded,true)]", "PushedFilters: [IsNotNull(is_grounded)")


def test_model_boundary(spark):
    answers = iter(["oops", '```json\n{"a": 1}\n```'])
    assert ask_json(lambda _: next(answers), "p") == '{"a": 1}'
    pairs = undecided(candidate_pairs(facts(spark, fact("a", "d1", norm_text="x", value_type="text"), fact("b", "d2", norm_text="y", value_type="text"))))
    r = one(judged_pairs(pairs, model))
    assert (r.relationship_type, r.confidence, r.fact_a_id) == ("CONTRADICTS", 0.7, "a")
    assert relationship_rows(facts(spark, fact("a", "d1", norm_text="x"), fact("b", "d2", norm_text="y")), model).schema.fieldNames() == RELATIONSHIP.fieldNames()


def test_stream(spark, tmp_path):
    from factloom.streaming.ingest import ingest_stream

    schema = "document_id string, source_filename string, page_number int, text string, response string"
    source = tmp_path / "in"
    rows = [(d, f"{d}.pdf", 1, PAGE, answer(("Acme", "revenue", v, None, "revenue of Rs"))) for d, v in (("d1", "Rs 8,142 Cr"), ("d2", "Rs 9,142 Cr"))]
    spark.createDataFrame(rows, schema).write.parquet(str(source))
    store = FactStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).parquet(str(source))
    ingest_stream(store, stream, str(tmp_path / "ck")).awaitTermination()
    assert [r.relationship_type for r in store.relationships().collect()] == ["CONTRADICTS"]


def test_empty_tables(spark):
    assert relationships(candidate_pairs(spark.createDataFrame([], FACT))).count() == 0


def twice_over(path):
    """A model that writes a line for each request, and gives one fact twice in an answer."""

    def factory():
        def reply(prompt):
            with open(path, "a") as f:
                f.write(prompt[:40].replace("\n", " ") + "\n")
            item = ("Borealis Works", "revenue", "Rs 12 Cr", None, "revenue of Rs 12 Cr")
            return answer(item, item)

        return reply

    return factory


def test_repeated_facts_stay_one_and_pages_are_asked_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Borealis Works reports revenue of Rs 12 Cr for the whole of the year.")
    pages = read_files(spark, str(tmp_path), plain_text_reader, "*.txt")
    store = FactStore(spark, str(tmp_path / "store"))
    for n in (1, 2, 3):
        assert ingest(store, pages, twice_over(str(tmp_path / "asked")))["facts"] == 1
        assert len((tmp_path / "asked").read_text().splitlines()) == n
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith("_kept")]


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("a", 5, "u"), ("a", 6, "t"), ("c", 7, "v"), ("c", 7, "v")], "id string, n int, s string")
    assert sorted(map(tuple, upsert(old, new, ("s",)).collect())) == [("a", 6, "x"), ("b", 2, "y"), ("c", 7, "v")]


def test_replace_leaves_the_old_version_on_failure(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "s"))
    store.replace("facts", facts(spark, fact("a", "d1")))
    reading = store.read("facts")
    with pytest.raises(Exception, match="no such luck"):
        store.replace("facts", facts(spark, fact("b", "d1")).withColumn("subject", F.raise_error(F.lit("no such luck")).cast("string")))
    assert [r.id for r in store.facts().collect()] == ["a"]
    store.replace("facts", facts(spark, fact("b", "d1")))
    assert [r.id for r in store.facts().collect()] == ["b"] and reading.count() == 1


def test_only_wanted_pages_are_extracted(spark, tmp_path):
    (tmp_path / "a.bin").write_text("first\fsecond\fthird")
    (tmp_path / "b.bin").write_text("one\ftwo")

    def reader(content, wanted):
        pages = content.decode().split("\f")
        assert wanted is None or wanted == {2, 9}
        return len(pages), [(i, p) for i, p in enumerate(pages, 1) if wanted is None or i in wanted]

    got = read_files(spark, str(tmp_path), reader, "*.bin", {"a.bin": [2, 9]})
    assert sorted((r.source_filename, r.page_number, r.page_count, r.text) for r in got.collect()) == [("a.bin", 2, 3, "second"), ("b.bin", 1, 2, "one"), ("b.bin", 2, 2, "two")]
    plain = read_files(spark, str(tmp_path), plain_text_reader, "*.bin", [2])
    assert sorted((r.source_filename, r.page_number) for r in plain.collect()) == [("a.bin", 2), ("b.bin", 2)]
    assert [r.source_filename for r in list_files(spark, str(tmp_path), "*.bin").collect()] == ["a.bin", "b.bin"]
    with pytest.raises(FileNotFoundError):
        read_files(spark, str(tmp_path / "nowhere"), plain_text_reader)


def test_pdf_reader_extracts_wanted_pages_alone(spark, monkeypatch):
    import sys
    import types

    read = []

    class Page:
        def __init__(self, n):
            self.n = n

        def extract_text(self):
            read.append(self.n)
            return None if self.n == 3 else f"page {self.n}"

    fake = types.ModuleType("pypdf")
    fake.PdfReader = lambda stream: types.SimpleNamespace(pages=[Page(i) for i in (1, 2, 3)])
    monkeypatch.setitem(sys.modules, "pypdf", fake)
    reader = pdf_reader()
    assert reader(b"", {1, 3, 7}) == (3, [(1, "page 1"), (3, "")]) and read == [1, 3]
    assert reader(b"", None)[1][1] == (2, "page 2")
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError):
        pdf_reader()


def test_http_model():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        failed = False

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if not Handler.failed:
                Handler.failed = True
                self.send_error(503)
                return
            body = json.dumps({"choices": [{"message": {"content": f"{asked['model']}: {asked['messages'][0]['content']}"}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = HttpModel(f"http://127.0.0.1:{server.server_port}/", "small", "secret")
    assert model.is_available() and model("hello") == "small: hello"
    server.shutdown()
    none = HttpModel("http://127.0.0.1:1/", "small", " ")
    assert not none.is_available()
    with pytest.raises(RuntimeError):
        none("hello")


def test_seed_from_one_document(spark, tmp_path):
    from factloom.operators.store import seed_from_document

    f = {"id": "a", "subject": "Borealis", "predicate": "revenue", "raw_value": "12", "value_type": "numeric", "source_document_id": "d", "source_filename": "d.pdf", "page_number": 2, "evidence_quote": "q", "is_grounded": True}
    t = f | {"id": "b", "normalized_value": "in words", "value_type": "text"}
    edge = {"id": "rel_a_b", "fact_a_id": "a", "fact_b_id": "b", "relationship_type": "CONTRADICTS", "confidence": 0.9, "fact_a": f | {"normalized_value": 12.5}, "fact_b": t}
    (tmp_path / "run.json").write_text(json.dumps({"all_facts": [f | {"normalized_value": 12.5}, t], "relationships": [edge]}, indent=1))
    got, edges = seed_from_document(spark, str(tmp_path / "run.json"))
    assert sorted((r.id, r.norm_num, r.norm_text) for r in got.collect()) == [("a", 12.5, None), ("b", None, "in words")]
    r = one(edges)
    assert (r.relationship_type, r.fact_a.norm_num, r.fact_b.norm_text) == ("CONTRADICTS", 12.5, "in words")


def test_a_quote_whose_parts_stand_on_the_page_is_not_whole(spark):
    df = spark.createDataFrame([("alpha beta", "beta alpha"), ("alpha beta", "Alpha  beta"), ("page", "")], "page_text string, evidence_quote string")
    assert [(g.score, g.is_whole) for g, in ground(df).select("grounding").collect()] == [(1.0, False), (1.0, True), (0.0, False)]


def test_events_and_dropped_facts_wait_for_no_values(spark):
    answers = spark.createDataFrame([("d", "f", 1, "page", "{}")], "document_id string, source_filename string, page_number int, text string, response string")
    facts_, events = facts_from_answers(answers, filter_ungrounded=True)
    assert "per\\s*cent" not in events._jdf.queryExecution().optimizedPlan().toString()
    plan = facts_._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("per\\s*cent") < plan.index("Filter _settled_is_grounded")  # the filter is below, so it comes first
