"""A store as one JSON document and back."""

import gzip
import json
import shutil

from test_facts import fact, facts

from factloom.functions.schemas import RELATIONSHIP
from factloom.operators.exchange import export_document, seed_document
from factloom.operators.facts import ungrounded_events
from factloom.operators.store import FactStore, seed_from_document


def edge(id_, a, b, kind, confidence):
    return (id_, a[0], b[0], kind, confidence, 'said "so"\n', None, a, b)


def test_round_trip(spark, tmp_path):
    store, other = FactStore(spark, str(tmp_path / "a")), FactStore(spark, str(tmp_path / "b"))
    own = [fact(f"f{i:02}", f"d{i % 3}", norm_num=i / 3, page_number=i % 4 + 1, evidence_quote='a "quote",\nü  {"id":') for i in range(40)]
    own += [fact("t1", "d1", norm_text="12", value_type="text"), fact("t2", "d2", norm_text="Ünï"), fact("t3", "d2", source_filename=None, page_number=None, is_grounded=False)]
    store.save("facts", facts(spark, *own))
    store.save("relationships", spark.createDataFrame([edge("r1", own[0], own[1], "CONTRADICTS", 0.5), edge("r2", own[2], own[40], "CONTRADICTS", 0.9), edge("r3", own[3], own[4], "RECONCILABLE", 0.9)], RELATIONSHIP))
    store.append_events(ungrounded_events(store.read("facts")))
    path = tmp_path / "out" / "run.json"
    export_document(store, str(path))
    document = json.loads(path.read_text(encoding="utf-8"))
    assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["run.json"]
    ids = sorted((f[13] or "", f[14] or 0, f[0]) for f in own)
    assert [f["id"] for f in document["all_facts"]] == [i for *_, i in ids] and document["sample_extracted_facts"] == document["all_facts"][:15]
    value = {f["id"]: f["normalized_value"] for f in document["all_facts"]}
    assert (value["f03"], value["t1"], value["t2"], value["t3"]) == (1.0, "12", "Ünï", None)
    assert document["summary"] == {"documents_count": 3, "facts_count": 43, "grounded_facts_count": 42, "relationships_count": 3, "corroborates_count": 0, "contradicts_count": 2, "reconcilable_count": 1}
    shown = document["showcase"]
    assert shown["corroborates"] is None and shown["contradicts"]["doc_b"]["normalized_value"] == "12" and shown["contradicts"]["confidence"] == 0.9
    assert shown["failure"]["failure_type"] == "ungrounded_evidence" and [r["id"] for r in document["relationships"]] == ["r1", "r2", "r3"]
    seed_document(other, str(path))
    for name in ("facts", "relationships"):
        assert sorted(map(repr, other.read(name).collect())) == sorted(map(repr, store.read(name).collect()))
    assert {r.id: r.extracted_facts_count for r in other.read("documents").collect()} == {"d0": 14, "d1": 14, "d2": 15}
    # Any reader of whole documents finds the same.
    f, e = seed_from_document(spark, str(path))
    assert f.count() == 43 and e.count() == 3
    # Written again in place of the first.
    export_document(other, str(path))
    assert json.loads(path.read_text(encoding="utf-8"))["all_facts"] == document["all_facts"]


def test_empty_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "a"))
    export_document(store, str(tmp_path / "run.json"))
    document = json.loads((tmp_path / "run.json").read_text())
    assert document["all_facts"] == [] == document["relationships"] == document["sample_extracted_facts"] and document["summary"]["facts_count"] == 0
    seed_document(store, str(tmp_path / "run.json"))
    assert store.read("facts").count() == 0


def test_packed_document(spark, tmp_path):
    """Members of gzip, read in parallel; without their table it is a gzip file still. What looks like another line's field is text."""
    store = FactStore(spark, str(tmp_path / "a"))
    own = [fact(f'f{i:02}","fact_a_id":', f"d{i % 3}", norm_num=i / 3, evidence_quote='ü\n{"id":"x","fact_a_id":1', page_number=i % 4 + 1) for i in range(40)]
    store.save("facts", facts(spark, *own))
    store.save("relationships", spark.createDataFrame([edge("r1", own[0], own[1], "CONTRADICTS", 0.5), edge("r2", own[2], own[3], "RECONCILABLE", 0.9)], RELATIONSHIP))
    path = tmp_path / "run.json.gz"
    for seeded in ("b", "c"):
        export_document(store, str(path))
        document = json.loads(gzip.decompress(path.read_bytes()))
        assert len(document["all_facts"]) == 40 and [r["id"] for r in document["relationships"]] == ["r1", "r2"]
        members = spark.read.parquet(f"{path}.members").orderBy("at").collect()
        assert len(members) > 3 and sum(m.bytes for m in members) == path.stat().st_size
        if seeded == "c":
            shutil.rmtree(f"{path}.members")
        other = FactStore(spark, str(tmp_path / seeded))
        seed_document(other, str(path))
        for name in ("facts", "relationships"):
            assert sorted(map(repr, other.read(name).collect())) == sorted(map(repr, store.read(name).collect()))
