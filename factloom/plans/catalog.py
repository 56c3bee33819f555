"""Queries by name; each takes (spark, sf_dir) and covers a family of operators over whole tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.evidence import ground, matching_form
from factloom.functions.naming import predicate_cluster, subject_key
from factloom.functions.periods import compare_periods, normalize_period
from factloom.functions.values import normalize_values, parse_values
from factloom.operators import views
from factloom.operators.classify import relationships, undecided
from factloom.operators.exchange import export_document, seed_document
from factloom.operators.facts import facts_from_answers, ungrounded_events
from factloom.operators.pairing import candidate_pairs
from factloom.operators.salience import salient_pages
from factloom.operators.store import FactStore, export_json, rebuilt_documents, seed, upsert
from factloom.plans.pipeline import relate, relate_noted, relationship_rows, save_facts, shared_dir
from factloom.plans.synthetic import NOTATIONS, answers, line_facts, order_facts, raw_values, text_facts
from factloom.sources.files import scan_files, text_pages
from factloom.sources.ledger import Ledger
from factloom.sources.models import ask_about_pages, judged_pairs
from factloom.sources.pages import document_id, documents_of, pages_from_text, select_pages

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def relate_flagship(spark, sf_dir):
    """Grounded facts to relationships: the whole second half of the pipeline."""
    return relationship_rows(order_facts(spark, sf_dir)).select("id", "fact_a_id", "fact_b_id", "relationship_type", "confidence", "contextual_difference")


@query
def parse_numeric(spark, sf_dir):
    return parse_values(raw_values(spark, sf_dir), "raw_value").select("id", "raw_value", "value.num", "value.unit", "value.value_type")


@query
def normalize_context(spark, sf_dir):
    """All values in their seven notations, with a unit that stands apart, or beside the number in the quote or on the page, or whose separator became a point. Bare numbers (the seventh notation) take smaller ones but for every fifth order."""
    r = raw_values(spark, sf_dir)
    bare = (F.col("n") + F.col("k")) % 7 == 6
    kind, short = F.col("k") % 5, F.concat((F.col("k") % 900 + 100).cast("string"), F.lit(".250"))
    small = (F.col("k") % 1000).cast("string")
    beside = F.when(bare, F.concat(F.lit("it was Rs "), small, F.lit(" bn in all"))).otherwise(F.concat(F.lit("it was "), F.col("raw_value"), F.lit(" in all")))
    r = r.select(
        "id",
        F.when(~bare | (kind == 0), F.col("raw_value")).when(kind == 3, short).otherwise(small).alias("raw_value"),
        F.when(kind.isin(0, 1), F.lit("₹ Cr")).when(kind == 2, F.lit("INR million")).when(kind == 3, F.lit("INR crore")).alias("raw_unit"),
        F.when(kind == 3, F.lit("Rs table 7,224 and 8,142")).when(kind == 4, beside).alias("evidence_quote"),
        F.when(~bare & (kind == 1), F.concat(F.lit("all in Rs: "), F.col("raw_value"), F.lit(" bn"))).alias("source_context"),
    )
    return normalize_values(r).select("id", "raw_value", "value.num", "value.text", "value.unit", "value.value_type")


@query
def ground_text_norm(spark, sf_dir):
    form = matching_form(F.concat(F.lit("“Rs” – ‘₹5’ (1, 2) "), F.col("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(form).cast("long").alias("n"), F.md5(form).alias("form_md5"))


def _quotes(spark, sf_dir):
    """Each document with a quote: even ids one of its own passages, odd ones a benchmark passage."""
    d, b = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    items = b.agg(F.count("*").alias("items")).withColumn("_one", F.lit(1))
    d = d.withColumn("_one", F.lit(1)).join(items, "_one").withColumn("item_id", F.col("doc_id") % F.col("items"))
    b = b.select("item_id", F.col("text").alias("passage"))
    own = F.concat(F.substring("text", 21, 40), F.lit("\n  (3) "), F.substring("text", 61, 40))
    return d.join(b, "item_id", "left").select("doc_id", F.col("text").alias("page_text"), F.when(F.col("doc_id") % 2 == 0, own).otherwise(F.col("passage")).alias("evidence_quote"))


@query
def ground_exact(spark, sf_dir):
    g = ground(_quotes(spark, sf_dir)).filter("grounding.is_whole")
    return g.select("doc_id", "grounding.is_grounded")


def _mixed_quotes(spark, sf_dir):
    """A passage of every document with foreign words put in; short, empty and missing texts too."""
    d = _t(spark, sf_dir, "documents")
    page = F.coalesce("text", F.lit(""))
    mixed = F.concat(F.substring(page, 1, 60), F.when(F.col("doc_id") % 3 == 0, F.lit(" qqxx ")).otherwise(F.lit(" qqxx wwzz vvkk ")), F.substring(page, 61, 50))
    return ground(d.select("doc_id", F.col("text").alias("page_text"), mixed.alias("evidence_quote")))


@query
def ground_scores(spark, sf_dir):
    return _mixed_quotes(spark, sf_dir).select("doc_id", "grounding.is_grounded", F.col("grounding.score").alias("score"))


@query
def ground_notes(spark, sf_dir):
    """What grounding says of passages with foreign words, and of every document's own passages."""
    own = _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page_text"), F.concat(F.lit(" "), F.substring("text", 11, 60), F.lit("\n")).alias("evidence_quote"))
    return _mixed_quotes(spark, sf_dir).unionByName(ground(own)).select("doc_id", F.md5("grounding.note").alias("note_md5"), (F.col("grounding.score") == 1).alias("whole"))


_PREDICATES = ("Total Revenue", "operating-profit", "pin codes covered", "Team Size", "active customers", "Registered Office", "corporate hq address", "office", "Board Member", "Real GDP growth", "CPI", "annual shipment volume count", "freight", "Something else")


@query
def predicate_clusters(spark, sf_dir):
    names = F.array(*(F.lit(p) for p in _PREDICATES))
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(names, (F.col("p_partkey") % len(_PREDICATES) + 1).cast("int")), F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("p_type")))).alias("predicate"))
    return p.select("p_partkey", "predicate", predicate_cluster(F.col("predicate")).alias("cluster"))


@query
def subject_keys(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    subject = F.concat(F.lit("The "), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" Limited")).when(F.col("c_custkey") % 3 == 1, F.lit(" Pvt. Ltd")).otherwise(F.lit(", Inc")))
    return c.select("c_custkey", subject.alias("subject"), subject_key(subject).alias("subject_key"))


def _periods(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    yy = F.lpad((F.col("y") % 100).cast("string"), 2, "0")
    kind = F.col("o_orderkey") % 6
    text = F.when(kind == 0, F.concat(F.lit("FY"), yy)).when(kind == 1, F.concat(F.lit("Fiscal  "), yy)).when(kind == 2, F.lit("As of  March 31, 2024")).when(kind == 3, F.lit("FY2023-24")).when(kind == 4, F.lit("Q4 FY24"))
    return o.select("o_orderkey", text.alias("period"), F.concat(F.lit("fy "), yy).alias("other"))


@query
def time_normalize(spark, sf_dir):
    return _periods(spark, sf_dir).select("o_orderkey", "period", normalize_period(F.col("period")).alias("normalized"))


@query
def time_compare(spark, sf_dir):
    p = _periods(spark, sf_dir).withColumn("c", compare_periods(F.col("period"), F.col("other")))
    return p.select("o_orderkey", "c.same", "c.reason")


def _pair_ids(facts):
    return candidate_pairs(facts).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query
def match_modes(spark, sf_dir):
    """All facts in one go: where two documents share a predicate under a key, facts of shared predicates are paired, elsewhere all that fit."""
    p = candidate_pairs(order_facts(spark, sf_dir))
    return p.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), (F.col("a.predicate") == F.col("b.predicate")).alias("shared"))


@query
def match_closest(spark, sf_dir):
    return _pair_ids(line_facts(spark, sf_dir))


@query
def match_across_documents(spark, sf_dir):
    """Lines of one document meet its other lines under their keys, but only facts of different documents are paired."""
    p = candidate_pairs(line_facts(spark, sf_dir))
    return p.groupBy(F.col("a.source_document_id").alias("doc_a"), F.col("b.source_document_id").alias("doc_b")).agg(F.count("*").alias("pairs"), F.countDistinct("a.subject").alias("subjects"))


def _edges(spark, sf_dir):
    return relationships(candidate_pairs(order_facts(spark, sf_dir)))


@query
def classify_numeric(spark, sf_dir):
    return _edges(spark, sf_dir).select("id", "relationship_type", "confidence")


@query
def classify_scope(spark, sf_dir):
    return _edges(spark, sf_dir).filter("contextual_difference like 'Standalone%'").select("id", "relationship_type", "contextual_difference", "short_explanation")


@query
def classify_address(spark, sf_dir):
    e = relationships(candidate_pairs(text_facts(spark, sf_dir).filter("predicate = 'office_address'")))
    return e.select("id", "relationship_type", "confidence")


@query
def classify_director(spark, sf_dir):
    e = relationships(candidate_pairs(text_facts(spark, sf_dir).filter("predicate = 'board_director'")))
    return e.select("id", "relationship_type", "confidence", "contextual_difference")


@query
def undecided_pairs(spark, sf_dir):
    u = undecided(candidate_pairs(text_facts(spark, sf_dir)))
    return u.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query
def relationship_counts(spark, sf_dir):
    return views.relationship_counts(_edges(spark, sf_dir))


@query
def corpus_metrics(spark, sf_dir):
    f = order_facts(spark, sf_dir)
    return views.corpus_metrics(f.select("source_document_id").distinct(), f)


@query
def doc_counts(spark, sf_dir):
    return views.document_counts(order_facts(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    return views.summary(order_facts(spark, sf_dir), _edges(spark, sf_dir))


@query
def seed_rebuild(spark, sf_dir):
    return rebuilt_documents(order_facts(spark, sf_dir)).drop("warnings", "created_at")


@query
def provenance(spark, sf_dir):
    return views.provenance_check(order_facts(spark, sf_dir))


@query
def salient_page_choice(spark, sf_dir):
    return salient_pages(pages_from_text(_t(spark, sf_dir, "documents")), 8).select("document_id", "page_number", "char_count")


@query
def chosen_pages(spark, sf_dir):
    """Explicit page lists for some documents, all pages of the others."""
    p = pages_from_text(_t(spark, sf_dir, "documents"))
    wanted = p.filter("page_number = 1 and cast(document_id as bigint) % 2 = 0").select("source_filename", F.array(F.lit(2), F.lit(5), F.lit(900)).alias("wanted"))
    return select_pages(p, wanted).select("document_id", "page_number", "char_count")


@query
def low_text_warnings(spark, sf_dir):
    p = pages_from_text(_t(spark, sf_dir, "documents"))
    return p.filter(F.size("warnings") > 0).select("document_id", "page_number", F.element_at("warnings", 1).alias("warning"))


@query
def document_rows(spark, sf_dir):
    d = documents_of(pages_from_text(_t(spark, sf_dir, "documents")))
    return d.select("id", "filename", "page_count", "processed_pages", F.size("warnings").cast("long").alias("n_warnings"), F.element_at(F.when(F.size("warnings") > 0, F.col("warnings")), 1).alias("first_warning"))


@query
def doc_id_hash(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", document_id(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("document_id"))


@query
def facts_search(spark, sf_dir):
    return views.search_facts(order_facts(spark, sf_dir), "TURNOVER", filename="B.pdf", grounded=True).select("id", "predicate")


@query
def rels_search(spark, sf_dir):
    return views.search_relationships(_edges(spark, sf_dir), "order 1", "RECONCILABLE").select("id")


@query
def facts_by_doc(spark, sf_dir):
    return order_facts(spark, sf_dir).filter("source_document_id = 'doc-A' and is_grounded").select("id", "page_number", "norm_num").orderBy("page_number", "id")


@query
def ungrounded(spark, sf_dir):
    return views.search_facts(order_facts(spark, sf_dir), grounded=False).select("id", "confidence", "extraction_notes")


@query
def fact_cards(spark, sf_dir):
    return views.fact_cards(order_facts(spark, sf_dir))


@query
def document_audit(spark, sf_dir):
    return views.document_audit(rebuilt_documents(order_facts(spark, sf_dir)))


@query
def topn_sample(spark, sf_dir):
    """The report of the first fifteen facts."""
    return views.first_facts(order_facts(spark, sf_dir), 15).select("id", "source_filename", "page_number")


@query
def upsert_facts(spark, sf_dir):
    f = order_facts(spark, sf_dir).select("id", "raw_value", "evidence_quote", "page_number", "confidence")
    k = F.substring("id", 3, 20).cast("long")
    old = f.filter(k % 3 != 0)
    new = f.filter(k % 3 != 1).withColumns({"raw_value": F.concat(F.lit("new "), F.col("raw_value")), "evidence_quote": F.lit("new"), "confidence": F.lit(0.5)})
    return upsert(old, new, ("page_number", "evidence_quote"))


@query
def upsert_documents(spark, sf_dir):
    d = rebuilt_documents(order_facts(spark, sf_dir)).select("id", "filename", "page_count", "processed_pages", "extracted_facts_count")
    new = d.withColumns({"filename": F.lit("renamed.pdf"), "extracted_facts_count": F.col("extracted_facts_count") + 1}).unionByName(d.withColumns({"id": F.concat("id", F.lit("-2"))}))
    return upsert(d, new, ("filename", "page_count"))


@query
def facts_ingest(spark, sf_dir):
    facts, _ = facts_from_answers(answers(spark, sf_dir))
    return facts.select("source_document_id", "predicate", "norm_num", "unit", "value_type", "comparison_key", "is_grounded", "confidence")


@query
def failure_events(spark, sf_dir):
    _, events = facts_from_answers(answers(spark, sf_dir))
    return events.select("document_filename", "page_number", "failure_type", "what_happened")


@query
def event_audit(spark, sf_dir):
    return views.event_audit(ungrounded_events(order_facts(spark, sf_dir)))


@query
def json_export(spark, sf_dir):
    """Facts as JSON documents, read again."""
    f = order_facts(spark, sf_dir).select("id", "subject", "norm_num", "is_grounded")
    lines = f.select("id", F.to_json(F.struct("id", "subject", "norm_num", "is_grounded")).alias("doc"))
    back = lines.select(F.from_json("doc", "id string, subject string, norm_num double, is_grounded boolean").alias("x"))
    return back.select("x.*")


@query
def parse_notations(spark, sf_dir):
    """Every magnitude with and without a currency, plain numbers, sentences and empty values, one of them for each line item."""
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("int").cast("string").alias("q"))
    kind = (F.col("id") % len(NOTATIONS)).cast("int")
    part = lambda i: F.get(F.array(*(F.lit(n[i]) for n in NOTATIONS)), kind)
    values = li.select("id", F.concat(part(0), F.when(part(3), F.col("q")).otherwise(F.lit("")), part(1)).alias("raw_value"))
    return parse_values(values, "raw_value").select("id", "raw_value", "value.num", "value.unit", "value.value_type")


@query
def scope_of_partners(spark, sf_dir):
    """Pairs of one number that counts partners and one that does not, and the rules' words for them."""
    f = order_facts(spark, sf_dir)
    said = F.when(F.col("source_document_id") == "doc-A", F.lit("includes partner staff")).otherwise(F.lit("excludes partner staff"))
    e = relationships(candidate_pairs(f.withColumns({"scope": said, "time_period": F.lit("FY24")})))
    return e.select("id", "relationship_type", "confidence", "contextual_difference")


@query
def facts_of_whole_texts(spark, sf_dir):
    """Facts from answers about every document's whole text."""
    facts, _ = facts_from_answers(answers(spark, sf_dir))
    return facts.select("source_document_id", "predicate", "norm_num", "unit", "comparison_key", "is_grounded", "confidence")


@query
def events_of_whole_texts(spark, sf_dir):
    _, events = facts_from_answers(answers(spark, sf_dir))
    return events.select("document_filename", "failure_type", "what_happened")


@query
def values_in_context(spark, sf_dir):
    """All seven notations with what stands beside them (see normalize_context)."""
    return QUERIES["normalize_context"](spark, sf_dir).select("id", "raw_value", "num", "unit", "value_type")


def _filled_store(spark, sf_dir) -> FactStore:
    """A store below the shared folder: facts saved twice, in two halves that overlap, with repeated rows."""
    store = FactStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    f = order_facts(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("long")
    store.save("facts", f.filter(k % 3 != 0).unionByName(f.filter(k % 7 == 1)))
    store.save("facts", f.filter(k % 3 != 1).withColumn("confidence", F.lit(0.5)))
    return store


@query
def store_facts(spark, sf_dir):
    return _filled_store(spark, sf_dir).facts(grounded_only=True, document_id="doc-B").select("id", "confidence", "page_number")


@query
def store_relationships(spark, sf_dir):
    store = _filled_store(spark, sf_dir)
    relate(store)
    return store.relationships("CONTRADICTS").select("id", "fact_a_id", "fact_b_id", "confidence")


@query
def store_documents(spark, sf_dir):
    store = _filled_store(spark, sf_dir)
    store.save("documents", rebuilt_documents(store.facts()))
    store.save("documents", rebuilt_documents(store.facts()).withColumns({"filename": F.lit("other.pdf"), "status": F.lit("again")}))
    return store.documents().select("id", "filename", "extracted_facts_count", "status")


@query
def store_events(spark, sf_dir):
    """Events appended in two parts, as two ingestions do."""
    store = _filled_store(spark, sf_dir)
    events = ungrounded_events(store.facts())
    store.append_events(events.filter("document_filename = 'A.pdf'"))
    store.append_events(events.filter("document_filename <> 'A.pdf'"))
    return store.events().select("document_filename", "page_number", "failure_type", "what_happened")


@query
def store_cleared(spark, sf_dir):
    store = _filled_store(spark, sf_dir)
    store.clear()
    store.replace("facts", order_facts(spark, sf_dir).filter("not is_grounded"))
    counts = [store.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "facts", "relationships", "processing_events")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query
def seeded_store(spark, sf_dir):
    """Facts and relationships exported as JSON, and a second store filled from that."""
    store = _filled_store(spark, sf_dir)
    relate(store)
    export_json(store.read("facts"), store.relationships(), f"{store.base}/export")
    other = FactStore(spark, f"{store.base}-seeded")
    seed(other, f"{store.base}/export")
    store.drop(store.base)
    f = other.read("facts").select("id", F.col("norm_num").alias("num"))
    return f.unionByName(other.relationships().select("id", F.col("fact_b.norm_num").alias("num"))).unionByName(other.documents().select("id", F.col("extracted_facts_count").cast("double").alias("num")))


@query
def relationships_by_batches(spark, sf_dir):
    """A store filled in two batches, the second one delivered twice: it corrects wrong numbers and brings facts that were not there. After each batch only the keys that it changed are related anew."""
    store = FactStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    f = order_facts(spark, sf_dir)
    k = F.substring("id", 3, 20).cast("long")
    wrong = f.filter(k % 5 == 0).withColumn("norm_num", F.when(F.col("source_document_id") == "doc-A", F.col("norm_num") * 3).otherwise(F.col("norm_num")))
    last = f.filter((k % 5 == 0) | (k % 7 == 1))
    for batch in (f.filter((k % 5 != 0) & (k % 7 != 1)).unionByName(wrong), last, last):
        save_facts(store, batch)
        relate_noted(store)
    return store.relationships().select("id", "fact_a_id", "fact_b_id", "relationship_type", "confidence")


@query
def events_ingested_twice(spark, sf_dir):
    """Events of all answers saved twice: what happens again is no other event."""
    store = FactStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for _ in range(2):
        store.append_events(facts_from_answers(answers(spark, sf_dir))[1])
    return store.events().select("document_filename", "failure_type", "what_happened")


@query
def grounded_facts_of_texts(spark, sf_dir):
    """Only the facts whose quotes stand on their pages; the events tell of the others."""
    facts, _ = facts_from_answers(answers(spark, sf_dir), filter_ungrounded=True)
    return facts.select("source_document_id", "predicate", "norm_num", "unit", "is_grounded", "confidence")


@query
def pages_of_files(spark, sf_dir):
    """Every document written as a page of some text file, below a line with its id, and the pages of all files read through the data source. What follows a file's last form feed is no document."""
    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    page = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "\f", " "))
    _t(spark, sf_dir, "documents").select(page.alias("value")).write.option("lineSep", "\f").text(at)
    pages = scan_files(spark, at, text_pages, "*.txt").filter("page_number < page_count")
    return pages.select(F.regexp_extract("text", r"^doc (\d+)", 1).cast("long").alias("doc_id"), "char_count", F.md5("text").alias("text_md5"))


def _page_model():
    """Stands for a model: one fact a page, its value the page's length, its quote from the page."""

    def model(prompt: str) -> str:
        page = prompt.split("\nPage:\n", 1)[1]
        item = {"subject": "The Page Ltd", "predicate": "Net_Profit", "raw_value": f"Rs {len(page)} million", "evidence_quote": page[10:50]}
        return f"```json\n{json.dumps({'facts': [item]})}\n```"

    return model


def _no_model():
    raise RuntimeError("asked again")


@query
def facts_by_model(spark, sf_dir):
    """Facts of whole texts by way of a model's answers. All pages are asked about twice with one ledger; the second time there is no model to ask."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", "page model")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    pages = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), name.alias("source_filename"), F.lit(1).alias("page_number"), "text")
    ask_about_pages(pages, _page_model, ledger)
    facts, _ = facts_from_answers(ask_about_pages(pages, _no_model, ledger))
    return facts.select("source_document_id", "predicate", "norm_num", "unit", "comparison_key", "is_grounded")


def _pair_model():
    """Stands for a model: its word about a customer goes by the number in its name. Some answers need repair, some name no known type."""

    def model(prompt: str) -> str:
        n = int(re.search(r"[Cc]ustomer#0*(\d+)", prompt)[1])
        if n % 5 == 0 and "is not" not in prompt:
            return f"no JSON about customer#{n}"
        kinds = ({"relationship_type": "corroborates"}, {"relationship_type": "CONTRADICTS", "confidence": 0.6, "short_explanation": "so it is"}, {"relationship_type": "UNSURE"}, {"relationship_type": "Reconcilable", "confidence": 0.7, "contextual_difference": "scope"})
        return json.dumps(kinds[n % 4])

    return model


@query
def pairs_judged(spark, sf_dir):
    """What a model says of all pairs that no rule decides."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", "pair model")
    e = judged_pairs(undecided(candidate_pairs(text_facts(spark, sf_dir))), _pair_model, ledger)
    return e.select("id", "fact_a_id", "fact_b_id", "relationship_type", "confidence", "short_explanation", "contextual_difference")


@query
def document_exchange(spark, sf_dir):
    """A store exported as one JSON document, packed, and a second store filled from that."""
    store = _filled_store(spark, sf_dir)
    relate(store)
    at = f"{store.base}-run.json.gz"
    export_document(store, at)
    other = FactStore(spark, f"{store.base}-seeded")
    seed_document(other, at)
    for path in (store.base, at, f"{at}.members"):
        store.drop(path)
    f = other.read("facts").select("id", F.col("norm_num").alias("num"))
    return f.unionByName(other.relationships().select("id", F.col("fact_b.norm_num").alias("num"))).unionByName(other.documents().select("id", F.col("extracted_facts_count").cast("double").alias("num")))


@query
def text_values(spark, sf_dir):
    """Values without a number, their blanks uneven, with and without a unit."""
    p = _t(spark, sf_dir, "part")
    raw = F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("  ")), F.lit("\n plating"))
    unit = F.when(F.col("p_size") % 3 == 1, F.lit("")).when(F.col("p_size") % 3 == 2, F.lit("finish"))
    values = p.select("p_partkey", raw.alias("raw_value"), unit.alias("raw_unit"), F.lit("as shown").alias("evidence_quote"), F.lit(None).cast("string").alias("source_context"))
    return normalize_values(values).select("p_partkey", "value.num", "value.text", "value.unit", "value.value_type")
