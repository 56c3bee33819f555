"""DuckDB SQL with the same rows as the query of that name."""

from __future__ import annotations

from factloom.plans.synthetic import NOTATIONS

ORACLES: dict[str, str] = {}

_RAW = """
raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS k, l_linenumber AS n, (l_linenumber + l_orderkey) % 7 AS kind, l_extendedprice AS p, l_quantity::int AS q,
         CASE (l_linenumber + l_orderkey) % 7 WHEN 0 THEN '₹' || format('{:,.2f}', round(l_extendedprice, 2)) || ' million' WHEN 1 THEN '₹' || format('{:,.2f}', round(l_extendedprice, 2)) || ' Cr'
           WHEN 2 THEN (l_quantity::int)::varchar || '.5%' WHEN 3 THEN (l_quantity::int)::varchar || 'K tonnes' WHEN 4 THEN '$' || (l_quantity::int)::varchar || ' bn'
           WHEN 5 THEN 'Rs ' || (l_quantity::int)::varchar || ' lakh' ELSE format('{:,.2f}', round(l_extendedprice, 2)) END AS raw_value
  FROM lineitem)"""

_FACTS = """
line AS (SELECT l_orderkey AS k, sum(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2)) * (1 + l_tax::decimal(4,2))) AS v, max(year(l_shipdate)) AS y FROM lineitem GROUP BY 1),
base AS (SELECT 'A' AS side, o_orderkey AS k, o_totalprice::decimal(12,2)::double AS v, year(o_orderdate) AS y FROM orders UNION ALL SELECT 'B', k, round(v, 2)::double, y FROM line),
facts AS (
  SELECT side || '-' || k AS id, k, side, 'Order ' || k || ' Limited' AS subject,
         CASE WHEN k % 3 = 0 THEN 'total_revenue' WHEN side = 'B' AND k % 3 = 1 THEN 'annual_turnover' ELSE 'revenue_from_services' END AS predicate,
         'value of ' || k AS raw_value, v AS norm_num, 'FY' || lpad((y % 100)::varchar, 2, '0') AS time_period, '20' || lpad((y % 100)::varchar, 2, '0') AS yr,
         CASE WHEN side = 'B' AND k % 13 = 0 THEN 'standalone' ELSE 'consolidated' END AS scope,
         'doc-' || side AS source_document_id, side || '.pdf' AS source_filename, (k % 40 + 1)::int AS page_number, 'order ' || k AS evidence_quote,
         k % 11 <> 0 AS is_grounded, CASE WHEN k % 11 <> 0 THEN 1.0 ELSE 0.2 END::double AS confidence, CASE WHEN k % 11 = 0 THEN 'UNGROUNDED: not found' END AS extraction_notes
  FROM base)"""


def _edges(where: str = "true") -> str:
    return f"""
pairs AS (SELECT a.k, a.id AS a_id, b.id AS b_id, a.norm_num AS va, b.norm_num AS vb, a.yr AS ya, b.yr AS yb, a.time_period AS ta, b.time_period AS tb, a.scope AS sa, b.scope AS sb, a.subject, a.predicate, a.raw_value
          FROM facts a JOIN facts b ON a.k = b.k AND a.side = 'A' AND b.side = 'B' WHERE {where}),
found AS (SELECT *, abs(va - vb) / greatest(abs(va), abs(vb), 1e-6) AS diff, (sa = 'standalone') <> (sb = 'standalone') AS scoped FROM pairs),
edges AS (
  SELECT *, 'rel_' || a_id || '_' || b_id AS id,
    CASE WHEN diff <= 0.005 AND ya = yb AND NOT scoped THEN 'CORROBORATES' WHEN ya <> yb OR scoped THEN 'RECONCILABLE' WHEN diff > 0.05 THEN 'CONTRADICTS' ELSE 'RECONCILABLE' END AS relationship_type,
    CASE WHEN diff <= 0.005 AND ya = yb AND NOT scoped THEN 0.98 WHEN ya <> yb OR scoped THEN 0.95 WHEN diff > 0.05 THEN 0.90 ELSE 0.88 END::double AS confidence,
    CASE WHEN diff <= 0.005 AND ya = yb AND NOT scoped THEN NULL WHEN ya <> yb THEN 'Different reporting periods / years (' || ya || ' in ''' || ta || ''' vs ' || yb || ' in ''' || tb || ''')'
         WHEN scoped THEN 'Standalone vs consolidated reporting (''' || sa || ''' vs ''' || sb || ''')' WHEN diff > 0.05 THEN NULL
         ELSE 'Minor reporting/rounding variation (~' || printf('%.2f', round(diff * 100, 2)) || '% difference)' END AS contextual_difference
  FROM found)"""


ORACLES["relate_flagship"] = f"WITH {_FACTS}, {_edges('a.is_grounded')} SELECT id, a_id AS fact_a_id, b_id AS fact_b_id, relationship_type, confidence, contextual_difference FROM edges"
ORACLES["classify_numeric"] = f"WITH {_FACTS}, {_edges()} SELECT id, relationship_type, confidence FROM edges"
ORACLES["classify_scope"] = f"""WITH {_FACTS}, {_edges()} SELECT id, relationship_type, contextual_difference,
  'The apparent numeric divergence (' || raw_value || ' vs ' || raw_value || ') is explained by differing scope definitions: ''' || sa || ''' in A.pdf vs ''' || sb || ''' in B.pdf.' AS short_explanation
  FROM edges WHERE contextual_difference LIKE 'Standalone%'"""
ORACLES["relationship_counts"] = f"WITH {_FACTS}, {_edges()} SELECT count(*) FILTER (relationship_type = 'CORROBORATES') AS corroborates, count(*) FILTER (relationship_type = 'CONTRADICTS') AS contradicts, count(*) FILTER (relationship_type = 'RECONCILABLE') AS reconcilable FROM edges"
ORACLES["run_summary"] = f"""WITH {_FACTS}, {_edges()}, e AS (SELECT count(*) AS relationships_count, count(*) FILTER (relationship_type = 'CORROBORATES') AS corroborates_count, count(*) FILTER (relationship_type = 'CONTRADICTS') AS contradicts_count, count(*) FILTER (relationship_type = 'RECONCILABLE') AS reconcilable_count FROM edges)
  SELECT count(DISTINCT source_document_id) AS documents_count, count(*) AS facts_count, count(*) FILTER (is_grounded) AS grounded_facts_count, any_value(relationships_count) AS relationships_count, any_value(corroborates_count) AS corroborates_count, any_value(contradicts_count) AS contradicts_count, any_value(reconcilable_count) AS reconcilable_count FROM facts, e"""
ORACLES["rels_search"] = f"WITH {_FACTS}, {_edges()} SELECT id FROM edges WHERE relationship_type = 'RECONCILABLE' AND contains(lower(subject), 'order 1')"
ORACLES["parse_numeric"] = f"""WITH {_RAW} SELECT id, raw_value,
  CASE kind WHEN 0 THEN round(replace(format('{{:.2f}}', round(p, 2)), ',', '')::double / 10, 4) WHEN 1 THEN round(p, 2) WHEN 2 THEN q + 0.5 WHEN 3 THEN round(q / 1000.0, 4) WHEN 4 THEN q * 1000.0 WHEN 5 THEN round(q / 100.0, 4) ELSE round(p, 2) END::double AS num,
  CASE kind WHEN 0 THEN 'INR crore' WHEN 1 THEN 'INR crore' WHEN 2 THEN 'percent' WHEN 3 THEN 'million tonnes' WHEN 4 THEN 'USD million' WHEN 5 THEN 'INR crore' ELSE 'count' END AS unit,
  CASE kind WHEN 2 THEN 'percentage' WHEN 3 THEN 'numeric' WHEN 6 THEN 'numeric' ELSE 'currency' END AS value_type FROM raw"""
ORACLES["normalize_context"] = f"""WITH {_RAW}, r AS (SELECT id, k, k % 5 AS c, p, CASE k % 5 WHEN 0 THEN raw_value WHEN 3 THEN (k % 900 + 100)::varchar || '.250' ELSE (k % 1000)::varchar END AS raw_value FROM raw WHERE kind = 6)
  SELECT id, raw_value, CASE c WHEN 0 THEN round(p, 2) WHEN 1 THEN k % 1000 WHEN 2 THEN k % 1000 WHEN 3 THEN (k % 900 + 100) * 1000 + 250 ELSE (k % 1000) * 100 END::double AS num, NULL::varchar AS text,
  CASE c WHEN 0 THEN CASE WHEN contains(raw_value, ',') THEN 'INR' ELSE 'INR crore' END WHEN 1 THEN 'INR crore' WHEN 2 THEN 'million' ELSE 'INR crore' END AS unit, CASE c WHEN 2 THEN 'numeric' ELSE 'currency' END AS value_type FROM r"""
_FORM = "lower(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, '“', '\"'), '”', '\"'), '‘', ''''), '’', ''''), '–', '-'), '—', '-'), '­', ''), '₹', 'Rs'), '\\(\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\)', ' ', 'g'), '\\s+', ' ', 'g')))"
ORACLES["ground_text_norm"] = f"WITH f AS (SELECT doc_id, {_FORM.format(x="('“Rs” – ‘₹5’ (1, 2) ' || text)")} AS form FROM documents) SELECT doc_id, length(form)::bigint AS n, md5(form) AS form_md5 FROM f"
ORACLES["ground_exact"] = f"""WITH q AS (SELECT doc_id, d.text AS page, CASE WHEN doc_id % 2 = 0 THEN substr(d.text, 21, 40) || chr(10) || '  (3) ' || substr(d.text, 61, 40) ELSE b.text END AS quote
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
  SELECT doc_id, true AS is_grounded FROM q WHERE page <> '' AND quote <> '' AND (contains(page, regexp_replace(quote, '^\\s+|\\s+$', '', 'g')) OR contains({_FORM.format(x="page")}, {_FORM.format(x="quote")}))"""
ORACLES["ground_scores"] = f"""WITH q AS (SELECT doc_id, coalesce(text, '') = '' AS none, {_FORM.format(x="coalesce(text, '')")} AS page, {_FORM.format(x="substr(coalesce(text, ''), 1, 60) || CASE WHEN doc_id % 3 = 0 THEN ' qqxx ' ELSE ' qqxx wwzz vvkk ' END || substr(coalesce(text, ''), 61, 50)")} AS quote FROM documents),
  t AS (SELECT doc_id, none, page, list_filter(string_split(quote, ' '), lambda x: length(x) > 1) AS t, list_distinct(string_split(page, ' ')) AS p FROM q),
  s AS (SELECT doc_id, none, len(list_filter(t, lambda x: list_contains(p, x))) / len(t) AS hits, len(t) AS n, list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS runs, page FROM t),
  r AS (SELECT doc_id, CASE WHEN none THEN 0.0 WHEN n >= 3 THEN 0.4 * hits::double + 0.6 * (len(list_filter(runs, lambda x: contains(page, x))) / len(runs))::double ELSE hits END AS score FROM s)
  SELECT doc_id, score >= 0.7 AS is_grounded, round(score, 3) AS score FROM r"""
_P = "regexp_replace(translate(lower(predicate), '- ', '__'), '[^a-z0-9_]', '', 'g')"
ORACLES["predicate_clusters"] = f"""WITH p AS (SELECT p_partkey, (['Total Revenue', 'operating-profit', 'pin codes covered', 'Team Size', 'active customers', 'Registered Office', 'corporate hq address', 'office', 'Board Member', 'Real GDP growth', 'CPI', 'annual shipment volume count', 'freight', 'Something else'])[p_partkey % 14 + 1] || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_type END AS predicate FROM part),
  c AS (SELECT *, {_P} AS c FROM p)
  SELECT p_partkey, predicate, CASE WHEN regexp_matches(c, 'revenue|turnover|sales_income|gross_receipts|topline') THEN 'revenue' WHEN regexp_matches(c, 'ebitda|operating_profit|net_profit|net_income') THEN 'profitability'
    WHEN contains(c, 'pin') AND regexp_matches(c, 'code|reach|cover') THEN 'pin_codes' WHEN regexp_matches(c, 'workforce|team_size|headcount|employee_strength|staff_count') THEN 'workforce'
    WHEN contains(c, 'customer') AND regexp_matches(c, 'active|count|base|total') THEN 'active_customers' WHEN contains(c, 'registered') AND regexp_matches(c, 'office|address') THEN 'registered_office'
    WHEN regexp_matches(c, 'corporate|headquarter|hq') AND regexp_matches(c, 'office|address') THEN 'corporate_office' WHEN regexp_matches(c, 'address|office') THEN 'office_address'
    WHEN regexp_matches(c, 'director|board_member|trustee') THEN 'governance_directorship' WHEN contains(c, 'gdp') AND regexp_matches(c, 'growth|rate|projection|real') THEN 'gdp_growth'
    WHEN regexp_matches(c, 'inflation|cpi|wpi|deflator') THEN 'inflation'
    WHEN regexp_matches(c, 'volume|shipment|tonnage|freight') AND len(list_filter(string_split(c, '_'), lambda t: t NOT IN ('count', 'number', 'total', 'annual', 'quarterly'))) >= 2
      THEN array_to_string(list_filter(string_split(c, '_'), lambda t: t NOT IN ('count', 'number', 'total', 'annual', 'quarterly'))[1:2], '_') ELSE c END AS cluster FROM c"""
ORACLES["subject_keys"] = r"""WITH s AS (SELECT c_custkey, 'The ' || c_name || CASE c_custkey % 3 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Pvt. Ltd' ELSE ', Inc' END AS subject FROM customer)
  SELECT c_custkey, subject, regexp_replace(regexp_replace(lower(subject), '\b(limited|ltd|corporation|inc|private|pvt|the)\b', '', 'g'), '[^a-z0-9]', '', 'g') AS subject_key FROM s"""
_PERIODS = """p AS (SELECT o_orderkey, o_orderkey % 6 AS kind, lpad((year(o_orderdate) % 100)::varchar, 2, '0') AS yy FROM orders),
  t AS (SELECT *, CASE kind WHEN 0 THEN 'FY' || yy WHEN 1 THEN 'Fiscal  ' || yy WHEN 2 THEN 'As of  March 31, 2024' WHEN 3 THEN 'FY2023-24' WHEN 4 THEN 'Q4 FY24' END AS period,
    CASE kind WHEN 0 THEN '20' || yy WHEN 1 THEN '20' || yy WHEN 2 THEN 'as of march 31, 2024' WHEN 3 THEN 'fy2024' WHEN 4 THEN 'q4 2024' ELSE '' END AS normalized, 'fy ' || yy AS other, '20' || yy AS no FROM p)"""
ORACLES["time_normalize"] = f"WITH {_PERIODS} SELECT o_orderkey, period, normalized FROM t"
ORACLES["time_compare"] = f"""WITH {_PERIODS}, y AS (SELECT *, CASE WHEN kind IN (0, 1) THEN normalized WHEN kind IN (2, 4) THEN '2024' END AS ny FROM t)
  SELECT o_orderkey, NOT coalesce(ny <> no, false) AS same, CASE WHEN period IS NULL THEN 'One or both facts lack explicit temporal context' WHEN normalized = no THEN 'Identical reporting period (' || period || ')'
    WHEN contains(normalized, '2024') AND contains(no, '2024') THEN 'Compatible reporting period (FY24 / March 31, 2024)' WHEN ny <> no THEN 'Different reporting periods / years (' || ny || ' in ''' || period || ''' vs ' || no || ' in ''' || other || ''')' ELSE 'Temporally compatible' END AS reason FROM y"""
ORACLES["match_closest"] = """WITH d AS (SELECT o_orderkey AS k, l_linenumber AS n, abs(o_totalprice - l_extendedprice) / greatest(abs(o_totalprice), abs(l_extendedprice), 1.0) AS dist FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
  SELECT 'A-' || k || '-1' AS a_id, 'B-' || k || '-' || n AS b_id FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY dist, n) = 1"""
ORACLES["classify_address"] = "SELECT 'rel_A-office_address-' || c_custkey || '_B-office_address-' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'CONTRADICTS' ELSE 'CORROBORATES' END AS relationship_type, CASE WHEN c_custkey % 4 = 0 THEN 0.92 ELSE 0.95 END::double AS confidence FROM customer"
ORACLES["classify_director"] = "SELECT 'rel_A-board_director-' || c_custkey || '_B-board_director-' || c_custkey AS id, 'RECONCILABLE' AS relationship_type, 0.92::double AS confidence, 'Entity status change over time (resignation in subsequent period)' AS contextual_difference FROM customer WHERE c_custkey % 3 = 0"
ORACLES["undecided_pairs"] = "SELECT 'A-board_director-' || c_custkey AS a_id, 'B-board_director-' || c_custkey AS b_id FROM customer WHERE c_custkey % 3 <> 0"
ORACLES["corpus_metrics"] = f"WITH {_FACTS} SELECT count(DISTINCT source_document_id) AS documents, count(*) AS facts, count(*) FILTER (is_grounded) AS grounded, round(count(*) FILTER (is_grounded)::double / greatest(count(*), 1) * 100, 1) AS grounded_percent FROM facts"
ORACLES["doc_counts"] = f"WITH {_FACTS} SELECT source_document_id, count(*) AS extracted, count(*) FILTER (is_grounded) AS grounded FROM facts GROUP BY 1"
_DOCS = "docs AS (SELECT source_document_id AS id, min(source_filename) AS filename, max(page_number) AS page_count, count(DISTINCT page_number)::int AS processed_pages, count(*)::int AS extracted_facts_count, (count(*) FILTER (is_grounded))::int AS grounded_facts_count, 'processed' AS status FROM facts GROUP BY 1)"
ORACLES["seed_rebuild"] = f"WITH {_FACTS}, {_DOCS} SELECT * FROM docs"
ORACLES["document_audit"] = f"WITH {_FACTS}, {_DOCS} SELECT id, filename, page_count AS pages, processed_pages, extracted_facts_count AS facts, grounded_facts_count AS grounded, status, 0::int AS warnings FROM docs"
ORACLES["upsert_documents"] = f"""WITH {_FACTS}, {_DOCS} SELECT id, filename, page_count, processed_pages, (extracted_facts_count + 1)::int AS extracted_facts_count FROM docs
  UNION ALL SELECT id || '-2', filename, page_count, processed_pages, extracted_facts_count FROM docs"""
ORACLES["provenance"] = f"WITH {_FACTS} SELECT count(*) > 0 AS any_facts, count(*) FILTER (is_grounded) > 0 AS any_grounded, coalesce(bool_and(source_filename <> '' AND page_number >= 1 AND evidence_quote <> ''), true) AS all_sourced FROM facts"
_PAGES = r"pages_ AS (SELECT doc_id::varchar AS document_id, i::int AS page_number, regexp_replace(string_split(text, chr(10))[i], '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_KEYWORDS = ("revenue", "turnover", "ebitda", "profit", "workforce", "employee", "team size", "pin code", "pincode", "shipment", "parcel", "tonnage", "freight", "active customer", "corporate office", "registered office", "director", "resigned", "gdp", "inflation")
_SCORE = r"least(len(regexp_extract_all(t, '\b\d+(?:,\d+)*(?:\.\d+)?\b')), 30) + CASE WHEN page_number <= 3 THEN 25 ELSE 0 END + CASE WHEN contains(lower(t), '(1)') OR contains(lower(t), 'footnote') OR contains(lower(t), 'as of march 31') THEN 15 ELSE 0 END" + "".join(f" + CASE WHEN contains(lower(t), '{k}') THEN 5 ELSE 0 END" for k in _KEYWORDS)
ORACLES["salient_page_choice"] = f"""WITH {_PAGES}, s AS (SELECT *, length(t)::int AS char_count, count(*) OVER (PARTITION BY document_id) AS n, CASE WHEN length(t) >= 100 THEN {_SCORE} END AS score FROM pages_)
  SELECT document_id, page_number, char_count FROM s QUALIFY n <= 8 OR (score IS NOT NULL AND row_number() OVER (PARTITION BY document_id ORDER BY score DESC NULLS LAST, page_number) <= 8)"""
ORACLES["chosen_pages"] = f"WITH {_PAGES} SELECT document_id, page_number, length(t)::int AS char_count FROM pages_ WHERE document_id::bigint % 2 = 1 OR page_number IN (2, 5, 900)"
_WARN = "'Page ' || page_number || ' produced minimal text (' || length(t) || ' chars). May be scanned, graphical, or blank.'"
ORACLES["low_text_warnings"] = f"WITH {_PAGES} SELECT document_id, page_number, {_WARN} AS warning FROM pages_ WHERE length(t) < 50"
ORACLES["document_rows"] = f"WITH {_PAGES} SELECT document_id AS id, 'doc-' || document_id AS filename, count(*)::int AS page_count, count(*)::int AS processed_pages, count(*) FILTER (length(t) < 50) AS n_warnings, min_by({_WARN}, page_number) FILTER (length(t) < 50) AS first_warning FROM pages_ GROUP BY 1"
ORACLES["doc_id_hash"] = "SELECT page_id, substr(sha256(coalesce(html, '')), 1, 16) AS document_id FROM pages"
ORACLES["facts_search"] = f"WITH {_FACTS} SELECT id, predicate FROM facts WHERE source_filename = 'B.pdf' AND is_grounded AND contains(predicate, 'turnover')"
ORACLES["facts_by_doc"] = f"WITH {_FACTS} SELECT id, page_number, norm_num FROM facts WHERE side = 'A' AND is_grounded"
ORACLES["ungrounded"] = f"WITH {_FACTS} SELECT id, confidence, extraction_notes FROM facts WHERE NOT is_grounded"
ORACLES["fact_cards"] = f"WITH {_FACTS} SELECT id, subject, predicate, raw_value, 'USD' AS unit, time_period, scope, 'None' AS qualifiers, (CASE WHEN is_grounded THEN 100 ELSE 20 END)::int AS confidence_percent, substr(evidence_quote, 1, 90) AS quote FROM facts"
ORACLES["topn_sample"] = f"WITH {_FACTS} SELECT id, source_filename, page_number FROM facts ORDER BY source_filename, page_number, id LIMIT 15"
ORACLES["upsert_facts"] = f"""WITH {_FACTS} SELECT id, CASE WHEN k % 3 = 1 THEN raw_value ELSE 'new ' || raw_value END AS raw_value, CASE WHEN k % 3 = 0 THEN 'new' ELSE evidence_quote END AS evidence_quote, page_number, CASE WHEN k % 3 = 1 THEN confidence ELSE 0.5 END::double AS confidence FROM facts"""
ORACLES["facts_ingest"] = f"""WITH d AS (SELECT doc_id, {_FORM.format(x="substr(text, 1, 400)")} AS page, {_FORM.format(x="substr(text, 11, 60)")} AS quote FROM documents WHERE length(text) >= 200 AND doc_id % 10 NOT IN (7, 8))
  SELECT doc_id::varchar AS source_document_id, 'net_profit' AS predicate, round((doc_id % 500)::double / 10, 4) AS norm_num, 'INR crore' AS unit, 'currency' AS value_type, 'company|profitability' AS comparison_key, contains(page, quote) AS is_grounded, CASE WHEN contains(page, quote) THEN 1.0 ELSE 0.2 END::double AS confidence FROM d
  UNION ALL SELECT doc_id::varchar, 'headcount', (doc_id % 1000)::double, 'count', 'numeric', 'company|workforce', false, 0.2::double FROM d"""
ORACLES["failure_events"] = """WITH d AS (SELECT doc_id FROM documents WHERE length(text) >= 200)
  SELECT 'doc-' || doc_id AS document_filename, 1::int AS page_number, 'ungrounded_evidence' AS failure_type, 'Fact ''headcount: ' || (doc_id % 1000) || ''' failed grounding.' AS what_happened FROM d WHERE doc_id % 10 NOT IN (7, 8)
  UNION ALL SELECT 'doc-' || doc_id, 1, 'llm_extraction_error', 'Failed to extract structured JSON from page: ' || CASE WHEN doc_id % 10 = 7 THEN 'the answer is not JSON' ELSE 'an item does not fit the schema' END FROM d WHERE doc_id % 10 IN (7, 8)"""
ORACLES["event_audit"] = f"""WITH {_FACTS} SELECT source_filename AS document, page_number AS page, 'ungrounded_evidence' AS type, 'Fact ''' || predicate || ': ' || raw_value || ''' failed grounding.' AS what,
  'LLM evidence quote ''' || substr(evidence_quote, 1, 60) || '...'' was not found in source text.' AS why, 'Flagged fact as UNGROUNDED with low confidence (0.2).' AS handling, 'Pass the text around the quote to anchor it.' AS improvement FROM facts WHERE NOT is_grounded"""
ORACLES["json_export"] = f"WITH {_FACTS} SELECT id, subject, norm_num, is_grounded FROM facts"
ORACLES["match_modes"] = f"WITH {_FACTS} SELECT a.id AS a_id, b.id AS b_id, a.predicate = b.predicate AS shared FROM facts a JOIN facts b ON a.k = b.k AND a.side = 'A' AND b.side = 'B'"
ORACLES["match_across_documents"] = "SELECT 'doc-A' AS doc_a, 'doc-B' AS doc_b, count(*) AS pairs, count(*) AS subjects FROM (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) HAVING count(*) > 0"


def _notations(part: int) -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return " ".join(f"WHEN {i} THEN {value(n[part])}" for i, n in enumerate(NOTATIONS))


ORACLES["parse_notations"] = f"""WITH l AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_orderkey * 8 + l_linenumber) % {len(NOTATIONS)} AS kind, l_quantity::int AS q FROM lineitem)
  SELECT id, (CASE kind {_notations(0)} END) || CASE WHEN (CASE kind {_notations(3)} END) THEN q::varchar ELSE '' END || (CASE kind {_notations(1)} END) AS raw_value,
    round((CASE kind {_notations(2)} END)::double * q, 4) AS num, CASE kind {_notations(4)} END::varchar AS unit, CASE kind {_notations(5)} END AS value_type FROM l"""
ORACLES["scope_of_partners"] = f"""WITH {_FACTS}, p AS (SELECT 'rel_' || a.id || '_' || b.id AS id FROM facts a JOIN facts b ON a.k = b.k AND a.side = 'A' AND b.side = 'B')
  SELECT id, 'RECONCILABLE' AS relationship_type, 0.95::double AS confidence, 'Differing inclusion of partner agents (''includes partner staff'' vs ''excludes partner staff'')' AS contextual_difference FROM p"""
_ANSWERED = """d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN substr(coalesce(text, ''), greatest(length(coalesce(text, '')) - 79, 1), 60) ELSE substr(coalesce(text, ''), 11, 60) END AS quote, coalesce(text, '') AS page FROM documents),
  g AS (SELECT *, quote <> '' AND contains(page, quote) AS found FROM d WHERE doc_id % 10 NOT IN (7, 8))"""
ORACLES["facts_of_whole_texts"] = f"""WITH {_ANSWERED} SELECT doc_id::varchar AS source_document_id, 'net_profit' AS predicate, round((doc_id % 500)::double / 10, 4) AS norm_num, 'INR crore' AS unit, 'company|profitability' AS comparison_key, found AS is_grounded, (CASE WHEN found THEN 1.0 ELSE 0.2 END)::double AS confidence FROM g
  UNION ALL SELECT doc_id::varchar, 'headcount', (doc_id % 1000)::double, 'count', 'company|workforce', false, 0.2::double FROM g"""
ORACLES["events_of_whole_texts"] = f"""WITH {_ANSWERED} SELECT 'doc-' || doc_id AS document_filename, 'ungrounded_evidence' AS failure_type, 'Fact ''headcount: ' || (doc_id % 1000) || ''' failed grounding.' AS what_happened FROM g
  UNION ALL SELECT 'doc-' || doc_id, 'ungrounded_evidence', 'Fact ''net_profit: Rs ' || (doc_id % 500) || ' million'' failed grounding.' FROM g WHERE NOT found
  UNION ALL SELECT 'doc-' || doc_id, 'llm_extraction_error', 'Failed to extract structured JSON from page: ' || CASE WHEN doc_id % 10 = 7 THEN 'the answer is not JSON' ELSE 'an item does not fit the schema' END FROM documents WHERE doc_id % 10 IN (7, 8)"""
ORACLES["values_in_context"] = f"""WITH {_RAW}, c AS (SELECT *, k % 5 AS c, CASE WHEN kind < 6 OR k % 5 = 0 THEN raw_value WHEN k % 5 = 3 THEN (k % 900 + 100)::varchar || '.250' ELSE (k % 1000)::varchar END AS shown FROM raw)
  SELECT id, shown AS raw_value, (CASE WHEN kind = 0 THEN round(round(p, 2) / 10, 4) WHEN kind = 1 THEN round(p, 2) WHEN kind = 2 THEN q + 0.5 WHEN kind = 3 THEN round(q / 1000.0, 4) WHEN kind = 4 AND c = 4 THEN q * 1000 WHEN kind = 4 THEN q * 100 WHEN kind = 5 THEN round(q / 100.0, 4)
      WHEN c = 0 THEN round(p, 2) WHEN c IN (1, 2) THEN k % 1000 WHEN c = 3 THEN (k % 900 + 100) * 1000 + 250 ELSE (k % 1000) * 100 END)::double AS num,
    CASE WHEN kind = 2 THEN 'percent' WHEN kind = 3 THEN 'million tonnes' WHEN kind = 4 AND c = 4 THEN 'USD million' WHEN kind < 6 THEN 'INR crore' WHEN c = 0 AND contains(shown, ',') THEN 'INR' WHEN c = 2 THEN 'million' ELSE 'INR crore' END AS unit,
    CASE WHEN kind = 2 THEN 'percentage' WHEN kind = 3 OR (kind = 6 AND c = 2) THEN 'numeric' ELSE 'currency' END AS value_type FROM c"""
#: What two saves leave: the second part's confidence, and every fact once.
_STORED = "stored AS (SELECT * REPLACE ((CASE WHEN k % 3 = 1 THEN confidence ELSE 0.5 END)::double AS confidence) FROM facts)"
ORACLES["store_facts"] = f"WITH {_FACTS}, {_STORED} SELECT id, confidence, page_number FROM stored WHERE side = 'B' AND is_grounded"
ORACLES["store_relationships"] = f"WITH {_FACTS}, {_edges('a.is_grounded')} SELECT id, a_id AS fact_a_id, b_id AS fact_b_id, confidence FROM edges WHERE relationship_type = 'CONTRADICTS'"
ORACLES["store_documents"] = f"WITH {_FACTS}, {_DOCS} SELECT id, filename, extracted_facts_count, 'again' AS status FROM docs"
ORACLES["store_events"] = f"WITH {_FACTS} SELECT source_filename AS document_filename, page_number, 'ungrounded_evidence' AS failure_type, 'Fact ''' || predicate || ': ' || raw_value || ''' failed grounding.' AS what_happened FROM facts WHERE NOT is_grounded"
ORACLES["store_cleared"] = f"WITH {_FACTS} SELECT 'facts' AS name, count(*) AS n FROM facts WHERE NOT is_grounded UNION ALL SELECT unnest(['documents', 'relationships', 'processing_events']), 0"
ORACLES["seeded_store"] = f"""WITH {_FACTS}, {_DOCS}, {_edges('a.is_grounded')} SELECT id, norm_num AS num FROM facts UNION ALL SELECT id, vb FROM edges UNION ALL SELECT id, extracted_facts_count::double FROM docs"""
ORACLES["relationships_by_batches"] = f"WITH {_FACTS}, {_edges('a.is_grounded')} SELECT id, a_id AS fact_a_id, b_id AS fact_b_id, relationship_type, confidence FROM edges"
ORACLES["events_ingested_twice"] = ORACLES["events_of_whole_texts"]
ORACLES["grounded_facts_of_texts"] = f"""WITH {_ANSWERED} SELECT doc_id::varchar AS source_document_id, 'net_profit' AS predicate, round((doc_id % 500)::double / 10, 4) AS norm_num, 'INR crore' AS unit, true AS is_grounded, 1.0::double AS confidence FROM g WHERE found"""
ORACLES["pages_of_files"] = r"""WITH p AS (SELECT doc_id, regexp_replace('doc ' || doc_id || chr(10) || translate(coalesce(text, ''), chr(12), ' '), '^\s+|\s+$', '', 'g') AS t FROM documents)
  SELECT doc_id, length(t)::int AS char_count, md5(t) AS text_md5 FROM p"""
ORACLES["facts_by_model"] = r"""SELECT doc_id::varchar AS source_document_id, 'net_profit' AS predicate, round(length(text) / 10, 4)::double AS norm_num, 'INR crore' AS unit, 'page|profitability' AS comparison_key, true AS is_grounded
  FROM documents WHERE length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 50"""
ORACLES["pairs_judged"] = """WITH p AS (SELECT c_custkey % 4 AS n, 'A-board_director-' || c_custkey AS a, 'B-board_director-' || c_custkey AS b FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 4 <> 2)
  SELECT 'rel_llm_' || substr(sha256(a || '|' || b), 1, 32) AS id, a AS fact_a_id, b AS fact_b_id, CASE n WHEN 0 THEN 'CORROBORATES' WHEN 1 THEN 'CONTRADICTS' ELSE 'RECONCILABLE' END AS relationship_type,
    CASE n WHEN 0 THEN 0.8 WHEN 1 THEN 0.6 ELSE 0.7 END::double AS confidence, CASE n WHEN 1 THEN 'so it is' ELSE 'Semantic evaluation based on source evidence.' END AS short_explanation, CASE n WHEN 3 THEN 'scope' END AS contextual_difference FROM p"""
ORACLES["document_exchange"] = ORACLES["seeded_store"]
ORACLES["ground_notes"] = ORACLES["ground_scores"].rsplit("SELECT doc_id, score >= 0.7", 1)[0].replace("r AS (SELECT doc_id, ", "r AS (SELECT doc_id, none, ") + """, o AS (SELECT doc_id, regexp_replace(substr(text, 11, 60), '^\\s+|\\s+$', '', 'g') AS q, coalesce(text, '') = '' AS none FROM documents)
  SELECT doc_id, md5(CASE WHEN none THEN 'No quote, or no page' WHEN score >= 0.7 THEN 'Found in parts: ' || round(score * 100, 1) || '% of the quote' ELSE 'Ungrounded: ' || round(score * 100, 1) || '% of the quote is on the page' END) AS note_md5, score = 1 AS whole FROM r
  UNION ALL SELECT doc_id, md5(CASE WHEN none THEN 'No quote, or no page' ELSE q END), NOT none FROM o"""
ORACLES["text_values"] = """SELECT p_partkey, NULL::double AS num, p_type || ' plating' AS text, CASE WHEN p_size % 3 = 2 THEN 'finish' ELSE 'text' END AS unit, 'text' AS value_type FROM part"""
