"""The corpus operators as queries by name, and DuckDB SQL where it can express one."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import table


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.licences import digest, scan_documents

    return digest(scan_documents(table(spark, sf_dir, "documents")))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.kd_shards import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 8)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.bpe_sql import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.order_minhash import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.substring_dedup import digest, without_repeats

    return digest(without_repeats(table(spark, sf_dir, "documents")))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one text of ten, chosen by the crc of its id, from some word on replaced by repetitions of what begins there. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.periodic_runs import digest, periodic_runs

    return digest(periodic_runs(table(spark, sf_dir, "documents"), repeated_tail))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language, op2_licences, op3_kd_shards, op4_byte_bpe, op5_order_minhash, op6_packing, op7_main_text, op8_ngram_join, op9_quality_rules, op10_toxicity, op11_substring_dedup, op12_periodic_runs, op13_vector_codes)}


def _vector_sql(rounds: int = 2) -> str:
    """Codebooks of each round as common table expressions, one after the other."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"near{i} AS (SELECT r, p, any_value(x) AS x, min(({distance}, e)) AS best FROM part JOIN book{i} USING (p) GROUP BY r, p)")
        if i < rounds:
            means = f"SELECT p, best[2] AS e, pos, floor(sum(x[pos])::double / count(*))::bigint AS m FROM near{i}, (SELECT unnest(range(1, 1 + (SELECT any_value(w) FROM part))) AS pos) GROUP BY ALL"
            steps.append(f"mean{i} AS (SELECT p, e, list(m ORDER BY pos) AS c FROM ({means}) GROUP BY ALL)")
            steps.append(f"book{i + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
part AS (SELECT r, vec_id, label, p, len(v) // 16 AS w, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part QUALIFY e < 64),
{", ".join(steps)},
coded AS (SELECT r, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY p) AS code, sum(best[1])::bigint AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"""


_REPEATS_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM docs, unnest(range(1, len(w) - 33)) AS t(i)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM repeated),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM docs),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, (len(w) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (r)"""

#: Pairs of equal words at most a quarter of the text apart, by distance; places that follow each other are a run. Of runs that cover the same stretch only the smallest period counts.
_RUNS_SQL = """
WITH ids AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)) AS letters FROM documents),
hashed AS (
  SELECT r, doc_id, w, len(w) AS n, xor(4294967295, list_reduce(flatten(list_transform(letters, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::bigint)) AS h FROM ids),
shaped AS (SELECT *, h % 10 = 0 AND n > 0 AS changed, CASE WHEN n > 0 THEN (h // 10) % n END AS a, CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM hashed),
words AS (
  SELECT r, n, i, CASE WHEN changed AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x FROM shaped, unnest(range(n)) AS t(i)),
pairs AS (SELECT u.r, v.i - u.i AS q, u.i FROM words u JOIN words v ON u.r = v.r AND u.x = v.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
stretches AS (
  SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, len, q FROM stretches b WHERE NOT EXISTS (SELECT 1 FROM stretches c WHERE c.r = b.r AND c.q < b.q AND c.s <= b.s AND c.s + c.len >= b.s + b.len)),
told AS (SELECT r, count(*) AS n_runs, min((-len, s, q)) AS best, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, best[2]::bigint AS start, (-best[1])::bigint AS length, best[3]::bigint AS period, (1000 * -best[1] // best[3])::bigint AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM ids LEFT JOIN told USING (r) LEFT JOIN left_over USING (r)"""

ORACLES: dict[str, str] = {"op12_periodic_runs": _RUNS_SQL, "op11_substring_dedup": _REPEATS_SQL, "op13_vector_codes": _vector_sql()}
