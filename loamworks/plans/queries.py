"""Queries over the driver's tables, one for each operator or a few, and their DuckDB SQL.

Pairs are made of conversations: a user's turn that an assistant's turn follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, dedupe, pairs as pr, split, stats as st
from ..sources import sinks
from ..sources.shared import shared_dir
from ..sources.zip_datasets import pairs_of, read_datasets
from .extract import ExtractorError, OfflineExtractor
from .pipelines import generate_dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(turn), "next_text": F.lead("text").over(turn)})
    asked = turns.where("role = 'user' AND next_role = 'assistant'")
    return asked.select("conv_id", "turn", F.col("text").alias("instruction"), F.col("next_text").alias("output"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").cast("int").alias("chunk"))


ORDER = ["conv_id", "turn"]
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.approx_tokens(F.col("text")).alias("approx_tokens"))


def _chunks(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    cut = chunking.chunk_documents(_documents(spark, sf_dir), most, by=("doc_id",))
    return cut.select("doc_id", "chunk", "approx_tokens", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 8000)


def chunk_documents_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 500)


def chunk_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    cut = chunking.chunk_documents(docs, by=("source",)).groupBy("source").agg(F.count("*").alias("chunks"), F.sum("approx_tokens").alias("chunk_tokens"))
    raw = docs.groupBy("source").agg(F.sum(tx.approx_tokens(F.col("text"))).alias("source_tokens"))
    return raw.join(cut, "source")


def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.paragraphs(F.replace("text", F.lit("\n"), F.lit("\r\n \n")))
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(found).alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("p").alias("paragraph_md5"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.sentences(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("sentences_md5"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("normal_md5"))


def pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pairs(spark, sf_dir).select("conv_id", "turn", tx.pair_key(F.col("instruction"), F.col("output")).alias("pair_key"))


def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.fnv1a(tx.normalize(F.col("text"))).alias("fnv1a"))


def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tx.prefix(F.col("text"), 2000)
    return _documents(spark, sf_dir).select("doc_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut).alias("text_md5"))


def dedupe_documents_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return dedupe.unique_chunks(docs, ["doc_id"]).select("doc_id", "source")


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, and again in capitals (a-z) with other punctuation."""
    own = conversation_pairs(spark, sf_dir)
    other = own.withColumns({"instruction": F.concat(F.lit("** "), F.translate("instruction", LOWER, LOWER.upper()), F.lit("?!")), "output": F.replace("output", F.lit(" "), F.lit(" - "))})
    return dedupe.union_datasets(own, other)


def dedupe_pairs_perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = dedupe.unique_pairs(_perturbed(spark, sf_dir), ["file_ord", *ORDER])
    return unique.select("conv_id", "turn", "file_ord", "instruction", "output")


def _split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    unique = split.with_split(dedupe.unique_pairs(conversation_pairs(spark, sf_dir), ORDER))
    return unique.where(F.col("split") == name).select("conv_id", "turn", "instruction", "output")


def split_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, "train")


def split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, "validation")


def source_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = dedupe.unique_chunks(_documents(spark, sf_dir).select("doc_id", "source", "text"), ["doc_id"])
    return st.source_counts(unique, "doc_id")


def _combined(pairs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    unique = split.with_split(dedupe.unique_pairs(pairs, order))
    return unique, st.combined_stats(pairs, unique)


def combined_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(_perturbed(spark, sf_dir), ["file_ord", *ORDER])[1]


def recombine_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined once more with the result of a first combination."""
    own = conversation_pairs(spark, sf_dir).select("instruction", "output", *ORDER)
    first = split.with_split(dedupe.unique_pairs(own, ORDER)).select("instruction", "output", *ORDER)
    again, _ = _combined(dedupe.union_datasets(first, own), ["file_ord", *ORDER])
    return again.select("instruction", "output", "split")


def alpaca_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.to_alpaca(conversation_pairs(spark, sf_dir))


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, flat."""
    chat = pr.to_chat(conversation_pairs(spark, sf_dir)).select(F.posexplode("messages").alias("pos", "m"))
    return chat.select(F.col("pos").cast("int").alias("pos"), "m.role", "m.content")


MODES = ["knowledge-base", "academic-research", "student-summary", "analytics", "none"]


def training_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("text", F.element_at(F.array(*map(F.lit, MODES)), (F.length("text") % 5 + 1).cast("int")).alias("mode"), F.concat(F.lit('{"n":'), F.length("text").cast("string"), F.lit("}")).alias("result"))
    return pr.training_entries(docs).select("instruction", F.md5("input").alias("input_md5"), "output")


def skipped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without outcome, of a service that fails at a sign."""
    cut = chunking.chunk_documents(_documents(spark, sf_dir).withColumn("source", F.col("doc_id").cast("string")), 500)
    done = cut.where(~F.contains("text", F.lit("***")))
    return st.skipped_chunks(cut, done).groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("chunk")), ",").alias("skipped"), F.count("*").alias("n"))


def pair_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pairs with white space around them; a system's turn has no output."""
    turns = table(spark, sf_dir, "conversations")
    own = turns.select("conv_id", "turn", F.concat(F.lit("\t \n"), F.col("role"), F.lit("\r\n ")).alias("instruction"), F.when(F.col("role") == "system", F.lit(" \t")).otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).alias("output"))
    return pr.clean(own).select("conv_id", "turn", "instruction", "output")


def coerce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON texts: a missing one falls back, numbers are read from text."""
    events = table(spark, sf_dir, "events")
    chunk = F.coalesce(F.get_json_object("props", "$.chunk"), F.get_json_object("props", "$.id"), F.col("user_id").cast("string"), F.lit("0"))
    source = F.coalesce(F.get_json_object("props", "$.source"), tx.stem(F.concat(F.lit("/data/"), F.col("event_type"), F.lit(".v1.zip"))))
    return events.select("event_id", source.alias("source"), tx.to_number(F.concat(F.lit(" "), chunk, F.lit("\n"))).cast("long").alias("chunk"), tx.to_number(F.concat(F.col("event_type"), chunk)).isNull().alias("bad_is_null"), tx.to_number(F.lit(" ")).cast("long").alias("empty"))


def preview_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.preview(conversation_pairs(spark, sf_dir), ORDER).select("conv_id", "turn", "instruction", "output")


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package names and extension dispatch for made-up paths of all parts."""
    kinds = F.element_at(F.array(*map(F.lit, [".PDF", ".docx", ".Zip", ".txt", ""])), (F.length("p_name") % 5 + 1).cast("int"))
    paths = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/"), F.col("p_name"), kinds).alias("path"))
    ext = tx.extension(F.col("path"))
    error = F.when(~ext.isin(".pdf", ".docx"), F.concat(F.lit("Unsupported file type: "), ext))
    name = F.concat(F.regexp_replace(tx.base_name(F.col("path")), r"(?i)\.(pdf|docx)$", ""), F.lit("_analytics.zip"))
    return paths.select("p_partkey", ext.alias("ext"), error.alias("error"), name.alias("name"))


def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs as two packages, written and read again."""
    own = conversation_pairs(spark, sf_dir).withColumn("split", F.when(F.length("instruction") % 2 == 0, "even").otherwise("odd"))
    folder, paths = shared_dir(spark, "packages"), []
    for name in ("even", "odd"):
        paths.append(sinks.write_zip(f"{folder}/{name}.zip", {"alpaca.jsonl": sinks.lines(own.where(F.col("split") == name), ORDER, pr.to_alpaca)}))
    return pairs_of(read_datasets(spark, paths)).select("instruction", "output", "source", "chunk", "file_ord")


def _fails_at_sign(passage: str) -> Exception | None:
    return ExtractorError("busy", status=529) if "***" in passage else None


def _offline() -> OfflineExtractor:
    return OfflineExtractor(_fails_at_sign)


def generated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all documents from the offline extractor, which fails at a sign."""
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), "text")
    return generate_dataset(docs, _offline).pairs.select("source", "chunk", "instruction", "output")


def generated_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), "text")
    stats = generate_dataset(docs, _offline).stats
    return stats.select("source", "chunks", "pairs", "approx_source_tokens", "approx_dataset_tokens", F.array_join("skipped_chunks", ",").alias("skipped"), F.col("error").isNotNull().alias("failed"))


QUERIES = {f.__name__: f for f in (doc_approx_tokens, chunk_documents, chunk_documents_500, chunk_stats_by_source, paragraph_split, sentence_split, normalize_text, pair_key, fnv1a_hash, truncate_text, dedupe_documents_first_wins, dedupe_pairs_perturbed, split_train, split_validation, source_pair_counts, combined_stats, recombine_idempotent, alpaca_rows, chat_rows, training_entries, skipped_chunks, pair_clean, coerce_rows, preview_50, output_names, zip_round_trip, generated_pairs, generated_stats)}

# ---- DuckDB SQL of the same

_PAIRS = """conv AS (
  SELECT conv_id, turn, role, text AS instruction, lead(role) OVER t AS next_role, lead(text) OVER t AS output
  FROM conversations WINDOW t AS (PARTITION BY conv_id ORDER BY turn)
), pairs AS (
  SELECT conv_id, turn, instruction, output, 'conv-' || conv_id AS source, turn::INTEGER AS chunk FROM conv WHERE role = 'user' AND next_role = 'assistant'
)"""


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _key(i: str = "instruction", o: str = "output") -> str:
    return f"{_norm(i)} || chr(10) || {_norm(o)}"


def _fnv(x: str) -> str:
    return f"list_reduce(list_transform(string_split({x}, ''), lambda c: unicode(c)::ubigint), lambda h, c: (xor(h, c) * 16777619::ubigint) & 4294967295::ubigint, 2166136261::ubigint)::BIGINT"


def _tokens(x: str) -> str:
    return f"ceil(length({x}) / 4.0)::BIGINT"


def _chunk_cte(most: int, text: str = "text") -> str:
    """chunks(doc_id, source, chunk, text): paragraphs, then sentences and slices of long ones, packed twice."""

    def packed(pieces: str, sep: int) -> str:
        joined = "st.c || chr(10) || chr(10) || p.c" if sep else "st.c || p.c"
        state = f"list_reduce(list_transform({pieces}, lambda x: {{'o': []::VARCHAR[], 'c': x}}), lambda st, p: CASE WHEN st.c <> '' AND length(st.c) + {sep} + length(p.c) > {most} THEN {{'o': list_append(st.o, st.c), 'c': p.c}} ELSE {{'o': st.o, 'c': CASE WHEN st.c = '' THEN p.c ELSE {joined} END}} END, {{'o': []::VARCHAR[], 'c': ''}})"
        return state

    cut = "list_transform(range(0, ((length(s) - 1) // {m}) + 1), lambda i: substring(s, (i * {m} + 1)::BIGINT, {m}))".format(m=most)
    return f"""paras AS (
  SELECT doc_id, source, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')) AS p,
    generate_subscripts(list_filter(list_transform(regexp_split_to_array(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), 1) AS pn
  FROM documents
), cut AS (
  SELECT doc_id, source, pn, CASE WHEN length(p) > {most} THEN flatten(list_transform(regexp_extract_all(p, '[^.!?]*[.!?]+\\s*|[^.!?]+$'), lambda s: {cut})) ELSE [p] END AS pieces FROM paras
), first AS (SELECT doc_id, source, pn, {packed('pieces', 0)} AS st FROM cut
), whole AS (SELECT doc_id, source, flatten(list(list_append(st.o, st.c) ORDER BY pn)) AS pieces FROM first GROUP BY doc_id, source
), second AS (SELECT doc_id, source, {packed('pieces', 2)} AS st FROM whole
), listed AS (SELECT doc_id, source, list_append(st.o, st.c) AS l FROM second
), chunks AS (SELECT doc_id, source, unnest(l) AS text, generate_subscripts(l, 1)::INTEGER AS chunk FROM listed)"""


def _chunk_sql(most: int) -> str:
    return f"WITH {_chunk_cte(most)} SELECT doc_id, chunk, {_tokens('text')} AS approx_tokens, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM chunks"


_DISTINCT_DOCS = f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY {_norm('text')} ORDER BY doc_id) = 1"
_PERTURBED = f"""{_PAIRS}, twice AS (
  SELECT *, 0 AS file_ord FROM pairs
  UNION ALL SELECT conv_id, turn, '** ' || translate(instruction, '{LOWER}', '{LOWER.upper()}') || '?!', replace(output, ' ', ' - '), source, chunk, 1 FROM pairs
), uniq AS (SELECT *, {_key()} AS k FROM twice QUALIFY row_number() OVER (PARTITION BY {_key()} ORDER BY file_ord, conv_id, turn) = 1)"""
_UNIQUE = f"uniq AS (SELECT *, {_key()} AS k FROM pairs QUALIFY row_number() OVER (PARTITION BY {_key()} ORDER BY conv_id, turn) = 1)"


def _split_sql(test: str) -> str:
    return f"WITH {_PAIRS}, {_UNIQUE} SELECT conv_id, turn, instruction, output FROM uniq WHERE {_fnv('k')} % 100 {test}"


_MADE = f"{_chunk_cte(8000)}, made AS (SELECT doc_id::VARCHAR AS source, chunk, 'What is ' || md5(text) || '?' AS instruction, 'A passage of ' || length(text) || ' characters.' AS output FROM chunks WHERE NOT contains(text, '***'))"

SQL = {
    "doc_approx_tokens": f"SELECT doc_id, {_tokens('text')} AS approx_tokens FROM documents",
    "chunk_documents": _chunk_sql(8000),
    "chunk_documents_500": _chunk_sql(500),
    "chunk_stats_by_source": f"WITH {_chunk_cte(8000)}, c AS (SELECT source, count(*) AS chunks, sum({_tokens('text')})::BIGINT AS chunk_tokens FROM chunks GROUP BY source), d AS (SELECT source, sum({_tokens('text')})::BIGINT AS source_tokens FROM documents GROUP BY source) SELECT source, source_tokens, chunks, chunk_tokens FROM d JOIN c USING (source)",
    "paragraph_split": f"WITH {_chunk_cte(8000, 'replace(text, chr(10), chr(13) || chr(10) || chr(32) || chr(10))')} SELECT doc_id, pn - 1 AS pos, md5(p) AS paragraph_md5 FROM paras",
    "sentence_split": "WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+\\s*|[^.!?]+$') AS l FROM documents) SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, '|')) AS sentences_md5 FROM s",
    "normalize_text": f"SELECT doc_id, md5({_norm('text')}) AS normal_md5 FROM documents",
    "pair_key": f"WITH {_PAIRS} SELECT conv_id, turn, {_key()} AS pair_key FROM pairs",
    "fnv1a_hash": f"SELECT doc_id, {_fnv(_norm('text'))} AS fnv1a FROM documents",
    "truncate_text": "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, substring(text, 1, 2000) AS t FROM documents)",
    "dedupe_documents_first_wins": _DISTINCT_DOCS,
    "dedupe_pairs_perturbed": f"WITH {_PERTURBED} SELECT conv_id, turn, file_ord, instruction, output FROM uniq",
    "split_train": _split_sql(">= 10"),
    "split_validation": _split_sql("< 10"),
    "source_pair_counts": f"WITH u AS ({_DISTINCT_DOCS}), c AS (SELECT source, count(*) AS pairs, min(doc_id) AS f FROM u GROUP BY source) SELECT source, pairs, row_number() OVER (ORDER BY f)::INTEGER AS position FROM c",
    "combined_stats": f"WITH {_PERTURBED} SELECT count(*) AS pairs, (SELECT count(*) FROM twice) - count(*) AS duplicates_removed, count(*) FILTER ({_fnv('k')} % 100 >= 10) AS train, count(*) FILTER ({_fnv('k')} % 100 < 10) AS validation, sum({_tokens('instruction || output')})::BIGINT AS approx_tokens FROM uniq",
    "recombine_idempotent": f"WITH {_PAIRS}, {_UNIQUE} SELECT instruction, output, CASE WHEN {_fnv('k')} % 100 < 10 THEN 'validation' ELSE 'train' END AS split FROM uniq",
    "alpaca_rows": f"WITH {_PAIRS} SELECT instruction, '' AS input, output, source, chunk FROM pairs",
    "chat_rows": f"WITH {_PAIRS} SELECT 0 AS pos, 'user' AS role, instruction AS content FROM pairs UNION ALL SELECT 1, 'assistant', output FROM pairs",
    "training_entries": "SELECT CASE length(text) % 5 " + " ".join(f"WHEN {i} THEN '{pr.INSTRUCTIONS.get(m, pr.OTHER_INSTRUCTION)}'" for i, m in enumerate(MODES)) + " END AS instruction, md5(text) AS input_md5, '{\"n\":' || length(text) || '}' AS output FROM documents",
    "skipped_chunks": f"WITH {_chunk_cte(500)} SELECT doc_id::VARCHAR AS source, string_agg(chunk::VARCHAR, ',' ORDER BY chunk) AS skipped, count(*) AS n FROM chunks WHERE contains(text, '***') GROUP BY doc_id",
    "pair_clean": "SELECT conv_id, turn, role AS instruction, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS output FROM conversations WHERE role <> 'system' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''",
    "coerce_rows": "WITH e AS (SELECT *, coalesce(json_extract_string(props, '$.chunk'), json_extract_string(props, '$.id'), user_id::VARCHAR, '0') AS c FROM events) SELECT event_id, coalesce(json_extract_string(props, '$.source'), event_type || '.v1') AS source, c::DOUBLE::BIGINT AS chunk, true AS bad_is_null, 0::BIGINT AS empty FROM e",
    "preview_50": f"WITH {_PAIRS} SELECT conv_id, turn, instruction, output FROM pairs ORDER BY conv_id, turn LIMIT 50",
    "output_names": "WITH p AS (SELECT p_partkey, p_name, ['.PDF', '.docx', '.Zip', '.txt', ''][length(p_name) % 5 + 1] AS e FROM part) SELECT p_partkey, lower(e) AS ext, CASE WHEN lower(e) NOT IN ('.pdf', '.docx') THEN 'Unsupported file type: ' || lower(e) END AS error, CASE WHEN lower(e) IN ('.pdf', '.docx') THEN p_name ELSE p_name || e END || '_analytics.zip' AS name FROM p",
    "zip_round_trip": f"WITH {_PAIRS} SELECT instruction, output, source, chunk, (length(instruction) % 2)::INTEGER AS file_ord FROM pairs",
    "generated_pairs": f"WITH {_MADE} SELECT source, chunk, instruction, output FROM made",
    "generated_stats": f"WITH {_MADE}, c AS (SELECT doc_id::VARCHAR AS source, count(*) AS chunks, coalesce(string_agg(chunk::VARCHAR, ',' ORDER BY chunk) FILTER (contains(text, '***')), '') AS skipped FROM chunks GROUP BY doc_id), m AS (SELECT source, count(*) AS pairs, sum({_tokens('instruction || output')})::BIGINT AS t FROM made GROUP BY source) SELECT d.doc_id::VARCHAR AS source, coalesce(c.chunks, 0) AS chunks, coalesce(m.pairs, 0) AS pairs, {_tokens('d.text')} AS approx_source_tokens, coalesce(m.t, 0) AS approx_dataset_tokens, coalesce(c.skipped, '') AS skipped, m.pairs IS NULL AS failed FROM documents d LEFT JOIN c ON c.source = d.doc_id::VARCHAR LEFT JOIN m ON m.source = d.doc_id::VARCHAR",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique pairs of all conversations with their split."""
    pairs = conversation_pairs(spark, sf_dir).withColumn("file_ord", F.lit(0))
    return split.with_split(dedupe.unique_pairs(pairs, ["file_ord", *ORDER])).select("conv_id", "turn", "instruction", "output", "source", "split")


