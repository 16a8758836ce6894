"""Registered queries of tables, logs and evaluation runs: what is written to the shared folder is read back and returned."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import functions as F

from veritome.config import DEFAULT
from veritome.functions import text as X
from veritome.operators import answer, block_index, chat, completion, evals, ingest, retrieve
from veritome.plans import catalog as C
from veritome.plans import derived as D
from veritome.plans.registry import query
from veritome.sources import page_source, tables
from veritome.streaming import admission
from veritome.streaming import events as streams


# ---- chunk and vector tables ------------------------------------------------------------------------------------------

@query("SELECT source AS path, md5(text) AS digest FROM documents")
def corpus_scan(spark, d):
    """Documents written as files of a folder for each source, in files of at most 10,000 with a line for each document, then found by their names and read in ranges of lines."""
    folder = tables.shared_folder(spark, "corpus")
    docs = D.table(spark, d, "documents").select(F.regexp_replace("text", "\n", "\x1e").alias("value"), F.col("source").alias("name"))
    docs.write.partitionBy("name").option("maxRecordsPerFile", 10_000).text(folder)
    pages = page_source.pages_in(spark, folder, "*.txt", page_source.separated(b"\n"))
    return pages.select(F.regexp_extract("path", r"name=([^/]+)", 1).alias("path"), F.md5(F.regexp_replace("text", "\x1e", "\n")).alias("digest"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, lang, n_chars FROM documents")
def chunks_json(spark, d):
    """Chunks through the JSON sink and back."""
    folder = tables.shared_folder(spark, "chunks")
    docs = D.table(spark, d, "documents")
    tables.write_json(docs, folder)
    back = tables.dataset_lines(spark, folder, docs.schema)
    return back.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "lang", "n_chars")


_OWNER = "CASE WHEN vec_id % 3 = 0 THEN 's' || label ELSE 'base' END"


def _vector_table(spark, d) -> str:
    path = tables.shared_folder(spark, "vectors")
    vectors = D.vectors(spark, d)
    tables.append_chunks(vectors.where("owner = 'base'").drop("owner"), path, "base")
    tables.append_owned(vectors.where("owner <> 'base'"), path)
    return path


@query(f"SELECT {_OWNER} AS owner, count(*) AS chunks, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1")
def vector_upsert(spark, d):
    return spark.read.parquet(_vector_table(spark, d)).groupBy("owner").agg(F.count("*").alias("chunks"), F.sum("chunk_id").alias("ids"))


@query(f"SELECT vec_id AS chunk_id, {_OWNER} AS owner FROM embeddings WHERE {_OWNER} IN ('base', 's1')")
def owner_scan(spark, d):
    return tables.owned(spark, _vector_table(spark, d), "base", "s1").select("chunk_id", "owner")


@query(f"SELECT {_OWNER} AS owner, count(*) AS chunks, (SELECT count(*) FROM embeddings WHERE {_OWNER} = 's1') AS gone FROM embeddings WHERE {_OWNER} <> 's1' GROUP BY 1")
def owner_delete(spark, d):
    path = _vector_table(spark, d)
    gone = tables.delete_owner(spark, path, "s1")
    return spark.read.parquet(path).groupBy("owner").agg(F.count("*").alias("chunks")).withColumn("gone", F.lit(gone).cast("long"))


@query("SELECT count(*) FILTER (vec_id % 2 = 0) AS chunks, 0::BIGINT AS absent FROM embeddings")
def store_recreate(spark, d):
    """The table is dropped and written anew; a table that isn't there has no rows."""
    path, vectors = tables.shared_folder(spark, "vectors"), D.vectors(spark, d)
    tables.recreate(vectors, path)
    tables.recreate(vectors.where("chunk_id % 2 = 0"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("chunks")).withColumn("absent", F.lit(tables.row_count(spark, f"{path}-none")).cast("long"))


@query("SELECT vec_id AS chunk_id, 'hashed' AS model FROM embeddings")
def model_check(spark, d):
    """Vectors are only read with the model that their manifest names."""
    path = tables.shared_folder(spark, "vectors")
    tables.recreate(D.vectors(spark, d), path)
    tables.write_manifest(spark, f"{path}-manifest", "hashed", 64)
    return tables.checked_vectors(spark, path, f"{path}-manifest", "hashed").select("chunk_id", F.lit("hashed").alias("model"))


@query(f"WITH {C._BM25} SELECT term, df, round(idf, 6) AS idf FROM i WHERE df > 1")
def bm25_saved(spark, d):
    """Postings written by term and read back by what searches them."""
    path, chunks = tables.shared_folder(spark, "postings"), D.chunks(spark, d)
    retrieve.postings(chunks).repartition("term").sortWithinPartitions("term").write.parquet(path)
    stats = retrieve.term_stats(spark.read.parquet(path), chunks.count())
    return stats.where("df > 1").withColumn("idf", F.round("idf", 6))


@query(f"WITH {C._BM25} SELECT query_id, rank, chunk_id, floor(score * 1000 + 0.5003) / 1000 AS score FROM b WHERE rank <= 10")
def bm25_saved_search(spark, d):
    """Ten passages of each question from the tables of a saved index."""
    path = tables.shared_folder(spark, "bm25")
    block_index.save_index(D.chunks(spark, d), path)
    return C._thousandths(block_index.search_index(spark, D.questions(spark, d), path, 10))


@query("SELECT v.vec_id AS chunk_id, v.label FROM embeddings v WHERE v.vec_id % 7 = 0")
def chunk_lookup(spark, d):
    """Point lookups: ids that aren't in the table drop out."""
    vectors = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    ids = vectors.where("chunk_id % 7 = 0").select("chunk_id").union(vectors.select((-F.col("chunk_id") - 1).alias("chunk_id")))
    return retrieve.looked_up(ids, vectors)


# ---- lines from spans -------------------------------------------------------------------------------------------------

_SPAN_LINES = f"(SELECT doc_id, i, regexp_extract_all(line, '[A-Za-z]+') AS ws FROM {C._LINES})"


@query(f"""SELECT doc_id, 1 AS page_number, string_agg(t, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, CASE WHEN len(ws) = 1 THEN ws[1] WHEN doc_id % 2 = 0 THEN ws[1] || ' ' || ws[2] ELSE ws[1] || '  ' || ws[2] END AS t FROM {_SPAN_LINES} WHERE len(ws) > 0) GROUP BY doc_id""")
def visual_lines(spark, d):
    """The first two words of every line as spans: near each other in even documents, columns apart in odd ones, and a little askew."""
    lines = D.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("ws", F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).where(F.size("ws") > 0)
    after = F.length(F.get("ws", F.lit(0))) * DEFAULT.char_advance + F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(40.0)
    first = F.struct((F.col("i") * 10.0).alias("y"), F.lit(0.0).alias("x"), F.get("ws", F.lit(0)).alias("text"))
    second = F.struct((F.col("i") * 10.0 + 2.0).alias("y"), after.alias("x"), F.get("ws", F.lit(1)).alias("text"))
    spans = lines.select("doc_id", F.lit(1).alias("page_number"), F.inline(F.filter(F.array(first, second), lambda s: s["text"].isNotNull())))
    return ingest.visual_lines(spans)


# ---- answers ----------------------------------------------------------------------------------------------------------

@query("""SELECT doc_id::VARCHAR AS chunk_id, source AS spec_id, coalesce(lang, '') AS version, 'UNKNOWN' AS clause_id, '' AS clause_title, '' AS heading_path, left(coalesce(text, ''), 2500) AS body,
  0 AS page_start, 0.0::DOUBLE AS score FROM documents""")
def source_cards(spark, d):
    docs = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("spec_id"), F.col("lang").alias("version"), F.col("text").alias("body"))
    return answer.source_cards(docs)


@query(f"""WITH c AS (SELECT doc_id AS query_id, i + 1 AS n FROM {C._LINES})
SELECT c.query_id, c.n, CASE WHEN c.query_id % 4 = 3 THEN false ELSE c.n % 3 <> 1 AND c.n % 5 <> 4 END AS supported FROM c""")
def batched_judge(spark, d):
    """One reply for all claims of a document: verdicts by n, some left out; every fourth document's reply is cut off, which fails all of its claims."""
    claims = D.claims(spark, d).select("query_id", "n")
    said = F.transform(F.filter(F.sort_array(F.collect_list("n")), lambda n: n % 5 != 4), lambda n: F.struct(n.alias("n"), F.when(n % 3 == 1, "NOT_SUPPORTED").otherwise("supported").alias("verdict")))
    replies = claims.groupBy("query_id").agg(F.to_json(F.struct(said.alias("verdicts"))).alias("raw"))
    replies = replies.withColumn("raw", F.when(F.col("query_id") % 4 == 3, F.left("raw", F.length("raw") - 2)).otherwise(F.concat(F.lit("```json\n"), "raw", F.lit("\n```"))))
    return answer.batch_verdicts(claims, replies)


@query(f"""WITH c AS (SELECT doc_id AS query_id, i + 1 AS n, CASE WHEN i % 4 <= 1 THEN doc_id WHEN i % 4 = 2 THEN doc_id + 1 END AS cited FROM {C._LINES})
SELECT query_id, array_to_string(list_sort(list(DISTINCT source || ' ' || coalesce(lang, ''))), '; ') AS cited_clauses FROM c JOIN documents ON doc_id = cited GROUP BY query_id""")
def cited_clauses(spark, d):
    known = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.concat_ws(" ", "source", F.coalesce("lang", F.lit(""))).alias("clause"))
    return answer.cited_clauses(D.claims(spark, d), known).withColumn("cited_clauses", F.array_join("cited_clauses", "; "))


_CACHED = "sha256('{\"model\":\"m\",\"prompt\":\"' || (event_id % 97)::VARCHAR || '\",\"max_tokens\":700}')"


@query(f"SELECT {_CACHED} AS key, count(*) AS requests FROM events GROUP BY 1")
def cache_filled(spark, d):
    """Misses are answered, their answers put into the cache, and then every request is answered from it."""
    path = tables.shared_folder(spark, "cache")
    rows = D.table(spark, d, "events").select(F.col("event_id").alias("request_id"), answer.cache_key(F.lit("m"), (F.col("event_id") % 97).cast("string"), 700).alias("key"))
    first = rows.where("request_id % 97 < 40").select("key", F.lit("r").alias("response")).dropDuplicates(["key"])
    first.write.parquet(path)
    answer.cache_put(answer.cache_misses(rows, spark.read.parquet(path)).select("key", F.lit("new").alias("response")), path)
    return rows.join(spark.read.parquet(path), "key").groupBy("key").agg(F.count("*").alias("requests"))


def _moody() -> completion.Service:
    """Refuses by the prompt's digest: a sixteenth is bad, one is refused twice, and one always; the rest is answered at once."""

    def load():
        last = ["", 0]

        def ask(prompt, most_tokens):
            digest = hashlib.md5(prompt.encode()).hexdigest()
            last[:] = [digest, last[1] + 1 if last[0] == digest else 1]
            if digest[0] == "0":
                raise completion.BadRequest("malformed")
            if digest[0] == "2" or (digest[0] == "1" and last[1] < 3):
                raise completion.RateLimited("try again in 1m2.5s" if last[1] == 1 else "too many requests")
            return f"r:{digest}"

        return ask

    return completion.Service("moody", load)


_MOST = 1_000_000


@query(f"""WITH r AS (SELECT doc_id, text, substr(md5(text), 1, 1) AS h, length(text) // 4 + 700 > {_MOST} AS big FROM documents)
SELECT doc_id AS request_id, CASE WHEN NOT big AND h NOT IN ('0', '2') THEN 'r:' || md5(text) END AS response, CASE WHEN text IS NULL THEN 'no_prompt' WHEN big THEN 'too_large' WHEN h = '0' THEN 'bad_request' WHEN h = '2' THEN 'gave_up' END AS error,
  CASE WHEN text IS NULL OR big THEN 0 WHEN h = '1' THEN 3 WHEN h = '2' THEN 5 ELSE 1 END AS attempts FROM r""")
def completions(spark, d):
    """Every document's text as a prompt, first those of half of the documents, then all: what was answered comes from the cache, refusals are tried again as their kind allows."""
    requests = D.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"))
    complete = partial(completion.completed, service=_moody(), cache=tables.shared_folder(spark, "completions"), budget=completion.Budget(tokens=_MOST, requests=6000), clock=completion.DryClock)
    complete(requests.where("request_id % 2 = 0"))
    return complete(requests).withColumn("error", F.split_part("error", F.lit(":"), F.lit(1)))


# ---- conversations and logs -------------------------------------------------------------------------------------------

@query("SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 1 THEN 2 WHEN turn % 3 = 2 THEN 0 END AS n_sources, CASE WHEN turn % 3 = 1 THEN 'c' || turn END AS first_source FROM conversations")
def turn_read(spark, d):
    """Turns stored with their sources as JSON, in tables made by DDL, and read in order with the JSON decoded; a cell that doesn't parse is null."""
    store = tables.create_store(spark, tables.shared_folder(spark, "store"))
    t, n = D.turns(spark, d), F.col("turn")
    cell = F.when(n % 3 == 1, F.format_string('[{"chunk_id": "c%d"}, {"chunk_id": "x"}]', n)).when(n % 3 == 2, "[]").otherwise("[{")
    t.select("conv_id", "turn", "role", "text", cell.alias("sources"), F.pmod(F.xxhash64("conv_id"), F.lit(8)).cast("int").alias("part")).write.mode("append").partitionBy("part").parquet(store["turns"])
    rows = chat.read_turns(spark.read.parquet(store["turns"]))
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("sources").isNotNull(), F.size("sources")).alias("n_sources"), F.get("sources", F.lit(0))["chunk_id"].alias("first_source"))


_CLASSED = "(SELECT conv_id, turn, length(text) AS n FROM conversations WHERE role = 'user')"


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'SPEC_QUESTION' WHEN turn % 4 = 1 THEN 'META' ELSE 'META' END AS intent, turn % 4 = 0 AS billable FROM {_CLASSED}")
def ambiguous_resolve(spark, d):
    """Ambiguous turns by a judge that calls some technical, some not, and is silent on the rest."""
    rows = D.turns(spark, d).where("role = 'user'").select("conv_id", "turn", F.lit("AMBIGUOUS").alias("intent"), F.lit(False).alias("billable"))
    verdicts = rows.where("turn % 4 < 2").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, "TECHNICAL").otherwise("SMALLTALK").alias("category"))
    return chat.resolved_intents(rows, verdicts)


#: What turns may ask of the service, and whether the answer explains what it can do.
_ASKED = [("what can you do", True), ("how are you", False), ("What is this?", True), ("what do you know", False), ("HOW DO YOU WORK", True), ("which spec", True), ("what documents", True), ("what corpus", False), ("your capabilities", False), ("what can I ask", True), ("who are you", False)]
_META = " ".join(f"WHEN conv_id % {len(_ASKED)} = {i} THEN '{'capabilities' if capable else 'conversational'}'" for i, (_, capable) in enumerate(_ASKED))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'greeting' WHEN turn % 4 = 1 THEN 'unclear' WHEN turn % 4 = 2 THEN CASE {_META} END END AS response FROM conversations""")
def canned_responses(spark, d):
    n = F.col("turn") % 4
    intent = F.when(n == 0, "GREETING").when(n == 1, "UNCLEAR").when(n == 2, "META").otherwise("SPEC_QUESTION")
    asked = F.element_at(F.array(*[F.lit(text) for text, _ in _ASKED]), (F.col("conv_id") % len(_ASKED) + 1).cast("int"))
    return D.turns(spark, d).select("conv_id", "turn", chat.canned_response(intent, asked).alias("response"))


@query("SELECT source AS session, array_to_string(list_sort(list(DISTINCT doc_id::VARCHAR)), ',') AS documents FROM documents WHERE doc_id % 3 = 0 GROUP BY source")
def user_documents(spark, d):
    docs = D.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("session"), F.col("doc_id").cast("string").alias("spec_id"))
    return chat.user_documents(docs).withColumn("documents", F.array_join("documents", ","))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS lines FROM events GROUP BY ALL")
def query_log(spark, d):
    """Two appends to a log partitioned by day, read back."""
    path = tables.shared_folder(spark, "log")
    rows = D.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type", "value")
    for part in (0, 1):
        tables.appended_log(rows.where(F.col("event_id") % 2 == part), path)
    return spark.read.schema("event_id bigint, event_type string, value double, day string").parquet(path).groupBy("day", "event_type").agg(F.count("*").alias("lines"))


@query("SELECT event_id, event_type FROM events")
def incremental_save(spark, d):
    """Items saved batch by batch, each batch once, however often it is run."""
    path = tables.shared_folder(spark, "draft")
    events = streams.event_stream(spark, d, D.table(spark, d, "events").schema, "events.parquet")
    streams.saved_increments(events.select("event_id", "event_type"), f"{path}/items", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/items").select("event_id", "event_type")


@query()
def rate_admission_stream(spark, d):
    """The decisions of rate_admission from a stream that is taken up in three runs, each with a later third of the requests; a last request, long after the others and of no key of theirs, lets all be decided."""
    path, rows = tables.shared_folder(spark, "admission"), D.requests(spark, d).select("key", "event_id", "ts", "tokens")
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    first, last = first or 0, last or 0
    third = F.least(F.lit(2), F.floor((F.unix_micros("ts") - first) * 3 / max(1, last - first)))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("event_id"), F.timestamp_micros(F.lit(last + 3_600_000_000)).alias("ts"), F.lit(0).cast("long").alias("tokens"))
    for part in [rows.where(third == i) for i in range(3)] + [end]:
        part.write.mode("append").parquet(f"{path}/requests")
        admission.run(spark.readStream.schema(rows.schema).parquet(f"{path}/requests"), f"{path}/decided", f"{path}/state")
    return spark.read.schema("key long, event_id long, decision string").parquet(f"{path}/decided").select("event_id", "key", "decision")


# ---- evaluation -------------------------------------------------------------------------------------------------------

@query(f"""SELECT count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_adversarial, round(avg(CASE WHEN answerable THEN (confidence < 0.9)::INT END), 4) AS false_refusal_rate,
  round(list_sort(list((doc_id % 997) / 10.0))[least(count(*), floor(count(*) * 0.95)::INT + 1)], 3)::DOUBLE AS p95_latency FROM {C._SCORES}""")
def eval_latency(spark, d):
    zero = F.lit(0.0)
    rows = D.scores(spark, d).select("answerable", (F.col("confidence") < DEFAULT.tau).alias("abstained"), zero.alias("recall_at_k"), zero.alias("reciprocal_rank"), zero.alias("ungrounded_rate"), zero.alias("citation_accuracy"), F.lit(0).alias("parse_failed"), (F.col("doc_id") % 997 / 10.0).alias("latency"))
    return evals.aggregated(rows).select("n_answerable", "n_adversarial", "false_refusal_rate", "p95_latency")


@query(f"SELECT *, CASE WHEN separation < 0.3 THEN 'weak separation' ELSE 'separable' END AS diagnosis FROM {C._SWEEP} ORDER BY separation DESC, tau LIMIT 1")
def sweep_diagnosis(spark, d):
    return evals.diagnosis(evals.threshold_sweep(D.scores(spark, d)))


@query(f"""WITH {C._HYBRID}, g AS ({C._GOLD}), ga AS (SELECT DISTINCT query_id FROM g), tp AS (SELECT query_id, max(score) AS top FROM rk GROUP BY query_id),
e AS (SELECT item_id AS query_id, ga.query_id IS NOT NULL AS answerable, coalesce(tp.top, 0) < 0.9 AS abstained,
        coalesce((SELECT max((rk.rank <= 3)::INT) FROM g JOIN rk ON rk.query_id = g.query_id AND rk.chunk_id = g.gold WHERE g.query_id = item_id), 0) AS recall,
        coalesce((SELECT max(1.0 / rk.rank) FROM g JOIN rk ON rk.query_id = g.query_id AND rk.chunk_id = g.gold WHERE g.query_id = item_id AND rk.rank <= 3), 0) AS rr
      FROM benchmark LEFT JOIN ga ON ga.query_id = item_id LEFT JOIN tp ON tp.query_id = item_id)
SELECT count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_adversarial, round(coalesce(avg(recall) FILTER (answerable), 0), 4) AS recall_at_k, round(coalesce(avg(rr) FILTER (answerable), 0), 4)::DOUBLE AS mrr,
  count(*) FILTER (answerable AND NOT abstained) AS answers_produced, round(coalesce(avg(abstained::INT) FILTER (answerable), 0), 4) AS false_refusal_rate, round(coalesce(avg(abstained::INT) FILTER (NOT answerable), 0), 4) AS abstention_correctness FROM e""")
def evaluate_loop(spark, d):
    """All items through retrieval and the gate, with the documents that contain them as gold: one batched run and its measures."""
    rows = evals.evaluated(C._results(spark, d), C._gold(spark, d).withColumn("gold", F.col("gold").cast("string")))
    return evals.aggregated(rows).select("n_answerable", "n_adversarial", "recall_at_k", "mrr", "answers_produced", "false_refusal_rate", "abstention_correctness")


@query()
def evaluate_run(spark, d):
    """The same with answers and verdicts of models that are asked through the completion loop: measures of claims, citations and unreadable replies too."""
    results = tables.durable(C._results(spark, d, tau=0.6))
    return evals.aggregated(evals.evaluated(results, C._gold(spark, d).withColumn("gold", F.col("gold").cast("string")), run=C.model_run(spark, results)))


@query("SELECT doc_id, regexp_replace(source || '-' || doc_id, '[^A-Za-z0-9]', '', 'g') AS slug, greatest(1, length(coalesce(text, '')) // 4) AS tokens FROM documents")
def slugs(spark, d):
    return D.identities(spark, d).join(D.table(spark, d, "documents").select("doc_id", X.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")), "doc_id").select("doc_id", X.slug(F.col("spec_id")).alias("slug"), "tokens")
