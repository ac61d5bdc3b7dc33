"""Streaming forms; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import DOCS, RUN_LOG, query, rounded, rounded_sql
from millrace.catalog.retrieval import CENTRES, K, centres, corpus, ranked_sql, shown
from millrace.plans.views import run_log, table
from millrace.session import shared_folder
from millrace.sources.corpus import read_corpus
from millrace.streaming import streams


@query("clean_stream", f"with {DOCS} select doc_seq, text from docs")
def clean_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    arriving = streams.read_files(spark, sf_dir, schema, "documents.parquet")
    out = shared_folder(spark, "cleaned")
    streams.clean_stream(read_corpus(arriving), out)
    return spark.read.schema("doc_seq bigint, text string").parquet(out)


@query("run_monitor", f"""
with {RUN_LOG},
last as (select run_id, step, train_loss, val_loss from run_log
         qualify row_number() over (partition by run_id order by step desc) = 1),
b as (select run_id, min(train_loss) as bt, min(val_loss) as bv, max(tokens_seen) as tokens_seen,
             count(*) as entries from run_log group by run_id)
select run_id, step, {rounded_sql('train_loss')} as train_loss, {rounded_sql('val_loss')} as val_loss,
       {rounded_sql('bt')} as best_train, {rounded_sql('bv')} as best_val, tokens_seen, entries
from last join b using (run_id)""")
def run_monitor(spark, sf_dir):
    arriving, out = shared_folder(spark, "log_files"), shared_folder(spark, "monitor")
    log = run_log(spark, sf_dir)
    log.repartition(4, "line_no").write.parquet(arriving)
    streams.monitor_runs(streams.read_files(spark, arriving, log.schema, files_per_trigger=2), out)
    losses = ["train_loss", "val_loss", "best_train", "best_val"]
    return streams.read_monitor(spark, out).withColumns({c: rounded(c) for c in losses})


@query("answer_stream", f"""
with {CENTRES}, {ranked_sql()}
select query_id, vec_id, rank, {rounded_sql('score')} as score from hits""")
def answer_stream(spark, sf_dir):
    arriving, out = shared_folder(spark, "questions"), shared_folder(spark, "answers")
    asked = centres(spark, sf_dir)
    asked.repartition(2, "query_id").write.parquet(arriving)
    streams.answer_stream(streams.read_files(spark, arriving, asked.schema, files_per_trigger=1),
                          corpus(spark, sf_dir), K, out)
    return shown(spark.read.parquet(out))
