"""Question/answer examples, shuffles and padded batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import (DOCS, QA, hash_sql, joined, joined_sql, query, strip_sql,
                                       word_ids_sql)
from millrace.catalog.tokens import TRAINING, VOCAB
from millrace.functions.text import word_ids
from millrace.operators import finetune, retrieve, tokenize
from millrace.operators.clean import limit_kept
from millrace.operators.tokenize import FIRST_MERGE
from millrace.plans.finetune import finetune_batches
from millrace.plans.views import WORD_EOT, qa

CAP = 400

EXAMPLES = f"""{QA},
stripped as (
  select qa_id, {strip_sql('context')} as c, {strip_sql('question')} as q,
         {strip_sql('answer')} as a from qa),
examples as (
  select qa_id, 'Context: ' || c || chr(10) || 'Question: ' || q || chr(10) || 'Answer: ' || a
         || '<|endoftext|>' as example
  from stripped where length(a) between 1 and {CAP})"""

TOKENS = f"""{EXAMPLES},
tokens as (select qa_id, list_slice({word_ids_sql('example')}, 1, 512) as ids from examples)"""

SHUFFLED = f"""{TOKENS},
shuffled as (
  select *, row_number() over (order by {hash_sql("'42'", "'0'", 'qa_id')}, qa_id) - 1 as place
  from tokens)"""

BATCHES = """,
sized as (select *, place // 8 as batch, max(len(ids)) over (partition by place // 8) - 1 as width
          from placed),
padded as (
  select batch, cast(place % 8 as int) as row, qa_id,
         list_concat(list_slice(ids, 1, len(ids) - 1),
                     list_transform(range(0, width - len(ids) + 1), lambda i: 0)) as x,
         list_concat(list_slice(ids, 2, len(ids)),
                     list_transform(range(0, width - len(ids) + 1), lambda i: -100)) as y
  from sized)"""


def examples(spark, sf_dir):
    return finetune.qa_examples(qa(spark, sf_dir), CAP)


def tokens(spark, sf_dir):
    made = examples(spark, sf_dir)
    return finetune.truncated(made.select("qa_id", word_ids(F.col("example")).alias("token_ids")))


def batch_rows(batches):
    return batches.select("batch", "row", "qa_id", joined("x").alias("x"), joined("y").alias("y"))


@query("qa_examples", f"with {EXAMPLES} select qa_id, example from examples")
def qa_examples(spark, sf_dir):
    return examples(spark, sf_dir)


@query("truncated_examples", f"with {TOKENS} select qa_id, {joined_sql('ids')} as ids from tokens")
def truncated(spark, sf_dir):
    return tokens(spark, sf_dir).select("qa_id", joined("token_ids").alias("ids"))


@query("shuffled_examples", f"with {SHUFFLED} select qa_id, place from shuffled")
def shuffled(spark, sf_dir):
    return finetune.shuffled(examples(spark, sf_dir).select("qa_id"), "qa_id").select(
        "qa_id", "place")


@query("padded_batches", f"""
with {SHUFFLED}, placed as (select * from shuffled){BATCHES}
select batch, row, qa_id, {joined_sql('x')} as x, {joined_sql('y')} as y from padded""")
def padded(spark, sf_dir):
    placed = finetune.shuffled(tokens(spark, sf_dir), "qa_id")
    return batch_rows(finetune.padded_batches(placed, WORD_EOT))


@query("padded_batches_in_order", f"""
with {TOKENS}, placed as (select *, row_number() over (order by qa_id) - 1 as place
                          from tokens){BATCHES}
select batch, row, qa_id, {joined_sql('x')} as x, {joined_sql('y')} as y from padded""")
def padded_in_order(spark, sf_dir):
    placed = finetune.in_order(tokens(spark, sf_dir), "qa_id")
    return batch_rows(finetune.padded_batches(placed, WORD_EOT))


QA_VOCAB, QA_LIMIT = 300, 30

QA_TRAINING = TRAINING.replace(DOCS, EXAMPLES + """,
docs as (select qa_id as doc_seq, replace(example, '<|endoftext|>', '') as text from examples
         order by qa_id limit 30)""").replace(
    f"t.step < {VOCAB - FIRST_MERGE}", f"t.step < {QA_VOCAB - FIRST_MERGE}")


@query("finetune_batches", f"""
with {QA_TRAINING},
tokens_of as (select doc_seq as qa_id, list_slice(list_append(ids, 0), 1, 512) as ids from encoded),
placed as (
  select *, row_number() over (order by {hash_sql("'42'", "'0'", 'qa_id')}, qa_id) - 1 as place
  from tokens_of){BATCHES}
select batch, row, qa_id, {joined_sql('x')} as x, {joined_sql('y')} as y from padded""")
def trained_finetune_batches(spark, sf_dir):
    """From records to batches, with a tokenizer learned from the examples themselves."""
    records = qa(spark, sf_dir)
    body = limit_kept(examples(spark, sf_dir), "qa_id", QA_LIMIT).select(
        F.replace("example", F.lit(finetune.END_TEXT), F.lit("")).alias("text"))
    merges = tokenize.train(tokenize.pre_token_counts(body), QA_VOCAB)
    return batch_rows(finetune_batches(records, merges, QA_LIMIT, max_answer=CAP))


@query("cycled_steps", f"""
with {EXAMPLES},
n as (select cast(ceil(count(*) / 8.0) as bigint) as batches from examples),
epochs as (select unnest(range(0, cast(ceil(1500.0 / batches) as bigint))) as epoch from n),
placed as (
  select qa_id, epoch, row_number() over (partition by epoch
         order by {hash_sql("'42'", 'epoch', 'qa_id')}, qa_id) - 1 as place
  from examples, epochs)
select epoch * batches + place // 8 + 1 as step, cast(epoch as int) as epoch,
       place // 8 as batch, cast(place % 8 as int) as row, qa_id
from placed, n where epoch * batches + place // 8 + 1 <= 1500""")
def cycled(spark, sf_dir):
    return finetune.cycled_steps(examples(spark, sf_dir), "qa_id", 1500)


PROMPT = "'Context: ' || {c} || chr(10) || 'Question: ' || q || chr(10) || 'Answer:'"


@query("prompts", f"""
with {QA},
s as (select qa_id, {strip_sql('context')} as c, {strip_sql('question')} as q from qa)
select qa_id, {PROMPT.format(c='c')} as prompt from s""")
def prompts(spark, sf_dir):
    from millrace.functions.text import prompt, strip
    return qa(spark, sf_dir).select(
        "qa_id", prompt(strip(F.col("context")), strip(F.col("question"))).alias("prompt"))


@query("long_prompt_fallback", f"""
with {QA},
s as (select qa_id, {strip_sql('context')} as c, {strip_sql('question')} as q from qa),
l as (select *, len(string_split({PROMPT.format(c='c')}, ' ')) > 460 as halved from s),
u as (select *, case when halved then substr(c, 1, length(c) // 2) else c end as used from l)
select qa_id, halved, {PROMPT.format(c="(case when halved then used || '...' else used end)")}
         as prompt,
       cast(len(list_distinct({word_ids_sql('used')})) as bigint) as context_tokens
from u""")
def long_prompts(spark, sf_dir):
    made = retrieve.prompts(qa(spark, sf_dir), word_ids)
    return made.select("qa_id", "halved", "prompt",
                       F.size("context_ids").cast("bigint").alias("context_tokens"))
