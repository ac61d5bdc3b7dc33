"""Where queries register, and small pieces of SQL they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import SPACE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def joined(array: Column | str) -> Column:
    """Array as text, the same in both engines."""
    return (F.col(array) if isinstance(array, str) else array).cast("string")


def rounded(value: Column | str) -> Column:
    """Six places, and no negative zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6) + F.lit(0.0)


# --- SQL --------------------------------------------------------------------

def strip_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{SPACE}+', ''), '{SPACE}+\z', '')"


def normalise_sql(x: str) -> str:
    return rf"regexp_replace({strip_sql(x)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def hash_sql(*parts: str) -> str:
    joined_parts = ", ".join(parts)
    return f"cast('0x' || substr(md5(concat_ws(':', {joined_parts})), 1, 15) as bigint)"


def word_ids_sql(x: str) -> str:
    return (f"list_transform(string_split({x}, ' '), lambda w: cast("
            "(ascii(w) * 8191 + ascii(right(w, 1)) * 127 + length(w)) % 65536 + 1 as int))")


def joined_sql(x: str) -> str:
    return f"cast({x} as varchar)"


def rounded_sql(x: str) -> str:
    return f"round({x}, 6) + cast(0 as double)"


DOCS = f"""docs as (
  select doc_id as doc_seq, t as text
  from (select doc_id, {normalise_sql('text')} as t from documents) where length(t) >= 120)"""

WORDS = f"""{DOCS},
words as (select doc_seq, list_append({word_ids_sql('text')}, 0) as ids from docs)"""

STREAM = f"""{WORDS},
stream as (
  select doc_seq, tok, row_number() over (order by doc_seq, i) - 1 as pos
  from (select doc_seq, unnest(ids) as tok, generate_subscripts(ids, 1) as i from words))"""

RUN_LOG = """lines as (
  select *, row_number() over (partition by user_id order by ts, event_id) as n from events),
run_log as (
  select cast(user_id as varchar) as run_id, n as line_no, 50 * n as step,
         case when event_type <> 'view' then value / 1000000 else cast(0 as double) end as lr,
         case when event_type <> 'signup' then value / 25 end as train_loss,
         case when event_type = 'purchase' then value / 30 end as val_loss,
         n * (50 * 16 * 256) as tokens_seen, value * 10 as vram_mb,
         case when event_type <> 'error' then value * 100 else cast(0 as double) end
           as throughput_tok_s,
         ts as time
  from lines)"""

SCORES = """score_rows as (
  select vec_id as row_id, vec_id // 16 as batch_id,
         case when label = 0 then -100 else label end as target,
         list_transform(embedding, lambda x: cast(x as double) * 10) as scores,
         list_transform(range(0, 20), lambda i: cast((vec_id * 7 + i * i) % 64 as int)) as history
  from embeddings),
scores as (
  select row_id, batch_id, target, unnest(scores) as score,
         cast(generate_subscripts(scores, 1) - 1 as int) as token_id from score_rows),
history as (
  select row_id, unnest(history) as tok, generate_subscripts(history, 1) as i from score_rows)"""

QA = """turns as (
  select conv_id, turn, role, text,
         lag(role) over w as asked_role, lag(text) over w as question, lag(turn) over w as asked
  from conversations window w as (partition by conv_id order by turn)),
qa as (
  select t.conv_id * 100 + t.asked as qa_id, d.text as context, t.question, t.text as answer
  from turns t join documents d on d.doc_id = t.conv_id
  where t.role = 'assistant' and t.asked_role = 'user')"""
