"""Sources, cleaning, packing and windows over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import (DOCS, STREAM, WORDS, hash_sql, joined, joined_sql,
                                       normalise_sql, query)
from millrace.functions.hashing import seeded_hash
from millrace.functions.text import normalise
from millrace.operators import clean, pack
from millrace.operators.ordered import chunk_of
from millrace.plans.views import clean_documents, table, word_documents
from millrace.sources.corpus import content_identity, read_corpus, source_signature

FRACTION, LENGTH = 0.01, 256


def dense():
    """The ids of the test tables have no gaps worth a look."""
    return chunk_of("doc_seq")


@query("read_corpus", """
select doc_id as doc_seq, text from documents""")
def read(spark, sf_dir):
    return read_corpus(table(spark, sf_dir, "documents"))


@query("read_corpus_missing_column", f"""
with {DOCS} select doc_seq, text from docs""")
def read_missing(spark, sf_dir):
    """Two sources in one corpus; the one without the text column adds nothing."""
    docs = table(spark, sf_dir, "documents")
    return clean.clean(read_corpus(docs).union(read_corpus(docs, "body")))


def content_sql(*columns: str) -> str:
    """The identity of a table's rows."""
    row = " || '|' || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in columns)
    half = lambda start: f"sum(cast('0x' || substr(md5({row}), {start}, 15) as bigint))"
    return f"'content:' || count(*) || ':' || coalesce({half(1)}, 0) || ':' || coalesce({half(16)}, 0)"


@query("source_signature", f"""
select substr(sha256({content_sql('doc_id', 'text')} ||
  '|col=text|vocab=32768|eot=True|max_articles=0|val_fraction=0.01|clean=v2'), 1, 16)
  as signature, count(*) as rows from documents""")
def signature(spark, sf_dir):
    """Signed by content: any row that changes, comes or goes changes it."""
    docs = table(spark, sf_dir, "documents")
    known = content_identity(docs, ["doc_id", "text"])
    return known.select(source_signature(F.col("identity")).alias("signature"),
                        docs.agg(F.count("*")).scalar().alias("rows"))


@query("normalise_text", f"""
select doc_id, {normalise_sql('text')} as text from documents""")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalise(F.col("text"))
                                                    .alias("text"))


@query("clean_documents", f"""
with {DOCS} select doc_seq, text, cast(length(text) as int) as chars from docs""")
def cleaned(spark, sf_dir):
    return clean_documents(spark, sf_dir).withColumn("chars", F.length("text"))


@query("limit_raw_rows", f"""
with firsts as (select doc_id, text from documents order by doc_id limit 600),
t as (select doc_id as doc_seq, {normalise_sql('text')} as text from firsts)
select doc_seq, text from t where length(text) >= 120""")
def limit_raw(spark, sf_dir):
    docs = read_corpus(table(spark, sf_dir, "documents"))
    return clean.clean(clean.limit_raw(docs, 600, dense()))


@query("limit_kept_rows", f"""
with {DOCS} select doc_seq, text from docs order by doc_seq limit 600""")
def limit_kept(spark, sf_dir):
    return clean.limit_kept(clean_documents(spark, sf_dir), "doc_seq", 600, dense())


@query("sample_documents", f"""
with {DOCS} select doc_seq, text from docs
order by {hash_sql("'1337'", 'doc_seq')}, doc_seq limit 300""")
def sample(spark, sf_dir):
    return clean.sample_documents(clean_documents(spark, sf_dir), 300)


@query("corpus_counts", f"""
with {WORDS}
select count(*) as docs, cast(sum(len(ids)) as bigint) as tokens,
       cast(max(len(ids)) as bigint) as longest from words""")
def counts(spark, sf_dir):
    return word_documents(spark, sf_dir).agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"),
        F.max("n_tokens").cast("bigint").alias("longest"))


@query("corpus_progress", f"""
with {WORDS},
placed as (select (row_number() over (order by doc_seq) - 1) // 64 as batch, len(ids) as n from words),
b as (select batch, count(*) as d, sum(n) as t from placed group by batch)
select batch, cast(sum(d) over w as bigint) as docs_done, cast(sum(t) over w as bigint)
  as tokens_done, batch % 5 = 0 as shown
from b window w as (order by batch)""")
def progress(spark, sf_dir):
    docs = word_documents(spark, sf_dir).select("doc_seq", "n_tokens")
    return clean.corpus_progress(docs, batch=64, every=5, chunk=dense())


SPLIT = f"""{STREAM},
cuts as (select count(*) as n, least(cast(floor(cast(count(*) as double) * cast({FRACTION} as double)) as bigint),
                count(*) // 10) as head from stream),
pieces as (
  select 'val' as split, doc_seq, tok, pos from stream, cuts where head < {LENGTH + 1} or pos < head
  union all
  select 'train', doc_seq, tok, case when head < {LENGTH + 1} then pos else pos - head end
  from stream, cuts where head < {LENGTH + 1} or pos >= head)"""


def split_words(spark, sf_dir):
    docs = word_documents(spark, sf_dir)
    lengths = docs.select("n_tokens")
    return pack.split_stream(pack.pack(docs, dense()), lengths, FRACTION, LENGTH)


@query("append_end_marker", f"""
with {WORDS} select doc_seq, {joined_sql('ids')} as ids from words""")
def append_eot(spark, sf_dir):
    return word_documents(spark, sf_dir).select("doc_seq", joined("token_ids").alias("ids"))


@query("distinct_tokens", f"""
with {WORDS}
select doc_seq, count(distinct t) as n, cast(sum(distinct t) as bigint) as total
from (select doc_seq, unnest(ids) as t from words) group by doc_seq""")
def distinct_tokens(spark, sf_dir):
    unique = F.array_distinct("token_ids")
    return word_documents(spark, sf_dir).select(
        "doc_seq", F.size(unique).cast("bigint").alias("n"),
        F.aggregate(unique, F.lit(0).cast("bigint"), lambda a, t: a + t).alias("total"))


@query("pack_stream", f"""
with {WORDS}
select doc_seq, cast(len(ids) as int) as n_tokens,
       cast(coalesce(sum(len(ids)) over (order by doc_seq rows between unbounded preceding
            and 1 preceding), 0) as bigint) as start_pos
from words""")
def pack_stream(spark, sf_dir):
    return pack.pack(word_documents(spark, sf_dir), dense()).select("doc_seq", "n_tokens", "start_pos")


@query("pack_hashed_ids", f"""
with {WORDS}, h as (select {hash_sql("'5'", 'doc_seq')} as doc_seq, len(ids) as n from words)
select doc_seq, cast(n as int) as n_tokens,
       cast(coalesce(sum(n) over (order by doc_seq rows between unbounded preceding
            and 1 preceding), 0) as bigint) as start_pos
from h""")
def pack_hashed_ids(spark, sf_dir):
    """The same documents under ids that are anything but dense."""
    docs = word_documents(spark, sf_dir).select(
        seeded_hash(5, F.col("doc_seq")).alias("doc_seq"), "n_tokens")
    return pack.pack(docs)


CLUSTERED = ("case when doc_seq % 2 = 0 then 1000000000000000 + doc_seq % 16 "
             "when doc_seq % 3 = 0 then 7 else doc_seq * 1000003 - 500000000 end")


@query("pack_clustered_ids", f"""
with {WORDS}, c as (select {CLUSTERED} as id, len(ids) as n from words),
g as (select id, count(*) as docs, sum(n) as n_tokens from c group by id)
select id as doc_seq, docs, cast(n_tokens as bigint) as n_tokens,
       cast(coalesce(sum(n_tokens) over (order by id rows between unbounded preceding and 1 preceding), 0)
            as bigint) as start_pos
from g""")
def pack_clustered_ids(spark, sf_dir):
    """Documents of which half lie in one cluster of ids, with ids that many share."""
    docs = word_documents(spark, sf_dir).select(F.expr(CLUSTERED).alias("doc_seq"), "n_tokens")
    return pack.pack(docs).groupBy("doc_seq").agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start_pos").alias("start_pos"))


@query("first_of_repeated_ids", f"""
with {WORDS}, c as (select {CLUSTERED} as id from words),
r as (select id, row_number() over (order by id) as place from c)
select id as doc_seq, count(*) as docs from r where place <= 500 group by id""")
def first_of_repeated_ids(spark, sf_dir):
    """A limit that falls among rows of one id keeps exactly as many rows."""
    docs = word_documents(spark, sf_dir).select(F.expr(CLUSTERED).alias("doc_seq"), "n_tokens")
    return clean.limit_raw(docs, 500).groupBy("doc_seq").agg(F.count("*").alias("docs"))


@query("split_stream", f"""
with {SPLIT}
select split, doc_seq, cast(min(pos) as bigint) as start_pos, cast(count(*) as int) as n_tokens,
       cast(list(tok order by pos) as varchar) as ids
from pieces group by split, doc_seq""")
def split_stream(spark, sf_dir):
    return split_words(spark, sf_dir).select("split", "doc_seq", "start_pos", "n_tokens",
                                             joined("token_ids").alias("ids"))


@query("split_sizes", f"""
with {SPLIT}
select split, count(distinct doc_seq) as docs, count(*) as n_tokens from pieces group by split""")
def split_sizes(spark, sf_dir):
    return pack.split_sizes(split_words(spark, sf_dir))


@query("readiness_checks", f"""
with {SPLIT},
f as (select (select count(*) from docs) as d,
             (select count(*) from pieces where split = 'train') as t)
select 'documents' as "check", d > 0 as ok, d as detail from f union all
select 'train_tokens', t > {LENGTH + 1}, t from f union all
select 'windows', t - {LENGTH} > 0, t - {LENGTH} from f union all
select 'end_marker', true, 1 from f""")
def readiness(spark, sf_dir):
    sizes = pack.split_sizes(split_words(spark, sf_dir))
    n_docs = clean_documents(spark, sf_dir).agg(F.count("*").alias("n_docs"))
    return clean.readiness(sizes, n_docs, LENGTH, has_eot=True)


WINDOW = 8


@query("sliding_windows", f"""
with {STREAM},
w as (select pos, tok, sum(tok * (pos % 97 + 1)) over r as mix, count(*) over r as n,
             last_value(tok) over r as final
      from stream window r as (order by pos rows between current row and {WINDOW} following))
select pos // 4096 as part, count(*) as windows, cast(sum(tok) as bigint) as first_tokens,
       cast(sum(final) as bigint) as last_tokens, cast(sum(mix) as bigint) as mix
from w where n = {WINDOW + 1} group by 1""")
def sliding_windows(spark, sf_dir):
    made = pack.windows(pack.pack(word_documents(spark, sf_dir), dense()), WINDOW)
    mix = F.aggregate(F.transform("w", lambda t, i: t * ((F.col("start") + i) % 97 + 1)),
                      F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.groupBy(F.expr("start div 4096").alias("part")).agg(
        F.count("*").alias("windows"), F.sum(F.get("w", F.lit(0))).alias("first_tokens"),
        F.sum(F.element_at("w", -1)).alias("last_tokens"), F.sum(mix).alias("mix"))


@query("strided_windows", f"""
with {STREAM}
select pos // {LENGTH + 1} * {LENGTH + 1} as start,
       cast(list(tok order by pos) as varchar) as w
from stream group by 1 having count(*) = {LENGTH + 1}""")
def strided_windows(spark, sf_dir):
    made = pack.windows(pack.pack(word_documents(spark, sf_dir), dense()), LENGTH, LENGTH + 1)
    return made.select("start", joined("w").alias("w"))


DRAWS = f"""{STREAM},
n as (select count(*) - {LENGTH} as windows from stream),
draws as (
  select step, row, {hash_sql("'1337'", 'step', 'row')} % windows as start
  from n, (select unnest(range(0, 20)) as step), (select unnest(range(0, 16)) as row))"""


def drawn(spark, sf_dir):
    docs = word_documents(spark, sf_dir)
    lengths = docs.select("n_tokens")
    starts = pack.draw_starts(spark.range(20), pack.stream_length(lengths) - LENGTH, 16, 1337)
    return pack.sampled_windows(pack.pack(docs, dense()), starts, LENGTH)


@query("sampled_windows", f"""
with {DRAWS}
select step, cast(row as int) as row, start,
       cast(list(tok order by pos) as varchar) as w
from draws join stream on pos between start and start + {LENGTH} group by 1, 2, 3""")
def sampled_windows(spark, sf_dir):
    return drawn(spark, sf_dir).select("step", "row", "start", joined("w").alias("w"))


@query("shifted_pairs", f"""
with {DRAWS}
select step, cast(row as int) as row, start,
  cast(list(tok order by pos) filter (pos < start + {LENGTH}) as varchar) as x,
  cast(list(tok order by pos) filter (pos > start) as varchar) as y
from draws join stream on pos between start and start + {LENGTH} group by 1, 2, 3""")
def shifted_pairs(spark, sf_dir):
    pairs = pack.shifted(drawn(spark, sf_dir), LENGTH)
    return pairs.select("step", "row", "start", joined("x").alias("x"), joined("y").alias("y"))
