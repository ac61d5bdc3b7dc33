"""Tokenizer and stored tokens over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.corpus import FRACTION, LENGTH, SPLIT, split_words
from millrace.catalog.registry import DOCS, QA, STREAM, hash_sql, joined, joined_sql, normalise_sql, query
from millrace.functions.text import SPACE
from millrace.operators import tokenize
from millrace.operators.ordered import ranked
from millrace.operators.pack import split_sizes
from millrace.plans.prepare import build_or_load_tokenizer, prepare_corpus, signed, training_batches
from millrace.plans.views import clean_documents, qa, table
from millrace.session import shared_folder
from millrace.sources.cache import read_tokens, write_tokens
from millrace.sources.corpus import content_identity, read_corpus, read_paragraphs
from millrace.sources.qa import read_qa

VOCAB = 400

_STORES: dict[tuple[str, str], tuple[str, str]] = {}


def store(spark, sf_dir) -> tuple[str, str]:
    """One folder and the identity of the documents, per session and source: a tokenizer is
    trained once, whoever asks for it first."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        raw = read_corpus(table(spark, sf_dir, "documents"))
        identity = content_identity(raw, ["doc_seq", "text"]).first().identity
        _STORES[key] = shared_folder(spark, "store"), identity
    return _STORES[key]


def tokenizer(spark, sf_dir):
    return build_or_load_tokenizer(clean_documents(spark, sf_dir), store(spark, sf_dir)[0], VOCAB,
                                   store(spark, sf_dir)[1])


def prepared_documents(spark, sf_dir):
    root, identity = store(spark, sf_dir)
    raw = read_corpus(table(spark, sf_dir, "documents"))
    return prepare_corpus(spark, raw, root, VOCAB, FRACTION, LENGTH, identity=identity)


@query("read_paragraphs", f"""
with {DOCS.replace('docs as', 'whole as')},
pieces as (
  select doc_seq, unnest(p) as piece, generate_subscripts(p, 1) as i from (
    select doc_seq, regexp_split_to_array(text, '(\\r\\n|\\n|\\r)({SPACE}*(\\r\\n|\\n|\\r))+') as p from whole)),
t as (select doc_seq, i, {normalise_sql("regexp_replace(piece, '\\r\\n?', chr(10), 'g')")} as text from pieces)
select row_number() over (order by doc_seq, i) as place, text from t where length(text) >= 120""")
def paragraphs(spark, sf_dir):
    """Documents written as one text corpus with line ends of all kinds, then read back by
    paragraph, in order."""
    folder = shared_folder(spark, "paragraphs")
    docs = clean_documents(spark, sf_dir).orderBy("doc_seq")
    ends = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (F.col("doc_seq") % 3 + 1).cast("int"))
    blank = F.concat(ends, F.lit(" \t"), ends)
    (docs.select(F.concat(F.replace("text", F.lit("\n"), ends), blank)).write
     .option("lineSep", "\n").text(folder))
    rows = ranked(read_paragraphs(spark, folder), ["doc_seq"], "place")
    return rows.select((F.col("place") + 1).alias("place"), "text")


@query("read_qa", f"""
with {QA} select qa_id, context, question, string_split(answer, chr(10))[1] as answer from qa""")
def nested_qa(spark, sf_dir):
    records = qa(spark, sf_dir).select(
        "qa_id", "context", "question",
        F.struct(F.split("answer", "\n").alias("text")).alias("answers"))
    return read_qa(records)


# DuckDB has no look-ahead: a mark before the last space of each run does its work.
RE_SPACE = (r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
            r"\x{205f}\x{3000}")
MARKED = rf"regexp_replace(text, '([{RE_SPACE}])([^{RE_SPACE}])', chr(1) || '\1\2', 'g')"
PIECES = (r"''(?:[sdmt]|ll|ve|re)|(?:\x01 )?\p{L}+|(?:\x01 )?\p{N}+"
          rf"|(?:\x01 )?[^{RE_SPACE}\p{{L}}\p{{N}}\x01]+|\x01?[{RE_SPACE}]+")


# Training in SQL.  A word is a text like <84><72>, so that replacing a pair's text merges it
# from left to right without overlap; each step merges the most frequent pair of all words.
TRAINING = f"""recursive {DOCS},
cut as (
  select doc_seq, replace(piece, chr(1), '') as word, i from (
    select doc_seq, unnest(p) as piece, generate_subscripts(p, 1) as i
    from (select doc_seq, regexp_extract_all({MARKED}, '{PIECES}') as p from docs))),
counted as (
  select word, count(*) as n, row_number() over (order by word) as wid from cut group by word),
shown as (
  select b, case when s then b else 255 + row_number() over (partition by s order by b) end as code from (
    select b, b between 33 and 126 or b between 161 and 172 or b >= 174 as s
    from (select unnest(range(256)) as b))),
symbols as materialized (
  select list(id order by b) as ids, list_prepend('<|endoftext|>', list(chr(cast(code as int)) order by code)) as texts
  from (select b, code, row_number() over (order by code) as id from shown)),
spelled as (
  select wid, n, list_transform(range(1, length(h), 2), lambda k: ids[cast('0x' || substr(h, k, 2) as int) + 1]) as s
  from (select wid, n, hex(encode(word)) as h, ids from counted, symbols)),
training as (
  select 0 as step, wid, n, '<' || array_to_string(s, '><') || '>' as w, 0 as l, 0 as r from spelled
  union all
  select t.step + 1, wid, n,
         replace(w, '<' || b.l || '><' || b.r || '>', '<' || (257 + t.step) || '>'), b.l, b.r
  from training t, (
    select p[1] as l, p[2] as r from (
      select n, unnest(list_zip(s, s[2:])) as p from (
        select n, cast(string_split(w[2:-2], '><') as int[]) as s from training))
    where p[2] is not null
    group by p having sum(n) >= 2 order by sum(n) desc, p[1], p[2] limit 1) b
  where t.step < {VOCAB - tokenize.FIRST_MERGE}),
merged as materialized (select distinct step, l, r from training where step > 0),
names as (
  select 0 as step, texts from symbols
  union all
  select n.step + 1, list_append(texts, texts[l + 1] || texts[r + 1])
  from names n join merged m on m.step = n.step + 1),
final as materialized (select texts from names order by step desc limit 1),
tokens as (select unnest(texts) as token, cast(generate_subscripts(texts, 1) - 1 as int) as id from final),
encodings as materialized (
  select wid, cast(string_split(arg_max(w, step)[2:-2], '><') as int[]) as ids from training group by wid),
encoded as (
  select doc_seq, flatten(list(ids order by i)) as ids
  from cut join counted using (word) join encodings using (wid) group by doc_seq)"""


@query("pre_token_counts", f"""
with {DOCS}
select replace(piece, chr(1), '') as word, count(*) as n
from (select unnest(regexp_extract_all({MARKED}, '{PIECES}')) as piece from docs) group by 1""")
def pre_tokens(spark, sf_dir):
    return tokenize.pre_token_counts(clean_documents(spark, sf_dir))


@query("learned_merges", f"""
with {TRAINING}
select cast(step - 1 as int) as rank, texts[l + 1] as left, texts[r + 1] as right from merged, final""")
def merges(spark, sf_dir):
    vocab, learned = tokenizer(spark, sf_dir)
    return tokenize.merge_texts(learned, vocab)


@query("vocabulary_report", f"""
with {TRAINING}
select cast({VOCAB} as bigint) as requested, count(*) as actual, count(*) = {VOCAB} as complete from tokens""")
def report(spark, sf_dir):
    return tokenize.vocabulary_report(tokenizer(spark, sf_dir)[0], VOCAB)


@query("token_ids", f"""
with {TRAINING}
select token, n, id from (select replace(word, ' ', 'Ġ') as token, n from counted) left join tokens using (token)""")
def lookups(spark, sf_dir):
    """Ids of all distinct pre-tokens in display form; null for those not in the vocabulary."""
    vocab, _ = tokenizer(spark, sf_dir)
    words = tokenize.pre_token_counts(clean_documents(spark, sf_dir))
    shown = words.select(F.replace("word", F.lit(" "), F.lit("Ġ")).alias("token"), "n")
    return tokenize.token_id(shown, vocab)


@query("encoded_documents", f"""
with {TRAINING}
select doc_seq, cast(len(ids) as int) as n_tokens, {joined_sql('ids')} as ids from encoded""")
def encoded(spark, sf_dir):
    _, learned = tokenizer(spark, sf_dir)
    rows = tokenize.encode(clean_documents(spark, sf_dir), learned)
    return rows.select("doc_seq", F.size("token_ids").alias("n_tokens"),
                       joined("token_ids").alias("ids"))


@query("decoded_documents", f"with {DOCS} select doc_seq, text from docs")
def decoded(spark, sf_dir):
    """Encoding and decoding gives the text back."""
    vocab, learned = tokenizer(spark, sf_dir)
    rows = tokenize.encode(clean_documents(spark, sf_dir), learned).select("doc_seq", "token_ids")
    return tokenize.decode(rows, vocab, out="text").select("doc_seq", "text")


@query("stored_tokens", f"""
with {SPLIT}
select split, count(distinct doc_seq) as docs, count(*) as n_tokens from pieces group by split""")
def stored_tokens(spark, sf_dir):
    """Word-token splits written under their signature, then read back; the
    second request finds them stored."""
    root, known = shared_folder(spark, "tokens"), signed(store(spark, sf_dir)[1], words=True)
    write_tokens(spark, lambda: split_words(spark, sf_dir), root, known)
    return split_sizes(read_tokens(spark, root, known))


TRAINED_SPLIT = SPLIT.replace(STREAM, TRAINING + """,
stream as (
  select doc_seq, tok, row_number() over (order by doc_seq, i) - 1 as pos from (
    select doc_seq, unnest(a) as tok, generate_subscripts(a, 1) as i
    from (select doc_seq, list_append(ids, 0) as a from encoded)))""")


@query("prepared_corpus", f"""
with {TRAINED_SPLIT}
select split, count(distinct doc_seq) as docs, count(*) as n_tokens from pieces group by split""")
def prepared(spark, sf_dir):
    """The whole preparation with the trained tokenizer."""
    return split_sizes(prepared_documents(spark, sf_dir).splits)


@query("prepared_checks", f"""
with {TRAINED_SPLIT},
facts as (select count(distinct doc_seq) as docs, count(*) filter (split = 'train') as train from pieces),
words as (select count(*) as actual from tokens)
select 'documents' as check, docs > 0 as ok, docs as detail from facts
union all select 'train_tokens', train > {LENGTH + 1}, train from facts
union all select 'windows', train - {LENGTH} > 0, train - {LENGTH} from facts
union all select 'end_marker', true, 1
union all select 'vocabulary', actual = {VOCAB}, actual from words""")
def prepared_checks(spark, sf_dir):
    """What must hold before training on the prepared corpus, and the size of its vocabulary."""
    made = prepared_documents(spark, sf_dir)
    size = made.report.select(F.lit("vocabulary").alias("check"), F.col("complete").alias("ok"),
                              F.col("actual").alias("detail"))
    return made.checks.unionByName(size)


@query("trained_batches", f"""
with {TRAINED_SPLIT},
train as (select pos, tok from pieces where split = 'train'),
draws as (
  select step, cast(row as int) as row,
         {hash_sql("'1337'", 'step', 'row')} % ((select count(*) from train) - {LENGTH}) as start
  from (select unnest(range(5, 25)) as step), (select unnest(range(0, 16)) as row))
select step, row, start,
  cast(list(tok order by pos) filter (pos < start + {LENGTH}) as varchar) as x,
  cast(list(tok order by pos) filter (pos > start) as varchar) as y
from draws join train on pos between start and start + {LENGTH} group by 1, 2, 3""")
def trained_batches(spark, sf_dir):
    """Batches of steps 5 to 24 from stored blocks of trained tokens."""
    pairs = training_batches(spark, prepared_documents(spark, sf_dir), "train", 20, 16, LENGTH, first_step=5)
    return pairs.select("step", "row", "start", joined("x").alias("x"), joined("y").alias("y"))
