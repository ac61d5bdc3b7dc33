"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (chat, cuckoo, language, lexical, links, mixing, neardup, pii, quality,
                          repair, rules, toxicity, trie_bpe)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"

# ASCII white space and words in DuckDB's patterns.
BLANK_SQL = r"[\x20\x09-\x0D]"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of the subpackage; the pipeline at the top of the repository is one."""
    import corpus_pipeline
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers
    return trie_bpe.read_vocabulary(public_tokenizers.path(VOCABULARY))


@query("op1_entropy_mix")
def entropy_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op2_cross_parse_language")
def cross_parse_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op3_odd_sketch_dedup", rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [w]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))) end as s
  from words),
items as (select doc_id, unnest(s) as item from sets),
joint as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from items a join items b using (item)
  where a.doc_id <> b.doc_id group by all),
links as (
  select a, b from joint join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
reach as (
  select doc_id as node, doc_id as other from sets
  union select r.node, l.b from reach r join links l on l.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(other) as component_id,
       s.doc_id = min(other) as kept
from sets s join reach on node = s.doc_id group by s.doc_id, len(s.s)""")
def odd_sketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=4)


@query("op4_fair_toxicity")
def fair_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_rule_ledger", rf"""
with docs as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{WORD_SQL}')) as l
  from documents),
starts as (
  select doc_id, i, list_slice(w, i, i + 7) as eight
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from docs)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, eight) as n from starts)
          where n > 1),
repeated as (
  select doc_id, count(distinct i + k) as n from again, (select unnest(range(0, 8)) as k)
  group by doc_id),
measures as (
  select doc_id, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(t, '{BLANK_SQL}', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(r.n, 0) as bigint) as n_repeat_words, len(l) as n_lines,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper,
         length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as n_letters,
         length(regexp_replace(t, '[^0-9]', '', 'g')) as n_digits
  from docs left join repeated r using (doc_id)),
judged as (
  select *, n_words < 20 as b0, 100 * n_repeat_words > 30 * n_words as b1, 2 * n_symbols > n_words as b2,
         100 * n_dup_lines > 30 * n_lines as b3, n_letters > 0 and 2 * n_upper > n_letters as b4,
         n_words > 0 and (word_chars < 2 * n_words or word_chars > 30 * n_words) as b5,
         10 * n_digits > 3 * word_chars as b6 from measures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       cast(b0::int + 2 * b1::int + 4 * b2::int + 8 * b3::int + 16 * b4::int + 32 * b5::int
            + 64 * b6::int as bigint) as failed_bits,
       b0 or b1 as base_failed, not (b0 or b1 or b2 or b3 or b4 or b5 or b6) as kept
from judged""")
def rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    entries = rules.ledger(table(spark, folder, "documents"))
    base = ~rules.passes(rules.POLICIES["base"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "failed_bits", base.alias("base_failed"),
        (~base & rules.passes(rules.POLICIES[rules.PRODUCTION])).alias("kept"))


@query("op6_shape_crf")
def shape_crf(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.private_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def _link_sql(src: str, dst: str, seed: str) -> str:
    """Scores of one direction after all steps, in table `<seed initial>`."""
    name = seed[0]
    start = f"cast(round({seed} * cast({1 - links.DAMPING!r} as double)) as bigint)"
    return f"""{name}w as (select {src} as src, {dst} as dst, count(*) over (partition by {src}) as degree
      from host_links),
{name}s as (
  select 0 as step, host, {start} as score from hosts
  union all
  select step + 1, host, first + cast(floor(coalesce(n, 0) * cast({links.DAMPING} as double)) as bigint)
  from (
    select s.step, h.host, any_value({start}) as first, sum(w.part) as n
    from (select distinct step from {name}s) s cross join hosts h
    left join (select dst, score // degree as part from {name}s join {name}w on {name}s.host = {name}w.src) w
      on w.dst = h.host
    group by s.step, h.host) where step < {links.STEPS}),
{name} as (select host, score from {name}s where step = {links.STEPS})"""


URL_SQL = rf"""
with recursive cut as (
  select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r
  from pages),
located as (
  select page_id, html, translate(regexp_extract(r, '^[^/?#]*'), '{links.UPPER}', '{links.LOWER}') as host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) as path from cut),
ruled as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and path like '/en/%' then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and path like '/en/%' then 'example.com/en/'
    when (host = 'net' or host like '%.net') and path like '/es/%' then 'net/es/'
    when (host = 'net' or host like '%.net') and path like '/fr/%' then 'net/fr/'
    when (host = 'com' or host like '%.com') and path like '/%' then 'com/' end as rule from located),
judged as (
  select *, case when rule in ('com/', 'www.example.com/en/') then 'allow'
                 when rule is not null then 'block' end as v from ruled),
hrefs as (
  select host as src, unnest(regexp_extract_all(html, 'href\s*=\s*["'']?(?:https?:)?//([^"''\s>]+)', 1, 'i')) as t
  from judged),
host_links as (
  select distinct src, dst from (
    select src, translate(regexp_extract(t, '^[^/?#]*'), '{links.UPPER}', '{links.LOWER}') as dst from hrefs)
  where src <> '' and dst <> '' and src <> dst),
hosts as (
  select host, max(good) as good, max(bad) as bad from (
    select host, cast(round(count(case when v = 'allow' then 1 end) * 1000000000.0::double / count(*)) as bigint) as good,
           cast(round(count(case when v = 'block' then 1 end) * 1000000000.0::double / count(*)) as bigint) as bad
    from judged where host <> '' group by host
    union all select src, 0, 0 from host_links union all select dst, 0, 0 from host_links)
  group by host),
{_link_sql('src', 'dst', 'good')},
{_link_sql('dst', 'src', 'bad')}
select page_id, j.host, path, rule, t.score as trust, d.score as distrust,
       coalesce(v, case when d.score - t.score > {int(links.MARGIN * (1 - links.DAMPING) * links.UNIT)}
                        then 'block' else 'allow' end) as verdict
from judged j left join g t on t.host = j.host left join b d on d.host = j.host"""


@query("op7_link_trust", URL_SQL)
def link_trust(spark: SparkSession, folder: str) -> DataFrame:
    return links.filter_urls(table(spark, folder, "pages"))


@query("op8_pairwise_quality")
def pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_cuckoo_dedup", rf"""
with hashed as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK_SQL}+', ' ', 'g')) as h
  from documents)
select doc_id, min(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = min(doc_id) over (partition by h) as kept, h as text_sha256
from hashed""")
def cuckoo_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cuckoo.deduplicate(table(spark, folder, "documents"))


@query("op10_trie_bpe")
def encoded_and_decoded(spark: SparkSession, folder: str) -> DataFrame:
    back = trie_bpe.round_trip(table(spark, folder, "documents"), vocabulary())
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


#: A conversation made of the template's own control strings, formatted beside the table's.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


@query("op11_typed_chat", rf"""
with messages as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')),
marked as (
  select *, len(regexp_extract_all(role || chr(0) || text, '\\|{chat.CONTROL}')) as n_escaped from messages)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), ''))
         as loss_sha256,
       cast(sum(length(role) + length(text) + n_escaped + {len(chat.OPEN + chat.BODY + chat.DONE + chat.CLOSE)})
            as bigint) as formatted_chars,
       0::bigint as n_attachments, 0::bigint as attachment_tokens
from marked group by conv_id""")
def typed_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, k, role, PROBE_TEXT) for k, role in enumerate(
        ("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.formatted(chat.text_parts(rows.unionByName(probe))))


@query("op12_lexical_blas", rf"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}') as w from documents),
totals as (select count(*) filter (len(w) > 0) as n_docs, cast(sum(len(w)) as bigint) as n_terms from docs),
wanted as (
  select item_id, term, count(*) as c from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')) as term from benchmark)
  group by all),
lengths as (
  select doc_id, w, 100 - 75 + ((75 * cast(len(w) as bigint) * n_docs) // n_terms) as m from docs, totals),
counted as (
  select doc_id, m, term, count(*) as tf from (select doc_id, m, unnest(w) as term from lengths)
  where term in (select term from wanted) group by all),
holding as (select term, count(*) as df from counted group by term),
weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1))) as bigint) as w
  from holding, totals),
scored as (
  select item_id, doc_id,
         cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from wanted join weights using (term) join counted using (term) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank,
       doc_id, score
from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= {lexical.TOP}""")
def lexical_blas(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


REPAIR_SQL = rf"""
with recursive table_of as (
  select list(c order by b) as t from (
    select b, list_reduce([b::bigint] || range(8), lambda c, k: case when c & 1 = 1
      then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as b))),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as was, coalesce(text, ' ') as said,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
kinds as (
  select conv_id, turn, was, said, xor(list_reduce([4294967295::bigint] || list_transform(
      string_split(k, ''), lambda x: ascii(x)::bigint),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 as kind
  from keyed, table_of),
damaged as (
  select conv_id, turn, was, case when kind = 4 then 'user' else was end as role,
         case when kind = 1 then '' when kind = 2 then regexp_replace(said, '[.!?]', '', 'g') else said end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from kinds where kind <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, was, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, was, copy) as nth,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) as final
  from damaged),
marked as (
  select conv_id, i, turn, role, text, role[1] as initial,
         case when final = '' then 'blank' when nth > 1 then 'duplicate'
              when final not in ('.', '!', '?') then 'truncated' end as fault from numbered),
inserts(st, n, st2, added) as (values (0, 0, 0, []::varchar[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []),
  (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
  (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:'])),
reads(st, initial, st2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
steps as (
  select distinct conv_id, 0::bigint as i, 0 as st, {{'cost': 0::bigint, 'audit': '', 'rep': []::varchar[]}} as way
  from conversations
  union all
  select conv_id, i, st, min(way) from (
    select p.conv_id, m.i, e.st as st,
           {{'cost': p.way.cost + 3 * ins.n + e.cost, 'audit': p.way.audit || repeat('I', ins.n) || e.letter,
             'rep': p.way.rep || ins.added || e.kept}} as way
    from steps p join marked m on m.conv_id is not distinct from p.conv_id and m.i = p.i + 1
    join inserts ins on ins.st = p.st,
    lateral (
      select ins.st2 as st, 4 as cost, 'D' as letter, []::varchar[] as kept
      union all
      select r.st2, case when m.fault is null then 0 else 3 end, 'K', [m.role || ':' || m.text]
      from reads r where r.st = ins.st2 and r.initial = m.initial and (m.fault is null or m.fault = 'truncated')
      union all
      select case when ins.st2 = 2 then 3 else 2 end, case when m.fault is null then 3 else 6 end, 'R',
             [case when ins.st2 = 2 then 'assistant:' else 'user:' end || m.text]
      where m.fault is null or m.fault = 'truncated') e)
  group by all),
ends as (
  select p.conv_id, min({{'cost': p.way.cost + 3 * ins.n, 'audit': p.way.audit || repeat('I', ins.n),
                          'rep': p.way.rep || ins.added}}) as way
  from steps p join inserts ins on ins.st = p.st
  where ins.st2 in (0, 3)
    and p.i = (select count(*) from marked m where m.conv_id is not distinct from p.conv_id)
  group by p.conv_id),
pairs as (
  select *, lag(initial) over (partition by conv_id order by i) as prior, i > 1 as later from marked),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (later and prior || initial not in ('su', 'ua', 'au')) as illegal
  from pairs group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, e.way.cost as cost,
       e.way.audit as audit, sha256(array_to_string(e.way.rep, chr(10))) as repaired_sha256
from ends e left join facts f on f.conv_id is not distinct from e.conv_id"""


@query("op13_glr_repair", REPAIR_SQL)
def glr_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, folder, "conversations"))
