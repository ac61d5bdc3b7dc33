"""A corpus from raw documents to stored token splits, and batches from what is stored."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import text_signature
from millrace.operators import tokenize
from millrace.operators.clean import clean, limit_raw, readiness, sample_documents
from millrace.operators.ordered import spread
from millrace.operators.pack import append_eot, draw_starts, pack, shifted, split_sizes, split_stream
from millrace.session import path_exists, written
from millrace.sources.blocks import has_blocks, stream_tokens, windows_at, write_blocks
from millrace.sources.cache import read_vocab, write_tokens, write_vocab
from millrace.sources.corpus import CLEAN_VERSION, content_identity


class Prepared(NamedTuple):
    """What a preparation leaves: its signature, stored splits `(split, doc_seq, start_pos,
    n_tokens, token_ids)`, the folder of their blocks, the tokenizer, its report, and what
    must hold before training starts as `(check, ok, detail)`."""

    signature: str
    splits: DataFrame
    blocks: str
    vocab: DataFrame
    merges: DataFrame
    report: DataFrame
    checks: DataFrame


def signed(identity: str, **settings) -> str:
    """16 hex digits of a corpus and of every setting that changes what is made of it."""
    text = identity + "".join(f"|{k}={v}" for k, v in sorted(settings.items())) + f"|clean={CLEAN_VERSION}"
    spark = SparkSession.getActiveSession()
    return spark.range(1).select(text_signature(F.lit(text)).alias("s")).first().s


def build_or_load_tokenizer(docs: DataFrame, root: str, vocab_size: int, identity: str, max_articles: int = 0,
                            sample: int | None = None, seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """`(vocab, merges)` stored under `root` for this corpus, trained when missing: on all
    documents, or on a uniform sample of `sample` of them."""
    spark = docs.sparkSession
    known = signed(identity, vocab=vocab_size, max_articles=max_articles, sample=sample,
                   seed=None if sample is None else seed)
    folder = f"{root.rstrip('/')}/tokenizer_{vocab_size}_{known}"
    if not path_exists(spark, f"{folder}/merges/_SUCCESS"):
        chosen = docs if sample is None else sample_documents(docs, sample, seed)
        merges = tokenize.train(tokenize.pre_token_counts(chosen), vocab_size)
        write_vocab(tokenize.vocabulary(merges), merges, folder)
    return read_vocab(spark, folder)


def prepare_corpus(spark: SparkSession, raw: DataFrame, root: str, vocab_size: int = 32768,
                   fraction: float = 0.01, length: int = 512, with_eot: bool = True, max_articles: int = 0,
                   sample: int | None = None, seed: int = 1337, identity: str | None = None) -> Prepared:
    """Tokenizer, stored splits, blocks, report and checks of `raw(doc_seq, text)`.

    The signature comes from the content of `raw` and every setting here; pass an
    `identity` that is known (of a ledger, say) to save reading `raw` for it.  What is
    stored under the signature is not made again.  `max_articles` limits the raw documents
    (0: all), `sample` those that the tokenizer learns from (None: all).
    """
    root = root.rstrip("/")
    identity = identity or content_identity(raw, ["doc_seq", "text"]).first().identity
    signature = signed(identity, vocab=vocab_size, fraction=fraction, length=length, eot=with_eot,
                       max_articles=max_articles, sample=sample, seed=None if sample is None else seed)
    docs = clean(spread(limit_raw(raw, max_articles), "doc_seq"))
    vocab, merges = build_or_load_tokenizer(docs, root, vocab_size, identity, max_articles, sample, seed)

    def make() -> DataFrame:
        encoded = tokenize.encode(docs, merges).select("doc_seq", "token_ids")
        if with_eot:
            encoded = append_eot(encoded, tokenize.END_ID)
        # Lengths get a column of their own: counting reads no tokens.
        stored = written(encoded.withColumn("n_tokens", F.size("token_ids")), "encoded")
        return split_stream(pack(stored), stored.select("n_tokens"), fraction, length)

    splits = write_tokens(spark, make, f"{root}/tokens", signature)
    blocks = f"{root}/blocks_{signature}"
    if not has_blocks(spark, blocks):
        write_blocks(splits, blocks)
    n_docs = splits.agg(F.count_distinct("doc_seq").alias("n_docs"))
    checks = readiness(split_sizes(splits).select("split", "n_tokens"), n_docs, length,
                       vocab.where(F.col("id") == tokenize.END_ID).count() > 0, with_eot)
    return Prepared(signature, splits, blocks, vocab, merges,
                    tokenize.vocabulary_report(vocab, vocab_size), checks)


def training_batches(spark: SparkSession, prepared: Prepared, split: str, steps: int, batch: int,
                     length: int, seed: int = 1337, first_step: int = 0) -> DataFrame:
    """`(step, row, start, x, y)`: seeded windows of a stored split, for steps from
    `first_step` on.  Only blocks that the windows touch are read."""
    n_windows = max(stream_tokens(spark, prepared.blocks, split) - length, 0)
    ids = spark.range(first_step, first_step + (steps if n_windows else 0))
    starts = draw_starts(ids, F.lit(max(n_windows, 1)), batch, seed)
    return shifted(windows_at(spark, prepared.blocks, split, starts, length), length)
