"""The queries of this subpackage, one per operator, and their SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_tree, ngram_join, packing, pii_votes, quality_bayes, quality_rules, toxicity_fm, warc
from . import oracles, piece_bpe, token_rollup
from .common import new_path, staged, table


def tokenizer_file(name: str) -> str:
    """A public vocabulary file, where the installed package has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "failed_lines")))


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_fm.fit(toxicity_fm.labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = toxicity_fm.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity_fm.held_out().alias("held_out"), "score", (F.col("score") >= toxicity_fm.THRESHOLD).cast("int").alias("predicted"))


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def _rollup(spark: SparkSession, counted: DataFrame, versions: dict[str, tuple[str, str]]) -> DataFrame:
    """All documents are inserted (twice, by one batch id), copies of a text but the first deleted, and texts without their repeated lines revised.

    versions: of each tokenizer version, the columns of counted that hold the counts of a text and of the revised one.
    """
    rollup = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    before = {v: c for v, (c, _) in versions.items()}
    for _ in range(2):
        rollup.commit("load", token_rollup.changes(counted, before, 1))
    counts = sorted({c for pair in versions.values() for c in pair})
    stay = staged(counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "lang", *counts)).alias("x")).select("x.*"), "stay")
    rollup.commit("copies", token_rollup.changes(counted, before, -1).unionByName(token_rollup.changes(stay, before, 1)))
    rollup.commit("lines", token_rollup.revisions(stay, versions))
    return rollup.totals()


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, digest, text, revised (without repeated lines), and the words of both: w0, w1."""
    words = lambda c: F.expr(f"size({quality_rules.words_of(f'coalesce({c}, {chr(39) * 2})')})").cast("long")
    base = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text", F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n").alias("revised"))
    return base.withColumns({"w0": words("text"), "w1": words("revised")})


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and the tokens of a tokenizer file, through three batches; see _rollup()."""
    counted = staged(token_rollup.count_tokens(_words(table(spark, sf_dir, "documents")), {"text": "t0", "revised": "t1"}, tokenizer_file("word_bpe_49k.json")), "counts")
    return _rollup(spark, counted, {"words/1": ("w0", "w1"), "word_bpe_49k/1": ("t0", "t1")})


def llm_word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word counts of op5 alone, which SQL can check."""
    counted = staged(_words(table(spark, sf_dir, "documents")).drop("text", "revised"), "counts")
    return _rollup(spark, counted, {"words/1": ("w0", "w1")})


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=False, with_text=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), percent=85, words=4)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def _pii(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The contract's columns, and how many spans there are of the other kinds and in all."""
    found = pii_votes.annotate(docs.select("doc_id", "text"), weights=weights, keep_text=False)
    n = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii_votes.BASE]
    more = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii_votes.KINDS if k not in pii_votes.BASE]
    base = F.sha2(F.expr(pii_votes.listed("filter(spans, s -> s.base)")), 256).alias("base_sha256")
    return found.select("doc_id", *n, base, F.expr(pii_votes.listed("spans")).alias("spans"), *more, F.size("spans").cast("long").alias("n_spans"))


def op10_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii(table(spark, sf_dir, "documents"))


def llm_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10 alone, which SQL can check."""
    return _pii(table(spark, sf_dir, "documents"), {}).select("doc_id", *(f"n_{k}" for k in pii_votes.BASE), "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality_bayes, op2_quality_rules, op3_toxicity_fm, op4_ann_tree, op5_token_rollup, op6_piece_bpe, op7_warc, op8_ngram_join, op9_packing, op10_pii_votes, llm_word_rollup, llm_pii_base)
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": oracles.OP2, "op7_warc": oracles.OP7, "llm_word_rollup": oracles.WORD_ROLLUP, "llm_pii_base": oracles.PII_BASE}
