"""The registered queries of the operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskmill.llm import chat, divergence, fptree, htmltext, linedup, mixing, packing, quality, sanitise, separators, simhash, spots, suffixtree
from deskmill.llm.common import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, Query] = {}


def query(job: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        small_batches(spark)
        return job(spark, sf_dir)

    CATALOG[job.__name__] = run
    return run


@query
def op1_spot_signatures(spark, sf_dir):
    return spots.edit_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query
def op3_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.with_main_text(pages).select("page_id", "url", "text", "n_chars")


@query
def op4_token_counts(spark, sf_dir):
    return separators.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_sanitise(spark, sf_dir):
    return sanitise.span_report(sanitise.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op6_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = F.inline(
        F.array(*(F.struct(F.lit(-7).cast("long"), F.lit(t).cast("long"), F.lit(r), F.lit(said)) for t, r in ((0, "user"), (1, "assistant"))))
    )
    probe = spark.range(1).select(extra).toDF("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


@query
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedup_lines(docs)


@query
def op8_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


@query
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_verdict(docs).drop("text", "cleaned")


@query
def op11_ranked_search(spark, sf_dir):
    return fptree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_lm_scores(spark, sf_dir):
    return suffixtree.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: SQL counterparts, where SQL can express the query.
ORACLE: dict[str, str] = {
    "op11_ranked_search": fptree.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
