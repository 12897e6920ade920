"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import wraps

from . import chunk_bpe, embedding_dedup, exact_dedup, fill_middle, packing, pii, prefix_trie, quality, secrets, simhash_dedup, slack_packing, token_files, toxicity
from .shared import importable


def ready(query):
    @wraps(query)
    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    q.__name__: ready(q)
    for q in (
        pii.op1_pii,
        secrets.op2_secrets,
        embedding_dedup.op3_embedding_dedup,
        exact_dedup.op4_exact_dedup,
        toxicity.op5_toxicity,
        simhash_dedup.op6_simhash_dedup,
        token_files.op7_token_files,
        chunk_bpe.op8_chunk_bpe,
        packing.op9_packing,
        quality.op10_quality,
        prefix_trie.op11_prefix_trie,
        fill_middle.op12_fill_middle,
        slack_packing.op13_slack_packing,
    )
}

SQL = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_fill_middle": fill_middle.OP12_SQL}
