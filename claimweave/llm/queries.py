"""Registered queries of the text operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimweave.llm.bpe import op5_byte_bpe
from claimweave.llm.decontaminate import op10_benchmark_hits
from claimweave.llm.exact_dedup import SQL as DEDUP_SQL
from claimweave.llm.exact_dedup import op12_exact_dedup
from claimweave.llm.jaccard_join import op2_ngram_jaccard_join
from claimweave.llm.lexical import SQL as LEXICAL_SQL
from claimweave.llm.lexical import op13_lexical_search
from claimweave.llm.licenses import SQL as LICENSE_SQL
from claimweave.llm.licenses import op8_license_digests
from claimweave.llm.merkle import SQL as MERKLE_SQL
from claimweave.llm.merkle import op11_merkle_manifest
from claimweave.llm.phrases import op3_phrase_fingerprints
from claimweave.llm.pii import op9_personal_data
from claimweave.llm.quality import op6_quality
from claimweave.llm.secrets import op7_secret_forest
from claimweave.llm.sharding import SQL as SHARD_SQL
from claimweave.llm.sharding import op1_hilbert_shards
from claimweave.llm.url_rules import op4_url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_shards,
        op2_ngram_jaccard_join,
        op3_phrase_fingerprints,
        op4_url_rules,
        op5_byte_bpe,
        op6_quality,
        op7_secret_forest,
        op8_license_digests,
        op9_personal_data,
        op10_benchmark_hits,
        op11_merkle_manifest,
        op12_exact_dedup,
        op13_lexical_search,
    )
}
SQL: dict[str, str] = {
    "op1_hilbert_shards": SHARD_SQL,
    "op8_license_digests": LICENSE_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
    "op12_exact_dedup": DEDUP_SQL,
    "op13_lexical_search": LEXICAL_SQL,
}
