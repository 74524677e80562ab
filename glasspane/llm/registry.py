"""The queries of this subpackage, by name, and their SQL where SQL expresses them."""

from .bpe import op4_byte_bpe
from .chunking import op1_chunk_fingerprints
from .decontaminate import op5_decontamination
from .divergence import OP12_SQL, op12_source_divergence
from .merkle import OP11_SQL, op11_merkle_manifest
from .pii import op2_pii_spans
from .quality import op10_quality_neighbours
from .repeats import OP13_SQL, op13_substring_dedup
from .shards import op6_tiered_shards
from .simhash import op8_simhash_groups
from .toxicity import op3_toxicity_trees
from .urls import op9_url_filter
from .warc import op7_warc_archive

QUERIES = {
    f.__name__: f
    for f in (
        op1_chunk_fingerprints, op2_pii_spans, op3_toxicity_trees, op4_byte_bpe, op5_decontamination,
        op6_tiered_shards, op7_warc_archive, op8_simhash_groups, op9_url_filter, op10_quality_neighbours,
        op11_merkle_manifest, op12_source_divergence, op13_substring_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_substring_dedup": OP13_SQL}
