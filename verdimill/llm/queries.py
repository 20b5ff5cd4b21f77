"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from .bpe import tokenize_documents
from .common import table
from .html_extract import extract_pages
from .mixing import MIX_SQL, mix_documents
from .quality import quality_rules
from .sharding import shard_documents
from .simhash import near_duplicates
from .substring import near_passages
from .topk import TOPK_SQL, top_k
from .toxicity import toxicity
from .warc import WARC_SQL, archive_round_trip

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark, sf_dir):
    """Fingerprints and components of all documents; nulls, ties and repeated rows as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark, sf_dir):
    """Ids and the text decoded from them, as digests, for all documents; a null text is empty."""
    return tokenize_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_toxicity(spark, sf_dir):
    """Scores of all documents; the rest as in ``toxicity``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark, sf_dir):
    """Main texts of all pages; the rest as in ``extract_pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_exact_topk(spark, sf_dir):
    """The best of all vectors for every twentieth id; the rest as in ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_ring_sharding(spark, sf_dir):
    """Shards of all documents; the rest as in ``shard_documents``."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark, sf_dir):
    """The mix of all documents; the rest as in ``mix_documents``."""
    return mix_documents(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    """All pages as read back from their archives; the rest as in ``archive_round_trip``."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark, sf_dir):
    """Measures and verdicts of all documents; the rest as in ``quality_rules``."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    """Repeated passages of all documents; the rest as in ``near_passages``."""
    return near_passages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_byte_bpe, op3_toxicity, op4_html_extraction, op5_exact_topk, op6_ring_sharding, op7_source_mixing, op8_warc, op9_quality_rules, op10_substring_dedup)}
ORACLE = {"op5_exact_topk": TOPK_SQL, "op7_source_mixing": MIX_SQL, "op8_warc": WARC_SQL}
