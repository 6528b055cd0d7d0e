"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from parlance.llm import decontaminate, manifest, nearcopies, turntrie, urls, warc
from parlance.llm.common import spread, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scan(spark, sf_dir):
    from parlance.llm.secrets import secret_digests

    return secret_digests(spread(table(spark, sf_dir, "documents")))


def op2_sentencepiece(spark, sf_dir):
    from parlance.llm.pieces import piece_digests

    return piece_digests(spread(table(spark, sf_dir, "documents")), _tokenizer())


def op3_near_duplicates(spark, sf_dir):
    from parlance.llm.nearcopies import near_components

    return near_components(spread(table(spark, sf_dir, "documents")))


def op4_warc(spark, sf_dir):
    from parlance.llm.warc import warc_table

    return warc_table(spread(table(spark, sf_dir, "pages")))


def op5_url_filter(spark, sf_dir):
    from parlance.llm.urls import url_verdicts

    return url_verdicts(spread(table(spark, sf_dir, "pages")))


def op6_phrase_fingerprint(spark, sf_dir):
    from parlance.llm.phrases import phrase_table

    return phrase_table(spread(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark, sf_dir):
    from parlance.llm.decontaminate import find_leaks

    return find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op8_quality(spark, sf_dir):
    from parlance.llm.quality import quality_table

    return quality_table(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op9_repeats(spark, sf_dir):
    from parlance.llm.repeats import repeats_table

    return repeats_table(spread(table(spark, sf_dir, "documents")))


def op10_language_id(spark, sf_dir):
    from parlance.llm.language import language_table

    return language_table(spread(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark, sf_dir):
    return turntrie.prefix_trie(spread(table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark, sf_dir):
    from parlance.llm.manifest import manifest_table

    return manifest_table(spread(table(spark, sf_dir, "documents")))


def op13_token_counts(spark, sf_dir):
    import public_tokenizers

    from parlance.llm.tokencounts import token_counts

    return token_counts(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_sentencepiece, op3_near_duplicates, op4_warc, op5_url_filter, op6_phrase_fingerprint, op7_decontaminate, op8_quality, op9_repeats, op10_language_id, op11_prefix_trie, op12_merkle_manifest, op13_token_counts)}
SQL: dict[str, str] = {"op3_near_duplicates": nearcopies.SQL, "op4_warc": warc.SQL, "op5_url_filter": urls.SQL, "op7_decontaminate": decontaminate.SQL, "op11_prefix_trie": turntrie.SQL, "op12_merkle_manifest": manifest.SQL}
