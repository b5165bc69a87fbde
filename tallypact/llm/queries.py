"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tallypact.llm import (
    chat,
    decontaminate,
    fill_middle,
    hard_negatives,
    kneser_ney,
    packing,
    pii,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    suffix_array,
    toxicity,
)
from tallypact.llm.common import table


def _documents(digest, *others):
    """A query that gives an operator the documents and the other tables it reads."""
    return lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"), *[table(spark, sf_dir, t) for t in others])


QUERIES = {
    "op1_substring_dedup": _documents(substring_dedup.digest),
    "op2_quality_rules": _documents(quality_rules.verdicts),
    "op3_simhash": _documents(simhash.digest),
    "op4_suffix_array": _documents(suffix_array.digest),
    "op5_packing": _documents(packing.digest),
    "op6_kneser_ney": _documents(kneser_ney.classify, "labels"),
    "op7_decontaminate": _documents(decontaminate.digest, "benchmark"),
    "op8_chat": lambda spark, sf_dir: chat.digest(chat.with_probe(table(spark, sf_dir, "conversations"))),
    "op9_toxicity": _documents(toxicity.digest, "labels"),
    "op10_pii": _documents(pii.digest),
    "op11_fill_middle": _documents(fill_middle.digest),
    "op12_hard_negatives": lambda spark, sf_dir: hard_negatives.digest(table(spark, sf_dir, "embeddings")),
    "op13_sharding": _documents(sharding.digest),
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op8_chat": chat.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_sharding": sharding.ORACLE,
}
