"""Corpus pipeline over ``documents``: quality rules, near-duplicates, benchmark leaks, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from sievework.llm import bagminhash, mixing, quality, sharding, templates
from sievework.llm.common import drop_path, made_since, mark, materialise, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays, the one of the smallest doc_id."""
    return bagminhash.deduplicate(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return templates.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def shards(spark, docs, sf_dir):
    """Placement of each row: doc_id, size, checksum, law, shard, slot, and the shard if there were one more."""
    return sharding.assign(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]
#: Signatures and hash orders aren't SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each reads what the one before it wrote, and what it needed besides is dropped once it has written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        start = mark()
        docs, path = materialise(stage(spark, docs, sf_dir), name)
        for old in [*before, *(p for p in made_since(start) if p != path)]:
            drop_path(spark, old)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
