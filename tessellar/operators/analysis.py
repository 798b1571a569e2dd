"""One analysis of a repository from end to end: requirements, links, findings, what changes, and the receipt that says so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.operators import assurance, sinks
from tessellar.sources.tables import written


def analyse(files: DataFrame, symbols: DataFrame, tested: DataFrame, known_findings: DataFrame, known_requirements: DataFrame) -> dict[str, DataFrame]:
    """requirements, implements, findings, delta (id, status, change), requirement_states and receipt of files (path, classification, text).

    What is known are findings (id, status) and requirements (path, identity, status). Each step is written before the
    next reads it; the receipt is one row of counts.
    """
    docs = assurance.prose(files)
    needs = written(assurance.requirements(docs))
    found = written(assurance.analyze(files, symbols, tested, docs, needs))
    links = written(assurance.implementation_links(needs, symbols))
    ids = found.select(assurance.fingerprint(F.col("type"), F.col("path"), F.col("line"), F.col("start_byte")).alias("id"))
    delta = written(sinks.findings_delta(known_findings, ids))
    states = written(assurance.reconcile_requirements(known_requirements, needs))
    cover = assurance.requirement_coverage(needs, links, assurance.tested_requirements(files))
    superseded = states.agg(F.count_if(F.col("state") == "superseded").alias("superseded"))
    receipt = sinks.delta_counts(delta).join(cover, F.lit(True)).join(superseded, F.lit(True))  # one row each
    return {"requirements": needs, "implements": links, "findings": found, "delta": delta, "requirement_states": states, "receipt": receipt}
