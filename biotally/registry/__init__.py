"""All registered queries, gathered from the domain modules."""

from __future__ import annotations

import importlib

DOMAINS = ("sequences", "digests", "epitope_jobs", "codon_jobs", "resistance_jobs", "outbreaks", "guide_jobs", "primer_jobs",
           "search_jobs", "screening_jobs", "pharma_jobs", "plate_jobs", "variant_jobs", "record_jobs", "stream_jobs")


def load():
    from biotally.registry.core import JOBS, ORACLES

    for name in DOMAINS:
        importlib.import_module(f"biotally.registry.{name}")
    return JOBS, ORACLES
