"""Named queries over the standard tables, with their SQL where SQL can express them."""

from __future__ import annotations

from . import association, files, genomes, graphs, reads, relational, sequences, taxa

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (genomes, taxa, sequences, reads, association, graphs, relational, files):
    QUERIES |= _module.PLANS.queries
    ORACLES |= _module.PLANS.oracles
