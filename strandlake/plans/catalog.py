"""Every registered query and its SQL."""

from __future__ import annotations

from strandlake.plans import association, cohort, dossier, loci, review, rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (rows.plans, cohort.plans, association.plans, review.plans, loci.plans, dossier.plans):
    QUERIES |= _part.queries
    ORACLE |= _part.sql
