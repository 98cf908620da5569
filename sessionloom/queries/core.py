"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from sessionloom.queries import part1, part2, part3, part4

PARTS = (part1, part2, part3, part4)
QUERIES = {k: q for p in PARTS for k, q in p.QUERIES.items()}
ORACLE = {k: q for p in PARTS for k, q in p.ORACLE.items()}
