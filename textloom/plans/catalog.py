"""All registered queries of the text-forensics part, with their SQL counterparts."""

from __future__ import annotations

from textloom.functions import evaluation, operating_points, resampling, stats
from textloom.operators import background, carriers, corpora, corpus, diff, document_measures, forensics, gram_counts, markdown, measured_rules, phrases, rules, sentence_spans, source_maps, structure, stylometry, verdicts, watermark, wordpiece, writing_rules
from textloom.sources import text_files
from textloom.streaming import admission, quota

_PARTS = (stylometry, rules, writing_rules, measured_rules, verdicts, carriers, forensics, corpus, corpora, document_measures, structure, sentence_spans, markdown, source_maps, diff, background, watermark, wordpiece, gram_counts, phrases, stats, evaluation, operating_points, resampling, quota, admission, text_files)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "stylometry"
