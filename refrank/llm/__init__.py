"""Operators for preparing large text corpora: deduplication, pseudonyms, decontamination, quality
and toxicity scoring, tokenisation. Every operator takes DataFrames and returns DataFrames; nothing
outside this package imports it."""
