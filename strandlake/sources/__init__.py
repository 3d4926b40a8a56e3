"""Readers and writers: FASTA, index tables, hit lines, exchange formats."""
