"""Readers and writers of sequence, region and table files, and of counters."""
