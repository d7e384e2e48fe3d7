"""Readers and writers: postings, ledgers, ticks, pages and provider feeds."""
