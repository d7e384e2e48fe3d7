"""DataFrame transforms over the posting, ledger and snapshot tables."""
