"""Readers and writers for the record, segment, paired-chain and result files."""
