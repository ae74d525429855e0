"""Readers and writers: FASTA, FASTQ, whitelists, packed pairs, score tables and saved results."""
