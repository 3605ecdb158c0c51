"""Schemas of the core tables, as DDL."""

READS = "file STRING, ordinal BIGINT, name STRING, comment STRING, seq STRING, qual STRING"
ALIGNMENTS = (
    "file STRING, ordinal BIGINT, qname STRING, flag INT, tid INT, chrom STRING, pos BIGINT, mapq INT, "
    "cigar ARRAY<STRUCT<op: INT, len: INT>>, l_qseq INT, seq STRING, qual STRING"
)
CONTIGS = "file STRING, tid INT, chrom STRING, length BIGINT"
SEGMENTS = "chrom STRING, start BIGINT, end BIGINT, depth BIGINT"

#: CIGAR operation codes.
M, I, D, N, S, H, P, EQ, X = range(9)
#: Flag bits: unmapped, secondary, failed quality control, duplicate.
UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE = 4, 256, 512, 1024
STRICT_MASK = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
