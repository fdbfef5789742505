"""Schemas of the tables that operators exchange."""

GENOMES = "genome string, role string, contig string, contig_idx int, length long, circular boolean"
CHUNKS = "genome string, contig string, start long, seq string"
KMER_COUNTS = "genome string, role string, k int, kmer string, n long"
SITES = "genome string, primer string, strand string, pos long"
CANDIDATES = "primer string, fg_count long, bg_count long, bl_freq double, gini double, ratio double"
SETS = "set_index int, score double, coverage double, selectivity double"
SET_MEMBERS = "set_index int, primer string"
#: Weights of roles in penalties: targets cost nothing, blacklisted genomes most.
ROLE_PENALTY = {"target": 0.0, "background": 1.0, "blacklist": 5.0}
