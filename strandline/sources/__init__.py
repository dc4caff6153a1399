"""Readers and writers of interval text and genome files."""

from .bed import format_bed, from_numpy, parse_bed, read_bed, to_numpy, write_bed
from .genome import chrom_size, chromosomes, genome_frame, has_chrom, insert, read_genome
from .validate import validate_sorted

__all__ = ["chrom_size", "chromosomes", "format_bed", "from_numpy", "genome_frame", "has_chrom", "insert", "parse_bed", "read_bed", "read_genome", "to_numpy", "validate_sorted", "write_bed"]
