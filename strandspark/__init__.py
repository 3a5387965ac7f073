"""Spark-native read-backed haplotype phasing and allele-specific expression."""
