"""Genotype / phenotype analytics expressed as Spark DataFrame operators."""
