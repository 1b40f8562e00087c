"""Spark operators for variant, repeat, ancestry, methylation and association tables of a cohort."""
