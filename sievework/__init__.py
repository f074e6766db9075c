"""Sievework: duplicate finding, review and clean-up of file catalogs as Spark DataFrame plans."""
