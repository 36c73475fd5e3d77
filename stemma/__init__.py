"""Genealogical data-quality jobs on Spark: tables in, tables out."""
