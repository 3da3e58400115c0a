"""Sparse point labels on images to dense class rasters, scored regions and annotation tables, as Spark plans."""
