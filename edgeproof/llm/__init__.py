"""Training-data operators: deduplication, decontamination, scoring, mixing, fixity and media.

Nothing else in the package imports this subpackage; ``__spark_entry__.py`` adds its queries only if it is present.
"""
