"""Training-data operators: deduplication, decontamination, secret scans, language
identification, tokenisation, quality rules and models, HTML rendering.

Nothing else in the library imports this package.  ``queries`` registers one query
per operator; ``/corpus_pipeline.py`` chains five of them."""
