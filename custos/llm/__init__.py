"""Training-data operators: quality, language, deduplication, decontamination,
mixing, token counts, chat linking, page extraction and vector search.

Nothing else in the library imports this subpackage; it may import general
helpers (``custos.session``). Every operator is a function from DataFrames to a
DataFrame with its own general interface; ``queries`` derives the registered
``opN_*`` queries from them and ``oracle`` holds the SQL where there is one.
"""
