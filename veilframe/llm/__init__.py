"""Training-data operators: mixing, fingerprints, language id, toxicity, decontamination,
token counts, packing, n-gram joins, secret scans and WARC archives.

Nothing outside this subpackage imports it.
"""
