"""Training-data operators: near-dedup, fingerprints, secret scans, substring
dedup, packing, language ID, URL filters, quality rules, piece encoding and
license scans. Nothing outside this subpackage imports it."""
