"""Training-data operators: near-duplicates, tokens, licences, languages, leaks,
secrets, quality, personal data, web archives and embedding neighbours."""
