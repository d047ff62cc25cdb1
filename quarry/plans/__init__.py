"""Plans compiled to DataFrame expressions: mappings, normalisation, extraction."""
