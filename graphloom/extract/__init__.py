"""File contents to nodes and edges: one extractor per family of languages, run on executors."""
