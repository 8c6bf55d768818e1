"""Readers and writers for games, puzzles, manifests, annotations, suites, chunks, logs and catalogues."""
