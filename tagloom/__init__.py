"""DataFrame operators for multi-label text coding at scale."""
