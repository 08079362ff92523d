"""DataFrame jobs for catalogues of agent packages and for large text corpora."""
