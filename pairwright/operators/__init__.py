"""DataFrame -> DataFrame operators for curating pair corpora."""
