"""DataFrame operators: ingest, dimension/fact upserts, price queries, monitoring, quality."""
