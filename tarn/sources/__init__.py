"""Lake tables, landed payloads, contracts and object listings."""
