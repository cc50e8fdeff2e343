"""Writers: packed shards and flat token files."""
