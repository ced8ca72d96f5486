"""DataFrame operators over whole tables."""
