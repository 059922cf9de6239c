"""Tables on disk: appends, upserts, retention and the sample data."""
