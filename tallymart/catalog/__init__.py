"""Every query by name, with independent SQL to check it against."""
